"""Identifier functions (ISBN-10 / ISBN-13) as built-in Column expressions.

Everything here compiles to Catalyst expressions: no Python runs per row,
the checksums stay inside whole-stage codegen and are pure map-side work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .._util import col

# Java regex with \A and \z: `$` would also match before a final newline.
_ISBN10_SHAPE = r"\A[0-9]{9}[0-9Xx]\z"
_ISBN13_SHAPE = r"\A97[89][0-9]{10}\z"
# Unicode white space, the set Go's strings.TrimSpace removes (Spark's trim
# only strips U+0020).
_EDGE_SPACE = r"\A[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+\z"


def trim_space(c) -> Column:
    """Strip leading and trailing Unicode white space."""
    return F.regexp_replace(col(c), _EDGE_SPACE, "")


def normalize_id(c) -> Column:
    """remove every ASCII hyphen and space, nothing else."""
    return F.replace(F.replace(col(c), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def _digit(c: Column, i: int) -> Column:
    # 1-based character position; try_cast keeps ANSI mode from raising.
    return F.substring(c, i, 1).try_cast("int")


def _isbn10_sum(n: Column) -> Column:
    total = F.lit(0)
    for i in range(9):
        total = total + _digit(n, i + 1) * (10 - i)
    check = F.when(F.upper(F.substring(n, 10, 1)) == "X", F.lit(10)).otherwise(_digit(n, 10))
    return total + check


def _isbn13_sum(n: Column) -> Column:
    total = F.lit(0)
    for i in range(12):
        total = total + _digit(n, i + 1) * (1 if i % 2 == 0 else 3)
    return total


def is_isbn10(c) -> Column:
    """10 ASCII bytes, nine digits plus digit/X/x, weighted sum divisible by 11."""
    n = col(c)
    return F.coalesce(n.rlike(_ISBN10_SHAPE) & (_isbn10_sum(n) % 11 == 0), F.lit(False))


def is_isbn13(c) -> Column:
    """13 digits starting 978/979, weights 1,3, check = (10 - sum % 10) % 10."""
    n = col(c)
    check = (10 - _isbn13_sum(n) % 10) % 10
    return F.coalesce(n.rlike(_ISBN13_SHAPE) & (check == _digit(n, 13)), F.lit(False))


def is_valid_id(n) -> Column:
    """True iff the normalised value ``n`` is a valid ISBN-13 or ISBN-10."""
    n = col(n)
    size = F.octet_length(n)
    return F.when(size == 13, is_isbn13(n)).when(size == 10, is_isbn10(n)).otherwise(F.lit(False))


def id_type(n, ok) -> Column:
    """Type name from the byte length of ``n`` and its validity ``ok``."""
    size = F.octet_length(col(n))
    return (F.when(~col(ok), F.lit(fixed.TYPE_INVALID))
            .when(size == 13, F.lit(fixed.TYPE_ISBN13)).otherwise(F.lit(fixed.TYPE_ISBN10)))


def reject_reason(n) -> Column:
    """Message for an identifier known to be invalid: checksum messages by
    byte length (a bad prefix or a letter is a checksum failure too)."""
    size = F.octet_length(col(n))
    return (F.when(size == 13, F.lit(fixed.MSG_BAD_ISBN13)).when(size == 10, F.lit(fixed.MSG_BAD_ISBN10))
            .otherwise(F.lit(fixed.MSG_BAD_FORMAT)))


def classification(n, ok) -> Column:
    """STRUCT<type, normalized, error> from ``n`` and its validity ``ok``;
    unset members are '' as in the tool."""
    return F.struct(
        id_type(n, ok).alias("type"),
        F.when(col(ok), col(n)).otherwise(F.lit("")).alias("normalized"),
        F.when(col(ok), F.lit("")).otherwise(reject_reason(n)).alias("error"),
    )


def classify_id(c) -> Column:
    """F4 as one expression: STRUCT<type, normalized, error>.

    Length is measured in bytes, so multi-byte characters count as the tool
    counts them. A NULL input is an Invalid format error. For whole frames
    use ``operators.validate.classify``, which normalises once per row.
    """
    n = normalize_id(c)
    return classification(n, is_valid_id(n))


def isbn10_to_13(c) -> Column:
    """'978' + first nine characters + new check digit.

    Wrong byte length gives ''. The old check digit is not verified. A body
    that is not nine digits gives NULL (the tool emits an arbitrary string).
    """
    n = col(c)
    base = F.concat(F.lit("978"), F.substring(n, 1, 9))
    check = (10 - _isbn13_sum(base) % 10) % 10
    return F.when(F.octet_length(n) != 10, F.lit("")).otherwise(
        F.when(F.substring(n, 1, 9).rlike(r"\A[0-9]{9}\z"), F.concat(base, check.cast("string")))
    )
