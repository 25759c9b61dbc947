"""Provider snapshots: raw JSON responses -> one metadata record per key.

A snapshot table holds the responses a provider gave for requested keys:
``(isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP)``.
Parsing is a map-side projection (VARIANT, no UDF); only the compact parsed
record is shuffled, never the raw body.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import json as J
from ..session import require_conf
from .keyfilter import only_keys

META_FIELDS = (
    "isbn_10", "isbn_13", "title", "authors", "publisher",
    "publication_date", "pages", "categories",
)
META_DDL = (
    "isbn_10 STRING, isbn_13 STRING, title STRING, authors ARRAY<STRING>, publisher STRING, "
    "publication_date STRING, pages BIGINT, categories ARRAY<STRING>"
)
SNAPSHOT_DDL = "isbn STRING, status_code INT, body STRING, fetched_at TIMESTAMP"


def _meta(isbn_10=None, isbn_13=None, title=None, authors=None, publisher=None,
          publication_date=None, pages=None, categories=None) -> Column:
    blank = F.lit("")
    return F.struct(
        (isbn_10 if isbn_10 is not None else blank).alias("isbn_10"),
        (isbn_13 if isbn_13 is not None else blank).alias("isbn_13"),
        (title if title is not None else blank).alias("title"),
        (authors if authors is not None else F.lit(None).cast("array<string>")).alias("authors"),
        (publisher if publisher is not None else blank).alias("publisher"),
        (publication_date if publication_date is not None else blank).alias("publication_date"),
        (pages if pages is not None else F.lit(0).cast("bigint")).alias("pages"),
        (categories if categories is not None else F.lit(None).cast("array<string>")).alias("categories"),
    )


def _parsed_body() -> Column:
    # Trailing bytes after the first value are ignored, like a streaming decoder.
    return F.try_parse_json(F.col("body"))


def _last_key_wins(df: DataFrame) -> None:
    """Duplicate JSON keys keep the last value (a streaming decoder's rule);
    the parse needs the session setting that says so."""
    require_conf(df.sparkSession, "spark.sql.variant.allowDuplicateKeys")


def _when() -> Column:
    """Which response of a key is the latest: fetch time, then status code,
    then a hash of the body, so a tie has one answer in any row order."""
    at = F.coalesce(F.col("fetched_at"), F.timestamp_seconds(F.lit(0)))
    return F.struct(at.alias("at"), F.coalesce("status_code", F.lit(-1)).alias("status"),
                    F.xxhash64("body").alias("body")).alias("fetched")


_A_FIELDS = ("title", "authors", "publishers", "publish_date", "number_of_pages", "subjects")
_B_FIELDS = ("title", "authors", "publisher", "publishedDate", "pageCount", "language", "categories",
             "industryIdentifiers")


def _fields(v, names) -> Column:
    """One cast of an object into STRUCT of VARIANT members (exact-case keys);
    NULL when ``v`` is not an object. Cheaper than one path lookup per field."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def parse_provider_a(snapshot: DataFrame) -> DataFrame:
    """Lenient, field-by-field typed extraction.

    Hit iff status 200, the body is a JSON object and its member
    ``"ISBN:" + key`` is an object (``{}`` is a hit with blank fields).
    Wrong-typed fields are left blank; the record is still a hit.
    Stages are separate projections so the parsed document is computed once
    per row (the optimizer keeps a non-cheap alias that is used twice).
    """
    _last_key_wins(snapshot)
    doc = F.try_variant_get(_parsed_body(), "$", "map<string,variant>")
    key = F.concat(F.lit(fixed.PROVIDER_A_KEY_PREFIX), F.col("isbn"))
    staged = snapshot.select(
        "isbn", "fetched_at", _when(), "status_code", F.element_at(doc, key).alias("rec")
    ).select(
        "isbn", "fetched_at", "fetched", "status_code", _fields("rec", _A_FIELDS).alias("f")
    ).select(
        "isbn", "fetched_at", "fetched",
        F.coalesce((F.col("status_code") == 200) & F.col("f").isNotNull(), F.lit(False)).alias("hit"),
        "f", J.get("f.publishers", "$[0]").alias("first_pub"),
    )
    pages = F.col("f.number_of_pages")
    meta = _meta(
        title=J.string_or_blank("f.title"),
        authors=J.object_names("f.authors"),
        publisher=F.when(J.is_object("first_pub"), J.string_or_blank(J.get("first_pub", "$.name")))
        .otherwise(F.lit("")),
        publication_date=J.string_or_blank("f.publish_date"),
        # JSON numbers are doubles in the tool; int() truncates toward zero.
        pages=F.coalesce(F.when(J.is_number(pages), F.try_variant_get(pages, "$", "bigint")), F.lit(0))
        .cast("bigint"),
        categories=J.object_names("f.subjects"),
    )
    return staged.select("isbn", "fetched_at", "fetched", "hit", F.when(F.col("hit"), meta).alias("meta"))


def _identifier_ok(e: Column) -> Column:
    return J.is_object(e) & J.strict(J.get(e, "$.type"), J.is_string) \
        & J.strict(J.get(e, "$.identifier"), J.is_string)


def _b_fields_ok(f: Column) -> Column:
    """Every declared volumeInfo member (``f``: the members cast out once)
    decodes into its type."""
    def field(name: str, ok) -> Column:
        return J.strict(f.getField(name), ok)

    return (
        field("title", J.is_string) & J.strict_string_array(f.getField("authors"))
        & field("publisher", J.is_string) & field("publishedDate", J.is_string)
        & field("pageCount", J.is_integer) & field("language", J.is_string)
        & J.strict_string_array(f.getField("categories"))
        & J.strict_object_array(f.getField("industryIdentifiers"), ("type", "identifier"), _identifier_ok)
    )


def _b_volume_ok(vi: Column) -> Column:
    """Every declared member of a volumeInfo object decodes into its type."""
    f = _fields(vi, _B_FIELDS)
    return J.is_absent(vi) | (f.isNotNull() & _b_fields_ok(f))


def _item_ok(it: Column) -> Column:
    return J.is_absent(it) | (J.is_object(it) & _b_volume_ok(J.get(it, "$.volumeInfo")))


def _string_list(v: Column) -> Column:
    # JSON null elements of a []string stay "" (zero value); the lambda only
    # runs when the list holds a null.
    arr = F.try_variant_get(v, "$", "array<string>")
    return F.when(F.size(arr) == F.size(F.array_compact(arr)), arr).otherwise(
        F.transform(arr, lambda s: F.coalesce(s, F.lit(""))))


def _last_identifier(ids: Column, kind: str) -> Column:
    """Identifier of the last element of type ``kind`` ('' if none)."""
    at = F.array_position(F.reverse(ids.getField("type")), kind)
    return F.when(at > 0, F.coalesce(F.element_at(ids.getField("identifier"), -at.cast("int")), F.lit(""))) \
        .otherwise(F.lit(""))


def parse_provider_b(snapshot: DataFrame) -> DataFrame:
    """Strict decode against the fixed volume shape.

    Any wrong-typed declared member in any item (including the unused
    ``language``) makes the whole response a miss. Hit iff status 200, the
    decode succeeds, ``totalItems`` is non-zero and there is a first item.

    Only what a decision needs is extracted: the first item is read by path
    (an existing ``items[0]`` also proves ``items`` is an array), its
    volumeInfo members come out of one struct cast, and the item list is
    materialised only when a second item exists (the per-item lambda).
    """
    _last_key_wins(snapshot)
    staged = snapshot.select(
        "isbn", "fetched_at", _when(), "status_code", _parsed_body().alias("v")
    ).select(
        "isbn", "fetched_at", "fetched", "status_code", "v",
        J.get("v", "$.totalItems").alias("total"), J.get("v", "$.items[0]").alias("item0"),
        J.get("v", "$.items[1]").isNotNull().alias("more"),
    ).withColumn("f", F.try_variant_get("item0", "$.volumeInfo", "struct<" + ", ".join(
        f"{n}: variant" for n in _B_FIELDS) + ">"))

    f = F.col("f")
    vi_ok = F.when(f.isNotNull(), _b_fields_ok(f)).otherwise(J.is_absent(J.get("item0", "$.volumeInfo")))
    item0_ok = J.is_absent("item0") | (J.is_object("item0") & vi_ok)
    items = J.elements(J.get("v", "$.items"))
    rest_ok = F.when(F.col("more"), F.forall(F.slice(items, 2, F.size(items) - 1), _item_ok)).otherwise(F.lit(True))
    total_n = F.coalesce(F.try_variant_get("total", "$", "bigint"), F.lit(0))
    decoded = J.is_object("v") & J.strict(F.col("total"), J.is_integer) & item0_ok & rest_ok
    hit = F.coalesce((F.col("status_code") == 200) & (total_n != 0) & F.col("item0").isNotNull() & decoded,
                     F.lit(False))
    staged = staged.select("isbn", "fetched_at", "fetched", hit.alias("hit"), "f")
    ids = F.try_variant_get(f.getField("industryIdentifiers"), "$", "array<struct<type: string, identifier: string>>")
    meta = _meta(
        isbn_10=_last_identifier(ids, fixed.IDENTIFIER_TYPE_10),
        isbn_13=_last_identifier(ids, fixed.IDENTIFIER_TYPE_13),
        title=J.string_or_blank(f.getField("title")),
        authors=_string_list(f.getField("authors")),
        publisher=J.string_or_blank(f.getField("publisher")),
        publication_date=J.string_or_blank(f.getField("publishedDate")),
        pages=F.coalesce(F.try_variant_get(f.getField("pageCount"), "$", "bigint"), F.lit(0)).cast("bigint"),
        categories=_string_list(f.getField("categories")),
    )
    return staged.select("isbn", "fetched_at", "fetched", "hit", F.when(F.col("hit"), meta).alias("meta"))


def latest_response(parsed: DataFrame) -> DataFrame:
    """The most recent response per key wins, hit or miss (``_when`` breaks ties).

    A grouped max_by with a map-side partial aggregate: a key with millions
    of responses collapses before the shuffle instead of landing in one task.
    Output is hash-partitioned by ``isbn`` (reused by the resolve joins).
    """
    return (
        parsed.groupBy("isbn")
        .agg(F.max_by(F.struct("hit", "meta"), F.col("fetched")).alias("r"))
        .select("isbn", F.col("r.hit").alias("hit"), F.col("r.meta").alias("meta"))
    )


@dataclass(frozen=True)
class Provider:
    """One metadata source in the fallback chain (lower priority wins)."""

    name: str
    priority: int
    snapshot: DataFrame
    parse: Callable[[DataFrame], DataFrame]

    def latest(self, keys: DataFrame | None = None, n: int = 0) -> DataFrame:
        """The latest responses; with ``keys`` (a ``key_filter`` made for ``n`` keys) hardly any for other keys, and
        what is left out is not parsed."""
        return latest_response(self.parse(only_keys(self.snapshot, keys, n)))

    def hits(self, keys: DataFrame | None = None, n: int = 0) -> DataFrame:
        """Keys whose latest response is a hit, with their metadata."""
        return self.latest(keys, n).where("hit").select("isbn", "meta")


def default_providers(snapshot_a: DataFrame, snapshot_b: DataFrame) -> list[Provider]:
    """The tool's fixed chain: provider A first, provider B as fallback."""
    return [
        Provider("provider_a", 1, snapshot_a, parse_provider_a),
        Provider("provider_b", 2, snapshot_b, parse_provider_b),
    ]
