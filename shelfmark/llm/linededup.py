"""Line deduplication across documents by a deletion-neighbourhood join.

A line is the sequence of its words. Lines of any length are duplicates when
their words are equal, lines of at least ``MIN_NEAR`` words also when one word
edit (a word replaced, inserted or deleted) turns one into the other: from
there on four of five words agree. A line goes when an earlier line is its
duplicate; "earlier" is the order of (doc_id, fingerprint of the text, line number).

Steps, all of them aggregations and equi-joins of built-in functions:

1. Every line occurrence gets a 128-bit key; equal lines collapse, with a
   map-side combine, to the place of the first.
2. Lines one word edit apart share their first or their last half, and of
   ``PARTS`` equal parts all but one. Lines whose half-line hashes, and then
   whose hashes of all parts but one, nobody else has cannot have a neighbour
   and drop out, so the variants below are only made where there can be a match.
3. A remaining line emits the hash of every variant with one word deleted, with
   the deleted position, and the hash of itself. Lines with an equal variant
   and position differ in that word; a line that equals a variant of another is
   one deletion away. Both relations need only the earliest line of each group,
   so no pairs are formed inside a group, however large.
4. The earliest neighbour of each line is verified word by word.

Defined cases: null text has no lines; blank lines are never duplicates; rows
repeated with equal id and text are one document (their lines are kept or go
alike); a null doc_id sorts first; an empty table gives an empty result; other
columns of the table are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark._util import with_once
from shelfmark.llm.common import join_split, pick, stored, words

#: Lines of fewer words get no row (a blank line has none).
MIN_EXACT = 1
MIN_NEAR = 5
#: Shortest line that without_duplicates cuts, unless the caller names another.
LEAST_CUT = 5
PARTS = 8
#: Up to so many documents (about 50 bytes each) with so many line numbers in all, the lines to
#: fetch or to cut are broadcast to the documents; beyond that both are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_LINES = 200_000, 1_000_000


def _key() -> list[Column]:
    return [F.xxhash64("w").alias("k1"), F.xxhash64(F.lit("second"), "w").alias("k2")]


def _halves(n: Column) -> Column:
    """Hashes of the first and last halves that a neighbour must share one of."""
    long, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def both(size: Column) -> list[Column]:
        return [F.xxhash64(F.lit("p"), size, F.slice("w", F.lit(1), size)),
                F.xxhash64(F.lit("s"), size, F.slice("w", n - size + 1, size))]

    return F.when(n >= MIN_NEAR, F.array_distinct(F.array(*both(long), *both(short)))).otherwise(F.array().cast("array<bigint>"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_EXACT) -> DataFrame:
    """Every line of at least ``least`` words: its place, keys and half-line hashes, no text."""
    df = pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").isNotNull())
    df = df.select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    df = with_once(df, words(F.col("line")), "w").filter(F.size("w") >= least)
    return df.select(F.struct("doc_id", "tk", "line_no").alias("at"), *_key(), _halves(F.size("w")).alias("halves"))


def _all_but_one() -> Column:
    """Hashes of a line without one of its PARTS, cut by its own length and by that of a line one word shorter.

    An edit of a line of m words at some place leaves the words before the
    place's part and those after it as they are.
    """
    n = F.size("w")

    def cut(m: Column, j: int) -> Column:
        start, end = F.floor(m * j / PARTS).cast("int"), F.floor(m * (j + 1) / PARTS).cast("int")
        return F.xxhash64(m, F.lit(j), F.slice("w", F.lit(1), start), F.lit("|"), F.slice("w", n - (m - end) + 1, m - end))

    return F.array(*[cut(m, j) for m in (n, n - 1) for j in range(PARTS)])


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that lines with different k1 have."""
    return rows.groupBy(key).agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo != hi").select(key)


def _prefix_xor(values: Column) -> Column:
    """Running XOR of an array, by doubling steps: n log n, one expression."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(
        acc, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("bigint")))))


def variants(lines: DataFrame) -> DataFrame:
    """(…, v, i): hash of each line with word i left out, and of the whole line with i = -1.

    A line's hash is the XOR of its words' hashes salted with their positions;
    after a deletion the later words stand one place earlier.
    """
    df = with_once(lines, F.transform("w", lambda x, i: F.xxhash64(x, i)), "here")
    df = with_once(df, F.transform("w", lambda x, i: F.xxhash64(x, i - 1)), "left")
    df = with_once(df, _prefix_xor(F.col("here")), "upto")
    df = with_once(df, _prefix_xor(F.col("left")), "upto_left")
    total, zero = F.element_at("upto", -1), F.lit(0).cast("bigint")
    gone = F.transform("upto_left", lambda x, i: F.struct(
        F.coalesce(F.get("upto", i - 1), zero).bitwiseXOR(F.element_at("upto_left", -1)).bitwiseXOR(x).alias("v"), i.alias("i")))
    whole = F.array(F.struct(total.alias("v"), F.lit(-1).alias("i")))
    rest = [c for c in df.columns if c not in ("w", "here", "left", "upto", "upto_left")]
    return df.select(*rest, F.explode(F.concat(whole, gone)).alias("x")).select(*rest, "x.v", "x.i")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different word arrays are one word edit apart (checked on the words)."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    at = F.coalesce(F.get(differ, 0), n) + 1   # first place (from 1) where they differ

    def tail(x: Column, start: Column) -> Column:
        return F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))

    return (F.when(F.size(a) == F.size(b), F.size(differ) <= 1)
            .when(F.size(a) == F.size(b) + 1, tail(a, at + 1) == tail(b, at))
            .when(F.size(b) == F.size(a) + 1, tail(b, at + 1) == tail(a, at))
            .otherwise(False))


def _small(places: DataFrame, numbers: str) -> DataFrame:
    """``places`` (one row a document, with line numbers), marked for broadcast if its counted size is within the bounds."""
    rows, lines = places.agg(F.count("*"), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    return F.broadcast(places) if rows <= BROADCAST_ROWS and lines <= BROADCAST_LINES else places


def near_duplicates(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, near_at): lines that have an earlier verified neighbour, with the earliest one's place."""
    halves = distinct.select("k1", F.explode("halves").alias("half"))
    near = halves.join(_shared(halves, "half"), "half", "left_semi").select("k1").distinct()
    wanted = distinct.join(near, "k1").select("at")
    # The words of the wanted lines, from the documents that hold their first occurrences.
    places = (wanted.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tk").alias("tk"))
              .agg(F.collect_set("at.line_no").alias("nos")))
    places = _small(stored(places, "line-places"), "nos")
    texts = (pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").isNotNull())
             .withColumn("tk", F.xxhash64("text")))
    there = texts.alias("t").join(places.alias("p"), (F.col("t.tk") == F.col("p.tk")) & F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")))
    there = there.select("t.doc_id", "t.tk", "p.nos", F.split("t.text", "\n").alias("ln"))
    there = there.select("doc_id", "tk", F.explode(F.transform("nos", lambda i: F.struct(
        i.alias("line_no"), F.get("ln", i).alias("line")))).alias("x"))
    lines = with_once(there.select("doc_id", "tk", "x.line_no", "x.line"), words(F.col("line")), "w")
    lines = lines.select(*_key(), F.struct("doc_id", "tk", "line_no").alias("at"), "w").dropDuplicates(["k1", "k2", "at"])
    lines = stored(lines, "line-words")
    # Stored, as both sides of the semi-join read it: the hashes are the dearest step of all.
    rest = stored(lines.select("k1", F.explode(_all_but_one()).alias("rest")), "line-rests")
    close = rest.join(_shared(rest, "rest"), "rest", "left_semi").select("k1").distinct()
    lines = stored(lines.join(close, "k1", "left_semi"), "close-lines")

    made = stored(variants(lines), "line-variants")
    me = F.struct("at", "k1", "k2")
    gone, whole = made.filter("i >= 0"), made.filter("i < 0")
    by_place = gone.groupBy("v", "i").agg(F.min(me).alias("m"), F.max("at").alias("last")).filter("m.at < last").drop("last")
    by_rest = gone.groupBy("v").agg(F.min(me).alias("m"))
    replaced = gone.join(by_place, ["v", "i"]).select("k1", "k2", "at", "m")
    longer = gone.join(whole.select("v", me.alias("m")), "v").select("k1", "k2", "at", "m")
    shorter = whole.join(by_rest, "v").select("k1", "k2", "at", "m")
    claims = (replaced.unionByName(longer).unionByName(shorter).filter("m.at < at")
              .groupBy("k1", "k2", "at").agg(F.min("m").alias("m")))
    other = lines.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("w").alias("ow"))
    claims = claims.select("k1", "k2", F.col("m.at").alias("near_at"), F.col("m.k1").alias("o1"), F.col("m.k2").alias("o2"))
    checked = (claims.join(lines.select("k1", "k2", "w"), ["k1", "k2"]).join(other, ["o1", "o2"])
               .filter(one_edit(F.col("w"), F.col("ow"))))
    return checked.groupBy("k1", "k2").agg(F.min("near_at").alias("near_at"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_EXACT) -> DataFrame:
    """One row a line of at least ``least`` words: its place, kept, and the place of the line it repeats."""
    every = stored(line_table(docs, id_col, text_col, least), "lines")
    distinct = stored(every.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.first("halves").alias("halves"),
                                                    F.count("*").alias("n")), "distinct-lines")
    near = near_duplicates(docs, distinct.filter(F.size("halves") > 0), id_col, text_col)
    # Only lines that occur again, or have a neighbour, can go.
    matter = (distinct.select("k1", "k2", F.col("at").alias("first_at"), "n").join(near, ["k1", "k2"], "left")
              .filter((F.col("n") > 1) | F.col("near_at").isNotNull())
              .select("k1", "k2", "first_at", "near_at", "n"))
    # All places of a line get its first one: a very common line's are split over several tasks.
    out = join_split(every.select("at", "k1", "k2"), stored(matter, "lines-that-matter"), ["k1", "k2"], "n")
    origin = F.coalesce(F.least("first_at", F.coalesce("near_at", "first_at")), "at")
    return (out.select("at", origin.alias("origin"))
            .select("at.doc_id", "at.tk", "at.line_no", (F.col("at") == F.col("origin")).alias("kept"),
                    F.col("origin.doc_id").alias("first_doc_id"), F.col("origin.line_no").alias("first_line_no")))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CUT) -> DataFrame:
    """The documents with duplicate lines of at least ``least`` words cut out; documents of which nothing is left go.

    All columns stay; documents that lose no line stay as they are.
    """
    cut = (line_dedup(docs, id_col, text_col, least).filter(~F.col("kept"))
           .groupBy("doc_id", "tk").agg(F.collect_set("line_no").alias("gone"))
           .select(F.col("doc_id").alias("_cut_id"), F.col("tk").alias("_cut_tk"), F.col("gone").alias("_cut_gone")))
    cut = _small(stored(cut, "cut-lines"), "_cut_gone")
    text = F.col(f"`{text_col}`")
    df = docs.join(cut, (F.xxhash64(text) == F.col("_cut_tk")) & F.col(f"`{id_col}`").eqNullSafe(F.col("_cut_id")), "left")
    df = with_once(df, F.when(F.col("_cut_gone").isNotNull(), F.split(text, "\n")), "_cut_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_cut_lines") - 1), F.col("_cut_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("_cut_lines", i)), "\n")
    df = with_once(df, F.when(F.col("_cut_gone").isNotNull(), left), "_cut_left")
    df = df.filter(F.col("_cut_gone").isNull() | F.col("_cut_left").rlike(r"[^\x20\x09-\x0D]"))
    return df.select(*[F.coalesce(F.col("_cut_left"), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
