"""Near-duplicate documents by circulant MinHash.

A document's set holds the hashes of its distinct word shingles. Two fixed
permutations of a universe of ``UNIVERSE`` bins make the whole signature: the
first places a shingle's bin, the second, shifted circularly by k, gives
coordinate k. So the coordinates of one shingle are one contiguous window of
the second permutation, and a signature is the minimum over such windows.

Signatures are cut into bands of ``ROWS`` coordinates; documents that agree on
a band meet in a bucket. The number of bands follows from the threshold so that
a linked pair meets nowhere with a chance below ``MISS``. Documents with equal
sets are one vertex from the start. Links are confirmed by the exact Jaccard
similarity of the full sets.

Each vertex also carries a parity bitmap of its set: an item flips one of
``BITMAP`` bits. Two bitmaps differ in no more bits than the sets in items, so
a pair whose bitmaps differ in more bits than a linked pair's sets may is left
out by a few instructions, without a doubt and without its sets.

No bucket is expanded into its pairs. A round holds every member of a bucket
against one hub, tests what the bitmaps let through, merges what is linked, and
the next looks only at buckets whose members are still in several components,
with another hub. After ``ROUNDS`` rounds the pairs of different components in
a bucket that pass the bitmaps, few by then, are tested. Nothing is capped:
every pair that shares a bucket is connected, ruled out or tested.

Defined cases: null and wordless texts have an empty set and are linked with
nothing; a text with fewer words than a shingle is one shingle of all its
words; rows repeated with equal id keep equal results; a null doc_id is never
the smallest of a group that has another; other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, slices, stored, worker_state

UNIVERSE = 1 << 20
ROWS = 5
MISS = 1e-7
ROUNDS = 3
BITMAP = 1024
BITS = [f"w{i}" for i in range(BITMAP // 64)]
SLICE = 8192

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z in lower case)."""
    words = (text or "").encode("utf-8").lower().split()   # bytes: only A-Z change, and only \x20 \x09-\x0D part words
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(len(words) if len(words) < size else size))
    for k in range(min(size, len(words))):
        out = mix(out * _MIX + h[k:k + n])
    return np.unique(out)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


class Circulant:
    """The two permutations, and signatures from them."""

    def __init__(self, bands: int):
        self.size = bands * ROWS
        rng = np.random.default_rng(20240131)
        self.place = rng.permutation(UNIVERSE).astype(np.int64)
        order = rng.permutation(UNIVERSE).astype(np.int32)
        around = np.concatenate([order[-(self.size - 1):], order])
        # Row j: the second permutation at bin j under the shifts size - 1 ... 0.
        self.shifted = np.lib.stride_tricks.sliding_window_view(around, self.size)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        bins = np.unique(self.place[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)])
        out = np.full(self.size, UNIVERSE, np.int32)
        for a in range(0, len(bins), SLICE):
            np.minimum(out, self.shifted[bins[a:a + SLICE]].min(axis=0), out=out)
        return out

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.signature(hashes).reshape(-1, ROWS).astype(np.uint64)
        key = mix(np.arange(1, len(rows) + 1, dtype=np.uint64) * _MIX)
        for k in range(ROWS):
            key = mix(key * _MIX + rows[:, k])
        return key


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set: bit i says whether an odd number of items fall on i."""
    odd = np.bincount((hashes % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether the bitmaps and sizes of the sides ``x`` and ``y`` leave a link possible."""
    apart = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in BITS), F.lit(0)).cast("bigint")
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((apart * (100 + percent) <= (a + b) * (100 - percent))
            & (F.least(a, b) * 100 >= F.greatest(a, b) * percent))


def _circulant(bands: int) -> Circulant:
    state = worker_state("neardedup")
    if ("circulant", bands) not in state:
        state["circulant", bands] = Circulant(bands)
    return state["circulant", bands]


def sketches(docs: DataFrame, size: int, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, n_shingles, v, keys, w0 …): the vertex ``v`` is a 128-bit digest of the set (null if empty)."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("tk"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = _circulant(bands)
        for batch in slices(batches):
            n, a, b, keys, bits = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, size)
                n.append(len(own))
                data = own.tobytes()
                a.append(np.int64(np.uint64(xxhash.xxh64_intdigest(data, 1))) if len(own) else None)
                b.append(np.int64(np.uint64(xxhash.xxh64_intdigest(data, 2))) if len(own) else None)
                keys.append(circulant.band_keys(own).view(np.int64) if len(own) else np.empty(0, np.int64))
                bits.append(parity(own))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            bits = np.array(bits, np.int64).reshape(len(n), len(BITS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *[pa.array(bits[:, i].copy()) for i in range(len(BITS))]],
                names=["doc_id", "tk", "n_shingles", "a", "b", "keys", *BITS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, tk bigint, n_shingles bigint, a bigint, b bigint, keys array<bigint>, "
                                 + ", ".join(f"{w} bigint" for w in BITS))
    return out.select("doc_id", "tk", "n_shingles", F.when(F.col("a").isNotNull(), F.struct("a", "b")).alias("v"), "keys", *BITS)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(v, items): the whole shingle set of every wanted vertex, from the document that stands for it."""
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("tk", F.xxhash64("text"))
    there = texts.alias("t").join(wanted.alias("w"), (F.col("t.tk") == F.col("w.tk")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [shingles(t, size).view(np.int64) for t in part.column(2).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(own)))], names=["a", "b", "items"])

    made = there.select("w.v.a", "w.v.b", "t.text").mapInArrow(run, "a bigint, b bigint, items array<bigint>")
    return made.select(F.struct("a", "b").alias("v"), "items").dropDuplicates(["v"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y, …) whose full sets are similar enough."""
    x = sets.select(F.col("v").alias("x"), F.col("items").alias("xi"))
    y = sets.select(F.col("v").alias("y"), F.col("items").alias("yi"))
    both = pairs.join(x, "x").join(y, "y")
    common = F.size(F.array_intersect("xi", "yi")).cast("bigint")
    union = F.size("xi") + F.size("yi") - common
    return both.filter(common * 100 >= union * percent).drop("xi", "yi")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge list (x, y), roots left out.

    ``rows``: a bound of the edges. Alternates large-star and small-star steps; every step is a grouped
    minimum and an equi-join, written out to cut the lineage.
    """
    edges = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("w")).filter("u != w").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u != w").distinct()
        down = edges.groupBy("u").agg(F.min("w").alias("m"))
        kept = edges.join(down, "u")
        edges = stored(kept.select(F.col("w").alias("u"), F.col("m").alias("w"))
                       .unionByName(down.select("u", F.col("m").alias("w"))).filter("u != w").distinct(), "stars", rows)
        if edges.join(edges.select(F.col("u").alias("w")), "w", "left_semi").isEmpty():
            one = edges.groupBy("u").agg(F.min("w").alias("w"), F.max("w").alias("most"))
            if one.filter("w != most").isEmpty():
                return edges.select(F.col("u").alias("node"), F.col("w").alias("root"))


def _merge(labels: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Labels after testing the pairs (x, y with labels cx, cy) and joining the components of those that are linked."""
    links = linked(pairs.distinct(), sets, percent).select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    roots = components(stored(links, "links", n), n).select(F.col("node").alias("c"), "root")
    return stored(labels.join(roots, "c", "left").select("v", F.coalesce("root", "c").alias("c")), "labels", n)


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, n_shingles, component_id): the smallest doc_id linked with each document, directly or not."""
    sketch = stored(sketches(docs, size, bands_for(percent), id_col, text_col), "sketches")
    vertices = sketch.filter("v is not null").groupBy("v").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "tk")).alias("at"), F.first("keys").alias("keys"),
        F.first("n_shingles").alias("n"), *[F.first(w).alias(w) for w in BITS])
    vertices = stored(vertices, "vertices")
    placed = vertices.select("v", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo != hi").select("key")
    meeting = stored(placed.join(shared, "key"), "meeting")
    labels = stored(meeting.select("v").distinct().select("v", F.col("v").alias("c")), "labels")
    n = labels.count()
    if n:
        wanted = vertices.join(labels.select("v"), "v")
        sets = stored(full_sets(docs, wanted.select("v", "at.doc_id", "at.tk"), size, id_col, text_col), "sets")
        members = stored(meeting.join(wanted.select("v", "n", *BITS), "v"), "members")
        for turn in range(ROUNDS + 1):
            now = members.join(labels, "v")
            hub = F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v", "c", "n", *BITS))
            mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub.alias("hub")).filter("lo != hi")
            mixed = stored(mixed.select("key", "hub.*"), "mixed", n)
            if mixed.isEmpty():
                break
            left, right = now.alias("l"), (mixed if turn < ROUNDS else now.join(mixed.select("key"), "key", "left_semi")).alias("r")
            apart = F.col("l.c") != F.col("r.c") if turn < ROUNDS else F.col("l.c") < F.col("r.c")
            pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & apart & may_link("l", "r", percent))
            pairs = pairs.select(F.col("l.v").alias("x"), F.col("r.v").alias("y"), F.col("l.c").alias("cx"), F.col("r.c").alias("cy"))
            labels = _merge(labels, pairs, sets, percent, n)
    named = vertices.select("v", "least_id").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    smallest = named.groupBy("c").agg(F.min("least_id").alias("component_id"))
    of = named.join(smallest, "c").select("v", "component_id")
    out = sketch.select("doc_id", "tk", "n_shingles", "v").join(of, "v", "left")
    return out.select("doc_id", "tk", "n_shingles", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def is_kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that a document with a smaller id stands for.

    Rows repeated with equal id and text are one document: one of them stays.
    """
    found = stored(classes(docs, size, percent, id_col, text_col), "classes")
    key = [F.col("doc_id").alias("_gone_id"), F.col("tk").alias("_gone_tk")]
    gone = found.filter(~is_kept()).select(*key).distinct()
    again = found.filter(is_kept()).groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    on = (F.xxhash64(F.col(f"`{text_col}`")).eqNullSafe(F.col("_gone_tk"))) & F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_id"))
    once = docs.join(gone.unionByName(again), on, "left_anti")
    repeated = docs.join(again, on, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(repeated)
