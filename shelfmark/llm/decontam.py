"""Benchmark decontamination: a BM25 index of the test items, asked with every training passage.

The test items are the indexed side. Words are lower-case runs of letters and
digits. An item's weights are its BM25 term weights, divided by their sum, so
that the score of a passage says which share of the item's weight its words
hold and one threshold serves all items. The item space is cut into blocks and
every term has a maximum weight for each block.

A document is cut into segments of as many words as the longest item has; a
passage is two neighbouring segments, so every occurrence of an item lies whole
in some passage. For all passages of a batch at once, the block maxima of their
terms are added up; blocks that cannot reach the threshold are left out (most
passages are done with here). For the others a block-max WAND walk over the
posting lists finds all items above the threshold: the cursors stand in item
order, the pivot is where the summed maxima reach the threshold, and a block
whose maxima fall short is skipped whole.

A retrieved item counts as leaked when enough of its shingles are in the
passage: of its question and of its answer, where it has an answer, else of
the whole text. Shingles are five words long, in parts of fewer than 14 words
so much shorter that one replaced word, wherever it stands, leaves half of them.

The index goes to all tasks and holds at most ``SHARD_CHARS`` of item text; a
larger benchmark is asked shard by shard, with term statistics of all of it.

Defined cases: null or wordless documents have no passages and leak nothing;
null or wordless items are in no document; parts of fewer than five words count
when they occur as a whole; an item with a null or wordless answer is one text
(its answer overlap is null); a document that leaks several items gets a row for
each, at its best passage (the earliest on ties); rows repeated with equal id
give repeated rows; an empty table gives an empty result; other columns are
left behind.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, received, shipped, slices, stored

TOKEN = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
THRESHOLD = 0.45
SHINGLE = 5
MIN_OVERLAP = 0.5
LEAST_SEGMENT = 32
BLOCKS = 128
SHARD_CHARS = 2_000_000
BATCH_WORDS = 100_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def shingle_size(n: int) -> int:
    """Words of a shingle in a part of n words: a replaced word changes at most half of the part's shingles."""
    return n if n < SHINGLE else min(SHINGLE, (n + 1) // 3)


def shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    size = shingle_size(len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles that the passage has; 1 for an empty part."""
    wanted = shingle_set(part)
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    there = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
    return len(wanted & there) / len(wanted)


@dataclass
class Index:
    ids: list[int]
    questions: list[list[str]]
    answers: list[list[str]]
    vocabulary: dict[str, int]
    items: list[np.ndarray]        # posting lists: item numbers, ascending
    weights: list[np.ndarray]
    most: np.ndarray               # (terms,) largest weight
    block_most: np.ndarray         # (terms, blocks) largest weight in each block
    block_size: int
    segment: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def build(rows: list[tuple[int, str, str | None]], df: dict[str, int] | None = None, total: int | None = None,
          mean: float | None = None, longest: int = 0) -> Index:
    """Index of (item_id, question or whole text, answer) rows; without an answer the text is one part.

    ``df``, ``total``, ``mean`` and ``longest`` are statistics of the whole
    benchmark when the rows are one shard of it.
    """
    parts = []
    for item, text, answer in rows:
        q, a = tokens(text), tokens(answer)
        if q or a:
            parts.append((item, q, a))
    parts.sort(key=lambda x: x[0])
    counts = [Counter(q + a) for _, q, a in parts]
    lengths = [len(q) + len(a) for _, q, a in parts]
    df = df or Counter(t for c in counts for t in c)
    total = total or len(parts)
    mean = mean or (sum(lengths) / max(1, len(lengths)))
    posted: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for i, (c, n) in enumerate(zip(counts, lengths)):
        w = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in c.items()}
        whole = sum(w.values())
        for t, x in w.items():
            posted[t].append((i, x / whole))
    vocabulary = {t: k for k, t in enumerate(posted)}
    size = max(1, -(-len(parts) // BLOCKS))
    most, block_most = np.zeros(len(posted), np.float32), np.zeros((len(posted), max(1, -(-len(parts) // size))), np.float32)
    items, weights = [], []
    for k, p in enumerate(posted.values()):
        items.append(np.array([i for i, _ in p]))
        weights.append(np.array([x for _, x in p]))
        most[k] = weights[-1].max()
        np.maximum.at(block_most[k], items[-1] // size, weights[-1].astype(np.float32))
    return Index([x[0] for x in parts], [x[1] for x in parts], [x[2] for x in parts], vocabulary, items, weights,
                 most, block_most, size, max([LEAST_SEGMENT, longest, *lengths]))


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item number, score) with a score of at least the threshold, by block-max WAND."""
    found = []
    cursors = [[int(index.items[t][0]), t, 0] for t in terms]
    size = index.block_size
    slack = threshold - 1e-6          # maxima are kept in single precision
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for c in cursors:
            bound += index.most[c[1]]
            if bound >= slack:
                pivot = c[0]
                break
        if pivot < 0:
            return found
        block = pivot // size
        ahead = [c for c in cursors if c[0] <= pivot]
        # Lists that stand before the pivot may still have it.
        if sum(float(index.block_most[c[1], block]) for c in ahead) < slack:
            # Later lists may start within this block; no item before the next start or block can do.
            rest = min((c[0] for c in cursors if c[0] > pivot), default=1 << 60)
            target = min((block + 1) * size, rest)
        else:
            score = 0.0
            for c in ahead:
                at = int(np.searchsorted(index.items[c[1]], pivot))
                if at < len(index.items[c[1]]) and index.items[c[1]][at] == pivot:
                    score += float(index.weights[c[1]][at])
            if score >= threshold:
                found.append((pivot, score))
            target = pivot + 1
        for c in ahead:
            c[2] = int(np.searchsorted(index.items[c[1]], target))
            c[0] = int(index.items[c[1]][c[2]]) if c[2] < len(index.items[c[1]]) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def candidates(index: Index, texts: list[list[str]], threshold: float) -> list[tuple[int, int]]:
    """(document, passage) of the batch whose block maxima reach the threshold in some block.

    Segment sums are added for neighbouring segments: an upper bound of the
    passage's sum, in which a term may count twice.
    """
    lengths = np.array([len(t) for t in texts])
    get = index.vocabulary.get
    ids = np.fromiter((x for t in texts for x in map(get, t, repeat(-1))), np.int64, int(lengths.sum()))
    count = np.maximum(1, -(-lengths // index.segment))
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), lengths)
    offset = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    segment = first[owner] + offset // index.segment
    known = ids >= 0
    pairs = np.unique(segment[known] * len(index.vocabulary) + ids[known])
    seg, term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    sums = _block_sums(index, seg, term, int(count.sum()) + 1)
    last = first + count - 1
    follow = sums[1:].copy()
    follow[last] = 0
    low = threshold - 1e-4
    hit = np.flatnonzero((sums[:-1] + follow).max(axis=1) >= low)
    doc = np.searchsorted(first, hit, side="right") - 1
    lonely = count[doc] == 1
    use = lonely | (hit < last[doc])
    hit, doc, lonely = hit[use], doc[use], lonely[use]
    # Again for what is left, now with each term of the two segments once.
    lo = np.searchsorted(seg, hit)
    hi = np.searchsorted(seg, np.where(lonely, hit + 1, hit + 2))
    rows = np.repeat(np.arange(len(hit)), hi - lo)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    pairs = np.unique(rows * len(index.vocabulary) + term[at])
    sums = _block_sums(index, pairs // len(index.vocabulary), pairs % len(index.vocabulary), len(hit))
    good = np.flatnonzero(sums.max(axis=1) >= low) if len(hit) else ()
    return [(int(doc[i]), int(hit[i] - first[doc[i]])) for i in good]


def _block_sums(index: Index, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Block maxima of the terms, summed for each owner (ascending)."""
    sums = np.zeros((n, index.block_most.shape[1]), np.float32)
    step = 1 << 14
    for a in range(0, len(owner), step):
        o = owner[a:a + step]
        starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        sums[o[starts]] += np.add.reduceat(index.block_most[term[a:a + step]], starts, axis=0)
    return sums


def leaks(index: Index, words: list[str], passage: int, threshold: float, least: float) -> list[tuple[int, float, float, float | None]]:
    """(item number, score, question or whole overlap, answer overlap) of the items that a passage leaks."""
    own = words[passage * index.segment:(passage + 2) * index.segment]
    terms = sorted({index.vocabulary[w] for w in own if w in index.vocabulary})
    out = []
    for item, score in wand(index, terms, threshold):
        q, a = overlap(index.questions[item], own), overlap(index.answers[item], own)
        if q >= least and a >= least:
            out.append((item, score, q, a if index.answers[item] else None))
    return out


def _shards(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[Index]:
    rows = pick(benchmark, item_id=id_col, text=text_col, **({"answer": answer_col} if answer_col else {}))
    if not answer_col:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    rows = rows.filter(F.col("text").isNotNull())
    size = F.length("text") + F.coalesce(F.length("answer"), F.lit(0))
    chars = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(chars / SHARD_CHARS * 1.25))
    if n == 1:
        yield build([tuple(r) for r in rows.collect()])
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [tokens(t) + tokens(a) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in own], pa.int64()), pa.array([sorted(set(t)) for t in own], pa.list_(pa.string()))],
                                             names=["shard", "n", "t"])

    # The terms that the shards' own indexes count, so a shard scores as the whole benchmark would.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    every = stored(rows.select("shard", "text", "answer").mapInArrow(terms, "shard int, n bigint, t array<string>").filter("n > 0"), "benchmark-terms")
    total, mean, longest = every.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    df = stored(every.select(F.explode("t").alias("t")).groupBy("t").count(), "benchmark-df")
    for k in range(n):
        got = [(r["item_id"], r["text"], r["answer"]) for r in rows.filter(F.col("shard") == k).collect()]
        own = every.filter(F.col("shard") == k).select(F.explode("t").alias("t")).distinct()
        stats = {r["t"]: r["count"] for r in df.join(own, "t").collect()}
        yield build(got, stats, total, mean, longest or 0)


def _grouped(rows: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(position of the first, words of consecutive texts) with about BATCH_WORDS words each."""
    at = 0
    while at < len(rows):
        start, texts, size = at, [], 0
        while at < len(rows) and size < BATCH_WORDS:
            texts.append(tokens(rows[at]))
            size += len(texts[-1])
            at += 1
        yield start, texts


def _ask(docs: DataFrame, index: Index, threshold: float, least: float) -> DataFrame:
    shared = shipped(docs.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = received(shared)
        for batch in slices(batches):
            for start, texts in _grouped(batch.column(2).to_pylist()):
                if not any(texts) or not ix.ids:
                    continue
                best: dict[tuple[int, int], tuple] = {}
                for d, p in candidates(ix, texts, threshold):
                    for item, score, q, a in leaks(ix, texts[d], p, threshold, least):
                        if (d, item) not in best or score > best[d, item][1]:
                            best[d, item] = (p * ix.segment, score, q, a)
                if best:
                    where = pa.array([start + d for d, _ in best], pa.int64())
                    cols = list(zip(*best.values()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(where), batch.column(1).take(where), pa.array([ix.ids[i] for _, i in best], pa.int64()),
                         pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]],
                        names=["doc_id", "tk", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tk bigint, item_id bigint, first_word bigint, score double, "
                                "question_overlap double, answer_overlap double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = MIN_OVERLAP,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               answer_col: str | None = None) -> DataFrame:
    """One row for each document and test item that it leaks, with the passage and its figures."""
    rows = pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").isNotNull())
    rows = rows.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    out = None
    for index in _shards(benchmark, item_col, item_text_col, answer_col):
        found = _ask(rows, index, threshold, least)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = MIN_OVERLAP,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  answer_col: str | None = None) -> DataFrame:
    """The documents, all columns as they are, that leak no test item (of any shard)."""
    at_text = docs.columns.index(text_col)
    for index in _shards(benchmark, item_col, item_text_col, answer_col):
        shared = shipped(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = received(shared)
            for batch in slices(batches):
                rows = batch.column(at_text).to_pylist()
                for start, texts in _grouped(rows):
                    keep = np.ones(len(texts), bool)
                    for d, p in candidates(ix, texts, threshold) if ix.ids and any(texts) else ():
                        if keep[d] and leaks(ix, texts[d], p, threshold, least):
                            keep[d] = False
                    yield batch.slice(start, len(texts)).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
