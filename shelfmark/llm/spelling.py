"""Spelling variants of a corpus' words by a frequency-vector trie.

A word's frequency vector counts its letters by group. One inserted letter is
a surplus of one in one group, a deleted one a deficit of one, a replaced one
at most both. So the words near a word lie on those paths of a trie over the
successive counts that a depth-first search reaches with a budget of one
surplus and one deficit. Words at a leaf are then verified letter by letter.

The trie is never in one place. The vocabulary is written sorted by (vector,
word) in range partitions: every file is a bounded run of the trie's leaves, a
*piece*. The pieces' first and last vectors (one row for ``PIECE`` words) are
the top of the trie, by which a word is sent to the pieces that its budget can
reach. A piece with many visitors is given to several tasks, each with its own
part of them. Inside a task the search walks the piece depth first, carrying
all visitors that can still reach a node. No bucket is capped, and no pair
leaves a task: only each word's number of near words and its best one do.

Forms lead to words of at least twice the count, so chains of forms are short
(at most log2 of the largest count) and a word has few words that name it as
their form (its near words): the roots come from joins level by level.

Defined cases: null and wordless texts give no words; a null doc_id is the
empty text where an id is asked for; repeated rows count each; texts and words
of any length are taken whole (counts above 255 in a group are held as 255,
which only lets more words through to be verified); ties go to the smallest
word in code point order; an empty table gives an empty result; other columns
of the table are left behind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import LOWER, UPPER, pick, slices, stored

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letter groups: one each for a-z, in about the order of how much they tell apart, and OTHER more by code point.
LETTERS = "eanirtsoldhcumgpbvfkwzyjxq"
OTHER = 6
GROUPS = len(LETTERS) + OTHER
#: Words of one piece of the trie, and visitors of one task that searches it.
PIECE = 16_000
VISITORS = 48_000
#: Distinct words a task counts before it hands them on.
COUNTED = 150_000
#: (visitor, word) combinations at a node from which on it counts as a leaf.
LEAF = 8_000
#: Pairs verified at a time, and the longest words that are compared as arrays.
PAIRS = 200_000
WIDTH = 40


def lower_runs(text: str) -> list[str]:
    """Maximal runs of letters, with only A-Z in lower case."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def word_counts(docs: DataFrame, least_len: int = 5, least_n: int = 3, change: Callable | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts with at least ``least_len`` code points and ``least_n`` occurrences.

    ``change(doc_id as text)`` gives a function from a run to the word that it stands for.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def flush(seen: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in seen.items() if len(w) >= least_len]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, 256):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                own = Counter(lower_runs(text))
                if change is None:
                    seen.update(own)
                else:
                    word_of = change(key)
                    for word, n in own.items():
                        seen[word_of(word)] += n
            if len(seen) >= COUNTED:
                yield flush(seen)
        yield flush(seen)

    counted = rows.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def vectors(words: list[str]) -> np.ndarray:
    """One row of GROUPS counts (at most 255) for each word."""
    group = np.array([len(LETTERS) + c % OTHER for c in range(256)], np.int64)
    for at, letter in enumerate(LETTERS):
        group[ord(letter)] = at
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    place = np.where(codes < 256, group[np.minimum(codes, 255)], len(LETTERS) + codes % OTHER)
    counts = np.bincount(owner * GROUPS + place, minlength=len(words) * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(words), GROUPS)


def vocabulary(counts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n, v, piece): the words in trie order; a piece is one written file of about ``piece`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = vectors(batch.column(0).to_pylist())
            v = pa.array([row.tobytes() for row in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], names=["word", "n", "v"])

    counted = stored(counts, "word-counts")
    pieces = max(1, -(-counted.count() // piece))
    made = counted.mapInArrow(run, "word string, n bigint, v binary").repartitionByRange(pieces, "v", "word").sortWithinPartitions("v", "word")
    return stored(made, "vocabulary").withColumn("piece", F.col("_metadata.file_name"))


class Top:
    """Where the pieces of the trie begin and end."""

    def __init__(self, spans: list[tuple[str, bytes, bytes]]):
        spans = sorted(spans, key=lambda s: (s[1], s[2]))
        self.names = [s[0] for s in spans]
        self.first = [s[1] for s in spans]
        self.last = [s[2] for s in spans]

    def pieces(self, prefix: bytes) -> tuple[int, int]:
        """The pieces (from, to) that may hold vectors with this prefix; from > to if there are none."""
        rest = GROUPS - len(prefix)
        return bisect_left(self.last, prefix + b"\0" * rest), bisect_right(self.first, prefix + b"\xff" * rest) - 1

    def routes(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, piece) for every piece that a probe can reach with its budget of one surplus and one deficit."""
        n, found = len(self.names), []
        stack = [(b"", 0, n - 1, np.arange(len(probes)), np.zeros(len(probes), np.uint8))] if n and len(probes) else []
        while stack:
            prefix, a, b, at, spent = stack.pop()
            level = len(prefix)
            if a == b or level == GROUPS:
                found += [at * n + p for p in range(a, b + 1)]
                continue
            own = probes[at, level].astype(np.int16)
            for value in np.unique(np.concatenate([own - 1, own, own + 1])):
                if 0 <= value <= 255:
                    lo, hi = self.pieces(prefix + bytes([value]))
                    if lo <= hi:
                        keep, now = _step(own, int(value), spent)
                        if len(keep):
                            stack.append((prefix + bytes([value]), lo, hi, at[keep], now))
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // max(n, 1), both % max(n, 1)


def _step(own: np.ndarray, value: int, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which visitors can go on to a child with this count, and what they have spent then (1: surplus, 2: deficit)."""
    d = value - own
    cost = np.where(d == 1, np.uint8(1), np.where(d == -1, np.uint8(2), np.uint8(0)))
    keep = np.flatnonzero((np.abs(d) <= 1) & (spent & cost == 0))
    return keep, spent[keep] | cost[keep]


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


class Letters:
    """Words as rows of code points, from the left and from the right, for verifying many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int32)
        short = [w if len(w) <= WIDTH else "" for w in words]
        self.left = self._rows([w.ljust(WIDTH, "\0") for w in short])
        self.right = self._rows([w.rjust(WIDTH, "\0") for w in short])

    @staticmethod
    def _rows(padded: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes.astype(np.uint16).reshape(-1, WIDTH)   # the words' letters all lie below U+0100

    def near(self, other: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs (own i, other's j): whether exactly one edit lies between them."""
        a, b = self.size[i], other.size[j]
        out = np.abs(a - b) <= 1
        long = np.maximum(a, b) > WIDTH
        for k in np.flatnonzero(out & long):
            out[k] = one_edit(self.words[i[k]], other.words[j[k]])
        k = np.flatnonzero(out & ~long)
        i, j, least, same = i[k], j[k], np.minimum(a[k], b[k]), a[k] == b[k]
        head = _run(self.left[i] == other.left[j])
        tail = _run((self.right[i] == other.right[j])[:, ::-1])
        # Equal padding after the shorter word's end must not count.
        head, tail = np.minimum(head, least), np.minimum(tail, least)
        out[k] = np.where(same, (head < least) & (head + tail >= least - 1), head + tail >= least)
        return out


def _run(equal: np.ndarray) -> np.ndarray:
    """Number of leading true values of each row."""
    return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def search(words: list[str], n: np.ndarray, trie: np.ndarray, visitors: list[str], probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each visitor its number of near words in a piece, and the place of the best one (-1: none).

    ``trie`` holds the vectors of ``words`` in sorted order, so a node is a run of its rows.
    """
    place = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), np.int64)
    rank = np.argsort(place)
    count, best = np.zeros(len(visitors), np.int64), np.full(len(visitors), len(words), np.int64)
    own, there = Letters(visitors), Letters(words)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def verify() -> None:
        if waiting:
            i, j = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            for at in range(0, len(i), PAIRS):
                x, y = i[at:at + PAIRS], j[at:at + PAIRS]
                good = own.near(there, x, y)
                np.add.at(count, x[good], 1)
                np.minimum.at(best, x[good], rank[y[good]])

    held = 0
    stack = [(0, 0, len(words), np.arange(len(visitors)), np.zeros(len(visitors), np.uint8))] if len(words) and visitors else []
    while stack:
        level, lo, hi, at, spent = stack.pop()
        if level == GROUPS or len(at) * (hi - lo) <= LEAF or hi - lo == 1:
            for x, y in _leaf(trie[lo:hi, level:], probes, at, spent, level):
                waiting.append((x, y + lo))
                held += len(x)
            if held >= PAIRS:
                verify()
                held = 0
            continue
        counts = trie[lo:hi, level]
        cuts = np.concatenate([[0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [hi - lo]])
        visiting = probes[at, level].astype(np.int16)
        for a, b in zip(cuts[:-1], cuts[1:]):
            keep, now = _step(visiting, int(counts[a]), spent)
            if len(keep):
                stack.append((level + 1, lo + int(a), lo + int(b), at[keep], now))
    verify()
    return count, np.append(place, -1)[best]


def _leaf(rows: np.ndarray, probes: np.ndarray, at: np.ndarray, spent: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, row) pairs at a leaf whose remaining counts are within what is left of the budget."""
    step = max(1, LEAF // len(rows))
    rows = rows.astype(np.int16)
    for k in range(0, len(at), step):
        who, used = at[k:k + step], spent[k:k + step]
        d = rows[None, :, :] - probes[who, level:].astype(np.int16)[:, None, :]
        over = np.maximum(d, 0).sum(axis=2)
        under = over - d.sum(axis=2)
        x, y = np.nonzero((over + (used & 1)[:, None] <= 1) & (under + (used >> 1)[:, None] <= 1))
        yield who[x], y


def near_words(vocab: DataFrame, visitors: int = VISITORS) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the most frequent of them."""
    spark = vocab.sparkSession
    # One row for each piece: the top of the trie.
    top = Top([(r["piece"], bytes(r["a"]), bytes(r["b"])) for r in vocab.groupBy("piece").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()])
    if not top.names:
        return spark.createDataFrame([], "word string, n_near bigint, best struct<n:bigint,word:string>")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            probes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, GROUPS)
            who, piece = top.routes(probes)
            for k in range(0, len(who), 50_000):
                part = pa.array(who[k:k + 50_000])
                names = pa.array([top.names[p] for p in piece[k:k + 50_000]], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(part) for c in batch.columns), names], names=["word", "n", "v", "piece"])

    sent = stored(vocab.select("word", "n", "v").mapInArrow(route, "word string, n bigint, v binary, piece string"), "routes")
    # One row for each piece again: its number of tasks.
    tasks = spark.createDataFrame([(r["piece"], -(-r["count"] // visitors)) for r in sent.groupBy("piece").count().collect()], "piece string, tasks bigint")
    asks = sent.join(tasks, "piece").select("piece", F.pmod(F.xxhash64("word"), "tasks").alias("task"), F.lit(False).alias("own"), "word", "n", "v")
    holds = vocab.join(tasks, "piece").select("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"),
                                              F.lit(True).alias("own"), "word", "n", "v")

    def find(table: pa.Table) -> pa.Table:
        own = table.filter(table["own"]).sort_by([("v", "ascending"), ("word", "ascending")])
        asking = table.filter(pa.compute.invert(table["own"]))
        sets = [np.frombuffer(b"".join(t["v"].to_pylist()), np.uint8).reshape(-1, GROUPS) for t in (own, asking)]
        words, visiting, n = own["word"].to_pylist(), asking["word"].to_pylist(), own["n"].to_numpy()
        count, best = search(words, n, sets[0], visiting, sets[1])
        hit = np.flatnonzero(count)
        top_n = n[best[hit]] if len(hit) else np.empty(0, np.int64)
        return pa.table({"word": pa.array([visiting[k] for k in hit], pa.string()), "n_near": pa.array(count[hit]),
                         "best_n": pa.array(top_n, pa.int64()), "best_word": pa.array([words[best[k]] for k in hit], pa.string())})

    found = asks.unionByName(holds).groupBy("piece", "task").applyInArrow(find, "word string, n_near bigint, best_n bigint, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best_word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form: the last word that its forms lead to.

    ``forms`` (word, form): no chain of forms may return to where it began.
    """
    links = forms.select("word", "form")
    # The first frontier: words that are forms but have none.
    names = links.select(F.col("form").alias("word")).distinct()
    frontier = names.join(links, "word", "left_anti").select("word", F.col("word").alias("root"))
    out = None
    while True:
        level = stored(links.join(frontier.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        if level.isEmpty():
            return out if out is not None else level
        out = level if out is None else out.unionByName(level)
        frontier = level


def groups(docs: DataFrame, least_len: int = 5, least_n: int = 3, ratio: int = 2, change: Callable | None = None,
           piece: int = PIECE, visitors: int = VISITORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word that occurs often enough.

    A word's form is the most frequent near word if that occurs ``ratio``
    (above 1) times as often as the word, or more; its root is where forms lead.
    """
    vocab = vocabulary(word_counts(docs, least_len, least_n, change, id_col, text_col), piece)
    near = stored(near_words(vocab, visitors), "near-words")
    named = vocab.select("word", "n").join(near, "word", "left")
    found = F.col("best.n") >= F.col("n") * ratio
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                F.when(found, F.col("best.word")).alias("form"), F.when(found, F.col("best.n")).alias("form_n")), "forms")
    out = named.join(roots(named.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """DuckDB SQL of the contract's columns: checksums byte by byte, near words by equal deletions and equal gaps."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(str(byte))
    return f"""
WITH RECURSIVE t AS (SELECT [{", ".join(table)}] AS crc),
d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+') AS runs FROM documents),
r AS (SELECT rid, id, run, count(*) AS k FROM (SELECT rid, id, unnest(runs) AS run FROM d) GROUP BY ALL),
h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda acc, b: xor(acc >> 8, t.crc[(xor(acc, b) & 255) + 1]::BIGINT)))::BIGINT AS h FROM r, t),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
c AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
p AS (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS z FROM c),
near AS (
  SELECT x.word, y.word AS other, y.n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = a || z
  UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = a || z),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, other := other)) AS best FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * v.n THEN best.other END AS form,
    CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
o AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN o e ON e.word = f.word JOIN f last ON last.word = e.at AND last.form IS NULL
"""
