"""Which filter takes what away, for every order of the filters: decision diagrams.

Every document gets a mask of the filters it fails. Per part of the corpus the
documents are counted by mask (in all, good and toxic ones), and these counts
are the leaves of a decision diagram: a level for each filter, an edge for
passing and one for failing it, equal subdiagrams held once, and at each node
the sums below it. Following the passing edges from the root gives what every
step of one order keeps; what hangs on a failing edge there is removed by it.
Orders are reached from each other by swapping two adjacent levels: of the
nodes only those of the two levels are made anew, and by the plain-changes
sequence all orders follow with one swap each.

The counting is Spark's: texts are read once and leave a digest, an id, a part
and a mask. Copies never meet in one task: each text's smallest id is a partial
aggregate, and a row finds out whether it holds it by a join on text and id,
after rows equal in both are counted. A diagram has at most two to the number
of filters leaves, whatever the corpus.

Defined cases: null text is the empty text (it fails the length filter only, or
the copy filter if another empty text has a smaller id); a null source is the
part ''; a row without an id is a copy of nothing, nothing is a copy of it, and no label is its own;
rows repeated with one id count each and are no copies of each other; a
document with several label rows is good (toxic) if one of them says so; texts
of any length are taken whole; an empty table gives an empty result; other
columns of the tables are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import UPPER, pick, slices, stored

MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_UPPER_PCT = 5
SYMBOLS = b"#$%&*|"
#: Filters by letter, in the order of the mask's bits. The last is decided by the table, the others by the text.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")

Count = tuple[int, ...]


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()                       # bytes part at \x20 and \x09-\x0D only
    mask = int(len(words) < MIN_WORDS)
    mask |= 2 * (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words))
    upper = len(data) - len(data.translate(None, UPPER.encode()))
    mask |= 4 * (100 * upper > MAX_UPPER_PCT * len(text or ""))
    return mask | 8 * (len(data.translate(None, SYMBOLS)) < len(data))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): rows of equal id, text and part counted once, with the bits of all filters they fail."""
    rows = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    rows = rows.select("doc_id", "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = batch.column(1).to_pylist()
            digest = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            mask = [text_mask(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())],
                                             names=["doc_id", "part", "digest", "mask"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int")
    found = stored(found.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-masks")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return found.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): at most one row for each part and mask."""
    marks = pick(labels, doc_id=id_col, good=good_col, toxic=toxic_col).groupBy("doc_id").agg(
        F.max((F.col("good") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = masks.join(marks, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[
        F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])


class Diagram:
    """A count-weighted decision diagram over the failure masks of ``size`` filters.

    A node is an index; ``low`` (passed) and ``high`` (failed) name its
    children, ``sums`` what lies below it. Nodes with equal children are one
    node. ``order[level]`` is the filter that a level asks.
    """

    def __init__(self, size: int, counts: dict[int, Count], width: int):
        self.order = list(range(size))
        self.low: list[int] = []
        self.high: list[int] = []
        self.sums: list[Count] = []
        self._nodes: dict[tuple[int, int], int] = {}
        self._leaves: dict[Count, int] = {}
        none = (0,) * width

        def build(level: int, mask: int) -> int:
            if level == size:
                return self._leaf(counts.get(mask, none))
            return self._node(build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, low: int, high: int, sums: Count) -> int:
        self.low.append(low)
        self.high.append(high)
        self.sums.append(sums)
        return len(self.sums) - 1

    def _leaf(self, count: Count) -> int:
        if count not in self._leaves:
            self._leaves[count] = self._new(-1, -1, count)
        return self._leaves[count]

    def _node(self, low: int, high: int) -> int:
        if (low, high) not in self._nodes:
            self._nodes[low, high] = self._new(low, high, tuple(a + b for a, b in zip(self.sums[low], self.sums[high])))
        return self._nodes[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes below stay as they are, nodes above get new children."""
        made: dict[tuple[int, int], int] = {}

        def again(node: int, depth: int) -> int:
            if (node, depth) not in made:
                low, high = self.low[node], self.high[node]
                if depth < level:
                    new = self._node(again(low, depth + 1), again(high, depth + 1))
                else:
                    new = self._node(self._node(self.low[low], self.low[high]), self._node(self.high[low], self.high[high]))
                made[node, depth] = new
            return made[node, depth]

        self.root = again(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Count, Count]]:
        """(filter, kept, removed) along the path of all passed filters."""
        node = self.root
        for name in self.order:
            yield name, self.sums[self.low[node]], self.sums[self.high[node]]
            node = self.low[node]


def plain_changes(size: int) -> Iterator[int]:
    """Levels to swap with their next one after the other, so that all orders of ``size`` filters come once."""
    if size < 2:
        return
    inner = plain_changes(size - 1)
    down = True
    while True:
        yield from range(size - 2, -1, -1) if down else range(size - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def orders(counts: dict[int, Count], names: str) -> list[tuple[str, int, str, int, int, int, int, int, int, int]]:
    """(order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of one part."""
    diagram = Diagram(len(names), counts, 3)
    failing = [sum(c[0] for mask, c in counts.items() if mask >> f & 1) for f in range(len(names))]
    alone = [counts.get(1 << f, (0, 0, 0))[0] for f in range(len(names))]
    shapley = [0] * len(names)
    found = []

    def walk() -> None:
        order = "".join(names[f] for f in diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[f] += removed[0]
            found.append((order, step, f, kept[0], removed[0], failing[f] - removed[0], alone[f], removed[1], removed[2]))

    walk()
    for level in plain_changes(len(names)):
        diagram.swap(level)
        walk()
    return [(order, step, names[f], *rest, shapley[f]) for order, step, f, *rest in found]


COLUMNS = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts by part and mask.

    All orders are reported, so ``names`` should be few (5 give 120 orders).
    """
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))   # at most 2 ** len(names) each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = orders({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in own}, names)
                columns = [list(c) for c in zip(*rows)]
                kinds = [pa.string(), pa.int32(), pa.string()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string())] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=list(COLUMNS))

    return cells.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} bigint" for c in COLUMNS[4:]))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five text filters over the documents, every order of them, for every part."""
    return audit(mask_counts(masked(docs, id_col, text_col, part_col), labels))


#: DuckDB SQL of the same counts, each order worked out from the masks.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, part, text,
    (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d
  FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d)),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
x AS (
  SELECT m.doc_id, part, a + 2 * b + 4 * c + 8 * d + 16 * coalesce(m.doc_id > f.first, false)::INT AS mask
  FROM m JOIN f ON f.text = m.text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM x LEFT JOIN l ON l.doc_id = x.doc_id GROUP BY part, mask),
o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || k FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(k)
  WHERE length(filter_order) < 5 AND NOT contains(filter_order, k)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS k,
    1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS ahead
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
r AS (
  SELECT part, filter_order, step, k,
    sum(CASE WHEN (mask & (coalesce(ahead, 0) | bit)::INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & coalesce(ahead, 0)::INT) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & coalesce(ahead, 0)::INT) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & coalesce(ahead, 0)::INT) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & coalesce(ahead, 0)::INT) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, k AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""
