"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

A word, in lower case and between blanks, has character n-grams of ``SIZES``;
a document has those of its words, each with the logarithm of one plus its
count. Each n-gram is scaled by its naive Bayes log-count ratio (how much more
of it there is in documents of label 1 than of label 0), and a logistic
regression is fitted on the scaled values.

The fit uses a sample of labelled documents (``FIT_ROWS`` rows with the smallest
hash of their id). Tasks count the words of their whole texts, as n-grams follow
from these; the driver sees each document's distinct words with their counts.
N-grams in fewer than ``MIN_DOCS`` documents of the sample, or with a ratio
below ``MIN_RATIO``, have no feature. Scoring reads every whole text.

Defined cases: null and empty texts have no n-grams and get the score of the
intercept; labels other than 0 and 1 are not learned from; if a class has no
labelled row, every score is the share of label 1 among the labelled rows (0
without any); rows repeated with equal id get equal results; other columns are
left behind.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, received, shipped, slices, worker_state

WORD = re.compile(r"[^\W_]+")
SIZES = (3, 4, 5, 6)
FIT_ROWS = 3000
MIN_DOCS = 4
MIN_RATIO = 0.7
SMOOTH = 1.0
RIDGE = 0.02
STEPS = 150
CACHE_WORDS = 300_000
LONGEST_CACHED = 40


def ngrams(word: str) -> set[str]:
    """Character n-grams of a word with a blank on either side."""
    s = f" {word} "
    return {s[i:i + n] for n in SIZES for i in range(len(s) - n + 1)} or {s}


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, counts: Counter) -> float:
        z = self.intercept + sum(self.weights[g] * math.log1p(n) for g, n in sorted(counts.items()) if g in self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def document_ngrams(text: str | dict[str, int] | None, known: dict[str, int] | None = None) -> Counter:
    """N-grams of a text, or of its word counts, with the number of words that have them (only those known, if given)."""
    out: Counter = Counter()
    for w, n in (text if isinstance(text, dict) else word_counts(text)).items():
        for g in ngrams(w):
            if known is None or g in known:
                out[g] += n
    return out


def fit(rows: list[tuple[str | dict[str, int], int]]) -> Model:
    """Fit on (text or its word counts, label) rows."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    heft = ({}, {})
    held: Counter = Counter()
    for text, label in rows:
        own, of = heft[label], document_ngrams(text)
        held.update(of.keys())
        for g, n in of.items():
            own[g] = own.get(g, 0.0) + math.log1p(n)
    total = [sum(h.values()) + SMOOTH * len(held) for h in heft]
    ratio = {}
    for g in sorted(g for g, n in held.items() if n >= MIN_DOCS):
        r = math.log((heft[1].get(g, 0.0) + SMOOTH) / total[1]) - math.log((heft[0].get(g, 0.0) + SMOOTH) / total[0])
        if abs(r) >= MIN_RATIO:
            ratio[g] = r
    del heft, held
    number = {g: i for i, g in enumerate(ratio)}
    r = np.array(list(ratio.values()))
    row, col, x = [], [], []
    for k, (text, _) in enumerate(rows):
        of = sorted((number[g], n) for g, n in document_ngrams(text, number).items())
        row.append(np.full(len(of), k))
        col.append(np.array([g for g, _ in of], np.int64))
        x.append(np.log1p([n for _, n in of]) * r[col[-1]])
    row, col, x = np.concatenate(row), np.concatenate(col), np.concatenate(x)
    # Logistic regression by accelerated gradient steps on the scaled features.
    n, k = len(rows), len(r)
    w, v, b, vb = np.zeros(k), np.zeros(k), float(np.log(y.mean() / (1 - y.mean()))), 0.0
    step = 1.0 / max(1.0, 0.25 * np.bincount(row, x * x, n).max())
    for _ in range(STEPS):
        ahead = w + 0.9 * v
        z = np.bincount(row, x * ahead[col], n) + b
        g = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(col, x * g[row], k) / n + RIDGE / n * ahead
        v = 0.9 * v - step * n / 8 * grad
        w = w + v
        vb = 0.5 * vb - 0.5 * g.mean()
        b += vb
    final = w * r
    return Model({g: float(final[i]) for g, i in number.items() if abs(final[i]) > 1e-6}, float(b))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, words, n): the distinct words of whole texts, in order, with their counts."""
    for batch in slices(batches, 64):
        counts = [sorted(word_counts(text).items()) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([[w for w, _ in c] for c in counts], pa.list_(pa.string())),
             pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int64()))], names=["doc_id", "label", "words", "n"])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on labelled documents where ``learn`` holds (a predicate over doc_id)."""
    named = pick(labels, doc_id=label_id_col, label=label_col).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        named = named.filter(learn)
    chosen = named.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(FIT_ROWS)
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(_counted, f"doc_id {kind}, label int, words array<string>, n array<bigint>").collect()
    return fit([(dict(zip(r["words"], r["n"])), r["label"]) for r in sorted(got)])


class Scorer:
    """Scores texts, keeping the known n-grams of recent words."""

    def __init__(self, model: Model):
        self.number = {g: i for i, g in enumerate(model.weights)}
        self.weights = np.array([*model.weights.values(), 0.0])
        self.intercept = model.intercept
        self.words: dict[str, tuple[int, ...]] = {}

    def known(self, word: str) -> tuple[int, ...]:
        number, s = self.number, f" {word} "
        found = tuple({number[g] for n in SIZES for i in range(len(s) - n + 1) if (g := s[i:i + n]) in number})
        if len(word) <= LONGEST_CACHED:
            if len(self.words) >= CACHE_WORDS:
                self.words = {}
            self.words[word] = found
        return found

    def margin(self, text: str | None) -> float:
        if not text:
            return self.intercept
        found: list[int] = []
        get = self.words.get
        for w in WORD.findall(text.lower()):
            ids = get(w)
            if ids is None:
                ids = self.known(w)
                get = self.words.get
            if ids:
                found += ids
        at, n = np.unique(np.array(found, np.int64), return_counts=True)
        return self.intercept + float((self.weights[at] * np.log1p(n)).sum())


def _scorer(model: Model) -> Scorer:
    state = worker_state("toxicity")
    if state.get("toxic_of") != model.key:
        state["toxic_of"], state["toxic"] = model.key, Scorer(model)
    return state["toxic"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    shared = shipped(docs.sparkSession, model)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(received(shared))
        for batch in slices(batches):
            z = np.array([scorer.margin(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())],
                                             names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
