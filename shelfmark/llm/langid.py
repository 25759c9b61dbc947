"""Language identification of code-switched text by a linear-chain CRF.

Every word of a text is a position of one chain. A word's features are its
affixes, its character trigrams and its membership of each language's lexicon;
the labels of neighbouring words are tied by learned transitions. Forward-
backward gives each word a posterior over the languages, and the mean of these
is the document's distribution.

The model is fitted on a bounded sample of labelled rows (``DOCS_PER_LANG``
documents of each language, each with its whole text; rows with the smallest
hash of their id, so the same table gives the same model).
Training chains splice pieces of documents of several languages, which is what
makes the transitions say how likely a switch is. Scoring reads every word of
every text.

Forward-backward is exact and works on many chains at once: chains are cut
into blocks of ``BLOCK`` positions, the products of a block's transition
matrices are made for all blocks together, block starts and ends get their
messages by a scan over each document's blocks, and the positions inside the
blocks follow, again for all blocks together.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
so is every text if no labelled row exists. Ties between languages go to the
first in alphabetical order. Rows with null language are scored, not learned
from. Repeated rows get equal results; other columns are left behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, received, shipped, slices, worker_state

UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: Bound of the fitting sample: labelled documents of a language, each with its whole text.
DOCS_PER_LANG = 250
LEXICON_PER_LANG = 2000

SPACE = 1 << 16
BLOCK = 32
CACHE_WORDS = 150_000
BATCH_WORDS = 60_000
CHAINS = 2400
EPOCHS = 4


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray       # (SPACE, K) emission weights of hashed features
    transitions: np.ndarray   # (K, K) log potentials
    lexicon: dict[str, tuple[int, ...]]   # word -> languages whose lexicon has it
    key: str = field(default_factory=lambda: uuid.uuid4().hex)   # tells workers one model from the next


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed feature ids of a lower-case word."""
    out = [zlib.crc32(b"L%d" % k) % SPACE for k in lexicon.get(word, ())]
    for n in (1, 2, 3, 4):
        if len(word) >= n:
            out.append(zlib.crc32(b"p" + word[:n].encode()) % SPACE)
            out.append(zlib.crc32(b"s" + word[-n:].encode()) % SPACE)
    out += [zlib.crc32(b"g" + word[i:i + 3].encode()) % SPACE for i in range(len(word) - 2)]
    return out


def emissions(model: Model, vocabulary: list[str]) -> np.ndarray:
    """(len(vocabulary), K) summed weights of each word's features."""
    lists = [features(w, model.lexicon) for w in vocabulary]
    lengths = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.zeros((len(lists), model.weights.shape[1]))
    step = 4096
    for a in range(0, len(lists), step):
        b = min(a + step, len(lists))
        lo, hi = starts[a], starts[b - 1] + lengths[b - 1]
        out[a:b] = np.add.reduceat(model.weights[flat[lo:hi]], starts[a:b] - lo, axis=0)
    return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over concatenated chains: (n, K) marginals.

    ``scores`` are log emissions of all positions, ``lengths`` (each >= 1) the
    chains' lengths. A chain starts from a uniform message.
    """
    n, k = scores.shape
    trans = np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    nb = int(blocks.sum())
    offset = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    slot = np.repeat(first, lengths) * BLOCK + offset
    e = np.ones((nb * BLOCK, k))
    e[slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = e.reshape(nb, BLOCK, k) + 1e-30
    real = np.zeros(nb * BLOCK, bool)
    real[slot] = True
    real = real.reshape(nb, BLOCK)

    def normal(x: np.ndarray, axes) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    many = np.flatnonzero(blocks > 1)
    start = np.full((nb, k), 1.0 / k)     # message into a block
    end = np.ones((nb, k))                # message into its end from the right
    if len(many):
        # Matrix of each block: what it does to a message that enters it.
        product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
        for t in range(BLOCK):
            new = (product.reshape(-1, k) @ trans).reshape(nb, k, k) * e[:, t, None, :]
            product = np.where(real[:, t, None, None], normal(new, (1, 2)), product)
        many = many[np.argsort(-blocks[many], kind="stable")]
        count, base = blocks[many], first[many]
        for r in range(1, int(count[0])):
            at = base[:np.searchsorted(-count, -r, side="left")] + r
            start[at] = normal(np.einsum("ni,nij->nj", start[at - 1], product[at - 1]), 1)
        for r in range(int(count[0]) - 2, -1, -1):
            at = base[:np.searchsorted(-count, -(r + 1), side="left")] + r
            end[at] = normal(np.einsum("nij,nj->ni", product[at + 1], end[at + 1]), 1)
    alpha = np.empty_like(e)
    a = start
    for t in range(BLOCK):
        a = np.where(real[:, t, None], normal((a @ trans) * e[:, t], 1), a)
        alpha[:, t] = a
    b = end
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= b
        b = np.where(real[:, t, None], normal((b * e[:, t]) @ trans.T, 1), b)
    out = alpha.reshape(-1, k)[slot]
    return normal(out, 1)


def fit(rows: list[tuple[str, list[str]]], seed: int = 11) -> Model:
    """Fit on (language, words) rows by Adagrad on the chains' log-likelihood."""
    langs = sorted({lang for lang, words in rows if words})
    k = len(langs)
    rng = np.random.default_rng(seed)
    by_lang: list[list[list[str]]] = [[w for lang, w in rows if lang == x and w] for x in langs]
    lexicon: dict[str, list[int]] = {}
    for y, texts in enumerate(by_lang):
        common = Counter(w for words in texts for w in words)
        for w, c in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_PER_LANG]:
            if c >= 3:
                lexicon.setdefault(w, []).append(y)
    model = Model(langs, np.zeros((SPACE, max(k, 1))), np.zeros((max(k, 1), max(k, 1))), {w: tuple(v) for w, v in lexicon.items()})
    if k < 2:
        return model
    chains = []
    for _ in range(CHAINS):
        words: list[str] = []
        gold: list[int] = []
        for _ in range(rng.integers(1, 5)):
            y = int(rng.integers(k))
            text = by_lang[y][int(rng.integers(len(by_lang[y])))]
            at = int(rng.integers(len(text)))
            piece = text[at:at + int(rng.integers(4, 40))]
            words += piece
            gold += [y] * len(piece)
        chains.append((words, gold))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in chains for w in words))}
    lists = [features(w, model.lexicon) for w in vocabulary]
    grown, seen_t = np.full_like(model.weights, 1e-3), np.full((k, k), 1e-3)
    eye = np.eye(k)
    size = 60
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chains))
        for a in range(0, len(chains), size):
            part = [chains[i] for i in order[a:a + size]]
            ids = np.array([vocabulary[w] for words, _ in part for w in words])
            gold = np.array([y for _, ys in part for y in ys])
            lengths = np.array([len(w) for w, _ in part])
            own, inverse = np.unique(ids, return_inverse=True)
            ls = [lists[i] for i in own]
            flat = np.concatenate([np.asarray(x, np.int64) for x in ls])
            owner = np.repeat(np.arange(len(own)), [len(x) for x in ls])
            em = np.zeros((len(own), k))
            np.add.at(em, owner, model.weights[flat])
            scores = em[inverse]
            p = posteriors(scores, lengths, model.transitions)
            grad = np.zeros((len(own), k))
            np.add.at(grad, inverse, eye[gold] - p)
            gw = np.zeros_like(model.weights)
            np.add.at(gw, flat, grad[owner])
            touched = np.unique(flat)
            g = gw[touched] - 1e-3 * model.weights[touched]
            grown[touched] += g * g
            model.weights[touched] += 0.25 * g / np.sqrt(grown[touched])
            # Expected and observed transitions between neighbours of one chain.
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(lengths) - 1] = False
            left = np.flatnonzero(inner)
            observed = np.zeros((k, k))
            np.add.at(observed, (gold[left], gold[left + 1]), 1)
            gt = observed - pair_expectation(scores, lengths, model.transitions, left)
            seen_t += gt * gt
            model.transitions += 0.25 * gt / np.sqrt(seen_t)
    return model


def pair_expectation(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Expected counts of label pairs at (left, left + 1).

    The forward message of a position is its marginal in the chain cut after
    it; both messages come from plain recursions over the few fitting chains.
    """
    k = scores.shape[1]
    trans = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts, size = (ends - lengths)[order], lengths[order]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = np.full((len(size), k), 1.0 / k)
    for t in range(int(size[0])):
        live = np.searchsorted(-size, -t, side="left")
        at = starts[:live] + t
        a = (a[:live] @ trans) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    for t in range(int(size[0]) - 2, -1, -1):
        at = starts[:np.searchsorted(-size, -(t + 1), side="left")] + t
        b = (beta[at + 1] * e[at + 1]) @ trans.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    right = left + 1
    joint = alpha[left][:, :, None] * trans[None] * (e[right] * beta[right])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return joint.sum(axis=0)


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """The bounded fitting sample as (language, words) rows on the driver."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).filter(learn)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (rows.select("lang", "doc_id").withColumn("r", F.row_number().over(order))
              .filter(F.col("r") <= DOCS_PER_LANG).select("doc_id", "lang").distinct())
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))
    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("w", w).filter(F.size("w") > 0).select("doc_id", "lang", "w")
    return [(r["lang"], list(r["w"])) for r in picked.orderBy("lang", "doc_id", F.xxhash64("w")).collect()]


def train(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Fit on rows where ``learn`` holds (a predicate over doc_id)."""
    return fit(sample(docs, F.lit(True) if learn is None else learn, id_col, text_col, lang_col))


class Scorer:
    """Words to posteriors, with emissions of recent words kept."""

    def __init__(self, model: Model):
        self.model = model
        self.row: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)))

    def rows_of(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.row) > CACHE_WORDS:
            self.row, self.table = {}, self.table[:0]
        known = self.row
        new = dict.fromkeys(w for t in texts for w in t if w not in known)
        if new:
            self.table = np.concatenate([self.table, emissions(self.model, list(new))])
            for w in new:
                known[w] = len(known)
        return np.fromiter((known[w] for t in texts for w in t), np.int64, sum(map(len, texts)))

    def label(self, texts: list[list[str]]) -> np.ndarray:
        """Posteriors of all words of non-empty texts, concatenated."""
        rows = self.rows_of(texts)
        return posteriors(self.table[rows], np.array([len(t) for t in texts]), self.model.transitions)


def _scorer(shared) -> Scorer:
    state, model = worker_state("langid"), received(shared)
    if state.get("crf_of") != model.key:
        state["crf_of"], state["crf"] = model.key, Scorer(model)
    return state["crf"]


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(position of the first, words of consecutive texts) with about BATCH_WORDS words each."""
    group: list[list[str]] = []
    size = at = 0
    for i, t in enumerate(texts):
        group.append(LETTERS.findall(t.lower()) if t else [])
        size += len(group[-1])
        if size >= BATCH_WORDS:
            yield at, group
            group, size, at = [], 0, i + 1
    if group:
        yield at, group


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches): score is the mean posterior of lang_pred."""
    shared = shipped(docs.sparkSession, model)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = _scorer(shared), received(shared).langs
        for batch in slices(batches):
            for at, group in _grouped(batch.column(1).to_pylist()):
                lang, score, sizes = [UNKNOWN] * len(group), np.zeros(len(group)), [len(g) for g in group]
                switches = np.zeros(len(group), np.int64)
                full = [i for i, g in enumerate(group) if g] if langs else []
                if full:
                    p = scorer.label([group[i] for i in full])
                    length = np.array([sizes[i] for i in full])
                    starts = np.cumsum(length) - length
                    mean = np.add.reduceat(p, starts, axis=0) / length[:, None]
                    best = mean.argmax(axis=1)
                    label = p.argmax(axis=1)
                    turn = np.concatenate([[0], label[1:] != label[:-1]])
                    turn[starts] = 0
                    switches[full] = np.add.reduceat(turn, starts)
                    score[full] = np.clip(mean[np.arange(len(full)), best], 0.0, 1.0)
                    for i, b in zip(full, best):
                        lang[i] = langs[b]
                ids = batch.column(0).slice(at, len(group))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(sizes, pa.int64()), pa.array(switches, pa.int64())],
                                                 names=["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words bigint, n_switches bigint")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, labels): the most likely language of every word, for mixed texts."""
    shared = shipped(docs.sparkSession, model)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = _scorer(shared), received(shared).langs
        for batch in slices(batches):
            for at, group in _grouped(batch.column(1).to_pylist()):
                labels: list[list[str]] = [[UNKNOWN] * len(g) for g in group]
                full = [i for i, g in enumerate(group) if g] if langs else []
                if full:
                    best = scorer.label([group[i] for i in full]).argmax(axis=1)
                    end = 0
                    for i in full:
                        labels[i] = [langs[b] for b in best[end:end + len(group[i])]]
                        end += len(group[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)),
                                                  pa.array(group, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))],
                                                 names=["doc_id", "words", "labels"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, words array<string>, labels array<string>")


def least_score(model: Model, share: float) -> float:
    """The score that lies at ``share`` of the way from what all languages being as likely gives to certainty."""
    even = 1 / max(1, len(model.langs))
    return even + share * (1 - even)


def in_known_language(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, whose language is found with a score of at least ``least``."""
    shared = shipped(docs.sparkSession, model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = _scorer(shared), received(shared).langs
        for batch in slices(batches):
            for at, group in _grouped(batch.column(at_text).to_pylist()):
                keep = np.zeros(len(group), bool)
                full = [i for i, g in enumerate(group) if g] if langs else []
                if full:
                    p = scorer.label([group[i] for i in full])
                    length = np.array([len(group[i]) for i in full])
                    mean = np.add.reduceat(p, np.cumsum(length) - length, axis=0) / length[:, None]
                    keep[full] = mean.max(axis=1) >= least
                yield batch.slice(at, len(group)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
