"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the hashes of all training tokens; level n holds the n-grams as
(context, successor): the context is the number of an (n-1)-gram of level n-1,
the successor the number of a token. A level is cut into shards of bounded size
by hash, so that a frequent context spreads over all shards. A shard is a few
arrays in the shared folder, which scoring tasks map into memory:

* the contexts, a monotone Elias-Fano sequence;
* pointers to where each context's successors begin, another one (to list the
  successors of a context; scoring does without them);
* the successors, made monotone by adding the context's place in the shard
  times the number of tokens. Looking up a successor is a successor search in
  this sequence, relative to the context;
* exact counts, in four bits each with the few larger ones apart, and smoothed log10
  probabilities and back-off weights as 8-bit codes on a uniform scale.

Probabilities use absolute discounting: an n-gram seen at least ``MIN_COUNT``
times keeps its count less the discount, the rest of its context's mass is
given to the shorter context. Unknown tokens share the discount of level 1.

Counting is a Spark job for each level: tasks sort and combine what they read
and send one compressed block of (key, count) for each shard; a shard's blocks
meet in one task, which writes the shard's arrays (under a temporary name, then
moved, so a repeated task does no harm). In the same job it sends each shard of
the shorter contexts what its own n-grams take from their mass, compressed, from
which a task writes that shard's back-off weights. The driver sees one row a shard.

Tasks look up distinct n-grams in sorted order, so that searches in the sequences
go through memory once and in one direction.

Defined cases: null text is empty and is one end token; with no training rows
every token is unknown with probability 1; rows repeated with equal id count
and score each for itself; other columns are left behind. The shared folder
has to be mounted on all nodes (a file: path), as memory maps need files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, received, scratch, shipped, worker_state

ORDER = 2
MIN_COUNT = 2
DISCOUNT = 0.5
#: Training tokens a shard is made for, and tokens gathered before a task combines and
#: sends them: sized for workers of a few hundred MB, to be raised together with memory
#: when a corpus would need more shards than there are tokens in a flush.
SHARD_TOKENS = 4_000_000
FLUSH_TOKENS = 2_000_000
SCORE_TOKENS = 1_000_000
#: Text that is split into words at once.
SPLIT_BYTES = 8_000_000
#: The end of a text is a token of its own; no word can hold a blank.
END = xxhash.xxh64_intdigest(b" end")

U64 = np.uint64


# ---- Elias-Fano sequences -------------------------------------------------

def _select_table() -> np.ndarray:
    """Place of the r-th set bit of every 16-bit word."""
    words = np.arange(1 << 16, dtype=np.uint32)
    table = np.zeros((1 << 16, 16), np.uint8)
    seen = np.zeros(1 << 16, np.int64)
    for bit in range(16):
        has = np.flatnonzero((words >> bit) & 1)
        table[has, seen[has]] = bit
        seen[has] += 1
    return table


def _tables() -> np.ndarray:
    state = worker_state("lm")
    if "select16" not in state:
        state["select16"] = _select_table()
    return state["select16"]


def pack(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of numbers below ``universe``."""
    n = len(values)
    universe = universe if n else 1
    values = values.astype(U64)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1) if n else 0
    high = (values >> U64(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
    at = high + np.arange(n)
    top = (universe - 1) >> low_bits if universe > 0 else 0
    words = np.zeros((n + top + 1) // 16 + 1, np.uint16)
    np.bitwise_or.at(words, at >> 4, (np.uint16(1) << (at & 15).astype(np.uint16)))
    low = np.zeros(n * low_bits // 64 + 2, U64)
    if low_bits:
        part = values & U64((1 << low_bits) - 1)
        pos = np.arange(n, dtype=np.int64) * low_bits
        word, off = pos >> 6, (pos & 63).astype(U64)
        np.bitwise_or.at(low, word, part << off)
        over = np.flatnonzero((pos & 63) + low_bits > 64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
    return {"meta": np.array([n, low_bits, top], np.int64), "high": words, "zeros": _zeros(words), "low": low}


def _zeros(words: np.ndarray) -> np.ndarray:
    """Zeros in front of every word; the ones follow from them."""
    zeros = np.concatenate([[0], np.cumsum(16 - np.bitwise_count(words).astype(np.int64))])
    return zeros.astype(np.uint32 if len(words) < 1 << 28 else np.int64)


class EliasFano:
    """A packed sequence: ``get`` by position, ``find`` by value."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.top = (int(x) for x in arrays["meta"])
        self.high, self.zeros, self.low = arrays["high"], arrays["zeros"], arrays["low"]
        self.ones: np.ndarray | None = None   # only ``get`` asks for them
        self.mask = U64((1 << self.bits) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        pos = i * self.bits
        word, off = pos >> 6, (pos & 63).astype(U64)
        x = self.low[word] >> off
        over = np.flatnonzero((pos & 63) + self.bits > 64)
        if len(over):
            x[over] |= self.low[word[over] + 1] << (U64(64) - off[over])
        return x & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        if self.ones is None:
            self.ones = (np.arange(len(self.zeros), dtype=np.int64) * 16 - self.zeros).astype(self.zeros.dtype)
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        at = word * 16 + _tables()[self.high[word], i - self.ones[word]]
        return ((at - i).astype(U64) << U64(self.bits)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First element with each high part, and the one after the last: those between two zeros."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        bits, rank, before = ~self.high[word], k - self.zeros[word], word * 16 - k
        lo = before + _tables()[bits, rank]
        # The next zero is mostly in the same word, where it can be read off.
        step = np.minimum(high, 1)
        end = before + _tables()[bits, np.minimum(rank + step, 15)] - step
        first = np.flatnonzero(high == 0)
        lo[first] = 0
        beyond = np.flatnonzero(k + step >= self.zeros[word + 1])
        if len(beyond):
            k = high[beyond]
            word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
            end[beyond] = word * 16 + _tables()[~self.high[word], k - self.zeros[word]] - k
        return lo, end

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where the sequence does not have it; values in order are found faster."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> U64(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(values), np.int64)
        inside = high <= self.top
        high = np.where(inside, high, 0)
        lo, end = self._bucket(high)
        want = values & self.mask
        hi = end.copy()
        # Successor search among the elements with this high part, by their low bits.
        live = np.flatnonzero(hi - lo > 1)
        while len(live):
            a, b = lo[live], hi[live]
            mid = (a + b - 1) >> 1
            less = self._low(mid) < want[live]
            lo[live] = a = np.where(less, mid + 1, a)
            hi[live] = b = np.where(less, b, mid + 1)
            live = live[b - a > 1]
        ok = np.flatnonzero(inside & (lo < end))
        ok = ok[self._low(lo[ok]) == want[ok]]
        out = np.full(len(values), -1, np.int64)
        out[ok] = lo[ok]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the (lowest, step) of their scale."""
    lo = float(x.min()) if len(x) else 0.0
    step = (float(x.max()) - lo) / 255 if len(x) else 0.0
    codes = np.rint((x - lo) / step).astype(np.uint8) if step else np.zeros(len(x), np.uint8)
    return codes, np.array([lo, step])


# ---- Files of a level -----------------------------------------------------

def _save(folder: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, x in arrays.items():
        made = f"{folder}/.{uuid.uuid4().hex}.npy"
        np.save(made, x)
        os.replace(made, f"{folder}/{shard}.{name}.npy")


def _load(folder: str, shard: int, name: str) -> np.ndarray:
    path = f"{folder}/{shard}.{name}.npy"
    return np.asarray(np.load(path, mmap_mode="r" if os.path.getsize(path) > 4096 else None))   # an empty array can't be mapped


def _sequence(folder: str, shard: int, name: str) -> EliasFano:
    arrays = {k: _load(folder, shard, f"{name}-{k}") for k in ("meta", "high", "low")}
    # The pointers are stored without ranks, as scoring does without them.
    return EliasFano(arrays | {"zeros": _zeros(arrays["high"]) if name == "pointers" else _load(folder, shard, f"{name}-zeros")})


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}-{k}": x for k, x in arrays.items() if (name, k) != ("pointers", "zeros")}


def _counted(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of exact counts: four bits each, 15 for those that are listed apart."""
    at = np.flatnonzero(counts >= 15)
    half = np.minimum(np.append(counts, 0), 15).astype(np.uint8)[:len(counts) + len(counts) % 2]
    return {"count": half[::2] | half[1::2] << 4, "count-size": np.array([len(counts)]),
            "count-at": _narrow(at), "count-big": _narrow(counts[at])}


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.int64)


def _counts(half: np.ndarray, at: np.ndarray, big: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Counts of entries i."""
    x = (half[i >> 1] >> ((i & 1) << 2).astype(np.uint8) & 15).astype(np.int64)
    large = np.flatnonzero(x == 15)
    x[large] = big[np.searchsorted(at, i[large].astype(at.dtype))]
    return x


def _all_counts(folder: str, shard: int) -> np.ndarray:
    return _counts(*(_load(folder, shard, name) for name in ("count", "count-at", "count-big")), np.arange(_size(folder, shard)))


def _size(folder: str, shard: int) -> int:
    """Entries of a shard."""
    return int(_load(folder, shard, "count-size")[0])


@dataclass
class Model:
    folder: str
    shards: int
    total: int                    # training tokens
    tokens: int                   # distinct ones
    unknown: float                # log10 probability of an unknown token
    order: int = 1
    bases: list[np.ndarray] = field(default_factory=list)   # number of the first entry of every shard, by level
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def level(self, n: int) -> str:
        return f"{self.folder}/level{n}"


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(29))


def _token_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of level 1 are ranges of the hash, so numbers follow the hash order."""
    return (((h >> U64(40)) * U64(shards)) >> U64(24)).astype(np.int64)


def _pair_shard(context: np.ndarray, token: np.ndarray, shards: int) -> np.ndarray:
    h = _scatter(_scatter(context.astype(U64)) + token.astype(U64))
    return (((h >> U64(40)) * U64(shards)) >> U64(24)).astype(np.int64)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by shard, in their order, and where each shard's begin)."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")   # numpy sorts 16 bits by radix
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """An order of the pairs of numbers, None where they are in order."""
    if len(a) < 2 or (a[:64] == np.sort(a[:64])).all() and ((a[1:] > a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] >= b[:-1]))).all():
        return None
    if max(int(a.max()), int(b.max())) < 1 << 32:
        return np.argsort((a.astype(U64) << U64(32)) | b.astype(U64))
    return np.lexsort((b, a))


class Trie:
    """Vectorised lookups in the mapped levels."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[tuple, object] = {}

    def _part(self, n: int, shard: int, name: str, sequence: bool = False):
        key = (n, shard, name)
        if key not in self.open:
            self.open[key] = (_sequence if sequence else _load)(self.model.level(n), shard, name)
        return self.open[key]

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order, cut = _dealt(shard, self.model.shards)
        for s in np.flatnonzero(cut[:-1] < cut[1:]).tolist():
            yield s, order[cut[s]:cut[s + 1]]

    def token_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for s, at in self._by_shard(_token_shard(hashes, self.model.shards)):
            found = self._part(1, s, "keys", True).find(hashes[at])
            out[at] = np.where(found >= 0, found + self.model.bases[0][s], -1)
        return out

    def gram_ids(self, n: int, context: np.ndarray, token: np.ndarray, *names: str):
        """Numbers of the n-grams of level n, -1 where there is none (or no context or token).

        With ``names``, numbers and a list of what ``values`` gives for these names.
        """
        out = np.full(len(context), -1, np.int64)
        more = [np.zeros(len(context)) for _ in names]
        use = np.flatnonzero((context >= 0) & (token >= 0))
        order = _pair_order(context[use], token[use])
        use = use if order is None else use[order]
        for s, at in self._by_shard(_pair_shard(context[use], token[use], self.model.shards)):
            at = use[at]
            own = context[at]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            place = self._part(n, s, "contexts", True).find(own[new].astype(U64))[np.cumsum(new) - 1]
            at, place = at[place >= 0], place[place >= 0]
            found = self._part(n, s, "successors", True).find(place.astype(U64) * U64(self.model.tokens) + token[at].astype(U64))
            at, found = at[found >= 0], found[found >= 0]
            out[at] = found + self.model.bases[n - 1][s]
            for x, name in zip(more, names):
                x[at] = self._decoded(n, s, name, found)
        return (out, more) if names else out

    def _decoded(self, n: int, s: int, name: str, i: np.ndarray) -> np.ndarray:
        if name == "count":
            return _counts(*(self._part(n, s, k) for k in ("count", "count-at", "count-big")), i)
        lo, step = self._part(n, s, f"{name}-scale")
        return lo + step * self._part(n, s, name)[i]

    def values(self, n: int, ids: np.ndarray, name: str, missing: float = 0.0) -> np.ndarray:
        """Decoded probabilities ("prob"), back-off weights ("back") or counts ("count") of entries."""
        out = np.full(len(ids), missing)
        use = np.flatnonzero(ids >= 0)
        base = self.model.bases[n - 1]
        for s, at in self._by_shard(np.searchsorted(base, ids[use], side="right") - 1):
            at = use[at]
            out[at] = self._decoded(n, s, name, ids[at] - base[s])
        return out

    def last_token(self, n: int, ids: np.ndarray) -> np.ndarray:
        """The last token of n-grams."""
        out = np.empty(len(ids), np.int64)
        base = self.model.bases[n - 1]
        for s, at in self._by_shard(np.searchsorted(base, ids, side="right") - 1):
            out[at] = (self._part(n, s, "successors", True).get(ids[at] - base[s]) % U64(self.model.tokens)).astype(np.int64)
        return out

    def successors(self, n: int, context: int) -> np.ndarray:
        """Tokens that follow a context (over all shards), by the pointers."""
        found = []
        for s in range(self.model.shards):
            place = self._part(n, s, "contexts", True).find(np.array([context], U64))[0]
            if place >= 0:
                lo, hi = self._part(n, s, "pointers", True).get(np.array([place, place + 1])).astype(np.int64)
                found.append(self._part(n, s, "successors", True).get(np.arange(lo, hi)) - U64(place * self.model.tokens))
        return np.sort(np.concatenate(found)) if found else np.empty(0, U64)


def _trie(model: Model) -> Trie:
    state = worker_state("lm")
    if state.get("trie_of") != (model.key, model.order):
        state["trie_of"], state["trie"] = (model.key, model.order), Trie(model)
    return state["trie"]


# ---- Counting -------------------------------------------------------------

def token_hashes(text: str | None) -> list[int]:
    """Hashes of a text's words (A-Z in lower case) and of its end."""
    # On bytes, lower() changes A-Z only and split() parts at \x20 \x09-\x0D only.
    out = list(map(xxhash.xxh64_intdigest, (text or "").encode("utf-8").lower().split()))
    out.append(END)
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes, compressed, after their number; numbers below 2**32 take four."""
    if x.dtype.kind in "iu" and x.itemsize == 8 and (not len(x) or (int(x.max()) < 1 << 32 and int(x.min()) >= 0)):
        x = x.astype(np.uint32)
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return bytes([x.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def _expand(data: bytes, kind) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8)
    x = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1)
    return x.view(kind) if width == np.dtype(kind).itemsize else x.view(np.uint32).astype(kind)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``token_hashes`` of many texts: (hashes, place there of every token, tokens of each text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = split.flatten().dictionary_encode(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    own = words.dictionary.to_numpy(zero_copy_only=False)   # much faster than to_pylist
    hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, own), U64, len(own)), U64(END))
    codes = words.indices.to_numpy()
    # Blanks at either end of a text leave an empty word there.
    keep = codes != words.dictionary.index("").as_py()
    before, ends = np.concatenate([[0], np.cumsum(keep)]), np.cumsum(sizes)
    lengths = before[ends] - before[ends - sizes] + 1
    out = np.full(int(lengths.sum()), len(hashes) - 1, np.int64)
    word = np.ones(len(out), bool)
    word[np.cumsum(lengths) - 1] = False
    out[word] = codes[keep]
    return hashes, out, lengths


def combined(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of a 1- or 2-column array) in order, with their counts."""
    if keys.ndim == 1:
        order = None if counts is None else np.argsort(keys)
        k = np.sort(keys) if order is None else keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    else:
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k = keys[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.empty(0, bool)
    first = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(first, len(k)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
    return k[first], sums.astype(np.int64)


def combined_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``combined`` of pairs, in one word where they fit: sorting is faster, the result is the same."""
    if len(a) and max(int(a.max()), int(b.max())) < 1 << 32:
        keys, sums = combined((a.astype(U64) << U64(32)) | b.astype(U64), counts)
        return np.column_stack([keys >> U64(32), keys & U64((1 << 32) - 1)]), sums
    return combined(np.column_stack([a, b]).astype(U64), counts)


def _blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row a shard: its keys (differences, byte planes) and counts, compressed."""
    order, cut = _dealt(shard, shards)
    own, a, b, c = [], [], [], []
    for s in range(shards):
        at = order[cut[s]:cut[s + 1]]
        if len(at):
            part = keys[at].reshape(len(at), -1)
            own.append(s)
            a.append(_squeeze(np.diff(part[:, 0], prepend=part.dtype.type(0))))
            b.append(_squeeze(part[:, 1].copy()) if part.shape[1] > 1 else None)
            c.append(_squeeze(counts[at]))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())],
                                      names=["shard", "a", "b", "n"])


BLOCK_SCHEMA = "shard int, a binary, b binary, n binary"


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The combined (keys, counts) of a shard's blocks."""
    first, second, counts = [], [], []
    for a, b, c in zip(table["a"].to_pylist(), table["b"].to_pylist(), table["n"].to_pylist()):
        first.append(np.cumsum(_expand(a, U64), dtype=U64))
        if b is not None:
            second.append(_expand(b, U64))
        counts.append(_expand(c, np.int64))
    if not second:
        return combined(np.concatenate(first), np.concatenate(counts))
    return combined_pairs(np.concatenate(first), np.concatenate(second), np.concatenate(counts))


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about SPLIT_BYTES together, or one that is longer."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, done + SPLIT_BYTES)))
        yield texts.slice(at, end - at)
        at, done = end, int(size[end - 1])


def _flushes(batches: Iterator[pa.RecordBatch], at: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes in order, place there of every token, lengths) of consecutive texts, about ``limit`` tokens each."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, place = np.unique(np.concatenate([h for h, _, _ in parts]), return_inverse=True)
        cut = np.cumsum([len(h) for h, _, _ in parts])
        return own, np.concatenate([place[e - len(h):e][c] for e, (h, c, _) in zip(cut, parts)]), np.concatenate([n for _, _, n in parts])

    for batch in batches:
        for piece in _pieces(batch.column(at)):
            parts.append(_split(piece))
            size += len(parts[-1][1])
            if size >= limit:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def _context_ids(trie: Trie, ids: np.ndarray, lengths: np.ndarray, upto: int) -> list[np.ndarray]:
    """For every n in 1..upto the number of the n-gram that ends at each token."""
    ends = [ids]
    for n in range(2, upto + 1):
        ends.append(_grams(trie, n, _before(ends[-1], lengths), ids)[0])
    return ends


def _grams(trie: Trie, n: int, before: np.ndarray, ids: np.ndarray, *names: str) -> list[np.ndarray]:
    """[numbers of the n-grams, values by names]; every distinct n-gram is looked up once."""
    use = np.flatnonzero((before >= 0) & (ids >= 0))
    order = _pair_order(before[use], ids[use])
    use = use if order is None else use[order]
    a, b = before[use], ids[use]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(use) else np.empty(0, bool)
    which = np.cumsum(new) - 1
    found = trie.gram_ids(n, a[new], b[new], *names)
    out = []
    for x in [found[0], *found[1]] if names else [found]:
        all_of = np.full(len(ids), -1 if not out else 0, x.dtype)
        all_of[use] = x[which]
        out.append(all_of)
    return out


def _before(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The n-gram in front of each token, -1 at the start of a text (and where it holds no n tokens)."""
    before = np.concatenate([[-1], ends[:-1]])
    before[np.cumsum(lengths) - lengths] = -1
    return before


def _local_folder(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"n-gram levels are mapped into memory: {path} has to be a folder mounted on all nodes")
    return parts.path


def build(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, text_col: str = "text") -> Model:
    """Count, smooth and write all levels (1 to 3) over every row of ``docs``."""
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    rows = pick(docs, text=text_col)
    chars, texts = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    shards = max(1, -(-((chars or 0) // 6 + texts) // SHARD_TOKENS))
    model = Model(_local_folder(scratch(spark, "ngrams")), shards, 0, 0, 0.0)

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, codes, _ in _flushes(batches, 0, FLUSH_TOKENS):
            counts = np.bincount(codes, minlength=len(hashes))
            keys, counts = hashes[counts > 0], counts[counts > 0]
            yield _blocks(keys, counts, _token_shard(keys, shards), shards)

    def write_tokens(key, table):
        keys, counts = _gathered(table)
        shard = key[0].as_py()
        _save(model.level(1), shard, _named("keys", pack(keys, 1 << 64)) | _counted(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    sizes = (rows.mapInArrow(count_tokens, BLOCK_SCHEMA).groupBy("shard")
             .applyInArrow(write_tokens, "shard int, n bigint, total bigint").collect())
    n = np.zeros(shards, np.int64)
    for r in sizes:
        n[r["shard"]] = r["n"]
    for s in np.flatnonzero(n == 0):
        _save(model.level(1), int(s), _named("keys", pack(np.empty(0, U64), 1 << 64)) | _counted(np.empty(0, np.int64)))
    model.total, model.tokens = sum(r["total"] for r in sizes), int(n.sum())
    model.bases.append(np.concatenate([[0], np.cumsum(n)[:-1]]))
    model.unknown = float(np.log10(DISCOUNT * model.tokens / model.total)) if model.total else 0.0
    for k in range(2, order + 1):
        model.order = k - 1
        _build_level(rows, model, k, min_count)
    _write_probs(spark, model)
    model.order = order
    return model


def _write_probs(spark, model: Model) -> None:
    """Level 1's probabilities, shard by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                codes, scale = quantise(_first_probs(_all_counts(model.level(1), s), model))
                _save(model.level(1), s, {"prob": codes, "prob-scale": scale})
            yield batch

    spark.range(0, model.shards, 1, model.shards).mapInArrow(run, "id bigint").count()


def _first_probs(count: np.ndarray, model: Model) -> np.ndarray:
    return np.log10((count - DISCOUNT) / model.total) if len(count) else np.empty(0)


def _build_level(rows: DataFrame, model: Model, n: int, min_count: int) -> None:
    shards = model.shards

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model)
        for hashes, codes, lengths in _flushes(batches, 0, FLUSH_TOKENS):
            ends = _context_ids(trie, trie.token_ids(hashes)[codes], lengths, n - 1)
            ids, before = ends[0], _before(ends[-1], lengths)
            use = np.flatnonzero((before >= 0) & (ids >= 0))
            keys, counts = combined_pairs(before[use], ids[use], None)
            if len(keys):
                yield _blocks(keys, counts, _pair_shard(keys[:, 0], keys[:, 1], shards), shards)

    def write_grams(key, table):
        shard, trie = key[0].as_py(), _trie(model)
        keys, counts = _gathered(table)
        keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        new = np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]]) if len(keys) else np.empty(0, bool)
        contexts, place = keys[new, 0], np.cumsum(new) - 1
        starts = np.append(np.flatnonzero(new), len(keys))
        whole = trie.values(n - 1, contexts.astype(np.int64), "count")
        codes, scale = quantise(np.log10((counts - DISCOUNT) / whole[place]) if len(keys) else np.empty(0))
        _save(model.level(n), shard,
              _named("contexts", pack(contexts, int(contexts[-1]) + 1 if len(contexts) else 1))
              | _named("pointers", pack(starts.astype(U64), len(keys) + 1))
              | _named("successors", pack(place.astype(U64) * U64(model.tokens) + keys[:, 1], max(1, len(contexts) * model.tokens)))
              | {"prob": codes, "prob-scale": scale} | _counted(counts))
        # What each context has given away (as the count and number of its n-grams), and what the shorter contexts
        # would have given to the same successors.
        shorter = np.power(10.0, _shorter_probs(trie, n, contexts, place, keys[:, 1], model))
        low = np.bincount(place, shorter, len(contexts)) if len(keys) else np.empty(0)
        given = np.add.reduceat(counts, starts[:-1]) if len(keys) else np.empty(0, np.int64)
        cut = np.append(np.searchsorted(contexts, model.bases[n - 2].astype(U64)), len(contexts))
        out = {"size": [len(keys)], "shard": [shard], "owner": [-1], "c": [b""], "g": [b""], "k": [b""], "l": [b""], "v": [b""]}
        for o in np.flatnonzero(cut[:-1] < cut[1:]).tolist():
            at = slice(cut[o], cut[o + 1])
            # Most contexts have one successor here, and its probability is one of few.
            some, which = np.unique(low[at], return_inverse=True)
            for name, x in (("size", 0), ("shard", shard), ("owner", o), ("c", _squeeze(np.diff(contexts[at], prepend=U64(0)))),
                            ("g", _squeeze(given[at])), ("k", _squeeze(np.diff(starts[cut[o]:cut[o + 1] + 1]))),
                            ("l", _squeeze(which.astype(np.uint32))), ("v", _squeeze(some))):
                out[name].append(x)
        return pa.table({"size": pa.array(out["size"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()),
                         "owner": pa.array(out["owner"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in "cgklv"}})

    def write_back(key, table):
        owner = key[0].as_py()
        if owner < 0:   # the shards' sizes
            return table.select(["owner", "shard", "size"])
        whole = _all_counts(model.level(n - 1), owner)
        taken, low = np.zeros(len(whole)), np.zeros(len(whole))
        for c, g, k, x, v in zip(*(table[name].to_pylist() for name in "cgklv")):
            at = np.cumsum(_expand(c, U64), dtype=U64).astype(np.int64) - model.bases[n - 2][owner]
            taken[at] += _expand(g, np.int64) - DISCOUNT * _expand(k, np.int64)
            low[at] += _expand(v, np.float64)[_expand(x, np.uint32)]
        left = np.maximum(1 - taken / whole, 1e-9) / np.maximum(1 - low, 1e-9)
        codes, scale = quantise(np.log10(left))
        _save(model.level(n - 1), owner, {"back": codes, "back-scale": scale})
        return pa.table({"owner": pa.array([owner], pa.int32()), "shard": pa.array([-1], pa.int32()), "size": pa.array([0], pa.int64())})

    made = rows.mapInArrow(count_grams, BLOCK_SCHEMA).groupBy("shard").applyInArrow(
        write_grams, "size bigint, shard int, owner int, c binary, g binary, k binary, l binary, v binary")
    made = made.groupBy("owner").applyInArrow(write_back, "owner int, shard int, size bigint").collect()
    sizes = np.zeros(shards, np.int64)
    present = {r["shard"]: r["size"] for r in made if r["owner"] < 0}
    for s, size in present.items():
        sizes[s] = size
    for s in set(range(shards)) - set(present):
        none = np.empty(0, U64)
        _save(model.level(n), s, _named("contexts", pack(none, 1)) | _named("pointers", pack(np.zeros(1, U64), 1))
              | _named("successors", pack(none, 1)) | {"prob": np.empty(0, np.uint8), "prob-scale": np.zeros(2)} | _counted(np.empty(0, np.int64)))
    for s in set(range(shards)) - {r["owner"] for r in made}:
        size = _size(model.level(n - 1), s)
        _save(model.level(n - 1), s, {"back": np.zeros(size, np.uint8), "back-scale": np.zeros(2)})
    model.bases.append(np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _shorter_probs(trie: Trie, n: int, contexts: np.ndarray, place: np.ndarray, tokens: np.ndarray, model: Model) -> np.ndarray:
    """log10 probabilities of the successors in the context without its first token (level n - 1)."""
    tokens = tokens.astype(np.int64)
    p = _first_probs(trie.values(1, tokens, "count", 1.0), model)
    if n == 3:
        last = trie.last_token(2, contexts.astype(np.int64))[place]
        grams = trie.gram_ids(2, last, tokens)
        p = np.where(grams >= 0, trie.values(2, grams, "prob"), p + trie.values(1, last, "back"))
    return p


# ---- Scoring --------------------------------------------------------------

def score_tokens(trie: Trie, hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of every token (its place among the hashes) of consecutive texts."""
    m = trie.model
    own = trie.token_ids(hashes)
    ids, count = own[codes], trie.values(1, own, "count")[codes]
    p = np.where(own >= 0, trie.values(1, own, "prob"), m.unknown)[codes]
    starts, ends, back = np.cumsum(lengths) - lengths, ids, None
    for n in range(2, m.order + 1):
        # Without the n-gram: the shorter context's probability, times the back-off weight of the context.
        back = trie.values(1, own, "back")[codes] if back is None else back
        p[1:] += np.where(_first(starts, len(p))[1:], 0, back[:-1])
        ends, prob, *more = _grams(trie, n, _before(ends, lengths), ids, "prob", *["back"] * (n < m.order))
        p = np.where(ends >= 0, prob, p)
        back = more[0] if more else None
    return p, count


def _first(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[starts] = True
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(received(shared))
        m = trie.model
        rest = np.log10(float(m.total + m.tokens + 1))
        for batch in batches:
            at = 0
            for hashes, codes, lengths in _flushes(iter([batch]), 1, SCORE_TOKENS):
                p, count = score_tokens(trie, hashes, codes, lengths)
                starts = np.cumsum(lengths) - lengths
                base = np.add.reduceat(np.log10(count + 1) - rest, starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(lengths)), pa.array(lengths, pa.int64()),
                     pa.array(np.add.reduceat((count > 0).astype(np.int64), starts), pa.int64()),
                     pa.array(np.full(len(lengths), m.total), pa.int64()), pa.array(base, pa.float64()),
                     pa.array(np.add.reduceat(p, starts), pa.float64())],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(lengths)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
