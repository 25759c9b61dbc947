"""Token ids as compact binary files: an adaptive context-mixing range coder.

Ids are written in blocks of at most ``BLOCK`` ids. A block starts from an
empty model and carries its length and a checksum, so any block can be read
alone. Inside a block,

* order 2 and order 1 predict the next id from what followed the last two ids
  and the last id before, each with a confidence; the prediction of the highest
  order that has one is the candidate;
* the chance that the candidate is right is mixed, in the logistic domain and
  with weights that learn, from two adaptive estimates: one by the confidences
  of both orders, one by the candidate itself (order 0);
* an id that was not predicted is coded by its order-0 frequency class and its
  remaining bits; only such ids are counted.

Predictions change with every id; estimates and weights follow one id in
``LEARN`` and are renewed after windows of up to ``RENEW`` ids, class
frequencies after up to ``RENEW_CLASSES`` ids that were not predicted. So most
of the work is done for whole windows. Range coders take the decisions, one
which ids are hits, another the classes of the others; remaining bits are laid
end to end. Where numbers are not integers, single operations of IEEE arithmetic
are rounded down, so what is read back does not depend on the machine. Many
blocks are coded side by side, one id of each at a time, which turns the coders
into array operations.

The files are Parquet tables of records: whole documents, in ascending order of
doc_id, with the number of ids of each and the blocks as bytes. Records are cut
by size and never depend on one another.

Defined cases: a null text is empty and has the end id alone; an empty table
gives an empty result; documents with equal doc_id are ordered by their text
(null first); a null doc_id comes first; ids are below 2**32; other columns are
left behind.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, scratch, worker_state

BLOCK = 4096
RENEW, RENEW_CLASSES, FIRST_WINDOW, STRIP = 512, 1024, 32, 128
#: Ids after which a record is closed (at the end of a document), and blocks coded side by side.
RECORD_IDS = 16 * BLOCK
SIDE_BY_SIDE = 1536

MAGIC = b"SMI2"
HEADER = "<4sBIIIIII"                  # magic, bits of an id, ids, ids not predicted, bytes of the three parts, crc32 of the ids
SLOTS1, SLOTS2 = 512, 1024
SURE, OWN = 32, 64                     # estimates by the confidences of both orders, and by the candidate
KEPT = 256                             # ids after which the counts of an estimate are halved
MANTISSA = 5
UNIT = 12                              # bits of a chance and of class frequencies
START_MASK = (1 << UNIT + 1) - 1       # a class's start lies below its frequency in one integer
LEARN = 4                              # one in so many ids is counted for estimates and weights; predictions learn from all
TOP, FLOOR, WORD = 32, 16, 16          # the range stays in [2**16, 2**32), words of 16 bits leave it

#: Words that a worker keeps, words that the library is given at once, and bytes of texts that are tokenized together.
WORDS_KEPT, JOINED, TEXT_BYTES = 400_000, 200, 8_000_000
#: Letters whose lower case and normal form are one letter each, and marks that the tokenizer sets apart from them.
LETTERS, MARKS = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+", string.punctuation
SAMPLE = [a + chr(x) + b for x in range(0x61, 0x250) if chr(x).isalpha() and chr(x).islower() for a, b in (("", ""), ("th", "e"), ("", "ing"))]


# ---- The model ------------------------------------------------------------

def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch by 12-bit probability, squash by the sum of two 12-bit logits and 4096 (fixed tables of rounded values)."""
    x = np.clip(np.arange(-4096, 4096), -2048, 2047) / 256
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.uint32)
    p = np.clip(np.arange(4096), 1, 4095) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)
    return stretch, squash


STRETCH, SQUASH = _logistic()


def kind_of(bits: int) -> type:
    """The integers that hold ``id * 4 + 3``."""
    return np.uint32 if bits <= 28 else np.uint64


def class_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First id and remaining bits of every class for ids of that many bits: small ids alone, larger ones by their leading bits."""
    small = 1 << (MANTISSA + 1)
    first, rest = list(range(small)), [0] * small
    for r in range(1, max(0, bits - 1 - MANTISSA) + 1):
        first += [m << r for m in range(1 << MANTISSA, 1 << (MANTISSA + 1))]
        rest += [r] * (1 << MANTISSA)
    return np.array(first, np.int64), np.array(rest, np.int64)


def _classes(ids: np.ndarray) -> np.ndarray:
    size = np.frexp(ids.astype(np.float64))[1].astype(np.int64)      # bit length, exact below 2**53
    rest = np.maximum(size - 1 - MANTISSA, 0)
    return (ids >> rest) + (rest << MANTISSA)


SMALL_CLASSES = _classes(np.arange(1 << 16)).astype(np.int16)


def classes_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return SMALL_CLASSES.take(ids) if bits <= 16 else _classes(ids)


def windows(steps: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of a block: short ones first, ``most`` ids later on."""
    a, size = 0, FIRST_WINDOW
    while a < steps:
        yield a, min(a + size, steps)
        a, size = a + size, min(a + size, most)


class Mixer:
    """Orders 1 and 2 of ``n`` blocks and the chance that their candidate is right.

    A prediction is kept as ``id * 4`` and how far its confidence is from 3;
    tables of all blocks lie end to end, so that a step is a few gathers and
    scatters. Predictions change with every id; estimates and weights at the
    end of a window.
    """

    def __init__(self, n: int, bits: int):
        self.kind = kind_of(bits)
        self.guess = np.full(n * (SLOTS1 + SLOTS2), 3, self.kind)
        # Ids seen and hits by the confidences of both orders, and by the candidate.
        self.seen = [np.zeros((2, n, size), np.int64) for size in (SURE, OWN)]
        self.w = np.full((2, n), 40000, np.int64)
        self.narrow(n)
        self.renew()

    def narrow(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.seen, self.w = [x[:, :n] for x in self.seen], self.w[:, :n]
        self.row1, self.row_sure, self.row_own = (np.arange(n, dtype=np.uint32) * np.uint32(x) for x in (SLOTS1 + SLOTS2, SURE, OWN))
        self.row2 = self.row1 + np.uint32(SLOTS1)

    def renew(self) -> None:
        """What the estimates add to the logit, from the counts and weights so far."""
        self.stretched, self.adds = [], []
        for w, (seen, hits) in zip(self.w, self.seen):
            s = STRETCH.take((((2 * hits + 1) << 12) / (2 * seen + 4)).astype(np.int64))
            self.stretched.append(s.ravel())
            self.adds.append((np.clip((w[:, None] * s) >> 16, -2047, 2047) + 2048).astype(np.int32).ravel())

    def places(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where orders 1 and 2 keep what follows these ids."""
        one, two = last & SLOTS1 - 1, last * self.kind(40503) + before >> 4 & SLOTS2 - 1
        return self.row1 + one.astype(np.uint32, copy=False), self.row2 + two.astype(np.uint32, copy=False)

    def contexts(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, place of its confidences, its own place) from the predictions of both orders."""
        sure, sure2 = one & 3, two & 3
        one, two = one >> 2, two >> 2
        candidate = np.where(sure2 == 3, one, two)
        sure += sure2 << 2
        sure += (one == two).view(np.uint8) << 4
        return candidate, self.row_sure + sure.astype(np.uint32, copy=False), self.row_own + (candidate & OWN - 1).astype(np.uint32, copy=False)

    def chance(self, sure: np.ndarray, own: np.ndarray) -> np.ndarray:
        """12-bit chance that the candidate is right."""
        return SQUASH.take(self.adds[0].take(sure, mode="clip") + self.adds[1].take(own, mode="clip"), mode="clip")

    def follow(self, at1: np.ndarray, at2: np.ndarray, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> None:
        """A prediction that was right grows in confidence, another is replaced."""
        new = ids << 2
        below = new - 1
        # Unsigned: other predictions differ by more than 3, as one of no confidence does by 3.
        self.guess[at1] = below + np.minimum(np.maximum(one - new, 1), 3)
        self.guess[at2] = below + np.minimum(np.maximum(two - new, 1), 3)

    def learn(self, sure: np.ndarray, own: np.ndarray, p: np.ndarray, hit: np.ndarray) -> None:
        """The end of a window: estimates and weights follow every ``LEARN``th of its ids, rows of one a block."""
        err = (hit.astype(np.int64) << UNIT) - p
        for j, (table, at) in enumerate(zip(self.seen, (sure, own))):
            self.w[j] += (self.stretched[j].take(at) * err).sum(axis=0) >> 11
            for counts, which in zip(table, (at.ravel(), at[hit])):
                counts += np.bincount(which, minlength=counts.size).reshape(counts.shape)
            table >>= table[0] > KEPT
        np.clip(self.w, 0, 1 << 17, out=self.w)
        self.renew()


class Classes:
    """Order 0 of ``n`` blocks: adaptive frequencies (of 4096 in all) of the classes of ids that were not predicted."""

    def __init__(self, n: int, bits: int):
        self.first, self.rest = class_table(bits)
        self.k = len(self.first)
        self.counts = np.zeros((n, self.k), np.float32)   # exact: a block has at most 4096 ids
        self.renew()
        self.narrow(n)

    def narrow(self, n: int) -> None:
        self.counts, self.freq = self.counts[:n], self.freq[:n * self.k]
        self.row, self.row_slot = np.arange(n, dtype=np.int32) * np.int32(self.k), np.arange(n, dtype=np.int32) << UNIT

    def renew(self) -> None:
        n, k = self.counts.shape
        total = self.counts.sum(axis=1, keepdims=True)
        freq = (self.counts * (np.float32((1 << UNIT) - k) / np.maximum(total, np.float32(1)))).astype(np.int32)
        freq += 1
        left = (1 << UNIT) - freq.sum(axis=1)
        none = total[:, 0] == 0
        share, over = divmod((1 << UNIT) - k, k)
        freq[none] += share
        freq[none, :over] += 1
        left[none] = 0
        freq[np.arange(n), self.counts.argmax(axis=1)] += left
        self.freq = freq.ravel()
        # Blocks lie end to end here too: the total of each is 4096.
        self.packed = ((np.cumsum(self.freq, dtype=np.int32) - self.freq & (1 << UNIT) - 1) + (self.freq << UNIT + 1)).view(np.uint32)

    def slots(self) -> np.ndarray:
        """The class at every slot of the frequencies, of all blocks."""
        return np.repeat(np.tile(np.arange(self.k, dtype=np.int16), len(self.counts)), self.freq)

    def learn(self, classes: np.ndarray) -> None:
        """The end of a window of classes, rows of one a block."""
        self.counts += np.bincount((self.row + classes).ravel(), minlength=self.counts.size).reshape(self.counts.shape)
        self.renew()


# ---- The coder ------------------------------------------------------------

def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of blocks, longest first; their lengths)."""
    order = np.argsort(-lengths, kind="stable")
    return order, lengths[order]


def _live(sizes: np.ndarray, t: int) -> int:
    """How many blocks, longest first, have more than t ids."""
    return int(np.searchsorted(-sizes, -t, side="left"))


def _flip(a: np.ndarray) -> np.ndarray:
    """The transpose as an array of its own, copied by strips that stay in the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, len(a), 64):
        out[:, i:i + 64] = a[i:i + 64].T
    return out


class Writer:
    """The range coder of many blocks: intervals in, words out."""

    def __init__(self, n: int, steps: int):
        self.low, self.span = np.zeros(n, np.int64), np.full(n, (1 << TOP) - 1, np.uint32)
        self.width = steps * (UNIT + 1) // WORD + 4
        # A word may be one carry above WORD bits until all are out.
        self.out, self.base = np.zeros(n * self.width, np.uint32), np.arange(n) * self.width
        self.end = self.base.copy()

    def settle(self, lo: np.ndarray, sp: np.ndarray) -> None:
        """Full words leave; lo and sp are the first blocks' ends of the range."""
        small = np.flatnonzero(sp < 1 << FLOOR)
        if len(small):
            over, to = lo[small], self.end[small]
            self.out[to] = over >> FLOOR
            self.end[small] = to + 1
            lo[small] = (over & (1 << FLOOR) - 1) << WORD
            sp[small] <<= WORD

    def parts(self) -> list[bytes]:
        self.out[self.end] = self.low + ((1 << FLOOR) - 1) >> FLOOR
        words = self.out.reshape(-1, self.width)[:, :int((self.end - self.base).max()) + 1]
        while (carry := words >> WORD).any():
            words &= (1 << WORD) - 1
            words[:, :-1] += carry[:, 1:]
        words = words.astype("<u2", order="C")
        return [w[:e + 1].tobytes() for w, e in zip(words, self.end - self.base)]


class Reader:
    """The range coder's words of many blocks."""

    def __init__(self, parts: list[bytes]):
        n, width = len(parts), max(map(len, parts)) // 2 + 4
        words = np.zeros((n, width), np.uint16)
        for row, data in zip(words, parts):
            row[:len(data) // 2] = np.frombuffer(data, "<u2", len(data) // 2)
        self.words, self.place = words.ravel(), np.arange(n) * width
        self.code = (self.words.take(self.place).astype(np.uint32) << WORD) | self.words.take(self.place + 1)
        self.place += 2
        self.span = np.full(n, (1 << TOP) - 1, np.uint32)

    def narrow(self, n: int) -> None:
        self.place, self.code, self.span = self.place[:n], self.code[:n], self.span[:n]

    def settle(self) -> None:
        small = np.flatnonzero(self.span < 1 << FLOOR)
        if len(small):
            at = self.place[small]
            self.code[small] = self.code[small] << WORD | self.words.take(at, mode="clip")
            self.place[small] = at + 1
            self.span[small] <<= WORD


def _bit_places(sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bit of every value, 16-bit words before every block and in all) for values of some blocks end to end."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(np.diff(ends[cut]) + 15 >> 4)])
    return ends[:-1] + np.repeat(words[:-1] * 16 - ends[cut[:-1]], counts), words


def _pack_bits(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bits of some blocks' values, as 16-bit words of each block."""
    place, words = _bit_places(sizes, counts)
    raw = np.zeros(int(words[-1]) + 4, np.uint16)
    if len(values):
        # Values that begin in a word are neighbours, and no two have a bit in common.
        word = place >> 4
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        both, word = np.add.reduceat(values << (place & 15), new), word[new]
        for j in range(3):
            raw[word + j] |= (both >> 16 * j & 0xFFFF).astype(np.uint16)
    return [raw[x:y].astype("<u2").tobytes() for x, y in zip(words, words[1:])]


def _unpack_bits(parts: list[bytes], sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    place, words = _bit_places(sizes, counts)
    if list(map(len, parts)) != (2 * np.diff(words)).tolist():
        raise ValueError("a block of ids has a wrong length")
    raw = np.frombuffer(b"".join(parts) + b"\0" * 8, "<u2").astype(np.int64)
    wide = raw[:-2] | raw[1:-1] << 16 | raw[2:] << 32
    return wide.take(place >> 4) >> (place & 15) & (1 << sizes) - 1


def _encode_missed(ids: np.ndarray, counts: np.ndarray, bits: int) -> tuple[list[bytes], list[bytes]]:
    """(coded classes, remaining bits) of ids that were not predicted, of all blocks end to end."""
    order, sizes = _lanes(counts)
    steps, n = int(sizes[0]), len(order)
    model, coder = Classes(n, bits), Writer(n, steps)
    rows, raw = np.zeros((n, steps), np.int16), []
    cut = np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, n, 64):
        own = ids[cut[i]:cut[min(i + 64, n)]].astype(np.int64)
        klass, many = classes_of(own, bits), counts[i:i + 64]
        rows[i:i + 64][np.arange(steps) < many[:, None]] = klass
        raw += _pack_bits(own - model.first.take(klass), model.rest.take(klass), many)
    rows = _flip(rows[order])
    for a, b in windows(steps, RENEW_CLASSES):
        live = _live(sizes, a)
        model.narrow(live)
        own = rows[a:b, :live]
        packed = model.packed.take(model.row + own)
        start, freq = packed & START_MASK, packed >> UNIT + 1
        for t in range(b - a):
            now = _live(sizes, a + t) if sizes[live - 1] < b else live
            lo, sp = coder.low[:now], coder.span[:now]
            unit = sp >> UNIT
            lo += unit * start[t, :now]
            np.multiply(unit, freq[t, :now], out=sp)
            coder.settle(lo, sp)
        if b < steps:
            model.learn(own)
    coded = [b""] * n
    for i, data in zip(order, coder.parts()):
        coded[i] = data
    return coded, raw


def _decode_missed(coded: list[bytes], tails: list[bytes], counts: np.ndarray, bits: int) -> np.ndarray:
    """The ids that were not predicted: a row for each place among them, a column for each block."""
    order, sizes = _lanes(counts)
    steps, n = int(sizes[0]), len(order)
    model, coder = Classes(n, bits), Reader([coded[i] for i in order])
    rows = np.zeros((steps, n), np.int16)
    for a, b in windows(steps, RENEW_CLASSES):
        live = _live(sizes, a)
        model.narrow(live)
        coder.narrow(live)
        slots, own = model.slots(), rows[a:b, :live]
        # Blocks that end inside a window go on with whatever comes: nothing is taken from it.
        for t in range(b - a):
            unit = coder.span >> UNIT
            # The floor of a quotient of 32-bit integers, exact as a double.
            slot = (coder.code / unit).astype(np.int32) & (1 << UNIT) - 1
            k = own[t] = slots.take(model.row_slot + slot, mode="clip")
            packed = model.packed.take(model.row + k, mode="clip")
            coder.code -= unit * (packed & START_MASK)
            coder.span = unit * (packed >> UNIT + 1)
            coder.settle()
        if b < steps:
            model.learn(own)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    rows, ids = _flip(rows)[at], np.zeros((steps + 1, n), kind_of(bits))
    for i in range(0, n, 64):
        many = counts[i:i + 64]
        there = np.arange(steps) < many[:, None]
        klass = rows[i:i + 64][there]
        own = np.zeros(there.shape, ids.dtype)
        own[there] = model.first.take(klass) + _unpack_bits(tails[i:i + 64], model.rest.take(klass), many)
        ids[:-1, i:i + 64] = own.T
    return ids


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Blocks of ids (each non-empty) to bytes, all side by side."""
    order, sizes = _lanes(np.array([len(b) for b in blocks]))
    steps, n = int(sizes[0]), len(order)
    rows = np.zeros((n, steps + 2), kind_of(bits))   # two zeros come before
    for row, i in zip(rows, order):
        row[2:len(blocks[i]) + 2] = blocks[i]
    ids = _flip(rows)
    missed = np.zeros((steps, n), bool)
    m, coder = Mixer(n, bits), Writer(n, steps)
    for a, b in windows(steps, RENEW):
        live = _live(sizes, a)
        m.narrow(live)
        seen: list[tuple] = []
        for c in range(a, b, STRIP):
            d = min(c + STRIP, b)
            x = ids[c + 2:d + 2, :live]
            at1, at2 = m.places(ids[c + 1:d + 1, :live], ids[c:d, :live])
            one, two = np.empty(x.shape, m.kind), np.empty(x.shape, m.kind)
            for t in range(d - c):
                one[t], two[t] = m.guess[at1[t]], m.guess[at2[t]]
                m.follow(at1[t], at2[t], one[t], two[t], x[t])
            candidate, sure, own = m.contexts(one, two)
            p, hit = m.chance(sure, own), candidate == x
            missed[c:d, :live] = ~hit
            seen.append(tuple(v[::LEARN] for v in (sure, own, p, hit)))
            for t in range(d - c):
                now = _live(sizes, c + t) if sizes[live - 1] < d else live
                lo, sp = coder.low[:now], coder.span[:now]
                bound = (sp >> UNIT) * p[t, :now]
                right = hit[t, :now]
                lo += bound * ~right
                sp[:] = np.where(right, bound, sp - bound)
                coder.settle(lo, sp)
        if b < steps:
            m.learn(*map(np.concatenate, zip(*seen)))
    wrong = _flip(missed) & (np.arange(steps) < sizes[:, None])
    counts = wrong.sum(axis=1)
    packed = [b""] * n
    for i, parts, count in zip(order, zip(coder.parts(), *_encode_missed(rows[:, 2:][wrong], counts, bits)), counts):
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        packed[i] = struct.pack(HEADER, MAGIC, bits, len(blocks[i]), count, *map(len, parts), crc) + b"".join(parts)
    return packed


def split_blocks(data: bytes) -> list[tuple]:
    """(bits, ids, crc, ids not predicted, coded hits, coded classes, remaining bits) of blocks laid end to end."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < struct.calcsize(HEADER):
            raise ValueError("not a block of ids")
        magic, bits, n, count, *sizes, crc = struct.unpack_from(HEADER, data, at)
        cut = list(accumulate(sizes, initial=at + struct.calcsize(HEADER)))
        if magic != MAGIC or not n or count > n or cut[-1] > len(data):
            raise ValueError("not a block of ids")
        out.append((bits, n, crc, count, *(data[x:y] for x, y in zip(cut, cut[1:]))))
        at = cut[-1]
    return out


def decode_blocks(packed: list[tuple]) -> list[np.ndarray]:
    """The ids of the blocks that ``split_blocks`` gave, with equal bits, side by side; a wrong checksum raises."""
    order, sizes = _lanes(np.array([b[1] for b in packed]))
    packed = [packed[i] for i in order]
    bits, steps, n = packed[0][0], int(sizes[0]), len(order)
    counts = np.array([b[3] for b in packed])
    m, coder = Mixer(n, bits), Reader([b[4] for b in packed])
    wrong = _decode_missed([b[5] for b in packed], [b[6] for b in packed], counts, bits).ravel()
    at = np.arange(n)
    last, before = np.zeros(n, m.kind), np.zeros(n, m.kind)
    out = np.zeros((steps, n), m.kind)
    for a, b in windows(steps, RENEW):
        live = _live(sizes, a)
        m.narrow(live)
        coder.narrow(live)
        last, before, at = last[:live], before[:live], at[:live]
        # What is learned from at the end of the window.
        seen: list[tuple] = []
        for t in range(b - a):
            at1, at2 = m.places(last, before)
            one, two = m.guess[at1], m.guess[at2]
            candidate, sure, own = m.contexts(one, two)
            chance = m.chance(sure, own)
            bound = (coder.span >> UNIT) * chance
            right = coder.code < bound
            coder.code = np.minimum(coder.code, coder.code - bound)   # unsigned: below bound it would wrap
            coder.span = np.where(right, bound, coder.span - bound)
            coder.settle()
            x = np.where(right, candidate, wrong.take(at, mode="clip"))
            at += ~right * n
            out[a + t, :live] = x
            m.follow(at1, at2, one, two, x)
            before, last = last, x
            if t % LEARN == 0:
                seen.append((sure, own, chance, right))
        if b < steps:
            m.learn(*map(np.stack, zip(*seen)))
    result: list[np.ndarray] = [np.empty(0)] * n
    for i, row, size, block in zip(order, _flip(out).astype("<u4", copy=False), sizes, packed):
        result[i] = row[:size]
        if zlib.crc32(result[i].tobytes()) != block[2]:
            raise ValueError("a block of ids has a wrong checksum")
    return result


# ---- Tokenizing -----------------------------------------------------------

def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, end to end."""
    ends = np.cumsum(sizes, dtype=starts.dtype)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places), dtype=places.dtype)
    return places


class Tokens:
    """Ids of whole texts by the tokenizers library, asked once for each recent word.

    With a tokenizer that drops white space, lowers letters and sets them apart
    from marks, the ids of a text are those of its blank-separated units one
    after the other, and those of letters with marks at their end are the ids of
    both. Units are split and numbered as Arrow arrays, only the distinct ones
    of a batch are looked up; the ids of all words lie end to end in one array.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = self.plain = (self.library.normalizer, self.library.pre_tokenizer)
        # Lower-case letters set apart by blanks need no normal form and no pattern, if this says the same.
        sample = " ".join(SAMPLE)
        ids = self.library.encode(sample, add_special_tokens=False).ids
        way = normalizers.Sequence([]), pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self._batch([sample], way)[0].ids == ids:
            self.plain = way
        # Ids that end a word, if the tokenizer marks them.
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        tokens = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        self.last = np.array([(t or "").endswith(suffix) for t in tokens]) if suffix else None
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int32)
        self.used, self.turn = np.zeros(0, np.int32), 0   # the batch that last had the word

    def _batch(self, texts: list[str], way: tuple) -> list:
        """What the library makes of texts, with this normalizer and pre-tokenizer."""
        self.library.normalizer, self.library.pre_tokenizer = way
        try:
            return self.library.encode_batch_fast(texts, add_special_tokens=False)
        finally:
            self.library.normalizer, self.library.pre_tokenizer = self.whole

    def _forget(self) -> None:
        """Only the words of the last two batches stay."""
        stay = np.flatnonzero(self.used > self.turn - 2)
        words, sizes = list(self.known), np.diff(self.ends)[stay]
        self.ids = self.ids.take(_ranges(self.ends[stay], sizes))
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.known = {words[i]: j for j, i in enumerate(stay.tolist())}
        self.used = self.used[stay]

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words end to end, number of ids of each); letters many at a time, which the library does faster."""
        letters = pc.match_substring_regex(pa.array(words, pa.string()), f"^{LETTERS}$").to_numpy(zero_copy_only=False) & (self.last is not None)
        plain, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        joined = [" ".join([words[i] for i in plain[a:a + JOINED].tolist()]) for a in range(0, len(plain), JOINED)]
        found = [np.array(e.ids, np.uint32) for e in self._batch(joined, self.plain)]
        sizes = np.zeros(len(words), np.int32)
        for a, ids in zip(range(0, len(plain), JOINED), found):
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(plain[a:a + JOINED]):
                raise ValueError("the tokenizer does not keep words apart")
            sizes[plain[a:a + JOINED]] = np.diff(ends, prepend=-1)
        asked = [e.ids for e in self._batch([words[i] for i in rest.tolist()], self.whole)]
        sizes[rest] = list(map(len, asked))
        found.append(np.fromiter(chain.from_iterable(asked), np.uint32))
        # Letters came first.
        order, starts = np.concatenate([plain, rest]), np.empty(len(words), np.int32)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found).take(_ranges(starts, sizes)), sizes

    def _places(self, words: list[str]) -> np.ndarray:
        """The places of words among those that are known; new ones are asked for."""
        if len(self.known) > WORDS_KEPT:
            self._forget()
        self.turn += 1
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            own = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(own))
            ids, sizes = self._ask(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
            at[missing] = list(map(self.known.__getitem__, own))
        self.used[at] = self.turn
        return at

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, laid end to end, number of ids of each), every text followed by ``end`` if that is given."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary
        # A unit of letters and marks is two words, any other is one.
        body = pc.ascii_rtrim(units, characters=MARKS)
        cut = pc.match_substring_regex(body, f"^{LETTERS}$")
        marked = pc.and_(cut, pc.not_equal(pc.binary_length(body), pc.binary_length(units)))
        marks = pc.replace_substring_regex(units.filter(marked), f"^{LETTERS}", "").dictionary_encode()
        words = pa.concat_arrays([pc.if_else(cut, pc.utf8_lower(body), units), marks.dictionary])
        at = self._places(words.to_numpy(zero_copy_only=False).tolist())
        # The word after the last known one has no ids.
        words = np.full((len(units), 2), len(self.known), np.int32)
        words[:, 0] = at[:len(units)]
        words[marked.to_numpy(zero_copy_only=False), 1] = at[len(units):].take(marks.indices.to_numpy())
        sizes = np.append(np.diff(self.ends), np.int32(0)).take(words)
        flat = self.ids.take(_ranges(self.ends.take(words).ravel(), sizes.ravel()))
        own = sizes.sum(axis=1, dtype=np.int32)
        code = coded.indices.to_numpy()
        ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))
        if end is not None:   # as one more unit
            flat, own, code = np.append(flat, np.uint32(end)), np.append(own, np.int32(1)), np.insert(code, ends, len(own))
            ends += np.arange(1, len(ends) + 1, dtype=ends.dtype)
        many = own.take(code)
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)]).take(np.concatenate([[0], ends]))
        return flat.take(_ranges((np.cumsum(own, dtype=np.int32) - own).take(code), many)), np.diff(ends)


def _tokens(text: str) -> Tokens:
    state = worker_state("tokenbin")
    key = ("tokens", hash(text))
    if key not in state:
        state[key] = Tokens(text)
    return state[key]


# ---- Files ----------------------------------------------------------------

RECORDS = "part int, record bigint, first bigint, doc_ids array<{kind}>, sizes array<bigint>, blocks binary"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids, in ascending order of doc_id, as files below ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = pick(docs, doc_id=id_col, text=text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value)
        part, first, number = None, 0, 0
        records: list[tuple[list, list[int], np.ndarray]] = []
        own_ids: list = []
        own: list[np.ndarray] = []

        def close() -> None:
            if own:
                records.append((list(own_ids), [len(x) for x in own], np.concatenate(own)))
                own_ids.clear()
                own.clear()

        def flush() -> pa.RecordBatch:
            nonlocal first, number
            blocks = [x[a:a + BLOCK] for _, _, x in records for a in range(0, len(x), BLOCK)]
            most = max(int(b.max()) for b in blocks)
            packed = iter(encode_blocks(blocks, max(16, most.bit_length())))
            cols: list[list] = [[], [], [], [], []]
            for ids, sizes, x in records:
                data = b"".join(next(packed) for _ in range(0, len(x), BLOCK))
                for c, v in zip(cols, (number, first, ids, sizes, data)):
                    c.append(v)
                number += 1
                first += len(x)
            records.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(id_type)), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                names=["part", "record", "first", "doc_ids", "sizes", "blocks"])

        held = size = 0
        for batch in batches:
            if batch.num_rows:
                part, id_type = batch.column(0)[0].as_py(), batch.schema.field(1).type
            ids, texts = batch.column(1).to_pylist(), batch.column(2).fill_null("")
            lengths = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(lengths // TEXT_BYTES, prepend=0)).tolist()
            for a, b in pairwise([0, *(c for c in cuts if c), *([batch.num_rows] if batch.num_rows else [])]):
                flat, sizes = tokens.encode(texts.slice(a, b - a), end_id)
                ends = np.cumsum(sizes)
                for doc, x, y in zip(ids[a:b], ends - sizes, ends):
                    own_ids.append(doc)
                    own.append(flat[x:y])
                    size += int(y - x)
                    if size >= RECORD_IDS:
                        held += -(-size // BLOCK)
                        size = 0
                        close()
                        if held >= SIDE_BY_SIDE:
                            yield flush()
                            held = 0
        close()
        if records:
            yield flush()

    ordered.mapInArrow(run, RECORDS.format(kind=kind)).write.parquet(path)


def _placed(spark, path: str) -> DataFrame:
    """The records of the files, with the number of ids before each."""
    files = spark.read.parquet(path)
    parts = files.select("part", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each file part: a running sum over them is small whatever the files hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(bases, "part").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "sizes", "blocks")


def _records(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """(doc_ids, start, where each document's ids end, ids) of every record, many blocks decoded at once."""
    blocks = [split_blocks(x.as_py()) for x in batch.column(3)]
    many = sum(map(len, blocks))
    at_once = -(-many // -(-many // SIDE_BY_SIDE)) if many else 0   # groups of like size
    a = 0
    while a < batch.num_rows:
        found, owner = [], []
        b = a
        while b < batch.num_rows and len(found) < at_once:
            found += blocks[b]
            owner.append(len(blocks[b]))
            b += 1
        ids: list = [None] * len(found)
        for bits in {x[0] for x in found}:
            at = [i for i, x in enumerate(found) if x[0] == bits]
            for i, x in zip(at, decode_blocks([found[i] for i in at])):
                ids[i] = x
        done = 0
        for r, n in zip(range(a, b), owner):
            flat = np.concatenate(ids[done:done + n])
            done += n
            ends = np.concatenate([[0], np.cumsum(batch.column(2)[r].values.to_numpy())])
            if ends[-1] != len(flat):
                raise ValueError("a record's documents and blocks differ in length")
            yield batch.column(1)[r].values, batch.column(0)[r].as_py(), ends, flat
        a = b


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start counts the ids of all documents before."""
    placed = _placed(spark, path)
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, start, ends, flat in _records(batch):
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(start + ends[:-1], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)))],
                    names=["doc_id", "start", "ids"])

    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, ids array<bigint>")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: what ``read`` gives, ids
    as the crc32 of them as little-endian 32-bit integers."""
    placed = _placed(spark, path)
    kind = placed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, start, ends, flat in _records(batch):
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(start + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def written(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the files below the shared folder; their path."""
    path = scratch(docs.sparkSession, "token-ids")
    write(docs, tokenizer_path, end_id, path, id_col, text_col)
    return path
