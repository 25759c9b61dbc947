"""Byte-level BPE: encode whole texts to ids and decode ids to texts.

A pre-token's bytes form a doubly linked list of symbols. A priority queue
holds the merge rank of every adjacent pair (lowest rank first, leftmost on
ties). A popped entry whose pair has changed since it was queued is stale and
is skipped. Decoding concatenates the vocabulary strings of the ids.

The vocabulary is a ``tokenizers`` JSON file of the byte-level BPE kind; its
text (of fixed size, a few MB) is broadcast and parsed once per worker.

Defined cases: a null text is an empty text; an empty text has no ids and
decodes to an empty text; a null list of ids decodes to an empty text.
Repeated rows give repeated results. Other columns are left behind.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, worker_state

# The byte-level pre-token pattern that the vocabulary was made with.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of one generation of a worker's caches (two generations are held).
UNITS_KEPT, PIECES_KEPT = 100_000, 250_000
ROWS_OUT = 256


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class Recent:
    """A cache of bounded size: what two generations of ``size`` entries have seen."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def get(self, key: str) -> tuple[int, ...] | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value


class Vocabulary:
    """Parsed vocabulary with the encoder and decoder working on it."""

    def __init__(self, text: str, caches: tuple[int, int] | None = None):
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        shown = byte_alphabet()
        self.byte_id = [vocab[shown[b]] for b in range(256)]
        # (left id, right id) -> (rank, merged id); later repeats of a pair win, as in a map built in file order
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
                                 if self.special else r"(?!)()")
        self.pre = regex.compile(PRE_TOKEN)
        # A unit (blanks, then what is not blank) never shares a pre-token with the next unit.
        self.units = re.compile(r"\s*\S+|\s+")
        self.odd = regex.compile("[\x1c-\x1f\x85᠎​﻿]")
        by_char = {c: b for b, c in shown.items()}
        strings = vocab | self.special
        self.bytes_of = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            known = all(c in by_char for c in s)
            self.bytes_of[i] = bytes(by_char[c] for c in s) if known else s.encode("utf-8")
        self.strings = pa.array(self.bytes_of, pa.binary())
        self.known_units, self.known_pieces = map(Recent, caches or (UNITS_KEPT, PIECES_KEPT))

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        byte_id, merge = self.byte_id, self.merge
        sym = [byte_id[b] for b in data]
        n = len(sym)
        if n == 1:
            return sym
        queue = []
        for i in range(n - 1):
            m = merge.get((sym[i], sym[i + 1]))
            if m is not None:
                queue.append((m[0], i, m[1], sym[i], sym[i + 1]))
        if not queue:
            return sym
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, made, left, right = pop(queue)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # stale: one of the two was merged meanwhile
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merge.get((made, sym[k]))
                if m is not None:
                    push(queue, (m[0], i, m[1], made, sym[k]))
            h = before[i]
            if h >= 0:
                m = merge.get((sym[h], made))
                if m is not None:
                    push(queue, (m[0], h, m[1], sym[h], made))
        return [s for s in sym if s >= 0]

    def unit(self, unit: str) -> tuple[int, ...]:
        ids = self.known_units.get(unit)
        if ids is None:
            out: list[int] = []
            for piece in self.pre.findall(unit):
                part = self.known_pieces.get(piece)
                if part is None:
                    part = tuple(self.merged(piece.encode("utf-8")))
                    if len(piece) <= 64:
                        self.known_pieces.put(piece, part)
                out += part
            ids = tuple(out)
            if len(unit) <= 64:
                self.known_units.put(unit, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part:
                continue
            # Blanks that regex engines disagree on: no units, the pattern sees the whole part.
            units = [part] if self.odd.search(part) else self.units.findall(part)
            seen = self.known_units.young
            for u in units:
                ids = seen.get(u)
                if ids is None:
                    ids = self.unit(u)
                    seen = self.known_units.young
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, lists: pa.ListArray) -> pa.StringArray:
        """The same for many lists: the strings of all ids, laid end to end, cut where the lists end."""
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        strings = self.strings.take(lists.flatten())
        ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
        cuts = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(lengths)])])
        texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts), strings.buffers()[2]])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # some ids are no whole characters
            return pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.string())


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _vocabulary(text: str, caches: tuple[int, int] | None = None) -> Vocabulary:
    state = worker_state("bpe")
    key = ("bpe", hash(text), caches)
    if key not in state:
        state[key] = Vocabulary(text, caches)
    return state[key]


def _id_arrays(lists: list[list[int]]) -> pa.Array:
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    flat = pa.array(list(chain.from_iterable(lists)), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary_text(vocab_path))
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocab.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                lists = [v.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _id_arrays(lists)], names=["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(coded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded): the text that the ids stand for, special tokens included."""
    spark = coded.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary_text(vocab_path))
    rows = pick(coded, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocab.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, v.decode_all(batch.column(1))], names=["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
               caches: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, ids, decoded): every whole text encoded, and its ids decoded, in one pass over the table.

    ``caches`` are sizes in place of (UNITS_KEPT, PIECES_KEPT).
    """
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocab_path))
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocab.value, caches)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = _id_arrays([v.encode(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, v.decode_all(ids)], names=["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
