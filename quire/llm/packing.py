"""Packing of tokenized documents into sequences by the sum-of-squares rule.

Each document is cut into full sequences and a rest. A rest goes online to the fill level for which the sum of the squared
numbers of partly filled windows grows least; these numbers stand in one array by level. At the end of a partition the windows
that are still open fill each other up, cut where needed, and what remains is split at powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .tokens import _UNSURE, Splitter, byte_alphabet, compiled, specification

CAPACITY = 2048
END_ID = 1
ROWS_OUT = 4096

# The pretoken pattern of this kind of tokenizer, written so that nothing is tried twice.
_POSSESSIVE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class Encoder(Splitter):
    """Token ids of a text as little-endian unsigned 32-bit numbers, as the library gives them for the tokenizer file.

    Where the file numbers its merged tokens in the order of its merges, a second engine that works by rank gives the same ids in
    a fraction of the time. Texts with characters that the engines may class differently go to the library itself.
    """

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        model, to_byte = json.loads(spec)["model"], byte_alphabet()
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = all(vocabulary[t] == 256 + i for i, t in enumerate(merged)) and len(vocabulary) == 256 + len(merged)
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("of the file", pat_str=_POSSESSIVE, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, text: str) -> bytes:
        if self.fast is None or _UNSURE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, specials = self.parts(text)
        out = []
        for i, p in enumerate(parts):
            out.append(self.fast.encode_to_numpy(p, disallowed_special=()).astype("<u4", copy=False).tobytes())
            if i < len(specials):
                out.append(np.array([self.library.token_to_id(specials[i])], "<u4").tobytes())
        return b"".join(out)


class Packer:
    """Online sum-of-squares packing; a piece is (document fields, start, ids)."""

    def __init__(self, capacity: int = CAPACITY, first_id: int = 0) -> None:
        self.capacity, self.next = capacity, first_id
        self.levels = np.zeros(capacity + 1, np.int64)  # partly filled windows by fill
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _closed(self, pieces: list) -> Iterator[tuple]:
        seq, at = self._new(), 0
        for doc, start, ids in pieces:
            yield doc[0], start, len(ids) // 4, zlib.crc32(ids), doc[1], seq, at
            at += len(ids) // 4

    def add(self, doc: tuple[int | None, int], ids: bytes) -> Iterator[tuple]:
        """The pieces that are settled once the document (id, tokens) is in."""
        full, c = len(ids) // 4 // self.capacity, self.capacity
        for i in range(full):
            yield from self._closed([(doc, i * c, ids[4 * i * c : 4 * (i + 1) * c])])
        if rest := ids[4 * full * c :]:
            yield from self._place((doc, full * c, rest))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        n, c = self.levels, self.capacity
        size = len(piece[2]) // 4
        growth = 2 * (n[1 + size :] - n[1 : c - size + 1]) + 2
        if len(growth):
            growth[-1] -= 1 + 2 * n[c]  # a full window leaves the sum
            growth[n[1 : c - size + 1] == 0] = 1 << 60
            level = c - size - int(np.argmin(growth[::-1]))  # ties: the fullest
        if not len(growth) or growth[level - 1] >= 2 * n[size] + 1:
            level, window = 0, []
        else:
            window = self.open[level].pop()
            n[level] -= 1
        window.append(piece)
        if level + size == c:
            yield from self._closed(window)
        else:
            n[level + size] += 1
            self.open[level + size].append(window)

    def finish(self) -> Iterator[tuple]:
        """The windows that are still open: the emptiest fill up the fullest, then the last is split at powers of two."""
        left = [w for level in reversed(self.open) for w in level]
        fill = [sum(len(p[2]) for p in w) // 4 for w in left]
        i, j = 0, len(left) - 1
        while i < j:
            doc, start, ids = left[j].pop()
            room = self.capacity - fill[i]
            if len(ids) // 4 > room:
                left[j].append((doc, start + room, ids[4 * room :]))
                ids = ids[: 4 * room]
            left[i].append((doc, start, ids))
            fill[i] += len(ids) // 4
            fill[j] -= len(ids) // 4
            if fill[i] == self.capacity:
                yield from self._closed(left[i])
                i += 1
            if not fill[j]:
                j -= 1
        if i == j and left:
            pieces, total = left[i][::-1], fill[i]
            while total:
                part, room = [], 1 << (total.bit_length() - 1)
                total -= room
                while room:
                    doc, start, ids = pieces.pop()
                    if len(ids) // 4 > room:
                        pieces.append((doc, start + room, ids[4 * room :]))
                        ids = ids[: 4 * room]
                    part.append((doc, start, ids))
                    room -= len(ids) // 4
                yield from self._closed(part)


def packed(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null text counts as empty: the end id alone. Repeated rows and null ids are packed like any other; an empty table gives no
    rows; other columns are not read. Every partition packs what it holds, so nothing is shuffled; a sequence's id holds the
    partition in its upper half and reruns agree. A partition's last window is cut into sequences of a power of two.
    """
    spark = docs.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(specification(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = compiled(Encoder, spec.value)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = encoder.encode(t or "") + end
                    yield from packer.add((doc_id, len(ids) // 4), ids)
            yield from packer.finish()

        held = []
        for p in pieces():
            held.append(p)
            if len(held) == ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
