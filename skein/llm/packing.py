"""Bounded-space online packing of tokenised documents into sequences of at most ``capacity`` tokens.

Each partition tokenises its documents and cuts off whole sequences; the rest of a document goes best-fit into one of
``open_windows`` open windows. Where none fits, the fullest window is filled up with a cut piece and emitted, so sequences that
leave a partition hold no padding. The windows still open at a partition's end are merged: partitions meet in groups of ``GROUP``
and a group's leftovers are laid end to end; the last tokens of a group go into sequences whose lengths are powers of two,
which need no padding.

Defined cases: a null text counts as empty, a document of the closing id alone; repeated rows are packed each; very long texts
span many sequences; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import PreTokenizer, pieces, vocabulary

CAPACITY = 1024
OPEN = 16
GROUP = 64  # partitions whose leftovers, at most GROUP * OPEN windows of under CAPACITY tokens, meet in one task
END_ID = 0
CACHE = 50_000  # pre-tokens whose ids a worker remembers

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long"


class Tokenizer:
    """Ids of whole texts: each distinct pre-token of a batch is encoded once, ids are gathered."""

    def __init__(self, cutter: PreTokenizer, path: str):
        self.cutter, self.path, self.known = cutter, path, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        distinct, inverse, first = self.cutter.split(texts)
        if len(self.known) > CACHE:
            self.known.clear()
        new = [x for x in distinct if x not in self.known]
        for x, ids in zip(new, pieces(self.path, new), strict=True):
            self.known[x] = np.array(ids, np.uint32).tobytes()
        raw = [self.known[x] for x in distinct]
        sizes = np.array([len(x) for x in raw], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(raw), np.uint32), np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        n = sizes[inverse] if len(inverse) else inverse
        upto = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        at = np.arange(upto[-1]) - np.repeat(upto[:-1], n) + np.repeat(begin[inverse] if len(inverse) else inverse, n)
        ids = flat[at] if len(at) else np.zeros(0, np.uint32)
        cut = upto[first]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class Windows:
    """A fixed number of open windows, sorted by room left. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, piece: tuple) -> list[list[tuple]]:
        """Place a piece shorter than the capacity; the windows that this fills."""
        doc, start, ids, total = piece
        done = []
        while len(ids):
            at = bisect.bisect_left(self.room, (len(ids), -1))
            if at == len(self.room) and len(self.room) < self.most:
                room, key = self.capacity, self.made
                self.made += 1
                self.held[key] = []
            elif at == len(self.room):
                room, key = self.room.pop(0)  # none fits: the fullest takes what it can and goes
            else:
                room, key = self.room.pop(at)  # best fit
            some = ids[:room]
            self.held[key].append((doc, start, some, total))
            start, ids, room = start + len(some), ids[room:], room - len(some)
            if room:
                bisect.insort(self.room, (room, key))
            else:
                done.append(self.held.pop(key))
        return done

    def left(self) -> list[list[tuple]]:
        return [self.held[key] for _, key in self.room]


class _Out:
    def __init__(self, part: int):
        self.part, self.rows, self.next, self.size = part, [], part << 31, 0

    def add(self, window: list[tuple], leftover: bool = False) -> None:
        offset, sequence = 0, self.next
        self.next += 1
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), raw, total, None if leftover else sequence, offset, self.part))
            self.size += len(raw)
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in PIECE.split(", ")]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(kinds)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pack(shared, path: str, capacity: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, windows, out = Tokenizer(shared.value, path), Windows(capacity, open_windows), _Out(TaskContext.get().partitionId())
        for part in common.chunks(batches, size=1 << 20):
            ids_of = part.column("doc_id").to_pylist()
            for doc, ids in zip(ids_of, encode([x.decode() for x in common.encoded(part.column("text"))]), strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    out.add([(doc, start, ids[start : start + capacity], len(ids))])
                for window in windows.put((doc, whole, ids[whole:].copy(), len(ids))):
                    out.add(window)
                if out.size > 4 << 20:
                    yield out.batch()
        for window in windows.left():
            out.add(window, leftover=True)
        yield out.batch()

    return run


def _merge(capacity: int):
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids"]))
        total = sum(r["length"] for r in rows)
        sizes = [capacity] * (total // capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % capacity) >> b & 1]
        out, sequence, offset = [], (1 << 62) | (key[0].as_py() << 31), 0
        for r in rows:
            start, raw = r["start"], r["ids"]
            while raw:
                some = raw[: 4 * (sizes[0] - offset)]
                out.append(r | {"start": start, "length": len(some) // 4, "ids": some, "sequence_id": sequence, "offset": offset})
                start, offset, raw = start + len(some) // 4, offset + len(some) // 4, raw[len(some) :]
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence, offset = sequence + 1, 0
        return pa.Table.from_pylist(out, table.schema)

    return run


def packed(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The pieces are written once to the shared folder, as the full sequences and the leftovers are both read from them.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    _, special = vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(PreTokenizer(special))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = common.cut(rows.mapInArrow(common.tidy(_pack(shared, vocabulary_path, capacity, open_windows)), PIECE))
    left = made.filter("sequence_id is null").groupBy(F.floor(F.col("part") / GROUP).alias("g")).applyInArrow(_merge(capacity), PIECE)
    return made.filter("sequence_id is not null").unionByName(left).drop("part")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
