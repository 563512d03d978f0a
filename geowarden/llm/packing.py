"""Bounded-space online packing of documents into token windows.

Every partition keeps a fixed number of open windows.  A document (what is left of it after whole
windows were cut off) goes where it fits best; if none has room, the fullest takes as much as
fits and is emitted, so no window is emitted with padding.  What is open at the end of a
partition is merged by groups of partitions: pieces are strung together and cut into whole
windows, and the last stretch of each group into powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bpe
from .common import body, durable, slices

LENGTH = 4096
OPEN = 16
#: Partitions whose open windows are merged together: at most GROUP * OPEN windows.
GROUP = 64
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in _SCHEMA.split(", ")]


class _Packer:
    def __init__(self, first: int, length: int, open_windows: int) -> None:
        self.next, self.length, self.most = first, length, open_windows
        self.open: list[list] = []  # [room, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.next, offset, None))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self._emit([(doc, at, ids[at : at + self.length], total)])
            at += self.length
        while at < total:
            need = total - at
            best = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := [self.length, []])
            if best is None:
                best = min(self.open, key=lambda w: w[0])
                need = best[0]
            best[1].append((doc, at, ids[at : at + need], total))
            best[0] -= need
            at += need
            if not best[0]:
                self._emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def close(self) -> None:
        """Rows of the windows that are still open; they keep their ids, for merging."""
        for _, pieces in self.open:
            offset = 0
            for doc, start, ids, total in pieces:
                self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.next, offset, ids.tobytes()))
                offset += len(ids)
            self.next += 1
        self.open = []

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], [*_FIELDS, "ids"])


def _merging(length: int):
    def merge(group: pa.Table) -> pa.Table:
        first = (1 << 62) | (group.column("group")[0].as_py() << 32)
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens")), strict=True), key=lambda r: r[:2])
        left = sum(len(r[4]) // 4 for r in rows)
        out, room, offset, sequence = [], 0, 0, first - 1
        for _, _, doc, start, raw, total in rows:
            at, ids = 0, np.frombuffer(raw, dtype=np.uint32)
            while at < len(ids):
                if not room:
                    room = length if left >= length else 1 << (left.bit_length() - 1)
                    left -= room
                    offset, sequence = 0, sequence + 1
                n = min(room, len(ids) - at)
                out.append((doc, start + at, n, zlib.crc32(ids[at : at + n]), total, sequence, offset))
                at, offset, room = at + n, offset + n, room - n
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=_FIELDS)

    return merge


def pack(docs: DataFrame, path: str, end: int = 2, length: int = LENGTH, open_windows: int = OPEN, text: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end``; a null or empty text is ``end`` alone.  Every id lies in
    exactly one piece, pieces of a sequence follow each other from offset 0, and a sequence is
    ``length`` ids long or a power of two.  Rows that repeat a doc_id are documents of their own,
    a null doc_id stays null, an empty table gives no rows, other columns are not looked at.
    Emitted and open windows come from one durable table, so a lost executor can't make the two
    disagree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        packer = _Packer(TaskContext.get().partitionId() << 32, length, open_windows)
        for batch in batches:
            for piece in slices(batch, 1):
                ids, offsets, _ = model.encode(piece.column(1).to_pylist())
                for doc, a, b in zip(piece.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    packer.add(doc, np.append(ids[a:b], np.uint32(end)))
                yield packer.take()
        packer.close()
        yield packer.take()

    pieces = durable(docs.select(F.col("doc_id").cast("long"), body(text)).mapInArrow(run, f"{_SCHEMA}, ids binary"))
    left = pieces.filter(F.col("ids").isNotNull()).withColumn("group", F.shiftright("sequence_id", 32) / F.lit(GROUP)).withColumn("group", F.col("group").cast("long"))
    merged = left.groupBy("group").applyInArrow(_merging(length), _SCHEMA)
    return pieces.filter(F.col("ids").isNull()).select(*_FIELDS).union(merged)
