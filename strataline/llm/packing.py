"""Packing of token sequences with bounded space, online.

Each partition reads its documents once and keeps ``windows`` open windows of
``length`` ids. A document's full windows leave at once; its rest goes into the
open window with the least room that still takes it (best fit). When none takes
it and all windows are in use, the fullest one is filled up with the head of the
rest and leaves. What is open at the end of a partition is merged in rounds: the
open windows of ``fan_in`` partitions, at most fan_in * windows * length ids, are
packed by the same rule, until one group is left. Its last windows are joined and
cut into full windows and powers of two, so no sequence needs padding.

Defined results: a null text counts as empty; a document without ids has no piece
(with an end id every document has one); repeated rows are separate documents; an
empty table gives an empty result; other columns are ignored; a very long text is encoded
whole in one task, with some 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import text_hash as H
from .storage import staged

LENGTH = 4096
WINDOWS = 16
FAN_IN = 32

_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("owner", pa.int64()), ("ids", pa.binary())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, owner long, ids binary"

Piece = tuple[int, int, bytes, int]  # doc_id, start, ids, ids of the document


class Packer:
    """Windows that left are in ``done``, as lists of pieces."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.windows = length, windows
        self.open: list[list] = []  # [ids used, pieces]
        self.done: list[list[Piece]] = []

    def add(self, doc_id: int, start: int, ids: bytes, total: int) -> None:
        full = self.length * 4
        whole = len(ids) // full * full
        for at in range(0, whole, full):
            self.done.append([(doc_id, start + at // 4, ids[at : at + full], total)])
        start, ids = start + whole // 4, ids[whole:] if whole else ids
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if self.length - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            take = min(n, self.length - best[0])
            best[0] += take
            best[1].append((doc_id, start, ids[: 4 * take], total))
            start, ids = start + take, ids[4 * take :]
            if best[0] == self.length:
                self.open = [w for w in self.open if w is not best]
                self.done.append(best[1])

    def finish(self) -> None:
        """Join what is open and cut it into full windows and powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(len(p[2]) for p in rest) // 4
        self.open = []
        size = room = min(self.length, 1 << left.bit_length() - 1) if left else 0
        pieces: list[Piece] = []
        for doc_id, start, ids, total in rest:
            while ids:
                take = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * take], total))
                start, ids, room = start + take, ids[4 * take :], room - take
                if not room:
                    self.done.append(pieces)
                    left -= size
                    pieces = []
                    size = room = min(self.length, 1 << left.bit_length() - 1) if left else 0


class _Rows:
    """Collects output rows; sequence ids are base, base + 1, ..."""

    def __init__(self, base: int, owner: int):
        self.next, self.owner = base, owner
        self.columns: list[list] = [[] for _ in _FIELDS]

    def sequence(self, pieces: list[Piece], keep_ids: bool) -> None:
        offset, size = 0, sum(len(p[2]) for p in pieces) // 4
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for column, value in zip(self.columns, (doc_id, start, n, zlib.crc32(ids), total, self.next, offset, size, self.owner, ids if keep_ids else None)):
                column.append(value)
            offset += n
        self.next += 1

    def __len__(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _FIELDS)], schema=_FIELDS)
        self.columns = [[] for _ in _FIELDS]
        return out


def _drain(packer: Packer, rows: _Rows) -> None:
    for pieces in packer.done:
        rows.sequence(pieces, False)
    packer.done = []


def pack(docs: DataFrame, encode: Callable[[pa.Array], list[bytes]], *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length. ``encode`` gives each text of a column its ids as
    little-endian unsigned 32-bit integers."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, rows = Packer(length, windows), _Rows(part << 28, part)
        for batch in (s for b in batches for s in H.slices(b, "t")):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                packer.add(doc_id, 0, ids, len(ids) // 4)
            _drain(packer, rows)
            if len(rows) > 4096:
                yield rows.batch()
        for _, pieces in packer.open:
            rows.sequence(pieces, True)
        yield rows.batch()

    def merge_round(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            group = table.column("group")[0].as_py()
            packer, rows = Packer(length, windows), _Rows((level << 56) + (group << 28), group)
            by = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")}
            order = sorted(range(table.num_rows), key=lambda i: (by["sequence_id"][i], by["offset"][i]))
            for i in sorted(order, key=lambda i: -len(by["ids"][i])):
                packer.add(by["doc_id"][i], by["start"][i], by["ids"][i], by["doc_tokens"][i])
            if last:
                packer.finish()
            _drain(packer, rows)
            for _, pieces in packer.open:
                rows.sequence(pieces, True)
            return pa.Table.from_batches([rows.batch()])

        return merge

    packed = staged(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(first, _DDL), "packing")
    parts = packed.where("ids is not null").agg(F.max("owner")).first()[0]
    result = packed.where("ids is null")
    level = 0
    while parts is not None:
        level += 1
        last = parts // fan_in == 0
        left = packed.where("ids is not null").withColumn("group", F.expr(f"owner div {fan_in}"))
        packed = staged(left.groupBy("group").applyInArrow(merge_round(level, last), _DDL), "packing")
        result = result.unionByName(packed.where("ids is null"))
        parts = None if last else parts // fan_in
    return result.drop("owner", "ids")
