"""Token ids in files: canonical length-limited Huffman codes from global counts.

The format is a folder with two tables:

* ``codebook``: one row; ``lengths`` holds the code length of each id, one byte each
  (0: the id doesn't occur). Codes are canonical: shorter first, then by id.
* ``ids``: one row per document, in folders ``block=k`` by ascending ranges of
  doc_id and ascending within each. ``payload`` is the document's bit stream, high
  bits first; ``checkpoints`` has the bit offset of every 256th id as little-endian
  unsigned 32-bit integers, so each run of 256 ids decodes by itself; ``start`` counts the
  ids of the documents before it in its block.

Both are Parquet, so writes commit as a whole and any store that Spark reaches
will do. Decoding looks ``MAX_BITS`` bits up in one table and runs in lockstep over
all runs of a batch.

Defined results: a null text counts as empty; null doc_ids come first; rows with
equal doc_ids are separate documents, ordered by payload; an empty table gives an
empty folder of ids; other columns are ignored; a text is encoded whole in one task, with some
40 bytes of memory for each of its bytes, and one whose codes need 512 MB or more raises ValueError.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import text_hash as H
from .storage import discard, new_folder
from .word_ids import WordEncoder

MAX_BITS = 20
RUN = 256  # ids between checkpoints
BLOCK_BOUNDS = 100_000  # most blocks that doc_ids are dealt into


def _merged_lengths(weights: np.ndarray, max_bits: int) -> np.ndarray:
    """Package-merge: lengths of the optimal code of at most ``max_bits`` for weights in ascending order. Each
    level holds the weights and the pairs of the level before; of the last level 2n - 2 entries are taken, and
    every package among them takes its two entries below."""
    n = len(weights)
    level, leaves = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, packages))
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(leaves):
        taken = int(is_leaf[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    return lengths


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code among those with no length over ``max_bits``: Huffman's algorithm;
    where that gives longer codes, package-merge."""
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if not len(present):
        return lengths
    if len(present) > 1 << max_bits:
        raise ValueError(f"{len(present)} ids don't fit codes of {max_bits} bits")
    if len(present) == 1:
        lengths[present] = 1
        return lengths
    heap = [(int(w), i) for i, w in enumerate(counts[present])]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(present) - 1, np.int64)
    for node in range(len(present), 2 * len(present) - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(len(parent), np.int64)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    depth = depth[: len(present)]
    if depth.max() > max_bits:
        order = np.argsort(counts[present], kind="stable")
        depth[order] = _merged_lengths(counts[present][order].astype(np.float64), max_bits)
    lengths[present] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order].astype(np.uint64)
        longest = np.uint64(sizes.max())
        steps = np.uint64(1) << (longest - sizes)
        codes[order] = (np.cumsum(steps) - steps) >> (longest - sizes)
    return codes


class Codec:
    """Encodes and decodes many documents at once with one code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.bits = int(self.lengths.max(initial=1))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(payload, checkpoints) of each document; ``counts``: ids of each."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        last = np.cumsum(counts)
        bits = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], last))])
        if len(bits) and bits.max() >= 1 << 32:
            raise ValueError("a document of 512 MB or more after coding doesn't fit 32-bit checkpoints")
        byte_base = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
        first_bit = np.concatenate(([0], ends))[last - counts]
        at = ends - sizes + np.repeat(byte_base[:-1] * 8 - first_bit, counts)
        raw = np.zeros(int(byte_base[-1]) // 8 + 2, np.uint64)
        if len(ids):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            left = self.codes[ids] << (64 - sizes).astype(np.uint64)
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            raw[word[firsts]] = np.bitwise_or.reduceat(left >> shift, firsts)
            over = np.flatnonzero(shift.astype(np.int64) + sizes > 64)
            raw[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
        stream = raw.astype(">u8").tobytes()
        marks = at - np.repeat(byte_base[:-1] * 8, counts)
        out = []
        for a, b, c, n in zip(byte_base[:-1].tolist(), byte_base[1:].tolist(), (last - counts).tolist(), counts.tolist()):
            out.append((stream[a:b], marks[c : c + n : RUN].astype("<u4").tobytes()))
        return out

    def _lookup(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            spans = np.int64(1) << (self.bits - self.lengths[order].astype(np.int64))
            ids = np.zeros(1 << self.bits, np.uint32)
            ids[: spans.sum()] = np.repeat(order, spans)
            self._table = ids, self.lengths[ids]
        return self._table

    def decode(self, payloads: list[bytes], checkpoints: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The ids of all documents."""
        symbols, sizes = self._lookup()
        bases = np.cumsum([0, *map(len, payloads)])
        raw = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8)
        runs = (counts + RUN - 1) // RUN
        owner = np.repeat(np.arange(len(counts)), runs)
        at = np.frombuffer(b"".join(checkpoints), "<u4").astype(np.int64) + bases[owner] * 8
        within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        left = np.minimum(counts[owner] - within * RUN, RUN)
        place = np.repeat(np.cumsum(counts) - counts, runs) + within * RUN
        out = np.zeros(int(counts.sum()), np.uint32)
        order = np.argsort(-left, kind="stable")
        at, left, place = at[order], left[order], place[order]
        n_alive = len(left) - np.searchsorted(left[::-1], np.arange(RUN), "right")
        words = np.ndarray((len(raw) - 7,), ">u8", raw.data, strides=(1,))
        keep = np.uint64(64 - self.bits)
        for k in range(RUN):
            n = int(n_alive[k])
            if not n:
                break
            bit = at[:n]
            window = words[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)
            code = (window >> keep).astype(np.int64)
            out[place[:n] + k] = symbols[code]
            at[:n] += sizes[code]
        return out


def _narrow(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write(docs: DataFrame, encoder: WordEncoder, path: str, *, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> None:
    """Encode every text and write the folder ``path``.

    Texts are tokenized once; plain ids and a count per id and task go to the
    shared folder. The driver gets the summed counts (``vocabulary`` rows at
    most). Only coded documents are shuffled, to their ranges of doc_id."""
    spark = docs.sparkSession
    kind = _narrow(vocabulary)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in (s for b in batches for s in H.slices(b, "t")):
            ids, counts = encoder.flat(batch.column(1))
            total += np.bincount(ids, minlength=vocabulary)
            raw, ends = ids.astype(kind).tobytes(), (np.cumsum(counts) * np.dtype(kind).itemsize).tolist()
            blobs = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            empty = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(blobs, pa.binary()), empty, empty], ["doc_id", "n_tokens", "ids", "id", "n"])
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(total[seen])], ["doc_id", "n_tokens", "ids", "id", "n"])

    plain_path = new_folder(spark, "plain_ids")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    source.mapInArrow(tokenize, "doc_id long, n_tokens long, ids binary, id long, n long").write.option("compression", "zstd").parquet(plain_path)
    plain = spark.read.schema("doc_id long, n_tokens long, ids binary, id long, n long").parquet(plain_path)

    counts = np.zeros(vocabulary, np.int64)
    for row in plain.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    rows = plain.where("ids is not null").select("doc_id", "n_tokens", "ids")
    n_blocks = max(1, min(BLOCK_BOUNDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [k / n_blocks for k in range(1, n_blocks)] or [0.5]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * n_blocks))).first()[0] or [], np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in (s for b in batches for s in H.slices(b, "ids")):
            sizes = batch.column(1).to_numpy()
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind)
            coded = codec.encode(ids, sizes)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            block = np.where(known, np.searchsorted(bounds, batch.column(0).fill_null(0).to_numpy()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in coded], pa.binary()), pa.array([x for _, x in coded], pa.binary()), pa.array(block, pa.int32())], ["doc_id", "n_tokens", "payload", "checkpoints", "block"])

    coded = rows.mapInArrow(code, "doc_id long, n_tokens long, payload binary, checkpoints binary, block int")
    # the same key for the window and the sort: one shuffle of coded documents
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "payload").rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    placed.write.partitionBy("block").parquet(f"{path}/ids")
    discard(spark, plain_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its decoded ids as little-endian unsigned 32-bit integers). The driver gets one sum per
    block, at most ``BLOCK_BOUNDS``."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0], np.uint8)
    rows = spark.read.schema("doc_id long, n_tokens long, payload binary, checkpoints binary, start long, block int").parquet(f"{path}/ids")
    before, total = {}, 0
    for r in sorted(rows.groupBy("block").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["block"]):
        before[r["block"]] = total
        total += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in (s for b in batches for s in H.slices(b, "payload", 1 << 20)):
            counts = batch.column("n_tokens").to_numpy()
            ids = codec.decode(batch.column("payload").to_pylist(), batch.column("checkpoints").to_pylist(), counts)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
            base = np.array([before[b] for b in batch.column("block").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("start").to_numpy() + base), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
