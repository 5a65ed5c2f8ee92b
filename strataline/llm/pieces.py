"""SentencePiece encoding and decoding through a table of distinct marked chunks.

Where no piece of the vocabulary has the white-space marker after another
character and the normalizer is the identity with a dummy prefix, no merge
crosses the point before a run of markers. So a text's ids are those of its chunks (a
run of markers and what follows it).

1. Tasks count their distinct chunks; the counts are summed by chunk. The chunks that
   occur more than once, the frequent ones first by powers of two, as many as
   ``max_entries`` allow, make the table: each is segmented and decoded once, by the
   library, in parallel, and the table (at most ``max_entries`` rows of at most
   ``LONGEST_KEPT`` characters) is written and broadcast.
2. Tasks cut their texts again, take the distinct chunks of a slice of texts, look them
   up, segment those that the table doesn't have, and join ids and surfaces back
   by position as Arrow columns.

So a table chunk is segmented once for the whole corpus and any other once in a
slice; the bound changes how much is segmented again, never the result. Nothing but
chunks and their counts is shuffled.

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows give equal rows; other columns are ignored by
:func:`encode_decode`, whatever their names; an empty table gives an empty result; a very long text
is a slice of its own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import text_hash as H
from .storage import Steps

MARK = "▁"
LONGEST_KEPT = 48
MAX_ENTRIES = 200_000
SLICE_BYTES = 4 << 20
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_models: dict[str, "Segmenter"] = {}
_known: dict[str, dict[str, tuple[bytes, int, bytes]]] = {}


class Segmenter:
    """The library's model, once it is known that its pieces don't cross white space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.mark_id = self.model.piece_to_id(MARK)
        crossing = [p for p in map(self.model.id_to_piece, range(size)) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing or self.mark_id == self.model.unk_id():
            raise ValueError(f"pieces of this model cross white space: {crossing[:3]}")
        probe = "  ﬁ é́ \t①  "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("this model changes texts before it segments them")

    def entries(self, chunks: list[str]) -> list[tuple[bytes, int, bytes]]:
        """Of chunks without their first marker: ids as decimals with a comma after each, their number, and
        the decoded chunk with a blank after it."""
        ids = self.model.encode(chunks, num_threads=1) if chunks else []
        ids = [x if c else [self.mark_id] for c, x in zip(chunks, ids)]
        return [(("%d," * len(x) % tuple(x)).encode(), len(x), t.encode() + b" ") for x, t in zip(ids, self.model.decode(ids, num_threads=1) if ids else [])]


def segmenter(path: str) -> Segmenter:
    if path not in _models:
        _models[path] = Segmenter(path)
    return _models[path]


def chunks_of(text: str) -> list[str]:
    """The chunks of the text with its dummy prefix, each without its first marker."""
    return [x[1:].replace(MARK, " ") for x in _CHUNK.findall(" " + text)] if text else []


def _cut(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(rows, chunks one text after the other, end of each row's chunks). Texts whose chunks are what
    stands between single blanks are cut by Arrow."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    odd = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  "))
    odd = pc.or_(pc.or_(odd, pc.starts_with(texts, " ")), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")))
    odd = odd.to_numpy(zero_copy_only=False)
    if not odd.all():
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        yield np.flatnonzero(~odd), pc.list_flatten(lists), np.cumsum(pc.list_value_length(lists).to_numpy())
    if odd.any():
        lists = [chunks_of(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        yield np.flatnonzero(odd), pa.array([c for x in lists for c in x], pa.large_string()), np.cumsum([len(x) for x in lists])


def _glued(values: list[bytes], at: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values at these places one after the other, and the end of each."""
    out = pa.array(values, pa.large_binary()).take(at)
    if not len(out):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = out.buffers()
    ends = np.frombuffer(offsets, np.int64)[out.offset : out.offset + len(out) + 1]
    return memoryview(data if data is not None else b""), ends


def chunk_table(docs: DataFrame, path: str, text_col: str, max_entries: int, steps: Steps) -> DataFrame:
    """(chunk, ids, n, surface) of the chunks that occur most, each segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            out = pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")])
            return pa.table({"chunk": out.column("chunk").cast(pa.string()), "n": out.column("n_sum")})

        for batch in (s for b in batches for s in H.slices(b, "t", SLICE_BYTES)):
            for _, flat, _ in _cut(batch.column(0)):
                found = flat.filter(pc.less_equal(pc.utf8_length(flat), LONGEST_KEPT)).value_counts()
                held.append(pa.table({"chunk": found.field(0).cast(pa.string()), "n": found.field(1)}))
            if sum(t.num_rows for t in held) > 4 * max_entries + 1000:
                held = [merged()]
                if held[0].num_rows > max_entries:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    counted = steps.table(counted, "chunks")
    level = F.floor(F.log2("n")).cast("int")
    least, room = None, max_entries
    for r in sorted(counted.groupBy(level.alias("k")).count().collect(), key=lambda r: -r["k"]):  # at most 63 rows
        if r["count"] > room:
            break
        least, room = r["k"], room - r["count"]
    chosen = counted.where(level >= least) if least is not None else counted.where("false")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = segmenter(path)
        for batch in batches:
            entries = library.entries(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([e[k] for e in entries], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary())))], ["chunk", "ids", "n", "surface"])

    table = steps.table(chosen.select("chunk").mapInArrow(segment, "chunk string, ids binary, n long, surface binary"), "table")
    steps.drop(counted)
    return table


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_entries: int = MAX_ENTRIES, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids
    (array<int>) and decoded (string)."""
    spark = docs.sparkSession
    steps = Steps(spark, "pieces")
    table = chunk_table(docs, path, text_col, max_entries, steps)
    shared, name = spark.sparkContext.broadcast(table.toArrow()), uuid.uuid4().hex
    steps.drop(table)

    def entries(library: Segmenter, chunks: list[str]) -> list[tuple[bytes, int, bytes]]:
        if name not in _known:
            _known.clear()
            got = shared.value
            _known[name] = dict(zip(got.column("chunk").to_pylist(), zip(*(got.column(c).to_pylist() for c in ("ids", "n", "surface")))))
        known = _known[name]
        new = [c for c in chunks if c not in known]
        here = dict(zip(new, library.entries(new)))
        return [known[c] if c in known else here[c] for c in chunks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = segmenter(path)
        for batch in (s for b in batches for s in H.slices(b, "t", SLICE_BYTES)):
            rows: list = [None] * batch.num_rows
            for at, flat, ends in _cut(batch.column(1)):
                distinct = flat.dictionary_encode()
                ids, n, surface = zip(*entries(library, distinct.dictionary.to_pylist())) if len(flat) else ((), (), ())
                place = distinct.indices
                (ids, id_ends), (surface, surface_ends) = _glued(list(ids), place), _glued(list(surface), place)
                n = np.concatenate(([0], np.cumsum(np.array(n, np.int64)[place.to_numpy()] if len(flat) else [])))
                for row, a, b in zip(at.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    own = ids[id_ends[a] : max(id_ends[a], id_ends[b] - 1)]
                    text = surface[surface_ends[a] : max(surface_ends[a], surface_ends[b] - 1)]
                    rows[row] = (int(n[b] - n[a]), hashlib.sha256(own).hexdigest(), hashlib.sha256(text).hexdigest(), [int(x) for x in bytes(own).split(b",") if x] if keep else None, str(text, "utf-8") if keep else None)
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out if keep else out.drop("ids", "decoded")
