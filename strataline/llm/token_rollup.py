"""Token counts as rollups that deltas maintain.

A rollup holds documents and tokens by source, language and tokenizer version as
the sum of committed batches. A batch is a table of events: ``insert`` adds a
document and its tokens, ``delete`` takes a document with its tokens away, and
``revise`` replaces ``old_tokens`` by ``n_tokens``. Each batch is summed by key first
(partly before its shuffle, so a hot source costs a row per task), written beside
the rollup, then moved into place by one rename: a batch is there as a whole or
not at all. A batch id that is already there is skipped, so a job may repeat its
commits after a failure. One job at a time may commit to a rollup.

Defined results: null keys are a group of their own; a null count is 0; an unknown
op fails the batch; repeated events count each time; an empty batch commits and changes nothing; a
batch folder without ``_SUCCESS`` (a move that broke off) is replaced by the next commit of its
id; groups whose documents and tokens are both 0 aren't listed; other columns of events are ignored.
A text is counted whole in one task, with some 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import text_hash as H
from .storage import new_folder
from .word_ids import WordEncoder

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(events: DataFrame) -> DataFrame:
    """Events (op, source, lang, tokenizer, n_tokens, old_tokens) as additive changes."""
    new, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)), F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
    return events.select(
        *(F.col(k).cast("string").alias(k) for k in KEYS),
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown).cast("long").alias("n_docs"),
        F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(unknown).cast("long").alias("n_tokens"),
    )


class Rollup:
    """In the folder ``path``: ``batches/<batch id>`` has the summed changes of each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._jpath(f"{self.path}/batches/{batch_id}/_SUCCESS"))

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Whether the batch was new."""
        if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        if self.committed(batch_id):
            return False
        target = self._jpath(f"{self.path}/batches/{batch_id}")
        if self._fs.exists(target):  # left by a move that broke off: nothing counts it, so it goes
            self._fs.delete(target, True)
        aside = new_folder(self.spark, "rollup-batch")
        changes = signed(events).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        changes.where("n_docs != 0 or n_tokens != 0").write.parquet(aside)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._jpath(aside), target):
            raise RuntimeError(f"batch {batch_id} could not be moved into place")
        return True

    def totals(self) -> DataFrame:
        root = self._jpath(f"{self.path}/batches")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        paths = [f"{self.path}/batches/{n}" for n in sorted(names) if self.committed(n)]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")


def count_tokens(docs: DataFrame, encoder: WordEncoder, *, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with each text's number of ids and ``text_key``, a
    128-bit digest of the text (null: as the empty text). Columns of these names are replaced."""
    docs = docs.drop(*{into, "text_key"} - {text_col})
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, text_col)):
            _, counts = encoder.flat(batch.column(text_col))
            texts = H.texts_of(batch.column(text_col))
            data, ends = memoryview(texts.data), texts.offsets.tolist()
            keys = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts.astype(np.int64)), pa.array(keys, pa.binary())], [*rest, into, "text_key"])

    schema = T.StructType([*(f for f in docs.schema if f.name != text_col), T.StructField(into, T.LongType()), T.StructField("text_key", T.BinaryType())])
    return docs.mapInArrow(run, schema)
