"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are windows of five words, lower-cased (a shorter text is one shingle). A shingle
weighs (1 + ln tf) * idf with idf = 1 + s * ln((N + 1) / df) / ln(N + 1): tf in the document,
df the documents that have it, N all documents, s the spread. Documents are near
duplicates if the weighted Jaccard similarity of their shingles is at least ``threshold``;
classes are the connected components, and a class is named by its smallest doc_id.
The spread is small on purpose: the shingles of a text with thousands of near copies
are frequent, those that a copy changed are unique, and a wide idf would push copies
that share over 0.8 of their shingles below the threshold because they are many.

1. Tasks hash the shingles of their texts by flushes of about a million and collapse equal
   texts. Each shingle of a flush goes once, with its count in the flush, to a bucket of the
   hash space, however many of its texts have it; a bucket adds up df and returns the
   shingles that more than one document has. Which text has which shingle travels with
   the flush, as small deltas of places in its ordered shingles.
2. Back at its texts, a text whose shared shingles weigh less than ``threshold`` of
   its total cannot have a partner and is done: no similarity can exceed that
   share. For the others, shingles of df 1 stand as one private element with their
   total weight (no other text can have them, so neither the similarity nor the
   sampling law changes), and ``bands * rows`` consistent weighted samples are drawn.
   Of equal texts one goes on if it agrees with another on a band, and the shares are
   taken again among those left.
3. Texts that agree on a band meet in a bucket. Links are tried against leaders:
   the text of each bucket that meets the most others in all its buckets (the
   original of a group of copies, as they differ less from it than from each
   other), then 4 and 16 of those left, only between texts whose components differ.
   So a large group of copies costs about a star, not its pairs. In buckets that
   still have several components after that, blocks of about 512 texts are compared with
   each other, a pair in its first common bucket only: no link between texts of a
   bucket is missed. That last step grows with the square of what is left of a bucket:
   texts that agree on four samples, share ``threshold`` of their weight with other texts and
   still are not linked to any of 21 leaders. Texts that share a long passage and little
   else fall out before by their private weights, which bound the similarity from above.
4. Every link is verified by the exact weighted Jaccard similarity.

A step's table is deleted when the next one stands, and its shuffle files when it is written, so
the disk holds the shuffle and the tables of one step and not those of the whole job.
Classes, links and samples stay in tables; the driver sees counts only.

Defined results: texts with equal words (an empty or null text has none) are one
class; rows that repeat a doc_id and its text count as one document, and an id with several
texts belongs to the class of each of them (:func:`classes` names the smallest,
:func:`deduplicate` decides text by text and keeps any one row of equal ids and texts); a
null doc_id gets a null class and is never compared; an empty table gives an empty
result; other columns are ignored, and ``bucket``, ``flush`` or the like among them
does no harm. A text is hashed whole in one task, with some 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import text_hash as H
from .storage import Steps, beside, staged

SHINGLE_WORDS = 5
THRESHOLD = 0.8
IDF_SPREAD = 0.1
BANDS, ROWS = 16, 4
LEADERS = (1, 4, 16)  # of a bucket, round by round
BLOCK = 512  # texts of a bucket that meet at once in the last round
FLUSH_SHINGLES = 1_000_000
BUCKETS_PER_PARTITION = 2  # of the hash space, so that a bucket of shingles is a few MB

# A row is either a flush's texts (``ids`` is set) or its shingles of one bucket.
_FLUSH = "ids binary, copies binary, keys binary, mass binary, blanks binary, sizes binary, steps binary, far binary, tf_at binary, tf binary, n int"
_SENT = f"bucket int, flush long, first int, low binary, high binary, many_at binary, many binary, {_FLUSH}"
_BACK = f"bucket int, flush long, first int, bits binary, low binary, high binary, df binary, df_far binary, {_FLUSH}"
_FLUSH_COLUMNS = [f.split()[0] for f in _FLUSH.split(", ")]
_LOW_BITS = np.uint64(40)  # of a hash, kept beside the number of its bucket
_LOW_MASK = np.uint64((1 << 40) - 1)
_FAR = 0xFFFF
_TEXT = "row long, node binary, doc_ids array<long>, total double, shared double, grams binary, weights binary, bands array<long>"


def _returning_memory(kernel: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The kernel, after which the worker gives its free memory back: workers live on between stages, and
    what they hold of an earlier one counts against their executor."""

    def run(table: pa.Table) -> pa.Table:
        out = kernel(table)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)
        return out

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _batch(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _lengths_to_starts(sizes: np.ndarray) -> np.ndarray:
    sizes = sizes.astype(np.int64)
    return np.cumsum(sizes) - sizes


def _keys(words: H.Words, hashes: np.ndarray) -> np.ndarray:
    """Two independent sums over the words of a text identify it: texts x 2."""
    n_words = np.diff(words.first)
    within = np.arange(len(hashes)) - np.repeat(words.first[:-1], n_words)
    keys = []
    for salt in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127):
        terms = np.concatenate((np.zeros(1, np.uint64), np.cumsum(H.mix(hashes ^ H.mix(within.astype(np.uint64) + np.uint64(salt))), dtype=np.uint64)))
        keys.append(H.mix(terms[words.first[1:]] - terms[words.first[:-1]] + n_words.astype(np.uint64)))
    return np.stack(keys, axis=1)


def _dealt(flush: int, n_buckets: int) -> int:
    """The bucket that a flush's own row goes by."""
    return int(H.mix(np.array([flush], np.uint64))[0] % np.uint64(n_buckets))


def _to_planes(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The low 40 bits of hashes as 32 and 8 bits."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (hashes >> np.uint64(32) & np.uint64(0xFF)).astype("u1").tobytes()


def _from_planes(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "u1").astype(np.uint64) << np.uint64(32)


def _to_steps(place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that rise within each text as 16-bit differences, and those that are too large."""
    step = np.diff(place, prepend=0)
    first = _lengths_to_starts(sizes)[sizes > 0]
    step[first] = place[first]
    far = step >= _FAR
    return np.where(far, _FAR, step).astype("<u2"), step[far].astype("<u4")


def _from_steps(steps: bytes, far: bytes, sizes: np.ndarray) -> np.ndarray:
    step = np.frombuffer(steps, "<u2").astype(np.int64)
    step[step == _FAR] = np.frombuffer(far, "<u4")
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(step)))
    return ends[1:] - np.repeat(ends[_lengths_to_starts(sizes)], sizes)


class _Flush:
    """Texts of one task until they are sent."""

    def __init__(self, shingle_words: int):
        self.k = shingle_words
        self.parts: list[tuple] = []
        self.shingles = 0

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        texts = H.lowered(H.texts_of(column))
        words = H.words_of(texts)
        hashes = H.Hasher(texts.data).ranges(words.start, words.end)
        n_words = np.diff(words.first)
        grams, at = H.grams(hashes, words.text, self.k)
        owner = words.text[at]
        keys = _keys(words, hashes)
        short = np.flatnonzero((n_words > 0) & (n_words < self.k))
        grams, owner = np.concatenate([grams, keys[short, 0]]), np.concatenate([owner, short])
        self.parts.append((ids, keys, n_words == 0, grams, owner))
        self.shingles += len(grams)

    def rows(self, flush: int, n_buckets: int) -> list[dict]:
        base = _lengths_to_starts(np.array([len(p[0]) for p in self.parts]))
        ids = np.concatenate([p[0] for p in self.parts])
        keys = np.concatenate([p[1] for p in self.parts])
        blank = np.concatenate([p[2] for p in self.parts])
        grams = np.concatenate([p[3] for p in self.parts])
        owner = np.concatenate([p[4] + b for p, b in zip(self.parts, base)])
        self.parts, self.shingles = [], 0
        # equal texts once
        distinct, first, which, copies = np.unique(keys.view("V16").ravel(), return_index=True, return_inverse=True, return_counts=True)
        of_first = np.full(len(ids), -1)
        of_first[first] = np.arange(len(first))
        mine = of_first[owner] >= 0
        grams, text = grams[mine], of_first[owner[mine]]
        # a hash is its bucket and its low bits from here on
        grams = ((grams >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)) << _LOW_BITS | grams & _LOW_MASK
        order = np.lexsort((grams, text))
        grams, text = grams[order], text[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        tf = np.diff(np.append(starts, len(grams)))
        grams, text = grams[starts], text[starts]
        mass = np.bincount(text, weights=1 + np.log(tf), minlength=len(distinct))
        sizes = np.bincount(text, minlength=len(distinct))
        shingles, place = np.unique(grams, return_inverse=True)
        count = np.bincount(place, weights=copies[text], minlength=len(shingles)).astype(np.int64)
        by_text, often = np.argsort(which, kind="stable"), np.flatnonzero(tf > 1)
        steps, far = _to_steps(place, sizes)
        out = [{
            "bucket": _dealt(flush, n_buckets), "flush": flush, "ids": ids[by_text].astype("<i8").tobytes(), "copies": copies.astype("<u4").tobytes(), "keys": keys[first].tobytes(),
            "mass": mass.tobytes(), "blanks": blank[first].tobytes(), "sizes": sizes.astype("<u4").tobytes(), "steps": steps.tobytes(), "far": far.tobytes(),
            "tf_at": often.astype("<u4").tobytes(), "tf": tf[often].astype("<u4").tobytes(), "n": len(shingles),
        }]
        cuts = np.searchsorted(shingles, np.arange(n_buckets + 1, dtype=np.uint64) << _LOW_BITS)
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            many = np.flatnonzero(count[s] > 1)
            low, high = _to_planes(shingles[s])
            out.append({
                "bucket": int(b), "flush": flush, "first": int(cuts[b]), "low": low, "high": high,
                "many_at": many.astype("<u4").tobytes(), "many": count[s][many].astype("<u4").tobytes(),
            })
        return out


def _send(n_buckets: int, shingle_words: int, flush_shingles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held = _Flush(shingle_words)

        def batches_out() -> Iterator[pa.RecordBatch]:
            rows = held.rows((part << 20) + n, n_buckets)
            for a in range(0, len(rows), 64):
                yield _batch(_SENT, rows[a : a + 64])

        for batch in (s for b in batches for s in H.slices(b, "t")):
            held.add(batch.column(0).to_numpy(), batch.column(1))
            if held.shingles >= flush_shingles:
                yield from batches_out()
                n += 1
        if held.parts:
            yield from batches_out()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: df of its shingles; returns the shared ones to their flushes."""
    rows = table.to_pylist()
    out = [{k: r[k] for k in ("flush", *_FLUSH_COLUMNS)} for r in rows if r["ids"] is not None]
    rows = [r for r in rows if r["ids"] is None]
    if rows:
        parts = [_from_planes(r["low"], r["high"]) for r in rows]
        ends = np.cumsum([len(p) for p in parts])
        count = np.ones(ends[-1])
        for r, end, own in zip(rows, ends, parts):
            count[end - len(own) + np.frombuffer(r["many_at"], "<u4").astype(np.int64)] = np.frombuffer(r["many"], "<u4")
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(which, weights=count)[which].astype(np.int64)
        for r, end, own in zip(rows, ends, parts):
            mine = df[end - len(own) : end]
            shared = mine > 1
            if shared.any():
                low, high = _to_planes(own[shared])
                near = np.minimum(mine[shared], 255)
                out.append({
                    "bucket": r["bucket"], "flush": r["flush"], "first": r["first"], "bits": np.packbits(shared).tobytes(), "low": low, "high": high,
                    "df": near.astype("u1").tobytes(), "df_far": mine[shared][near == 255].astype("<u8").tobytes(),
                })
    return pa.Table.from_batches([_batch(_BACK, out)])


def gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal shares, by Newton's method on 1 - (1 + x) e^-x."""
    q = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.maximum(np.sqrt(2 * q), -np.log1p(-q))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x


def samples(grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Improved consistent weighted samples (texts x n) of texts with ``sizes`` elements
    each, one after the other; two texts agree on a sample with the probability of
    their weighted Jaccard similarity. For an element of weight w: r, c ~ Gamma(2, 1), b ~
    U(0, 1), t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the element with the
    least a, with its t, is the sample."""
    starts = _lengths_to_starts(sizes)
    table, log_w = gamma_table(), np.log(weights)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), n), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for j in range(n):
        h = H.mix(grams + np.uint64((seed * 1_000_003 + j) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        g = H.mix(h + np.uint64(0xD1B54A32D192ED03))
        r = table[(g >> np.uint64(48)).astype(np.int64)]
        b = (g & low) * 2.0**-32
        c = -np.log(((h & low) + 0.5) * 2.0**-32) - np.log(((h >> np.uint64(32)) + 0.5) * 2.0**-32)
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.flatnonzero(a == np.minimum.reduceat(a, starts)[owner])
        first = least[np.searchsorted(owner[least], np.arange(len(sizes)))]
        out[:, j] = H.mix(grams[first] + H.mix(t[first].astype(np.int64).astype(np.uint64)))
    return out


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return 1 + IDF_SPREAD * np.log((n_docs + 1) / df) / np.log(n_docs + 1)


def _weigh(n_docs: int, threshold: float, bands: int, rows: int):
    """One flush: weights, the texts that can have a partner, and their bands."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        info = next(r for r in got if r["ids"] is not None)
        copies = np.frombuffer(info["copies"], "<u4").astype(np.int64)
        ids, keys = np.frombuffer(info["ids"], "<i8"), np.frombuffer(info["keys"], "V16")
        mass, blank = np.frombuffer(info["mass"]), np.frombuffer(info["blanks"], bool)
        gram_of, df_of = np.zeros(info["n"], np.uint64), np.ones(info["n"], np.int64)
        for r in got:
            if r["ids"] is None:
                at = r["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], "u1")))
                gram_of[at] = H.mix(np.uint64(r["bucket"]) << _LOW_BITS | _from_planes(r["low"], r["high"]))
                found = np.frombuffer(r["df"], "u1").astype(np.int64)
                found[found == 255] = np.frombuffer(r["df_far"], "<u8").astype(np.int64)
                df_of[at] = found
        sizes = np.frombuffer(info["sizes"], "<u4").astype(np.int64)
        place, text = _from_steps(info["steps"], info["far"], sizes), np.repeat(np.arange(len(sizes)), sizes)
        tf = np.ones(len(place), np.int64)
        tf[np.frombuffer(info["tf_at"], "<u4")] = np.frombuffer(info["tf"], "<u4")
        common = df_of[place] > 1
        place, text, tf = place[common], text[common], tf[common]
        grams, df = gram_of[place], df_of[place]
        times = 1 + np.log(tf)
        weights = times * idf(df, n_docs)
        shared = np.bincount(text, weights=weights, minlength=len(copies))
        private = np.maximum(mass - np.bincount(text, weights=times, minlength=len(copies)), 0) * idf(np.ones(1), n_docs)[0]
        private[private < 1e-9] = 0
        total = shared + private
        stays = (shared >= threshold * total - 1e-9) & ~blank
        keep = np.flatnonzero(stays | (copies > 1) | blank)
        out: list[dict] = []
        if len(keep):
            rank = np.full(len(copies), -1)
            rank[np.flatnonzero(stays)] = np.arange(stays.sum())
            alone = np.flatnonzero(stays & (private > 0))
            mine = rank[text] >= 0
            g = np.concatenate([grams[mine], H.mix(np.frombuffer(info["keys"], "<u8")[::2][alone] ^ np.uint64(0xA0761D6478BD642F))])
            w = np.concatenate([weights[mine], private[alone]])
            o = np.concatenate([rank[text[mine]], rank[alone]])
            order = np.lexsort((g, o))
            g, w, sizes = g[order], w[order], np.bincount(o, minlength=int(stays.sum()))
            banded = np.zeros((0, bands), np.uint64)
            if len(sizes):
                drawn = samples(g, w, sizes, bands * rows).reshape(len(sizes), bands, rows)
                banded = np.repeat(np.arange(bands, dtype=np.uint64)[None] + np.uint64(1), len(sizes), axis=0)
                for k in range(rows):
                    banded = H.mix(banded * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, k])
            ends, doc_ends = np.cumsum(sizes), np.cumsum(copies)
            for i in keep.tolist():
                row = {"row": (info["flush"] << 24) + i, "node": keys[i].tobytes(), "doc_ids": ids[doc_ends[i] - copies[i] : doc_ends[i]].tolist(), "total": float(total[i]), "shared": float(shared[i])}
                if stays[i]:
                    k = rank[i]
                    s = slice(ends[k] - sizes[k], ends[k])
                    row |= {"grams": g[s].tobytes(), "weights": w[s].astype("<f4").tobytes(), "bands": banded[k].view(np.int64).tolist()}
                out.append(row)
        return pa.Table.from_batches([_batch(_TEXT, out)])

    return run


def candidates(docs: DataFrame, steps: Steps, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, flush_shingles: int = FLUSH_SHINGLES) -> DataFrame:
    """The texts that can have a partner (and all equal texts): steps 1 and 2."""
    spark = docs.sparkSession
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    n_docs = max(source.count(), 1)
    n_buckets = BUCKETS_PER_PARTITION * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = source.mapInArrow(_send(n_buckets, shingle_words, flush_shingles), _SENT)
    back = steps.table(sent.groupBy("bucket").applyInArrow(_returning_memory(_count), _BACK), "shared")
    found = steps.table(back.groupBy("flush").applyInArrow(_returning_memory(_weigh(n_docs, threshold, bands, rows)), _TEXT), "texts")
    steps.drop(back)
    return found


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, "ga")):
            keep = []
            columns = [batch.column(c).to_pylist() for c in ("ga", "wa", "ta", "gb", "wb", "tb")]
            for k, (ga, wa, ta, gb, wb, tb) in enumerate(zip(*columns)):
                keep.append(weighted_jaccard(np.frombuffer(ga, "<u8"), np.frombuffer(wa, "<f4"), ta, np.frombuffer(gb, "<u8"), np.frombuffer(wb, "<f4"), tb) >= threshold - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def weighted_jaccard(ga: np.ndarray, wa: np.ndarray, ta: float, gb: np.ndarray, wb: np.ndarray, tb: float) -> float:
    """Of two texts with sorted elements and total weights."""
    if len(ga) > len(gb):
        ga, wa, gb, wb = gb, wb, ga, wa
    at = np.searchsorted(gb, ga).clip(max=len(gb) - 1)
    both = gb[at] == ga
    common = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return common / (ta + tb - common)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with ``linked``."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("grams").alias(f"g{name}"), F.col("weights").alias(f"w{name}"), F.col("total").alias(f"t{name}"))

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_similar(threshold), "a binary, b binary, linked boolean")


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the component is its smallest
    node. Each round takes the least label of the neighbours, then the label's own label."""
    steps = steps or Steps(links.sparkSession, "components")
    both = steps.table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = steps.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        side = beside(labels)
        near = both.join(side.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("nearest"))
        step = near.join(side, "node").select("node", F.col("component").alias("old"), F.least("component", "nearest").alias("component"))
        jump = side.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = steps.table(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        steps.drop(labels)
        labels = step
        if step.where("component != old").isEmpty():
            steps.drop(both)
            return labels.select("node", "component")


_SHARE = "flush long, rows binary, alive binary"
_PART = "bucket int, grams binary, weights binary, rows binary, sizes binary, many binary, alive binary"


def _scatter(n_buckets: int):
    """Shingles to their buckets. One that several texts of a slice have is known to be shared: it goes to its
    bucket once, without texts, and its weight is added up here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, "grams", 8 * H.SLICE_BYTES)):
            parts = [np.frombuffer(g, "<u8") for g in batch.column("grams").to_pylist()]
            grams = np.concatenate(parts)
            weights = np.frombuffer(b"".join(batch.column("weights").to_pylist()), "<f4")
            rows = np.repeat(batch.column("row").to_numpy(), [len(x) for x in parts])
            _, first, which, n = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
            several = n[which] > 1
            out = []
            if several.any():
                mine, owner = np.unique(rows[several], return_inverse=True)
                alive = np.bincount(owner, weights=weights[several].astype(np.float64))
                flush = mine >> 24
                cuts = [0, *(np.flatnonzero(np.diff(flush)) + 1), len(mine)]
                out += [{"bucket": _dealt(flush[a], n_buckets), "rows": mine[a:b].tobytes(), "alive": alive[a:b].tobytes()} for a, b in zip(cuts, cuts[1:])]
            many = np.sort(grams[first[n > 1]])
            grams, weights, rows = grams[~several], weights[~several], rows[~several]
            edges = np.arange(n_buckets + 1)
            place = lambda g: ((g >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            bucket = place(grams)
            order = np.argsort(bucket, kind="stable")
            cuts, many_cuts = np.searchsorted(bucket[order], edges), np.searchsorted(place(many), edges)
            for b in np.flatnonzero(np.diff(cuts) + np.diff(many_cuts)):
                at = order[cuts[b] : cuts[b + 1]]
                starts = np.flatnonzero(np.diff(rows[at], prepend=-1))
                out.append({
                    "bucket": int(b), "grams": grams[at].tobytes(), "weights": weights[at].tobytes(), "rows": rows[at][starts].tobytes(),
                    "sizes": np.diff(np.append(starts, len(at))).astype("<u4").tobytes(), "many": many[many_cuts[b] : many_cuts[b + 1]].tobytes(),
                })
            yield _batch(_PART, out)

    return run


def _alive(table: pa.Table) -> pa.Table:
    """One bucket: the weight of each text's shingles that another text has too, packed by flush."""
    parts = table.to_pylist()
    out = [{"flush": int(np.frombuffer(r["rows"], "<i8")[0]) >> 24, "rows": r["rows"], "alive": r["alive"]} for r in parts if r["alive"] is not None]
    parts = [r for r in parts if r["alive"] is None]
    if parts:
        grams = np.concatenate([np.frombuffer(r["grams"], "<u8") for r in parts])
        weights = np.concatenate([np.frombuffer(r["weights"], "<f4") for r in parts]).astype(np.float64)
        rows = np.concatenate([np.repeat(np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["sizes"], "<u4")) for r in parts])
        many = np.concatenate([np.frombuffer(r["many"], "<u8") for r in parts])
        _, which, n = np.unique(np.concatenate((grams, many)), return_inverse=True, return_counts=True)
        both = n[which[: len(grams)]] > 1
        distinct, owner = np.unique(rows[both], return_inverse=True)
        alive = np.bincount(owner, weights=weights[both], minlength=len(distinct))
        flush = distinct >> 24
        cuts = [0, *(np.flatnonzero(np.diff(flush)) + 1), len(distinct)]
        out += [{"flush": int(flush[a]), "rows": distinct[a:b].tobytes(), "alive": alive[a:b].tobytes()} for a, b in zip(cuts, cuts[1:]) if b > a]
    return pa.Table.from_batches([_batch(_SHARE, out)])


def _sum_alive(table: pa.Table) -> pa.Table:
    rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), "<i8")
    distinct, owner = np.unique(rows, return_inverse=True)
    return pa.table({"row": distinct, "alive": np.bincount(owner, weights=np.frombuffer(b"".join(table.column("alive").to_pylist())), minlength=len(distinct))})


def _shared_weights(texts: DataFrame) -> DataFrame:
    """(row, shared): the weight of a text's shingles that another of the ``texts``, all different, has."""
    n_buckets = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = texts.select("row", "grams", "weights").mapInArrow(_scatter(n_buckets), _PART).groupBy("bucket").applyInArrow(_returning_memory(_alive), _SHARE)
    return shares.groupBy("flush").applyInArrow(_sum_alive, "row long, alive double").withColumnRenamed("alive", "shared")


def _hopeful(members: DataFrame, threshold: float, steps: Steps) -> DataFrame:
    """Members of buckets with more than one component that can have a partner there: what a text
    shares is at least ``threshold`` of its own total and the least private weight in the bucket together."""
    for _ in range(2):
        private = F.col("total") - F.col("shared")
        stats = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(private).alias("least")).where("low != high").select("bucket", "least")
        stats = steps.table(stats, "stats")
        rest = steps.table(members.join(beside(stats), "bucket").where(F.col("shared") >= (F.col("total") + F.col("least")) * threshold - 1e-6).drop("least"), "buckets")
        steps.drop(stats, members)
        members = rest
    return members


def _compare(threshold: float):
    """Two blocks (or one) of a bucket: the links that join components, by exact similarity. A pair is
    looked at in the bucket of its first common band only."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, low, high = rows[0]["bucket"], rows[0]["i"], rows[0]["j"]
        bands = np.array([r["bands"] for r in rows], np.int64)
        total, shared = (np.array([r[c] for r in rows]) for c in ("total", "shared"))
        names: dict[bytes, int] = {}
        label = np.array([names.setdefault(r["component"], len(names)) for r in rows])
        block = np.array([r["block"] for r in rows])
        grams, weights = [np.frombuffer(r["grams"], "<u8") for r in rows], [np.frombuffer(r["weights"], "<f4") for r in rows]
        links: list[tuple[bytes, bytes]] = []
        for a in np.flatnonzero(block == low):
            others = np.arange(a + 1, len(rows)) if low == high else np.flatnonzero(block == high)
            most = np.minimum(shared[a], shared[others])
            others = others[(label[others] != label[a]) & (most >= (total[a] + total[others] - most) * threshold - 1e-6)]
            same = bands[others] == bands[a]
            others = others[bands[a][same.argmax(axis=1)] == bucket] if len(others) else others
            for b in others:
                if label[a] != label[b] and weighted_jaccard(grams[a], weights[a], total[a], grams[b], weights[b], total[b]) >= threshold - 1e-6:
                    links.append((rows[a]["node"], rows[b]["node"]))
                    label[label == label[b]] = label[a]
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return run


def _links_in_blocks(left: DataFrame, texts: DataFrame, threshold: float, steps: Steps) -> DataFrame:
    """(a, b) that join components of the buckets ``left``. A bucket is dealt by hash to blocks of about ``BLOCK`` texts and
    each two blocks are one group, so a group has a bounded number of texts however large its bucket is."""
    n = steps.table(left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    placed = left.select("bucket", "node", "component", "total", "shared").join(beside(n), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "total", "shared")
    full = spread.join(texts.select("node", "grams", "weights", "bands"), "node")
    out = steps.table(full.groupBy("bucket", "i", "j").applyInArrow(_returning_memory(_compare(threshold)), "a binary, b binary"), "links")
    steps.drop(n)
    return out


def _with_node(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """The rows with the node of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in H.slices(b, "t")):
            texts = H.lowered(H.texts_of(batch.column(batch.num_columns - 1)))
            words = H.words_of(texts)
            keys = _keys(words, H.Hasher(texts.data).ranges(words.start, words.end))
            node = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), node], names=["row", into])

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, rows.select("row", F.lit(b"").alias(into)).schema).select("row.*", into)


def _crowded(found: DataFrame, steps: Steps) -> DataFrame:
    """(bucket, node, row, total, company) of the different texts that agree on a band with another: ``company`` is
    how many they meet in all their buckets."""
    one = found.where("bands is not null").groupBy("node").agg(F.min(F.struct("row", "total", "bands")).alias("x"))
    spread = steps.table(one.select("node", "x.row", "x.total", F.explode("x.bands").alias("bucket")), "spread")
    n = spread.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low != high").select("bucket", "n")
    n = steps.table(n, "crowded")
    met = steps.table(spread.join(beside(n), "bucket"), "met")
    steps.drop(spread, n)
    company = steps.table(met.groupBy("node").agg(F.sum("n").alias("company")), "company")
    out = steps.table(met.drop("n").join(beside(company), "node"), "members")
    steps.drop(met, company)
    return out


def _leaders(left: DataFrame, leaders: int) -> DataFrame:
    """The first of each bucket. Tasks keep that many of a bucket before they send them, so a large one is no large task."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("company"), "node"))
    leading = left.withColumn("k", rank).where(F.col("k") <= leaders)
    return leading.select("bucket", *[F.col(c).alias(f"its_{c}") for c in ("node", "company", "component", "total", "shared")])


def _links(found: DataFrame, threshold: float, steps: Steps) -> DataFrame | None:
    """(node, component) of the different texts of ``found`` that have a partner."""
    members = _crowded(found, steps)
    rows = steps.table(members.select("row").distinct(), "rows")
    texts = steps.table(found.select("row", "node", "total", "grams", "weights", "bands").join(beside(rows), "row", "left_semi"), "distinct")
    shared = steps.table(_shared_weights(texts), "alive")
    left = members.join(beside(shared), "row").where(F.col("shared") >= F.col("total") * threshold - 1e-6).drop("row").withColumn("component", F.col("node"))
    left = _hopeful(steps.table(left, "buckets"), threshold, steps)
    steps.drop(rows, shared, members, found)
    tried = links = labels = None
    for leaders in LEADERS:
        if left.isEmpty():
            break
        leading = steps.table(_leaders(left, leaders), "leaders")
        most = F.least("shared", "its_shared")  # nothing above this can be common to both
        can = most >= (F.col("total") + F.col("its_total") - most) * threshold - 1e-6
        pairs = left.join(beside(leading), "bucket").where("(company < its_company or company = its_company and its_node < node) and component != its_component").where(can)
        pairs = pairs.select(F.least("its_node", "node").alias("a"), F.greatest("its_node", "node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = steps.table(pairs, "pairs")
        checked = steps.table(_verify(pairs, texts, threshold), "checked")
        steps.drop(pairs)
        tried = checked if tried is None else tried.unionByName(checked)
        new = checked.where("linked").select("a", "b")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links, steps)
        # the leaders were compared with all; buckets of one component are done
        rest = left.drop("component").join(beside(steps.table(leading.select("bucket", F.col("its_node").alias("node")), "led")), ["bucket", "node"], "left_anti")
        if labels is not None:
            rest = rest.join(beside(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            rest = rest.withColumn("component", F.col("node"))
        rest = steps.table(rest, "buckets")
        steps.drop(left, leading)
        left = _hopeful(rest, threshold, steps)
    if not left.isEmpty():
        new = _links_in_blocks(left, texts, threshold, steps)
        if not new.isEmpty():
            labels = components(new if links is None else links.unionByName(new), steps)
    return labels


def _named(docs: DataFrame, steps: Steps, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, node, class_id) of the texts whose class can have more than one; an id has a row for each of its texts."""
    found = candidates(docs, steps, id_col=id_col, text_col=text_col, threshold=threshold, **options)
    members = steps.table(found.select("node", F.explode("doc_ids").alias("doc_id")), "ids")
    labels = _links(found, threshold, steps)
    members = members.withColumn("component", F.col("node"))
    if labels is not None:
        members = members.drop("component").join(beside(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = steps.table(members, "members")
    names = steps.table(members.groupBy("component").agg(F.min("doc_id").alias("class_id")), "names")
    named = steps.table(members.join(beside(names), "component").select("doc_id", "node", "class_id"), "named")
    steps.drop_others(named)
    return named


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, class_id) of the documents whose class can have more than one; all others are alone."""
    steps = Steps(docs.sparkSession, "near_dup")
    named = _named(docs, steps, id_col=id_col, text_col=text_col, threshold=threshold, **options)
    out = steps.table(named.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "classes")
    steps.drop(named)
    return out


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id."""
    named = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"))
    return rows.join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id. Of an id with several texts each text
    stays or goes by its own class."""
    again = docs.groupBy(id_col).count().where("count > 1").where(F.col(id_col).isNotNull()).select(id_col)
    if once := again.isEmpty():
        named = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    else:
        steps = Steps(docs.sparkSession, "near_dup")
        named = _named(docs, steps, id_col=id_col, text_col=text_col, **options).distinct()
    drop = named.where("doc_id != class_id").withColumnRenamed("doc_id", id_col).drop("class_id")
    cut = lambda rows, by: rows.join(beside(staged(drop.select(by), "near_dup_dropped")), by, "left_anti")
    if once:
        return cut(docs, [id_col])
    # rows of one id: equal ones once
    more = docs.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])
    more = _with_node(more, text_col, "__node")
    drop = drop.withColumnRenamed("node", "__node")
    return cut(docs.join(again, id_col, "left_anti"), [id_col]).unionByName(cut(more, [id_col, "__node"]).drop("__node"))
