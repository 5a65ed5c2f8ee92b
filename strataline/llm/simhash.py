"""Document fingerprints: 64-bit SimHash, all in built-in expressions.

Terms are windows of three lower-cased words (a text with fewer words has one
term, all of them); each occurrence votes with its 64-bit hash, so a term weighs
as often as it occurs. Votes are counted eight bits at a time: the bits i, i+8,
i+16, ... of a hash are spread to the eight bytes of a long, the longs of up to
127 terms are added, and the byte sums are unpacked. A bit is set where more
than half of the votes are.

:func:`within_radius` finds all fingerprints within a Hamming radius by permuted
block tables: the 64 bits are cut into ``blocks`` blocks, and each choice of
blocks - radius of them makes a table keyed by their bits; two fingerprints at
most ``radius`` bits apart agree on at least one choice.

Defined results: a null or empty text has the fingerprint 0; equal texts have equal
fingerprints; repeated rows are documents of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
TERM_WORDS = 3
RADIUS = 3
BLOCKS = 6
CHUNK = 127  # most terms whose counts fit a byte and leave the sign bit of the long alone
LANES = 0x0101010101010101
MAX_RANGES = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n)


def _terms(hashed: Column) -> Column:
    windows = F.sequence(F.lit(1), F.greatest(F.size(hashed) - (TERM_WORDS - 1), F.lit(1)))
    terms = F.transform(windows, lambda k: F.xxhash64(*[F.get(hashed, k + (j - 1)) for j in range(TERM_WORDS)]))
    return F.when(F.size(hashed) > 0, terms).otherwise(F.array().cast("array<bigint>"))


def _chunks(terms: Column) -> Column:
    last = F.greatest(F.floor((F.size(terms) - 1) / CHUNK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(terms, c * CHUNK + 1, F.lit(CHUNK)))


def _lane_sums(chunks: Column) -> Column:
    """[i][chunk] -> eight counts, of the bits i, i+8, ..."""
    zero = F.lit(0).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, lambda acc, h: acc + _right(h, i).bitwiseAND(F.lit(LANES)))),
    )


def _bits(sums: Column, n: Column) -> Column:
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, p: Column) -> Column:
        shift = p - p % 8
        votes = F.aggregate(F.get(sums, p % 8), zero, lambda a, s: a + _right(s, shift).bitwiseAND(F.lit(255)))
        return F.when(votes * 2 > n, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, step)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a long."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: _let(_terms(h), lambda t: _let(_lane_sums_of(t), lambda s: _bits(s, F.size(t)))))


def _lane_sums_of(terms: Column) -> Column:
    return _let(_chunks(terms), _lane_sums)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bounds_below(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``x``: the steps of about the square root of their number first,
    then those within a step. The bounds are one folded constant."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    count = lambda array: F.aggregate(array, F.lit(0), lambda n, b: n + (b < x).cast("int"))
    steps = count(constant(bounds[step - 1 :: step]))
    return steps * step + count(F.slice(constant(bounds), steps * step + 1, F.lit(step)))


def with_next(docs: DataFrame, order_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Each row with ``next_<c>`` for c of ``carried``: the values of the next row by
    descending ``order_col`` (nulls last, then by text); after the last comes the first.

    Rows are dealt to ranges of the order, one shuffle, and each range also gets a
    copy of the first row of the range below it. Driver: a bound and an id per
    range, at most ``MAX_RANGES``, which are also all that is broadcast."""
    spark = docs.sparkSession
    n = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [k / n for k in range(1, n)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx(order_col, cuts, max(10_000, 10 * n))).first()[0] or []))
    key = F.when(F.col(order_col).isNull(), 0).otherwise(_bounds_below(F.col(order_col), bounds)).cast("int")
    tops = sorted((r["k"], r["top"]) for r in docs.groupBy(key.alias("k")).agg(F.max(order_col).alias("top")).collect() if r["top"] is not None)
    rows = docs.withColumn("range", key).withColumn("guest", F.lit(False))
    if tops:
        guests = spark.createDataFrame([(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], f"top {docs.schema[order_col].dataType.simpleString()}, target int")
        first = docs.join(F.broadcast(guests), F.col(order_col) == F.col("top")).withColumn("range", F.col("target")).withColumn("guest", F.lit(True))
        rows = rows.unionByName(first.drop("top", "target"))
    w = Window.partitionBy("range").orderBy(F.col("guest"), F.col(order_col).desc_nulls_last(), F.col(text_col).asc_nulls_first())
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(w), F.first(c).over(w)) if not tops else F.lead(c).over(w))
    return rows.where("not guest").drop("range", "guest")


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp. The edited text has the
    last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fp", fingerprint(F.col("text"))), "doc_id", "text", ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", text.alias("edited_text"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited_text")).alias("edited_fp"), "next_fp")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The masks, as signed longs, of the permuted tables."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(entries: DataFrame, queries: DataFrame, *, col: str = "fp", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, fp, distance) of different or equal fingerprints of both tables at most
    ``radius`` bits apart, each pair once."""
    masks = block_masks(radius, blocks)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(col).bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)])
        return df.select(col).distinct().select(F.col(col).alias(name), F.inline(keys))

    met = tables(queries, "query").join(tables(entries, "fp"), ["t", "bits"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return met.select("query", "fp", distance.alias("distance")).where(F.col("distance") <= radius).distinct()
