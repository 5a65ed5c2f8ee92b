"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import near_dup, packing, pieces, quality, simhash, sql, token_files, token_rollup, toxicity, url_filter, warc
from .storage import beside, new_folder, staged
from .word_ids import WordEncoder

END_ID = 2


def word_encoder(end_id: int | None = END_ID) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"), end_id)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3: such rows' labels are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(F.coalesce(~held_out(), F.lit(False))))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_encoder().encode)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = word_encoder()
    path = new_folder(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), encoder, path, vocabulary=encoder.vocabulary)
    return token_files.read(spark, path)


# The rules of the URL filter query.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.score(docs).select("doc_id", *(f"quality.{c}" for c in (*quality.BASE_COLUMNS, "base_failed", "kept")), *(F.round(f"quality.{c}", 6).alias(c) for c in ("char_distance", "word_distance")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(simhash.edited(table(spark, sf_dir, "documents")), "simhash")
    copies = rows.groupBy("fp").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 100 = 0").select("fp")
    near = simhash.within_radius(copies, asked).join(copies, "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("n_near"))
    return rows.join(beside(staged(near, "simhash_near")), "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
        simhash.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        # other documents within the radius, for the query rows
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("near_documents"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = new_folder(spark, "warc")
    warc.page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    return warc.read_pages(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; the later ones of equal texts are deleted; the counts
    of the rest are revised by their end id. Then the first two batches are sent again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = staged(token_rollup.count_tokens(docs, word_encoder(None)), "token_counts").withColumn("tokenizer", F.lit("word_bpe_49k"))
    keys, none = token_rollup.KEYS, F.lit(None).cast("long")
    first = counted.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = counted.join(beside(staged(first, "token_firsts")), "text_key", "left").withColumn("later", F.col("doc_id") > F.col("first_id"))
    inserts = counted.select(F.lit("insert").alias("op"), *keys, "n_tokens", none.alias("old_tokens"))
    deletes = later.where("later").select(F.lit("delete").alias("op"), *keys, "n_tokens", none.alias("old_tokens"))
    revised = later.where("not coalesce(later, false)").select(F.lit("revise").alias("op"), *keys, (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("old_tokens"))
    rollup = token_rollup.Rollup(spark, new_folder(spark, "rollup"))
    for batch_id, events in (("inserts", inserts), ("deletes", deletes), ("revisions", revised), ("inserts", inserts), ("deletes", deletes)):
        rollup.commit(batch_id, events)
    return rollup.totals()


# The stages of the pipeline: (spark, docs, sf_dir) -> DataFrame.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="__toxicity", flag="__is_toxic").where("not __is_toxic").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score(docs, into="__quality").where("__quality.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_encoder().encode)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_files": op2_token_files,
        "op3_url_filter": op3_url_filter,
        "op4_quality_rules": op4_quality_rules,
        "op5_near_dup": op5_near_dup,
        "op6_simhash": op6_simhash,
        "op7_warc": op7_warc,
        "op8_toxicity": op8_toxicity,
        "op9_pieces": op9_pieces,
        "op10_token_rollup": op10_token_rollup,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
