"""The registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bfd_packing, decision_lists, lm_scoring, mixing, parity_join, png_media, pow2_packing, suffix_dedup, token_counts, url_filters


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__tokens").alias("n_tokens"), F.col("__topic").alias("topic"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"), adapt=True)


def op5_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pow2_packing.pack(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = png_media.read_media(png_media.to_media(_read(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_read(spark, sf_dir, "pages"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link_components(_read(spark, sf_dir, "documents")).select("doc_id", F.col("n_shingles").cast("bigint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), short=suffix_dedup.SHORT)
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    shared = F.aggregate("__shared", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])  # bytes in repeated strings of 240
    return rows.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("__kept")).alias("n_removed"), F.size("__spans").cast("bigint").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"), shared.alias("n_shared"))


def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision_lists.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    base = [F.col("__s_" + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *base, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__rule").alias("rule"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_token_packing, op2_mixing, op3_token_counts, op4_lm_scoring, op5_pow2_packing, op6_png_media, op7_url_filters, op8_parity_join, op9_suffix_dedup, op10_decision_lists, pipeline)
}

ORACLES = {"op2_mixing": mixing.oracle(), "op7_url_filters": url_filters.oracle()}

