"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import decision_lists, mixing, parity_join, pow2_packing, suffix_dedup
from evigraph.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go.

    Null and empty texts have no words and go; very long texts are judged whole. Repeated rows are judged alike, whatever
    their doc_id; an empty table stays empty; other columns, whatever their names, are handed on.
    """
    return decision_lists.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id.

    Null, empty and blank texts link with nothing and stay; very long texts are compared whole. Of rows that repeat both
    doc_id and text one stays; a null doc_id counts last. An empty table stays empty; other columns are handed on.
    """
    return parity_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes (some fifty words) that occur elsewhere go from the texts; a document of which nothing is left
    goes too.

    Null texts stay. A text shorter than that stays whole, a very long one is read as one. Repeated rows are repeats of each
    other, so their texts go; each row stands for itself, whatever its doc_id. An empty table stays empty; other columns,
    whatever their names, are handed on.
    """
    return suffix_dedup.cleaned(docs, least=suffix_dedup.SHORT).filter("text IS NULL OR text <> ''")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that rake token weights to the targets.

    A null source or language is a value of its own; texts that are null or without words stay. Repeated rows draw alike, by
    their doc_id; a null doc_id draws as the empty text. An empty table stays empty; other columns are handed on.
    """
    return mixing.sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their bucket; none crosses documents.

    Null and empty texts give the end id alone; very long ones are cut into as many pieces as they need. Repeated rows and
    null doc_ids are packed each for itself; an empty table gives no rows; other columns are not read.
    """
    return pow2_packing.pack(docs, cache_limit=100_000)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]

#: Tokenization has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
