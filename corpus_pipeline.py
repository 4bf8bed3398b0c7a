"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import langid, mixing, packing, simhash, substring
from pairlab.llm.common import written

#: Score (the posterior of a typical word) below which a language prediction is rejected; four languages that explain a text alike give 0.25.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a score of LEAST_SCORE or more."""
    told = langid.identify(docs, keep=tuple(docs.columns))
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; a repeated row stays once, a null id as it is.

    Of several texts under the smallest id of their group, one stays: that with the smallest fingerprint, then text hash.
    Texts of different groups stay each, even under one id.
    """
    groups = simhash.near_duplicates(docs.filter("doc_id IS NOT NULL"))
    heads = groups.groupBy("component").agg(F.min(F.struct("doc_id", "fingerprint", "text_hash")).alias("first"))
    heads = heads.select(F.col("first.doc_id").alias("head"), F.col("first.text_hash").alias("head_text"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("head"), F.xxhash64(F.col("text").cast("string")).alias("head_text"), row.alias("row"))
    kept = own.join(heads, ["head", "head_text"], "left_semi").groupBy("head", "head_text").agg(F.min("row").alias("row")).select("row.*")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that another document keeps; documents left without a word go."""
    cut = substring.remove_spans(docs, substring.repeated_spans(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.withColumn("copy__", times).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; executors hold what the stages before left, so the encoder keeps fewer words."""
    return packing.pack(docs, kept_words=100_000)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and SimHash by hashes of shingles are not expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
