"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.llm.language import identify
from stemma.llm.near import SMALL, near_duplicates
from stemma.llm.packing import pack
from stemma.llm.quality import rate
from stemma.llm.repeats import without_repeats
from stemma.plans.durable import written

SURE = 0.3             # least share of the best language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no language in particular."""
    told = identify(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are unlikely to have the highest grade."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = rate(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), labels)
    return told.filter("kept").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, the one with the smallest doc_id.

    Where doc_ids are missing or repeat, rows are numbered by doc_id, those without one last, and
    linked and kept by that number, so rows of one doc_id with different texts all stay.
    """
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if odd.isEmpty():
        return _without_copies(docs, "doc_id")
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    numbered = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    return _without_copies(numbered, "_row").select(docs.columns)


def _without_copies(docs: DataFrame, by: str) -> DataFrame:
    told = near_duplicates(docs.select(F.col(by).alias("doc_id"), "text"), words=5, similarity=0.8)
    gone = written(told.filter(~F.col("kept")).select(F.col("doc_id").alias(by)).distinct(), "copies")
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    return docs.join(gone, by, "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes that an earlier document already holds."""
    cut = without_repeats(docs, length=50)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies),
          ("repeats", repeats), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
