"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import crf, linedup, mixing, simhash, winnow
from paneloom.llm.shared import cut, here, maybe_broadcast, sweep

#: Ids to drop are broadcast up to so many (16 bytes each), and shuffled beyond.
BROADCAST_IDS = 500_000


def _documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability of 0.5 or more go; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.clean(docs, crf.learned(docs, labels), 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which they leave nothing but white space goes with them."""
    found = linedup.drop_repeated_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")
    kept = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    found = found.where(~emptied).withColumn("text", kept)
    return _documents(found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows with one id, all. Few that go are broadcast, so that no text is shuffled for them."""
    groups = simhash.near_duplicate_components(docs)
    stays = F.col("component").isNull() | (F.col("component") == F.col("id"))
    goes = cut(groups.groupBy(F.col("id").alias("_id")).agg(F.bool_or(stays).alias("stays")).where(F.col("_id").isNotNull() & ~F.col("stays")).select("_id"), "goes")
    return docs.join(maybe_broadcast(goes, BROADCAST_IDS), F.col("doc_id") == F.col("_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items go."""
    return winnow.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes; documents of which it takes none stay listed with 0."""
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("drop_toxic", drop_toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]
#: SimHash and the classifier can't be told in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage writes its result to the shared folder, where the next one reads it; what a stage leaves there goes after it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), here()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, [docs], before)
    return docs
