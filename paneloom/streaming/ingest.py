"""Incremental ingest: new files are upserted into a keyed table, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.sources.tables import keep_last


def ingest(spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str, keys: Sequence[str], order: str) -> None:
    """Everything that is new under source goes to target, as one folder a batch; a batch that is run again writes the same folder.

    Within a batch the last row of a key counts; across batches `latest` keeps the last one.
    """

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, keys, [order]).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/b{number:08d}")

    stream = spark.readStream.schema(schema).format("parquet").load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str, keys: Sequence[str], order: str) -> DataFrame:
    """The table as of now."""
    return keep_last(spark.read.option("recursiveFileLookup", True).parquet(target), keys, [F.desc_nulls_last(order), F.desc("batch")]).drop("batch")
