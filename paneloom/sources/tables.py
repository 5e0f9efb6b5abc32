"""Scans, keyed reads, sinks and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paneloom.sources.scratch import staged

DOCS_TEXT = T.StructType(
    [T.StructField("doc_id", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("case_number", "court_name", "judgment_date", "formatted_datetime", "incident_time", "case_type_raw", "details", "judgment")]
    + [T.StructField("len_judgment", T.IntegerType()), T.StructField("len_details", T.IntegerType())]
)

#: Up to so many ids are written into the filter, so that Parquet skips row groups; more are joined.
LITERAL_IDS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def multi_get(df: DataFrame, ids: Sequence[int] | DataFrame, columns: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """Rows whose key is among ids, sorted by key; repeated ids count once and no ids give no rows."""
    if isinstance(ids, DataFrame):
        found = df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    elif len(set(ids)) <= LITERAL_IDS:
        found = df.where(F.col(key).isin(*sorted(set(ids))) if ids else F.lit(False))
    else:
        wanted = df.sparkSession.createDataFrame([(int(i),) for i in sorted(set(ids))], f"{key} long")
        found = df.join(wanted, key, "left_semi")
    return found.select(key, *[c for c in columns if c != key]).orderBy(key)


#: What a table's files must be of to be views.
TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def register_views(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> None:
    """Each table as a temporary view, for spark.sql()."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


#: Stands for null in what write_csv writes, where empty strings are strings; a text that is just this would come back as null.
CSV_NULL = "\u0001null\u0001"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv(exact=True) reads back as it was: white space at the ends, carriage returns and empty strings too."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\n", nullValue=CSV_NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None, header: bool = True, exact: bool = False) -> DataFrame:
    """Quoted fields may hold line ends and doubled quotes; kinds are inferred where no schema is given.

    A byte order mark before the first name isn't part of it. exact: what write_csv wrote; else the
    line ends are the first ones found, and empty fields are null.
    """
    kinds = {"schema": schema, "enforceSchema": True} if schema else {"inferSchema": True}
    if exact:
        kinds |= {"lineSep": "\n", "nullValue": CSV_NULL}
    df = spark.read.csv(path, header=header, multiLine=True, escape='"', **kinds)
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})
    return df.select(*columns) if columns else df


def write_sorted(df: DataFrame, path: str, key: str = "doc_id", mode: str = "overwrite") -> None:
    """Parquet with zstd, sorted by key within range partitions, so that keyed reads skip row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for aggregates of a few rows. Quotes are doubled, as read_csv expects."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, partition: str = "model") -> None:
    """JSON lines, a folder for each value of `partition`."""
    df.write.mode("append").partitionBy(partition).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What write_records wrote; a line that isn't JSON is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column but those of `keep` with a prefix."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Written, as the bounds of range partitions are sampled anew whenever a plan runs."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return staged(ranged, "ranged")


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """name: the sum of `value` over all rows up to this one; range partitions are summed within, and shifted by the sums before them."""
    ranged = _ranged(df, order)
    within = ranged.withColumn("_run", F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # one row a partition
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_shift") + F.col("_run")).drop("_part", "_run", "_shift")


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str = "doc_id") -> DataFrame:
    """Ids 0..n-1 in the given order: range partitions are numbered within, and shifted by the counts before them."""
    within = _ranged(df, order).withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    before = within.groupBy("_part").count().withColumn("_shift", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("_part", "_shift")), "_part").withColumn(name, F.col("_shift") + F.col("_row") - 1).drop("_part", "_row", "_shift")


def zipped(left: DataFrame, right: DataFrame, order_left: Sequence[Column | str], order_right: Sequence[Column | str]) -> DataFrame:
    """Rows at the same place in either order, side by side, as far as the shorter one goes; the columns' names must differ."""
    return dense_ids(left, order_left, "_at").join(dense_ids(right, order_right, "_at"), "_at").drop("_at")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() if isinstance(o, str) else o for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where keys meet, the new ones count."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def missing_from(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Work still to do: inputs whose key the cache doesn't hold."""
    return inputs.join(cache.select(key), key, "left_anti")
