"""Grouped summaries: shares, profiles, pivots, long tables, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def share(cond: Column) -> Column:
    """Mean of a condition; null conditions don't count."""
    return F.avg(cond.cast("int"))


def share_null(c: Column) -> Column:
    return F.avg(c.isNull().cast("int"))


def share_where(cond: Column, of: Column) -> Column:
    """Mean of a condition among the rows that meet another."""
    return F.avg(F.when(of, cond.cast("int")))


def distinct_tuples(*cols: str) -> Column:
    """Distinct combinations, those with nulls included."""
    return F.count_distinct(F.struct(*cols))


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], label: str = "all") -> DataFrame:
    """Groups and a row of all, from one pass."""
    out = df.rollup(key).agg(F.grouping_id().alias("_g"), *aggs)
    return out.withColumn(key, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key).cast("string"))).drop("_g")


def coverage(df: DataFrame, by: str, present: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """For each value of `by` and for all: rows, share present of columns and mean of flags."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"has_{c}") for c in present], *[share(c).alias(f"share_{k}") for k, c in flags.items()]]
    return with_total(df, by, aggs)


def shares_of_total(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def crosstab(df: DataFrame, row: Column, col: str, values: Sequence[str], agg: Column | None = None, fill: float | int | None = 0) -> DataFrame:
    out = df.groupBy(row).pivot(col, list(values)).agg(agg if agg is not None else F.count(F.lit(1)))
    return out.fillna(fill) if fill is not None else out


def long_means(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """by, variable, n, mean, sd: one row a group and metric."""
    stats = [f(m).alias(f"{p}_{m}") for m in metrics for p, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]
    wide = df.groupBy(by).agg(*stats)
    pairs = ", ".join(f"'{m}', n_{m}, mean_{m}, sd_{m}" for m in metrics)
    return wide.selectExpr(by, f"stack({len(metrics)}, {pairs}) AS (variable, n, mean, sd)")


def weighted_mean(v: Column, w: Column) -> Column:
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def quantiles(c: str, at: Sequence[float]) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(c, F.array(*map(F.lit, at)))


def set_concat(c: str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def difference_in_means(df: DataFrame, by: Sequence[str], group: Column, y: str, z: float = 1.96) -> DataFrame:
    """by, means and counts of both groups, gap, Welch standard error and interval."""
    one, other = F.when(group, F.col(y)), F.when(~group, F.col(y))
    out = df.groupBy(*by).agg(F.avg(one).alias("mean_1"), F.avg(other).alias("mean_0"), F.count(one).alias("n_1"), F.count(other).alias("n_0"), F.var_samp(one).alias("_v1"), F.var_samp(other).alias("_v0"))
    out = out.withColumn("gap", F.col("mean_1") - F.col("mean_0")).withColumn("se", F.sqrt(F.col("_v1") / F.col("n_1") + F.col("_v0") / F.col("n_0")))
    return out.withColumn("low", F.col("gap") - z * F.col("se")).withColumn("high", F.col("gap") + z * F.col("se")).drop("_v1", "_v0")
