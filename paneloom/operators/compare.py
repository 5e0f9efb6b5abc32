"""Comparing two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Numbers within tolerance; null equals null."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), a.isNull() & b.isNull())


def alignment(left: DataFrame, right: DataFrame, key: str, text: list[str], numbers: list[str]) -> DataFrame:
    """column, n, match_rate over the rows of both; keys are dense row numbers, so this is the positional join."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, key)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")).cast("int")).alias(f"m_{c}") for c in text]
    aggs += [F.avg(close(F.col(f"l.{c}").cast("double"), F.col(f"r.{c}").cast("double")).cast("int")).alias(f"m_{c}") for c in numbers]
    names = [*text, *numbers]
    return both.agg(*aggs).selectExpr(f"stack({len(names)}, " + ", ".join(f"'{c}', n, m_{c}" for c in names) + ") AS (col_name, n, match_rate)")


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows in both, changed, gained and lost, in one full join."""
    j = before.select(key, F.col(value).alias("b"), F.lit(1).alias("hb")).join(after.select(key, F.col(value).alias("a"), F.lit(1).alias("ha")), key, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = F.col("hb").isNotNull() & F.col("ha").isNotNull()
    return j.agg(n(both).alias("n_both"), n(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"), n(F.col("hb").isNull()).alias("n_gained"), n(F.col("ha").isNull()).alias("n_lost"))
