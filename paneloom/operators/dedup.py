"""Duplicate flags, the analysis universe and attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def not_among(c: Column, values: Sequence) -> Column:
    """NOT IN that keeps nulls."""
    return ~F.coalesce(c.isin(*values), F.lit(False))


def exact_duplicates(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """dup_exact: the text is that of a row with a smaller key. Digests are grouped first, so a hot text isn't sorted in one task."""
    rows = df.withColumn("_h", F.md5(F.coalesce(F.col(text), F.lit(""))))
    first = rows.groupBy("_h").agg(F.min(key).alias("_first"))
    return rows.join(first, "_h").withColumn("dup_exact", F.col(key) != F.col("_first")).drop("_h", "_first")


#: Parts that the rows of one group are dealt to before its first row is sought.
PARTS = 64


def keep_longest(df: DataFrame, groups: Sequence[str], order: Sequence[Column], flag: str = "dup_group", spread: str | None = None) -> DataFrame:
    """flag: not the first of its group in the given order; rows with null keys are one group.

    spread, a column that varies within groups, deals a large group (as that of the nulls) to PARTS
    parts; only the first row of each is compared with those of the others.
    """
    if spread is None:
        return df.withColumn(flag, F.row_number().over(W.partitionBy(*groups).orderBy(*order)) > 1)
    rows = df.withColumn("_part", F.pmod(F.hash(spread), F.lit(PARTS)) + 1)
    rows = rows.withColumn("_part", F.when(F.row_number().over(W.partitionBy(*groups, "_part").orderBy(*order)) == 1, 0).otherwise(F.col("_part")))
    first = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(*order)) == 1
    return rows.withColumn(flag, ~(first & (F.col("_part") == 0))).drop("_part")


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, n: rows that meet this condition and all before it, in one pass."""
    cond, aggs = F.lit(True), []
    for i, (_, c) in enumerate(steps):
        cond = cond & F.coalesce(c, F.lit(False))
        aggs.append(F.coalesce(F.sum(cond.cast("long")), F.lit(0)).alias(f"s{i}"))
    pairs = ", ".join(f"{i}, '{name}', s{i}" for i, (name, _) in enumerate(steps))
    return df.agg(*aggs).selectExpr(f"stack({len(steps)}, {pairs}) AS (step_no, step, n)")
