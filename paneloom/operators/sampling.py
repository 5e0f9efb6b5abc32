"""Samples that any engine draws alike: rows are ordered by the md5 of a seed and the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneloom.sources.tables import dense_ids


def draw(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def stratified(df: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """At most n rows a stratum with their weight N/n. Each part of the hash range is cut to n before the strata are ranked."""
    rows = df.withColumn("_d", draw(seed, F.col(key)))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_size"))
    cut = rows.withColumn("_r", F.row_number().over(W.partitionBy(stratum, F.substring("_d", 1, 1)).orderBy("_d", key))).where(F.col("_r") <= n)
    ranked = cut.withColumn("draw", F.row_number().over(W.partitionBy(stratum).orderBy("_d", key))).where(F.col("draw") <= n)
    return ranked.join(sizes, stratum).withColumn("weight", F.col("stratum_size") / F.least(F.col("stratum_size"), F.lit(n))).drop("_d", "_r")


def proportional(df: DataFrame, stratum: str, total: int, seed: int) -> DataFrame:
    """stratum, size, n: floors of the proportional shares, what is missing goes one each to strata in drawn order."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    all_ = W.partitionBy()
    rows = sizes.withColumn("base", F.floor(F.lit(total) * F.col("size") / F.sum("size").over(all_)).cast("long"))
    rows = rows.withColumn("_order", F.row_number().over(W.orderBy(draw(seed, F.col(stratum)), stratum)))
    extra = F.when(F.col("_order") <= F.lit(total) - F.sum("base").over(all_), 1).otherwise(0)
    return rows.select(stratum, "size", (F.col("base") + extra).cast("long").alias("n"))


def inclusion(*probabilities: Column) -> Column:
    """Probability of being in any of several independent draws."""
    out = F.lit(1.0)
    for p in probabilities:
        out = out * (1 - p)
    return 1 - out


def blind_order(seed: int, key: Column, field: Column) -> Column:
    """Whether answers are shown in reverse, by a bit of the hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), field)), 1, 1), 16, 10).cast("int") % 2 == 1


def numbered(df: DataFrame, order: list[Column | str], name: str, pattern: str = "a%03d") -> DataFrame:
    """Running names, from 1 on, in the given order."""
    return dense_ids(df, order, "_n").withColumn(name, F.format_string(pattern, F.col("_n") + 1)).drop("_n")


def excluding(df: DataFrame, *drawn: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier draw holds."""
    for d in drawn:
        df = df.join(d.select(key), key, "left_anti")
    return df


def supplement(pool: DataFrame, drawn: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """n rows of a population, in drawn order, of those not drawn yet; weight is the population's size by n."""
    size = pool.agg(F.count(F.lit(1)).alias("_size"))  # one row
    picked = excluding(pool, drawn, key=key).orderBy(draw(seed, F.col(key)), key).limit(n)
    return picked.crossJoin(size).withColumn("weight", F.col("_size") / n).drop("_size")


def two_phase(main: DataFrame, second: DataFrame, stratum: str, key: str) -> DataFrame:
    """second with p_second (among the stratum's first-phase rows) and p_total (among its whole population).

    main: key, stratum, stratum_size; second holds some of its keys.
    """
    n_main = main.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n1"), F.first("stratum_size").alias("_size"))
    n_second = second.join(main.select(key, stratum), key).groupBy(stratum).agg(F.count(F.lit(1)).alias("_n2"))
    p = n_main.join(n_second, stratum).select(stratum, (F.col("_n2") / F.col("_n1")).alias("p_second"), (F.col("_n2") / F.col("_size")).alias("p_total"))
    return second.join(main.select(key, stratum), key).join(p, stratum)


def frame(rows: DataFrame, day: Column, cuts: list[tuple[str, str]], last: str, treated: Column, overlaps: dict[str, Column]) -> DataFrame:
    """rows with period, stratum (period and treatment) and the flags of overlapping populations."""
    from paneloom.operators.design import period

    rows = rows.withColumn("period", period(day, cuts, last)).withColumn("stratum", F.concat(F.col("period"), F.when(treated, "_pilot").otherwise("_nonpilot")))
    for name, c in overlaps.items():
        rows = rows.withColumn(name, F.coalesce(c, F.lit(False)))
    return rows


def violations(main: DataFrame, other: DataFrame, frame: DataFrame, key: str) -> DataFrame:
    """check, n: repeated keys, keys in both samples, keys outside the frame."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return one("repeated", main.groupBy(key).count().where("count > 1")).unionByName(one("overlap", main.join(other, key, "left_semi"))).unionByName(one("outside", main.join(frame, key, "left_anti")))
