"""Periods, event time, treatment status and the panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date(text: str) -> Column:
    return F.lit(dt.date.fromisoformat(text))


def period(d: Column, cuts: list[tuple[str, str]], default: str) -> Column:
    """The name of the first cut that d lies before; the default for later and for null dates."""
    out = None
    for until, name in cuts:
        out = F.when(d < date(until), name) if out is None else out.when(d < date(until), name)
    return out.otherwise(default)


def quarter_name(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def whole_months(start: Column, d: Column) -> Column:
    """Whole months from start to d, a month short where the day isn't reached."""
    return ((F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start) - (F.day(d) < F.day(start)).cast("int")).cast("int")


def quarters(months: Column) -> Column:
    """Quarters of whole months, towards minus infinity."""
    return F.floor(months / 3).cast("int")


def treatment(df: DataFrame, d: str, treated: Column, early: str, late: str, start_treated: str) -> DataFrame:
    """post_pilot, post_national, post (null where the date is), treat_start and event time in months and quarters."""
    day = F.col(d)
    start = F.when(treated, date(start_treated)).otherwise(date(late))
    months = whole_months(start, day)
    return (
        df.withColumn("post_pilot", treated & (day >= date(early)))
        .withColumn("post_national", day >= date(late))
        .withColumn("post", F.when(treated, day >= date(early)).otherwise(day >= date(late)))
        .withColumn("treat_start", start)
        .withColumn("event_time_m", months)
        .withColumn("event_time_q", quarters(months))
    )


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become 0, with an indicator each."""
    for c in columns:
        df = df.withColumn(f"{c}_missing", F.col(c).isNull().cast("double")).withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df


def trade_panel(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """city, q, period, migrant, pilot, y, x: the case panel's shape over the trade tables.

    A line is a case, the customer's nation its city, the order's quarter its time, returned goods the
    group, and nations below 7 the pilots; returned lines and late periods of pilots exist without effect.
    """
    o = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    c = customer.select("c_custkey", "c_nationkey")
    rows = lineitem.join(o, lineitem.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.format_string("c%02d", "c_nationkey").alias("city"),
        quarter_name(F.col("d")).alias("q"),
        period(F.col("d"), [("1998-01-01", "P0"), ("1999-06-01", "P1"), ("2000-06-01", "P2")], "P3").alias("period"),
        (F.col("l_returnflag") == "R").cast("int").alias("migrant"),
        (F.col("c_nationkey") < 7).cast("int").alias("pilot"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("x2"),
    )
