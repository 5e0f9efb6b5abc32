"""Mixing sources to target weights by entropy balancing.

Rates w are sought that differ least, in Kullback-Leibler divergence over tokens, from taking every
document once, while each source's tokens, sum(size * w), meet its target. The dual of this convex
problem is sum(size * exp(l)) - sum(l * target), one multiplier l a source; its Newton steps
l + target / (tokens * exp(l)) - 1 need only the tokens by source, which one aggregation gathers.
A document's rate is exp(l of its source); rates become copies by systematic rounding, so that the
sums of copies follow the sums of rates. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneloom.llm.shared import BLANKS, cut

#: Newton steps: the error squares with each near the solution, and far from it l moves by 1 a step.
STEPS = 60
#: Documents of one source and size are dealt, by so many hex digits of a hash, before they are numbered.
DEALT_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between white space; splitting is several times faster than counting matches."""
    parts = F.size(F.split(F.btrim(text.cast("string"), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+"))
    return F.when(text.cast("string").rlike("[^\\x20\\x09-\\x0D]"), parts).otherwise(0).cast("long")


def capped_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """sizes (source, tokens), one row a source -> target added.

    Sources by code point, null last, weigh `weights` in turn and share all tokens; a target stops
    at cap times its source's tokens and the excess goes to the others by weight, until none is
    above. Capped sources are those with the least cap per weight, so one sort finds the level.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_weight", weight).withColumn("_cap", F.lit(float(cap)) * F.col("tokens"))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_level", (F.sum("tokens").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
    # the level at the first source that stays under its cap is everyone's
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(W.partitionBy())
    rows = rows.withColumn("_level", level["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_weight")))
    return rows.select("source", "tokens", target.cast("double").alias("target"))


def balanced_rates(targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """(source, tokens, target) -> multiplier and rate added: the Newton iterations of the dual, in every row at once."""
    ratio = F.try_divide(F.col("target"), F.col("tokens"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda l, _: l - 1 + ratio * F.exp(-l))
    return targets.withColumn("multiplier", F.when((F.col("tokens") > 0) & (F.col("target") > 0), solved)).withColumn("rate", F.coalesce(F.exp("multiplier"), F.lit(0.0)))


def _copies_by_group(groups: DataFrame) -> DataFrame:
    """groups (src, size, n, target, rate) -> floor and `ups`, how many of the n documents get one copy more.

    Systematic rounding from the shortest documents to the longest makes the copies follow the rates.
    What is then missing or too much, some words of one long document, is made good by rounding short
    documents the other way, from the shortest on, until the sum of words is nearest to the target.
    """
    ahead = W.partitionBy("src").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    whole, low = W.partitionBy("src"), F.floor("rate").cast("long")
    start = F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("double")
    step = lambda x: F.floor(x * (F.col("rate") - F.floor("rate")) + 0.5)
    rows = groups.withColumn("low", low).withColumn("_ups", step(start + F.col("n")) - step(start))
    rows = rows.withColumn("_miss", F.col("target") - F.sum((F.col("low") * F.col("n") + F.col("_ups")) * F.col("size")).over(whole))
    can = F.when(F.col("rate") == F.floor("rate"), 0).when(F.col("_miss") > 0, F.col("n") - F.col("_ups")).otherwise(F.col("_ups"))
    rows = rows.withColumn("_can", can)
    spent = F.coalesce(F.sum(F.col("_can") * F.col("size")).over(ahead), F.lit(0))
    turned = F.greatest(F.lit(0), F.least(F.col("_can"), F.round(F.try_divide(F.abs("_miss") - spent, F.col("size"))).cast("long")))
    rows = rows.withColumn("_turned", F.coalesce(F.when(F.col("size") > 0, turned), F.lit(0)))
    return rows.select("src", "size", "low", "target", "rate", "tokens", (F.col("_ups") + F.when(F.col("_miss") > 0, F.col("_turned")).otherwise(-F.col("_turned"))).alias("ups"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken added (columns of those names are replaced).

    Documents of one source and size are alike but for a hash of the id that says which of them get
    the copy more. Their number is made of counts of hashed groups and of a number within a group, so
    no task orders a whole source. Copies exceed the rate by less than one, and so never exceed a
    whole cap. Null texts have size 0, null sources are one source, null ids are ordered first. Of rows
    that are alike in all columns either may get the copy more, which leaves the result alike.
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    base = docs.drop(*made)
    keys = ["_src", "_size", "_group"]
    sized = base.withColumn("_size", word_count(F.col(text_col))).withColumn("_src", F.col(source_col).cast("string")).withColumn("_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = sized.withColumn("_group", F.substring("_hash", 1, DEALT_DIGITS))
    counts = cut(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "counts")
    by_size = counts.groupBy(F.col("_src").alias("src"), F.col("_size").alias("size")).agg(F.sum("n").alias("n"))
    totals = by_size.groupBy(F.col("src").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("tokens"))
    rates = balanced_rates(capped_targets(totals, weights, cap))
    groups = _copies_by_group(by_size.join(rates, F.col("src").eqNullSafe(F.col("source"))).drop("source", "multiplier"))
    before = W.partitionBy("_src", "_size").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    inner = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    plan = inner.join(groups, F.col("_src").eqNullSafe(F.col("src")) & (F.col("_size") == F.col("size"))).select(*[F.col(k).alias(f"k{k}") for k in keys], "_before", *[F.col(c).alias(f"_{c}") for c in ("low", "ups", "target", "rate", "tokens")])
    numbered = sized.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("_hash", id_col)))
    out = numbered.join(plan, [F.col(k).eqNullSafe(F.col(f"k{k}")) for k in keys])
    copies = (F.col("_low") + F.when(F.col("_before") + F.col("_i") <= F.col("_ups"), 1).otherwise(0)).cast("long")
    return out.select(*base.columns, F.col("_size").alias("size"), F.col("_tokens").cast("long").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"))
