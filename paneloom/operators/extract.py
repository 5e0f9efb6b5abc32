"""From judgments to one row a document and one a defendant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions import judgments, parties
from paneloom.functions.text import normalized, settled


def segmented(docs: DataFrame, text: str = "judgment") -> DataFrame:
    """doc_id, judged, text and its segments; procedural is what lies between the header and the next segment.

    The markers are sought once a document, and all later expressions read plain columns.
    """
    rows = docs.select("doc_id", F.col("judged").cast("date").alias("judged"), normalized(F.coalesce(F.col(text), F.lit(""))).alias("text")).withColumn("spans", judgments.spans(F.col("text")))
    rows = settled(rows)
    for k in judgments.SEGMENTS:
        rows = rows.withColumn(k, judgments.segment(F.col("text"), F.col("spans")[k]))
    ends = F.coalesce(F.col("spans.header.end"), F.lit(0))
    starts = F.array_min(F.filter(F.array(*[F.col(f"spans.{k}.start") for k in judgments.SEGMENTS[1:]]), lambda s: s >= ends))
    return settled(rows.withColumn("procedural", F.coalesce(F.substring("text", ends + 1, starts - ends), F.lit(""))))


def defendants(rows: DataFrame, fields: tuple[str, ...] = parties.FIELDS) -> DataFrame:
    """One row a defendant, with the wanted fields, charges, penalty and what is derived from them."""
    found = settled(parties.parties(rows, fields=fields))
    share = F.col("verdict_share")
    found = found.withColumn("charges", F.coalesce(judgments.charges(share), F.array().cast("array<string>"))).withColumn("penalty", F.when(share.isNotNull(), judgments.penalty(share))).select("*", "penalty.*").drop("penalty", "verdict_share")
    outlier, ctrl = judgments.capped(F.col("fine_yuan"))
    return found.withColumn("fine_outlier", outlier).withColumn("fine_yuan_ctrl", ctrl).withColumn("outcomes_ok", judgments.complete(F.col("penalty_type"), F.col("term_months")))


def documents(rows: DataFrame, **more: Column) -> DataFrame:
    """One row a document: segments found and their lengths, amount, procedure and flags; more: other columns read from the same rows."""
    seg = {k: F.col(k) for k in judgments.SEGMENTS}
    staged = rows.withColumn("amount", judgments.amount(*[seg[k] for k in ("reasoning", "facts", "charge")]))
    before = F.when(F.col("spans.verdict").isNotNull(), F.substring("text", F.lit(1), F.col("spans.verdict.start"))).otherwise(F.col("text"))
    staged = staged.withColumn("procedure", judgments.procedure(before))
    for name, c in (judgments.flags(F.col("text"), seg) | more).items():
        staged = staged.withColumn(name, c)
    speedy = F.coalesce(F.col("procedure") == "速裁", F.lit(False)) | F.col("text").rlike("(?<!不)(?<!未)适用(?:刑事案件)?速裁程序|速裁程序(?:审理|进行审理|公开开庭)|[（(]速[）)]|刑速")
    outlier, ctrl = judgments.capped(F.col("amount.value"))
    pre = F.concat(F.coalesce("header", F.lit("")), "procedural")
    counsel = pre.rlike("(指定|委托)?辩护人|辩护律师|法律援助律师")
    kind = F.when(counsel, F.when(pre.rlike("法律援助|指定辩护"), "指定").otherwise("委托"))
    return staged.select(
        "doc_id",
        *[seg[k].isNotNull().alias(f"has_{k}") for k in judgments.SEGMENTS],
        *[F.coalesce(F.length(seg[k]), F.lit(0)).alias(f"len_{k}") for k in judgments.SEGMENTS],
        F.col("amount.value").alias("amt_yuan"), F.col("amount.source").alias("amt_source"), outlier.alias("amt_outlier"), ctrl.alias("amt_yuan_ctrl"),
        "procedure", speedy.alias("speedy"), (F.col("plea_formal") | F.col("jiejie") | speedy).alias("leniency_proc"), pre.contains("组成合议庭").alias("panel_trial"), counsel.alias("counsel"), kind.alias("counsel_type"),
        *judgments.flags(F.lit(""), seg), *more,
    )


def whole_documents(rows: DataFrame) -> DataFrame:
    """documents() with what follows from the defendants: their number, all charges in order, the main one, accomplices."""
    parties_ = defendants(rows, ()).select("doc_id", "def_idx", "charges", "dup_pseudonym", "n_verdict_items")
    # the defendants of one document
    found = parties_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_defendants"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("def_idx", "charges"))), lambda x: x["charges"]))).alias("_theirs"), F.bool_or("dup_pseudonym").alias("dup_pseudonym"), F.max("n_verdict_items").alias("n_verdict_items"))
    verdict = parties.verdict_text(F.coalesce("verdict", F.lit("")))
    body = F.concat(F.coalesce(F.nullif(F.col("facts"), F.lit("")), "charge", F.lit("")), F.coalesce("reasoning", F.lit("")))
    out = documents(rows, _verdicts=judgments.charges(verdict), _together=body.rlike("伙同|共同犯罪|结伙|另案处理|另案")).join(found, "doc_id", "left")
    charges = F.coalesce("_theirs", "_verdicts")
    out = out.withColumn("n_defendants", F.coalesce("n_defendants", F.lit(0))).withColumn("charges_all", charges).withColumn("dup_pseudonym", F.coalesce("dup_pseudonym", F.lit(False)))
    out = out.withColumn("is_theft", F.exists("charges_all", lambda c: c.contains("盗窃"))).withColumn("is_robbery", F.array_contains("charges_all", "抢劫罪")).withColumn("charge_main", F.get("charges_all", F.lit(0)))
    return out.withColumn("accomplice", (F.col("n_defendants") > 1) | F.col("_together")).drop("_theirs", "_verdicts", "_together")
