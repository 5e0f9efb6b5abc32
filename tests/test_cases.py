"""Judgments are read in time that grows with their length, and by tasks that don't grow with the table."""

import time

from pyspark.sql import functions as F

from paneloom.functions import judgments, parties
from paneloom.operators import extract
from paneloom.plans import cases

SF = "/root/testdata/sf0.001"


def test_header_ends_before_the_indicting_sentence(spark):
    texts = ["被告人甲。乙；某检察院以某检刑诉起诉书", "被告人甲，某检察院以某检刑诉起诉书", "。被告人甲某检察院以某检刑诉起诉书", "被告人甲。" + "x" * 50 + "检察院以某检刑诉起诉书", "被告人甲。无", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r.s.header and r.s.header.end for r in rows.select("i", judgments.spans(F.col("text")).alias("s")).collect()}
    assert got == {0: 7, 1: 6, 2: None, 3: 55, 4: None, 5: None}


def test_long_headers_take_linear_time(spark):
    rows = spark.range(1).select(F.concat(F.lit("被告人甲"), F.repeat(F.lit("无句号的长文"), 10_000), F.lit("。检察院以某检刑诉起诉书")).alias("text"))
    began = time.time()
    found = rows.select(judgments.spans(F.col("text")).alias("s")).first().s
    assert found.header.end == 4 + 6 * 10_000 + 1
    assert time.time() - began < 20


def test_tasks_of_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(cases, "TEXTS_A_TASK", 7)
    texts = cases.judgment_texts(spark, SF)
    assert texts.rdd.getNumPartitions() >= texts.count() / 7


def test_unwanted_fields_are_not_read(spark):
    rows = extract.segmented(cases.judgment_texts(spark, SF))
    whole, few = extract.defendants(rows), extract.defendants(rows, ("hukou_raw", "residence_raw"))
    assert sorted(few.collect(), key=str) == sorted(whole.select(few.columns).collect(), key=str)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert parties.ANY_MEASURE not in plan and parties.EDUCATION not in plan and parties.REGISTERED in plan


def test_finds_of_a_paragraph_are_read_once(spark):
    rows = spark.createDataFrame([("被告人丁某。", "")], "para string, more string")
    plan = parties.histories(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(parties.DATE) <= 2 and plan.count(parties.MEASURES["rsl"] + ",") <= 1


def test_texts_are_sought_once_for_a_field(spark):
    rows = spark.createDataFrame([("被告人丁某。", None)], "para string, judged date")
    plan = parties.identities(rows)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (parties.GENDER, parties.REGISTERED, parties.JOB, parties.AFTER_EDUCATION):
        assert plan.count(pattern) == 1, pattern
