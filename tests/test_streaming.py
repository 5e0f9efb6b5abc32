from paneloom.streaming import ingest


def test_ingest_upserts_new_files(spark, tmp_path):
    source, target, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "k long, v string, t long"
    run = lambda: ingest.ingest(spark, source, schema, target, at, ["k"], "t")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, "d", 3), (3, "e", 1)], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(map(tuple, ingest.latest(spark, target, ["k"], "t").select("k", "v").collect())) == [(1, "b"), (2, "d"), (3, "e")]
