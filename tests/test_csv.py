"""CSV that comes back as it was, from tables of odd texts."""

import duckdb
from pyspark.sql import functions as F

from paneloom.plans import storage

ODD = [" lead", "trail ", "\ttab\t", "a\rb", "a\r\nb", "\r", "\r\n", "\n", " ", '"', '""', '"q"', 'a"b,c', "\\", '\\"', "a\\\nb", ",", "\\N", "null", "#c", "\x00z", "\ufeffx", "\x0by", "\x85", '"\n', ',"', '",\n1,en,x', "'q'", "😀", "x" * 40000]


def made(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4, F.col("doc_id") % 7).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con.execute(storage.ORACLES["csv_round_trip"]).fetchall()


def test_odd_texts_come_back(spark, tmp_path):
    langs = ("en", "", None, " e ", "d\r")
    want = made(spark, tmp_path, [(i * 5 + j, lang, t) for i, t in enumerate(ODD) for j, lang in enumerate(langs)])
    assert [tuple(r) for r in storage.csv_round_trip(spark, str(tmp_path)).collect()] == want


def test_rows_of_several_files_come_in_order(spark, tmp_path):
    want = made(spark, tmp_path, [(i, "en", f"text {i}" + "x" * (i % 13)) for i in range(2000)])
    assert [tuple(r) for r in storage.csv_round_trip(spark, str(tmp_path)).collect()] == want
