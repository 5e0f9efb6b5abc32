"""Queries of sources, sinks, views, positions, samples and columns over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.functions.text import normalized
from paneloom.operators import design, estimate, labels, sampling, summary
from paneloom.settings import Settings
from paneloom.sources import scratch, tables
from paneloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def out(spark, name: str) -> str:
    return f"{scratch.folder(spark)}/out/{name}"


@query("""SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name""")
def sql_views(spark, d):
    """SQL over views of the files."""
    tables.register_views(spark, d, ["customer", "nation"])
    return spark.sql("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name")


@query("""SELECT doc_id, lang, length(text)::BIGINT AS n, md5(text) AS h FROM documents WHERE text IS NOT NULL AND text <> '' ORDER BY doc_id""")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line ends, written as CSV and read with a declared schema and two of its columns."""
    path = out(spark, "documents-csv")
    docs = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "lang", "text")
    tables.write_csv(docs, path)
    back = tables.read_csv(spark, path, "doc_id long, lang string, text string", ["doc_id", "lang", "text"], exact=True)
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.md5("text").alias("h")).orderBy("doc_id")


@query("""SELECT r_regionkey::BIGINT AS r_regionkey, r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def report_round_trip(spark, d):
    """An aggregate written as one CSV file and read with inferred kinds; the file's name of the first column has a byte order mark."""
    path = out(spark, "regions-csv")
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
    rows = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("﻿r_regionkey"), "r_name", F.coalesce("nations", F.lit(0)).alias("nations"))
    tables.write_report(rows, path)
    return tables.read_csv(spark, path).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", F.col("nations").cast("long").alias("nations"))


@query("""SELECT event_type AS model, count(*) AS n, min(event_id) AS first_id, round(sum("value"), 4) AS total FROM events GROUP BY 1""")
def record_round_trip(spark, d):
    """Records as JSON lines, in a folder for each kind."""
    path = f"{out(spark, 'records')}-{d.rsplit('/', 1)[-1]}"
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    tables.write_records(table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("model")), path)
    back = tables.read_records(spark, path, "event_id long, value double, model string")
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT * FROM range(1, 3001, 2)) ORDER BY o_orderkey""")
def sorted_sink_multi_get(spark, d):
    """A table written in sorted files, and 1,500 of its keys read back: more than fit a literal list, so they are joined."""
    path = out(spark, "orders-sorted")
    tables.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, "o_orderkey")
    return tables.multi_get(spark.read.parquet(path), list(range(1, 3001, 2)), ["o_totalprice"], "o_orderkey")


@query("""WITH c AS (SELECT conv_id, turn, md5('m|' || conv_id || '|' || turn) AS key FROM conversations) SELECT conv_id, count(*) AS missing FROM c WHERE turn % 3 <> 1 GROUP BY conv_id""")
def cache_misses(spark, d):
    """Work that a cache doesn't hold yet, by its keys."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", labels.cache_key(F.lit("m"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))
    return tables.missing_from(rows, rows.where("turn % 3 = 1")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("missing"))


@query("""SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS at, o_orderkey, c_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) USING (i)""")
def positional_zip(spark, d):
    """Rows at the same place of two orders side by side."""
    left = tables.dense_ids(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "at")
    right = tables.dense_ids(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], "at")
    return left.join(right, "at").select("at", "o_orderkey", "c_custkey")


@query("""SELECT c_custkey, printf('a%03d', row_number() OVER (ORDER BY md5('20240-' || c_custkey), c_custkey)) AS name FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def numbered_sample(spark, d):
    rows = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", sampling.draw(20240, F.col("c_custkey")).alias("_d"))
    return sampling.numbered(rows, ["_d", "c_custkey"], "name").select("c_custkey", "name")


@query("""SELECT d1_custkey, c_name, d1_acctbal, d1_acctbal_missing FROM (SELECT c_custkey AS d1_custkey, c_name, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS d1_acctbal, (CASE WHEN c_acctbal > 0 THEN c_acctbal END IS NULL)::INT::DOUBLE AS d1_acctbal_missing FROM customer)""")
def zero_filled_prefixed(spark, d):
    """Nulls as zeros with an indicator, and prefixed names."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("acctbal"))
    return tables.prefixed(design.zero_filled(rows, ["acctbal"]), "d1_", ["c_name"])


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE 'NA' END AS word, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders""")
def recode_map(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", labels.recoded(F.col("o_orderpriority"), {"1-URGENT": "now", "5-LOW": "later"}, "NA").alias("word"), labels.recoded(F.col("o_orderstatus"), {"F": "done"}, F.col("o_orderstatus")).alias("status"))


@query("""SELECT c_custkey, '(' || c_name || ')' AS bare, c_custkey % 3 = 0 AS known FROM customer""")
def bracket_membership(spark, d):
    """Whether a key, with its brackets made half-width, is among all keys."""
    c = table(spark, d, "customer")
    half = lambda s: F.translate(s, "（）", "()")
    asked = c.select("c_custkey", half(F.concat(F.lit("（"), "c_name", F.lit("）"))).alias("bare"))
    keys = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("("), "c_name", F.lit(")")).alias("bare")).distinct().withColumn("known", F.lit(True))
    return asked.join(keys, "bare", "left").select("c_custkey", "bare", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE AS year_before, (o_orderdate::DATE + INTERVAL 2 YEAR)::DATE AS two_later FROM orders""")
def date_shift(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", estimate.shifted(day, -1).alias("year_before"), estimate.shifted(day, 2).alias("two_later"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '\\\\[nrtu](3000)?', '', 'g'), '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', '', 'g')) AS h FROM documents""")
def normalized_texts(spark, d):
    """Texts without white space of any kind, by digest."""
    return table(spark, d, "documents").select("doc_id", F.md5(normalized(F.coalesce("text", F.lit("")))).alias("h"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (n_chars < 500) AS short_before, count(*) FILTER (n_chars < 500 AND doc_id % 4 <> 0) AS short_after, round(avg((n_chars < 500)::INT), 9) AS before_share, round(avg((n_chars < 500 AND doc_id % 4 <> 0)::INT), 9) AS after_share FROM documents GROUP BY source""")
def coverage_before_after(spark, d):
    """How many rows a field covers before and after a fill, by group."""
    docs = table(spark, d, "documents")
    before, after = F.col("n_chars") < 500, (F.col("n_chars") < 500) & (F.col("doc_id") % 4 != 0)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(before).alias("short_before"), F.count_if(after).alias("short_after"), F.round(summary.share(before), 9).alias("before_share"), F.round(summary.share(after), 9).alias("after_share"))


# ---- samples

FRAME_SQL = """f AS (SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1997-01-01' THEN 'P0' WHEN o_orderdate < DATE '1999-01-01' THEN 'P1' ELSE 'P2' END || CASE WHEN o_custkey % 5 = 0 THEN '_pilot' ELSE '_nonpilot' END AS stratum, o_orderpriority = '1-URGENT' AS urgent, o_totalprice > 200000 AS dear FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('20240-main-' || o_orderkey), o_orderkey) AS draw, count(*) OVER (PARTITION BY stratum) AS size FROM f),
main AS (SELECT * FROM r WHERE draw <= 30),
s1 AS (SELECT * FROM f WHERE urgent AND o_orderkey NOT IN (SELECT o_orderkey FROM main) ORDER BY md5('20240-s1-' || o_orderkey), o_orderkey LIMIT 25)"""


def _frame(spark, d):
    o = table(spark, d, "orders")
    return sampling.frame(o, F.col("o_orderdate").cast("date"), [("1997-01-01", "P0"), ("1999-01-01", "P1")], "P2", F.col("o_custkey") % 5 == 0, {"urgent": F.col("o_orderpriority") == "1-URGENT", "dear": F.col("o_totalprice") > 200000}).select("o_orderkey", "period", "stratum", "urgent", "dear")


def _main(spark, d):
    return sampling.stratified(_frame(spark, d), "stratum", 30, Settings("", "").seed_of("main"), "o_orderkey")


@query(f"""WITH {FRAME_SQL} SELECT stratum, count(*) AS n, count(*) FILTER (urgent) AS urgent, count(*) FILTER (dear) AS dear FROM f GROUP BY stratum""")
def sample_frame(spark, d):
    return _frame(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("urgent").alias("urgent"), F.count_if("dear").alias("dear"))


@query(f"""WITH {FRAME_SQL}, n AS (SELECT count(*) FILTER (urgent) AS pop FROM f)
SELECT o_orderkey, stratum, round(1 / (1 - (1 - least(size, 30) / size) * (1 - CASE WHEN urgent THEN 25 / pop ELSE 0 END)), 9) AS weight_combined FROM main, n
UNION ALL SELECT o_orderkey, 'supplement', round(pop / 25, 9) FROM s1, n""")
def supplemented_sample(spark, d):
    """A stratified draw, and 25 more of a population that overlaps the strata, without those drawn; weights of the main draw count both ways in."""
    main, frame = _main(spark, d), _frame(spark, d)
    pool = frame.where("urgent")
    more = sampling.supplement(pool, main, 25, Settings("", "").seed_of("s1"), "o_orderkey")
    size = pool.agg(F.count(F.lit(1)).alias("pop"))  # one row
    p_main, p_more = F.least("stratum_size", F.lit(30)) / F.col("stratum_size"), F.when(F.col("urgent"), 25 / F.col("pop")).otherwise(0.0)
    both = main.crossJoin(size).select("o_orderkey", "stratum", F.round(1 / sampling.inclusion(p_main, p_more), 9).alias("weight_combined"))
    return both.unionByName(more.select("o_orderkey", F.lit("supplement").alias("stratum"), F.round("weight", 9).alias("weight_combined")))


@query(f"""WITH {FRAME_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('20240-audit-' || o_orderkey), o_orderkey) AS k FROM main)
SELECT o_orderkey, stratum, round(least(6, count(*) OVER (PARTITION BY stratum)) / any_value(n1), 9) AS p_second, round(least(6, count(*) OVER (PARTITION BY stratum)) / any_value(size), 9) AS p_total
FROM (SELECT *, (SELECT count(*) FROM main m WHERE m.stratum = a.stratum) AS n1 FROM a WHERE k <= 6) GROUP BY o_orderkey, stratum, size, n1""")
def two_phase_sample(spark, d):
    """Six of each stratum's first draw, with their probabilities among the draw and among the population."""
    main = _main(spark, d)
    second = sampling.stratified(main.select("o_orderkey", "stratum"), "stratum", 6, Settings("", "").seed_of("audit"), "o_orderkey").select("o_orderkey")
    found = sampling.two_phase(main.select("o_orderkey", "stratum", "stratum_size"), second, "stratum", "o_orderkey")
    return found.select("o_orderkey", "stratum", F.round("p_second", 9).alias("p_second"), F.round("p_total", 9).alias("p_total"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY md5('9-' || c_custkey), c_custkey LIMIT 60""")
def shuffled_head(spark, d):
    """The first sixty in drawn order (the report's length)."""
    return table(spark, d, "customer").where("c_acctbal > 0").orderBy(sampling.draw(9, F.col("c_custkey")), "c_custkey").limit(60).select("c_custkey", "c_mktsegment")


# ---- labels over tables

@query("""SELECT conv_id, CASE WHEN max((turn % 5 = 3)::INT) = 1 THEN 'json_error' WHEN max((turn % 5 = 2)::INT) = 1 THEN 'invalid_value' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id""")
def reply_statuses(spark, d):
    """Whether a document's replies could be read and were of the right kind."""
    turn = F.col("turn")
    errors = table(spark, d, "conversations").select("conv_id", F.when(turn % 5 == 3, "json_error").when(turn % 5 == 2, "invalid:x").alias("error"))
    return labels.reply_status(errors, "conv_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN abs(o_orderkey % 7 - o_orderkey % 7 * 1.1) < 0.5 ELSE (o_orderkey % 3)::VARCHAR = (o_orderkey % 4)::VARCHAR END AS same FROM orders""")
def agreeing_values(spark, d):
    k = F.col("o_orderkey")
    even = k % 2 == 0
    a, b = F.when(even, k % 7).otherwise(k % 3).cast("string"), F.when(even, ((k % 7) * F.lit(1.1)).cast("string")).otherwise((k % 4).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", labels.agrees(F.when(even, "term_months").otherwise("x"), a, b).alias("same"))


@query("""SELECT round(sum((hit * 0.1 + miss * 2.0 + o * 8.0) / 1e6 * CASE WHEN isodow(ts) <= 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 2 ELSE 1 END), 8) AS usd, count(*) AS calls FROM (SELECT ts, event_id % 1000 AS hit, event_id % 700 AS miss, event_id % 90 AS o FROM events)""")
def call_costs(spark, d):
    i = F.col("event_id")
    usd = labels.cost(i % 1000, i % 700, i % 90, (0.1, 2.0, 8.0), labels.is_peak(F.col("ts")))
    return table(spark, d, "events").agg(F.round(F.sum(usd), 8).alias("usd"), F.count(F.lit(1)).alias("calls"))


@query("""WITH m AS (SELECT avg(event_id % 1000) AS hit, avg(event_id % 700) AS miss, avg(event_id % 90) AS o FROM events), t AS (SELECT * FROM (VALUES ('full', 5000, 1.0, 1.0), ('header only', 12000, 0.4, 0.3)) AS v(item, docs, i, q)),
p AS (SELECT item, docs, docs * (hit * 0.1 + miss * i * 2.0 + o * q * 8.0) / 1e6 AS usd FROM t, m) SELECT item, docs::BIGINT AS docs, round(usd, 8) AS usd FROM p UNION ALL SELECT 'TOTAL', NULL, round(sum(usd), 8) FROM p""")
def cost_projection(spark, d):
    """What planned runs will cost, by the mean tokens of the calls made."""
    i = F.col("event_id")
    calls = table(spark, d, "events").select((i % 1000).alias("hit"), (i % 700).alias("miss"), (i % 90).alias("out"))
    return labels.projected_cost(calls, [("full", 5000, 1.0, 1.0), ("header only", 12000, 0.4, 0.3)], (0.1, 2.0, 8.0)).withColumn("usd", F.round("usd", 8))


@query("""SELECT * FROM (VALUES ('status_at_judgment', 'choice', '在押;取保;监视居住;NA'), ('term_months', 'number', NULL), ('origin_text', 'text', NULL)) AS t(field, kind, allowed)""")
def codebook(spark, d):
    """The form's fields as a table, from which replies are checked; a prompt's name carries its version."""
    return labels.codebook(spark).where(F.col("field").isin("status_at_judgment", "term_months", "origin_text")).select("field", "kind", F.array_join("allowed", ";").alias("allowed"))


@query("""SELECT 'extract' AS prompt, 2 AS version, 'extract_v2' AS name UNION ALL SELECT 'adjudicate', 1, 'adjudicate_v1'""")
def prompt_versions(spark, d):
    rows = spark.createDataFrame([("extract_v1", "a"), ("extract_v2", "b"), ("adjudicate_v1", "c")], "name string, text string")
    return labels.latest_prompts(rows).select("prompt", "version", "name")
