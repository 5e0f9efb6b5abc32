"""Queries over the driver's tables: relational core, sampling, design and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators import compare, dedup, design, labels, sampling, summary
from paneloom.sources import tables
from paneloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("""
WITH f AS (SELECT d.*, l.quality, l.toxic, md5(coalesce(text, '')) AS h FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY h) AS dup FROM f)
SELECT lang, count(*) AS n, sum(dup::INT)::BIGINT AS n_dup, sum((NOT dup AND NOT coalesce(source IN ('src0', 'src1'), false))::INT)::BIGINT AS n_universe,
 round(avg(CASE WHEN NOT dup THEN quality END), 6) AS quality_rate, round(avg(CASE WHEN NOT dup THEN toxic END), 6) AS toxic_rate
FROM g GROUP BY lang""")
def universe_rates(spark, d):
    rows = dedup.exact_duplicates(table(spark, d, "documents"), "text").join(table(spark, d, "labels"), "doc_id", "left")
    fresh = ~F.col("dup_exact")
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("dup_exact").cast("long")).alias("n_dup"),
        F.sum((fresh & dedup.not_among(F.col("source"), ["src0", "src1"])).cast("long")).alias("n_universe"),
        F.round(F.avg(F.when(fresh, F.col("quality"))), 6).alias("quality_rate"),
        F.round(F.avg(F.when(fresh, F.col("toxic"))), 6).alias("toxic_rate"),
    )


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (7, 3, 3, 11, 150, 999999) ORDER BY doc_id""")
def scan_multi_get(spark, d):
    return tables.multi_get(table(spark, d, "documents"), [7, 3, 3, 11, 150, 999999], ["lang", "n_chars"])


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id""")
def scan_keyed_semi(spark, d):
    return tables.multi_get(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1").select("doc_id"), ["lang", "n_chars"])


@query("""SELECT count(*) AS n FROM benchmark WHERE FALSE""")
def scan_empty_ids(spark, d):
    return tables.multi_get(table(spark, d, "documents"), []).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, sum(dup::INT)::BIGINT AS n_dup, max(CASE WHEN NOT dup THEN l_extendedprice END) AS kept_price FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) > 1 AS dup FROM lineitem) GROUP BY 1, 2""")
def dup_flags(spark, d):
    rows = dedup.keep_longest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_shipdate")], "dup", "l_partkey")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dup").cast("long")).alias("n_dup"), F.max(F.when(~F.col("dup"), F.col("l_extendedprice"))).alias("kept_price"))


@query("""SELECT * FROM (SELECT 0 AS step_no, 'all' AS step, count(*) AS n FROM orders UNION ALL
SELECT 1, 'dated', count(*) FROM orders WHERE o_orderdate >= DATE '1996-01-01' UNION ALL
SELECT 2, 'not_failed', count(*) FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND NOT coalesce(o_orderstatus IN ('F'), false) UNION ALL
SELECT 3, 'urgent', count(*) FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND NOT coalesce(o_orderstatus IN ('F'), false) AND o_orderpriority LIKE '1%')""")
def universe_counts(spark, d):
    return dedup.flow(table(spark, d, "orders"), [("all", F.lit(True)), ("dated", F.col("o_orderdate") >= design.date("1996-01-01")), ("not_failed", dedup.not_among(F.col("o_orderstatus"), ["F"])), ("urgent", F.col("o_orderpriority").startswith("1"))])


@query("""SELECT lang, count(*) AS n, avg((toxic IS NULL)::INT) AS null_share, round(avg(CASE WHEN quality = 1 THEN (toxic = 1)::INT END), 6) AS toxic_if_good
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def null_share_by_group(spark, d):
    return docs_labels(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), summary.share_null(F.col("toxic")).alias("null_share"), F.round(summary.share_where(F.col("toxic") == 1, F.col("quality") == 1), 6).alias("toxic_if_good"))


@query("""SELECT count(DISTINCT (source, toxic)) AS pairs, count(DISTINCT (lang, quality, toxic)) AS triples, count(DISTINCT md5(text)) AS texts FROM documents LEFT JOIN labels USING (doc_id)""")
def tuple_distinct(spark, d):
    return docs_labels(spark, d).agg(summary.distinct_tuples("source", "toxic").alias("pairs"), summary.distinct_tuples("lang", "quality", "toxic").alias("triples"), F.count_distinct(F.md5("text")).alias("texts"))


@query("""SELECT lang, median(n_chars) AS med, quantile_cont(n_chars, 0.01) AS q01, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.99) AS q99, max(n_chars) AS longest,
(SELECT mode(lang) FROM documents) AS top_lang FROM documents GROUP BY lang""")
def mode_median_quantiles(spark, d):
    docs = table(spark, d, "documents")
    out = docs.groupBy("lang").agg(F.median("n_chars").alias("med"), summary.quantiles("n_chars", [0.01, 0.25, 0.99]).alias("q"), F.max("n_chars").alias("longest"))
    return out.select("lang", "med", F.col("q")[0].alias("q01"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q99"), "longest").crossJoin(docs.agg(F.mode("lang", True).alias("top_lang")))  # one row


@query("""SELECT dayofweek(ts)::BIGINT AS dow, sum((event_type = 'click')::INT)::BIGINT AS click, sum((event_type = 'view')::INT)::BIGINT AS "view", sum((event_type = 'purchase')::INT)::BIGINT AS purchase FROM events GROUP BY 1""")
def crosstab_pivot(spark, d):
    return summary.crosstab(table(spark, d, "events"), (F.dayofweek("ts") - 1).cast("long").alias("dow"), "event_type", ["click", "view", "purchase"])


@query("""SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type""")
def share_of_total(spark, d):
    return summary.shares_of_total(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("""WITH h AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1)
SELECT source, count(*) AS n, round(avg((h.n > 1)::INT), 9) AS dup_share, max(h.n) AS largest FROM documents JOIN h ON md5(text) = h GROUP BY source""")
def dup_group_share(spark, d):
    docs = table(spark, d, "documents").select("source", F.md5("text").alias("h"))
    sized = docs.join(docs.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "h")
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(summary.share(F.col("size") > 1), 9).alias("dup_share"), F.max("size").alias("largest"))


@query("""SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1, 2""")
def group_means_sd(spark, d):
    return table(spark, d, "orders").groupBy(design.quarter_name(F.col("o_orderdate")).alias("q"), "o_orderpriority").agg(F.count("o_totalprice").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


@query("""SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg((toxic IS NOT NULL)::INT), 9) AS has_toxic, round(avg((text LIKE '%the %')::INT), 9) AS share_the FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang) HAVING count(*) >= 100""")
def rollup_all_row(spark, d):
    out = summary.coverage(docs_labels(spark, d), "lang", ["toxic"], {"the": F.col("text").like("%the %")}).where("n >= 100")
    return out.select("lang", "n", F.round("has_toxic", 9).alias("has_toxic"), F.round("share_the", 9).alias("share_the"))


@query("""SELECT l_returnflag, 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1 UNION ALL
SELECT l_returnflag, 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) FROM lineitem GROUP BY 1""")
def balance_long(spark, d):
    out = summary.long_means(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])
    return out.select("l_returnflag", "variable", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS w_mean FROM lineitem GROUP BY 1""")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(summary.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("w_mean"))


@query("""SELECT year(o_orderdate)::BIGINT AS y, round(sum(l_extendedprice) / sum(o_totalprice), 8) AS ratio_of_sums, round(avg(l_extendedprice / o_totalprice), 6) AS mean_ratio FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def ratio_of_sums(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum("l_extendedprice") / F.sum("o_totalprice"), 8).alias("ratio_of_sums"), F.round(F.avg(F.col("l_extendedprice") / F.col("o_totalprice")), 6).alias("mean_ratio"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types FROM events GROUP BY user_id""")
def sorted_set_concat(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(summary.set_concat("event_type").alias("types"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, source FROM documents)
SELECT 'lang' AS col_name, count(*) AS n, round(avg((d.lang IS NOT DISTINCT FROM b.lang)::INT), 9) AS match_rate FROM documents d JOIN b USING (doc_id) UNION ALL
SELECT 'source', count(*), round(avg((d.source IS NOT DISTINCT FROM b.source)::INT), 9) FROM documents d JOIN b USING (doc_id) UNION ALL
SELECT 'n_chars', count(*), round(avg((abs(d.n_chars - b.n_chars) <= 1e-8 + 1e-5 * abs(b.n_chars))::INT), 9) FROM documents d JOIN b USING (doc_id)""")
def align_positional(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return compare.alignment(docs, other, "doc_id", ["lang", "source"], ["n_chars"]).withColumn("match_rate", F.round("match_rate", 9))


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_totalprice > 50000), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_totalprice < 300000)
SELECT sum((a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL)::INT)::BIGINT AS n_both, sum((a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.v IS DISTINCT FROM b.v)::INT)::BIGINT AS n_changed,
sum((b.o_orderkey IS NULL)::INT)::BIGINT AS n_gained, sum((a.o_orderkey IS NULL)::INT)::BIGINT AS n_lost FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey""")
def before_after_diff(spark, d):
    o = table(spark, d, "orders")
    return compare.before_after(o.where("o_totalprice > 50000"), o.where("o_totalprice < 300000").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('20240-' || c_custkey), c_custkey) AS draw, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer)
SELECT c_mktsegment, c_custkey, draw::BIGINT AS draw, round(size / least(size, 40), 6) AS weight FROM r WHERE draw <= 40""")
def stratified_sample(spark, d):
    s = sampling.stratified(table(spark, d, "customer"), "c_mktsegment", 40, 20240, "c_custkey")
    return s.select("c_mktsegment", "c_custkey", F.col("draw").cast("long").alias("draw"), F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), b AS (SELECT *, floor(151 * size / sum(size) OVER ())::BIGINT AS base, row_number() OVER (ORDER BY md5('20240-' || c_mktsegment), c_mktsegment) AS o FROM s)
SELECT c_mktsegment, size, base + (o <= 151 - sum(base) OVER ())::INT::BIGINT AS n FROM b""")
def proportional_alloc(spark, d):
    return sampling.proportional(table(spark, d, "customer"), "c_mktsegment", 151, 20240)


@query("""SELECT doc_id, (('0x' || substr(md5('20240-' || doc_id || '-' || lang), 1, 1))::INT % 2) = 1 AS reversed FROM documents""")
def blind_order(spark, d):
    return table(spark, d, "documents").select("doc_id", sampling.blind_order(20240, F.col("doc_id"), F.col("lang")).alias("reversed"))


@query("""WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), b AS (SELECT c_custkey FROM customer WHERE c_custkey % 15 = 0), f AS (SELECT c_custkey FROM customer WHERE c_custkey % 20 <> 0)
SELECT 'repeated' AS "check", 0::BIGINT AS n UNION ALL SELECT 'overlap', count(*) FROM a SEMI JOIN b USING (c_custkey) UNION ALL SELECT 'outside', count(*) FROM a ANTI JOIN f USING (c_custkey)""")
def sample_integrity(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return sampling.violations(c.where("c_custkey % 10 = 0"), c.where("c_custkey % 15 = 0"), c.where("c_custkey % 20 <> 0"), "c_custkey")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, role, turn, text FROM n WHERE r = 1""")
def calls_upsert_keep_last(spark, d):
    c = table(spark, d, "conversations")
    cut = F.col("turn") < 2
    return tables.keep_last(tables.upsert(c.where(cut), c.where(~cut), ["conv_id", "role", "turn"]), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "text")


@query("""SELECT CASE WHEN o_orderdate < DATE '1997-01-01' THEN 'P0' WHEN o_orderdate < DATE '1998-07-01' THEN 'P1' WHEN o_orderdate < DATE '2000-01-01' THEN 'P2' ELSE 'P3' END AS period, count(*) AS n, sum((o_orderkey IS NULL)::INT)::BIGINT AS n_null
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def period_assign(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    p = design.period(F.col("o_orderdate").cast("date"), [("1997-01-01", "P0"), ("1998-07-01", "P1"), ("2000-01-01", "P2")], "P3")
    return j.groupBy(p.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").isNull().cast("long")).alias("n_null"))


@query("""WITH m AS (SELECT o_orderkey, o_orderdate::DATE AS d, (year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 6 - (day(o_orderdate) < 15)::INT AS m FROM orders)
SELECT o_orderkey, m::INT AS event_time_m, floor(m / 3)::INT AS event_time_q, year(d) || 'Q' || quarter(d) AS q FROM m""")
def event_time(spark, d):
    day = F.col("o_orderdate").cast("date")
    m = design.whole_months(design.date("1998-06-15"), day)
    return table(spark, d, "orders").select("o_orderkey", m.alias("event_time_m"), design.quarters(m).alias("event_time_q"), design.quarter_name(day).alias("q"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, coalesce(n_nationkey < 7, false) AS pilot FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, CASE WHEN pilot THEN DATE '1997-03-10' ELSE DATE '1999-01-01' END AS treat_start FROM t)
SELECT pilot, count(*) AS n, sum((pilot AND d >= DATE '1997-03-10')::INT)::BIGINT AS post_pilot, sum((d >= DATE '1999-01-01')::INT)::BIGINT AS post_national,
sum((CASE WHEN pilot THEN d >= DATE '1997-03-10' ELSE d >= DATE '1999-01-01' END)::INT)::BIGINT AS post,
sum((year(d) - year(treat_start)) * 12 + month(d) - month(treat_start) - (day(d) < day(treat_start))::INT)::BIGINT AS months FROM s GROUP BY pilot""")
def treatment_status(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.select(F.col("o_orderdate").cast("date").alias("d"), F.coalesce(F.col("n_nationkey") < 7, F.lit(False)).alias("pilot"))
    t = design.treatment(j, "d", F.col("pilot"), "1997-03-10", "1999-01-01", "1997-03-10")
    total = lambda c: F.sum(F.col(c).cast("long"))
    return t.groupBy("pilot").agg(F.count(F.lit(1)).alias("n"), total("post_pilot").alias("post_pilot"), total("post_national").alias("post_national"), total("post").alias("post"), total("event_time_m").alias("months"))


@query("""WITH a AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, lang FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, a, b, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT lang, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c GROUP BY lang),
ra AS (SELECT lang, a AS k, sum(n) AS na FROM c GROUP BY 1, 2), rb AS (SELECT lang, b AS k, sum(n) AS nb FROM c GROUP BY 1, 2),
pe AS (SELECT lang, sum(na * nb)::DOUBLE AS pe FROM ra JOIN rb USING (lang, k) GROUP BY lang)
SELECT lang, n::BIGINT AS n, round(same / n, 8) AS agree, round((same / n - coalesce(pe, 0) / (n * n)) / (1 - coalesce(pe, 0) / (n * n)), 8) AS kappa FROM t LEFT JOIN pe USING (lang)""")
def kappa_agreement(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return labels.kappa(j, ["lang"], "a", "b").select("lang", "n", F.round("agree", 8).alias("agree"), F.round("kappa", 8).alias("kappa"))


@query("""WITH b AS (SELECT (n_chars > 1000) AS r, (lang = 'en') AS a, (text LIKE '%the %') AS b FROM documents)
SELECT CASE WHEN r = a AND a = b THEN 'all' WHEN r = a THEN 'rule_a' WHEN r = b THEN 'rule_b' WHEN a = b THEN 'a_b' ELSE 'differ' END AS pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY 1""")
def pattern_three_way(spark, d):
    docs = table(spark, d, "documents").select(labels.pattern(F.col("n_chars") > 1000, F.col("lang") == "en", F.col("text").like("%the %")).alias("pattern"))
    return summary.shares_of_total(docs, "pattern").withColumn("share", F.round("share", 9))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS rule, CASE WHEN toxic = 1 THEN 'NA' WHEN quality IS NULL THEN NULL ELSE lang END AS a, CASE WHEN toxic = 1 THEN 'NA' WHEN quality = 0 THEN 'xx' WHEN quality IS NULL THEN NULL ELSE lang END AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN rule IS NOT NULL THEN 'rule' WHEN a = b AND a <> 'NA' THEN 'models' WHEN a IS NULL OR b IS NULL THEN 'llm_missing' WHEN a = 'NA' AND b = 'NA' THEN 'both_NA' ELSE 'unresolved_llm' END AS source,
count(*) AS n, count(coalesce(rule, CASE WHEN a = b AND a <> 'NA' THEN a END)) AS n_value FROM b GROUP BY 1""")
def hybrid_fill(spark, d):
    j = docs_labels(spark, d)
    t, q, lang = F.col("toxic"), F.col("quality"), F.col("lang")
    a = F.when(t == 1, "NA").when(q.isNotNull(), lang)
    b = F.when(t == 1, "NA").when(q == 0, "xx").when(q.isNotNull(), lang)
    value, source = labels.fill(F.when(F.col("doc_id") % 3 != 0, lang), a, b)
    return j.select(value.alias("v"), source.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_value"))


@query("""WITH c AS (SELECT doc_id, (ARRAY['1', '2', 'other', 'x'])[doc_id % 4 + 1] AS choice, (('0x' || substr(md5('7-' || doc_id || '-' || lang), 1, 1))::INT % 2) = 1 AS r FROM documents)
SELECT CASE WHEN choice = '1' THEN CASE WHEN r THEN 'model' ELSE 'rule' END WHEN choice = '2' THEN CASE WHEN r THEN 'rule' ELSE 'model' END WHEN choice = 'other' THEN 'third' ELSE 'failed' END AS side, count(*) AS n FROM c GROUP BY 1""")
def adjudicate_side(spark, d):
    docs = table(spark, d, "documents")
    choice = F.element_at(F.array(*map(F.lit, ("1", "2", "other", "x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.groupBy(labels.adjudicated_side(choice, sampling.blind_order(7, F.col("doc_id"), F.col("lang"))).alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT event_id, ts, (value * 10 * (CASE WHEN isodow(ts) <= 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 2 ELSE 1 END)) AS cost FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT count(*) AS n, round(sum(cost), 4) AS total, sum((spent - cost >= 5000)::INT)::BIGINT AS n_over FROM s""")
def cost_ledger(spark, d):
    calls = table(spark, d, "events").where("event_type = 'purchase'").withColumn("cost", F.col("value") * 10 * F.when(labels.is_peak(F.col("ts")), 2).otherwise(1))
    return labels.ledger(calls, ["ts", "event_id"], 5000).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 4).alias("total"), F.sum(F.col("over").cast("long")).alias("n_over"))


@query("""WITH g AS (SELECT l_linestatus, avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag <> 'R') AS m0, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n0,
var_samp(l_quantity) FILTER (l_returnflag = 'R') AS v1, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS v0 FROM lineitem GROUP BY 1)
SELECT l_linestatus, n1 AS n_1, n0 AS n_0, round(m1 - m0, 7) AS gap, round(sqrt(v1 / n1 + v0 / n0), 7) AS se, round(m1 - m0 - 1.96 * sqrt(v1 / n1 + v0 / n0), 7) AS low FROM g""")
def gap_ci(spark, d):
    g = summary.difference_in_means(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_returnflag") == "R", "l_quantity")
    return g.select("l_linestatus", "n_1", "n_0", *[F.round(c, 7).alias(c) for c in ("gap", "se", "low")])


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS n_text FROM pages""")
def html_strip(spark, d):
    from paneloom.functions.text import strip_markup

    return table(spark, d, "pages").select("page_id", F.length(strip_markup(F.col("html"))).cast("long").alias("n_text"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.\n]'), lambda x: trim(x) <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, len(list_filter(s, lambda x: regexp_matches(x, 'the ') AND NOT regexp_matches(x, 'of ')))::BIGINT AS n_pos FROM s""")
def sentence_flags(spark, d):
    from paneloom.functions.text import sentences

    s = sentences(F.col("text"), "[.\\n]")
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("s", lambda x: x.rlike("the ") & ~x.rlike("of "))).cast("long").alias("n_pos"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS n_bare, md5(regexp_replace(text, '[ \t\r\n\f\x0b]+', '', 'g')) AS h FROM documents""")
def text_normalize(spark, d):
    bare = F.regexp_replace("text", "[ \\t\\r\\n\\f\\x0b]+", "")
    return table(spark, d, "documents").select("doc_id", F.length(bare).cast("long").alias("n_bare"), F.md5(bare).alias("h"))


@query("""SELECT doc_id, CASE WHEN strpos(text, 'the ') > 0 THEN substr(text, greatest(strpos(text, 'the ') - 60, 1), least(strpos(text, 'the ') - 1, 60) + 80) END AS snippet FROM documents""")
def snippet_context(spark, d):
    from paneloom.functions.text import snippet

    return table(spark, d, "documents").select("doc_id", snippet(F.col("text"), "the ", 60, 80).alias("snippet"))


@query(r"""SELECT doc_id, coalesce(list_sum(list_transform(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: TRY_CAST(x AS DOUBLE))), 0.0) AS total FROM documents""")
def clause_number_sum(spark, d):
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.aggregate(runs, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 1) UNION ALL
SELECT 'except', count(*) FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 1)""")
def set_operations(spark, d):
    l = table(spark, d, "labels")
    a, b = l.where("toxic = 1").select("doc_id"), l.where("quality = 1").select("doc_id")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.union(b).distinct()).union(one("intersect", a.intersect(b))).union(one("except", a.subtract(b)))


@query("""WITH s AS (SELECT r_name, n_name, count(*) AS n, sum(o_totalprice) AS v FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT r_name, n_name, n, round(v, 2) AS v, row_number() OVER (PARTITION BY r_name ORDER BY v DESC, n_name)::BIGINT AS place FROM s QUALIFY place <= 3""")
def join_chain_top(spark, d):
    from pyspark.sql import Window as W

    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    s = j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    top = s.withColumn("place", F.row_number().over(W.partitionBy("r_name").orderBy(F.desc("v"), "n_name")).cast("long")).where("place <= 3")
    return top.withColumn("v", F.round("v", 2))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT doc_id, text LIKE '%License%' AS license, regexp_matches(text, '[0-9]{4}') AS years, text LIKE '%@%' AS mail, CASE WHEN toxic IS NULL THEN 2.0 ELSE 1.0 END AS w FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'license' AS cue, sum(license::INT)::BIGINT AS n, round(avg(license::INT), 9) AS share, round(sum(license::INT * w) / sum(w), 9) AS w_share, sum(license::INT) < 20 AS few FROM c UNION ALL
SELECT 'years', sum(years::INT)::BIGINT, round(avg(years::INT), 9), round(sum(years::INT * w) / sum(w), 9), sum(years::INT) < 20 FROM c UNION ALL
SELECT 'mail', sum(mail::INT)::BIGINT, round(avg(mail::INT), 9), round(sum(mail::INT * w) / sum(w), 9), sum(mail::INT) < 20 FROM c""")
def cue_battery(spark, d):
    """How often each cue is met, plain and weighted, and whether too seldom to be judged; one pass, then one row a cue."""
    rows = docs_labels(spark, d).withColumn("w", F.when(F.col("toxic").isNull(), 2.0).otherwise(1.0))
    cues = {"license": F.col("text").contains("License"), "years": F.col("text").rlike("[0-9]{4}"), "mail": F.col("text").contains("@")}
    aggs = [a for k, c in cues.items() for a in (F.sum(c.cast("long")).alias(f"n_{k}"), summary.share(c).alias(f"s_{k}"), summary.weighted_mean(c.cast("double"), F.col("w")).alias(f"w_{k}"))]
    long = rows.agg(*aggs).selectExpr(f"stack({len(cues)}, " + ", ".join(f"'{k}', n_{k}, s_{k}, w_{k}" for k in cues) + ") AS (cue, n, share, w_share)")
    return long.select("cue", "n", F.round("share", 9).alias("share"), F.round("w_share", 9).alias("w_share"), (F.col("n") < 20).alias("few"))


@query("""WITH u AS (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN toxic IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'poor' END AS reason FROM documents LEFT JOIN labels USING (doc_id)),
q AS (SELECT doc_id, reason FROM u WHERE reason IS NOT NULL UNION ALL SELECT conv_id, 'conversation' FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'))
SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS docs FROM q GROUP BY reason""")
def work_queue(spark, d):
    """What is unresolved, by the first reason that holds, and what another table adds."""
    reason = F.when(F.col("n_chars") < 100, "short").when(F.col("toxic").isNull(), "unlabelled").when(F.col("quality") == 0, "poor")
    own = docs_labels(spark, d).select("doc_id", reason.alias("reason")).where("reason is not null")
    other = table(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("reason", F.lit("conversation"))
    return own.unionByName(other).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""SELECT event_type, count(*) AS calls, round(sum(value), 4) AS cost, round(avg(value), 6) AS latency, sum((value < 1)::INT)::BIGINT AS failed FROM events GROUP BY ROLLUP (event_type)""".replace("SELECT event_type,", "SELECT coalesce(event_type, 'ALL') AS stage,"))
def cost_by_stage(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "stage")
    aggs = [F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.avg("value"), 6).alias("latency"), F.sum((F.col("value") < 1).cast("long")).alias("failed")]
    return summary.with_total(e, "stage", aggs, "ALL")


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('99-' || doc_id), doc_id) AS i FROM documents) SELECT lang, source, doc_id, i::BIGINT AS draw FROM r WHERE i <= 2""")
def spot_check(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.concat_ws("|", "lang", "source").alias("cell"))
    return sampling.stratified(docs, "cell", 2, 99, "doc_id").select("lang", "source", "doc_id", F.col("draw").cast("long").alias("draw"))


@query("""WITH f AS (SELECT (toxic IS NULL)::INT AS a, (n_chars < 300)::INT AS b, (lang <> 'en')::INT AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT sum(a)::BIGINT AS need_a, sum(b)::BIGINT AS need_b, sum(c)::BIGINT AS need_c, sum((a + b + c > 0)::INT)::BIGINT AS any_need, sum((a + b > 0)::INT)::BIGINT AS without_c FROM f""")
def fill_sizes(spark, d):
    """Sizes of the sets to fill, of their union and of the union without one."""
    a, b, c = F.col("toxic").isNull(), F.col("n_chars") < 300, F.col("lang") != "en"
    n = lambda x: F.sum(x.cast("long"))
    return docs_labels(spark, d).agg(n(a).alias("need_a"), n(b).alias("need_b"), n(c).alias("need_c"), n(a | b | c).alias("any_need"), n(a | b).alias("without_c"))


@query("""SELECT o_orderpriority, round(avg((o_totalprice > 100000)::INT), 9) AS share, round(sum((o_totalprice > 100000)::INT * o_shippriority_w) / sum(o_shippriority_w), 9) AS w_share FROM (SELECT *, 1 + (o_orderkey % 3) AS o_shippriority_w FROM orders) GROUP BY 1""")
def weighted_agreement(spark, d):
    o = table(spark, d, "orders").withColumn("w", 1 + F.col("o_orderkey") % 3)
    big = F.col("o_totalprice") > 100000
    return o.groupBy("o_orderpriority").agg(F.round(summary.share(big), 9).alias("share"), F.round(summary.weighted_mean(big.cast("double"), F.col("w")), 9).alias("w_share"))


@query("""SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1)::BIGINT AS row_id FROM documents""")
def dense_row_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return tables.dense_ids(docs, [F.desc("n_chars"), F.asc("doc_id")], "row_id").select("doc_id", F.col("row_id").cast("long").alias("row_id"))
