"""Queries of the estimators over the panel of the trade tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paneloom.operators import design, estimate
from paneloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def panel(spark, d):
    return design.trade_panel(table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer"))


PANEL_SQL = """p AS (SELECT 'c' || lpad(c_nationkey::VARCHAR, 2, '0') AS city, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, (l_returnflag = 'R')::INT AS migrant, (c_nationkey < 7)::INT AS pilot, l_extendedprice / 1000 AS y, l_quantity AS x
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {PANEL_SQL}, m AS (SELECT city, avg(y) AS my, avg(x) AS mx FROM p GROUP BY city), c AS (SELECT city, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, count(*) AS k FROM p JOIN m USING (city) GROUP BY city),
t AS (SELECT sum(xy) / sum(xx) AS slope, sum(xx) AS sxx, sum(k)::DOUBLE AS n, count(*)::DOUBLE AS g FROM c)
SELECT round(slope, 8) AS slope, round(sqrt(sum((xy - slope * xx) * (xy - slope * xx))) / sxx * sqrt(g / (g - 1) * (n - 1) / (n - 2)), 8) AS se, any_value(t.n)::BIGINT AS n FROM c, t GROUP BY slope, sxx, t.n, g""")
def fe_within_slope(spark, d):
    return estimate.within_slope(panel(spark, d), "y", "x", "city", "city").select(F.round("slope", 8).alias("slope"), F.round("se", 8).alias("se"), "n")


@query(f"""WITH {PANEL_SQL}, c AS (SELECT city, pilot, q, avg(CASE WHEN migrant = 0 THEN y END) AS l, avg(CASE WHEN migrant = 1 THEN y END) AS m FROM p GROUP BY ALL)
SELECT city, pilot, q, round(m - l, 6) AS gap FROM c WHERE m IS NOT NULL AND l IS NOT NULL""")
def csdid_cells(spark, d):
    return estimate.cohort_cells(panel(spark, d)).select("city", "pilot", "q", F.round("gap", 6).alias("gap"))


@query(f"""WITH {PANEL_SQL}, c AS (SELECT city, pilot, q, avg(CASE WHEN migrant = 0 THEN y END) AS l, avg(CASE WHEN migrant = 1 THEN y END) AS m FROM p GROUP BY ALL),
g AS (SELECT city, pilot, q, m - l AS gap FROM c WHERE m IS NOT NULL AND l IS NOT NULL), b AS (SELECT city, max_by(gap, q) AS base FROM g WHERE q < '1998Q1' GROUP BY city)
SELECT q, round(avg(CASE WHEN pilot = 1 THEN gap - base END) - avg(CASE WHEN pilot = 0 THEN gap - base END), 6) AS att FROM g JOIN b USING (city) GROUP BY q HAVING att IS NOT NULL""")
def csdid_att(spark, d):
    return estimate.group_time_effects(estimate.cohort_cells(panel(spark, d)), "1998Q1").select("q", F.round("att", 6).alias("att"))


@query()
def triple_diff(spark, d):
    return estimate.tidy(spark, estimate.triple_diff(panel(spark, d), controls=("x",)))


@query()
def event_study(spark, d):
    df, names = estimate.event_design(with_time(panel(spark, d)), -1, (-4, 4))
    return estimate.tidy(spark, estimate.ols(estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city"), "y", names))


@query()
def wild_bootstrap(spark, d):
    df, names = estimate.add_design(panel(spark, d))
    g = estimate.grams(df, ["y"], [*names, "x"], "city_mig", "q_mig", "city", singletons=False)
    signs = estimate.draws(g.clusters, 999)
    tested = [n for n in names if n.endswith("_mig")]
    found = [estimate.restricted_t(g, "y", [*names, "x"], n, signs) for n in tested]
    step = estimate.romano_wolf([t for t, _ in found], np.stack([s for _, s in found]))
    rows = [(n, round(t, 8), round(estimate.wild_p(t, s), 6), round(p, 6)) for n, (t, s), p in zip(tested, found, step, strict=True)]
    return spark.createDataFrame(rows, "param string, t double, p_wild double, p_step_down double")


@query()
def gelbach(spark, d):
    df, names = estimate.add_design(panel(spark, d))
    g = estimate.grams(df, ["y"], [*names, "x", "x2"], "city_mig", "q_mig", "city")
    found = estimate.gelbach(g, "y", names, {"quantity": ["x"], "discount": ["x2"]}, "pilot_P2_mig")
    return spark.createDataFrame([(k, round(v, 8)) for k, v in found.items()], "part string, moved double")


def _controls(df):
    """The controls and their pairwise interactions."""
    return df.withColumn("x_sq", F.col("x") * F.col("x")).withColumn("x_x2", F.col("x") * F.col("x2")).withColumn("x2_sq", F.col("x2") * F.col("x2")), ["x", "x2", "x_sq", "x_x2", "x2_sq"]


@query()
def double_selection(spark, d):
    df, names = estimate.add_design(panel(spark, d))
    df, controls = _controls(df)
    g = estimate.grams(df, ["y"], [*names, *controls], "city_mig", "q_mig", "city", singletons=False)
    return estimate.tidy(spark, estimate.double_selection(g, "y", "pilot_P2_mig", controls, [n for n in names if n != "pilot_P2_mig"]), 6)


@query(f"""WITH {PANEL_SQL}, m AS (SELECT city, avg(y) AS my, avg(x) AS mx FROM p GROUP BY city), c AS (SELECT city, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, count(*) AS k FROM p JOIN m USING (city) GROUP BY city),
t AS (SELECT sum(xy) / sum(xx) AS slope, sum(xx) AS sxx, sum(k)::DOUBLE AS n, count(*)::DOUBLE AS g FROM c)
SELECT round((1.959964 + 0.841621) * sqrt(sum((xy - slope * xx) * (xy - slope * xx))) / sxx * sqrt(g / (g - 1) * (n - 1) / (n - 2)), 8) AS mde FROM c, t GROUP BY slope, sxx, t.n, g""")
def mde(spark, d):
    s = estimate.within_slope(panel(spark, d), "y", "x", "city", "city")
    return s.select(F.round(F.lit(1.959964 + 0.841621) * F.col("se"), 8).alias("mde"))


@query()
def dml_plr(spark, d):
    df, names = estimate.add_design(panel(spark, d))
    df, controls = _controls(df)
    g = estimate.grams(df, ["y"], [*names, *controls], "city_mig", "q_mig", "city", singletons=False)
    return estimate.tidy(spark, estimate.dml_plr(g, "y", "pilot_P2_mig", controls, [n for n in names if n != "pilot_P2_mig"]), 6)


@query()
def ipw_fit(spark, d):
    """The propensity has the effects of city and quarter."""
    rows = panel(spark, d).withColumn("observed", (F.col("x2") < 0.06).cast("int")).withColumn("xs", (F.col("x") - 25) / 15)
    weighted = estimate.inverse_probability(rows, "observed", ["xs", "migrant"], ("city", "q")).where("observed = 1")
    df, names = estimate.add_design(weighted)
    return estimate.tidy(spark, estimate.ols(estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city", "weight"), "y", names), 6)


def with_time(rows, first: tuple[int, int] = (1998, 1)):
    """rel: quarters since the first treated one."""
    year, quarter = F.substring("q", 1, 4).cast("int"), F.substring("q", 6, 1).cast("int")
    return rows.withColumn("rel", year * 4 + quarter - (first[0] * 4 + first[1]))


@query()
def event_study_simple(spark, d):
    """One group, effects of city and quarter."""
    df, names = estimate.simple_event_design(with_time(panel(spark, d).where("migrant = 1")), -1, (-4, 4))
    return estimate.tidy(spark, estimate.ols(estimate.grams(df, ["y"], names, "city", "q", "city"), "y", names))


@query()
def placebo_triple_diff(spark, d):
    """The triple difference as if every date of the reform had been a year earlier, before the first true one."""
    rows = panel(spark, d).where("period = 'P0'").withColumn("day", F.to_date(F.concat(F.substring("q", 1, 4), F.lit("-"), F.lpad(((F.substring("q", 6, 1).cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01"))))
    moved = rows.withColumn("period", design.period(estimate.shifted(F.col("day"), 1), [("1998-01-01", "P0"), ("1999-06-01", "P1")], "P2"))
    df, names = estimate.add_design(moved, ("P1",))
    return estimate.tidy(spark, estimate.ols(estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city", singletons=False), "y", names))


@query()
def split_wald(spark, d):
    """The effect of a period by two groups of rows, and the test that they are the same."""
    df, names = estimate.add_design(panel(spark, d).withColumn("local", (F.col("x") > 25).cast("int")))
    df = df.withColumn("pilot_P2_mig_local", F.col("pilot_P2_mig") * F.col("local")).withColumn("pilot_P2_mig_other", F.col("pilot_P2_mig") * (1 - F.col("local")))
    xs = [*[n for n in names if n != "pilot_P2_mig"], "pilot_P2_mig_local", "pilot_P2_mig_other", "local"]
    fit = estimate.ols(estimate.grams(df, ["y"], xs, "city_mig", "q_mig", "city", singletons=False), "y", xs)
    stat, k, p = estimate.wald(fit, [{"pilot_P2_mig_local": 1.0, "pilot_P2_mig_other": -1.0}])
    by = {r[0]: r for r in fit.rows()}
    rows = [(n, round(by[n][1], 8), round(by[n][2], 8), round(by[n][4], 8)) for n in ("pilot_P2_mig_local", "pilot_P2_mig_other")]
    return spark.createDataFrame([*rows, ("equal", round(stat, 8), float(k), round(p, 8))], "param string, value double, se double, p double")


@query()
def composition_did(spark, d):
    """Whether the share of returned goods moved in the pilots: cells of city and quarter, weighted by their rows."""
    cells = panel(spark, d).groupBy("city", "pilot", "q", "period").agg(F.avg("migrant").alias("share"), F.count(F.lit(1)).cast("double").alias("w"))
    names = []
    for p in ("P1", "P2", "P3"):
        cells = cells.withColumn(f"pilot_{p}", ((F.col("pilot") == 1) & (F.col("period") == p)).cast("double"))
        names.append(f"pilot_{p}")
    return estimate.tidy(spark, estimate.ols(estimate.grams(cells, ["share"], names, "city", "q", "city", "w"), "share", names))


@query()
def robustness_triple_diff(spark, d):
    """One coefficient in several variants of the model, with what they have in common."""
    df, names = estimate.add_design(panel(spark, d))
    runs = {}
    for name, rows, extra in (("base", df, []), ("quantity", df, ["x"]), ("both", df, ["x", "x2"]), ("small", df.where("x <= 40"), ["x"])):
        runs[name] = estimate.ols(estimate.grams(rows, ["y"], [*names, *extra], "city_mig", "q_mig", "city", singletons=False), "y", [*names, *extra])
    found = estimate.variants(spark, runs, "pilot_P2_mig")
    return found.select("variant", F.round("coef", 8).alias("coef"), F.round("p", 8).alias("p"), "n")


SLOPES = {"all": "TRUE", "many": "l_quantity > 10", "cheap": "l_discount < 0.05", "returned": "l_returnflag = 'R'"}


def _slope_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS variant, slope, sqrt(sum((xy - slope * xx) * (xy - slope * xx))) / sxx * sqrt(g / (g - 1) * (n - 1) / (n - 2)) AS se FROM (
SELECT *, sum(xy) OVER () / sum(xx) OVER () AS slope, sum(xx) OVER () AS sxx, sum(k) OVER ()::DOUBLE AS n, count(*) OVER ()::DOUBLE AS g FROM (
SELECT f, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, count(*) AS k FROM (SELECT l_suppkey % 20 AS f, l_quantity AS x, l_extendedprice / 1000 AS y, avg(l_quantity) OVER (PARTITION BY l_suppkey % 20) AS mx, avg(l_extendedprice / 1000) OVER (PARTITION BY l_suppkey % 20) AS my FROM lineitem WHERE {where}) GROUP BY f)) GROUP BY slope, sxx, n, g"""


@query(f"""WITH v AS ({' UNION ALL '.join(_slope_sql(n, w) for n, w in SLOPES.items())})
SELECT count(*) AS n_variants, round(min(slope), 8) AS lowest, round(max(slope), 8) AS highest, count(*) FILTER (abs(slope / se) > 1.96) AS n_significant, min(sign(slope)) = max(sign(slope)) AS all_same_sign FROM v""")
def robustness_slopes(spark, d):
    """A slope within twenty groups in four sets of rows, and its range."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("f"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), "l_quantity", "l_discount", "l_returnflag")
    found = None
    for name, where in SLOPES.items():
        one = estimate.within_slope(rows.where(where), "y", "x", "f", "f").select(F.lit(name).alias("variant"), F.col("slope").alias("coef"), F.when(F.abs(F.col("slope") / F.col("se")) > 1.96, 0.0).otherwise(1.0).alias("p"))
        found = one if found is None else found.unionByName(one)
    out = estimate.robustness(found)
    return out.withColumn("lowest", F.round("lowest", 8)).withColumn("highest", F.round("highest", 8))


DYNAMIC_SQL = f"""WITH {PANEL_SQL}, c AS (SELECT city, q, avg(y) FILTER (migrant = 1) - avg(y) FILTER (migrant = 0) AS gap, any_value(CASE WHEN substr(city, 2)::INT < 5 THEN '1997Q3' WHEN substr(city, 2)::INT < 9 THEN '1998Q2' END) AS first FROM p GROUP BY city, q HAVING gap IS NOT NULL),
qs AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS t FROM (SELECT DISTINCT q FROM c)), k AS (SELECT c.*, t, (SELECT count(*) FROM qs WHERE qs.q < c.first) AS g FROM c JOIN qs USING (q)),
cohorts AS (SELECT DISTINCT g FROM k WHERE first IS NOT NULL AND g > 0), base AS (SELECT city, cohorts.g AS bg, gap AS b FROM k, cohorts WHERE t = cohorts.g - 1),
moved AS (SELECT k.city, k.first, k.g, k.t, base.bg, gap - b AS change FROM k JOIN base USING (city) WHERE k.t <> base.bg - 1),
att AS (SELECT bg, t, avg(change) FILTER (first IS NOT NULL AND g = bg) - avg(change) FILTER ((first IS NULL OR g > greatest(t, bg - 1)) AND (first IS NULL OR g <> bg)) AS a, count(*) FILTER (first IS NOT NULL AND g = bg) AS n FROM moved GROUP BY bg, t)
SELECT t - bg AS event, round(sum(a * n) / sum(n), 6) AS att, sum(n)::BIGINT AS n_treated FROM att WHERE a IS NOT NULL GROUP BY event"""


def _dynamic(spark, d):
    n = F.substring("city", 2, 2).cast("int")
    return estimate.staggered(estimate.cohort_cells(panel(spark, d)), F.when(n < 5, "1997Q3").when(n < 9, "1998Q2"))


@query(DYNAMIC_SQL)
def csdid_dynamic(spark, d):
    """Two adoption dates, by quarters since treatment."""
    found = _dynamic(spark, d)
    return spark.createDataFrame([(e, round(float(a), 6), n) for e, a, n in zip(found.events, found.att, found.n_treated.tolist(), strict=True)], "event long, att double, n_treated long")


@query()
def csdid_bands(spark, d):
    """Its standard errors and band from 999 draws of multipliers."""
    found = _dynamic(spark, d)
    se, critical = found.bands()
    return spark.createDataFrame([(e, round(float(a), 6), round(float(s), 6), round(float(a - critical * s), 6), round(float(a + critical * s), 6)) for e, a, s in zip(found.events, found.att, se, strict=True)], "event long, att double, se double, low double, high double")


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, round(max(i + s * l_quantity), 4) AS predicted FROM lineitem, f GROUP BY ALL""")
def case_index(spark, d):
    """A fit to some of the rows, applied to all."""
    rows = estimate.predicted(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], F.col("l_returnflag") == "R")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max("predicted"), 4).alias("predicted"))


@query("""SELECT o_custkey % 25 AS court, year(o_orderdate)::INT AS y, count(DISTINCT o_orderkey % 977) AS n, max(o_orderkey % 977) AS highest, round(least(1, count(DISTINCT o_orderkey % 977) / max(o_orderkey % 977)), 9) AS rate FROM orders GROUP BY ALL""")
def publication_rate(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("court"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 977).alias("serial"))
    return estimate.publication_rates(rows, "court", "y", "serial").withColumn("rate", F.round("rate", 9))


@query("""WITH g AS (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1 HAVING avg((o_totalprice > 240000)::INT) >= 0.5)
SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey SEMI JOIN g USING (c_nationkey) GROUP BY 1""")
def covered_courts(spark, d):
    """Rows of the nations that were well covered early on."""
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return estimate.well_covered(rows, "c_nationkey", F.col("o_totalprice") > 240000, F.col("o_orderdate") < design.date("1997-01-01")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT l_returnflag, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS o, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 2 WHEN 1 THEN l_quantity + 0.25 WHEN 2 THEN l_quantity - 1 ELSE l_quantity END AS n FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg((abs(o - n) < 0.5)::INT), 9) AS same, round(avg((n = 2 * o)::INT), 9) AS doubled, round(avg((n > o)::INT), 9) AS greater, round(avg((n < o)::INT), 9) AS less FROM v WHERE o IS NOT NULL GROUP BY 1""")
def old_new_shares(spark, d):
    """How two versions of a number compare."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    new = F.when(k % 4 == 0, q * 2).when(k % 4 == 1, q + 0.25).when(k % 4 == 2, q - 1).otherwise(q)
    found = estimate.version_shares(table(spark, d, "lineitem"), "l_returnflag", F.when(k != 3, q), new)
    return found.select("l_returnflag", "n", *[F.round(c, 9).alias(c) for c in ("same", "doubled", "greater", "less")])


@query("""SELECT count(*) AS n, round(avg(quality), 9) AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL""")
def complete_rows(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return estimate.complete_cases(rows, ["quality", "toxic", "lang"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 9).alias("quality"))
