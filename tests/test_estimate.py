"""Gram estimators against dense regressions and planted effects."""

import math

import numpy as np
import pandas as pd
import pytest

from paneloom.operators import estimate


@pytest.fixture(scope="module")
def simulated():
    rng = np.random.default_rng(11)
    rows = []
    for c in range(24):
        own, q_effect = rng.normal(), {}
        for t in range(12):
            period = ("P0", "P1", "P2", "P3")[t // 3]
            shock = rng.normal() * 0.1
            for i in range(8):
                m, x = i % 2, rng.normal()
                effect = (c < 8) * {"P0": 0, "P1": 0.02, "P2": 0.04, "P3": 0.06}[period] + (c < 8) * m * {"P0": 0, "P1": -0.5, "P2": -1.2, "P3": 0.3}[period]
                rows.append((f"c{c:02d}", f"q{t:02d}", period, m, int(c < 8), own * (1 + m) + 0.1 * t * (1 + m) + shock + effect + 0.5 * x + rng.normal() * 0.3, x))
    return pd.DataFrame(rows, columns=["city", "q", "period", "migrant", "pilot", "y", "x"])


def dense(pdf, names):
    d = pdf.copy()
    for p in ("P1", "P2", "P3"):
        d[f"pilot_{p}"] = ((d.pilot == 1) & (d.period == p)).astype(float)
        d[f"pilot_{p}_mig"] = d[f"pilot_{p}"] * d.migrant
    dummies = pd.get_dummies(d.city + "_" + d.migrant.astype(str)).to_numpy(float), pd.get_dummies(d.q + "_" + d.migrant.astype(str)).to_numpy(float)
    z = np.hstack([d[names].to_numpy(float), *dummies])
    beta = np.linalg.pinv(z) @ d.y.to_numpy()
    u = d.y.to_numpy() - z @ beta
    fixed = np.hstack(dummies)
    x = d[names].to_numpy(float)
    x = x - fixed @ (np.linalg.pinv(fixed) @ x)
    a = np.linalg.inv(x.T @ x)
    s = np.stack([x[d.city == c].T @ u[d.city == c] for c in sorted(d.city.unique())])
    return beta[: len(names)], a @ (s.T @ s) @ a


def test_triple_difference_equals_dense(spark, simulated):
    df, names = estimate.add_design(spark.createDataFrame(simulated))
    names = [*names, "x"]
    g = estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city")
    fit = estimate.ols(g, "y", names, correction=False)
    beta, v = dense(simulated, names)
    assert fit.beta == pytest.approx(beta, abs=1e-8) and fit.v == pytest.approx(v, abs=1e-10)
    at = [names.index(f"pilot_{p}_mig") for p in ("P1", "P2", "P3")]
    assert np.all(np.abs(fit.beta[at] - [-0.5, -1.2, 0.3]) < 3 * np.sqrt(np.diag(fit.v))[at] + 1e-9)

    signs = estimate.draws(g.clusters, 199)
    t, stars = estimate.restricted_t(g, "y", names, "pilot_P2_mig", signs)
    full = estimate.ols(g, "y", names)
    j = full.names.index("pilot_P2_mig")
    assert t == pytest.approx(full.beta[j] / math.sqrt(full.v[j, j])) and estimate.wild_p(t, stars) < 0.2
    assert all(estimate.t_two_sided(x, df) == pytest.approx(p, abs=1e-6) for x, df, p in ((2.0, 10, 0.0733880), (1.0, 1, 0.5), (-3.5, 23, 0.0019285), (0.0, 5, 1.0)))
    tests = [estimate.restricted_t(g, "y", names, n, signs) for n in ("pilot_P1_mig", "pilot_P2_mig", "pilot_P3_mig")]
    step = estimate.romano_wolf([a for a, _ in tests], np.stack([s for _, s in tests]))
    assert all(p >= estimate.wild_p(a, s) - 1e-9 for p, (a, s) in zip(step, tests, strict=True))

    base = [n for n in names if n != "x"]
    moved = estimate.gelbach(g, "y", base, {"x": ["x"]}, "pilot_P2_mig")
    short = estimate.ols(g, "y", base)
    assert moved["total"] == pytest.approx(short.beta[short.names.index("pilot_P2_mig")] - full.beta[j], abs=1e-9)


def test_dependent_columns_are_left_out():
    x = np.array([[1.0, 2.0, 3.0], [0.5, 1.0, -1.0], [2.0, 4.0, 0.0], [1.0, 2.0, 5.0]])
    assert estimate.independent(x.T @ x) == [0, 2]


def test_rows_alone_in_a_level_are_left_out(spark, simulated):
    odd = simulated.iloc[:1].assign(city="c99", y=100.0)
    df, names = estimate.add_design(spark.createDataFrame(pd.concat([simulated, odd])))
    kept = estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city", singletons=False)
    whole = estimate.grams(estimate.add_design(spark.createDataFrame(simulated))[0], ["y"], names, "city_mig", "q_mig", "city")
    assert kept.n == whole.n == len(simulated) and kept.total == pytest.approx(whole.total, abs=1e-8)
    again = estimate.grams(df.repartition(7), ["y"], names, "city_mig", "q_mig", "city")
    assert again.n == len(simulated) + 1


def test_too_many_levels_are_refused(spark):
    df = spark.range(5000).selectExpr("cast(id % 2 as string) as c", "cast(id as string) as s", "rand(1) as y", "rand(2) as x")
    with pytest.raises(ValueError, match="levels"):
        estimate.grams(df, ["y"], ["x"], "c", "s", "c")
    with pytest.raises(ValueError, match="no rows"):
        estimate.grams(df.where("false"), ["y"], ["x"], "c", None, "c")


def test_simple_event_study_equals_dense(spark, simulated):
    pdf = simulated[simulated.migrant == 1].assign(rel=lambda d: d.q.str[1:].astype(int) - 3)
    df, names = estimate.simple_event_design(spark.createDataFrame(pdf), -1, (-2, 3))
    assert names == ["ev_m2", "ev_p0", "ev_p1", "ev_p2", "ev_p3"]
    fit = estimate.ols(estimate.grams(df, ["y"], names, "city", "q", "city"), "y", names)
    at = pdf.rel.clip(-2, 3)
    x = np.stack([((pdf.pilot == 1) & (at == k)).to_numpy(float) for k in (-2, 0, 1, 2, 3)], axis=1)
    z = np.hstack([x, pd.get_dummies(pdf.city).to_numpy(float), pd.get_dummies(pdf.q).to_numpy(float)])
    assert fit.beta == pytest.approx((np.linalg.pinv(z) @ pdf.y.to_numpy())[:5], abs=1e-8)


def test_weights_equal_repeated_rows(spark, simulated):
    pdf = simulated.assign(w=np.arange(len(simulated)) % 3 + 1.0)
    df, names = estimate.add_design(spark.createDataFrame(pdf))
    many, _ = estimate.add_design(spark.createDataFrame(pdf.loc[pdf.index.repeat(pdf.w.astype(int))]))
    a, b = (estimate.grams(x, ["y"], names, "city_mig", "q_mig", "city", w) for x, w in ((df, "w"), (many, None)))
    assert a.total == pytest.approx(b.total, abs=1e-7) and estimate.ols(a, "y", names).beta == pytest.approx(estimate.ols(b, "y", names).beta, abs=1e-9)


def test_wald_of_one_restriction_is_the_square_of_t(spark, simulated):
    df, names = estimate.add_design(spark.createDataFrame(simulated))
    fit = estimate.ols(estimate.grams(df, ["y"], names, "city_mig", "q_mig", "city"), "y", names)
    _, _, _, t, p, _, _ = next(r for r in fit.rows() if r[0] == "pilot_P2_mig")
    stat, k, p_wald = estimate.wald(fit, [{"pilot_P2_mig": 1.0}])
    assert (stat, k, p_wald) == (pytest.approx(t * t), 1, pytest.approx(p))
    assert estimate.wald(fit, [{"pilot_P1_mig": 1.0, "pilot_P2_mig": -1.0}])[2] < 0.05


def test_lasso_selection_and_partialling_find_the_effect(spark):
    """y depends on the treatment (2), which depends on one control; of twenty controls two matter."""
    rng = np.random.default_rng(8)
    n = 4000
    x = rng.normal(size=(n, 20))
    treat = 0.8 * x[:, 0] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(20)]).assign(treat=treat, y=2 * treat + 1.5 * x[:, 0] - x[:, 1] + rng.normal(size=n), city=[f"c{i % 40}" for i in range(n)], q=[f"q{i % 7}" for i in range(n)])
    g = estimate.grams(spark.createDataFrame(pdf), ["y"], ["treat", *[f"x{i}" for i in range(20)]], "city", "q", "city")
    controls = [f"x{i}" for i in range(20)]
    for fit in (estimate.double_selection(g, "y", "treat", controls), estimate.dml_plr(g, "y", "treat", controls), estimate.double_selection(g, "y", "treat", controls[1:], ["x0"]), estimate.dml_plr(g, "y", "treat", controls[1:], ["x0"])):
        assert fit.names[0] == "treat" and abs(fit.beta[0] - 2) < 0.08 and 0.005 < np.sqrt(fit.v[0, 0]) < 0.05
    part = g.without(["x0"])
    alone = estimate.ols(part, "y", ["treat"])
    both = estimate.ols(g, "y", ["treat", "x0"])
    assert alone.beta[0] == pytest.approx(both.beta[0]) and alone.v[0, 0] == pytest.approx(both.v[0, 0], rel=1e-3)
    # a penalty of nothing is least squares; one above the greatest correlation picks nothing
    assert estimate.lasso(g, "y", controls[:3], 0.0) == pytest.approx(estimate.ols(g, "y", controls[:3]).beta, abs=1e-6)
    assert 0 < estimate.cross_validated(g, "y", controls) < 1


def test_logit_with_effects(spark):
    """Coefficients and probabilities are those of a dense maximum-likelihood fit."""
    rng = np.random.default_rng(6)
    n = 3000
    city, q, x = rng.integers(0, 5, n), rng.integers(0, 4, n), rng.normal(size=n)
    z = -0.4 + 0.3 * city - 0.5 * q + 0.9 * x
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    pdf = pd.DataFrame({"city": city.astype(str), "q": q.astype(str), "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    fit = estimate.logit(df, "y", ["x"], ("city", "q"))
    d = np.hstack([x[:, None], pd.get_dummies(pdf.city).to_numpy(float), pd.get_dummies(pdf.q).to_numpy(float)[:, 1:]])
    b = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        b += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d, d.T @ (y - p))
    assert fit.columns["x"] == pytest.approx(b[0], abs=1e-6) and list(fit.effects["city"].values()) == pytest.approx(b[1:6].tolist(), abs=1e-6) and list(fit.effects["q"]) == ["1", "2", "3"]
    weighted = estimate.inverse_probability(df, "y", ["x"], ("city", "q")).toPandas()
    assert weighted.propensity.to_numpy() == pytest.approx(np.clip(1 / (1 + np.exp(-d @ b)), 0.02, 1), abs=1e-6) and (weighted.weight * weighted.propensity).to_numpy() == pytest.approx(1)
    plain = estimate.logit(df, "y", ["x"])
    assert plain.intercept != 0 and not plain.effects


def test_staggered_effects(spark):
    """Two cohorts with planted effects and no noise; never treated cities are controls throughout."""
    rows = []
    for c in range(9):
        first = 3 if c < 3 else 5 if c < 6 else 99
        for t in range(8):
            rows.append((f"c{c}", f"q{t}", 0.3 * c + 0.1 * t + (t >= first) * (1.0 + 0.5 * (t - first)), None if first == 99 else f"q{first}"))
    cells = spark.createDataFrame(rows, "city string, q string, gap double, first string")
    from pyspark.sql import functions as F

    found = estimate.staggered(cells, F.col("first"))
    effect = dict(zip(found.events, found.att.tolist(), strict=True))
    assert all(effect[e] == pytest.approx(1.0 + 0.5 * e) for e in range(3)) and all(effect[e] == pytest.approx(0, abs=1e-12) for e in effect if e < -1)
    assert dict(zip(found.events, found.n_treated.tolist(), strict=True))[0] == 6 and -1 not in effect
    se, critical = found.bands(99)
    assert np.allclose(se, 0, atol=1e-12) and critical >= 0
