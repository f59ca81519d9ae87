"""Newton steps on aggregated sums, weighted refits and weighted ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsquall.functions import numeric as N
from gridsquall.operators import likelihood as L
from gridsquall.operators import rank as R


def conditional(rng, n, form="exp", t=(0.6, 1.0, 0.3, 0.2, -0.5)):
    x, d = 0.1 + rng.exponential(size=n), rng.uniform(0.05, 5, n)
    f = np.exp(-d / np.exp(t[1])) if form == "exp" else np.maximum(d, L.FLOOR_KM) ** -np.exp(t[1])
    return x, t[0] * f * x + x ** t[2] * (t[3] + np.exp(t[4]) * rng.normal(size=n)), d


@pytest.mark.parametrize("model,p", [(L.heffernan_tawn("exp"), (0.4, 0.7, 0.2, 0.1, -0.3)), (L.heffernan_tawn("pow"), (0.4, -0.7, 0.2, 0.1, -0.3)), (L.fixed(L.heffernan_tawn("exp"), {2: 0.25}), (0.4, 0.7, 0.1, -0.3))])
def test_derivatives_of_the_conditional_model(model, p):
    cols, p = list(conditional(np.random.default_rng(0), 60)), np.array(p)
    f, g, h = model(cols, p)
    for k in range(len(p)):
        e = np.eye(len(p))[k] * 1e-6
        up, down = model(cols, p + e), model(cols, p - e)
        assert np.allclose((up[0] - down[0]) / 2e-6, g[:, k], atol=1e-5, rtol=1e-5)
        assert np.allclose((up[1] - down[1]) / 2e-6, h[:, :, k], atol=1e-5, rtol=1e-5)
    x, y, d = cols
    if len(p) == 5 and model is not None and np.allclose(f, L.heffernan_tawn("exp")(cols, p)[0]):
        assert np.isclose(f.sum(), N.heffernan_tawn_nll([p[0], np.exp(p[1]), *p[2:]], x, y, d, "exp"))


def test_derivatives_of_the_logistic_model():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 2, 50).astype(float), rng.normal(size=50), rng.normal(size=50), rng.normal(size=50)]
    p = np.array([0.1, -0.4, 0.8])
    _, g, h = L.logistic(cols, p)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        up, down = L.logistic(cols, p + e), L.logistic(cols, p - e)
        assert np.allclose((up[0] - down[0]) / 2e-6, g[:, k], atol=1e-6) and np.allclose((up[1] - down[1]) / 2e-6, h[:, :, k], atol=1e-6)


def frame(spark, x, y, d):
    return spark.createDataFrame([(k % 40, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, d, strict=True))], "i long, x double, y double, km double").repartition(5)


def test_both_forms_are_recovered_and_replicates_equal_plain_refits(spark):
    rng = np.random.default_rng(2)
    for form, other in (("exp", "pow"), ("pow", "exp")):
        t = (0.6, 1.0, 0.3, 0.2, -0.5) if form == "exp" else (0.5, -0.5, 0.3, 0.2, -0.5)
        df = frame(spark, *conditional(rng, 3000, form, t)).withColumn("w", L.poisson_weights(6, "i")).cache()
        f = L.fit_forms(df, ["x", "y", "km"])
        own = list(L.STARTS).index(form)
        assert f.converged.all() and (f.gradient < 1e-6).all() and f.nll[own] < f.nll[1 - own]
        se = np.sqrt(np.diag(np.linalg.inv(f.hessian[own])))
        assert (np.abs(f.params[own] - t) < 4 * se).all()
        drawn = L.refit(df, ["x", "y", "km"], form, f.params[own], "w", 6)
        assert drawn.converged.all()
        rows = df.toPandas()
        b = 3
        times = rows.w.map(lambda w: w[b]).to_numpy()
        again = frame(spark, *(np.repeat(rows[c].to_numpy(), times) for c in ("x", "y", "km"))).cache()
        plain = L.refit(again, ["x", "y", "km"], form, f.params[own])
        assert np.allclose(drawn.params[b], plain.params[0], atol=1e-6) and np.isclose(drawn.nll[b], plain.nll[0])
        held = L.refit(df, ["x", "y", "km"], form, f.params[own], beta=0.1)
        assert held.converged[0] and held.nll[0] >= f.nll[own] and held.params.shape == (1, 4)


def test_draws_are_poisson_and_equal_within_a_unit(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("i")).withColumn("w", L.poisson_weights(20, "i")).toPandas()
    w = np.stack(df.w.to_list())
    assert (df.groupby("i").w.agg(lambda v: len({tuple(x) for x in v})) == 1).all()
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and w.max() < 12


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_weighted_ranks(spark, buckets):
    rng = np.random.default_rng(3)
    rows = [(b, float(v), int(w)) for b in range(4) for v, w in zip(rng.integers(0, 30, 80) / 7, rng.integers(1, 4, 80), strict=True)]
    got = R.weighted_ranks(spark.createDataFrame(rows, "b long, x double, w int").repartition(3), "b", "x", "w", "r", buckets).toPandas()
    for b, g in got.groupby("b"):
        flat = np.sort(np.repeat(g.x.to_numpy(), g.w.to_numpy()))
        want = [(np.searchsorted(flat, v, "left") + np.searchsorted(flat, v, "right") + 1) / 2 for v in g.x]
        assert np.allclose(g.r, want), b


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, y double, km double")
    assert not L.fit_forms(df, ["x", "y", "km"]).converged.any()


def test_vectors_of_special_functions():
    rho = np.linspace(-0.99, 0.99, 23)
    a = float(N.norm_ppf(0.8))
    assert np.allclose(N.bivariate_norm_cdf_many(a, a, rho), [N.bivariate_norm_cdf(a, a, r) for r in rho])
    q, mean = np.array([0.025, 0.5, 0.975, 0.975, 0.0]), np.array([0.3, 7.0, 40.0, 0.01, 3.0])
    assert N.poisson_ppf_many(q, mean).tolist() == [N.poisson_ppf(x, m) for x, m in zip(q, mean, strict=True)]
