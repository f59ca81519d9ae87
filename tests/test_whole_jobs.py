"""Registered queries do the whole job of their operator."""

import os

import numpy as np
import pytest

from gridsquall.config import CONFIG
from gridsquall.operators import resample as S
from gridsquall.operators.pairs import near_pairs
from gridsquall.plans import registry
from gridsquall.plans.statistics import _chi, _margins
from gridsquall.sources import adapters as A

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def close_pairs(spark):
    return {(r.i, r.j) for r in near_pairs(A.stations(A.events(spark, SF)), CONFIG.tail.near_m).collect()}


def test_replicates_of_all_close_pairs(spark):
    m = _margins(spark, SF).toPandas()
    days = sorted(m.day.unique())
    n = len(days)
    hot = {s: np.isin(days, g.day[g.u > 0.8]) for s, g in m.groupby("sid")}

    def index(size):
        t = S.block_index(spark, n, 3, size).toPandas().sort_values(["b", "pos"])
        return t.src.to_numpy().reshape(size, n)

    pairs = close_pairs(spark)
    src = index(CONFIG.tail.bootstraps)
    got = {(r.i, r.j): (r.ci_low, r.ci_high) for r in registry.QUERIES["D10_bootstrap_interval"](spark, SF).collect()}
    assert set(got) == pairs
    for i, j in pairs:
        k = (hot[i][src] & hot[j][src]).sum(1) if i in hot and j in hot else np.zeros(len(src))
        assert np.allclose(got[i, j], np.percentile(k / (n * (1 - 0.8)), [2.5, 97.5]))
    src = index(CONFIG.tail.permutations)
    seen = {(r.i, r.j): r.n_joint for r in _chi(spark, SF, CONFIG.tail.near_m).collect()}
    got = {(r.i, r.j): r.p for r in registry.QUERIES["D11_permutation_p_value"](spark, SF).collect()}
    assert set(got) == pairs
    for i, j in pairs:
        k = (hot[i] & hot[j][src]).sum(1) if i in hot and j in hot else np.zeros(len(src))
        assert abs(got[i, j] - (1 + (k >= seen[i, j]).sum()) / 200) < 1e-12


def test_positions_of_all_pairs(spark):
    from gridsquall.functions.geo import haversine, metres_to_degrees
    from pyspark.sql import functions as F

    s = A.stations(A.events(spark, SF))
    got = {(r.i, r.j): r for r in registry.QUERIES["H11_position_uncertainty"](spark, SF).collect()}
    ids = sorted(r.sid for r in s.collect())
    assert set(got) == {(i, j) for i in ids for j in ids if i < j}
    x = s.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(999))))
    dx, dy = metres_to_degrees(*((S.uniform("sid", "b", F.lit(a)) - 0.5) * 150.0 for a in "xy"), F.col("lat"))
    x = x.select("sid", "b", (F.col("lat") + dy).alias("la"), (F.col("lon") + dx).alias("lo"))
    x = x.alias("a").join(x.alias("c"), F.expr("a.b = c.b AND a.sid < c.sid"))
    m = haversine(F.col("a.la"), F.col("a.lo"), F.col("c.la"), F.col("c.lo"))
    q = F.percentile(m, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    for r in x.groupBy(F.col("a.sid").alias("i"), F.col("c.sid").alias("j")).agg(q.alias("q")).collect():
        assert np.isclose(got[r.i, r.j].d_median, r.q[1]) and np.isclose(got[r.i, r.j].ru, (r.q[2] - r.q[0]) / r.q[1], rtol=1e-6)


def test_replicates_of_the_ensembles(spark):
    levels = registry.QUERIES["H14_model_implied_ensemble"](spark, SF)
    assert levels.select("b").distinct().count() == 150


def test_sort_of_all_ramps(spark):
    from gridsquall.operators.rank import numbered_sort
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).withColumn("v", F.xxhash64("id") % 50)
        got = sorted((r.pos, r.v, r.id) for r in numbered_sort(rows, F.desc("v"), F.asc("id")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p for p, _, _ in got] == list(range(1, 5001)) and [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (-x[0], x[1]))
    assert registry.QUERIES["E18_full_sort"](spark, SF).count() == A.ramps(A.events(spark, SF)).count() > 500


def test_pairs_that_no_draw_holds_are_left_out(spark):
    from gridsquall.plans.decisions import shared_draws

    networks = spark.createDataFrame([(1, [0, 2]), (2, [2, 3]), (3, [1])], "sid long, rs array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "i long, j long")
    assert [(r.i, r.j, r.rs) for r in shared_draws(pairs, networks).collect()] == [(1, 2, [2])]


def test_drawn_positions_are_not_shuffled(spark):
    """Stations go to the pairs of tiles with two numbers each, not with a thousand draws."""
    plan = registry.QUERIES["H11_position_uncertainty"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning(ta")
    assert below and "la#" in above and "la#" not in below and "Exchange" not in above


@pytest.mark.parametrize("around", [0.06, -0.3])
def test_median_uncertainty_is_that_of_all_pairs(spark, monkeypatch, around):
    """Values far from the median are only counted; a window that misses it is not used."""
    from gridsquall.plans import models as M

    monkeypatch.setattr(M, "GUESS", 8)
    monkeypatch.setattr(M, "AROUND", around)
    monkeypatch.setattr(M, "LEAST_TILE", 4)
    rows = registry.QUERIES["H11_position_uncertainty"](spark, SF).collect()
    n, share, median = M.position_summary(spark, A.stations(A.events(spark, SF)))
    assert n == len(rows) and abs(share - np.mean([r.flagged for r in rows])) < 1e-12 and abs(median - np.median([r.ru for r in rows])) < 1e-12
    inside = M._uncertainties(spark, A.stations(A.events(spark, SF)), median * 0.9, median * 1.1).collect()
    assert sum(r.w for r in inside) == n and len(inside) < n


def test_numbers_drawn_in_tasks_are_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, 7, -3, 1 << 40, 90_000]
    rows = spark.createDataFrame([(i,) for i in ids], "sid long").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(19))))
    for letter in "xy":
        want = {(r.sid, r.b): r.u for r in rows.select("sid", "b", S.uniform("sid", "b", F.lit(letter)).alias("u")).collect()}
        got = S.uniforms(np.array(ids), 20, letter)
        assert all(got[k, b] == want[i, b] for k, i in enumerate(ids) for b in range(20))
