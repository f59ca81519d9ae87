"""Counts for close pairs inside tiles against brute force, and plans that shuffle no pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsquall.operators import pairs as P
from gridsquall.operators import tiles
from gridsquall.plans import registry

SF = "/root/testdata/sf0.001"
NO_PAIRS_SHUFFLED = ["C7_any_extreme_in_window", "C8_symmetric_pairing", "D14_pair_event_summary", "D7_coincidence_window", "D10_bootstrap_interval", "D11_permutation_p_value", "H18_chi_against_gaussian"]


@pytest.fixture(scope="module")
def stations(spark):
    rng = np.random.default_rng(5)
    rows = [(k * 3 % 71, 52 + float(rng.integers(0, 9)) / 300, 5 + float(rng.integers(0, 9)) / 200) for k in range(71)]
    return spark.createDataFrame(rows, "sid long, lat double, lon double").cache()


@pytest.fixture(scope="module")
def ramps(spark):
    rng = np.random.default_rng(6)
    rows = [(int(s), e, int(t) * 30_000_000, float(m), "up", 0.6) for e, (s, t, m) in enumerate(zip(rng.integers(0, 64, 900), rng.integers(0, 240, 900), rng.random(900), strict=True))]
    return spark.createDataFrame(rows, "sid long, event_id long, start_us long, mag double, direction string, u double").cache()


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_event_counts(monkeypatch, stations, ramps, block):
    monkeypatch.setattr(tiles, "LEAST_TILE", 8)
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "CANDIDATES", 40)
    window = F.round(F.least(F.col("dist") / 15.0 / 60, F.lit(30.0)) * 6e7).cast("long")
    near = P.near_pairs(stations, 3000.0).cache()
    every = P.match_events(P.both_ways(near), ramps.filter("mag > u"), ramps, window)
    n = every.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"), F.count_if(F.col("mag_j") > 0.6).alias("nearest"), F.count_if("any_extreme").alias("any"))
    want = {(r.i, r.j): (r.n, r.found, r.nearest, r["any"]) for r in n.collect()}
    counts = tiles.event_counts(stations, ramps, 3000.0).cache()
    got = {(r.i, r.j): (r.n, r.found, r.nearest, r["any"]) for r in tiles.directed(counts).filter("n > 0").collect()}
    assert got == want and sum(x[2] for x in want.values()) < sum(x[1] for x in want.values()) > 100
    assert sorted((r.i, r.j) for r in counts.collect()) == sorted((r.i, r.j) for r in near.collect())
    every = {r.sid: r.n for r in ramps.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r.ramps_i == every.get(r.i, 0) and r.ramps_j == every.get(r.j, 0) for r in counts.collect())


@pytest.mark.parametrize("days", [22, 150])
def test_days_of_pairs(monkeypatch, spark, stations, days):
    """Counts over one word of days and over several, with a station that has none."""
    monkeypatch.setattr(tiles, "LEAST_TILE", 8)
    monkeypatch.setattr(tiles, "BLOCK", 60)
    rng = np.random.default_rng(days)
    sids = sorted(r.sid for r in stations.collect())[1:]
    hot = {s: np.flatnonzero(rng.random(days) < 0.3) for s in sids}
    at = {s: rng.integers(0, 12, len(hot[s])).astype(float) for s in sids}
    scores = {s: rng.standard_normal(days) for s in sids}
    rows = [(s, hot[s].tolist(), at[s].tolist(), scores[s].tolist()) for s in sids]
    own = stations.join(spark.createDataFrame(rows, "sid long, hot array<int>, at array<double>, scores array<double>"), "sid", "left").cache()
    near = [(r.i, r.j, r.dist) for r in P.near_pairs(stations, 3000.0).collect()]
    has = lambda s: np.isin(np.arange(days), hot.get(s, []))
    index = rng.integers(0, days, (40, days))

    got = {(r.i, r.j): (r.ci_low, r.ci_high) for r in tiles.joint_intervals(own, 3000.0, days, index, 4.0, 0.025, 0.975).collect()}
    assert set(got) == {(i, j) for i, j, _ in near}
    assert all(np.allclose(got[i, j], np.percentile((has(i)[index] & has(j)[index]).sum(1) / 4.0, [2.5, 97.5])) for i, j, _ in near)

    got = {(r.i, r.j): (r.n_joint, r.above) for r in tiles.joint_permutations(own, 3000.0, days, index).collect()}
    joint = {(i, j): int((has(i) & has(j)).sum()) for i, j, _ in near}
    assert got == {(i, j): (joint[i, j], int(((has(i) & has(j)[index]).sum(1) >= joint[i, j]).sum())) for i, j, _ in near}

    got = {(r.i, r.j): (r.n, r.hits_0, r.hits_1) for r in tiles.peak_gaps(own, 3000.0, (10, 2)).collect()}
    want = {}
    for i, j, dist in near:
        if joint[i, j]:
            gap = np.abs(*(np.diff([[x[k] for x in (dict(zip(hot[s], at[s], strict=True)) for s in (i, j))] for k in np.intersect1d(hot[i], hot[j])]).T))
            want[i, j] = (joint[i, j], int((gap <= dist / 10 / 60).sum()), int((gap <= dist / 2 / 60).sum()))
    assert got == want

    got = {(r.i, r.j): (r.n_joint, r.rho) for r in tiles.score_correlations(own, 3000.0, days).collect()}
    assert set(got) == {(i, j) for i, j, _ in near if i in scores and j in scores}
    assert all(n == joint[k] and np.isclose(rho, np.corrcoef(scores[k[0]], scores[k[1]])[0, 1]) for k, (n, rho) in got.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NO_PAIRS_SHUFFLED)
def test_pairs_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.partition("FlatMapGroupsInArrow")
    assert above[1] and not any(x in above[0] for x in ("Exchange hash", "SortMergeJoin", "HashAggregate"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_matches_are_not_shuffled(spark):
    plan = registry.QUERIES["C6_nearest_in_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.partition("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_nearest_match_with_equal_times(stations, ramps):
    """Many events at one time, and as near before as after: the earlier one, then the one of smaller number."""
    window = F.round(F.least(F.col("dist") / 15.0 / 60, F.lit(30.0)) * 6e7).cast("long")
    ramps = ramps.withColumn("start_us", F.floor(F.col("start_us") / 120_000_000).cast("long") * 120_000_000).withColumn("v", F.col("mag") * 7)
    columns = ["i", "j", "event_i", "us_i", "mag_i", "us_j", "mag_j", "any_extreme"]
    want = P.match_events(P.both_ways(P.near_pairs(stations, 3000.0)), ramps.filter("mag > u"), ramps, window).filter("found").select(*columns).collect()
    got = P.match_near(ramps.filter("mag > u"), ramps, stations, 3000.0, window, 200_000_001, ("v",)).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(map(tuple, want)) and len(want) > 100
    assert all(r.v_i == r.mag_i * 7 and r.v_j == r.mag_j * 7 for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_matched_share_counts_every_pair(spark):
    from gridsquall.plans.joins import matched, matched_share

    every = [r.found for r in matched(spark, SF).collect()]
    row = matched_share(spark, SF).first()
    assert (row.n, round(row.f * row.n)) == (len(every), sum(every)) and row.n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_joint_days_of_some_pairs_need_no_others(spark):
    """``H23_gate_coherence`` asks for the joint days of pairs with matches only."""
    from gridsquall.operators import tail
    from gridsquall.plans.statistics import _chi, _margins

    every = {(r.i, r.j): (r.n, r.n_joint) for r in _chi(spark, SF).collect()}
    some = [(j, i) if k % 2 else (i, j) for k, (i, j) in enumerate(sorted(every)) if k % 3 == 0] + [(1, 10**9)]
    got = {(r.i, r.j): (r.n, r.n_joint) for r in tail.joint_of(spark.createDataFrame(some, "i long, j long"), _margins(spark, SF), 0.8).collect()}
    assert got == {(i, j): every.get((min(i, j), max(i, j)), (got[1, 10**9][0], 0)) for i, j in some} and any(k for _, k in got.values())


def test_tiles_hold_as_many_stations_as_memory_allows(spark, monkeypatch):
    rows = [(s, 52.0 + (s * 37 % 101) / 1000, 5.0 + (s * 53 % 103) / 700, [s] * 4) for s in range(300)]
    stations = spark.createDataFrame(rows, "sid long, lat double, lon double, v array<int>")
    copies = lambda: tiles.dealt_pairs(stations, 3000.0, ("v",))[0].count()
    monkeypatch.setattr(tiles, "LEAST_TILE", 100)
    few = copies()
    monkeypatch.setattr(tiles, "MOST_TILE", 20)
    many = copies()
    monkeypatch.setattr(tiles, "MOST_TILE", 8192)
    monkeypatch.setattr(tiles, "VALUES", 100)
    assert 300 <= few <= 3 * 300 < 2 * few < many and tiles.dealt_pairs(stations, 3000.0, ("v",))[0].agg({"_tile": "max"}).first()[0] >= 9


def test_scores_are_made_of_ranks_in_the_tiles(spark):
    rng = np.random.default_rng(4)
    ranks = [(s, 52.0 + s / 5000, 5.0, [int(x) + 1 for x in rng.permutation(9)] if s else [1, 2], [s % 9]) for s in range(12)]
    held = spark.createDataFrame(ranks, "sid long, lat double, lon double, scores array<int>, hot array<int>")
    got = {(r.i, r.j): r.rho for r in tiles.score_correlations(held, 5000.0, 9, lambda u: np.log(u / (1 - u))).collect()}
    z = {s: np.log(np.array(r) / 10 / (1 - np.array(r) / 10)) for s, _, _, r, _ in ranks if s}
    assert set(got) == {(i, j) for i in z for j in z if i < j}
    assert all(abs(rho - np.corrcoef(z[i], z[j])[0, 1]) < 1e-12 for (i, j), rho in got.items())
