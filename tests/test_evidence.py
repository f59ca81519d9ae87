"""Operators on evidence and decisions against loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridsquall.operators import pairs as P
from gridsquall.operators import stats as S
from gridsquall.operators import tail as T
from gridsquall.plans import registry  # isort: skip  registers the queries before their modules are used
from gridsquall.plans import decisions as D


def test_gates_are_registered():
    assert len([n for n in registry.QUERIES if n.startswith("H23_gate")]) >= 12 and "H22_copula_fixtures" not in registry.QUERIES


def test_drawn_networks_are_exact_in_size_and_nested_by_hash(spark):
    stations = spark.range(30).withColumnRenamed("id", "sid").repartition(4)
    rows = D.drawn_networks(stations, [3, 10, 30], 4).collect()
    held = {r: {x.sid for x in rows if r in x.rs} for r in range(12)}
    assert [len(held[r]) for r in range(12)] == [3] * 4 + [10] * 4 + [30] * 4
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in range(i + 1, 30)], "i long, j long")
    for x in D.shared_draws(pairs, D.drawn_networks(stations, [3, 10, 30], 4)).collect():
        assert sorted(x.rs) == [r for r in range(12) if x.i in held[r] and x.j in held[r]]
    assert D.sizes_for(175) == [50, 80, 100, 120, 150] and D.sizes_for(15) == [4, 7, 9, 10, 13]


def test_families_are_adjusted_apart(spark):
    rng = random.Random(0)
    rows = [(f, rng.choice([0.001, 0.005, 0.02, 0.2, 0.9, None])) for f in range(5) for _ in range(40)]
    df = spark.createDataFrame([(f, k, p) for k, (f, p) in enumerate(rows)], "f long, k long, p double")
    got = {r.k: (r.p_adjusted, r.significant) for r in T.benjamini_hochberg(df, "p", by=("f",)).collect()}
    assert len(got) == len(rows)
    for f in range(5):
        for r in T.benjamini_hochberg(df.filter(F.col("f") == f), "p").collect():
            assert got[r.k] == (r.p_adjusted, r.significant)


def test_pairs_by_number(spark):
    rng = random.Random(1)
    members = [(g, s, rng.randrange(1000)) for g, n in ((1, 2), (2, 25), (3, 26), (4, 60), (5, 1), (1000003, 40)) for s in rng.sample(range(500), n)]
    df = spark.createDataFrame(members, "g long, s long, t long").repartition(3)
    value = {(g, s): t for g, s, t in members}
    got = P.sampled_pairs(df, "g", "s", "t", 300, 2).collect()
    for g, n in ((1, 2), (2, 25), (3, 26), (4, 60), (1000003, 40)):
        own = [(r.i, r.j) for r in got if r.g == g]
        assert len(own) == len(set(own)) == min(300, n * (n - 1) // 2) and all(i < j for i, j in own)
    assert all((r.t_i, r.t_j) == (value[r.g, r.i], value[r.g, r.j]) for r in got) and not [r for r in got if r.g == 5]
    assert {r.g for r in P.sampled_pairs(df, "g", "s", "t", 10, 26).collect()} == {3, 4, 1000003}


def test_many_wind_tables_in_one_pass(spark):
    rng = random.Random(2)
    tables = [(f"s{k}", [60, 100, 300][k % 3], rng.randrange(5000), rng.random()) for k in range(6) for _ in range(30)]
    times = sorted(rng.sample(range(5000), 80))
    got = {(r.at, r.src): (r.gap, r.v) for r in P.asof_sources(spark.createDataFrame([(t,) for t in times], "at long"), spark.createDataFrame(tables, "src string, tol long, us long, v double"), "at", "us", "src", "tol", ["v"]).collect()}
    want = {}
    for t in times:
        for s in {x[0] for x in tables}:
            near = sorted((abs(t - us), us, v) for src, tol, us, v in tables if src == s and abs(t - us) <= tol)
            if near:
                want[t, s] = near[0]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)


def test_normal_law_and_rank_sums(spark):
    z = [-9.0, -8.0, -3.3, -1.0, -1e-9, 0.0, 0.4, 2.5, 7.9, 12.0]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], atol=1e-14)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 8, 30), rng.integers(2, 9, 40)
    df = spark.createDataFrame([(1, 1, float(v)) for v in a] + [(1, 0, float(v)) for v in b], "k long, g int, v double")
    r = S.mann_whitney_p(S.mann_whitney(df, ["k"], "g", "v")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(n**3 - n for n in np.unique(np.concatenate([a, b]), return_counts=True)[1].tolist())
    sd = math.sqrt(30 * 40 / 12 * (71 - ties / (70 * 69)))
    assert np.isclose(r.u, u) and np.isclose(r.p_less, 0.5 * math.erfc(-((u - 600 + 0.5) / sd) / math.sqrt(2))) and np.isclose(r.p_two, math.erfc((abs(u - 600) - 0.5) / sd / math.sqrt(2)))


def test_velocities_against_least_squares(spark):
    rng = np.random.default_rng(4)
    dt = rng.uniform(-900, 900, 60)
    dx, dy = 5 * dt + rng.normal(size=60) * 300, -2 * dt + rng.normal(size=60) * 300
    df = spark.createDataFrame([(k % 2, float(t), float(x), float(y)) for k, (t, x, y) in enumerate(zip(dt, dx, dy, strict=True))] + [(9, 1.0, 1.0, 1.0)], "d long, dt double, dx double, dy double")
    got = {r.d: r for r in S.velocities(df, "d", 10).collect()}
    assert set(got) == {0, 1}
    for d in (0, 1):
        t, x, y = dt[d::2], dx[d::2], dy[d::2]
        vx, vy = (t @ x) / (t @ t), (t @ y) / (t @ t)
        r2 = 1 - (((x - vx * t) ** 2).sum() + ((y - vy * t) ** 2).sum()) / (((x - x.mean()) ** 2).sum() + ((y - y.mean()) ** 2).sum())
        assert np.allclose([got[d].vx, got[d].vy, got[d].speed, got[d].r2], [vx, vy, math.hypot(vx, vy), r2], atol=1e-4)


def test_matching_by_place_equals_matching_by_pairs(spark):
    rng = random.Random(5)
    stations = spark.createDataFrame([(s, 52 + rng.random() / 15, 5 + rng.random() / 10) for s in range(25)], "sid long, lat double, lon double")
    rows = [(s, s * 1000 + k, rng.randrange(6 * 3_600_000_000), rng.random(), rng.choice(["up", "down"]), 0.7) for s in range(25) for k in range(30)]
    ev = spark.createDataFrame(rows, "sid long, event_id long, start_us long, mag double, direction string, u double")
    window = F.round(F.least(F.col("dist") / 2.0 / 60, F.lit(30.0)) * 6e7).cast("long")
    columns = ["i", "j", "event_i", "us_i", "mag_i", "us_j", "mag_j", "dir_j", "any_extreme"]
    want = P.match_events(P.both_ways(P.near_pairs(stations, 5000.0)), ev.filter("mag > u"), ev, window).filter("found").select(*columns).collect()
    got = P.match_near(ev.filter("mag > u"), ev, stations, 5000.0, window).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
