import ast
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsquall.operators import clean, events, models, pairs, rank, solar, stats, tail


def test_library_does_not_need_llm():
    root = pathlib.Path(__file__).parent.parent / "gridsquall"
    for f in root.rglob("*.py"):
        if "llm" in f.parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), f


def test_nearest_prefers_the_earlier_on_ties(spark):
    left = spark.createDataFrame([(1, 600_000_000), (2, 10_000_000_000)], "id long, t long")
    right = spark.createDataFrame([(300_000_000, "a"), (900_000_000, "b")], "rt long, v string")
    got = {r.id: r.v for r in pairs.asof_nearest(left, right, 400_000_000, [], "t", "rt", ["v"], ["id"]).collect()}
    assert got == {1: "a", 2: None}


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    s = spark.createDataFrame([(i, float(52 + rng.uniform(0, 0.2)), float(5 + rng.uniform(0, 0.3))) for i in range(80)], "sid long, lat double, lon double")
    want = {(r.i, r.j) for r in pairs.pair_distances(s).filter("dist < 3000").collect()}
    assert {(r.i, r.j) for r in pairs.near_pairs(s, 3000.0).collect()} == want and want


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "k long, p double")
    got = {r.k: (round(r.p_adjusted, 6), r.significant) for r in tail.benjamini_hochberg(df, "p").collect()}
    assert got == {1: (0.04, True), 2: (0.04, True), 3: (0.04, True), 4: (0.5, False)}


def test_daily_matrix_has_zeros_and_all_days(spark):
    r = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 20, 0.5), (2, 3, 86_400_000_010, 0.2)], "sid long, event_id long, start_us long, mag double")
    got = {(x.sid, x.day): (x.m, x.minute is None) for x in tail.daily_matrix(r).collect()}
    assert got == {(1, 0): (0.5, False), (1, 1): (0.0, True), (2, 0): (0.0, True), (2, 1): (0.2, False)}


def test_circular_mean(spark):
    r = spark.createDataFrame([(350.0,), (10.0,)], "a double").agg(stats.circular_mean(F.col("a")).alias("m")).first()
    assert min(r.m, 360 - r.m) < 1e-9


def test_nan_counts_as_missing(spark):
    s = spark.createDataFrame([(1, 0, float("nan")), (1, 5, 1.0), (1, 50, 2.0), (2, 0, 3.0)], "sid long, us long, k double")
    spans = spark.createDataFrame([(1, 0, 10)], "sid long, begin_us long, end_us long")
    got = sorted((r.sid, r.us, r.k) for r in clean.clip_operational(s, spans).collect())
    assert got == [(1, 0, None), (1, 5, 1.0), (1, 50, None), (2, 0, 3.0)]


def test_segments_never_bridge_a_gap(spark):
    k = [0.0] * 5 + [0.2 * i for i in range(5)] + [None] + [1.0] * 5
    s = spark.createDataFrame([(1, i, i * 60_000_000, v) for i, v in enumerate(k)], "sid long, event_id long, us long, k double")
    seg = events.sdt_segments(s, 0.02).collect()
    assert all(not (r.us_a < 600_000_000 < r.us_b) for r in seg)
    ramps = events.segment_ramps(events.sdt_segments(s, 0.02), 0.1, 1).collect()
    assert len(ramps) == 1 and ramps[0].direction == "up"


def test_inverse_ecdf_is_hazen(spark):
    x = sorted(np.random.default_rng(0).random(9).tolist())
    us = [0.01, 0.3, 0.5, 0.77, 0.99]
    df = spark.createDataFrame([(x, u) for u in us], "a array<double>, u double")
    got = [r.v for r in df.select(rank.inverse_ecdf(F.col("a"), F.col("u")).alias("v")).collect()]
    assert got == pytest.approx(np.quantile(x, us, method="hazen").tolist())


def test_solar_noon_and_night(spark):
    us = spark.sql("SELECT unix_micros(timestamp'2024-06-21 11:40:00') a, unix_micros(timestamp'2024-06-21 23:40:00') b")
    e = lambda c: solar.elevation(F.col(c), F.lit(52.0), F.lit(5.0))
    r = us.select(e("a").alias("a"), e("b").alias("b"), solar.clear_sky_ghi(e("a"), F.lit(173)).alias("g"), solar.clear_sky_ghi(e("b"), F.lit(173)).alias("n")).first()
    assert r.a == pytest.approx(61.4, abs=0.3) and r.b < 0 and 750 < r.g < 950 and r.n == 0


def test_logistic_with_offset_recovers(spark):
    rng = np.random.default_rng(5)
    x, off = rng.normal(size=6000), rng.normal(size=6000) * 0.5
    y = (rng.random(6000) < 1 / (1 + np.exp(-(0.7 - 1.2 * x + off)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, x, off, strict=True)], "y int, x double, o double").cache()
    f = models.logistic_offset(df, "y", ["x"], "o")
    assert f["coef"] == pytest.approx([0.7, -1.2], abs=0.12) and all(lo < c < hi for lo, c, hi in zip(f["low"], f["coef"], f["high"], strict=True))
    df.unpersist()


def test_independence_of_partitioning(spark):
    from gridsquall.operators.resample import uniform

    a = spark.range(1000).repartition(3).select("id", uniform("id").alias("u"))
    b = spark.range(1000).repartition(7).select("id", uniform("id").alias("u"))
    assert a.exceptAll(b).count() == 0 and abs(a.agg(F.avg("u")).first()[0] - 0.5) < 0.05
