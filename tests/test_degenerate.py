"""Groups of one or two rows, constant values, and the edge cases of estimators."""

import random

import numpy as np
import pytest
from generators import generated_chi
from pyspark.sql import functions as F

from gridsquall.functions import numeric as N
from gridsquall.operators import evt
from gridsquall.operators import stats as S
from gridsquall.operators import tail as T
from gridsquall.operators.events import sdt_segments
from gridsquall.operators.pairs import match_events


def test_regression_of_small_and_constant_groups(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 2.0), (2, 3.0, 8.0), (3, 4.0, 1.0), (3, 4.0, 2.0), (3, 4.0, 5.0), (4, 1.0, 7.0), (4, 2.0, 7.0), (4, 5.0, 7.0), (5, 0.0, 0.1), (5, 1.0, 1.2), (5, 2.0, 1.9)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r for r in df.groupBy("g").agg(*S.regression("x", "y")).withColumn("p", S.correlation_p("r", "n")).collect()}
    assert got[1].n == 1 and got[1].r is None and got[1].slope is None and got[1].slope_se is None
    assert got[2].slope == 3.0 and got[2].slope_se is None
    assert got[3].r is None and got[3].slope is None and got[4].r is None and got[4].slope == 0.0
    x, y = np.array([0, 1, 2.0]), np.array([0.1, 1.2, 1.9])
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - slope * x - intercept
    assert np.isclose(got[5].slope, slope) and np.isclose(got[5].intercept, intercept) and np.isclose(got[5].slope_se, np.sqrt((rest**2).sum() / 1 / 2.0))
    assert np.isclose(got[5].r, np.corrcoef(x, y)[0, 1])


def events(spark, series):
    rows = [(s, 100 * s + k, int(m) * 60_000_000) for s, minutes in series.items() for k, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "sid long, event_id long, start_us long")


def index(gaps):
    """The intervals estimator, written from its definition."""
    t = np.asarray(gaps, float)
    n = len(t) + 1
    if n < 5 or t.sum() == 0:
        return 1.0
    a, b = (t, t) if t.max() <= 2 else (t - 1, t - 2)
    top, under = 2 * a.sum() ** 2, (n - 1) * (a * b).sum()
    return float(np.clip(top / under, 0, 1)) if under > 0 else 1.0


def test_extremal_index_at_its_edges(spark):
    series = {1: [0, 5, 90, 300], 2: [0, 5, 90, 300, 301], 3: [7] * 6, 4: [0, 1, 3, 4, 6], 5: [0, 40, 41, 42, 1000, 1001, 5000], 6: [0, 0, 0, 0, 1]}
    df = events(spark, series)
    got = {r.sid: (r.n, r.theta) for r in evt.extremal_index(df).collect()}
    runs = {r.sid: r.run_min for r in evt.choose_run_length(df).collect()}
    for s, minutes in series.items():
        gaps = np.diff(minutes)
        assert got[s][0] == len(minutes) and np.isclose(got[s][1], index(gaps)), s
        assert np.isclose(N.ferro_segers(gaps), index(gaps))
        target = max(1, round(len(minutes) * index(gaps)))
        assert runs[s] == min(range(60, 1141, 60), key=lambda r: abs(1 + (gaps > r).sum() - target))
    assert got[2][1] < 1.0  # five events are enough


def test_poisson_null_without_a_span(spark):
    df = spark.createDataFrame([(1, 5, 0.0), (2, 5, 100.0)], "g int, n long, span double")
    got = {r.g: r.p for r in df.select("g", T.poisson_null(F.col("n"), F.col("span"), F.lit(30.0)).alias("p")).collect()}
    assert got[1] is None and np.isclose(got[2], 1 - np.exp(-3))


def test_match_events_against_brute_force(spark):
    rng = random.Random(4)
    ev = [(s, k, rng.randrange(0, 40) * 450_000_000, rng.choice([0.1, 0.2, 0.3]), rng.choice(["up", "down"]), 0.2) for k, s in enumerate(rng.choice([1, 2, 3, 4]) for _ in range(120))]
    df = spark.createDataFrame(ev, "sid long, event_id long, start_us long, mag double, direction string, u double")
    pairs = spark.createDataFrame([(1, 2, 900.0), (2, 1, 900.0), (1, 3, 1500.0), (4, 1, 10.0), (1, 9, 5.0)], "i long, j long, dist double")
    got = match_events(pairs, df.filter("mag > 0.15"), df, (F.col("dist") * 1_000_000).cast("long")).collect()
    want = {}
    for i, j, dist in [(1, 2, 900.0), (2, 1, 900.0), (1, 3, 1500.0), (4, 1, 10.0), (1, 9, 5.0)]:
        for s, k, us, mag, *_ in ev:
            if s == i and mag > 0.15:
                near = sorted((abs(us - o[2]), o[2], o[1], o[3], o[4]) for o in ev if o[0] == j and abs(us - o[2]) <= dist * 1_000_000)
                want[i, j, k] = (bool(near), *((near[0][1], near[0][3], near[0][4]) if near else (None,) * 3), any(o[3] > 0.2 for o in near))
    assert {(r.i, r.j, r.event_i): (r.found, r.us_j, r.mag_j, r.dir_j, r.any_extreme) for r in got} == want and len(got) == len(want)


def plain_door(v, eps):
    out, pivot, low, high = [0], 0, -np.inf, np.inf
    for k in range(1, len(v)):
        a, b = max(low, (v[k] - eps - v[pivot]) / (k - pivot)), min(high, (v[k] + eps - v[pivot]) / (k - pivot))
        if b < a:
            pivot = k - 1
            out.append(pivot)
            a, b = v[k] - eps - v[pivot], v[k] + eps - v[pivot]
        low, high = a, b
    return sorted({*out, len(v) - 1})


@pytest.mark.parametrize("few", [1, 3, 100])
def test_many_doors_at_once(few):
    rng = np.random.default_rng(few)
    sizes = [0, 1, 2, 50, 3, 400, 7, 7, 120, 1, 33]
    first = np.concatenate(([0], np.cumsum(sizes)))
    v = rng.normal(size=first[-1]).cumsum() * 0.1
    got = N.swinging_doors(v, first, 0.15, few)
    for a, z in zip(first[:-1], first[1:], strict=True):
        assert np.flatnonzero(got[a:z]).tolist() == (plain_door(v[a:z], 0.15) if z > a else [])


def test_segments_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(s, k, k * 60_000_000, None if rng.random() < 0.1 else rng.random()) for s in range(7) for k in range(rng.choice([1, 60, 300]))]
    df = spark.createDataFrame(rows, "sid long, event_id long, us long, k double")
    got = sorted(map(tuple, sdt_segments(df.repartition(5), 0.3).collect()))
    want = []
    for s in range(7):
        run, own = 0, []
        for r in [*sorted(x for x in rows if x[0] == s), (s, 0, 0, None)]:
            if r[3] is None:
                if own:
                    run += 1
                    at = plain_door([x[3] for x in own], 0.3)
                    want += [(s, run, own[a][2], own[b][2], own[a][3], own[b][3], b - a) for a, b in zip(at[:-1], at[1:], strict=True)]
                own = []
            else:
                own.append(r)
    assert got == sorted(want)


def test_generated_pairs_have_their_known_dependence(spark):
    got = {r.pair: r.chi for r in generated_chi(spark).collect()}
    assert got["ar1 independent"] < 0.10 and got["ar1 correlated"] > 0.25 and abs(got["gumbel 2"] - (2 - 2**0.5)) < 0.05
