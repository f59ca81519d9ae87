"""Pairs by places against brute force, with crowded places, far ones and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsquall.functions import geo
from gridsquall.operators import pairs, places
from gridsquall.plans import registry


@pytest.fixture(scope="module")
def stations(spark):
    rng = np.random.default_rng(3)
    spots = [(52 + float(rng.integers(0, 6)) / 1000, 5 + float(rng.integers(0, 6)) / 700) for _ in range(25)]
    rows = [(100 + 7 * k, *spots[int(rng.integers(0, 25))]) for k in range(90)] + [(5000, 52.9, 6.3), (5001, 53.5, 5.0)]
    return spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "sid long, lat double, lon double").cache()


@pytest.fixture(scope="module")
def brute(stations):
    return [(r.i, r.j, r.dist) for r in pairs.pair_distances(stations).collect()]


def around(brute):
    out = {}
    for i, j, d in brute:
        out.setdefault(i, []).append((d, j))
        out.setdefault(j, []).append((d, i))
    return out


@pytest.mark.parametrize("radius", [300.0, None])
def test_station_pairs(stations, brute, radius):
    got = [(r.i, r.j, r.dist) for r in places.station_pairs(stations, radius).collect()]
    assert sorted(got) == sorted(x for x in brute if radius is None or x[2] < radius) and got


def test_full_lists_and_extra_columns(monkeypatch, stations, brute):
    monkeypatch.setattr(places, "MOST", 2)
    got = places.station_pairs(stations.withColumn("v", stations.sid * 10), None, ("v",)).collect()
    assert sorted((r.i, r.j, r.dist) for r in got) == sorted(brute) and all(r.v_i == 10 * r.i and r.v_j == 10 * r.j for r in got)


def test_nearest_in_growing_circles(stations, brute):
    want = {i: min((round(d, 3), j) for d, j in v)[1] for i, v in around(brute).items()}
    assert {r.sid: r.j for r in places.nearest(stations, 50.0).collect()} == want


def test_nearest_of_none_and_one(spark, stations):
    assert places.nearest(stations.limit(0)).collect() == [] == places.nearest(stations.limit(1)).collect()


def test_within_a_radius(stations, brute):
    near = {i: [(d, j) for d, j in v if d < 400] for i, v in around(brute).items()}
    got = {r.sid: (r.n, r.least, r.j) for r in places.within(stations, 400.0).collect()}
    assert got == {i: (len(v), min(v)[0] if v else None, min((round(d, 3), j) for d, j in v)[1] if v else None) for i, v in near.items()}


def test_distances_to_later_stations(stations, brute):
    got = {r.i: (r.n, r.mean, r.least) for r in places.later_distances(stations, block=8, salt=3).collect()}
    want = {}
    for i, _, d in brute:
        want.setdefault(i, []).append(d)
    assert set(got) == set(want)
    assert all(got[i][0] == len(v) and np.isclose(got[i][1], np.mean(v)) and got[i][2] == min(v) for i, v in want.items())


@pytest.mark.parametrize("few", [1, 100_000])
def test_median_of_all_distances(stations, brute, few):
    n, median, least = places.weighted_median(places.all_distances(stations), "dist", "w", bins=3, few=few)
    d = [x[2] for x in brute]
    assert (n, least) == (len(d), min(d)) and np.isclose(median, np.median(d), rtol=1e-12)


def test_median_of_nothing(stations):
    assert places.weighted_median(places.all_distances(stations.limit(1)), "dist", "w") == (0, None, None)


@pytest.mark.parametrize("name", ["G1_haversine", "G3_bearing", "G4_wind_alignment", "G5_expected_lag", "G9_distance_decay"])
def test_all_pairs_are_made_by_places(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_tile_i" in plan


def test_bearings_of_crowded_places_go_from_the_smaller_number(spark, monkeypatch):
    monkeypatch.setattr(places, "MOST", 2)
    rows = [(s, 52.0 + (s * 7 % 3) / 100, 5.0 + (s * 5 % 2) / 100) for s in range(40)] + [(None, None, None)]
    stations = spark.createDataFrame(rows, "sid long, lat double, lon double")
    two = pairs.pair_distances(stations).withColumn("towards", geo.bearing(*(F.col(f"{c}_{k}") for k in "ij" for c in ("lat", "lon"))))
    want = {(r.i, r.j, r.dist, r.towards) for r in two.collect()}
    got = [(r.i, r.j, r.dist, r.towards) for r in places.station_pairs(stations, towards=geo.bearing).collect()]
    assert len(want) == 780 == len(got) and set(got) == want
