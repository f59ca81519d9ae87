"""Wide and JSON files of a bounded size, and rolling means that no shuffle carries."""

import os

import numpy as np
from pyspark.sql import functions as F

from gridsquall.operators import events as E
from gridsquall.plans import further
from gridsquall.sources import adapters as A
from gridsquall.sources import files


def test_wide_files_hold_some_stations_each(spark, tmp_path):
    rows = [(s, 1000 * t, s + t / 7.0) for s in range(1, 24) for t in range(6) if (s + t) % 3]
    path = str(tmp_path / "wide")
    files.write_wide_files(spark.createDataFrame(rows, "sid long, us long, k double"), path, stations=5)
    heads = []
    for folder, _, names in os.walk(path):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(folder, name)) as f:
                    heads.append(f.readline().strip().split(","))
    assert sorted(h[0] for h in heads) == ["us"] * 5 and max(map(len, heads)) == 6
    assert sorted(x for h in heads for x in h[1:]) == sorted(f"ID{s}" for s in range(1, 24))
    got = files.read_wide_files(spark, path).filter("k IS NOT NULL").collect()
    assert sorted((r.sid, r.us, r.k) for r in got) == sorted(rows)


def test_wide_files_of_nothing(spark):
    assert files.long_csv_round_trip(spark.createDataFrame([], "sid long, us long, k double")).collect() == []


def test_json_files_grow_in_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(further, "JSON_ROWS", 20)
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(2.0).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = further.query.__globals__["QUERIES"]["A9_json_array_files"](spark, str(tmp_path))
    assert len(got.inputFiles()) > 8 and got.count() == 1000


def test_rolling_minutes_need_no_shuffle_of_minutes(spark):
    rng = np.random.default_rng(5)
    ev = [(k, int(rng.integers(0, 9)), int(rng.integers(0, 4 * A.DAY_US)), "view" if rng.random() < 0.9 else "signup", float(rng.uniform(0, 100))) for k in range(900)]
    lines = A.minute_lines(spark.createDataFrame(ev, "event_id long, sid long, us long, event_type string, value double"))
    want = {}
    days = {}
    for r in lines.collect():
        days.setdefault((r.sid, r.day), {}).update({m: r.c + r.s * m for m in range(r.a, r.b)})
    for key, v in days.items():
        for m in sorted(v):
            last = [v[x] for x in range(m - 29, m + 1) if x in v]
            if len(last) >= 21 and round(float(np.mean(last)), 9) > 0.5:
                want[key] = m
                break
    out = E.rolling_minutes(lines, 30, 21, 0.5)
    assert {(r.sid, r.day): r.minute for r in out.collect()} == want and len(want) > 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower()
