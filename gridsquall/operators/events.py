"""Order-dependent operators: runs, declustering, segmentation, first crossings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.functions.numeric import swinging_doors


def valid_runs(series: DataFrame) -> DataFrame:
    """Numbers the stretches of non-null values of each station as ``run``."""
    w = Window.partitionBy("sid").orderBy("us", "event_id")
    new = F.when(F.col("k").isNull(), 0).when(F.lag("k").over(w).isNull(), 1).otherwise(0)
    return series.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).filter("k IS NOT NULL").drop("_new")


def decluster_runs(events: DataFrame, key: str, us: str, mag: str, run_min: float) -> DataFrame:
    """The largest event (the earliest on ties) of each cluster of gaps up to ``run_min`` whole minutes."""
    w = Window.partitionBy(key).orderBy(us, "event_id")
    gap = F.floor((F.col(us) - F.lag(us).over(w)) / 6e7)
    marked = events.withColumn("cluster", F.sum(F.when(gap > run_min, 1).otherwise(0)).over(w))
    best = Window.partitionBy(key, "cluster").orderBy(F.desc(mag), us, "event_id")
    return marked.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def sdt_segments(series: DataFrame, eps: float) -> DataFrame:
    """Swinging-door segments ``sid, run, us_a, us_b, k_a, k_b, n`` of each run of valid values.

    The door's state makes this sequential within a run.  The window that numbers the runs
    has brought each station's rows together in order, so the runs of a batch of rows are
    worked on together, and only a run that the batch cuts off is carried to the next.
    """

    def segments(sid: np.ndarray, run: np.ndarray, us: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], (sid[1:] != sid[:-1]) | (run[1:] != run[:-1]), [True])))
        at = np.flatnonzero(swinging_doors(v, first, eps))
        inner = np.flatnonzero((sid[at[1:]] == sid[at[:-1]]) & (run[at[1:]] == run[at[:-1]]))
        a, b = at[inner], at[inner + 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sid[a], run[a], us[a], us[b], v[a], v[b], b - a)], names=["sid", "run", "us_a", "us_b", "k_a", "k_b", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = [np.asarray(batch.column(k)) for k in range(4)]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(new):
                yield segments(*(x[: new[-1] + 1] for x in held))
                held = [x[new[-1] + 1 :] for x in held]
        if held is not None and len(held[0]):
            yield segments(*held)

    rows = valid_runs(series).sortWithinPartitions("sid", "us", "event_id").select("sid", "run", "us", "k")
    return rows.mapInArrow(work, "sid long, run long, us_a long, us_b long, k_a double, k_b double, n long")


def segment_ramps(segments: DataFrame, delta: float, min_minutes: float) -> DataFrame:
    """Segments steep and long enough to count as ramps."""
    d = F.col("k_b") - F.col("k_a")
    minutes = (F.col("us_b") - F.col("us_a")) / 6e7
    return segments.filter((F.abs(d) >= delta) & (minutes >= min_minutes)).select("sid", F.col("us_a").alias("start_us"), F.col("us_b").alias("end_us"), d.alias("delta_k"), F.when(d > 0, "up").otherwise("down").alias("direction"), minutes.alias("duration_min"))


def rolling_minutes(lines: DataFrame, minutes: int, least: int, level: float) -> DataFrame:
    """``sid, day, minute``: when the mean of the last ``minutes`` (``least`` with a value) first exceeds ``level``.

    The lines of ``minute_lines`` lie together by station, in the window's order.  Their minutes
    are made for some station days at a time and never leave the task.
    """
    DAYS = 256  # noqa: N806  station days at a time, so that running sums stay exact to 1e-11

    def crossings(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([0], np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)) + 1))
        for at in range(0, len(new), DAYS):
            lo, hi = new[at], new[at + DAYS] if at + DAYS < len(new) else len(x[0])
            sid, day, a, b, c, s = (v[lo:hi] for v in x)
            group = np.zeros(hi - lo, dtype=np.int64)
            group[new[at + 1 : at + DAYS] - lo] = 1
            group = np.cumsum(group)
            size = (b - a).astype(np.int64)
            line = np.repeat(np.arange(len(size)), size)
            minute = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + a[line]
            key = group[line] * 4096 + minute  # days have 1440 minutes, so windows end before the next day's keys
            total = np.concatenate(([0.0], np.cumsum(c[line] + s[line] * minute - level)))
            first = np.searchsorted(key, key - (minutes - 1))
            n = np.arange(1, len(key) + 1) - first
            mean = (total[1:] - total[first]) / n + level
            hit = np.flatnonzero((n >= least) & (np.round(mean, 9) > level))
            _, k = np.unique(group[line[hit]], return_index=True)
            row = line[hit[k]]
            yield pa.RecordBatch.from_arrays([pa.array(sid[row]), pa.array(day[row]), pa.array(minute[hit[k]].astype(np.int64))], names=["sid", "day", "minute"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = [np.asarray(batch.column(k)) for k in range(6)]
            held = own if held is None else [np.concatenate(v) for v in zip(held, own, strict=True)]
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(new):
                yield from crossings([v[: new[-1] + 1] for v in held])
                held = [v[new[-1] + 1 :] for v in held]
        if held is not None and len(held[0]):
            yield from crossings(held)

    rows = lines.filter("sid IS NOT NULL").sortWithinPartitions("sid", "day", "a").select("sid", "day", "a", "b", "c", "s")
    return rows.mapInArrow(work, "sid long, day long, minute long")


def rolling_crossing(series: DataFrame, rows: int = 30, least: int = 21, level: float = 0.5) -> DataFrame:
    """For each station and day, when the rolling mean first exceeds ``level``."""
    from gridsquall.sources.adapters import DAY_US

    day = F.floor(F.col("us") / F.lit(DAY_US)).cast("long")
    w = Window.partitionBy("sid", "day").orderBy("us", "event_id").rowsBetween(1 - rows, 0)
    r = series.withColumn("day", day).withColumn("mean", F.when(F.count("k").over(w) >= least, F.avg("k").over(w)))
    return r.filter(F.col("mean") > level).groupBy("sid", "day").agg(F.min("us").alias("t_us"))
