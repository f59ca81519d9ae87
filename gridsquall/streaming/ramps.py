"""Streaming forms of the ramp operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def block_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and the largest value of each station in tumbling blocks of 90 minutes."""
    return events.withWatermark("ts", late).groupBy("sid", F.window("ts", "90 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("sid", F.col("w.start").alias("block"), "n", "top")


def event_clusters(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Declustering as session windows: events with gaps up to ``gap`` are one cluster."""
    s = events.withWatermark("ts", late).groupBy("sid", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("sid", F.col("w.start").alias("first"), "n", "top")


def swinging_door(events: DataFrame, eps: float = 0.02) -> DataFrame:
    """Break points of each station's line, kept up to date with a door per station as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        door = list(state.get) if state.exists else None
        out = []
        for pdf in batches:
            for t, v in pdf.sort_values("us")[["us", "value"]].itertuples(index=False):
                if door is None:
                    out.append((t, v))
                    door = [t, v, t, v, float("-inf"), float("inf")]
                    continue
                pt, pv, lt, lv, low, high = door
                if t <= lt:
                    continue  # later than its successor: the line has passed it
                a, b = (v - eps - pv) / (t - pt), (v + eps - pv) / (t - pt)
                low, high = max(low, a), min(high, b)
                if high < low:
                    out.append((lt, lv))
                    pt, pv = lt, lv
                    low, high = (v - eps - pv) / (t - pt), (v + eps - pv) / (t - pt)
                door = [pt, pv, t, v, low, high]
        if door is not None:
            state.update(tuple(door))
        yield pd.DataFrame({"sid": [key[0]] * len(out), "us": [int(t) for t, _ in out], "value": [float(v) for _, v in out]})

    return events.groupBy("sid").applyInPandasWithState(step, "sid long, us long, value double", "pt long, pv double, lt long, lv double, low double, high double", "append", GroupStateTimeout.NoTimeout)
