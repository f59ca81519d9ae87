"""Extreme-value operators: gaps, extremal index, run length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.config import CONFIG


def gaps(events: DataFrame, key: str = "sid", us: str = "start_us") -> DataFrame:
    w = Window.partitionBy(key).orderBy(us, "event_id")
    return events.select(key, F.floor((F.col(us) - F.lag(us).over(w)) / 6e7).cast("long").alias("t")).filter("t IS NOT NULL")


def extremal_index(events: DataFrame) -> DataFrame:
    """``sid, n, theta`` by the intervals estimator; 1 for fewer than five events, for gaps that are all 0, and where it is not defined."""
    t = F.col("t").cast("double")
    n = F.count(F.lit(1))
    short = F.try_divide(2 * F.pow(F.sum(t), F.lit(2)), n * F.sum(t * t))
    long = F.try_divide(2 * F.pow(F.sum(t - 1), F.lit(2)), n * F.sum((t - 1) * (t - 2)))
    theta = F.when((n < 4) | (F.sum(t) == 0), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.when(F.max("t") <= 2, short).otherwise(long), F.lit(1.0))))
    return gaps(events).groupBy("sid").agg((n + 1).alias("n"), theta.alias("theta"))


def choose_run_length(events: DataFrame, step_min: int = 60, candidates: int = CONFIG.extremes.run_lengths) -> DataFrame:
    """The first run length whose number of clusters comes nearest to n times theta, but at least 1."""
    r = F.explode(F.sequence(F.lit(step_min), F.lit(step_min * candidates), F.lit(step_min))).alias("r")
    clusters = gaps(events).select("sid", "t", r).groupBy("sid", "r").agg((1 + F.count_if(F.col("t") > F.col("r"))).alias("clusters"))
    x = clusters.join(extremal_index(events), "sid")
    return x.groupBy("sid").agg(F.min_by(F.col("r").cast("long"), F.struct(F.abs(F.col("clusters") - F.greatest(F.lit(1.0), F.round(F.col("n") * F.col("theta")))), F.col("r"))).alias("run_min"))
