"""Normalisation of raw series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(x: Column) -> Column:
    """NaN as null: only null means missing."""
    return F.when(~F.isnan(x), x)


def clip_operational(series: DataFrame, spans: DataFrame) -> DataFrame:
    """Values outside a station's [begin_us, end_us] become null; a station without span keeps all."""
    inside = F.col("us").between(F.coalesce("begin_us", F.lit(-(2**62))), F.coalesce("end_us", F.lit(2**62)))
    return series.join(spans, "sid", "left").withColumn("k", F.when(inside, missing(F.col("k")))).drop("begin_us", "end_us")


def capacity_normalise(series: DataFrame, stations: DataFrame, low: float = 0.0, high: float = 1.1) -> DataFrame:
    """``p = k / cap``; null for an invalid capacity or a share outside [low, high]."""
    p = F.when(F.col("cap") > 0, missing(F.col("k")) / F.col("cap"))
    return series.join(stations.select("sid", "cap"), "sid").withColumn("p", F.when(p.between(low, high), p)).drop("cap")


def clear_sky_index(p: Column, ghi: Column) -> Column:
    """Power share over clear-sky share, where that is over 0.005 and the index within 0..1.5."""
    k = F.try_divide(p, ghi / 1000)
    return F.when((ghi / 1000 > 0.005) & k.between(0.0, 1.5), k)


def censoring_report(series: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count("k")
    return series.groupBy("sid").agg(n.alias("n_total"), ok.alias("n_valid"), F.round(100 * ok / n, 2).alias("pct_valid"), F.round(100 - 100 * ok / n, 2).alias("pct_censored"))


def modal_step(series: DataFrame) -> DataFrame:
    """The most frequent step in whole minutes for each station; the least on ties."""
    w = Window.partitionBy("sid").orderBy("us", "event_id")
    step = series.select("sid", F.floor((F.col("us") - F.lag("us").over(w)) / 6e7).cast("long").alias("step")).filter("step IS NOT NULL")
    count = step.groupBy("sid", "step").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("sid").agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("step_min"), F.max("n").alias("n"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
