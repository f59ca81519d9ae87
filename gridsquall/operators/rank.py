"""Rank transforms, empirical distributions, Laplace margins, decay curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.session import cut


def laplace(u: Column) -> Column:
    return F.when(u >= 0.5, -F.log(2 * (1 - u))).otherwise(F.log(2 * u))


def laplace_inverse(x: Column) -> Column:
    return F.when(x >= 0, 1 - F.exp(-x) / 2).otherwise(F.exp(x) / 2)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decay(d: Column, a: float, scale: float, form: str) -> Column:
    return F.lit(a) * F.exp(-d / scale) if form == "exp" else F.lit(a) * F.pow(1 + d, F.lit(-scale))


def return_level(u: Column, sigma: Column, xi: Column, n: Column) -> Column:
    return F.when(F.abs(xi) < 1e-6, u + sigma * F.log(n)).otherwise(u + sigma / xi * (F.pow(n, xi) - 1))


def midrank_ecdf(df: DataFrame, key: str, value: str) -> DataFrame:
    """((values below + values up to) / 2 + 0.5) / (n + 1), within 1e-6 of neither end."""
    w = Window.partitionBy(key)
    low = F.rank().over(w.orderBy(value)) - 1
    tie = F.count(F.lit(1)).over(Window.partitionBy(key, value))
    u = (low + tie / 2 + 0.5) / (F.count(F.lit(1)).over(w) + 1)
    return df.withColumn("u", F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6)))


def inverse_ecdf(values: Column, u: Column) -> Column:
    """Hazen quantile of a sorted array: linear between (k - 1/2)/n, flat at the ends."""
    n = F.size(values)
    pos = F.least(F.greatest(u * n - 0.5, F.lit(0.0)), (n - 1).cast("double"))
    lo = F.floor(pos).cast("int")
    a, b = F.get(values, lo), F.get(values, F.least(lo + 1, n - 1))
    return a + (b - a) * (pos - lo)


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def numbered_sort(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in ranges of the order, with ``pos`` from 1: places in a range plus the rows of the ranges before."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = cut(rows).withColumn("_r", F.shiftright("_m", 33))
    sizes = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    pos = F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(bases), "_r").withColumn("pos", pos).drop("_r", "_m", "_base")


def weighted_ranks(df: DataFrame, key: str, value: str, weight: str, out: str, buckets: int = 64) -> DataFrame:
    """Average ranks of rows that count ``weight`` times, within each key, as column ``out``.

    Values are dealt into ranges (equal values share one), whose sums of weights tell where
    ranks begin in the next, so a key's rows are ranked by many tasks.
    """
    edges = sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.01))) if buckets > 1 else []  # a number for each range
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    rows = df.withColumn("_k", bucket)
    sums = rows.groupBy(key, "_k").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select(key, "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    upto = F.sum(weight).over(Window.partitionBy(key, "_k").orderBy(value))
    tie = F.sum(weight).over(Window.partitionBy(key, "_k", value))
    return rows.join(base, [key, "_k"]).withColumn(out, F.col("_base") + upto - (tie - 1) / 2.0).drop("_k", "_base")
