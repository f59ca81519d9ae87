"""Grouped statistics as aggregate expressions, p-values by NumPy on the aggregated rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridsquall.functions.numeric import norm_cdf, student_p


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation."""
    return pd.Series([None if pd.isna(x) or m < 3 else 0.0 if abs(x) >= 1 else student_p(x * ((m - 2) / (1 - x * x)) ** 0.5, m - 2) for x, m in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * norm_cdf(-z.abs().to_numpy(dtype=float)))


def normal_cdf(z: Column, terms: int = 120) -> Column:
    """The normal distribution function by its series, as an expression; 0 or 1 beyond 8."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    step = lambda s, k: F.struct((s["t"] * x * x / (2 * k + 1)).alias("t"), (s["v"] + s["t"] * x * x / (2 * k + 1)).alias("v"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("v")), step, lambda s: s["v"])
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(0.5 + F.exp(-x * x / 2) / (2 * F.pi()) ** 0.5 * total)


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null where x or y does not vary."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def regression(x: str, y: str) -> list[Column]:
    """n, r, slope, intercept, r2 and the slope's standard error of y on x; null where they are not defined."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    slope, r2 = F.try_divide(sxy, sxx), F.try_divide(sxy * sxy, sxx * syy)
    se = F.sqrt(F.try_divide(F.try_divide((1 - r2) * syy, sxx), F.when(n > 2, n - 2)))
    return [n.alias("n"), correlation(x, y).alias("r"), slope.alias("slope"), (F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)).alias("intercept"), r2.alias("r2"), se.alias("slope_se")]


def mann_whitney(df: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """U of group 1 against group 0 and its tie-corrected normal score."""
    from gridsquall.operators.rank import average_rank

    ranked = df.withColumn("_r", average_rank(value, *key))
    t = ranked.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_t")).groupBy(*key).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    s = ranked.groupBy(*key).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"), F.sum(F.when(F.col(group) == 1, F.col("_r"))).alias("_w"))
    s = s.join(t, key) if key else s.crossJoin(t)
    n = F.col("n1") + F.col("n0")
    u = F.col("_w") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12.0 * (n + 1 - F.try_divide("_ties", n * (n - 1)))
    return s.select(*key, "n1", "n0", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n0") / 2.0, F.sqrt(var)).alias("z"), F.try_divide(F.lit(0.5), F.sqrt(var)).alias("half"))


def mann_whitney_p(u: DataFrame) -> DataFrame:
    """Adds ``p_less`` (group 1 tends to be smaller) and ``p_two``, by the continuity-corrected normal law."""
    less, two = normal_cdf(F.col("z") + F.col("half")), 2 * normal_cdf(-F.abs("z") + F.col("half"))
    return u.withColumn("p_less", less).withColumn("p_two", F.least(F.lit(1.0), two))


def velocities(moves: DataFrame, key: str, least: int) -> DataFrame:
    """``key, n, vx, vy, speed, r2``: the velocity that explains displacements ``dx, dy`` by times ``dt`` best, from sums."""
    t, x, y = F.col("dt"), F.col("dx"), F.col("dy")
    n, tt, tx, ty = F.count(F.lit(1)), F.sum(t * t), F.sum(t * x), F.sum(t * y)
    square = F.sum(x * x) + F.sum(y * y)
    g = moves.groupBy(key).agg(n.alias("n"), tt.alias("tt"), tx.alias("tx"), ty.alias("ty"), square.alias("q"), (square - (F.pow(F.sum(x), 2) + F.pow(F.sum(y), 2)) / n).alias("total"))
    g = g.filter((F.col("n") >= least) & (F.col("tt") > 0))
    move = F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")
    r2 = F.when(F.col("total") > 0, 1 - (F.col("q") - move / F.col("tt")) / F.col("total"))
    return g.select(key, "n", F.round(F.col("tx") / F.col("tt"), 5).alias("vx"), F.round(F.col("ty") / F.col("tt"), 5).alias("vy"), F.round(F.sqrt(move) / F.col("tt"), 5).alias("speed"), F.round(r2, 5).alias("r2"))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """z of the pooled two-proportion test; null where it is not defined."""
    p = (x1 + x2) / (n1 + n2)
    return F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))


def circular_mean(angle: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))), F.lit(360.0))


def through_origin(x: Column, y: Column) -> Column:
    return F.try_divide(F.sum(x * y), F.sum(x * x))


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-frequency bins by quantile edges (equal values share a bin), numbered from 0."""
    probs = [k / bins for k in range(bins + 1)]
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, probs)))).alias("_e"))  # one row
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(0), below - 1)).drop("_e")
