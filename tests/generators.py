"""Generated pairs of known dependence, for tests of tail statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsquall.operators import resample as S

#: Samples of a generated series, its memory, and how far back innovations still count.
SAMPLES, PHI, MEMORY = 50_000, 0.9, 120


def ar1_pair(spark, rho: float):
    """``t, x, y``: two AR(1) series whose innovations correlate, as moving sums of hashed normals."""
    w = Window.partitionBy("part").orderBy("t").rowsBetween(-MEMORY, 0)
    t = spark.range(SAMPLES).select(F.col("id").alias("t"), F.floor(F.col("id") / 1000).alias("part"))
    # each part brings the innovations before it along, so that parts need not meet
    lead = t.filter(F.col("t") % 1000 >= 1000 - MEMORY).select("t", (F.col("part") + 1).alias("part"))
    a, b = S.normal("t", F.lit("ar-a")), S.normal("t", F.lit("ar-b"))
    rows = t.unionByName(lead).select("t", "part", a.alias("a"), (rho * a + (1 - rho * rho) ** 0.5 * b).alias("b"))
    memory = lambda c: F.aggregate(F.collect_list(c).over(w), F.lit(0.0), lambda s, e: PHI * s + e)
    return rows.select("t", "part", memory("a").alias("x"), memory("b").alias("y")).filter(F.floor(F.col("t") / 1000) == F.col("part")).drop("part")


def gumbel_pair(spark, theta: float):
    """``t, u, v`` from a Gumbel copula: exponentials divided by a shared positive stable frailty."""
    a = 1 / theta
    u, e = F.pi() * S.uniform("id", F.lit("angle")), -F.log(S.uniform("id", F.lit("frailty")))
    s = F.sin(a * u) / F.pow(F.sin(u), F.lit(1 / a)) * F.pow(F.sin((1 - a) * u) / e, F.lit((1 - a) / a))
    margin = lambda k: F.exp(-F.pow(-F.log(S.uniform("id", F.lit(k))) / F.col("s"), F.lit(a)))
    return spark.range(SAMPLES).withColumn("s", s).select(F.col("id").alias("t"), margin("u").alias("u"), margin("v").alias("v"))


def generated_chi(spark):
    """Chi at 0.95 of generated pairs: AR(1) series, independent and not, and a Gumbel copula (2 - sqrt 2 in the limit)."""
    out = None
    for name, df, x, y in (("ar1 independent", ar1_pair(spark, 0.0), "x", "y"), ("ar1 correlated", ar1_pair(spark, 0.8), "x", "y"), ("gumbel 2", gumbel_pair(spark, 2.0), "u", "v")):
        q = df.agg(F.percentile(x, 0.95).alias("qx"), F.percentile(y, 0.95).alias("qy"))  # one row
        chi = df.crossJoin(F.broadcast(q)).agg((F.count_if((F.col(x) > F.col("qx")) & (F.col(y) > F.col("qy"))) / (SAMPLES * 0.05)).alias("chi")).select(F.lit(name).alias("pair"), "chi")
        out = chi if out is None else out.unionByName(chi)
    return out
