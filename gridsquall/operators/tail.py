"""Daily maxima, margins, and tail dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.operators.places import station_pairs
from gridsquall.session import cut
from gridsquall.sources.adapters import DAY_US


def daily_matrix(ramps: DataFrame) -> DataFrame:
    """``sid, day, m, minute`` for every station and every day on which any station ramped.

    ``m`` is an explicit 0 and ``minute`` null where a station had no ramp that day.
    """
    day = F.floor(F.col("start_us") / F.lit(DAY_US)).cast("long")
    top = ramps.groupBy("sid", day.alias("day")).agg(F.max("mag").alias("m"), F.max_by((F.col("start_us") % DAY_US) / 6e7, F.struct("mag", -F.col("start_us"), -F.col("event_id"))).alias("minute"))
    grid = ramps.select("sid").distinct().crossJoin(top.select("day").distinct())  # stations x days, the result's own size
    return grid.join(top, ["sid", "day"], "left").select("sid", "day", F.coalesce("m", F.lit(0.0)).alias("m"), "minute")


def uniform_margins(daily: DataFrame) -> DataFrame:
    """Rank / (n + 1) of each station's days, ties by day."""
    w = Window.partitionBy("sid")
    return daily.withColumn("u", F.row_number().over(w.orderBy("m", "day")) / (F.count(F.lit(1)).over(w) + 1.0))


def hot_words(margins: DataFrame, q: float) -> tuple[DataFrame, int]:
    """``sid, m``: the days of a station over the quantile as bits, and the number of words of 64 days."""
    bit = F.expr("shiftleft(1L, cast(pmod(day, 64) AS int))")
    hot = cut(margins.filter(F.col("u") > q).groupBy("sid", F.floor(F.col("day") / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("m")))
    words = sorted(r.w for r in hot.select("w").distinct().collect())  # a number for every 64 days
    of = [F.coalesce(F.max(F.when(F.col("w") == w, F.col("m"))), F.lit(0).cast("long")) for w in words]
    return hot.groupBy("sid").agg((F.array(*of) if words else F.lit(None).cast("array<long>")).alias("m")), len(words)


def shared_words(words: int) -> Column:
    """How many bits ``m_i`` and ``m_j`` have in common; 0 where one has none."""
    if words > 64:
        shared = F.aggregate(F.zip_with("m_i", "m_j", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, k: s + k)
    else:
        shared = F.lit(0)
        for k in range(words):
            shared = shared + F.bit_count(F.get("m_i", F.lit(k)).bitwiseAND(F.get("m_j", F.lit(k))))
    return F.coalesce(shared, F.lit(0)).cast("long")


def joint_exceedance(margins: DataFrame, stations: DataFrame, q: float, radius_m: float | None = None) -> DataFrame:
    """``i, j, dist, n, n_joint`` of all pairs, or those within a radius; pairs without a joint day keep a 0.

    A station's days are bits, 64 of them a word.  Stations bring their words to the pairs,
    so pairs are counted where they are formed and never shuffled.
    """
    n = margins.agg(F.countDistinct("day").alias("n"))  # one row
    hot, words = hot_words(margins, q)
    stations = stations.join(hot, "sid", "left")
    pairs = station_pairs(stations.select("sid", "lat", "lon", "m"), radius_m, ("m",))
    return pairs.select("i", "j", "dist", shared_words(words).alias("n_joint")).crossJoin(F.broadcast(n))


def joint_of(pairs: DataFrame, margins: DataFrame, q: float) -> DataFrame:
    """``pairs`` ``i, j`` with ``n`` and ``n_joint``: for few of all pairs, whose stations are joined to them."""
    n = margins.agg(F.countDistinct("day").alias("n"))  # one row
    hot, words = hot_words(margins, q)
    of = lambda k: hot.select(F.col("sid").alias(k), F.col("m").alias(f"m_{k}"))
    x = pairs.join(of("i"), "i", "left").join(of("j"), "j", "left")
    return x.withColumn("n_joint", shared_words(words)).drop("m_i", "m_j").crossJoin(F.broadcast(n))


def chi(n_joint: Column, n: Column, q: float) -> Column:
    return n_joint / (n * F.lit(1 - q))


def chibar(n_joint: Column, n: Column, q: float) -> Column:
    """2 ln(1-q) / ln(joint share) - 1, not below -1."""
    c = n_joint / n
    return F.when(n_joint > 0, F.when(c < 1, F.greatest(F.lit(-1.0), 2 * F.log(F.lit(1 - q)) / F.log(c) - 1)).otherwise(1.0)).otherwise(-1.0)


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05, by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Adds ``p_adjusted`` (running minimum from the largest p) and ``significant``, within each family ``by``.

    Equal p-values have one answer, that of their last rank, so ranks are running counts
    over distinct p-values: a permutation test of B draws has B + 1 of them, however many
    pairs it is made for.  ``few`` says that their number is bounded so; their table is then
    broadcast, and no row of ``df`` is shuffled.  A null p has a null adjustment and is not significant.
    """
    g = df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    family = Window.partitionBy(*by)
    up = family.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(*by, "_p", F.sum("_n").over(up).alias("_k"), F.sum("_n").over(family).alias("_m"))
    raw = F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(family.orderBy(F.desc("_k"))))
    crit = F.max(F.when(F.col("_p") <= F.col("_k") * alpha / F.col("_m"), F.col("_p"))).over(family)
    g = g.select(*(F.col(c).alias(f"_{c}") for c in by), "_p", raw.alias("p_adjusted"), F.coalesce(F.col("_p") <= crit, F.lit(False)).alias("significant"))
    same = F.col(p) == F.col("_p")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    out = df.join(F.broadcast(g) if few else g, same, "left").drop("_p", *(f"_{c}" for c in by))
    return out.withColumn("significant", F.coalesce("significant", F.lit(False)))


def poisson_null(n: Column, span_min: Column, window_min: Column) -> Column:
    """Chance that a random partner falls within the window on either side; null without a span."""
    return 1 - F.exp(-F.try_divide(n.cast("double"), span_min) * 2 * window_min)
