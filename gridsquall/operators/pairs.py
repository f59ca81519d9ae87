"""Station pairs and joins in time.

Interval joins turn time into buckets of the tolerance: one side goes to its own bucket
and both neighbours, so an equi-join finds all partners within the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.functions.geo import haversine
from gridsquall.operators.places import station_pairs


def pair_distances(stations: DataFrame) -> DataFrame:
    """``i, j, dist`` for ``i < j``; the station table is small and fixed (one row a sensor)."""
    a = stations.select(F.col("sid").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"))
    b = stations.select(F.col("sid").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"))
    return a.join(b, F.col("i") < F.col("j")).withColumn("dist", haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return pairs.select("i", "j", "dist").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))


def swapped(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, with all its columns, from one pass over the pairs."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    way = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("_w")
    return pairs.select(way, *rest).select("_w.*", *rest)


def near_pairs(stations: DataFrame, radius_m: float) -> DataFrame:
    """Pairs within a radius, by tiles of places instead of all pairs."""
    return station_pairs(stations, radius_m)


def bucketed(df: DataFrame, us: str, width_us: int, spread: bool) -> DataFrame:
    b = F.floor(F.col(us) / F.lit(width_us)).cast("long")
    return df.withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)) if spread else b)


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, keys: list[str], left_us: str, right_us: str, take: list[str], id_cols: list[str]) -> DataFrame:
    """Each left row with the nearest right row within the tolerance, or nulls; the earlier one on ties."""
    a = bucketed(left.select(*id_cols, *[k for k in keys if k not in id_cols], left_us), left_us, tolerance_us, True)
    b = bucketed(right.select(*keys, right_us, *take), right_us, tolerance_us, False)
    gap = F.abs(F.col(left_us) - F.col(right_us))
    near = a.join(b, [*keys, "_bucket"]).filter(gap <= tolerance_us)
    best = near.groupBy(*id_cols).agg(F.min_by(F.struct(right_us, *take), F.struct(gap, F.col(right_us))).alias("_m"))
    return left.join(best.select(*id_cols, "_m.*"), id_cols, "left")


def match_events(pairs: DataFrame, events: DataFrame, others: DataFrame, window_us: Column) -> DataFrame:
    """For every directed pair and event of ``i``, the nearest event of ``j`` within the pair's window.

    ``found``, ``us_j``, ``mag_j``, ``dir_j`` describe it; ``any_extreme`` tells whether any
    partner in the window exceeds ``u_j``.  Windows are at most 30 minutes, the bucket width.
    The events of ``j`` are the small side: each bucket's list holds those of its neighbours,
    too, so the pairs' events meet one list each and need no second shuffle.
    """
    width = 1_800_000_000
    e = events.select(F.col("sid").alias("i"), F.col("event_id").alias("event_i"), F.col("start_us").alias("us_i"), F.col("mag").alias("mag_i"))
    o = others.select(F.col("sid").alias("j"), F.col("start_us").alias("us_j"), F.col("mag").alias("mag_j"), F.col("direction").alias("dir_j"), F.col("event_id").alias("event_j"), F.col("u").alias("u_j"))
    lists = bucketed(o, "us_j", width, True).groupBy("j", "_bucket").agg(F.collect_list(F.struct("us_j", "event_j", "mag_j", "dir_j", "u_j")).alias("_o"))
    base = pairs.withColumn("window_us", window_us).join(e, "i")
    apart = lambda r: F.abs(F.col("us_i") - r["us_j"])
    near = bucketed(base, "us_i", width, False).join(lists, ["j", "_bucket"], "left").withColumn("_o", F.filter("_o", lambda r: apart(r) <= F.col("window_us")))
    best = F.array_min(F.transform("_o", lambda r: F.struct(apart(r).alias("gap"), r["us_j"].alias("us_j"), r["event_j"].alias("event_j"), r["mag_j"].alias("mag_j"), r["dir_j"].alias("dir_j"))))
    near = near.withColumn("_m", best).withColumn("any_extreme", F.coalesce(F.exists("_o", lambda r: r["mag_j"] > r["u_j"]), F.lit(False)))
    return near.select(*pairs.columns, "event_i", "us_i", "mag_i", F.col("_m").isNotNull().alias("found"), "_m.us_j", "_m.mag_j", "_m.dir_j", "any_extreme")


def neighbours_in_time(others: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """The first of a station's events at each time, with the station's times before and after, and the last extreme time up to it and the first from it on."""
    first = F.min_by(F.struct(F.col("mag").alias("mag_j"), F.col("direction").alias("dir_j"), *(F.col(c).alias(f"{c}_j") for c in extra)), "event_id")
    g = others.groupBy("sid", F.col("start_us").alias("us_j")).agg(first.alias("_f"), F.bool_or(F.col("mag") > F.col("u")).alias("_hot"))
    w = Window.partitionBy("sid").orderBy("us_j")
    hot = F.when(F.col("_hot"), F.col("us_j"))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return g.select("sid", "us_j", "_f.*", F.lag("us_j").over(w).alias("_before"), F.lead("us_j").over(w).alias("_after"), F.last(hot, True).over(back).alias("_hot_before"), F.first(hot, True).over(on).alias("_hot_after"))


def match_near(events: DataFrame, others: DataFrame, stations: DataFrame, radius_m: float, window_us: Column, most_us: int = 1_800_000_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``match_events`` finds, without the pairs: the matched events only, with the ``extra`` columns of both as ``_i`` and ``_j``.

    Events of i go to their own and all neighbouring cells of the radius and of ``most_us``, the
    longest window, so one equi-join on place and time brings the candidates together.  Events of
    j bring the times of their neighbours, by which a candidate tells whether it is the
    nearest: no match is shuffled, no pair of stations and no unmatched event is written out.
    ``window_us`` is an expression of ``dist``.
    """
    dy, dx = radius_m / 110_540.0 * 1.01, radius_m / (111_320.0 * 0.5) * 1.01
    place = stations.select("sid", "lat", "lon", F.floor(F.col("lat") / dy).alias("_y"), F.floor(F.col("lon") / dx).alias("_x"))
    side = lambda df, k: df.join(place, "sid").withColumnsRenamed({"sid": k, "lat": f"lat_{k}", "lon": f"lon_{k}"})
    own = [f"{c}_i" for c in extra]
    e = side(events.select("sid", F.col("event_id").alias("event_i"), F.col("start_us").alias("us_i"), F.col("mag").alias("mag_i"), *(F.col(c).alias(n) for c, n in zip(extra, own, strict=True))), "i")
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    rest = ["i", "lat_i", "lon_i", "event_i", "us_i", "mag_i", *own]
    e = bucketed(e, "us_i", most_us, True).select(*rest, "_bucket", near("_y"), "_x").select(*rest, "_bucket", "_y", near("_x"))
    o = bucketed(side(neighbours_in_time(others, extra), "j"), "us_j", most_us, False)
    gap = lambda c: F.abs(F.col("us_i") - F.col(c))
    nearest = F.coalesce(gap("us_j") < gap("_before"), F.lit(True)) & F.coalesce(gap("us_j") <= gap("_after"), F.lit(True))
    x = e.join(o, ["_bucket", "_y", "_x"]).filter((F.col("i") != F.col("j")) & (gap("us_j") <= most_us) & nearest)
    x = x.withColumn("dist", haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))
    x = x.filter(F.col("dist") < radius_m).withColumn("_w", window_us).filter(gap("us_j") <= F.col("_w"))
    hot = lambda c: F.coalesce(gap(c) <= F.col("_w"), F.lit(False))
    return x.select("i", "j", "dist", "event_i", "us_i", "mag_i", "us_j", "mag_j", "dir_j", (hot("_hot_before") | hot("_hot_after")).alias("any_extreme"), *own, *(f"{c}_j" for c in extra))


def asof_sources(times: DataFrame, tables: DataFrame, at: str, us: str, source: str, tolerance: str, take: list[str]) -> DataFrame:
    """The nearest row of every source's table within the source's own tolerance, the earlier one on ties: ``at, source, gap`` and ``take``.

    Times go to their own bucket of each tolerance there is, rows of the tables to their own
    and both neighbours, so one equi-join serves all sources.
    """
    widths = tables.select(tolerance).distinct()
    bucket = lambda c: F.floor(F.col(c) / F.col(tolerance)).cast("long")
    asked = times.crossJoin(F.broadcast(widths.limit(64))).withColumn("_bucket", bucket(at))  # a row for each kind of tolerance
    near = F.explode(F.array(bucket(us) - 1, bucket(us), bucket(us) + 1))
    gap = F.abs(F.col(at) - F.col(us))
    found = asked.join(tables.withColumn("_bucket", near), [tolerance, "_bucket"]).filter(gap <= F.col(tolerance))
    best = found.groupBy(at, source).agg(F.min_by(F.struct(gap.alias("gap"), *take), F.struct(gap, F.col(us))).alias("_m"))
    return best.select(at, source, "_m.*")


def sampled_pairs(members: DataFrame, group: str, ident: str, value: str, most: int, least: int) -> DataFrame:
    """At most ``most`` pairs of the members of every group of at least ``least``: ``group, i, j, t_i, t_j`` with i before j.

    The pairs of a group of n are numbered 0 to n (n - 1) / 2; numbers in steps of a prime
    are drawn and turned into the pair's two places, so no other pair is ever formed.
    """
    placed = members.select(group, ident, value, (F.row_number().over(Window.partitionBy(group).orderBy(ident)) - 1).cast("long").alias("_pos"))
    n = F.col("_n")
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(n >= max(2, least)).withColumn("_total", F.floor(n * (n - 1) / 2).cast("long"))
    step = F.when(F.col("_total") % 1_000_003 == 0, 998_244_353).otherwise(1_000_003)
    drawn = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_total"), F.lit(most)) - 1)).alias("_r"))
    drawn = drawn.withColumn("_m", (F.col(group) * 7919 + F.col("_r") * step) % F.col("_total"))
    m = F.col("_m")
    start = lambda a: a * n - F.floor(a * (a + 1) / 2)
    guess = F.floor((2 * n - 1 - F.sqrt((2 * n - 1) * (2 * n - 1) - 8 * m)) / 2).cast("long")
    drawn = drawn.withColumn("_g", guess)
    g = F.col("_g")
    drawn = drawn.withColumn("_a", g - (m < start(g)).cast("long") + (m >= start(g + 1)).cast("long"))
    drawn = drawn.withColumn("_b", m - start(F.col("_a")) + F.col("_a") + 1)
    one = lambda pos, i, t: placed.select(group, F.col("_pos").alias(pos), F.col(ident).alias(i), F.col(value).alias(t))
    return drawn.select(group, "_a", "_b").join(one("_a", "i", "t_i"), [group, "_a"]).join(one("_b", "j", "t_j"), [group, "_b"]).select(group, "i", "j", "t_i", "t_j")
