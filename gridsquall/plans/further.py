"""Queries that complete operators of the other modules: sources, seasons, circular and binned
statistics, grids of thresholds, full correlation and ramp shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsquall.operators import events as E
from gridsquall.operators import stats
from gridsquall.operators import tail as T
from gridsquall.plans.registry import query
from gridsquall.plans.sql import DAILY, sql
from gridsquall.plans.statistics import door_sql
from gridsquall.session import cut
from gridsquall.sources import adapters as A
from gridsquall.sources import files


def r6(c):
    return F.round(c, 6)


GRID_VALUE = "CASE WHEN (us // 3600000000 + 3) % 13 > 0 THEN speed * (1 + 3/10.0::DOUBLE) END"


@query("A8_station_of_grid_file", sql(f"SELECT us, round(v, 6) AS speed FROM (SELECT us, {GRID_VALUE} AS v FROM wind) WHERE v IS NOT NULL"))
def _(spark, d):
    """One station of files that hold an array over all stations for each time; times without a finite value go."""
    w = A.wind(A.events(spark, d))
    hour = F.floor(F.col("us") / 3.6e9).cast("long")
    value = lambda s: F.when((hour + s) % 13 > 0, F.col("speed") * (1 + s / 10.0)).otherwise(F.lit(float("nan")))
    grid = w.select("us", F.transform(F.sequence(F.lit(0), F.lit(9)), value).alias("values"))
    return files.station_of_grid(files.parquet_round_trip(grid.withColumn("day", F.floor(F.col("us") / F.lit(A.DAY_US))), ["day"]), 3).select("us", r6("value").alias("speed"))


#: Objects in a file, about 0.3 MB of text.
JSON_ROWS = 5_000


@query("A9_json_array_files", sql("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN round(value, 4) END AS power FROM ev"))
def _(spark, d):
    """Files with one JSON array each: a kept list of renamed fields; what is no number becomes null."""
    e = A.events(spark, d)
    parts = max(8, -(-e.count() // JSON_ROWS))
    rows = e.select(F.pmod(F.xxhash64("event_id"), F.lit(parts)).alias("part"), F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.round("value", 4).cast("string")).otherwise("n/a").alias("pac"), F.lit("x").alias("unused")).alias("r"))
    return files.json_array_round_trip(rows, {"id": ("event_id", "long"), "pac": ("power", "double")})


SEASON = "CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m <= 5 THEN 'MAM' WHEN m <= 8 THEN 'JJA' ELSE 'SON' END"


@query("B13_all_seasons", f"SELECT {SEASON} AS season, count(*) AS n FROM (SELECT month(o_orderdate) AS m FROM orders) GROUP BY 1")
def _(spark, d):
    m = F.month("o_orderdate")
    season = F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")
    return A.table(spark, d, "orders").groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("D20_circular_correlation", sql("""SELECT day, count(*) AS n, round(sum(sin(a-ma)*sin(b-mb)) / nullif(sqrt(sum(power(sin(a-ma),2))*sum(power(sin(b-mb),2))), 0), 5) AS r, round(avg(cos(a-b)), 5) AS alignment FROM (
 SELECT *, atan2(avg(sin(a)) OVER d, avg(cos(a)) OVER d) AS ma, atan2(avg(sin(b)) OVER d, avg(cos(b)) OVER d) AS mb FROM (
  SELECT us // 86400000000 AS day, radians(dir) AS a, radians(lead(dir) OVER (ORDER BY us)) AS b FROM wind) WHERE b IS NOT NULL WINDOW d AS (PARTITION BY day)) GROUP BY day"""))
def _(spark, d):
    """Correlation of each hour's direction with the next one's, and their mean alignment, by day."""
    hour = Window.orderBy("us")  # one network series: a row for each hour
    w = A.wind(A.events(spark, d)).select(F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long").alias("day"), F.radians("dir").alias("a"), F.radians(F.lead("dir").over(hour)).alias("b")).filter("b IS NOT NULL")
    day = Window.partitionBy("day")
    mean = lambda c: F.atan2(F.avg(F.sin(c)).over(day), F.avg(F.cos(c)).over(day))
    x = w.select("day", "a", "b", F.sin(F.col("a") - mean("a")).alias("x"), F.sin(F.col("b") - mean("b")).alias("y"))
    r = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))
    return x.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(r, 5).alias("r"), F.round(F.avg(F.cos(F.col("a") - F.col("b"))), 5).alias("alignment"))


@query("D22_fixed_bins", sql("SELECT bin, count(*) AS n, round(avg(mag) + 1e-9::DOUBLE, 5) AS mean_mag, round(regr_sxy(mag, duration_min) / nullif(sqrt(regr_sxx(mag, duration_min)*regr_syy(mag, duration_min)), 0), 4) AS r FROM (SELECT mag, duration_min, floor(mag / 0.1::DOUBLE)::BIGINT AS bin FROM ramps) GROUP BY bin"))
def _(spark, d):
    """Bins of fixed width, with Pearson's r in each."""
    b = A.ramps(A.events(spark, d)).withColumn("bin", F.floor(F.col("mag") / 0.1))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mag") + 1e-9, 5).alias("mean_mag"), F.round(stats.correlation("duration_min", "mag"), 4).alias("r"))


@query("D26_epsilon_delta_grid", door_sql("SELECT eps AS epsilon, delta, count(*) AS n, count(DISTINCT sid) AS n_stations FROM found JOIN (VALUES (0.05::DOUBLE), (0.10), (0.15), (0.20)) g(delta) ON abs(d) >= delta AND abs(d) >= 0.05 GROUP BY 1, 2", 0.01, 0.02, 0.05))
def _(spark, d):
    """Ramps counted for every tolerance and threshold, with one compression for each tolerance."""
    s = cut(A.series(A.events(spark, d)))
    found = None
    for eps in (0.01, 0.02, 0.05):
        segments = E.segment_ramps(E.sdt_segments(s, eps), 0.05, 10).select("sid", F.abs("delta_k").alias("mag"), F.lit(eps).alias("epsilon"))
        found = segments if found is None else found.unionByName(segments)
    grid = found.select("epsilon", "sid", "mag", F.explode(F.array(*map(F.lit, (0.05, 0.10, 0.15, 0.20)))).alias("delta")).filter("mag >= delta")
    return grid.groupBy("epsilon", "delta").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("n_stations"))


@query("D28_portfolio_correlated_sigma", sql("""SELECT round(sqrt(sum(a.w*b.w*c)), 6) AS sigma FROM (
 SELECT x.sid AS i, y.sid AS j, covar_samp(x.m, y.m) AS c FROM daily x JOIN daily y USING (day) GROUP BY 1, 2) JOIN w a ON a.sid = i JOIN w b ON b.sid = j""", DAILY, """
w AS (SELECT s.sid, cap/sum(cap) OVER () AS w FROM stations s JOIN (SELECT sid FROM train GROUP BY sid) t USING (sid))"""))
def _(spark, d):
    """sqrt(sum sum w w rho s s) with the Pearson matrix of the stations' daily maxima.

    The double sum is the variance of the weighted daily sum, so no pair is ever formed.
    """
    e = A.events(spark, d)
    daily = T.daily_matrix(A.ramps(e).filter("split = 'train'"))
    w = A.stations(e).join(daily.select("sid").distinct(), "sid").select("sid", "cap")
    total = w.agg(F.sum("cap").alias("total"))  # one row
    day = daily.join(w, "sid").groupBy("day").agg(F.sum(F.col("cap") * F.col("m")).alias("x"))
    return day.agg(F.stddev_samp("x").alias("s")).crossJoin(F.broadcast(total)).select(r6(F.try_divide("s", "total")).alias("sigma"))


#: Station values at every minute between neighbouring samples of a day, as the minute adapter has them.
MINUTE_SQL = """
two AS (SELECT sid, us, k, lag(us) OVER w AS us0, lag(k) OVER w AS k0 FROM series WINDOW w AS (PARTITION BY sid ORDER BY us, event_id)),
line AS (SELECT *, us0 // 86400000000 AS day, ceil((us0 - us0 // 86400000000 * 86400000000) / 6e7::DOUBLE)::BIGINT AS a, ceil((us - us0 // 86400000000 * 86400000000) / 6e7::DOUBLE)::BIGINT AS b
 FROM two WHERE k IS NOT NULL AND k0 IS NOT NULL AND us // 86400000000 = us0 // 86400000000),
minutes AS (SELECT sid, day, minute, k0 + (k - k0) * (minute * 6e7::DOUBLE - (us0 - day * 86400000000)) / (us - us0) AS k FROM (SELECT *, unnest(range(a, b)) AS minute FROM line WHERE b > a))
"""


@query("E12_rolling_crossing_30", sql("SELECT sid, day, min(minute)::BIGINT AS minute FROM (SELECT sid, day, minute, CASE WHEN count(*) OVER w >= 21 THEN avg(k) OVER w END AS mean FROM minutes WINDOW w AS (PARTITION BY sid, day ORDER BY minute RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE round(mean, 9) > 0.5 GROUP BY 1, 2", MINUTE_SQL))
def _(spark, d):
    """For each station and day the first minute at which the mean of the last 30 minutes (21 with a value at least) exceeds one half."""
    return E.rolling_minutes(A.minute_lines(A.events(spark, d)), 30, 21, 0.5)


@query("G17_ramp_shape", sql("SELECT event_id, t AS minute, round(delta_k * t / 10.0::DOUBLE, 6) + 0.0::DOUBLE AS dk FROM ramps, range(11) s(t)"))
def _(spark, d):
    """Each ramp as a linear patch of eleven points."""
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("minute")
    return A.ramps(A.events(spark, d)).select("event_id", "delta_k", t).select("event_id", "minute", (r6(F.col("delta_k") * F.col("minute") / 10.0) + 0.0).alias("dk"))
