"""Queries on scans, cleaning and scalar functions (A, B, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsquall.functions import geo
from gridsquall.operators import clean, solar
from gridsquall.plans.registry import query
from gridsquall.plans.sql import HAVERSINE, PAIRS, sql
from gridsquall.sources import adapters as A
from gridsquall.sources import files


def r6(c):
    return F.round(c, 6)


@query("A1_parquet_scan", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", "value", "event_type").filter("event_type = 'purchase' AND value > 50").drop("event_type")


@query("A2_wide_csv_unpivot", sql("SELECT sid, us, round(k, 6) AS k FROM (SELECT sid, us // 3600000000 * 3600000000 AS us, avg(k) AS k FROM series GROUP BY 1, 2) WHERE k IS NOT NULL"))
def _(spark, d):
    """Hourly means written as one wide CSV (a column for each station) and read back long."""
    s = A.series(A.events(spark, d)).withColumn("us", F.floor(F.col("us") / 3.6e9).cast("long") * 3_600_000_000)
    long = s.groupBy("sid", "us").agg(F.avg("k").alias("k")).filter("k IS NOT NULL")
    return files.long_csv_round_trip(long).select("sid", "us", r6("k").alias("k"))


@query("A3_metadata_csv", sql("SELECT sid, round(lat, 6) AS lat, round(lon, 6) AS lon, round(cap / 1000, 6) AS cap_kw FROM stations"))
def _(spark, d):
    return files.metadata_round_trip(A.stations(A.events(spark, d)))


@query("A4_commented_text", sql("SELECT us // 3600000000 AS hour, round(speed*10)::BIGINT AS ff, dir FROM wind"))
def _(spark, d):
    w = A.wind(A.events(spark, d)).select(F.floor(F.col("us") / 3.6e9).cast("long").alias("hour"), F.round(F.col("speed") * 10).cast("long").alias("ff"), F.col("dir").cast("long").alias("dir"))
    return files.commented_text_round_trip(w)


@query("A7_nearest_grid_point", sql("""
SELECT sid, arg_min(g, (round(dist, 3), g)) AS grid_id, round(min(dist), 3) AS dist FROM (
 SELECT a.sid, b.g, """ + HAVERSINE + """ AS dist FROM stations a, (SELECT x*10+y AS g, 52.0::DOUBLE+x/90.0::DOUBLE AS lat, 5.0::DOUBLE+y/60.0::DOUBLE AS lon FROM range(10) t(x), range(10) s(y)) b) GROUP BY sid"""))
def _(spark, d):
    """Each station with the nearest of a 10 x 10 grid (a fixed number of points, so broadcast)."""
    x, y = F.floor(F.col("id") / 10), F.col("id") % 10
    grid = F.broadcast(spark.range(100).select(F.col("id").alias("g"), (52.0 + x / 90.0).alias("glat"), (5.0 + y / 60.0).alias("glon")))
    near = A.stations(A.events(spark, d)).crossJoin(grid).withColumn("dist", geo.haversine(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon")))
    return near.groupBy("sid").agg(F.min_by("g", F.struct(F.round("dist", 3), F.col("g"))).alias("grid_id"), F.round(F.min("dist"), 3).alias("dist"))


@query("A9_json_scan", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def _(spark, d):
    e = A.table(spark, d, "events").filter("props IS NOT NULL")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("A10_file_discovery", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, d):
    """One file tree with a folder for each kind; a glob leaves one out and the path gives the key."""
    return files.discovered(A.table(spark, d, "events").select("event_id", "event_type")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("A11_padded_hour_timestamp", "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS us FROM events")
def _(spark, d):
    e = A.events(spark, d)
    t = F.timestamp_micros("us")
    text = F.concat_ws(" ", F.date_format(t, "yyyy-MM-dd"), F.lpad((F.hour(t) * 100).cast("string"), 4, "0"))
    return e.select("event_id", F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm"))).alias("us"))


@query("A12_multi_file_keyed", "SELECT n_name AS key, 'nation' AS stem FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def _(spark, d):
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet", 1).alias("stem")
    return A.table(spark, d, "nation").select(F.col("n_name").alias("key"), stem).unionByName(A.table(spark, d, "region").select(F.col("r_name").alias("key"), stem))


@query("A13_plant_merge", sql("SELECT s.sid, s.event_id, round(w.speed, 6) AS speed FROM series s LEFT JOIN wind w ON w.us = s.us // 3600000000 * 3600000000"))
def _(spark, d):
    e = A.events(spark, d)
    w = A.wind(e).select("us", "speed")
    s = A.series(e).select("sid", "event_id", (F.floor(F.col("us") / 3.6e9).cast("long") * 3_600_000_000).alias("us"))
    return s.join(w, "us", "left").select("sid", "event_id", r6("speed").alias("speed"))


@query("A15_parquet_sink", sql("SELECT event_id, direction, split FROM ramps"))
def _(spark, d):
    return files.parquet_round_trip(A.ramps(A.events(spark, d)).select("event_id", "direction", "split"), ["split"])


@query("A16_audit_latest", "SELECT o_custkey % 7 AS script, o_orderpriority AS gate, max(o_orderkey) AS run FROM orders GROUP BY 1, 2")
def _(spark, d):
    """An append-only log of runs; the latest record of each key counts."""
    from gridsquall.operators.audit import latest

    log = A.table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("script"), F.col("o_orderpriority").alias("gate"), F.col("o_orderkey").alias("run"))
    return latest(log, ["script", "gate"], "run")


@query("A17_mapping_csv", sql("SELECT i, arg_min(j, (round(dist, 3), j)) AS j FROM (SELECT i, j, dist FROM pairs UNION ALL SELECT j, i, dist FROM pairs) GROUP BY i", PAIRS))
def _(spark, d):
    from gridsquall.operators.places import nearest

    near = nearest(A.stations(A.events(spark, d))).withColumnRenamed("sid", "i")
    return files.csv_round_trip(near, "i long, j long")


@query("A19_hash_fallback", sql("SELECT event_id, round(((event_id*7919 + 104729) % 1000) / 50.0::DOUBLE, 6) AS speed, (event_id*7919 + 17) % 360 AS dir, true AS synthetic FROM ramps"))
def _(spark, d):
    """Deterministic stand-in wind, always flagged."""
    r, i = A.ramps(A.events(spark, d)), F.col("event_id")
    return r.select("event_id", r6((i * 7919 + 104729) % 1000 / 50.0).alias("speed"), ((i * 7919 + 17) % 360).alias("dir"), F.lit(True).alias("synthetic"))


SPANS = "spans AS (SELECT sid, min(us) + 86400000000 AS b, max(us) - 86400000000 AS e FROM series GROUP BY sid)"


@query("B1_operational_clip", sql("SELECT s.sid, event_id, round(CASE WHEN s.us BETWEEN b AND e THEN k END, 6) AS k FROM series s JOIN spans USING (sid)", SPANS))
def _(spark, d):
    s = A.series(A.events(spark, d))
    spans = s.groupBy("sid").agg((F.min("us") + A.DAY_US).alias("begin_us"), (F.max("us") - A.DAY_US).alias("end_us"))
    return clean.clip_operational(s, spans).select("sid", "event_id", r6("k").alias("k"))


@query("B2_censoring_report", sql("SELECT sid, count(*) AS n_total, count(k) AS n_valid, round(100*count(k)::DOUBLE/count(*), 2) AS pct_valid, round(100 - 100*count(k)::DOUBLE/count(*), 2) AS pct_censored FROM series GROUP BY sid"))
def _(spark, d):
    return clean.censoring_report(A.series(A.events(spark, d)))


@query("B3_modal_step", sql("SELECT sid, arg_min(step, (-n, step)) AS step_min, max(n) AS n FROM (SELECT sid, step, count(*) AS n FROM (SELECT sid, (us - lag(us) OVER (PARTITION BY sid ORDER BY us, event_id)) // 60000000 AS step FROM series) WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY sid"))
def _(spark, d):
    return clean.modal_step(A.series(A.events(spark, d)))


@query("B4_capacity_normalise", sql("SELECT sid, count(*) AS n, count(CASE WHEN p BETWEEN 0 AND 1.1 THEN 1 END) AS n_valid, round(avg(CASE WHEN p BETWEEN 0 AND 1.1 THEN p END) + 1e-9::DOUBLE, 4) AS mean_p FROM (SELECT sid, k/cap AS p FROM series JOIN stations USING (sid)) GROUP BY sid"))
def _(spark, d):
    e = A.events(spark, d)
    p = clean.capacity_normalise(A.series(e), A.stations(e))
    return p.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_valid"), F.round(F.avg("p") + 1e-9, 4).alias("mean_p"))


SUN = """
sun0 AS (SELECT s.sid, s.event_id, s.us, s.k, t.lat, t.lon, t.cap, s.us/8.64e10::DOUBLE + 2440587.5 - 2451545.0 AS n, dayofyear(make_timestamp(s.us)) AS doy FROM series s JOIN stations t USING (sid)),
sun1 AS (SELECT *, radians(357.528 + 0.9856003*n) AS g, radians(23.439 - 0.0000004*n) AS ob FROM sun0),
sun2 AS (SELECT *, radians(280.460 + 0.9856474*n + 1.915*sin(g) + 0.020*sin(2*g)) AS lam FROM sun1),
sun3 AS (SELECT *, asin(sin(ob)*sin(lam)) AS dec, degrees(atan2(cos(ob)*sin(lam), cos(lam))) AS ra FROM sun2),
sun AS (SELECT *, degrees(asin(sin(radians(lat))*sin(dec) + cos(radians(lat))*cos(dec)*cos(radians(280.46061837 + 360.98564736629*n + lon - ra)))) AS elev, cos(2*pi()*(doy-172)/365.25) AS season FROM sun3)
"""
GHI = """
sky0 AS (SELECT *, 1/(sin(radians(elev)) + 0.50572*power(greatest(elev, 0.0)+6.07995, -1.6364)) AS am, 2*pi()*(doy-1)/365 AS b FROM sun),
sky AS (SELECT *, CASE WHEN elev > 0 THEN (5.09e-5::DOUBLE*5+0.868)*1366.1*(1.00011+0.034221*cos(b)+0.00128*sin(b)+0.000719*cos(2*b)+0.000077*sin(2*b))*sin(radians(elev))*exp(-(3.92e-5::DOUBLE*5+0.0387)*am*(exp(-5.0/8000)+exp(-5.0/1250)*2))*exp(0.01*power(am, 1.8)) ELSE 0 END AS ghi FROM sky0)
"""


def _sun(spark, d):
    e = A.events(spark, d)
    s = A.series(e).join(A.stations(e), "sid").withColumn("doy", F.dayofyear(F.timestamp_micros("us")))
    return s.withColumn("elev", solar.elevation(F.col("us"), F.col("lat"), F.col("lon")))


@query("B5_clear_sky_ghi", sql("SELECT event_id, round(ghi, 4) AS ghi FROM sky", SUN, GHI))
def _(spark, d):
    return _sun(spark, d).select("event_id", F.round(solar.clear_sky_ghi(F.col("elev"), F.col("doy")), 4).alias("ghi"))


@query("B6_clear_sky_index", sql("SELECT sid, count(i) AS n, round(quantile_cont(i, 0.5), 5) AS median, round(quantile_cont(i, 0.95), 5) AS p95 FROM (SELECT sid, CASE WHEN ghi/1000 > 0.005 AND k/cap/(ghi/1000) BETWEEN 0 AND 1.5 THEN k/cap/(ghi/1000) END AS i FROM sky) GROUP BY sid", SUN, GHI))
def _(spark, d):
    s = _sun(spark, d)
    i = clean.clear_sky_index(F.col("k") / F.col("cap"), solar.clear_sky_ghi(F.col("elev"), F.col("doy")))
    return s.withColumn("i", i).groupBy("sid").agg(F.count("i").alias("n"), F.round(F.percentile("i", 0.5), 5).alias("median"), F.round(F.percentile("i", 0.95), 5).alias("p95"))


@query("B7_solar_covariates", sql("SELECT event_id, round(elev, 5) AS elev, round(season, 6) AS season FROM sun", SUN))
def _(spark, d):
    return _sun(spark, d).select("event_id", F.round("elev", 5).alias("elev"), r6(solar.season(F.col("doy"))).alias("season"))


@query("B8_temporal_split", sql("SELECT split, count(*) AS n, min(start_us) AS first_us FROM ramps GROUP BY 1"))
def _(spark, d):
    return A.ramps(A.events(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("first_us"))


@query("B9_hour_ending_to_utc", "SELECT event_id, epoch_us(CAST(ts::DATE AS TIMESTAMP)) + (hour(ts)+1)*3600000000 - 5400000000 AS us FROM events")
def _(spark, d):
    """Hour-ending local labels 1..24 (UTC+1) to the middle of the hour in UTC: 90 minutes less."""
    e = A.events(spark, d)
    day = F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long") * A.DAY_US
    label = F.hour(F.timestamp_micros("us")) + 1
    return e.select("event_id", (day + label * F.lit(3_600_000_000) - F.lit(5_400_000_000)).alias("us"))


@query("B10_wind_clean", sql("SELECT us, round(speed/10, 6) AS speed, CASE WHEN dir IN (0, 990) THEN -1 ELSE dir END AS dir FROM (SELECT *, row_number() OVER (PARTITION BY us ORDER BY tag) AS rn FROM (SELECT *, 0 AS tag FROM wind UNION ALL SELECT us, speed+1, 990, 1 FROM wind)) WHERE rn = 1"))
def _(spark, d):
    w = A.wind(A.events(spark, d)).select("us", "speed", F.col("dir").cast("long").alias("dir"))
    twice = w.withColumn("tag", F.lit(0)).unionByName(w.select("us", (F.col("speed") + 1).alias("speed"), F.lit(990).cast("long").alias("dir"), F.lit(1).alias("tag")))
    one = clean.first_of(twice, ["us"], ["tag"])
    return one.select("us", r6(F.col("speed") / 10).alias("speed"), F.coalesce(F.when(~F.col("dir").isin(0, 990), F.col("dir")), F.lit(-1)).alias("dir"))


@query("B11_uv_to_speed_direction", sql("SELECT event_id, round(sqrt(u*u+v*v), 6) AS speed, round(((180+degrees(atan2(u,v))) % 360 + 360) % 360, 6) AS dir FROM (SELECT event_id, value/10-5 AS u, (event_id % 21)/2.0::DOUBLE-5.25 AS v FROM ev)"))
def _(spark, d):
    s, r = geo.from_components(F.col("value") / 10 - 5, F.col("event_id") % 21 / 2.0 - 5.25)
    return A.events(spark, d).select("event_id", r6(s).alias("speed"), r6(r).alias("dir"))


@query("B12_time_rounding", sql("SELECT event_id, round(us/6e8::DOUBLE)::BIGINT*600000000 AS us10, list_min([abs(us % 86400000000 - h*10800000000) FOR h IN range(8)]) / 6e7::DOUBLE AS dist_min FROM ev"))
def _(spark, d):
    """Nearest 10 minutes, and minutes to the nearest of 0, 3, ..., 21 h (no wrap to the next day)."""
    us = F.col("us")
    gap = F.least(*(F.abs(us % A.DAY_US - F.lit(h * 10_800_000_000)) for h in range(8))) / 6e7
    return A.events(spark, d).select("event_id", (F.round(us / 6e8).cast("long") * 600_000_000).alias("us10"), gap.alias("dist_min"))


@query("B13_season_filter", "SELECT o_orderpriority AS grp, count(*) FILTER (month(o_orderdate) IN (6,7,8)) AS jja, count(*) FILTER (month(o_orderdate) IN (12,1,2)) AS djf, count(*) FILTER (month(o_orderdate) NOT IN (6,7,8)) AS rest FROM orders GROUP BY 1")
def _(spark, d):
    m = F.month("o_orderdate")
    return A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count_if(m.isin(6, 7, 8)).alias("jja"), F.count_if(m.isin(12, 1, 2)).alias("djf"), F.count_if(~m.isin(6, 7, 8)).alias("rest"))


@query("B14_finite_filter", sql("SELECT event_id, round(k, 6) AS k FROM series WHERE k IS NOT NULL AND isfinite(k)"))
def _(spark, d):
    return A.series(A.events(spark, d)).na.drop(subset=["k"]).filter(F.abs("k") < float("inf")).select("event_id", r6("k").alias("k"))


@query("B15_distance_filter", sql("SELECT i, j, round(dist, 3) AS dist FROM pairs WHERE dist < 5000", PAIRS))
def _(spark, d):
    from gridsquall.operators.pairs import near_pairs

    return near_pairs(A.stations(A.events(spark, d)), 5000.0).select("i", "j", F.round("dist", 3).alias("dist"))


@query("B16_prefix_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(o.colRegex("`o_order.*`")).withColumn("o_orderdate", F.to_date("o_orderdate")).select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("B17_clipping", sql("SELECT event_id, round(least(mag*3, 1.0), 6) AS capped, round(least(greatest(mag, 0.2), 0.8), 6) AS clipped FROM ramps"))
def _(spark, d):
    m = F.col("mag")
    return A.ramps(A.events(spark, d)).select("event_id", r6(F.least(m * 3, F.lit(1.0))).alias("capped"), r6(F.least(F.greatest(m, F.lit(0.2)), F.lit(0.8))).alias("clipped"))


@query("B18_standard_names", "SELECT s_suppkey AS station_id, s_name AS station_name, s_nationkey AS region_id FROM supplier")
def _(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return s.withColumnsRenamed({"s_suppkey": "station_id", "s_name": "station_name", "s_nationkey": "region_id"})


@query("G1_haversine", sql("SELECT i, j, round(dist, 3) AS dist FROM pairs", PAIRS))
def _(spark, d):
    from gridsquall.operators.places import station_pairs

    return station_pairs(A.stations(A.events(spark, d))).select("i", "j", F.round("dist", 3).alias("dist"))


@query("G2_metres_to_degrees", sql("SELECT sid, round(150/(111320.0::DOUBLE*cos(radians(lat))), 9) AS dlon, round(150/111320.0::DOUBLE, 9) AS dlat FROM stations"))
def _(spark, d):
    x, y = geo.metres_to_degrees(F.lit(150.0), F.lit(150.0), F.col("lat"))
    return A.stations(A.events(spark, d)).select("sid", F.round(x, 9).alias("dlon"), F.round(y, 9).alias("dlat"))


BEARING = "((degrees(atan2(sin(radians(lon_j-lon_i))*cos(radians(lat_j)), cos(radians(lat_i))*sin(radians(lat_j))-sin(radians(lat_i))*cos(radians(lat_j))*cos(radians(lon_j-lon_i)))) % 360) + 360) % 360"


def _bearings(spark, d):
    from gridsquall.operators.places import station_pairs

    return station_pairs(A.stations(A.events(spark, d)), towards=geo.bearing).withColumnRenamed("towards", "brg")


@query("G3_bearing", sql(f"SELECT i, j, round({BEARING}, 5) AS brg FROM pairs", PAIRS))
def _(spark, d):
    return _bearings(spark, d).select("i", "j", F.round("brg", 5).alias("brg"))


@query("G4_wind_alignment", sql(f"SELECT i, j, round(cos(radians(((i*37+j) % 360 + 180) % 360 - {BEARING})), 5) AS align FROM pairs", PAIRS))
def _(spark, d):
    return _bearings(spark, d).select("i", "j", F.round(geo.alignment((F.col("i") * 37 + F.col("j")) % 360, F.col("brg")), 5).alias("align"))


@query("G5_expected_lag", sql(f"SELECT i, j, round(v, 5) AS v_along, CASE WHEN v > 1 THEN round(dist/v/60, 5) END AS lag_min, coalesce(dist/v/60 > 30, false) AND v > 1 AS censored FROM (SELECT i, j, dist, (3 + (i+j) % 12)*cos(radians(((i*37+j) % 360 + 180) % 360 - {BEARING})) AS v FROM pairs)", PAIRS))
def _(spark, d):
    v = (3 + (F.col("i") + F.col("j")) % 12) * geo.alignment((F.col("i") * 37 + F.col("j")) % 360, F.col("brg"))
    p = _bearings(spark, d).withColumn("v", v)
    lag = F.when(F.col("v") > 1, F.col("dist") / F.col("v") / 60)
    return p.select("i", "j", F.round("v", 5).alias("v_along"), F.round(lag, 5).alias("lag_min"), F.coalesce(lag > 30, F.lit(False)).alias("censored"))


@query("G6_planar_projection", sql("SELECT sid, round((lon - m_lon)*111320.0::DOUBLE*cos(radians(m_lat)), 4) AS x, round((lat - m_lat)*110540.0::DOUBLE, 4) AS y FROM stations, (SELECT avg(lat) AS m_lat, avg(lon) AS m_lon FROM stations)"))
def _(spark, d):
    s = A.stations(A.events(spark, d))
    x, y = geo.planar(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon"))
    centre = s.agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))  # one row
    return s.crossJoin(F.broadcast(centre)).select("sid", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("G7_laplace", "SELECT p_partkey, round(CASE WHEN u >= .5 THEN -ln(2*(1-u)) ELSE ln(2*u) END, 6) AS x FROM (SELECT p_partkey, (p_partkey % 997 + 1)/999.0::DOUBLE AS u FROM part)")
def _(spark, d):
    from gridsquall.operators.rank import laplace

    return A.table(spark, d, "part").select("p_partkey", r6(laplace((F.col("p_partkey") % 997 + 1) / 999.0)).alias("x"))


@query("G8_logit_expit", "SELECT p_partkey, round(ln(p/(1-p)), 6) AS logit, round(1/(1+exp(-(p*6-3))), 6) AS expit FROM (SELECT p_partkey, least(greatest((p_partkey % 101)/100.0::DOUBLE, 1e-4), 1-1e-4) AS p FROM part)")
def _(spark, d):
    from gridsquall.operators.rank import expit, logit

    p = F.least(F.greatest(F.col("p_partkey") % 101 / 100.0, F.lit(1e-4)), F.lit(1 - 1e-4))
    return A.table(spark, d, "part").select("p_partkey", r6(logit(p)).alias("logit"), r6(expit(p * 6 - 3)).alias("expit"))


@query("G9_distance_decay", sql("SELECT i, j, round(0.6*exp(-dist/1000/3.5), 6) AS a_exp, round(0.6*power(1+dist/1000, -0.4), 6) AS a_pow FROM pairs", PAIRS))
def _(spark, d):
    from gridsquall.operators.places import station_pairs
    from gridsquall.operators.rank import decay

    km = F.col("dist") / 1000
    return station_pairs(A.stations(A.events(spark, d))).select("i", "j", r6(decay(km, 0.6, 3.5, "exp")).alias("a_exp"), r6(decay(km, 0.6, 0.4, "pow")).alias("a_pow"))


@query("G10_return_level", "SELECT p_partkey, round(CASE WHEN abs(xi) < 1e-6 THEN 0.2 + 0.07*ln(n) ELSE 0.2 + 0.07/xi*(power(n, xi)-1) END, 6) AS z FROM (SELECT p_partkey, (p_partkey % 9 - 4)/20.0::DOUBLE AS xi, 70.0::DOUBLE*(1 + p_partkey % 5) AS n FROM part)")
def _(spark, d):
    from gridsquall.operators.rank import return_level

    xi, n = (F.col("p_partkey") % 9 - 4) / 20.0, 70.0 * (1 + F.col("p_partkey") % 5)
    return A.table(spark, d, "part").select("p_partkey", r6(return_level(F.lit(0.2), F.lit(0.07), xi, n)).alias("z"))


@query("G11_shape_standard_error", "SELECT p_partkey, round(sqrt(power(1-xi, 2)/n), 6) AS se FROM (SELECT p_partkey, (p_partkey % 9 - 4)/20.0::DOUBLE AS xi, 50 + p_partkey % 70 AS n FROM part)")
def _(spark, d):
    xi, n = (F.col("p_partkey") % 9 - 4) / 20.0, 50 + F.col("p_partkey") % 70
    return A.table(spark, d, "part").select("p_partkey", r6(F.sqrt(F.pow(1 - xi, 2) / n)).alias("se"))


@query("G13_date_parts", "SELECT event_id, ts::DATE AS day, hour(ts) AS h, minute(ts) AS mi, month(ts) AS mo, dayofyear(ts) AS doy FROM events")
def _(spark, d):
    t = F.timestamp_micros("us")
    parts = (F.to_date(t).alias("day"), F.hour(t).cast("long").alias("h"), F.minute(t).cast("long").alias("mi"), F.month(t).cast("long").alias("mo"), F.dayofyear(t).cast("long").alias("doy"))
    return A.events(spark, d).select("event_id", *parts)


@query("G14_string_functions", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS padded, c_custkey || '__' || c_nationkey AS pair_id, split_part(c_name, '#', 1) AS head, starts_with(c_name, 'Cust') AS pre, contains(c_name, '7') AS has7 FROM customer")
def _(spark, d):
    c = F.col("c_custkey").cast("string")
    return A.table(spark, d, "customer").select("c_custkey", F.lpad(c, 8, "0").alias("padded"), F.concat_ws("__", c, F.col("c_nationkey").cast("string")).alias("pair_id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"), F.col("c_name").startswith("Cust").alias("pre"), F.col("c_name").contains("7").alias("has7"))


@query("G16_json_records", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type AS kind FROM events")
def _(spark, d):
    """Records written as JSON lines and read back."""
    e = A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind"))
    line = e.select(F.to_json(F.struct("event_id", "k", "kind")).alias("j"))
    return line.select(F.from_json("j", "event_id long, k long, kind string").alias("r")).select("r.*")


@query("G17_array_functions", "SELECT o_custkey, i AS pos, round(min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY i), 2) AS running_min FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = A.table(spark, d, "orders").withColumn("pos", F.row_number().over(w).cast("long"))
    return o.select("o_custkey", "pos", F.round(F.min("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running_min"))
