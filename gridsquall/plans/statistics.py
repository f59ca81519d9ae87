"""Queries on aggregates, statistics and ordered operators (D, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridsquall.operators import events as E
from gridsquall.operators import rank as R
from gridsquall.operators import stats as S
from gridsquall.operators import tail as T
from gridsquall.operators import tiles
from gridsquall.operators.clean import first_of
from gridsquall.operators.places import station_pairs
from gridsquall.plans.joins import NEAR, THRESH, event_counts
from gridsquall.plans.registry import query
from gridsquall.plans.sql import DAILY, PAIRS, sql
from gridsquall.sources import adapters as A


def r6(c):
    return F.round(c, 6)


def r4(c):
    return F.round(c, 4)


def _train(spark, d):
    return A.ramps(A.events(spark, d)).filter("split = 'train'")


def _daily(spark, d):
    return T.daily_matrix(_train(spark, d))


def _margins(spark, d):
    return T.uniform_margins(_daily(spark, d))


@query("D1_daily_max_matrix", sql("SELECT sid, day, round(m, 6) AS m, round(minute, 4) AS minute FROM daily", DAILY))
def _(spark, d):
    return _daily(spark, d).select("sid", "day", r6("m").alias("m"), r4("minute").alias("minute"))


@query("D2_grouped_counts_pivot", sql("SELECT sid, count(*) FILTER (split='train') AS train, count(*) FILTER (split='test') AS test, count(*) FILTER (direction='up') AS n_up FROM ramps GROUP BY sid"))
def _(spark, d):
    r = A.ramps(A.events(spark, d))
    return r.groupBy("sid").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("direction") == "up").alias("n_up"))


@query("D3_null_aware_sum", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)/1000, 6) AS kq FROM lineitem GROUP BY 1")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return li.groupBy("l_orderkey").agg(r6(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))) / 1000).alias("kq"))


@query("D4_group_quantiles", sql("SELECT sid, round(median(mag), 6) AS q50, round(quantile_cont(mag, 0.75) - quantile_cont(mag, 0.25), 6) AS iqr, round(quantile_cont(mag, 0.95), 6) AS q95 FROM ramps GROUP BY sid"))
def _(spark, d):
    q = F.percentile("mag", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    r = A.ramps(A.events(spark, d)).groupBy("sid").agg(q.alias("q"))
    return r.select("sid", r6(F.get("q", F.lit(1))).alias("q50"), r6(F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), r6(F.get("q", F.lit(3))).alias("q95"))


@query("D5_capacity_weighted_mean", sql("SELECT us // 3600000000 AS h, round(CASE WHEN sum(CASE WHEN k IS NOT NULL THEN cap END) > 1e-9 THEN sum(cap*k)/sum(CASE WHEN k IS NOT NULL THEN cap END) END + 1e-9::DOUBLE, 6) AS k FROM series JOIN stations USING (sid) GROUP BY 1"))
def _(spark, d):
    """Weights are renormalised over the stations that have a value."""
    e = A.events(spark, d)
    s = A.series(e).join(A.stations(e).select("sid", "cap"), "sid")
    w = F.sum(F.when(F.col("k").isNotNull(), F.col("cap")))
    return s.groupBy(F.floor(F.col("us") / 3.6e9).cast("long").alias("h")).agg(r6(F.when(w > 1e-9, F.sum(F.col("cap") * F.col("k")) / w) + 1e-9).alias("k"))


CHI = """
days AS (SELECT count(DISTINCT day) AS n FROM margins),
joint AS (SELECT a.sid AS i, b.sid AS j, count(*) AS n_joint FROM margins a JOIN margins b ON a.day = b.day AND a.sid < b.sid WHERE a.u > 0.8 AND b.u > 0.8 GROUP BY 1, 2),
chi AS (SELECT i, j, dist, n, coalesce(n_joint, 0) AS n_joint FROM pairs LEFT JOIN joint USING (i, j), days)
"""


def _chi(spark, d, near=None, q=0.8):
    return T.joint_exceedance(_margins(spark, d), A.stations(A.events(spark, d)), q, near)


@query("D6_tail_dependence_chi", sql("SELECT i, j, n_joint, round(n_joint/(n*(1-0.8::DOUBLE)), 6) AS chi, round(CASE WHEN n_joint > 0 THEN CASE WHEN n_joint < n THEN greatest(-1.0, 2*ln(1-0.8::DOUBLE)/ln(n_joint::DOUBLE/n) - 1) ELSE 1.0 END ELSE -1.0 END, 6) AS chibar FROM chi WHERE dist < 5000", DAILY, PAIRS, CHI))
def _(spark, d):
    """Upper-tail co-occurrence of daily maxima for station pairs under 5 km."""
    c = _chi(spark, d, 5000.0)
    return c.select("i", "j", "n_joint", r6(T.chi(F.col("n_joint"), F.col("n"), 0.8)).alias("chi"), r6(T.chibar(F.col("n_joint"), F.col("n"), 0.8)).alias("chibar"))


@query("D7_coincidence_window", sql("SELECT p.i, p.j, v.v AS speed, count(*) AS n, round(avg((abs(a.minute - b.minute) <= p.dist/v.v/60)::INT), 6) AS frac FROM pairs p JOIN margins a ON a.sid = p.i JOIN margins b ON b.sid = p.j AND b.day = a.day, (VALUES (10), (15), (20)) v(v) WHERE p.dist < 5000 AND a.u > 0.8 AND b.u > 0.8 AND a.minute IS NOT NULL AND b.minute IS NOT NULL GROUP BY 1, 2, 3", DAILY, PAIRS))
def _(spark, d):
    """Share of joint days on which both peaks fit the travel time at three cloud speeds."""
    m = _margins(spark, d).filter("u > 0.8 AND minute IS NOT NULL")
    m = m.groupBy("sid").agg(F.collect_list(F.struct("day", "minute")).alias("r")).select("sid", F.col("r.day").alias("hot"), F.col("r.minute").alias("at"))
    speeds = (10, 15, 20)
    x = tiles.peak_gaps(A.stations(A.events(spark, d)).join(m, "sid", "left"), 5000.0, speeds)
    each = F.array(*(F.struct(F.lit(v).alias("speed"), F.col(f"hits_{k}").alias("hits")) for k, v in enumerate(speeds)))
    x = x.select("i", "j", "n", F.explode(each).alias("s"))
    return x.select("i", "j", "s.speed", F.col("n").cast("long").alias("n"), r6(F.col("s.hits") / F.col("n")).alias("frac"))


@query("D8_acf_block_length", sql("""
SELECT least(greatest(coalesce(min(l) FILTER (r < 0.2), 10), 2), 10)::BIGINT AS block_days, round(arg_min(r, l), 6) AS r1 FROM acf""", DAILY, """
dmean AS (SELECT day, avg(m) AS x FROM daily GROUP BY day), z AS (SELECT day, row_number() OVER (ORDER BY day) AS t, x - avg(x) OVER () AS x FROM dmean),
acf AS (SELECT l.l, sum(a.x*b.x)/(SELECT sum(x*x) FROM z) AS r FROM range(1, 16) l(l) JOIN z a ON true JOIN z b ON b.t = a.t + l.l GROUP BY 1)"""))
def _(spark, d):
    """First lag of the mean daily series with autocorrelation under 0.2, within 2..10 days."""
    from gridsquall.operators.resample import block_length

    return block_length(_daily(spark, d)).select("block_days", r6("r1").alias("r1"))


BH = """
p0 AS (SELECT i, j, (i*131 + j*17) % 997 / 1000.0::DOUBLE * (CASE WHEN (i+j) % 3 = 0 THEN 0.01 ELSE 1 END) AS p FROM pairs),
p1 AS (SELECT *, row_number() OVER (ORDER BY p, i, j) AS k, count(*) OVER () AS m FROM p0),
p2 AS (SELECT *, least(1.0, min(p*m/k) OVER (ORDER BY k DESC)) AS p_adjusted, max(CASE WHEN p <= k*0.05::DOUBLE/m THEN p END) OVER () AS crit FROM p1)
"""


@query("D12_benjamini_hochberg", sql("SELECT i, j, round(p_adjusted, 6) AS p_adjusted, coalesce(p <= crit, false) AS significant FROM p2", PAIRS, BH))
def _(spark, d):
    p = ((F.col("i") * 131 + F.col("j") * 17) % 997 / 1000.0) * F.when((F.col("i") + F.col("j")) % 3 == 0, 0.01).otherwise(1.0)
    return T.benjamini_hochberg(station_pairs(A.stations(A.events(spark, d))).withColumn("p", p), "p", few=True).select("i", "j", r6("p_adjusted").alias("p_adjusted"), "significant")


@query("D13_poisson_null", sql("SELECT sid, count(*) AS n, round(1-exp(-count(*)::DOUBLE/((max(start_us)-min(start_us))/6e7)*2*30), 6) AS p_null FROM ramps GROUP BY sid HAVING count(*) > 1"))
def _(spark, d):
    span = (F.max("start_us") - F.min("start_us")) / 6e7
    return A.ramps(A.events(spark, d)).groupBy("sid").agg(F.count(F.lit(1)).alias("n"), r6(T.poisson_null(F.count(F.lit(1)), span, F.lit(30.0))).alias("p_null")).filter("n > 1")


@query("D14_pair_event_summary", sql("SELECT i, j, count(*) AS n_extreme, count(*) FILTER (found) AS n_matched, round(avg(found::INT), 6) AS frac, round(avg((found AND mag_j > u)::INT), 6) AS chi_event, round(avg(any_extreme::INT), 6) AS chi_any FROM matched JOIN thresh ON sid = j GROUP BY 1, 2", PAIRS, THRESH, NEAR))
def _(spark, d):
    g = tiles.directed(event_counts(spark, d)).filter("n > 0 AND ramps_j > 0")
    share = lambda c: r6(F.col(c) / F.col("n"))
    return g.select("i", "j", F.col("n").alias("n_extreme"), F.col("found").alias("n_matched"), share("found").alias("frac"), share("nearest").alias("chi_event"), share("any").alias("chi_any"))


@query("D15_ols_regression", sql("SELECT sid, count(*) AS n, round(corr(mag, duration_min), 5) AS r, round(regr_slope(mag, duration_min), 7) AS slope, round(regr_intercept(mag, duration_min), 5) AS intercept FROM ramps GROUP BY sid HAVING count(*) > 2"))
def _(spark, d):
    n, r, slope, intercept, *_ = S.regression("duration_min", "mag")
    g = A.ramps(A.events(spark, d)).groupBy("sid").agg(n, r, slope, intercept).filter("n > 2")
    return g.select("sid", "n", F.round("r", 5).alias("r"), F.round("slope", 7).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("D15_ols_p_values")
def _(spark, d):
    g = A.ramps(A.events(spark, d)).groupBy("sid").agg(*S.regression("duration_min", "mag"))
    return g.withColumn("p", S.correlation_p("r", "n"))


AVG_RANK = "rank() OVER (PARTITION BY sid ORDER BY {0}) + (count(*) OVER (PARTITION BY sid, {0}) - 1)/2.0::DOUBLE"


@query("D16_spearman", sql("SELECT sid, round(corr(a, b), 5) AS rho FROM (SELECT sid, " + AVG_RANK.format("mag") + " AS a, " + AVG_RANK.format("duration_min") + " AS b FROM ramps) GROUP BY sid HAVING count(*) > 2"))
def _(spark, d):
    r = A.ramps(A.events(spark, d)).select("sid", R.average_rank("mag", "sid").alias("a"), R.average_rank("duration_min", "sid").alias("b"))
    return r.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(S.correlation("a", "b"), 5).alias("rho")).filter("n > 2").drop("n")


@query("D17_mann_whitney", sql("SELECT sid, count(*) FILTER (g=1) AS n1, count(*) FILTER (g=0) AS n0, round(sum(r) FILTER (g=1) - count(*) FILTER (g=1)*(count(*) FILTER (g=1)+1)/2, 4) AS u FROM (SELECT sid, (direction='up')::INT AS g, " + AVG_RANK.format("mag") + " AS r FROM ramps) GROUP BY sid HAVING count(*) FILTER (g=1) > 0"))
def _(spark, d):
    r = A.ramps(A.events(spark, d)).withColumn("g", (F.col("direction") == "up").cast("int"))
    return S.mann_whitney(r, ["sid"], "g", "mag").filter("n1 > 0").select("sid", "n1", "n0", r4("u").alias("u"))


@query("D18_two_proportions", sql("SELECT sid, round((a/n1 - b/n2)/sqrt((a+b)/(n1+n2)*(1-(a+b)/(n1+n2))*(1/n1+1/n2)), 5) AS z FROM (SELECT sid, count(*) FILTER (direction='up' AND split='train')::DOUBLE AS a, count(*) FILTER (split='train')::DOUBLE AS n1, count(*) FILTER (direction='up' AND split='test')::DOUBLE AS b, count(*) FILTER (split='test')::DOUBLE AS n2 FROM ramps GROUP BY sid) WHERE n1 > 0 AND n2 > 0 AND a+b > 0 AND a+b < n1+n2"))
def _(spark, d):
    tr, up = F.col("split") == "train", F.col("direction") == "up"
    n = lambda c, a: F.count_if(c).cast("double").alias(a)
    g = A.ramps(A.events(spark, d)).groupBy("sid").agg(n(tr & up, "a"), n(tr, "n1"), n(~tr & up, "b"), n(~tr, "n2"))
    g = g.filter("n1 > 0 AND n2 > 0 AND a + b > 0 AND a + b < n1 + n2")
    return g.select("sid", F.round(S.two_proportions(F.col("a"), F.col("n1"), F.col("b"), F.col("n2")), 5).alias("z"))


@query("D19_through_origin_slope", sql("SELECT sid, round(sum(duration_min*mag)/sum(duration_min*duration_min), 8) AS alpha FROM ramps GROUP BY sid HAVING sum(duration_min*duration_min) > 0"))
def _(spark, d):
    return A.ramps(A.events(spark, d)).groupBy("sid").agg(F.round(S.through_origin(F.col("duration_min"), F.col("mag")), 8).alias("alpha")).filter("alpha IS NOT NULL")


CIRC = "degrees(atan2(avg(sin(radians(dir))), avg(cos(radians(dir)))))"


@query("D20_circular_statistics", sql("SELECT day, n, round(ca, 4) AS cos_mean, round(sa, 4) AS sin_mean, round(rr, 4) AS resultant FROM (SELECT us // 86400000000 AS day, count(*) AS n, avg(cos(radians(dir))) AS ca, avg(sin(radians(dir))) AS sa, sqrt(power(avg(cos(radians(dir))),2)+power(avg(sin(radians(dir))),2)) AS rr FROM wind GROUP BY 1)"))
def _(spark, d):
    a = F.radians("dir")
    c, s = F.avg(F.cos(a)), F.avg(F.sin(a))
    g = A.wind(A.events(spark, d)).groupBy(F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long").alias("day"))
    return g.agg(F.count(F.lit(1)).alias("n"), r4(c).alias("cos_mean"), r4(s).alias("sin_mean"), r4(F.sqrt(c * c + s * s)).alias("resultant"))


@query("D21_daily_wind", sql(f"SELECT us // 86400000000 AS day, count(*) AS n, round(avg(speed), 5) AS speed, round((({CIRC}) % 360 + 360) % 360, 3) AS dir FROM wind GROUP BY 1"))
def _(spark, d):
    g = A.wind(A.events(spark, d)).groupBy(F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long").alias("day"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed"), 5).alias("speed"), F.round(S.circular_mean(F.col("dir")), 3).alias("dir"))


@query("D22_quantile_bins", sql("SELECT bin, count(*) AS n, round(avg(mag), 5) AS mean_mag, round(median(duration_min), 4) AS med_min FROM (SELECT mag, duration_min, greatest(0, len(list_filter(e, lambda x: x < mag)) - 1)::INT AS bin FROM ramps, (SELECT list_distinct(quantile_cont(mag, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1])) AS e FROM ramps)) GROUP BY bin"))
def _(spark, d):
    b = S.quantile_bins(A.ramps(A.events(spark, d)), "mag", 10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mag"), 5).alias("mean_mag"), r4(F.percentile("duration_min", 0.5)).alias("med_min"))


@query("D23_daily_coverage", sql("SELECT sid, day, n, round(n/med, 5) AS rel FROM (SELECT sid, us // 86400000000 AS day, count(k) AS n FROM series GROUP BY 1, 2) JOIN (SELECT day, median(n) AS med FROM (SELECT sid, us // 86400000000 AS day, count(k) AS n FROM series GROUP BY 1, 2) GROUP BY day) USING (day) WHERE med > 0"))
def _(spark, d):
    """A station's daily samples against the network's median of that day."""
    n = A.series(A.events(spark, d)).groupBy("sid", F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long").alias("day")).agg(F.count("k").alias("n"))
    med = n.groupBy("day").agg(F.percentile("n", 0.5).alias("med"))
    return n.join(med, "day").filter("med > 0").select("sid", "day", "n", F.round(F.col("n") / F.col("med"), 5).alias("rel"))


@query("D24_anchor_selection", sql("SELECT sid, role, pct FROM (SELECT sid, round(100*count(k)::DOUBLE/count(*), 2) AS pct, CASE WHEN 100*count(k)::DOUBLE/count(*) >= 85 THEN 'anchor' WHEN 100*count(k)::DOUBLE/count(*) < 75 THEN 'target' END AS role FROM series GROUP BY sid) WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY role ORDER BY pct DESC, sid) <= 20"))
def _(spark, d):
    """The 20 best covered stations, and the 20 best of the badly covered ones."""
    pct = 100 * F.count("k") / F.count(F.lit(1))
    g = A.series(A.events(spark, d)).groupBy("sid").agg(F.round(pct, 2).alias("pct"), F.when(pct >= 85, "anchor").when(pct < 75, "target").alias("role")).filter("role IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("pct"), "sid"))
    return g.withColumn("_k", k).filter("_k <= 20").select("sid", "role", "pct")


@query("D25_exclusion_sensitivity", sql("SELECT 'all' AS s, round(avg(n_joint/(n*(1-0.8::DOUBLE))), 6) AS chi FROM chi UNION ALL SELECT 'without', round(avg(n_joint/(n*(1-0.8::DOUBLE))), 6) FROM chi WHERE i % 10 <> 0 AND j % 10 <> 0", DAILY, PAIRS, CHI))
def _(spark, d):
    c = _chi(spark, d).withColumn("chi", T.chi(F.col("n_joint"), F.col("n"), 0.8))
    some = c.filter("i % 10 <> 0 AND j % 10 <> 0")
    mean = lambda df, s: df.agg(r6(F.avg("chi")).alias("chi")).select(F.lit(s).alias("s"), "chi")
    return mean(c, "all").unionByName(mean(some, "without"))


@query("D26_threshold_grid", sql("SELECT g.d AS delta, count(*) AS n, count(DISTINCT sid) AS n_stations FROM ramps JOIN (VALUES (0.10::DOUBLE), (0.15), (0.20), (0.25), (0.30)) g(d) ON mag >= g.d GROUP BY 1"))
def _(spark, d):
    """Events counted for every threshold in one pass over them."""
    grid = F.explode(F.array(*map(F.lit, (0.10, 0.15, 0.20, 0.25, 0.30)))).alias("delta")
    return A.ramps(A.events(spark, d)).select("sid", "mag", grid).filter("mag >= delta").groupBy("delta").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("n_stations"))


@query("D27_stability_summary", sql("SELECT k, count(*) AS n_ok, round(median(m), 6) AS q50, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.75), 6) AS q75 FROM (SELECT sid % 5 AS k, sid, avg(mag) AS m FROM ramps GROUP BY 1, 2) GROUP BY k"))
def _(spark, d):
    m = A.ramps(A.events(spark, d)).groupBy((F.col("sid") % 5).alias("k"), "sid").agg(F.avg("mag").alias("m"))
    q = lambda p, a: r6(F.percentile("m", p)).alias(a)
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("n_ok"), q(0.5, "q50"), q(0.25, "q25"), q(0.75, "q75"))


SIGMA = """
w AS (SELECT s.sid, cap/sum(cap) OVER () AS w FROM stations s JOIN (SELECT sid FROM train GROUP BY sid) t USING (sid)),
sd AS (SELECT sid, w, stddev_samp(m) AS s FROM daily JOIN w USING (sid) GROUP BY sid, w)
"""


@query("D28_portfolio_sigma", sql("SELECT round(sqrt(sum(CASE WHEN a.sid = b.sid THEN power(a.w*a.s, 2) ELSE a.w*b.w*a.s*b.s*0.3 END)), 6) AS sigma, round(sum(a.w*a.s)/count(DISTINCT b.sid), 6) AS upper FROM sd a, sd b", DAILY, SIGMA))
def _(spark, d):
    """sqrt(sum w2 s2 + sum rho w w s s) with one rho, from two sums instead of all pairs."""
    e = A.events(spark, d)
    daily = _daily(spark, d)
    w = A.stations(e).join(daily.select("sid").distinct(), "sid").withColumn("w", F.col("cap") / F.sum("cap").over(Window.partitionBy()))
    sd = daily.groupBy("sid").agg(F.stddev_samp("m").alias("s")).join(w, "sid").withColumn("ws", F.col("w") * F.col("s"))
    total, square = F.sum("ws"), F.sum(F.col("ws") * F.col("ws"))
    return sd.agg(r6(F.sqrt(0.7 * square + 0.3 * total * total)).alias("sigma"), r6(total).alias("upper"))


@query("D29_percentiles_long", sql("SELECT metric, round(value, 6) AS value FROM (SELECT quantile_cont(mag, 0.05) AS p05, quantile_cont(mag, 0.5) AS p50, quantile_cont(mag, 0.95) AS p95 FROM ramps) UNPIVOT (value FOR metric IN (p05, p50, p95))"))
def _(spark, d):
    q = A.ramps(A.events(spark, d)).agg(F.percentile("mag", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    wide = q.select(*(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p05", "p50", "p95"))))
    return wide.unpivot([], ["p05", "p50", "p95"], "metric", "value").select("metric", r6("value").alias("value"))


@query("D30_profile", sql("SELECT sid, count(*) AS n, round(100*(1 - count(k)::DOUBLE/count(*)), 2) AS pct_missing, min(us) AS first_us, max(us) AS last_us FROM series GROUP BY sid"))
def _(spark, d):
    return A.series(A.events(spark, d)).groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(100 * (1 - F.count("k") / F.count(F.lit(1))), 2).alias("pct_missing"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("D31_pivot_table", sql("SELECT sid, round(avg(mag) FILTER (direction='up') + 1e-9::DOUBLE, 6) AS up, round(avg(mag) FILTER (direction='down') + 1e-9::DOUBLE, 6) AS down FROM ramps GROUP BY sid"))
def _(spark, d):
    return A.ramps(A.events(spark, d)).groupBy("sid").pivot("direction", ["up", "down"]).agg(r6(F.avg("mag") + 1e-9))


@query("D32_value_counts", sql("SELECT CASE WHEN mag < .2 THEN 'small' WHEN duration_min > 1000 THEN 'slow' ELSE 'ok' END AS reason, count(*) AS n FROM ramps GROUP BY 1"))
def _(spark, d):
    why = F.when(F.col("mag") < 0.2, "small").when(F.col("duration_min") > 1000, "slow").otherwise("ok")
    return A.ramps(A.events(spark, d)).groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


RUNS = "runs AS (SELECT sid, us, event_id, k, sum(CASE WHEN k IS NOT NULL AND (pk IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY us, event_id) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY sid ORDER BY us, event_id) AS pk FROM series))"


def door_sql(body: str, *eps: float) -> str:
    """Swinging-door segments ``eps, sid, run, a, z`` (sample numbers) and their samples ``samples``, one step of every run at a time."""
    values = ", ".join(f"({e}::DOUBLE)" for e in eps)
    same = "r.eps = w.eps AND r.sid = w.sid AND r.run = w.run"
    return sql(body, RUNS, f"""
samples AS (SELECT e.eps, sid, run::BIGINT AS run, us, k, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY e.eps, sid, run) AS n FROM runs, (VALUES {values}) e(eps) WHERE k IS NOT NULL WINDOW w AS (PARTITION BY e.eps, sid, run ORDER BY us, event_id)),
walk AS (SELECT eps, sid, run, i, n, k, 0::BIGINT AS p, k AS vp, -1e300::DOUBLE AS lo, 1e300::DOUBLE AS hi, [0::BIGINT] AS b FROM samples WHERE i = 0
 UNION ALL
 SELECT eps, sid, run, i, n, k, CASE WHEN hi < lo THEN i - 1 ELSE p END, CASE WHEN hi < lo THEN vk ELSE vp END, CASE WHEN hi < lo THEN k - eps - vk ELSE lo END, CASE WHEN hi < lo THEN k + eps - vk ELSE hi END, CASE WHEN hi < lo THEN list_append(b, i - 1) ELSE b END
 FROM (SELECT r.eps, r.sid, r.run, r.i, r.n, r.k, w.p, w.vp, w.k AS vk, w.b, greatest(w.lo, (r.k - r.eps - w.vp)/(r.i - w.p)) AS lo, least(w.hi, (r.k + r.eps - w.vp)/(r.i - w.p)) AS hi FROM walk w JOIN samples r ON {same} AND r.i = w.i + 1)),
ends AS (SELECT eps, sid, run, list_append(b, n - 1) AS b FROM walk WHERE i = n - 1 AND n > 1),
seg AS (SELECT eps, sid, run, b[j] AS a, b[j + 1] AS z FROM (SELECT *, unnest(range(1, len(b))) AS j FROM ends)),
door AS (SELECT w.eps, w.sid, w.run, x.us AS us_a, y.us AS us_b, x.k AS k_a, y.k AS k_b, w.z - w.a AS n FROM seg w JOIN samples r ON {same} AND r.i = w.a JOIN samples y ON y.eps = w.eps AND y.sid = w.sid AND y.run = w.run AND y.i = w.z JOIN samples x ON x.eps = w.eps AND x.sid = w.sid AND x.run = w.run AND x.i = w.a),
found AS (SELECT eps, sid, us_a AS start_us, us_b AS end_us, k_b - k_a AS d, (us_b - us_a)/6e7::DOUBLE AS minutes FROM door WHERE (us_b - us_a)/6e7::DOUBLE >= 10)
""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("E1_swinging_door", door_sql("SELECT sid, run, us_a, us_b, round(k_a, 6) AS k_a, round(k_b, 6) AS k_b, n FROM door", 0.02))
def _(spark, d):
    return E.sdt_segments(A.series(A.events(spark, d)), 0.02).select("sid", "run", "us_a", "us_b", r6("k_a").alias("k_a"), r6("k_b").alias("k_b"), "n")


@query("E2_valid_runs", sql("SELECT sid, run::BIGINT AS run, count(*) AS n, min(us) AS first_us FROM runs WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2", RUNS))
def _(spark, d):
    return E.valid_runs(A.series(A.events(spark, d))).groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us")).filter("n >= 2")


@query("E3_ramp_extraction", door_sql("SELECT sid, start_us, end_us, round(d, 6) AS delta_k, CASE WHEN d > 0 THEN 'up' ELSE 'down' END AS direction, round(minutes + 1e-9::DOUBLE, 5) AS duration_min FROM found WHERE abs(d) >= 0.10", 0.02))
def _(spark, d):
    r = E.segment_ramps(E.sdt_segments(A.series(A.events(spark, d)), 0.02), 0.10, 10)
    return r.withColumn("delta_k", r6("delta_k")).withColumn("duration_min", F.round(F.col("duration_min") + 1e-9, 5))


@query("E3_step_ramps", sql("SELECT event_id, sid, direction, round(delta_k, 6) AS delta_k, round(duration_min + 1e-9::DOUBLE, 5) AS duration_min FROM ramps"))
def _(spark, d):
    return A.ramps(A.events(spark, d)).select("event_id", "sid", "direction", r6("delta_k").alias("delta_k"), F.round(F.col("duration_min") + 1e-9, 5).alias("duration_min"))


@query("E4_equal_value_blocks", sql("SELECT sid, event_type, block::BIGINT AS block, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY us, event_id) AS block FROM (SELECT *, lag(event_type) OVER (PARTITION BY sid ORDER BY us, event_id) AS p FROM ev)) GROUP BY 1, 2, 3 HAVING count(*) >= 2"))
def _(spark, d):
    w = Window.partitionBy("sid").orderBy("us", "event_id")
    new = F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)
    b = A.events(spark, d).withColumn("new", new).withColumn("block", F.sum("new").over(w))
    return b.groupBy("sid", "event_type", "block").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("E5_gaps_minutes", sql("SELECT event_id, gap FROM (SELECT event_id, (start_us - lag(start_us) OVER (PARTITION BY sid ORDER BY start_us, event_id)) // 60000000 AS gap FROM ramps) WHERE gap IS NOT NULL"))
def _(spark, d):
    w = Window.partitionBy("sid").orderBy("start_us", "event_id")
    gap = F.floor((F.col("start_us") - F.lag("start_us").over(w)) / 6e7).cast("long")
    return A.ramps(A.events(spark, d)).select("event_id", gap.alias("gap")).filter("gap IS NOT NULL")


@query("E6_runs_declustering", sql("SELECT sid, cluster::BIGINT AS cluster, arg_max(event_id, (mag, -start_us, -event_id)) AS event_id FROM (SELECT *, sum(CASE WHEN gap > 720 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY start_us, event_id) AS cluster FROM (SELECT *, (start_us - lag(start_us) OVER (PARTITION BY sid ORDER BY start_us, event_id)) // 60000000 AS gap FROM ramps)) GROUP BY 1, 2"))
def _(spark, d):
    return E.decluster_runs(A.ramps(A.events(spark, d)), "sid", "start_us", "mag", 720).select("sid", "cluster", "event_id")


GAPS = "gaps AS (SELECT sid, (start_us - lag(start_us) OVER (PARTITION BY sid ORDER BY start_us, event_id)) // 60000000 AS t FROM ramps)"
THETA = GAPS + """, theta AS (SELECT sid, count(t) + 1 AS n, CASE WHEN count(t) < 4 OR sum(t) = 0 THEN 1.0 ELSE least(1.0, coalesce(CASE WHEN max(t) <= 2 THEN 2*power(sum(t), 2)/nullif(count(t)*sum(t*t), 0) ELSE 2*power(sum(t-1), 2)/nullif(count(t)*sum((t-1)*(t-2)), 0) END, 1.0)) END AS theta FROM gaps WHERE t IS NOT NULL GROUP BY sid)"""


@query("E7_run_length_choice", sql("SELECT sid, arg_min(r, (abs(clusters - target), r)) AS run_min FROM (SELECT g.sid, c.r*60 AS r, 1 + count(*) FILTER (g.t > c.r*60) AS clusters, greatest(1, round(any_value(h.n*h.theta))) AS target FROM gaps g JOIN theta h USING (sid), range(1, 20) c(r) WHERE g.t IS NOT NULL GROUP BY 1, 2) GROUP BY sid", THETA))
def _(spark, d):
    from gridsquall.operators.evt import choose_run_length

    return choose_run_length(A.ramps(A.events(spark, d)))


@query("E8_extremal_index", sql("SELECT sid, n, round(theta, 6) AS theta FROM theta", THETA))
def _(spark, d):
    from gridsquall.operators.evt import extremal_index

    return extremal_index(A.ramps(A.events(spark, d))).select("sid", "n", r6("theta").alias("theta"))


@query("E9_uniform_margins", sql("SELECT sid, day, round(u, 6) AS u FROM margins", DAILY))
def _(spark, d):
    return _margins(spark, d).select("sid", "day", r6("u").alias("u"))


@query("E10_midrank_ecdf", sql("SELECT event_id, round(least(greatest((rank() OVER (PARTITION BY sid ORDER BY mag) - 1 + count(*) OVER (PARTITION BY sid, mag)/2.0::DOUBLE + 0.5)/(count(*) OVER (PARTITION BY sid) + 1), 1e-6), 1-1e-6), 6) AS u FROM ramps"))
def _(spark, d):
    return R.midrank_ecdf(A.ramps(A.events(spark, d)), "sid", "mag").select("event_id", r6("u").alias("u"))


@query("E11_inverse_ecdf", sql("SELECT sid, u, round(a[lo+1] + (a[least(lo+1, n-1)+1] - a[lo+1])*(pos-lo), 6) AS x FROM (SELECT *, floor(pos)::INT AS lo FROM (SELECT sid, u, a, n, least(greatest(u*n - 0.5, 0.0), n-1.0) AS pos FROM (SELECT sid, list(mag ORDER BY mag) AS a, count(*) AS n FROM ramps GROUP BY sid), (VALUES (0.05::DOUBLE), (0.5), (0.93)) v(u)))"))
def _(spark, d):
    g = A.ramps(A.events(spark, d)).groupBy("sid").agg(F.sort_array(F.collect_list("mag")).alias("a"))
    g = g.select("sid", "a", F.explode(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.93))).alias("u"))
    return g.select("sid", "u", r6(R.inverse_ecdf(F.col("a"), F.col("u"))).alias("x"))


@query("E12_rolling_crossing", sql("SELECT sid, day, min(us) AS t_us FROM (SELECT sid, us, us // 86400000000 AS day, CASE WHEN count(k) OVER w >= 2 THEN avg(k) OVER w END AS mean FROM series WINDOW w AS (PARTITION BY sid, us // 86400000000 ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE mean > 0.5 GROUP BY 1, 2"))
def _(spark, d):
    """First time of a day that the mean of three samples (two at least) is over one half."""
    return E.rolling_crossing(A.series(A.events(spark, d)), 3, 2, 0.5)


@query("E13_block_first", sql("SELECT sid, start_us // 5400000000 AS block, min(start_us) AS t_us FROM ramps WHERE direction = 'up' AND mag >= 0.15 GROUP BY 1, 2"))
def _(spark, d):
    r = A.ramps(A.events(spark, d)).filter("direction = 'up' AND mag >= 0.15")
    return r.groupBy("sid", F.floor(F.col("start_us") / 5.4e9).cast("long").alias("block")).agg(F.min("start_us").alias("t_us"))


@query("E15_one_row_per_group", sql("SELECT sid, arg_min(event_id, ((event_id*7919 + sid) % 1000003, event_id)) AS event_id FROM ramps GROUP BY sid"))
def _(spark, d):
    return A.ramps(A.events(spark, d)).groupBy("sid").agg(F.min_by("event_id", F.struct((F.col("event_id") * 7919 + F.col("sid")) % 1000003, F.col("event_id"))).alias("event_id"))


@query("E16_top_k", sql("SELECT sid, event_id, k FROM (SELECT sid, event_id, row_number() OVER (PARTITION BY sid ORDER BY mag DESC, event_id) AS k FROM ramps) WHERE k <= 3"))
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("mag"), "event_id"))
    return A.ramps(A.events(spark, d)).withColumn("k", k.cast("long")).filter("k <= 3").select("sid", "event_id", "k")


@query("E17_keep_first", sql("SELECT sid, us // 86400000000 AS day, arg_min(event_id, (us, event_id)) AS event_id FROM ev GROUP BY 1, 2"))
def _(spark, d):
    e = A.events(spark, d).withColumn("day", F.floor(F.col("us") / F.lit(A.DAY_US)).cast("long"))
    return first_of(e, ["sid", "day"], ["us", "event_id"]).select("sid", "day", "event_id")


@query("E18_top_500", sql("SELECT event_id, row_number() OVER (ORDER BY mag DESC, event_id) AS pos FROM ramps ORDER BY mag DESC, event_id LIMIT 500"))
def _(spark, d):
    """The 500 largest ramps in order (a top-k report)."""
    top = A.ramps(A.events(spark, d)).orderBy(F.desc("mag"), "event_id").limit(500)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("mag"), "event_id")).cast("long").alias("pos"))


@query("E18_full_sort", sql("SELECT event_id, row_number() OVER (ORDER BY mag DESC, event_id) AS pos FROM ramps"))
def _(spark, d):
    """All ramps in order; ``E18_top_500`` is the report of the 500 largest."""
    return R.numbered_sort(A.ramps(A.events(spark, d)).select("event_id", "mag"), F.desc("mag"), F.asc("event_id")).select("event_id", "pos")
