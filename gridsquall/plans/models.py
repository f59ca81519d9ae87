"""Queries on resampling, fits and decisions (D8-D11, G12, H)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from gridsquall.config import CONFIG, Ramps
from gridsquall.functions import numeric as N
from gridsquall.operators import ensembles as E
from gridsquall.operators import gates, solar
from gridsquall.operators import implied as I
from gridsquall.operators import likelihood as L
from gridsquall.operators import marginals as P
from gridsquall.operators import models as M
from gridsquall.operators import places
from gridsquall.operators import rank as R
from gridsquall.operators import resample as S
from gridsquall.operators import stats as statistics
from gridsquall.operators import tail as T
from gridsquall.operators import tiles
from gridsquall.operators.pairs import match_near
from gridsquall.plans.joins import LONGEST_US, NEAR, THRESH, _extremes, _window, found, matched, matched_share
from gridsquall.plans.registry import query
from gridsquall.plans.sql import DAILY, PAIRS, sql
from gridsquall.plans.statistics import CHI, _chi, _daily, _margins
from gridsquall.session import cut, stored
from gridsquall.sources import adapters as A

#: Stations under this distance are close, in metres.
NEAR_M = 5000.0
#: Replicates of the registered ensembles.
B = CONFIG.resampling.replicates


def _ramps(spark, d):
    return A.ramps(A.events(spark, d))


def _day_numbers(margins):
    """Days as 0, 1, ...; a row for each day."""
    return margins.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("pos"))


@query("D9_moving_block_index")
def _(spark, d):
    return S.block_index(spark, _daily(spark, d).select("day").distinct().count(), 3, 40)


def _hot_stations(spark, d):
    """Stations with ``hot``, the numbers of their days over the 80 % quantile, and how many days there are."""
    m = _margins(spark, d)
    days = cut(_day_numbers(m))
    hot = m.filter("u > 0.8").join(days, "day").groupBy("sid").agg(F.collect_list(F.col("pos").cast("int")).alias("hot"))
    return A.stations(A.events(spark, d)).join(hot, "sid", "left"), days.count()


def _drawn_days(spark, days: int, replicates: int) -> np.ndarray:
    """The day at each place of each replicate, a number for each: a calendar's, not the tables' size."""
    rows = S.block_index(spark, days, 3, replicates).orderBy("b", "pos").collect()
    return np.array([r.src for r in rows], np.int64).reshape(replicates, days)


@query("D10_bootstrap_interval")
def _(spark, d):
    stations, n = _hot_stations(spark, d)
    index = _drawn_days(spark, n, CONFIG.tail.bootstraps)
    return tiles.joint_intervals(stations, CONFIG.tail.near_m, n, index, n * (1 - 0.8), 0.025, 0.975)


def _permutation_p(spark, d):
    """``i, j, p, n_joint, n`` of every close pair: the share of block permutations with at least as many joint days.

    Pairs are not stored: a plan that uses them twice makes them twice.
    """
    size = CONFIG.tail.permutations
    stations, n = _hot_stations(spark, d)
    r = tiles.joint_permutations(stations, CONFIG.tail.near_m, n, _drawn_days(spark, n, size))
    return r.select("i", "j", ((1 + F.col("above")) / (size + 1.0)).alias("p"), "n_joint", F.lit(n).cast("long").alias("n"))


@query("D11_permutation_p_value")
def _(spark, d):
    return T.benjamini_hochberg(_permutation_p(spark, d).select("i", "j", "p"), "p", few=True)


def _doubles(f):
    """A pandas function of double columns on whole arrays; null and NaN give null."""

    def work(*columns: pd.Series) -> pd.Series:
        v = [c.to_numpy(dtype=float) for c in columns]
        ok = np.logical_and.reduce([np.isfinite(x) for x in v])
        out = np.full(len(v[0]), np.nan)
        if ok.any():
            out[ok] = f(*(x[ok] for x in v))
        return pd.Series(out).where(np.isfinite(out), None).astype("Float64")

    return work


@F.pandas_udf(DoubleType())
def _chi_gauss(rho: pd.Series) -> pd.Series:
    a = float(N.norm_ppf(0.8))
    return _doubles(lambda r: (1 - 2 * 0.8 + N.bivariate_norm_cdf_many(a, a, np.clip(r, -0.999, 0.999))) / 0.2)(rho)


@F.pandas_udf(DoubleType())
def _normal_score(u: pd.Series) -> pd.Series:
    return _doubles(N.norm_ppf)(u)


@F.pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return _doubles(N.norm_cdf)(z)


@F.pandas_udf(LongType())
def _poisson_ppf(q: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(N.poisson_ppf_many(q.to_numpy(dtype=float), mean.to_numpy(dtype=float)))


@query("G12_special_functions")
def _(spark, d):
    """Normal score, normal probability, the Gaussian chi and Poisson quantiles of every part."""
    p = A.table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 997 + 1) / 999.0).alias("u"))
    scored = p.select("p_partkey", "u", _normal_score("u").alias("z"), _chi_gauss(F.col("u") * 2 - 1).alias("chi"))
    return scored.select("p_partkey", F.round("z", 7).alias("z"), F.round(_normal_cdf("z"), 7).alias("p"), F.round("chi", 7).alias("chi"), _poisson_ppf("u", F.col("u") * 40).alias("n"))


@query("H1_threshold_stability")
def _(spark, d):
    """Every candidate threshold of every station and direction; series of the test tables are short, so five excesses are enough here."""
    return P.threshold_stability(_ramps(spark, d), ["sid", "direction"], least=5)


@query("H2_gpd_fit")
def _(spark, d):
    return P.fit_peaks(_ramps(spark, d), ["sid"], adaptive=False, min_ramps=20, min_declustered=5)


def _with_covariates(ramps):
    """Solar elevation (as a share of 90 degrees) and season at the start of each ramp, at the centre of the network."""
    t = F.timestamp_micros("start_us")
    high = solar.elevation(F.col("start_us"), F.lit(52.05), F.lit(5.07)) / 90.0
    return ramps.withColumn("c1", high).withColumn("c2", solar.season(F.dayofyear(t)))


@query("H3_gpd_covariates")
def _(spark, d):
    return P.fit_scale_covariates(_with_covariates(_ramps(spark, d)), ["sid"], ["c1", "c2"])


@query("H4_marginal_pipeline")
def _(spark, d):
    return P.fit_marginals(_with_covariates(_ramps(spark, d)), ["sid", "direction"], ["c1", "c2"])


@query("H5_peaks_over_threshold")
def _(spark, d):
    """One fit a station; its series are short, so the limits on events and clusters are lower than for the network's minute series."""
    return P.fit_peaks(_ramps(spark, d), ["sid"], min_ramps=30, min_declustered=10, least=5)


def _train_ecdf(spark, d):
    """``sid, event_id, x``: magnitudes of all ramps on the Laplace scale of their station."""
    return R.midrank_ecdf(_ramps(spark, d), "sid", "mag").select("sid", "event_id", "start_us", R.laplace(F.col("u")).alias("x"))


def _coincidence_offset():
    """The logit of the chance that a partner comes by itself at the rate ``lam`` in a window by ``dist``."""
    p = 1 - F.exp(-F.col("lam") * 2 * F.least(F.col("dist") / 15.0 / 60, F.lit(30.0)))
    return R.logit(F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4)))


def _stage1(spark, d):
    """Extreme events of every directed close pair: ``y`` (matched), offset, log distance and the event's Laplace magnitude."""
    r = _ramps(spark, d)
    rate = r.groupBy(F.col("sid").alias("j")).agg(F.try_divide(F.count(F.lit(1)).cast("double"), (F.max("start_us") - F.min("start_us")) / 6e7).alias("lam"))
    m = matched(spark, d).join(rate.filter("lam IS NOT NULL"), "j")
    x = _train_ecdf(spark, d).select(F.col("sid").alias("i"), F.col("event_id").alias("event_i"), "x")
    km = F.col("dist") / 1000
    return cut(m.join(x, ["i", "event_i"]).select("i", "j", "event_i", "us_i", F.col("found").cast("int").alias("y"), km.alias("km"), F.log(F.greatest(km, F.lit(L.FLOOR_KM))).alias("ld"), "x", _coincidence_offset().alias("off")))


STAGE1 = ["intercept", "log_distance", "magnitude"]


@query("H6_logistic_with_offset")
def _(spark, d):
    f = M.logistic_offset(_stage1(spark, d), "y", ["ld", "x"], "off")
    rows = [(n, *(float(f[k][i]) for k in ("coef", "se", "low", "high")), float(f["deviance"]), float(f["aic"])) for i, n in enumerate(STAGE1)]
    return spark.createDataFrame(rows, "term string, coef double, se double, low double, high double, deviance double, aic double")


def _scaled(ramps):
    """Ramps with ``x``, their magnitude on the Laplace scale of their station."""
    return R.midrank_ecdf(ramps, "sid", "mag").withColumn("x", R.laplace(F.col("u"))).drop("u")


def _scored(ramps):
    """Ramps with ``x`` and ``score``, their magnitude on the normal scale."""
    return _scaled(ramps).withColumn("score", _normal_score(R.laplace_inverse(F.col("x"))))


def _laplace_pairs(spark, d):
    """Matched events of directed close pairs: ``i, j, x, y, km``, both magnitudes on the Laplace scale, which the events bring with them."""
    m = found(spark, d, _scaled, ("x",)).filter("x_i > 0.05")
    return m.select("i", "j", F.col("x_i").alias("x"), F.col("x_j").alias("y"), (F.col("dist") / 1000).alias("km"))


XYD = ["x", "y", "km"]


def _two_forms(pairs):
    """The estimates of both forms, and the number of the one with the lower likelihood loss (they have as many parameters)."""
    f = L.fit_forms(pairs, XYD)
    return f, int(np.nanargmin(np.where(np.isfinite(f.nll), f.nll, np.inf)))


@query("H7_conditional_extremes")
def _(spark, d):
    """Both forms of the conditional model, the chosen one by AIC, and its refit with beta held; ``gradient`` is the largest derivative at the estimate."""
    pairs = stored(_laplace_pairs(spark, d).select(*XYD))
    n = pairs.count()
    f, best = _two_forms(pairs)
    held = L.refit(pairs, XYD, list(L.STARTS)[best], f.params[best], beta=float(f.params[best, 2]))
    full = np.insert(held.params[0], 2, f.params[best, 2])
    rows = [(form, False, k == best, *f.params[k], f.nll[k], f.gradient[k], f.converged[k]) for k, form in enumerate(L.STARTS)]
    rows.append((list(L.STARTS)[best], True, False, *full, held.nll[0], held.gradient[0], held.converged[0]))
    out = [(r[0], r[1], bool(r[2]), n, float(r[3]), float(np.exp(r[4])), float(r[5]), float(r[6]), float(np.exp(r[7])), float(r[8]), 2.0 * (4 if r[1] else 5) + 2 * float(r[8]), float(r[9]), bool(r[10])) for r in rows]
    return spark.createDataFrame(out, "form string, beta_held boolean, chosen boolean, n long, alpha0 double, decay double, beta double, mu double, sigma double, nll double, aic double, gradient double, converged boolean")


def _bootstrap(spark, d):
    """``term, b, value`` of the refits of all replicates, whole directed pairs drawn together; and the plain estimates by term."""
    pairs, events = _laplace_pairs(spark, d), _stage1(spark, d)
    drawn = L.poisson_weights(B, "i", "j")
    pairs, events = cut(pairs.withColumn("w", drawn)), cut(events.withColumn("w", drawn))
    f, best = _two_forms(pairs)
    form = list(L.STARTS)[best]
    tails = L.refit(pairs, XYD, form, f.params[best], "w", B)
    columns = ["y", "off", "ld", "x"]
    plain = L.newton(events, columns, [L.logistic], np.zeros(3))
    odds = L.newton(events, columns, [L.logistic] * B, plain.params[0], "w")
    rows = [(t, b, float(v)) for b in range(B) for t, v, ok in (("alpha0", tails.params[b, 0], tails.converged[b]), ("decay", np.exp(tails.params[b, 1]), tails.converged[b]), ("beta", tails.params[b, 2], tails.converged[b]), *((f"gamma_{n}", odds.params[b, k], odds.converged[b]) for k, n in enumerate(STAGE1))) if ok and np.isfinite(v)]
    fitted = spark.createDataFrame(rows, "term string, b long, value double")
    each = pairs.select("x", "y", F.posexplode("w").alias("b", "w")).filter("w > 0")
    ranked = R.weighted_ranks(R.weighted_ranks(cut(each), "b", "x", "w", "rx"), "b", "y", "w", "ry")
    w, x, y = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    rho = F.try_divide(F.sum(w * x * y) - sx * sy / n, F.sqrt((F.sum(w * x * x) - sx * sx / n) * (F.sum(w * y * y) - sy * sy / n)))
    spearman = ranked.groupBy("b").agg(rho.alias("value")).select(F.lit("rho").alias("term"), F.col("b").cast("long").alias("b"), "value")
    slope = each.groupBy("b").agg(F.try_divide(F.sum(w * F.col("x") * F.col("y")), F.sum(w * F.col("x") * F.col("x"))).alias("value")).select(F.lit("slope").alias("term"), F.col("b").cast("long").alias("b"), "value")
    estimates = {"alpha0": f.params[best, 0], "decay": np.exp(f.params[best, 1]), "beta": f.params[best, 2]} | {f"gamma_{n}": plain.params[0, k] for k, n in enumerate(STAGE1)}
    return fitted.unionByName(spearman).unionByName(slope).filter("value IS NOT NULL"), estimates, form


@query("H8_cluster_bootstrap")
def _(spark, d):
    """Intervals of the conditional model, the coincidence model, Spearman's rho and the slope through the origin: 150 weighted refits at once."""
    values, estimates, form = _bootstrap(spark, d)
    plain = spark.createDataFrame([(k, float(v)) for k, v in estimates.items()], "term string, estimate double")
    out = values.groupBy("term").agg(F.count(F.lit(1)).alias("n_ok"), *S.percentile_interval("value"))
    return out.join(F.broadcast(plain), "term", "left").withColumn("form", F.lit(form))


@query("H9_bootstrap_slope")
def _(spark, d):
    p = _laplace_pairs(spark, d)
    w = M.replicate_weights(p, ["i", "j", "x", "y"], B)
    a = w.groupBy("i", "b").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.sum(F.col("w") * F.col("x") * F.col("x"))).alias("alpha"))
    return a.groupBy("i").agg(*S.percentile_interval("alpha"))


@query("H10_decay_curve_fit")
def _(spark, d):
    p = _laplace_pairs(spark, d).withColumn("bin", F.floor(F.col("km") / 0.5))
    return M.decay_curve(p.groupBy("bin").agg(F.avg("km").alias("km"), statistics.correlation("x", "y").alias("r")), "km", "r")


#: Stations in a tile of the position draws at least and at most, and stations that one meets at once.
LEAST_TILE, MOST_TILE, AT_ONCE = 64, 1024, 32


#: Percentiles of the drawn distances, and the width of a position's cell in metres.
SHARES, CELL_M = (0.025, 0.5, 0.975), 150.0


def _tile_percentiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """``i, j, lo, mid, hi``: percentiles of the distances drawn between the stations of two tiles.

    A distance grows with its chord, so places in their order are found among squared chords, and
    only the chords at those places are turned into distances.
    """
    pdf = pdf.sort_values(["tile", "sid"])
    sid, tile = pdf["sid"].to_numpy(), pdf["tile"].to_numpy()
    east, north = ((S.uniforms(sid, CONFIG.resampling.position_draws, c) - 0.5) * CELL_M for c in "xy")
    la, lo = (pdf[c].to_numpy(dtype=float)[:, None] for c in ("la", "lo"))
    m = CONFIG.geometry.metres_per_degree
    la, lo = np.radians(la + north / m), np.radians(lo + east / (m * np.cos(np.radians(la))))
    at = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    same = pdf["ta"].iloc[0] == pdf["tb"].iloc[0]
    first = int((tile == tile[0]).sum())
    where = [x * (at.shape[2] - 1) for x in SHARES]
    low = np.array([int(x) for x in where])
    both = np.concatenate([low, np.minimum(low + 1, at.shape[2] - 1)])
    part = np.array(where) - low
    out, room = [], np.empty((2, AT_ONCE, at.shape[2]))
    for k in range(first):
        for start in range(k + 1 if same else first, len(sid), AT_ONCE):
            o = slice(start, start + AT_ONCE)
            square, gap = room[0, : len(sid[o])], room[1, : len(sid[o])]
            np.subtract(at[0, o], at[0, k], out=square)
            np.multiply(square, square, out=square)
            for c in at[1:]:
                np.subtract(c[o], c[k], out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(square, gap, out=square)
            square.sort(axis=1)
            chord = np.sqrt(square[:, both])
            q = 2 * CONFIG.geometry.earth_radius_m * np.arcsin(np.minimum(1.0, chord / 2))
            a, b = q[:, : len(low)], q[:, len(low) :]
            out.append((np.full(len(q), sid[k]), sid[o], a + (b - a) * part))
    if not out:
        return pd.DataFrame({c: [] for c in ("i", "j", "lo", "mid", "hi")})
    i, j, q = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "lo": q[:, 0], "mid": q[:, 1], "hi": q[:, 2]})


def _drawn_tiles(spark, stations: DataFrame) -> DataFrame:
    """``sid, tile, ta, tb, la, lo``: stations and their nominal positions for each pair of tiles; draws are made where they are used."""
    s = cut(stations.filter("sid IS NOT NULL"))
    n = s.count()
    tiles = max(1, min(-(-n // LEAST_TILE), max(24, -(-n // MOST_TILE))))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, tiles * (tiles + 1) // 2))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    dealt = s.select("sid", "lat", "lon", F.pmod(F.xxhash64("sid"), F.lit(tiles)).alias("tile")).withColumn("o", other)
    near = dealt.select("sid", "lat", "lon", "tile", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"))
    near = near.repartition(width, "ta", "tb").sortWithinPartitions("ta", "tb")
    return near.select("sid", "tile", "ta", "tb", F.col("lat").alias("la"), F.col("lon").alias("lo"))


#: A distance is uncertain where its interval is wider than this share of its median.
UNSURE = 0.2


@query("H11_position_uncertainty")
def _(spark, d):
    """Distance percentiles of all pairs when positions shift within their 150 m cells."""
    q = _drawn_tiles(spark, A.stations(A.events(spark, d))).groupBy("ta", "tb").applyInPandas(_tile_percentiles, "i long, j long, lo double, mid double, hi double")
    ru = (F.col("hi") - F.col("lo")) / F.col("mid")
    return q.select("i", "j", F.col("mid").alias("d_median"), ru.alias("ru"), (ru > UNSURE).alias("flagged"))


def _uncertainties(spark, stations: DataFrame, low: float, high: float) -> DataFrame:
    """``ru, w, flagged``: the pairs' uncertainties from ``low`` to ``high`` one by one, those below and above as one row a task with their number."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _tile_percentiles(pdf)
        ru = ((q["hi"] - q["lo"]) / q["mid"]).to_numpy(dtype=float)
        sides = [(low / 2, ru < low), (high * 2, ru > high)]
        inside = ru[(ru >= low) & (ru <= high)]
        rows = pd.DataFrame({"ru": inside, "w": 1, "flagged": (inside > UNSURE).astype(np.int64)})
        more = pd.DataFrame([(v, int(of.sum()), int((of & (ru > UNSURE)).sum())) for v, of in sides if of.any()], columns=["ru", "w", "flagged"])
        return pd.concat([rows, more]) if len(more) else rows

    return _drawn_tiles(spark, stations).groupBy("ta", "tb").applyInPandas(work, "ru double, w long, flagged long")


#: Stations of which the window that holds the median is guessed, and its half width as a share of the pairs.
GUESS, AROUND = 1024, 0.06


def position_summary(spark, stations: DataFrame) -> tuple[int, float | None, float | None]:
    """The number of pairs, the share of uncertain ones, and the median uncertainty, all over all pairs.

    A part of the stations tells where about the median lies, so that only the values near it
    have to be kept; where it turns out to lie elsewhere, all are.
    """
    everything = (0.0, 1e9)
    window = everything
    if stations.count() > GUESS:
        some = _uncertainties(spark, stations.orderBy(F.xxhash64("sid"), "sid").limit(GUESS), *everything)
        window = tuple(some.agg(F.percentile("ru", F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND))).alias("q")).first().q)  # half a million numbers
    for low, high in (window, everything):
        values = stored(_uncertainties(spark, stations, low, high))
        n, median, _ = places.weighted_median(values, "ru", "w")
        at = values.filter(f"ru < {low!r}D").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        upto = values.filter(f"ru <= {high!r}D").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        if not n or at <= (n - 1) // 2 and n // 2 < upto:
            break
    share = values.agg(F.sum("flagged").cast("double") / F.lit(n)).first()[0] if n else None
    return n, share, median


#: Ramps of the network's minute series, which is smoother than a station's, and the limits of a fit: the test tables hold three weeks of training instead of three years.
NETWORK = Ramps(eps=0.005, delta=0.02)
LIMITS = {"min_ramps": 30, "min_declustered": 5, "least": 10}


@dataclass
class Network:
    """The training part of the network: station lines, the network's steps by day, days compressed once, and the length of blocks."""

    lines: DataFrame
    first: int
    days: int
    steps: DataFrame
    compressed: DataFrame
    block: int

    @property
    def years(self) -> float:
        return self.days / 365.25


def _network(spark, d) -> Network:
    lines = cut(A.minute_lines(A.events(spark, d)))
    end = F.floor(F.unix_micros(F.lit(CONFIG.test_from).cast("timestamp")) / F.lit(A.DAY_US)).cast("long")
    row = lines.agg(F.min("day").alias("first"), F.least(F.max("day") + 1, end).alias("end")).first()  # one row
    first, days = row.first or 0, max(1, (row.end or 1) - (row.first or 0))
    steps = cut(E.network_days(lines, first, days))
    compressed = cut(E.compressed_days(steps, NETWORK.eps))
    tops = spark.range(days).withColumnRenamed("id", "day").join(compressed.select(F.col("src").alias("day"), F.col("top").alias("m")), "day", "left").fillna({"m": 0.0})
    return Network(lines, first, days, steps, compressed, S.block_length(tops).first().block_days)


def _real(net: Network, spark):
    return E.day_ensemble(net.compressed, S.block_index(spark, net.days, net.block, B), NETWORK, **LIMITS)


def _independent(net: Network):
    return E.step_ensemble(E.shuffled_stations(net.lines, net.first, net.days, net.block, B), net.days, NETWORK, **LIMITS)


@query("H12_real_ensemble")
def _(spark, d):
    """Blocks of days of the network's minute series, compressed, cut into ramps and fitted in each of 150 replicates."""
    net = _network(spark, d)
    return E.return_levels(_real(net, spark), net.years)


@query("H13_independence_ensemble")
def _(spark, d):
    """As H12, with the days of every station in an order of its own and the network added up anew."""
    net = _network(spark, d)
    return E.return_levels(_independent(net), net.years)


def _implied(spark, d, gaussian: bool):
    """A fit for each replicate of the network with simulated partners of its extreme events.

    The fitted coincidence model says which close pairs' extremes match, a draw at a time; the
    fitted conditional model, or a Gaussian copula whose correlation decays with distance,
    gives the partner's magnitude, read from its own distribution; a linear ramp of that
    height takes the place of the partner's values.  Patches count in the network's mean as
    the partner's values do, in proportion to the capacity that has values at the minute.
    """
    net = _network(spark, d)
    stations, ramps, extremes = _extremes(spark, d, _scored if gaussian else _scaled)
    lam = ramps.groupBy("sid").agg(F.try_divide(F.count(F.lit(1)).cast("double"), (F.max("start_us") - F.min("start_us")) / 6e7).alias("lam"))
    rate = stations.join(lam.select("sid", F.when(F.col("lam").isNotNull(), F.array("lam")).alias("lam")), "sid", "left")
    scores = ("x", "score") if gaussian else ("x",)
    hits = stored(match_near(extremes, ramps, stations, NEAR_M, _window(), LONGEST_US, scores).select("i", "j", "dist", *(f"{c}_{k}" for c in scores for k in "ij")))
    seen = hits.join(lam.filter("lam IS NOT NULL").withColumnRenamed("sid", "j"), "j").withColumn("km", F.col("dist") / 1000)
    seen = seen.select(_coincidence_offset().alias("off"), F.log(F.greatest("km", F.lit(L.FLOOR_KM))).alias("ld"), F.col("x_i").alias("x"))
    evaluated = cut(rate.join(extremes.groupBy("sid").agg(F.collect_list("x").alias("x")), "sid", "left"))
    odds = L.newton(evaluated, [], [L.logistic], np.zeros(3), total=I.coincidence_sums(evaluated, NEAR_M, seen)).params[0]
    pairs = hits.filter("x_i > 0.05").withColumn("km", F.col("dist") / 1000)
    if gaussian:
        bins = pairs.withColumn("bin", F.floor(F.col("km") / 0.5)).groupBy("bin").agg(F.avg("km").alias("km"), statistics.correlation("score_i", "score_j").alias("r")).filter("r IS NOT NULL")
        best = M.decay_curve(bins, "km", "r").orderBy("sse").first()
        form = (float(best.a), float(best.scale), best.form) if best else (0.0, 1.0, "exp")

        def partner(km: np.ndarray, x: np.ndarray, score: np.ndarray, z: np.ndarray) -> np.ndarray:
            a, scale, kind = form
            rho = np.clip(a * (np.exp(-km / scale) if kind == "exp" else (1 + km) ** -scale), -0.995, 0.995)
            return N.norm_cdf(rho * score + np.sqrt(1 - rho * rho) * z)
    else:
        f, best = _two_forms(pairs.select(F.col("x_i").alias("x"), F.col("x_j").alias("y"), "km"))
        a0, decay, beta, mu, log_s = (float(v) for v in f.params[best])

        def partner(km: np.ndarray, x: np.ndarray, score: np.ndarray, z: np.ndarray) -> np.ndarray:
            alpha = a0 * (np.exp(-km / np.exp(decay)) if best == 0 else np.exp(-np.exp(decay) * np.log(np.maximum(km, L.FLOOR_KM))))
            y = alpha * x + x**beta * (mu + np.exp(log_s) * z)
            return np.where(y >= 0, 1 - np.exp(-np.abs(y)) / 2, np.exp(-np.abs(y)) / 2)

    r = ramps.filter("split = 'train'")
    length = int(round(r.agg(F.percentile("duration_min", 0.5)).first()[0] or 1))
    minute = F.floor(F.col("start_us") / 6e7).cast("long") - net.first * E.MINUTES
    sign = F.when(F.col("direction") == "down", -1.0).otherwise(1.0)
    own = extremes.filter("split = 'train' AND x > 0").select("sid", F.struct(minute.alias("minute"), F.col("event_id").alias("event"), "x", (F.col("score") if gaussian else F.lit(0.0)).alias("score"), sign.alias("sign")).alias("e")).filter("e.minute >= 0")
    arrays = lambda df, c: df.groupBy("sid").agg(F.sort_array(F.collect_list(c)).alias(c))
    base = (F.col("day") - net.first) * E.MINUTES
    lines = net.lines.filter((F.col("day") >= net.first) & (F.col("day") < net.first + net.days))
    lines = lines.select("sid", F.struct((base + F.col("a")).cast("int").alias("start"), (base + F.col("b")).cast("int").alias("stop"), "w", "c", "s").alias("l"))
    each = rate.join(arrays(own, "e"), "sid", "left").join(arrays(r, "mag"), "sid", "left").join(arrays(lines, "l"), "sid", "left")
    each = each.select("sid", "lat", "lon", "lam", F.col("mag").alias("mags"), *(F.col(f"e.{c}").alias(c) for c in ("x", "score", "minute", "sign", "event")), *(F.col(f"l.{c}").alias(c) for c in ("start", "stop", "w", "c", "s")))
    patches = I.simulated_patches(each, NEAR_M, odds, partner, net.days, length, B, int(gaussian))
    fits = E.step_ensemble(E.with_patches(net.steps, patches, B), net.days, NETWORK, **LIMITS)
    return E.return_levels(fits, net.years)


@query("H14_model_implied_ensemble")
def _(spark, d):
    return _implied(spark, d, False)


@query("H15_gaussian_copula_ensemble")
def _(spark, d):
    return _implied(spark, d, True)


@query("H16_ratio_interval")
def _(spark, d):
    """Ratio of the real to the independent ensemble's return levels, by 5000 hashed draws from each."""
    net = _network(spark, d)
    one = lambda fits, a: E.return_levels(fits, net.years).filter("z IS NOT NULL").groupBy("years").agg(F.sort_array(F.collect_list("z")).alias(a))
    z = one(_real(net, spark), "p").join(one(_independent(net), "q"), "years").select("*", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("r"))
    pick = lambda a: F.get(a, F.floor(S.uniform("years", "r", F.lit(a)) * F.size(a)).cast("int"))
    return z.withColumn("ratio", pick("p") / pick("q")).groupBy("years").agg(F.percentile("ratio", 0.5).alias("ratio"), *S.percentile_interval("ratio"))


#: Return periods of the backtest in days; the test tables hold one week of it.
BACKTEST_DAYS = (0.5, 1.0, 2.0, 4.0)


@query("H17_poisson_backtest")
def _(spark, d):
    """Every station's return levels from its training ramps against the clusters of its test ramps, with Poisson bounds.

    Exceedances are declustered with the run length of the fit.  A failure is gross where the
    observed number is over five times, or under a fifth of, the expected one.
    """
    r = _ramps(spark, d)
    fits = P.fit_peaks(r.filter("split = 'train'"), ["sid"], min_ramps=20, min_declustered=8, least=5).filter("converged")
    days = r.groupBy("split").agg(((F.max("start_us") - F.min("start_us")) / 8.64e10).alias("days")).groupBy().pivot("split", ["train", "test"]).agg(F.first("days"))
    levels = fits.crossJoin(F.broadcast(days)).select("sid", "run_min", "test", F.explode(F.array(*map(F.lit, BACKTEST_DAYS))).alias("days"), R.return_level(F.col("threshold_u"), F.col("sigma"), F.col("xi"), F.col("n_declustered") / F.col("train") * F.col("days")).alias("z"))
    over = r.filter("split = 'test'").select("sid", "start_us", "event_id", "mag").join(levels.select("sid", "days", "z", "run_min"), "sid").filter("mag > z")
    w = Window.partitionBy("sid", "days").orderBy("start_us", "event_id")
    gap = F.floor((F.col("start_us") - F.lag("start_us").over(w)) / 6e7)
    seen = over.withColumn("new", gap.isNull() | (gap > F.col("run_min"))).groupBy("sid", "days").agg(F.count_if("new").alias("observed"))
    out = levels.join(seen, ["sid", "days"], "left").select("sid", "days", "z", (F.col("test") / F.col("days")).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    out = out.withColumn("low", _poisson_ppf(F.lit(0.025), "expected")).withColumn("high", _poisson_ppf(F.lit(0.975), "expected"))
    gross = (F.col("observed") > 5 * F.col("expected")) | (F.col("observed") < 0.2 * F.col("expected"))
    return out.withColumn("covered", F.col("observed").between(F.col("low"), F.col("high"))).withColumn("gross", gross)


@query("H18_chi_against_gaussian")
def _(spark, d):
    m = _margins(spark, d).join(F.broadcast(cut(_day_numbers(_daily(spark, d)))), "day").select("sid", "pos", "u")
    row = F.sort_array(F.collect_list(F.struct("pos", "u", (F.col("u") > 0.8).alias("hot"))))
    rank = F.transform("r", lambda x: F.round(x["u"] * (F.size("r") + 1)).cast("int"))
    m = m.groupBy("sid").agg(row.alias("r")).select("sid", rank.alias("scores"), F.transform(F.filter("r", lambda x: x["hot"]), lambda x: x["pos"].cast("int")).alias("hot"))
    n = _daily(spark, d).select("day").distinct().count()
    c = tiles.score_correlations(A.stations(A.events(spark, d)).join(m, "sid", "left"), 5000.0, n, N.norm_ppf)
    c = c.select("i", "j", T.chi(F.col("n_joint"), F.lit(n), 0.8).alias("chi"), F.nanvl("rho", F.lit(None)).alias("rho"))
    return c.withColumn("chi_gauss", _chi_gauss("rho")).withColumn("gap", F.col("chi") - F.col("chi_gauss"))


@query("H20_threshold_sweep", sql("SELECT g.d AS delta, count(*) FILTER (direction='up') AS n_up, round(avg(duration_min), 4) AS mean_min FROM ramps JOIN (SELECT (5*r + 5)/100.0::DOUBLE AS d FROM range(6) t(r)) g ON mag >= g.d GROUP BY 1"))
def _(spark, d):
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: (5 * r + 5) / 100.0)).alias("delta")
    return _ramps(spark, d).select("mag", "direction", "duration_min", grid).filter("mag >= delta").groupBy("delta").agg(F.count_if(F.col("direction") == "up").alias("n_up"), F.round(F.avg("duration_min"), 4).alias("mean_min"))


GATE = "SELECT 'G1' AS gate, n_pairs, round(med, 6) AS median_chi, CASE WHEN n_pairs < 10 THEN 'insufficient' WHEN med > 0.1 THEN 'dependent' ELSE 'independent' END AS decision FROM (SELECT count(*) AS n_pairs, median(n_joint/(n*(1-0.8::DOUBLE))) AS med FROM chi WHERE dist < 5000)"


@query("H23_gate_dependence", sql(GATE, DAILY, PAIRS, CHI))
def _(spark, d):
    c = _chi(spark, d, 5000.0)
    m = c.agg(F.count(F.lit(1)).alias("n_pairs"), F.percentile(T.chi(F.col("n_joint"), F.col("n"), 0.8), 0.5).alias("med"))
    g = gates.gate(m, "G1", [("insufficient", F.col("n_pairs") < 10), ("dependent", F.col("med") > 0.1)], "independent")
    return g.select("gate", "n_pairs", F.round("med", 6).alias("median_chi"), "decision")


@query("H23_gate_pairing", sql("SELECT 'C1b' AS gate, count(*) AS n, round(avg(found::INT), 6) AS frac, CASE WHEN avg(found::INT) > 0.2 THEN 'proceed' ELSE 'weak' END AS decision FROM matched", PAIRS, THRESH, NEAR))
def _(spark, d):
    m = matched_share(spark, d)
    return gates.gate(m, "C1b", [("proceed", F.col("f") > 0.2)], "weak").select("gate", "n", F.round("f", 6).alias("frac"), "decision")


@query("H23_gate_distances", sql("SELECT 'G0' AS gate, count(*) AS n_pairs, round(median(dist), 3) AS median_m, CASE WHEN min(dist) > 150 THEN 'positions usable' ELSE 'positions too coarse' END AS decision FROM pairs", PAIRS))
def _(spark, d):
    m = spark.createDataFrame([places.weighted_median(places.all_distances(A.stations(A.events(spark, d))), "dist", "w")], "n_pairs long, m double, least double")
    return gates.gate(m, "G0", [("positions usable", F.col("least") > 150)], "positions too coarse").select("gate", "n_pairs", F.round("m", 3).alias("median_m"), "decision")
