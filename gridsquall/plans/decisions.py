"""Queries on subsampled networks and on decisions that follow from other queries' results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.config import CONFIG
from gridsquall.operators import ensembles as E
from gridsquall.operators import gates
from gridsquall.operators import likelihood as L
from gridsquall.operators import rank as R
from gridsquall.operators import resample as S
from gridsquall.operators import stats
from gridsquall.operators import tail as T
from gridsquall.plans import models as M
from gridsquall.plans.evidence import COVERAGE
from gridsquall.plans.registry import QUERIES, query
from gridsquall.plans.sql import sql
from gridsquall.plans.statistics import _margins
from gridsquall.session import cut, stored
from gridsquall.sources import adapters as A

#: Sizes of the drawn networks and the size of the network they are meant for, draws of each, and what a draw needs.
SIZES, WHOLE, DRAWS = (50, 80, 100, 120, 150), 175, 100
LEAST_PAIRS, LEAST_MATCHED = 30, 30


def sizes_for(stations: int) -> list[int]:
    """The sizes themselves where the network has as many stations, else in proportion to it."""
    return list(SIZES) if stations >= max(SIZES) else [max(2, round(k * stations / WHOLE)) for k in SIZES]


def drawn_networks(stations: DataFrame, sizes: list[int], draws: int) -> DataFrame:
    """``sid, rs``: the numbers (size number x draws + draw) of the draws that hold a station: its ``k`` smallest hashes."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(sizes) * draws - 1))).alias("r")
    w = Window.partitionBy("r").orderBy(S.uniform("r", "sid", F.lit("network")), "sid")
    k = F.element_at(F.array(*map(F.lit, sizes)), F.floor(F.col("r") / draws).cast("int") + 1)
    ranked = stations.select("sid", numbers).withColumn("place", F.row_number().over(w))
    return ranked.filter(F.col("place") <= k).groupBy("sid").agg(F.array_sort(F.collect_list("r")).alias("rs"))


def shared_draws(pairs: DataFrame, networks: DataFrame) -> DataFrame:
    """``pairs`` that any draw holds, with ``rs``, the draws that hold both stations."""
    one = lambda k: networks.select(F.col("sid").alias(k), F.col("rs").alias(f"rs_{k}"))
    both = pairs.join(one("i"), "i").join(one("j"), "j").withColumn("rs", F.array_intersect("rs_i", "rs_j"))
    return both.drop("rs_i", "rs_j").filter(F.size("rs") > 0)


def _subsamples(spark, d):
    """The draws' own significance and tail fits: ``k, b, status, ...``, and the full network's decay with its interval."""
    stations = A.stations(A.events(spark, d)).select("sid")
    sizes = sizes_for(stations.count())
    total = len(sizes) * DRAWS
    networks = cut(drawn_networks(stations, sizes, DRAWS))
    pairs = M._permutation_p(spark, d).withColumn("chi", T.chi(F.col("n_joint"), F.col("n"), 0.8))
    each = cut(shared_draws(pairs, networks).select("p", "chi", F.explode("rs").alias("r")))  # what the draws hold, read twice
    tested = T.benjamini_hochberg(each, "p", CONFIG.tail.alpha, ("r",))
    hot = F.col("significant")
    own = tested.groupBy("r").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(hot).alias("n_significant"), F.percentile(F.when(hot, F.col("chi")), 0.5).alias("chi_median"))
    matched = cut(M._laplace_pairs(spark, d))
    full = L.fit_forms(matched, M.XYD)
    keys = matched.select("i", "j").distinct()
    weight = F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda r: F.array_contains("rs", r).cast("byte"))
    weighted = cut(matched.join(shared_draws(keys, networks).select("i", "j", weight.alias("w")), ["i", "j"]))
    beta = float(full.params[0, 2])
    fits = L.refit(weighted, M.XYD, "exp", full.params[0], "w", total, beta)
    count = dict(weighted.select(F.posexplode("w").alias("r", "w")).groupBy("r").agg(F.sum("w").alias("n")).collect())  # a row for each draw
    rows = [(r, sizes[r // DRAWS], r % DRAWS, int(count.get(r) or 0), float(fits.params[r, 0]), float(np.exp(min(fits.params[r, 1], 50.0))), bool(fits.converged[r])) for r in range(total)]
    tails = spark.createDataFrame(rows, "r int, k int, b int, n_matched long, alpha0 double, decay double, fitted boolean")
    out = tails.join(own, "r", "left")
    n = F.coalesce("n_pairs", F.lit(0))
    status = F.when(n < LEAST_PAIRS, "few close pairs").when(F.col("n_matched") < LEAST_MATCHED, "few matches").when(~F.col("fitted"), "no fit").otherwise("ok")
    share = F.when(n >= LEAST_PAIRS, F.col("n_significant") / n)
    fit = lambda c: F.when((F.col("n_matched") >= LEAST_MATCHED) & F.col("fitted"), F.col(c)).alias(c)
    out = out.select("k", "b", status.alias("status"), n.alias("n_pairs"), F.coalesce("n_significant", F.lit(0)).alias("n_significant"), share.alias("share"), "chi_median", "n_matched", fit("alpha0"), fit("decay"))
    cov = np.linalg.pinv(full.hessian[0])
    half = 1.96 * float(np.sqrt(max(cov[1, 1], 0)))
    centre = float(full.params[0, 1])
    return out, (float(np.exp(min(centre - half, 50.0))), float(np.exp(min(centre + half, 50.0))))


@query("H19_network_subsampling")
def _(spark, d):
    """100 networks of each of five sizes: close pairs, their adjusted permutation p-values, chi, and the conditional model with beta held, in each."""
    return _subsamples(spark, d)[0]


@query("D27_subsampling_decision")
def _(spark, d):
    """Medians and quartiles of the drawn networks by size, and whether a size is stable.

    It is where its median share of significant pairs reaches 0.30, and, from the second size
    on, its median decay length lies in the whole network's interval.
    """
    each, (low, high) = _subsamples(spark, d)
    ok = cut(each).filter("status = 'ok'")
    q = lambda c: [F.percentile(c, p).alias(f"{c}_{n}") for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    sizes = sizes_for(A.stations(A.events(spark, d)).count())
    grid = spark.createDataFrame([(k,) for k in sizes], "k int")  # five rows
    g = grid.join(ok.groupBy("k").agg(F.count(F.lit(1)).alias("n_ok"), *q("share"), *q("decay")), "k", "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0)))
    inside = F.col("decay_q50").between(low, high) | (F.col("k") <= sizes[0])
    return g.withColumn("stable", F.coalesce((F.col("n_ok") > 0) & (F.col("share_q50") >= 0.30) & inside, F.lit(False)))


@query("H23_gate_positions")
def _(spark, d):
    """Share of all pairs whose distance is uncertain by more than a fifth of it."""
    m = spark.createDataFrame([M.position_summary(spark, A.stations(A.events(spark, d)))], "n_pairs long, share double, median_ru double")
    return gates.gate(m, "G0", [("insufficient", F.col("n_pairs") == 0), ("approved with reservation", F.col("share") < 0.10)], "partly rejected")


@query("H23_gate_significance")
def _(spark, d):
    """Share of close pairs with significant tail dependence."""
    m = QUERIES["D11_permutation_p_value"](spark, d).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("significant").cast("int")).alias("share"))
    return gates.gate(m, "G1", [("approved", F.col("share") > 0.30)], "rejected")


@query("H23_gate_marginals")
def _(spark, d):
    m = QUERIES["H4_marginal_pipeline"](spark, d).agg(F.count(F.lit(1)).alias("n_series"), F.avg(F.col("passed").cast("int")).alias("share"), F.count_if("low_confidence").alias("n_low_confidence"), F.count_if("covariate_model_unstable").alias("n_rescued"))
    return gates.gate(m, "G2", [("approved", F.col("share") >= 0.90)], "partly rejected")


@query("H23_gate_coherence")
def _(spark, d):
    """Whether the conditional model couples magnitudes positively, and its slopes by pair rank with the daily chi."""
    pairs = stored(M._laplace_pairs(spark, d))
    f, best = M._two_forms(pairs)
    slope = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("k"), stats.through_origin(F.col("x"), F.col("y")).alias("a")).filter("k >= 3").drop("k")
    x = T.joint_of(cut(slope), _margins(spark, d), 0.8).withColumn("chi", T.chi(F.col("n_joint"), F.col("n"), 0.8)).withColumn("g", F.lit(0))
    ranked = R.weighted_ranks(R.weighted_ranks(cut(x.withColumn("w", F.lit(1))), "g", "a", "w", "ra"), "g", "chi", "w", "rc")
    m = ranked.agg(F.count(F.lit(1)).alias("n_pairs"), stats.correlation("ra", "rc").alias("rho")).withColumn("alpha0", F.lit(float(f.params[best, 0])))
    return gates.gate(m, "G3", [("approved", (F.col("alpha0") > 0) & (F.col("rho") > 0))], "approved with reservation")


@query("H23_gate_backtest")
def _(spark, d):
    m = QUERIES["H17_poisson_backtest"](spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("int")).alias("covered"), F.count_if("gross").alias("n_gross"))
    return gates.gate(m, "G4", [("insufficient", F.col("n") == 0), ("approved", (F.col("covered") >= 0.90) & (F.col("n_gross") == 0))], "approved with reservation")


def _ratio(spark, p: DataFrame, q: DataFrame) -> DataFrame:
    """Median and interval of the ratio of two ensembles' one-year levels, by 5000 hashed draws from each."""
    one = lambda z, a: z.filter("z IS NOT NULL AND years = 1.0").agg(F.sort_array(F.collect_list("z")).alias(a))  # noqa: E731  150 numbers
    x = one(p, "p").crossJoin(F.broadcast(one(q, "q"))).select("*", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("r"))
    pick = lambda a: F.get(a, F.floor(S.uniform("r", F.lit(a)) * F.size(a)).cast("int"))
    return x.withColumn("ratio", pick("p") / pick("q")).agg(F.percentile("ratio", 0.5).alias("ratio"), *S.percentile_interval("ratio"))


@query("H23_gate_portfolio")
def _(spark, d):
    """Whether a portfolio of independent stations would understate the one-year level."""
    net = M._network(spark, d)
    m = _ratio(spark, E.return_levels(M._real(net, spark), net.years), E.return_levels(M._independent(net), net.years))
    return gates.gate(m, "RQ3", [("insufficient", F.col("ratio").isNull()), ("confirmed", F.col("ci_low") > 1.0)], "not confirmed")


@query("H23_gate_copula")
def _(spark, d):
    """Whether a Gaussian copula would; and whether it and the conditional model agree within two per cent, as both share the first stage."""
    net = M._network(spark, d)
    copula = cut(QUERIES["H15_gaussian_copula_ensemble"](spark, d))
    median = lambda z, a: z.filter("years = 1.0").agg(F.percentile("z", 0.5).alias(a))
    m = _ratio(spark, E.return_levels(M._real(net, spark), net.years), copula).crossJoin(median(copula, "z_copula")).crossJoin(median(QUERIES["H14_model_implied_ensemble"](spark, d), "z_model"))
    m = m.withColumn("gap", F.abs(F.col("z_copula") / F.col("z_model") - 1))
    return gates.gate(m, "RQ3b", [("insufficient", F.col("ratio").isNull()), ("confirmed", F.col("ci_low") > 1.0), ("shared first stage", F.col("gap") < 0.02)], "not confirmed")


@query("H23_gate_censoring", sql("SELECT 'D2' AS gate, count(*) AS n_stations, count(*) FILTER (coalesce(pa2 <= 0.05 AND r2 < 0, false)) AS n_informative, CASE WHEN count(*) FILTER (coalesce(pa2 <= 0.05 AND r2 < 0, false)) = 0 THEN 'not informative' WHEN count(*) FILTER (coalesce(pa2 <= 0.05 AND r2 < 0, false)) <= 2 THEN 'informative in few' ELSE 'informative' END AS decision FROM adj", COVERAGE))
def _(spark, d):
    m = QUERIES["D23_informative_censoring"](spark, d).agg(F.count(F.lit(1)).alias("n_stations"), F.count_if("informative").alias("n_informative"))
    return gates.gate(m, "D2", [("not informative", F.col("n_informative") == 0), ("informative in few", F.col("n_informative") <= 2)], "informative").select("gate", "n_stations", "n_informative", "decision")


@query("H23_gate_out_of_sample")
def _(spark, d):
    """Coverage of the backtest, and how far the model's levels are from the observed ones, over all horizons."""
    net = M._network(spark, d)
    median = lambda z, a: z.groupBy("years").agg(F.percentile("z", 0.5).alias(a))
    gap = median(QUERIES["H14_model_implied_ensemble"](spark, d), "m").join(median(E.return_levels(M._real(net, spark), net.years), "r"), "years")
    gap = gap.agg(F.percentile(100 * F.abs(F.col("m") / F.col("r") - 1), 0.5).alias("gap_pct"))
    m = QUERIES["H17_poisson_backtest"](spark, d).agg(F.avg(F.col("covered").cast("int")).alias("covered")).crossJoin(gap)
    return gates.gate(m, "S6", [("confirmed", (F.col("covered") >= 0.75) & (F.coalesce("gap_pct", F.lit(0.0)) < 40))], "not confirmed")
