"""Resampling by hashes: any replicate can be computed anywhere, in any order.

A uniform number is a hash of (seed, replicate, key), so results do not depend on
partitioning, and a lost task computes the same again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsquall.config import CONFIG


def uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) for each key."""
    return (F.pmod(F.xxhash64(F.lit(CONFIG.seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


_P = [np.uint64(x) for x in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(h: np.ndarray, k: int) -> np.ndarray:
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k))


def _hashed(h: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a value of 8, 4 or 1 bytes, with what was hashed before as its seed."""
    with np.errstate(over="ignore"):
        h = h + _P[5] + np.uint64(size)
        if size == 8:
            h = _turned(h ^ (_turned(v * _P[2], 31) * _P[1]), 27) * _P[1] + _P[4]
        elif size == 4:
            h = _turned(h ^ ((v & np.uint64(0xFFFFFFFF)) * _P[1]), 23) * _P[2] + _P[3]
        else:
            h = _turned(h ^ (v * _P[5]), 11) * _P[1]
        h = (h ^ (h >> np.uint64(33))) * _P[2]
        h = (h ^ (h >> np.uint64(29))) * _P[3]
    return h ^ (h >> np.uint64(32))


def uniforms(ids: np.ndarray, draws: int, letter: str) -> np.ndarray:
    """The numbers ``uniform(id, b, F.lit(letter))`` of long ids and of draws b from 0 on, a row for each id."""
    h = _hashed(np.array([42], np.uint64), np.array([CONFIG.seed], np.int64).astype(np.uint64), 4)
    h = _hashed(h, np.asarray(ids, np.int64).astype(np.uint64), 8)[:, None]
    h = _hashed(_hashed(h, np.arange(draws, dtype=np.uint64)[None, :], 4), np.uint64(ord(letter)), 1)
    return ((h & np.uint64((1 << 52) - 1)).astype(float) + 0.5) / float(1 << 52)


def normal(*keys: Column | str) -> Column:
    """A standard normal number for each key (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit("r")))) * F.cos(2 * F.pi() * uniform(*keys, F.lit("a")))


def block_length(daily: DataFrame, most_lag: int = 15) -> DataFrame:
    """``block_days, r1`` of the mean daily series, which has a row for each day."""
    mean = daily.groupBy("day").agg(F.avg("m").alias("x"))
    z = mean.select(F.row_number().over(Window.orderBy("day")).alias("t"), (F.col("x") - F.avg("x").over(Window.partitionBy())).alias("x"))
    a = z.select("x", "t", F.explode(F.sequence(F.lit(1), F.lit(most_lag))).alias("l")).withColumn("t2", F.col("t") + F.col("l"))
    prod = a.join(z.select(F.col("t").alias("t2"), F.col("x").alias("y")), "t2").groupBy("l").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    r = prod.crossJoin(F.broadcast(z.agg(F.sum(F.col("x") * F.col("x")).alias("v")))).withColumn("r", F.col("c") / F.col("v"))
    first = F.min(F.when(F.col("r") < 0.2, F.col("l")))
    return r.agg(F.least(F.greatest(F.coalesce(first, F.lit(10)), F.lit(2)), F.lit(10)).cast("long").alias("block_days"), F.min_by("r", "l").alias("r1"))


def block_index(spark, days: int, block: int, replicates: int, *salt: Column) -> DataFrame:
    """``b, pos, src``: circular moving blocks; which day takes each place of each replicate."""
    pos = spark.range(replicates * days).select(F.floor(F.col("id") / days).alias("b"), (F.col("id") % days).alias("pos"))
    start = F.floor(uniform("b", F.floor(F.col("pos") / block), *salt) * days)
    return pos.withColumn("src", ((start + F.col("pos") % block) % days).cast("long"))


def day_masks(drawn: DataFrame, replicates: int) -> DataFrame:
    """``sid, w, masks`` of ``b, pos, sid``: for 64 places a word, one bit mask for each replicate."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 AS int))")
    words = drawn.groupBy("sid", F.floor(F.col("pos") / 64).cast("long").alias("w"), "b").agg(F.bit_or(bit).alias("m"))
    found = words.groupBy("sid", "w").agg(F.map_from_entries(F.collect_list(F.struct(F.col("b").cast("int"), "m"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long")))
    return found.select("sid", "w", each.alias("masks"))


def joint_counts(left: DataFrame, right: DataFrame, pairs: DataFrame, replicates: int) -> DataFrame:
    """``i, j, ks``: the places that the masks of both have set, one number for each replicate."""
    a = left.select(F.col("sid").alias("i"), "w", F.col("masks").alias("a"))
    b = right.select(F.col("sid").alias("j"), "w", F.col("masks").alias("b"))
    word = pairs.join(a, "i").join(b, ["j", "w"]).select("i", "j", F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseAND(y))).alias("k"))
    none = F.array_repeat(F.lit(0), replicates)
    total = word.groupBy("i", "j").agg(F.aggregate(F.collect_list("k"), none, lambda s, k: F.zip_with(s, k, lambda x, y: x + y)).alias("ks"))
    return pairs.join(total, ["i", "j"], "left").select("i", "j", F.coalesce("ks", none).alias("ks"))


def sorted_percentile(values: Column, q: float, size: int) -> Column:
    """The percentile of a sorted array of a known size, between neighbours in proportion."""
    low = int((size - 1) * q)
    part = (size - 1) * q - low
    a, b = F.get(values, F.lit(low)), F.get(values, F.lit(min(low + 1, size - 1)))
    return a + (b - a) * part


def percentile_interval(value: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [F.get(q, F.lit(0)).alias("ci_low"), F.get(q, F.lit(1)).alias("ci_high")]
