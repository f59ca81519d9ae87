"""Stations, series, ramps and wind from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsquall.config import CONFIG

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, sid, us, event_type, value``; times are UTC microseconds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("sid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


def stations(ev: DataFrame) -> DataFrame:
    sid = F.col("sid")
    return ev.select("sid").distinct().select(sid, (52.0 + (sid * 37 % 101) / 1000.0).alias("lat"), (5.0 + (sid * 53 % 103) / 700.0).alias("lon"), (1.0 + sid % 9).alias("cap"))


def series(ev: DataFrame) -> DataFrame:
    """``sid, event_id, us, k``; a null ``k`` is a gap."""
    return ev.select("sid", "event_id", "us", F.when(F.col("event_type") != "signup", F.col("value") / 100.0).alias("k"))


def ramps(ev: DataFrame, least: float = CONFIG.ramps.delta) -> DataFrame:
    """Steps between neighbouring samples of a station that are at least ``least`` high."""
    w = Window.partitionBy("sid").orderBy("us", "event_id")
    steps = ev.select("sid", "event_id", F.lag("us").over(w).alias("start_us"), F.col("us").alias("end_us"), ((F.col("value") - F.lag("value").over(w)) / 100.0).alias("delta_k"))
    kept = steps.filter(F.col("start_us").isNotNull() & (F.abs("delta_k") >= least))
    cut = F.unix_micros(F.lit(CONFIG.test_from).cast("timestamp"))
    return kept.select(
        "sid", "event_id", "start_us", "end_us", "delta_k", F.abs("delta_k").alias("mag"),
        F.when(F.col("delta_k") > 0, "up").otherwise("down").alias("direction"),
        ((F.col("end_us") - F.col("start_us")) / 6e7).alias("duration_min"),
        F.when(F.col("start_us") >= cut, "test").otherwise("train").alias("split"),
    )


def wind(ev: DataFrame) -> DataFrame:
    """``us`` (full hour), ``speed`` and ``dir``."""
    hour = F.floor(F.col("us") / 3.6e9).cast("long") * 3_600_000_000
    return ev.filter("event_type = 'view'").groupBy(hour.alias("us")).agg((F.avg("value") / 10).alias("speed"), (F.sum("event_id") * 37 % 360).alias("dir"))


#: Fixed-point units of capacity, of capacity times value, and of capacity times slope: sums of whole numbers do not depend on their order.
UNITS = (1e6, 1e8, 1e11)


def minute_lines(ev: DataFrame) -> DataFrame:
    """``sid, day, a, b, w, c, s``: a station's minute series as lines between its neighbouring samples of a day.

    In the minutes of the day from ``a`` to before ``b`` the value is ``c + s * minute``; ``w`` is
    the station's capacity.  Samples without a value part the lines, as midnight does.
    """
    w = Window.partitionBy("sid").orderBy("us", "event_id")
    k = F.when(F.col("event_type") != "signup", F.col("value") / 100.0)
    two = ev.select("sid", "us", k.alias("k"), F.lag("us").over(w).alias("us0"), F.lag(k).over(w).alias("k0"))
    day = lambda c: F.floor(F.col(c) / F.lit(DAY_US)).cast("long")
    minute = lambda c: (F.ceil((F.col(c) - F.col("day") * DAY_US) / 6e7)).cast("int")
    lines = two.filter("k IS NOT NULL AND k0 IS NOT NULL").withColumn("day", day("us0")).filter(F.col("day") == day("us"))
    lines = lines.withColumn("a", minute("us0")).withColumn("b", minute("us")).filter("b > a")
    rise = (F.col("k") - F.col("k0")) / ((F.col("us") - F.col("us0")) / 6e7)
    at = F.col("k0") + rise * (F.col("a") - (F.col("us0") - F.col("day") * DAY_US) / 6e7)
    s = F.when(F.col("b") - F.col("a") > 1, rise).otherwise(0.0)
    return lines.select("sid", "day", "a", "b", (1.0 + F.col("sid") % 9).alias("w"), (at - s * F.col("a")).alias("c"), s.alias("s"))


def line_steps(lines: DataFrame, *keys: str) -> DataFrame:
    """The whole-number steps ``minute, dw, dc, ds`` by which lines enter and leave running sums, beside ``keys``."""
    w, c, s = (F.round(v * u).cast("long") for v, u in zip((F.col("w"), F.col("w") * F.col("c"), F.col("w") * F.col("s")), UNITS, strict=True))
    step = lambda m, sign: F.struct(F.col(m).cast("int").alias("minute"), (w * sign).alias("dw"), (c * sign).alias("dc"), (s * sign).alias("ds"))
    return lines.select(*keys, F.explode(F.array(step("a", 1), step("b", -1))).alias("x")).select(*keys, "x.*").filter("minute < 1440")
