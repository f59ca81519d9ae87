"""Run log: appended records, of which the latest of each key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(log: DataFrame, path: str) -> None:
    """Adds records as JSON lines."""
    log.write.mode("append").json(path)


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The record with the largest ``at`` of each key."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r"))
    return best.select(*keys, "_r.*")


def markdown(log: DataFrame) -> DataFrame:
    """Each record as a Markdown table row."""
    return log.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in log.columns)), F.lit(" |")).alias("line"))
