"""Every query of the library with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


from gridsquall.plans import basic, decisions, evidence, further, joins, models, statistics  # noqa: E402, F401  registers its queries
