"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsquall.session import ensure_checkpoint_dir

#: Texts are worked on in runs of about so many characters, to bound memory.
RUN_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gridsquall-{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there.

    Spark deletes the shuffle files of what has been written once the driver has collected
    its garbage, which by itself may be long after; so it is asked to.
    """
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path, compression=compression)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``kept`` returned: of those that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(name))
            if not path.getName().startswith("gridsquall-"):
                raise ValueError(f"{path} is not a table of kept()")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def runs(batches: Iterable[pa.RecordBatch], column: int, limit: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the strings of a column add up to about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        lengths = np.asarray(pa.compute.binary_length(col).fill_null(0))
        part = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``c0, c1, ...`` so that none clashes, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``numbered`` under their own names."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def least_hashes(df: DataFrame, h: str, limit: int, *then: str) -> DataFrame:
    """The ``limit`` rows with the least value of the 64-bit hash ``h``.

    Of a larger table only the range of hashes that holds about twice as many rows is
    sorted, so what reaches one task does not grow with the number of partitions.
    """
    n = df.count()
    if n > 2 * limit:
        df = df.filter(F.col(h) < -(1 << 63) + int((1 << 64) * (2 * limit / n)))
    return df.orderBy(h, *then).limit(limit)
