"""Tables that queries derive once and keep in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a local session gets a local folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "lakeside-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, reread: lineage is cut, and the rows survive the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/lakeside-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str, str], tuple[str, object]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], order: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` derived from ``sf_dir``: written by the first query of an application that needs it.

    With ``order`` the rows are dealt to files by ranges of these columns and sorted, so that a
    filter on them reads few row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        df = build()
        path = f"{shared_folder(spark)}/lakeside-index-{uuid.uuid4().hex}"
        ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        ordered.write.parquet(path)
        _kept[key] = (path, df.schema)
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, *keys: str, bytes_each: int = 2 << 20) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its size asks for (as files hold it), so that no task's share grows with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // bytes_each)
    return df.repartition(n, *keys) if df.sparkSession.sparkContext.defaultParallelism < n < 100_000 else df.repartition(*keys)


def spread(df: DataFrame, bytes_a_core: int = 4 << 20) -> DataFrame:
    """A table of a few megabytes, often one row group, dealt to all cores; larger ones as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < bytes_a_core * cores else df
