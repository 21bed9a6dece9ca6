"""What the training-data operators share: reading tables, sizes, the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trim() -> None:
    """Gives memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that setting is absent, a local session (tests, a laptop) gets a local folder; a
    cluster gets an error, since its executors share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "lakeside-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakeside-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lineage is cut, and
    the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int, least: int = 16) -> int:
    """How many hash buckets keep each at about ``bytes_each`` of stored input."""
    spark = df.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = input_bytes(df)
    if size > 1 << 60:  # unknown
        size = floor * bytes_each
    return max(least, min(floor, 4096), math.ceil(size / bytes_each))


def spread(df: DataFrame, bytes_a_core: int = 4 << 20) -> DataFrame:
    """A table of a few megabytes, often one row group, dealt to all cores; larger ones as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if input_bytes(df) < bytes_a_core * cores else df


def hashed_sample(df: DataFrame, n_rows: int, wanted: int, *keys: str) -> DataFrame:
    """The ``wanted`` of ``n_rows`` rows (all, if fewer) with the smallest hash of ``keys``; only about that many are sorted."""
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, (1.3 * wanted + 200) / max(n_rows, 1))
    return df.withColumn("_h", h).filter(F.col("_h") < int(share * (1 << 40))).orderBy("_h", *keys).limit(wanted).drop("_h")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator on texts needs, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
