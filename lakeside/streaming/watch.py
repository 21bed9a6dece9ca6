"""Incremental indexing: a file source of (path, content) batches kept as a table of current files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Directories that are never indexed.
DENY_DIRS = (".git", ".build", ".next", ".nuxt", ".venv", "venv", "env", "node_modules", "dist", "build", "out", "target", "DerivedData", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "site-packages", "Pods", "Carthage", "vendor", "coverage", ".idea", ".cache", ".gradle", ".terraform")
MAX_BYTES = 1_000_000


def relevant(df: DataFrame) -> DataFrame:
    """Rows whose path is indexed: no hidden or denied directory, no secret name, a known language."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    hidden = F.exists(dirs, lambda s: s.startswith(".") & (s != ".github"))
    denied = F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in DENY_DIRS]))
    return df.filter(~hidden & ~denied & ~X.base_name(F.col("path")).startswith(".") & ~X.is_secret_name(X.base_name(F.col("path"))) & X.language(F.col("path")).isNotNull())


def listed(df: DataFrame, most_bytes: int = MAX_BYTES, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows (path, size, content as bytes) that are indexed: relevant, not ignored, neither empty nor large, no zero byte at the start."""
    plain = F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") == 0
    return relevant(df.filter((F.col("size") > 0) & (F.col("size") <= most_bytes))).filter(plain & ~X.ignored_by(F.col("path"), list(ignore)))


def discover(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), most: int = 60_000) -> DataFrame:
    """path below root, size, mtime, content of every indexed file that no ignore pattern covers, in path order, ``most`` at most."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("/", "/+") + "/", "")
    named = raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return listed(named, ignore=ignore).withColumn("content", F.decode("content", "UTF-8")).orderBy("path").limit(most)


SCHEMA_VERSION = 1


def check_version(spark: SparkSession, table_dir: str) -> None:
    """Notes the schema version beside a table; refuses one that a newer program wrote."""
    path = f"{table_dir.rstrip('/')}_version"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).exists(where):
        found = spark.read.parquet(path).first()["version"]
        if found > SCHEMA_VERSION:
            raise RuntimeError(f"{table_dir} has schema {found}, this program knows {SCHEMA_VERSION}")
    spark.createDataFrame([(SCHEMA_VERSION,)], "version int").write.mode("overwrite").parquet(path)


def wait_for_lock(locked, pause: float = 5.0, tries: int = 3) -> bool:
    """Waits while ``locked()`` holds, ``tries`` pauses at most; whether the lock went."""
    for _ in range(tries):
        if not locked():
            return True
        time.sleep(pause)
    return not locked()


class Cached:
    """A value that is computed again after ``seconds``."""

    def __init__(self, compute, seconds: float = 30.0, clock=time.monotonic):
        self.compute, self.seconds, self.clock = compute, seconds, clock
        self.at, self.value = None, None

    def get(self):
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.value, self.at = self.compute(), now
        return self.value


def watch_all(sources: dict[str, DataFrame], base_dir: str, interval: str = "1500 milliseconds", once: bool = False) -> dict:
    """One query for each named source, tables and checkpoints side by side; with ``once`` waits for all."""
    queries = {n: start_watch(df, f"{base_dir}/{n}/table", f"{base_dir}/{n}/checkpoint", interval, once) for n, df in sources.items()}
    if once:
        for q in queries.values():
            q.awaitTermination()
    return queries


def start_watch(stream: DataFrame, table_dir: str, checkpoint: str, interval: str = "1500 milliseconds", once: bool = False, locked=None):
    """Appends each micro-batch of (path, content, mtime) events; ``current`` reads the latest state.

    One query runs one micro-batch at a time, so passes never overlap.  ``locked``: while it says so (a
    repository being written), a batch waits, three times five seconds at most.
    """
    check_version(stream.sparkSession, table_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if locked is not None:
            wait_for_lock(locked)
        events = relevant(batch).withColumn("sha", F.sha2(F.col("content").cast("binary"), 256)).withColumn("batch", F.lit(batch_id))
        events.write.mode("overwrite").parquet(f"{table_dir}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def current(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest event of each path; a null content means that the file is gone."""
    w = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("batch"))
    events = spark.read.option("basePath", table_dir).parquet(table_dir)
    return events.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and content is not null").drop("rn")
