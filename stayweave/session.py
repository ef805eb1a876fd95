"""Session settings, lineage cuts and the size check every broadcast goes through."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Only a new session can take these. Recording the Python call site of every Column call costs as
# much time as building the plan.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.ui.enabled": "false"}

# Rows a table may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("stayweave").config(
        "spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in {**START_SETTINGS, **SETTINGS}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on (UTC, AQE, Arrow)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, for intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, as in tests, it lies below the warehouse, which
    all of them share as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    return stored(df)


def stored(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Loops that join their own results need it: a checkpoint keeps the size estimate of its plan, and estimates of
    joins of joins grow by a power every round. A written table has its real size and is read by column.
    """
    path = f"{shared_folder(df.sparkSession)}/{name or 'step'}-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote, when nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        context = spark.sparkContext
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if path.rpartition("/")[2].startswith("step-"):
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go as each ends, not when the driver happens to collect its garbage.

    For loops that write their steps: nothing else reads the shuffles of a write.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Hint that joins with ``df`` shuffle, whatever size Spark guesses.

    It takes a written table to be as large as its compressed files, and rows repeated by ``explode`` to be one, so it would
    broadcast tables that are hundreds of times larger in the driver. AQE still splits skewed keys.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` stays under ``max_rows``.

    Meant for tables that are cheap to count (a checkpoint or a file). Beyond the bound
    the plain table is returned, so the join shuffles and AQE may split skewed keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_or_shuffle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of up to ``max_rows`` rows and a shuffle beyond, so Spark's guess of the size counts in neither case."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else by_shuffle(df)
