"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()
_ROOTS: list[str] = []

# A task with several sorts and aggregates was seen to hold thirty times the compressed bytes it fetches.
FETCH_MB = 8
INPUT_MB = 8


def build_session(app: str = "spotloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{FETCH_MB}m",
        "spark.sql.session.timeZone": "UTC",
        # Streaming counts keep one row of state per (cell, gene): off the JVM heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_tasks(spark: SparkSession, folder: str) -> None:
    """Lets what a task fetches from a shuffle stay the same at every size of the tables in ``folder``.

    Adaptive execution merges partitions up to ``FETCH_MB``, and shuffles begin with one for each ``INPUT_MB`` of input.
    Settings that make smaller tasks are kept.
    """
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(size).strip().lower()).groups()
    if int(number) << " kmgtp".index(unit or " ") * 10 > FETCH_MB << 20:
        spark.conf.set(size, f"{FETCH_MB}m")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if (tasks := -(-held // (INPUT_MB << 20))) > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, tasks)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    Outside local mode a warehouse on a machine's own disk is an error, as executors elsewhere would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
        own_disk = root.startswith("/") or root.startswith("file:")
        if own_disk and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Nothing there is reused; ``scratch`` removes what was made inside it."""
    return f"{_ROOTS[-1] if _ROOTS else shared_root(spark) + '/spotloom'}/{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is staged inside the block, removed at its end: write or collect results before that."""
    root = f"{shared_root(spark)}/spotloom/{uuid.uuid4().hex}"
    _ROOTS.append(root)
    try:
        yield root
    finally:
        _ROOTS.remove(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay an iterative plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Used where several later steps read the same expensive result: it is computed once,
    later scans prune columns, and a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column (scalar subquery), so a fact such as an
    extent or a panel reaches every row without a join."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("fact")).scalar()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers (once per session)."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spotloom-code-')}/spotloom_{uuid.uuid4().hex}", "zip", home.parent, home.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
