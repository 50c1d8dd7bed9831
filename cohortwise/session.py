"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Aggregates shuffle on every grouping key, so a
# partitioning inherited from a join on one hot key is never reused, and skewed join partitions
# are split even if that costs another exchange.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.session.timeZone": "UTC",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str | int = "*", app: str = "cohortwise", memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark; on a cluster use the given session and `tune`."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder, or a local one on local[*]."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortwise-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def _scratch_home(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/cohortwise/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared scratch folder."""
    return f"{_scratch_home(spark)}/{uuid.uuid4().hex}/{name}"


def path_state(spark: SparkSession, pattern: str) -> tuple[tuple[str, int, int], ...]:
    """(path, change time, length) of what a path pattern matches; empty if there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return tuple((s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in found)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that still read them become unusable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as a table in the shared folder and read it back.

    The written table survives lost executors, and its known size lets the planner choose
    between a broadcast and a shuffle join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], Any]]) -> list[Any]:
    """Run jobs that do not need each other side by side; their results come in the given order.

    A fit is a long row of short stages, each of which leaves cores idle while the driver prepares the
    next one; those of other fits take them. A failure is raised once all jobs have ended.
    """
    if not jobs:
        return []
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inherit(job)) for job in jobs]
    return [job.result() for job in running]
