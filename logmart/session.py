"""Session helpers: building a session for tests/bench and locating the
shared checkpoint folder.

The library itself never creates a session; operators take DataFrames.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every run of the library relies on. Timestamps are
# ``timestamp_ntz`` end to end, but pin the zone anyway so that any
# conversion a user adds is reproducible.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    app: str = "logmart",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests and the bench; on a cluster the user's own
    session is passed to the operators instead."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster this must be a shared file system path configured as
    ``spark.checkpoint.dir``; it is never invented there. Only a local
    session without one (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running jobs that cut lineage"
        )
    path = tempfile.mkdtemp(prefix="logmart-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written tables
    (snapshots, stream sinks) that must survive executor loss."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "logmart", name)


#: Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy(df: DataFrame, action):
    """What ``action`` makes of ``df``, whose shuffle files go after that."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return action(df.select("*"))      # planned anew: a plan keeps the setting it was made under
    finally:
        spark.conf.set(CLEANUP, before)


_scopes = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and
    read back: like a checkpoint it cuts the lineage and survives executor
    loss, and each later step reads the columns it needs only. The shuffle
    files of its making go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    if open_scopes := getattr(_scopes, "paths", []):
        open_scopes[-1].append(path)
    tidy(df, lambda x: x.write.parquet(path, compression="zstd"))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """What this thread has ``stored`` inside is deleted at the end, when all
    that is made of it must be written."""
    _scopes.paths = [*getattr(_scopes, "paths", []), []]
    try:
        yield
    finally:
        for path in _scopes.paths.pop():
            delete(spark, path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once its last reader has run."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partition count for an explicit repartition: the session's shuffle
    partitions, or the default parallelism when that is not a number
    (some platforms set it to ``auto``)."""
    value = spark.conf.get("spark.sql.shuffle.partitions", "200")
    try:
        return max(1, int(value))
    except ValueError:
        return max(1, spark.sparkContext.defaultParallelism)
