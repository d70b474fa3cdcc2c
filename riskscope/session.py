"""Session settings shared by the bench, the tests and command-line use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Intermediate tables that this process wrote and has not released.
_WRITTEN: list[str] = []
# Spark deletes the shuffle files of a query at its end under this setting, else when the driver collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC.

    On a cluster leave both arguments out: the master and the partition count come
    from the submit command.
    """
    builder = (
        SparkSession.builder.appName("riskscope")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only on a local master.

    Executors of a cluster do not see each other's disks, so without a named folder it raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not is_single_process(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def is_single_process(master: str) -> bool:
    """True for masters whose executor is the driver itself."""
    return master == "local" or master.startswith("local[")


def materialise(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back as Parquet.

    For results that several branches of a plan read: the input is computed once, later
    reads prune columns, and a lost executor costs no recomputation of the lineage. The shuffle
    files of the write go with it, and `release` deletes the table itself.
    """
    path = scratch_path(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned; nothing that is still to run may read them."""
    for table in tables:
        path = table.__dict__.get("_scratch")
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(table.sparkSession, path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, for one intermediate table."""
    path = f"{ensure_checkpoint_dir(spark)}/riskscope-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release_materialised(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; call it when their results are stored."""
    released = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return released


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
