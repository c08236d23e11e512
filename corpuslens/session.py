"""Session, checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while it has at most this many rows (measured, not estimated).
BROADCAST_ROWS = 200_000


def build_session(app: str = "corpuslens", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; on a cluster the submitted settings are used as they are."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, else ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a machine-local folder
    would be lost with its executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at:
        return at
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpuslens-checkpoint-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder: like ``cut``, for wide rows. Removed when the driver ends."""
    spark = df.sparkSession
    at = scratch(spark, "table")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder for tables of one run. Removed when the driver ends."""
    at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, at))
    return at


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _remove_written() -> None:
    for spark, at in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; its folder goes with the application
            return


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts at most one row more than that."""
    return df.limit(rows + 1).count() <= rows


def join_dimension(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table: broadcast if it is small enough, otherwise a shuffled join.

    The size of ``right`` is measured first. Beyond ``rows`` the join is left to AQE, which splits hot
    partitions of the left side (``spark.sql.adaptive.skewJoin.enabled``).
    """
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """``df``, in as many partitions as there are cores if a scan gives fewer (one small file is one task); large inputs stay as they are."""
    sc = df.sparkSession.sparkContext
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():
        return df
    return df.repartition(sc.defaultParallelism) if run.toRdd().getNumPartitions() < sc.defaultParallelism else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(*modules) -> None:
    """Pickle functions of these modules by value, so that executors need no copy of the package."""
    from pyspark import cloudpickle

    for m in modules:
        cloudpickle.register_pickle_by_value(m)
