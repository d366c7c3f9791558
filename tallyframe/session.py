"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "tallyframe", cores: str = "8") -> SparkSession:
    """A local session for tests and bench runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYFRAME_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Tables of fewer bytes are read as they are, as are those that have a split for each core by their size.
DEALT_BYTES, SPLIT_BYTES = 1 << 20, 128 << 20
#: Tables of texts, whose rows take time.
TEXTS = {"criteria", "documents", "examples", "raw_entries", "rollouts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in TEXTS else df


def dealt(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores (say one file with one row group) dealt out to all of them, so that row-local work isn't left to
    a few. Filters and column pruning pass through. A table of as many splits as cores or more is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    size = plan.optimizedPlan().stats().sizeInBytes()
    if size < DEALT_BYTES or size > cores * SPLIT_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is named by the cluster in ``spark.checkpoint.dir``;
    only in local mode, where that is unset (tests), a temporary one is made and set. A cluster without it is an error, since no folder of one
    machine would outlive it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named is None and current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-checkpoint-"))
    elif current.isEmpty():
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint: it outlives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(spark: SparkSession, size: float, each: float = 64e6) -> int:
    """Partitions for an exchange of ``size`` bytes: no fewer than the session's setting, and none of more than about ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // each) + 1)


def small_or_plain(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to hold at most ``max_rows`` rows, else as it is,
    so that a larger one joins through a shuffle. Give it something cheap to count, as a ``cut``."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once for each application, so that queries also run
    where it isn't installed on every machine."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tallyframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyframe-package-"), "tallyframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._tallyframe_shipped = True
