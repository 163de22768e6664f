"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "chronoplane") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small test tables: keep a task per core although each holds little.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_chronoplane_shipped", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="chronoplane-"), "chronoplane"), "zip", os.path.dirname(folder), os.path.basename(folder))
    context.addPyFile(archive)
    context._chronoplane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: `spark.checkpoint.dir`, or the one already set on the context.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local folder would
    lose its content with the machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="chronoplane-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), "work", f"{name}-{uuid.uuid4().hex[:12]}")


#: Rows that a task sorts or groups at once; a few hundred bytes each, so some 100 MB, however large the table.
TASK_ROWS = 250_000


def parts_for(df: DataFrame) -> int:
    """Into how many parts `df` is dealt so that a part has about TASK_ROWS rows. Counts, so `df` should be a file or `stored`."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage where several passes follow: the plan runs once, later passes read only the columns they
    need with known sizes, and nothing is lost with an executor.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
