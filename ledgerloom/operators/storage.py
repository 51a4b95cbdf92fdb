"""Tables between rounds, in the folder that the driver and all executors share, and the package on the workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir that nothing else uses.

    Where the session names no folder, as in local tests, a local one is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes the package importable for Python workers that don't start in its folder.

    The archive is kept as long as the context, so that executors which join later can fetch it.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", None):
        return
    held = tempfile.TemporaryDirectory(prefix="ledgerloom-")
    context.addPyFile(shutil.make_archive(f"{held.name}/ledgerloom_src", "zip", root, "ledgerloom"))
    context._ledgerloom_shipped = held
