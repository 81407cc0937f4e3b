"""Intermediate tables in the shared folder the cluster names.

A written table cuts the lineage, survives the loss of an executor, and keeps
column pruning and row-group statistics, which a row checkpoint would not.
`Scratch` removes its tables when the job that needed them is done.
"""

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _local_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix=f"quillgrid-{application}-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may go without, and gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.conf.get("spark.master").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: executors of a local cluster share no temporary folder")
    return _local_root(spark.conf.get("spark.app.id", "local"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str = "stage") -> DataFrame:
    """Write the frame once and continue from the files."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that live as long as a `with` block: written once, reread, removed at its end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0

    def __enter__(self) -> "Scratch":
        return self

    def written(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)
