"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of an execution when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose tasks run in the driver's own process
    (`local[n]`, as in tests) gets a temporary folder; on a cluster, where such
    a folder would be another one on each machine, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plankton-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables, written as Parquet in the shared folder and read again.

    A written table cuts the lineage: if an executor is lost, later stages
    reread the files instead of recomputing what went before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, *, release: bool = False) -> DataFrame:
        """release: df is written once and never run again, so the files of its exchanges are deleted after the write."""
        path = self.path(name)
        own = self.spark.conf.get(RELEASE, None)
        if release:
            self.spark.conf.set(RELEASE, True)
        try:
            df.write.parquet(path)
        finally:
            if release:
                self.spark.conf.unset(RELEASE) if own is None else self.spark.conf.set(RELEASE, own)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
