"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, one temporary folder in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stationfill-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of the current stage only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_dealt(self, df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """As save, as a table of `parts` buckets by `key`: windows and groupings within a key, and joins on it and more, need no exchange.

        While it is written, a join of sides that are dealt by `key` is taken as it is, whatever its other columns.
        """
        path, table, setting = f"{self.root}/{name}", self._table(name), "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return re.sub(r"\W", "_", f"{self.root.rsplit('/', 1)[-1]}_{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
