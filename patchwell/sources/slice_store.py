"""Decoded slices as one bucketed table: each volume is decoded once, and what joins by slice moves no pixels.

Buckets are of case and block (``volumes.BLOCK`` slices that follow each other),
so a task that decodes a stretch of slices writes one file a block, and a case
that holds a third of all slices is spread over many buckets.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import volumes
from .stored import new_path

#: What tells a slice, in tables that are joined within their buckets.
KEYS = ("case_id", "block", "z")


class SliceStore:
    """Slices by ``role`` (a modality, or a mask's name)."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table, path

    @classmethod
    def write(cls, spark: SparkSession, paths: dict[str, str], buckets: int | None = None) -> SliceStore:
        """Decode the volumes at the paths of each role. ``buckets``: as many as the session's shuffle partitions, unless given."""
        return cls.of({role: volumes.slices(spark, p) for role, p in paths.items()}, buckets)

    @classmethod
    def of(cls, slices: dict[str, DataFrame], buckets: int | None = None) -> SliceStore:
        """Store slices (``case_id, z`` and what they have) of each role, in one job."""
        every = [df.withColumn("role", F.lit(role)) for role, df in slices.items()]
        spark = every[0].sparkSession
        rows = reduce(DataFrame.unionByName, every).withColumn("block", F.floor(F.col("z") / volumes.BLOCK).cast("int"))
        table, path = f"slices_{uuid.uuid4().hex}", new_path(spark, "slices")
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.partitionBy("role").bucketBy(n, "case_id", "block").sortBy("case_id", "block", "z").option("path", path).format("parquet").saveAsTable(table)
        return cls(spark, table, path)

    def role(self, name: str) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("role") == name).drop("role")

    def modalities(self, names: list[str]) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("role").isin(names)).withColumnRenamed("role", "modality")

    def drop(self) -> None:
        """Forget the table and remove its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
