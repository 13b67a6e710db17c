"""A table whose parts are replaced all at once or not at all.

Rows lie under `version` and `part`. A manifest, written last, says which version of each part holds; it counts from the moment
its job has committed, so a merge that fails on the way leaves the table as it was. Readers join the manifest, and as its columns
are the table's partitions, only the files of the versions that hold are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

MANIFEST = StructType([StructField("part", StringType()), StructField("version", LongType())])


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], part: Column, schema: StructType):
        self.spark, self.path, self.key, self.part, self.schema = spark, path.rstrip("/"), key, part, schema

    def _versions(self) -> list[int]:
        """Versions whose manifest has committed."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.Path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def manifest(self) -> DataFrame:
        """(part, version): a row for each part."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{found[-1]}")

    def rows(self, where: DataFrame | None = None) -> DataFrame:
        """The rows that hold, of all parts or of those in `where` (part)."""
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        laid = StructType([*self.schema.fields, StructField("version", LongType()), StructField("part", StringType())])
        stored = self.spark.read.schema(laid).parquet(f"{self.path}/rows")
        # the optimizer prunes partitions by a side that a filter makes selective
        holds = self.manifest().where("version >= 0")
        if where is not None:
            holds = holds.join(where, "part", "left_semi")
        return stored.join(holds, ["version", "part"]).select(*self.schema.names)

    def merge(self, updates: DataFrame) -> None:
        """Put the updates' non-null columns over the rows of their keys, and add rows of new keys.

        Keys that come twice are an error, and then nothing changes.
        """
        twice = updates.groupBy(*self.key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key comes more than once: {[twice[0][k] for k in self.key]}")
        versions = self._versions()
        version = versions[-1] + 1 if versions else 0
        parts = updates.select(self.part.cast("string").alias("part")).distinct()
        before = self.rows(parts)
        names = [c for c in self.schema.names if c not in self.key]
        given = updates.select(*self.key, *[F.col(c).alias(f"_{c}") if c in updates.columns else F.lit(None).cast(self.schema[c].dataType).alias(f"_{c}") for c in names])
        merged = before.join(given, self.key, "full").select(*[F.col(c) if c in self.key else F.coalesce(f"_{c}", c).alias(c) for c in self.schema.names])
        placed = merged.withColumn("version", F.lit(version).cast("long")).withColumn("part", self.part.cast("string"))
        # a version that a failed merge has left behind is written over
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "part").parquet(f"{self.path}/rows")
        written = placed.select("part").distinct().withColumn("version", F.lit(version).cast("long"))
        kept = self.manifest().join(written.select("part"), "part", "left_anti")
        kept.unionByName(written).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
