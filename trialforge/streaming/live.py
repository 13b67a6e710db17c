"""Logs that grow: appends in order of time with late and repeated rows, and streams that follow them.

A stream is started once for each append and stops when it has drained what is there, so every append
goes through a restart from the checkpoint. Sinks are keyed: a row is stored once, whether the log, the
stream or a failed micro-batch repeats it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trialforge.sources.shared import checkpoint_dir

Sink = Callable[[DataFrame, int], None]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass
class GrowingLog:
    """Rows with a time column `ts`, written in `appends` equal spans of time.

    Rows where `late` holds come one append later than their time says; rows where `again` holds come once
    more, one append later. `delay` seconds of watermark lose none of either.
    """

    rows: DataFrame
    appends: int = 3
    late: Column | None = None
    again: Column | None = None

    def __post_init__(self) -> None:
        spark = self.rows.sparkSession
        # a time without a zone counts as one in the session's
        self.rows = self.rows.withColumn("ts", F.col("ts").cast("timestamp"))
        self.path, self.schema, self.micros = fresh_path(spark, "log"), self.rows.schema, F.unix_micros("ts")
        low, high = self.rows.agg(F.min(self.micros), F.max(self.micros)).head()
        self.low, self.high = low or 0, high or 0
        self.span = (self.high - self.low) // self.appends + 1
        self.delay = f"{2 * self.span // 1_000_000 + 1} seconds"

    def arriving(self, number: int) -> DataFrame:
        """What the given append brings."""
        due = F.floor((self.micros - self.low) / self.span)
        last = self.appends - 1
        when = F.least(due + self.late.cast("int"), F.lit(last)) if self.late is not None else due
        first = self.rows.where(when == number)
        if self.again is None:
            return first
        return first.unionByName(self.rows.where(self.again & (F.least(when + 1, F.lit(last)) == number)))

    def append(self, number: int) -> None:
        self.arriving(number).write.mode("append").parquet(self.path)

    def close(self, marker: dict[str, Column]) -> None:
        """A row far later than all others, which lets every window and timer before it end."""
        far = F.timestamp_micros(F.lit(self.high + 20 * self.span + 60_000_000))
        row = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema} | {"ts": far.alias("ts")} | {k: c.alias(k) for k, c in marker.items()}
        self.rows.sparkSession.range(1).select(*[row[f.name] for f in self.schema]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows.sparkSession.readStream.schema(self.schema).parquet(self.path)


def drain(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> None:
    """Everything that the source has by now goes through; then the query stops."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(log: GrowingLog, build: Callable[[DataFrame], DataFrame], sink: Sink, mode: str = "append", marker: dict[str, Column] | None = None) -> None:
    """Each append, then the marker, with a drain and a restart after each."""
    checkpoint = fresh_path(log.rows.sparkSession, "stream")
    for number in range(log.appends):
        log.append(number)
        drain(build(log.read()), sink, checkpoint, mode)
    if marker is not None:
        log.close(marker)
        drain(build(log.read()), sink, checkpoint, mode)


class KeyedSink:
    """A table that stores each key once.

    `part` (few values in a micro-batch) lays it out, so that only parts that the micro-batch touches are looked at for
    keys that are there; a repeated micro-batch writes over its own rows.
    """

    def __init__(self, path: str, keys: list[str], part: Column):
        self.path, self.keys, self.part, self.schema = path, keys, part, None

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        marked = rows.dropDuplicates(self.keys).withColumn("_part", self.part)
        self.schema = StructType([*marked.schema.fields, StructField("_epoch", LongType())])
        touched = [r[0] for r in marked.select("_part").distinct().collect()]
        if touched and exists(spark, self.path):
            there = spark.read.schema(self.schema).parquet(self.path).where(F.col("_part").isin(touched) & (F.col("_epoch") != epoch))
            marked = marked.join(there.select(*self.keys), self.keys, "left_anti")
        _overwrite(marked, epoch, self.path, "_part")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path).drop("_epoch", "_part")


class LatestSink:
    """Each micro-batch's whole result under its number (complete mode); a repeated one writes over itself."""

    def __init__(self, path: str):
        self.path, self.schema = path, None

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        self.schema = StructType([*rows.schema.fields, StructField("_epoch", LongType())])
        _overwrite(rows, epoch, self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The result as of the last micro-batch."""
        kept = spark.read.schema(self.schema).parquet(self.path)
        return kept.join(kept.agg(F.max("_epoch").alias("_epoch")), "_epoch", "left_semi").drop("_epoch")


def _overwrite(rows: DataFrame, epoch: int, path: str, *parts: str) -> None:
    rows.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch", *parts).parquet(path)
