"""Structured Streaming over worker logs, and event-time windows as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trialforge.schema import WORKER_RECORD


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Worker records as they are appended; broken lines go."""
    return spark.readStream.schema(WORKER_RECORD).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def progress(log: DataFrame) -> DataFrame:
    """Running counts by algorithm and status."""
    return log.groupBy("algorithm", "status").count()


def start_compaction(log: DataFrame, path: str, checkpoint: str, batch_id: str) -> StreamingQuery:
    """Append each run once: keys that the target has are left out, so a repeated micro-batch adds nothing."""
    from trialforge.schema import UNIQUE
    from trialforge.sources.sinks import compile_batch

    def write(rows: DataFrame, _: int) -> None:
        runs = compile_batch(rows, batch_id)["runs"]
        spark = rows.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            runs = runs.join(spark.read.schema(runs.schema).parquet(path).select(*UNIQUE), list(UNIQUE), "left_anti")
        runs.write.mode("append").parquet(path)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Extensions: event time.


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
