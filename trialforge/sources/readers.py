"""Readers of batches, worker logs, graphs, catalogues and experiment files. Schemas are explicit."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

from trialforge.operators.derive import derive, truth
from trialforge.schema import MANIFEST_ENTRY, REQUIRED, RUNS, WORKER_RECORD, conform, require


class SqliteRange(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.options.get('table', 'runs')}").fetchone()
        step = int(self.options.get("rows", 100_000))
        return [SqliteRange(k, k + step) for k in range(low or 0, (high or -1) + 1, step)] or [SqliteRange(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        table = self.options.get("table", "runs")
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            there = {r[1] for r in db.execute(f"PRAGMA table_info({table})")}
            # wanted columns that the file has; others are null
            picked = ", ".join(f'"{c}"' if c in there else f"NULL AS {c}" for c in self.names)
            where, values = "rowid >= ? AND rowid < ?", [partition.low, partition.high]
            if self.options.get("batch_id") and "batch_id" in there:
                where, values = where + " AND batch_id = ?", [*values, self.options["batch_id"]]
            for row in db.execute(f"SELECT {picked} FROM {table} WHERE {where}", values):
                yield tuple(None if v is None else str(v) for v in row)


class SqliteSource(DataSource):
    """Runs of a legacy SQLite batch as text columns, in ranges of rowid. The path must be visible to the executors."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_runs"

    def schema(self) -> StructType:
        from pyspark.sql.types import StringType

        return StructType([StructField(c, StringType()) for c in RUNS.fieldNames()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_runs").option("path", path)
    df = (reader.option("batch_id", batch_id) if batch_id else reader).load()
    flags = ("success", "is_valid", "partial")
    df = df.withColumns({c: truth(F.col(c)) for c in flags})
    whole = [f.name for f in RUNS if f.dataType.typeName() in ("integer", "long")]
    return conform(df.withColumns({c: F.col(c).cast("double") for c in whole}), RUNS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of runs by its header; 0/1 and words are booleans; problem_name is an old name of graph_name."""
    df = spark.read.option("header", True).csv(path)
    if "problem_name" in df.columns and "graph_name" not in df.columns:
        df = df.withColumnRenamed("problem_name", "graph_name")
    df = df.withColumns({c: truth(F.col(c)) for c in ("success", "is_valid", "partial") if c in df.columns})
    return conform(require(df, tuple(c for c in REQUIRED if c != "error")), RUNS).fillna(0, ["graph_id"])


def read_worker_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON Lines; without strict, blank, broken and cut-off lines go and unknown fields vanish."""
    rows = spark.read.schema(WORKER_RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.withColumn("graph_name", F.coalesce("graph_name", "problem_name")).drop("problem_name")


def completed_keys(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("algorithm", F.lit("")).alias("algorithm"), F.coalesce("graph_id", F.lit(0)).alias("graph_id"), F.coalesce("topology_name", F.lit("")).alias("topology_name"), F.coalesce("seed", F.lit(-1)).alias("seed")).distinct()


def load_batch(spark: SparkSession, batch_dir: str) -> tuple[DataFrame, dict[str, Any]]:
    """Runs with derived columns, and the batch's configuration: results.db before runs.csv, config.json before the stored one."""
    config: dict[str, Any] = {}
    db, csv, stored = (os.path.join(batch_dir, n) for n in ("results.db", "runs.csv", "config.json"))
    if os.path.exists(stored):
        config = json.loads(open(stored).read())
    if os.path.exists(db):
        runs = read_sqlite(spark, db, os.path.basename(os.path.normpath(batch_dir)) if config.get("batch_id") else None)
        if not config:
            config = stored_config(db)
    elif os.path.exists(csv):
        runs = read_csv(spark, csv)
    else:
        raise FileNotFoundError(f"neither results.db nor runs.csv in {batch_dir}")
    return derive(runs, timeout=float(config.get("timeout", 60.0))), config


def stored_config(db: str) -> dict[str, Any]:
    """The configuration in the batches table; empty if there is none that can be read."""
    try:
        with sqlite3.connect(f"file:{db}?mode=ro", uri=True) as con:
            row = con.execute("SELECT config_json FROM batches LIMIT 1").fetchone()
        return json.loads(row[0]) if row and row[0] else {}
    except (sqlite3.Error, ValueError):
        return {}


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Graph files (node-link JSON with edges or links): (id, name, category, metadata) and (graph_id, u, v, weight)."""
    edge = "array<struct<source: int, target: int, weight: double>>"
    schema = f"id int, name string, category string, metadata string, graph struct<directed: boolean, edges: {edge}, links: {edge}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    edges = raw.select(F.col("id").alias("graph_id"), F.explode(F.coalesce("graph.edges", "graph.links")).alias("e"))
    return raw.select("id", "name", "category", "metadata"), edges.select("graph_id", F.col("e.source").alias("u"), F.col("e.target").alias("v"), F.col("e.weight").alias("weight"))


def _either(short: str, long: str, default: Any) -> Column:
    return F.coalesce(F.col(short), F.col(long), F.lit(default))


def normalized_manifest(entries: DataFrame) -> DataFrame:
    """Catalogue entries under long names, whichever names the file has."""
    e = conform(entries, MANIFEST_ENTRY)
    return e.select("id", "name", _either("type", "category", "other").alias("type"), _either("n", "nodes", 0).alias("nodes"), _either("e", "edges", 0).alias("edges"), _either("d", "density", 0.0).alias("density"), _either("h", "hash", "").alias("hash"), "sz", "p", F.coalesce("topo", "topologies", F.array().cast("array<string>")).alias("topologies"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(StructType.fromJson({"type": "struct", "fields": [{"name": "graphs", "type": {"type": "array", "elementType": MANIFEST_ENTRY.jsonValue(), "containsNull": True}, "nullable": True, "metadata": {}}]})).option("multiLine", True).json(path)
    return normalized_manifest(raw.select(F.explode("graphs").alias("g")).select("g.*"))


def read_presets_frame(spark: SparkSession, path: str) -> DataFrame:
    """name and selection, split at the first comma; the header line goes."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).where(F.col("value").contains(",")).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("selection")).where("not (lower(name) = 'name' and lower(selection) = 'selection')")


def library_spec(spark: SparkSession, path: str) -> DataFrame:
    """graph_type, params as a map, seed and topologies of a specification file."""
    raw = spark.read.option("header", True).schema("graph_type string, params string, seed int, topologies string").csv(path)
    return raw.select("graph_type", F.when(F.col("params") != "", F.str_to_map("params", F.lit(";"), F.lit("="))).alias("params"), "seed", F.split("topologies", r"\|").alias("topologies"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("sz"), F.sha2("content", 256).alias("hash"))


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """ok, corrupt or missing for each entry; the manifest's hash may be a prefix, an empty one passes."""
    found = files.withColumn("id", F.regexp_extract("file", r"^(\d+)_", 1).try_cast("int")).withColumnRenamed("hash", "found_hash").select("id", "found_hash")
    state = F.when(F.col("found_hash").isNull(), "missing").when(F.startswith("found_hash", "hash"), "ok").otherwise("corrupt")
    return manifest.join(found, "id", "left").select("id", "name", state.alias("state"))


def incomplete_runs(root: str) -> list[dict[str, Any]]:
    """Folders that have a config.json and no results yet, newest first, with their lines so far."""
    out = []
    for entry in os.scandir(root) if os.path.isdir(root) else []:
        config = os.path.join(entry.path, "config.json")
        if entry.is_dir() and os.path.exists(config) and not os.path.exists(os.path.join(entry.path, "results.db")):
            workers = os.path.join(entry.path, "workers")
            lines = sum(1 for f in (os.scandir(workers) if os.path.isdir(workers) else []) if f.name.endswith(".jsonl") for line in open(f.path) if line.strip())
            out.append({"path": entry.path, "checkpoint": os.path.exists(os.path.join(entry.path, "checkpoint.json")), "lines": lines, "mtime": os.path.getmtime(config)})
    return sorted(out, key=lambda r: -r["mtime"])


def resolve_batch(root: str, spec: str) -> str:
    """A path, a 1-based number (newest first), an exact name or a unique prefix."""
    if os.path.isdir(spec):
        return spec
    batches = sorted((e for e in os.scandir(root) if e.is_dir()), key=lambda e: (-e.stat().st_mtime, e.name))
    if spec.isdigit() and 1 <= int(spec) <= len(batches):
        return batches[int(spec) - 1].path
    named = [e.path for e in batches if e.name == spec] or [e.path for e in batches if e.name.startswith(spec)]
    if len(named) != 1:
        raise ValueError(f"{'no' if not named else 'more than one'} batch fits {spec!r}")
    return named[0]


def resolve_experiment(explicit: dict[str, Any], file: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """Explicit values before the file's before defaults; documented short names mean the long ones."""
    names = {"trials": "n_trials", "warmup": "warmup_trials", "workers": "n_workers"}
    known = {names.get(k, k): v for k, v in file.items() if v is not None}
    return defaults | known | {names.get(k, k): v for k, v in explicit.items() if v is not None}
