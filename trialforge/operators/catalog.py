"""Catalogue queries over normalized manifest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def type_overview(manifest: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """Least and greatest id, total and installed of each type."""
    m = manifest if installed is None else manifest.join(installed.select("id", F.lit(True).alias("_in")), "id", "left")
    there = F.count_if("_in") if installed is not None else F.lit(0).cast("long")
    return m.groupBy("type").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("total"), there.alias("installed"))


def listing(manifest: DataFrame, kind: str | None = None, places: int = 3) -> DataFrame:
    m = manifest if kind is None else manifest.where(F.lower("type") == kind.lower())
    return m.select("id", "name", "type", "nodes", "edges", F.round("density", places).alias("density")).orderBy("id")


def duplicates(manifest: DataFrame) -> DataFrame:
    """(id, name, canonical, collision): equal name and structure share the least id; a name with several structures collides."""
    p = F.transform(F.array_sort(F.map_entries(F.coalesce("p", F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    m = manifest.withColumn("fp", F.concat_ws("|", F.col("nodes").cast("string"), F.col("edges").cast("string"), F.concat_ws(";", p)))
    canonical = F.min("id").over(Window.partitionBy("name", "fp"))
    several = F.min("fp").over(Window.partitionBy("name")) != F.max("fp").over(Window.partitionBy("name"))
    return m.select("id", "name", canonical.alias("canonical"), several.alias("collision"))


def redirect(ids: DataFrame, dup: DataFrame) -> DataFrame:
    """Canonical ids of the given ids."""
    return ids.join(dup.select("id", "canonical"), "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def cache_summary(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes of each type."""
    f = files.withColumn("id", F.regexp_extract("file", r"^(\d+)_", 1).try_cast("int")).select("id", F.col("sz").alias("bytes"))
    return f.join(manifest.select("id", "type"), "id", "left").groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def by_id(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the given ids; an unknown id gives a row of nulls."""
    return ids.join(manifest, "id", "left")


def by_name(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """Entries of the given names; of entries with one name, the one of the greatest id."""
    last = manifest.groupBy("name").agg(F.max("id").alias("id"))
    return names.join(last, "name", "left").join(manifest.drop("name"), "id", "left")
