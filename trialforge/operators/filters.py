"""Selections and filters: id specifications, categories, shared graphs, views, compatibility."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUSHABLE = ("algorithm", "topology_name", "graph_name", "graph_id", "status", "success", "trial", "seed")
RESIDUAL = ("category", "base_topology", "fault_rate")


@dataclass
class Selection:
    """Included and excluded id ranges; every: all ids."""

    include: list[tuple[int, int]] = field(default_factory=list)
    exclude: list[tuple[int, int]] = field(default_factory=list)
    every: bool = False

    def condition(self, column: str = "graph_id") -> Column:
        c = F.col(column)
        within = lambda ranges: reduce(lambda a, r: a | c.between(*r), ranges, F.lit(False))
        return (F.lit(True) if self.every else within(self.include)) & ~within(self.exclude)

    def ids(self) -> set[int]:
        """The ids themselves; {-1} for all."""
        if self.every:
            return {-1}
        expand = lambda ranges: {i for a, b in ranges for i in range(a, b + 1)}
        return expand(self.include) - expand(self.exclude)


def parse_selection(spec: str, presets: dict[str, str] | None = None) -> Selection:
    """Ids and ranges by commas or &; ! leaves out; * is all; dashes may be typographic; a preset's name is its text."""
    text = (presets or {}).get(spec.strip(), spec).replace("–", "-").replace("—", "-")
    out = Selection()
    for part in (p.strip() for p in re.split("[,&]", text)):
        if not part:
            continue
        if part == "*":
            out.every = True
            continue
        body = part.removeprefix("!").strip()
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", body)
        if not m:
            raise ValueError(f"not an id or a range: {part!r}")
        a = int(m[1])
        (out.exclude if part.startswith("!") else out.include).append((a, int(m[2] or a)))
    return out


def read_presets(lines: list[str]) -> dict[str, str]:
    """name,selection at the first comma of each line; only the header line is skipped."""
    rows = [line.strip().split(",", 1) for line in lines if "," in line]
    return {name.strip(): text.strip() for name, text in (rows[1:] if rows and rows[0][0].strip().lower() == "name" else rows)}


def graph_filter(runs: DataFrame, graphs: str | None = None, category: str | None = None, presets: dict[str, str] | None = None) -> DataFrame:
    """Rows of the selected ids and of the category; an unknown category is an error."""
    if graphs is not None:
        runs = runs.where(parse_selection(graphs, presets).condition())
    if category is not None:
        found = runs.where(F.lower("category") == category.strip().lower())
        if found.isEmpty():
            present = sorted(r[0] for r in runs.select("category").distinct().collect() if r[0])
            raise ValueError(f"no graphs of category {category!r}; there are {', '.join(present)}")
        runs = found
    return runs


def graph_filter_slug(graphs: str | None = None, category: str | None = None) -> str:
    return "_".join(re.sub(r"[,&\s]+", "_", p.strip()) for p in (category, graphs) if p)


def shared_graphs(runs: DataFrame, algorithms: list[str] | None = None) -> DataFrame:
    """All rows of the graphs that each of the algorithms solved at least once."""
    wanted = runs if algorithms is None else runs.where(F.col("algorithm").isin(*algorithms))
    need = wanted.select(F.countDistinct("algorithm").alias("need")).head()[0] if algorithms is None else len(set(algorithms))
    solved = wanted.where("success").groupBy("graph_name").agg(F.countDistinct("algorithm").alias("_k")).where(F.col("_k") == need)
    return runs.join(solved, "graph_name", "left_semi")


def complete_cases(values: DataFrame, keys: list[str], n_algorithms: int) -> DataFrame:
    """Values of the problems for which all algorithms have one."""
    return at_least(values, keys, n_algorithms)


def at_least(values: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    return values.where("value is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def _one(c: Column, value: Any) -> tuple[Column, bool]:
    text = str(value).strip() if not isinstance(value, bool) else str(value).lower()
    negated = text.startswith("!")
    text = text.removeprefix("!").strip()
    if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", text):
        return c.cast("long").between(int(m[1]), int(m[2])), negated
    return c.cast("string") == text, negated


def view_predicate(filters: dict[str, Any]) -> Column:
    """Scalars, lists, !values and a-b ranges, for every key; fault rates compare as numbers."""
    out = F.lit(True)
    for key, spec in filters.items():
        if key not in (*PUSHABLE, *RESIDUAL):
            raise ValueError(f"no such view filter: {key}")
        values = spec if isinstance(spec, list) else [spec]
        if key == "fault_rate":
            parsed = [(F.col(key) == float(str(v).removeprefix("!")), str(v).startswith("!")) for v in values]
        else:
            parsed = [_one(F.col(key), v) for v in values]
        wanted, unwanted = [c for c, n in parsed if not n], [c for c, n in parsed if n]
        if wanted:
            out = out & reduce(Column.__or__, wanted)
        if unwanted:
            out = out & ~reduce(Column.__or__, unwanted)
    return out


def view(sources: list[tuple[DataFrame, dict[str, Any], str]]) -> DataFrame:
    """Union of filtered batches, each row with its source_batch."""
    parts = [df.where(view_predicate(filters)).withColumn("source_batch", F.lit(name)) for df, filters, name in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def supports(supported: list[str] | None, topology: Column) -> Column:
    """Any of the prefixes, without case; None: all."""
    if supported is None:
        return F.lit(True)
    return reduce(Column.__or__, [F.startswith(F.lower(topology), F.lit(p.lower())) for p in supported], F.lit(False))


def fits(graph_topologies: str, topology: str, nodes: str, edges: str, most_nodes: str, most_edges: str) -> Column:
    """By the manifest's topology prefixes where it has any, else by size."""
    named = F.exists(F.col(graph_topologies), lambda p: F.startswith(F.lower(F.col(topology)), F.lower(p)))
    return F.when(F.coalesce(F.size(graph_topologies), F.lit(0)) > 0, named).otherwise((F.col(nodes) <= F.col(most_nodes)) & (F.col(edges) <= F.col(most_edges)))


def search_graphs(manifest: DataFrame, category: str | None = None, min_nodes: int = 0, max_nodes: int = 0, min_edges: int = 0, max_edges: int = 0, topology: str | None = None) -> DataFrame:
    """Catalogue entries by all given bounds (0: none), in order of id."""
    out = manifest
    if category:
        out = out.where(F.lower("type") == category.lower())
    for column, lo, hi in (("nodes", min_nodes, max_nodes), ("edges", min_edges, max_edges)):
        out = out.where(F.col(column) >= lo) if lo else out
        out = out.where(F.col(column) <= hi) if hi else out
    if topology:
        out = out.where(F.array_contains("topologies", topology))
    return out.orderBy("id")


def drop_selected_duplicates(selected: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Leave out an id only if its canonical id is selected too. duplicates: (id, canonical)."""
    twin = duplicates.where("id <> canonical").join(selected.select(F.col("id").alias("canonical")), "canonical", "left_semi").select("id")
    return selected.join(twin, "id", "left_anti")


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
