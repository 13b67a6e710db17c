"""Derived columns of runs, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes and their categories, first match wins.
PREFIXES = [
    ("random_er", "random_er"), ("random_planar", "random_planar"), ("random_", "random"), ("er_", "random_er"), ("barabasi_albert_", "barabasi_albert"),
    ("watts_strogatz_", "watts_strogatz"), ("sbm_", "sbm"), ("lfr_benchmark_", "lfr_benchmark"), ("planted_", "planted_solution"), ("weak_strong_cluster_", "weak_strong_cluster"),
    ("grid_", "grid"), ("honeycomb_", "honeycomb"), ("triangular_lattice_", "triangular_lattice"), ("kagome_", "kagome"), ("frustrated_square_", "frustrated_square"),
    ("king_graph_", "king_graph"), ("cubic_lattice_", "cubic_lattice"), ("bcc_lattice_", "bcc_lattice"), ("shastry_sutherland_", "shastry_sutherland"), ("spin_glass_", "spin_glass"),
    ("regular_", "regular"), ("circulant_", "circulant"), ("hypercube_", "hypercube"), ("johnson_", "johnson"), ("kneser_", "kneser"), ("turan_", "turan"),
    ("generalized_petersen_", "generalized_petersen"), ("hardware_native_", "hardware_native"), ("named_special_", "special"), ("sudoku_", "sudoku"),
    ("bipartite_", "bipartite"), ("complete_", "complete"), ("cycle_", "cycle"), ("path_", "path"), ("star_", "star"), ("wheel_", "wheel"),
    ("binary_tree_", "binary_tree"), ("tree_", "tree"),
]
SPECIAL = ("petersen", "dodecahedral", "icosahedral")

# Categories of the five families.
FAMILIES = {
    "random": ("random_er", "random_planar", "barabasi_albert", "watts_strogatz", "sbm", "lfr_benchmark", "regular"),
    "structured": ("complete", "bipartite", "circulant", "turan", "johnson", "kneser", "hypercube", "generalized_petersen"),
    "lattice": ("grid", "honeycomb", "triangular_lattice", "kagome", "king_graph", "cubic_lattice", "bcc_lattice", "shastry_sutherland", "frustrated_square"),
    "tree_path": ("path", "cycle", "star", "wheel", "binary_tree", "tree"),
    "application": ("spin_glass", "weak_strong_cluster", "planted_solution", "hardware_native", "sudoku", "named_special"),
}


def category_of(name: Column) -> Column:
    """Category by name: special names, K and digits, then the first prefix."""
    n = F.lower(F.trim(name))
    out = F.when(n.isin(*SPECIAL), "special").when(n.rlike(r"^k\d+$"), "complete")
    for prefix, category in PREFIXES:
        out = out.when(n.startswith(prefix), category)
    return out.otherwise("other")


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


FAULT = r"^(.+)@fr=([0-9.]+(?:e[+-]?\d+)?)$"


def base_topology(name: Column) -> Column:
    found = F.regexp_extract(name, FAULT, 1)
    return F.when(found == "", name).otherwise(found)


def fault_rate(name: Column) -> Column:
    found = F.regexp_extract(name, FAULT, 2)
    return F.when(found == "", F.lit(0.0)).otherwise(found.try_cast("double"))


def truth(c: Column) -> Column:
    """0/1, 'true', 'yes' and the like as a boolean; null stays null."""
    return F.when(c.isNotNull(), F.lower(c.cast("string")).isin("1", "true", "yes"))


def derive(runs: DataFrame, manifest: DataFrame | None = None, timeout: float = 60.0) -> DataFrame:
    """The seven derived columns. The manifest's type (by graph_id) goes before the name's category."""
    if "problem_name" in runs.columns and "graph_name" not in runs.columns:
        runs = runs.withColumnRenamed("problem_name", "graph_name")
    if "graph_id" not in runs.columns:
        runs = runs.withColumn("graph_id", F.lit(0))
    category = F.col("category") if "category" in runs.columns else category_of(F.col("graph_name"))
    if manifest is not None:
        runs = runs.join(manifest.select(F.col("id").alias("graph_id"), F.col("type").alias("_type")), "graph_id", "left")
        category = F.coalesce(F.col("_type"), category)
    return runs.withColumns({
        "category": category,
        "qubit_overhead_ratio": ratio("total_qubits_used", "problem_nodes"),
        "coupler_overhead_ratio": ratio("total_couplers_used", "problem_edges"),
        "max_to_avg_chain_ratio": ratio("max_chain_length", "avg_chain_length"),
        "is_timeout": F.col("wall_time") >= 0.95 * timeout,
        "base_topology": base_topology(F.col("topology_name")),
        "fault_rate": fault_rate(F.col("topology_name")),
    }).drop("_type")


def seed_of(*parts: Column) -> Column:
    """First four bytes, big-endian, of SHA-256 over the parts joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def density(n: Column, e: Column) -> Column:
    return F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(F.lit(0.0))


def chain_std(lengths: Column) -> Column:
    """Sample deviation of an array, 0 for fewer than two entries."""
    n = F.size(lengths)
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(0.0))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def direction(a: Column, b: Column) -> Column:
    return F.when(a < b, "a < b").when(a > b, "a > b").otherwise("equal")


def magnitude(r: Column) -> Column:
    """Size word of a rank-biserial effect; nothing for null."""
    return F.when(r.isNull(), "").when(r < 0.1, "negligible").when(r < 0.3, "small").when(r < 0.5, "medium").otherwise("large")


def success_label(ok: Column, n: Column, percent: bool = True) -> Column:
    """k/n, or a percentage where n is over 5."""
    plain = F.concat_ws("/", ok.cast("string"), n.cast("string"))
    return F.when(n > 5, F.concat(F.bround(100 * ok / n).cast("int").cast("string"), F.lit("%"))).otherwise(plain) if percent else plain


def family_of(category: Column) -> Column:
    out = None
    for family, members in FAMILIES.items():
        out = (F if out is None else out).when(category.isin(*members), family)
    return out


def virtual_topology(name: str, rate: float) -> str:
    return f"{name}@fr={rate:.4g}" if rate else name


def storage_folder(category: Column, file: Column) -> Column:
    """Folder of a stored graph: its category, small-world graphs by their k."""
    k = F.regexp_extract(file, "_k([0-9]+)_", 1)
    split = F.when(k == "", "watts_strogatz_other").otherwise(F.concat(F.lit("watts_strogatz_k"), k))
    return F.when(category == "watts_strogatz", split).otherwise(category)


def safe_name(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def run_log_name(algorithm: Column, graph: Column, trial: Column, seed: Column) -> Column:
    """File of one run's log, which tells all four."""
    return F.concat(F.concat_ws("__", safe_name(algorithm), safe_name(graph), trial.cast("string"), seed.cast("string")), F.lit(".log"))


# Most nodes and edges of the largest graph of each topology.
CEILINGS = {"chimera": (2048, 6016), "pegasus": (5640, 40484), "zephyr": (4800, 45864)}


def topology_tag(nodes: Column, edges: Column) -> Column:
    """Names of the topologies that are large enough, joined by a bar."""
    return F.concat_ws("|", *[F.when((nodes <= n) & (edges <= e), F.lit(name)) for name, (n, e) in CEILINGS.items()])


def geometric_series(start: int, stop: int, factor: float) -> list[int]:
    """start, start * factor, ... rounded, each once, and stop at the end."""
    if factor <= 1 or start <= 0:
        raise ValueError("a series needs a factor above 1 and a positive start")
    steps = range(int(math.log(max(stop, start) / start) / math.log(factor)) + 2) if stop >= start else []
    found = {n for n in (round(start * factor**k) for k in steps if start * factor**k <= stop) if n <= stop}
    return sorted(found | {stop})


def seed_count(nodes: Column, ceiling: int) -> Column:
    """Five seeds near the ceiling, three elsewhere."""
    return F.when(nodes >= 0.85 * ceiling, 5).otherwise(3)


def jitter(name: Column, width: float = 0.4) -> Column:
    """A place within `width` around 0 that a graph always has, from 32 bits of its name's MD5."""
    share = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return (share - 0.5) * width


def flat_record(embedding: Column) -> Column:
    """An embedding as the JSON text that flat files hold; null stays null."""
    return F.to_json(embedding)
