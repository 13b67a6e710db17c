"""Graph-relational operators: embedding checks and metrics, faults, components, properties, topologies.

Graphs are edge frames (u, v); embeddings are chain frames (run_id, src, qubit). Every check is a
join or an aggregation over all runs at once.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller end first; loops go."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def both_ways(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))


def chains_of(embeddings: DataFrame) -> DataFrame:
    """(run_id, src, pos, qubit) from the map form."""
    return embeddings.select("run_id", F.explode("embedding").alias("src", "chain")).select("run_id", F.col("src").cast("int").alias("src"), F.posexplode("chain").alias("pos", "qubit"))


# Checks of embeddings, first failure first.

CHECKS = ("coverage", "non_empty_chains", "connectivity", "disjointness", "edge_preservation")


def uncovered(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Source nodes (run_id, src) without a chain."""
    return nodes.select("run_id", "src").join(chains, ["run_id", "src"], "left_anti")


def overlaps(chains: DataFrame) -> DataFrame:
    """Qubits that a run uses more than once, in one chain or in two."""
    return chains.groupBy("run_id", "qubit").agg(F.count("*").alias("n")).where("n > 1")


def unpreserved(source_edges: DataFrame, chains: DataFrame, target: DataFrame) -> DataFrame:
    """Source edges (run_id, u, v) that no target edge joins chain to chain.

    One target edge is enough for a source edge. So first a few qubits of each chain look for one, then
    sixteen times as many for the source edges that are left, and at last all qubits for the rest.
    """
    from trialforge.sources.shared import cut

    chains = cut(chains.select("run_id", "src", "qubit"), "chains")
    t = cut(both_ways(target.select("u", "v")).select(F.col("u").alias("qa"), F.col("v").alias("qb")).distinct(), "couplers")
    left = cut(source_edges, "source-edges")
    share = max(1, chains.count() // (4 * max(1, chains.select("run_id", "src").distinct().count())))
    while True:
        a = chains.select("run_id", F.col("src").alias("u"), F.col("qubit").alias("qa"))
        b = chains.select("run_id", F.col("src").alias("v"), F.col("qubit").alias("qb"))
        if share > 1:
            a = a.where(F.pmod(F.xxhash64("run_id", "u", "qa"), F.lit(share)) == 0)
        b = b.join(left.select("run_id", "v"), ["run_id", "v"], "left_semi")
        kept = left.join(a, ["run_id", "u"]).join(t, "qa").join(b, ["run_id", "v", "qb"]).select("run_id", "u", "v").distinct()
        left = left.join(kept, ["run_id", "u", "v"], "left_anti")
        if share == 1:
            return left
        left = cut(left, "source-edges")
        if left.isEmpty():
            return left
        share = share // 16 or 1


def inner_edges(chains: DataFrame, target: DataFrame) -> DataFrame:
    """Target edges inside chains: (run_id, src, u, v)."""
    a = chains.select("run_id", "src", F.col("qubit").alias("u"))
    b = chains.select("run_id", "src", F.col("qubit").alias("v"))
    return a.join(undirected(target), "u").join(b, ["run_id", "src", "v"]).select("run_id", "src", "u", "v").distinct()


def min_labels(nodes: DataFrame | None, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the least node of each component within keys. Without nodes, those of the edges.

    Each round hooks every node to its least smaller neighbour, follows hooks down to nodes that have none
    and keeps distinct edges between these. A node that takes none in is itself taken in by the next round,
    so two rounds halve the nodes that are left. Written tables go to the folder of spark.checkpoint.dir.
    """
    from trialforge.sources.shared import cut

    keyed = F.expr(" and ".join(["true", *[f"{k} is not null" for k in keys]]))
    ordered = lambda e: e.where("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    whole = cut(ordered(edges), "edges")
    left, rounds = whole.where(keyed), []
    while not left.isEmpty():
        up = cut(left.groupBy(*keys, F.col("v").alias("node")).agg(F.min("u").alias("label")), "hooks")
        while True:
            above = up.select(*keys, F.col("node").alias("label"), F.col("label").alias("next"))
            up = cut(up.join(above, [*keys, "label"], "left").select(*keys, "node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "hooks")
            if up.where("moved").isEmpty():
                break
        up = up.drop("moved")
        rounds.append(up)
        for end in ("u", "v"):
            left = left.join(up.select(*keys, F.col("node").alias(end), F.col("label").alias("to")), [*keys, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = cut(ordered(left).distinct(), "edges")
    labels = left.select(*keys, F.col("u").alias("node"), F.col("u").alias("label"))
    for up in reversed(rounds):
        later = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("last"))
        labels = up.join(later, [*keys, "label"], "left").select(*keys, "node", F.coalesce("last", "label").alias("label")).unionByName(labels)
    if nodes is not None:
        return nodes.select(*keys, "node").join(labels, [*keys, "node"], "left").select(*keys, "node", F.coalesce("label", "node").alias("label"))
    labels = cut(labels, "labels")
    # the least nodes themselves, and nodes without keys, which nothing joins
    alone = whole.where(~keyed).select(*keys, F.explode(F.array("u", "v")).alias("label"))
    rest = labels.select(*keys, "label").unionByName(alone).distinct()
    return labels.unionByName(rest.select(*keys, F.col("label").alias("node"), "label"))


def disconnected(chains: DataFrame, target: DataFrame) -> DataFrame:
    """Chains (run_id, src) of more than one piece."""
    nodes = chains.select("run_id", "src", F.col("qubit").alias("node")).distinct()
    labels = min_labels(nodes, inner_edges(chains, target), ["run_id", "src"])
    return labels.groupBy("run_id", "src").agg(F.countDistinct("label").alias("pieces")).where("pieces > 1")


def spread(chains: DataFrame, target: DataFrame) -> DataFrame:
    """Chains (run_id, src) with qubits in two components of the whole target: they cannot be of one piece."""
    edges = undirected(target)
    labels = min_labels(None, edges, [])
    placed = chains.join(labels.select(F.col("node").alias("qubit"), "label"), "qubit", "left").withColumn("label", F.coalesce("label", "qubit"))
    return placed.groupBy("run_id", "src").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("run_id", "src")


def validate(nodes: DataFrame, source_edges: DataFrame, chains: DataFrame, empty: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each run: passed, and the first check that failed. empty: (run_id, src) of chains without qubits.

    Only runs that passed the checks before go on to the next; chains that lie in two components of the
    target are told before any are followed along their own edges.
    """
    from trialforge.sources.shared import cut

    # each is read by several checks
    nodes, source_edges, empty = cut(nodes.select("run_id", "src"), "nodes"), cut(source_edges.select("run_id", "u", "v"), "source-edges"), cut(empty.select("run_id", "src"), "empty")
    chains, target = cut(chains.select("run_id", "src", "qubit"), "chains"), cut(undirected(target), "target")
    checks = [
        (0, lambda c, e: uncovered(nodes, chains.select("run_id", "src").unionByName(empty))), (1, lambda c, e: empty), (2, lambda c, e: spread(c, target)), (2, lambda c, e: disconnected(c, target)),
        (3, lambda c, e: overlaps(c)), (4, lambda c, e: unpreserved(e, c, target)),
    ]
    failed = None
    for k, check in checks:
        on = (lambda rows: rows) if failed is None else (lambda rows, f=failed: rows.join(f, "run_id", "left_anti"))
        going = on(chains)
        if failed is not None and on(nodes.select("run_id")).isEmpty():
            break
        one = on(check(going, on(source_edges)).select("run_id").distinct()).withColumn("k", F.lit(k))
        failed = cut(one if failed is None else failed.unionByName(one), "failed")
    name = F.element_at(F.array(*[F.lit(c) for c in CHECKS]), F.col("k") + 1)
    return nodes.select("run_id").distinct().join(failed, "run_id", "left").select("run_id", F.col("k").isNull().alias("passed"), F.when(F.col("k").isNotNull(), name).alias("check"))


def key_problems(nodes: DataFrame, chains: DataFrame, target_nodes: DataFrame) -> DataFrame:
    """Format checks that joins can tell: keys beyond the source, keys missing, qubits beyond the target."""
    extra = chains.select("run_id", "src").distinct().join(nodes.select("run_id", "src"), ["run_id", "src"], "left_anti").groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("extra_keys").alias("problem"), "n")
    missing = uncovered(nodes, chains).groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("missing_keys").alias("problem"), "n")
    beyond = chains.join(target_nodes.select(F.col("node").alias("qubit")), "qubit", "left_anti").groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("value_validity").alias("problem"), "n")
    return extra.unionByName(missing).unionByName(beyond)


def time_problems(runs: DataFrame, cores: int) -> DataFrame:
    """Rows whose wall time isn't positive and finite, or whose CPU time is more than all cores give."""
    wall = F.coalesce((F.col("wall_time") >= 0) & ~F.isnan("wall_time"), F.lit(False))
    return runs.withColumn("problem", F.when(~wall, "wall_time_validity").when(F.col("cpu_time") > F.col("wall_time") * cores, "cpu_time_plausibility")).where("problem is not null")


def embedding_metrics(chains: DataFrame, target: DataFrame) -> DataFrame:
    """Chain lengths' mean, greatest and deviation, distinct qubits, and couplers inside chains, by run."""
    lengths = chains.groupBy("run_id", "src").agg(F.count("*").alias("n"))
    sizes = lengths.groupBy("run_id").agg(F.avg("n").alias("avg_chain_length"), F.max("n").alias("max_chain_length"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("chain_length_std"))
    qubits = chains.groupBy("run_id").agg(F.countDistinct("qubit").alias("total_qubits_used"))
    couplers = inner_edges(chains, target).groupBy("run_id").agg(F.count("*").alias("total_couplers_used"))
    return sizes.join(qubits, "run_id").join(couplers, "run_id", "left").fillna(0, ["total_couplers_used"])


# Faults.


def sample_nodes(n: int, rate: float, seed: int) -> list[int]:
    """int(n * rate) of the nodes 0..n-1, by the language's own generator, so that a seed always names the same faults."""
    if not 0 <= rate < 1:
        raise ValueError("a fault rate is at least 0 and below 1")
    return random.Random(seed).sample(range(n), int(n * rate))


def without_faults(nodes: DataFrame, edges: DataFrame, bad_nodes: DataFrame | None = None, bad_edges: DataFrame | None = None, drop_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left; nodes that only lost couplers go if nothing holds them."""
    if bad_nodes is not None:
        nodes = nodes.join(bad_nodes, "node", "left_anti")
        for end in ("u", "v"):
            edges = edges.join(bad_nodes.withColumnRenamed("node", end), end, "left_anti")
    if bad_edges is not None:
        edges = edges.join(both_ways(bad_edges), ["u", "v"], "left_anti")
        if drop_isolated:
            nodes = nodes.join(both_ways(edges).select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    return nodes.select("node"), edges.select("u", "v")


def removed_parts(nodes: DataFrame, edges: DataFrame, left_nodes: DataFrame, left_edges: DataFrame) -> DataFrame:
    """What faults took away: (kind, u, v), v null for nodes."""
    gone = nodes.select("node").join(left_nodes.select("node"), "node", "left_anti").select(F.lit("node").alias("kind"), F.col("node").alias("u"), F.lit(None).cast("long").alias("v"))
    cut_ = undirected(edges).join(undirected(left_edges), ["u", "v"], "left_anti").select(F.lit("coupler").alias("kind"), "u", F.col("v").cast("long").alias("v"))
    return gone.unionByName(cut_)


def component_count(nodes: DataFrame, edges: DataFrame) -> int:
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    labels = min_labels(nodes, edges, [])
    return labels.where("node = label").count()


# Properties.


def degree_properties(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges, nodes with an edge, density, degrees (population deviation) and whether all are equal, by graph."""
    degrees = both_ways(edges, keys).groupBy(*keys, "u").agg(F.count("*").alias("d"))
    n, m = F.count("*"), F.sum("d") / 2
    return degrees.groupBy(*keys).agg(n.alias("n_vertices"), m.cast("long").alias("n_edges"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"), F.stddev_pop("d").alias("degree_std"), (F.max("d") == F.min("d")).alias("is_regular"))


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, c) with a < b < c.

    Each edge points from the end with fewer edges to the other (ties by number), so no node, however
    many edges it has, has more than about sqrt(2 m) outgoing ones.
    """
    e = edges.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    degrees = both_ways(e, keys).groupBy(*keys, "u").agg(F.count("*").alias("d"))
    ends = e.join(degrees.withColumnRenamed("d", "du"), [*keys, "u"]).join(degrees.select(*keys, F.col("u").alias("v"), F.col("d").alias("dv")), [*keys, "v"])
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    swap = lambda a, b, da, db: (F.struct(F.col(a).alias("n"), F.col(da).alias("d")).alias("low"), F.struct(F.col(b).alias("n"), F.col(db).alias("d")).alias("high"))
    out = ends.where(up).select(*keys, *swap("u", "v", "du", "dv")).unionByName(ends.where(~up).select(*keys, *swap("v", "u", "dv", "du")))
    first = out.select(*keys, F.col("low.n").alias("x"), F.col("high.n").alias("y"), F.col("high.d").alias("dy"))
    second = out.select(*keys, F.col("low.n").alias("x"), F.col("high.n").alias("z"), F.col("high.d").alias("dz"))
    wedges = first.join(second, [*keys, "x"]).where("dy < dz or (dy = dz and y < z)").select(*keys, "x", "y", "z")
    closed = wedges.join(out.select(*keys, F.col("low.n").alias("y"), F.col("high.n").alias("z")), [*keys, "y", "z"])
    low, high = F.least("x", "y", "z"), F.greatest("x", "y", "z")
    return closed.select(*keys, low.alias("a"), (F.col("x") + F.col("y") + F.col("z") - low - high).alias("b"), high.alias("c"))


def clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles, transitivity and mean local clustering by graph."""
    t = triangles(edges, keys)
    corner = F.explode(F.array("a", "b", "c"))
    local = t.select(*keys, corner.alias("u")).groupBy(*keys, "u").agg(F.count("*").alias("t"))
    degrees = both_ways(edges, keys).groupBy(*keys, "u").agg(F.count("*").alias("d")).join(local, [*keys, "u"], "left").fillna(0, ["t"])
    pairs = F.col("d") * (F.col("d") - 1) / 2
    c = F.when(F.col("d") > 1, F.col("t") / pairs).otherwise(0.0)
    return degrees.groupBy(*keys).agg((F.sum("t") / 3).cast("long").alias("triangles"), F.coalesce(F.try_divide(F.sum("t").cast("double"), F.sum(pairs)), F.lit(0.0)).alias("clustering_global"), F.avg(c).alias("clustering_avg"))


def assortativity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the degrees at the two ends of edges; null without variance."""
    both = both_ways(edges, keys)
    d = both.groupBy(*keys, "u").agg(F.count("*").cast("double").alias("d"))
    ends = both.join(d.withColumnRenamed("d", "x"), [*keys, "u"]).join(d.select(*keys, F.col("u").alias("v"), F.col("d").alias("y")), [*keys, "v"])
    return ends.groupBy(*keys).agg(F.try_divide(F.covar_pop("x", "y"), F.nullif(F.var_pop("x"), F.lit(0.0))).alias("assortativity"))


def bfs_levels(edges: DataFrame, source: int, most: int = 10_000) -> DataFrame:
    """(node, level) from one source, a frontier join for each level."""
    from trialforge.sources.shared import cut

    both = both_ways(edges)
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source, 0)], "node long, level int")
    frontier = seen
    for level in range(1, most):
        frontier = cut(both.join(frontier.select(F.col("node").alias("u")), "u").select(F.col("v").cast("long").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier), "seen")
    else:
        raise RuntimeError(f"nodes are further away than {most - 1} steps")
    return seen


# Hardware topologies, by coordinates.


def chimera(spark: SparkSession, m: int, n: int | None = None, t: int = 4) -> DataFrame:
    """Edges of an m by n grid of bipartite cells with t nodes a side; node ((i n + j) 2 + side) t + k."""
    n = n or m
    cells = spark.range(m * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))
    node = lambda i, j, side, k: ((i * n + j) * 2 + side) * t + k
    ks = F.sequence(F.lit(0), F.lit(t - 1))
    i, j = F.col("i"), F.col("j")
    k = cells.withColumn("k", F.explode(ks))
    inner = k.withColumn("l", F.explode(ks)).select(node(i, j, F.lit(0), F.col("k")).alias("u"), node(i, j, F.lit(1), F.col("l")).alias("v"))
    down = k.where(i < m - 1).select(node(i, j, F.lit(0), F.col("k")).alias("u"), node(i + 1, j, F.lit(0), F.col("k")).alias("v"))
    right = k.where(j < n - 1).select(node(i, j, F.lit(1), F.col("k")).alias("u"), node(i, j + 1, F.lit(1), F.col("k")).alias("v"))
    return inner.unionByName(down).unionByName(right)


# Offsets of the twelve tracks of a Pegasus graph, vertical and horizontal.
PEGASUS_VERTICAL = (2, 2, 2, 2, 10, 10, 10, 10, 6, 6, 6, 6)
PEGASUS_HORIZONTAL = (6, 6, 6, 6, 2, 2, 2, 2, 10, 10, 10, 10)


def pegasus(spark: SparkSession, m: int) -> DataFrame:
    """Edges of the fabric of P(m): qubits are segments of length 12 on a grid; crossing ones are coupled.

    A qubit (u, w, k, z) has number ((u m + w) 12 + k)(m - 1) + z. Qubits without an internal
    coupler don't belong to the fabric.
    """
    size = m * 12 * (m - 1)
    q = spark.range(2 * size).select(F.col("id"), (F.col("id") / size).cast("int").alias("u"), (F.col("id") / (12 * (m - 1)) % m).cast("int").alias("w"), (F.col("id") / (m - 1) % 12).cast("int").alias("k"), (F.col("id") % (m - 1)).cast("int").alias("z"))
    offset = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("k") + 1)
    line = F.col("w") * 12 + F.col("k")
    vertical = q.where("u = 0").select(F.col("id").alias("u"), line.alias("x"), (F.col("z") * 12 + offset(PEGASUS_VERTICAL)).alias("y0"))
    horizontal = q.where("u = 1").select(F.col("id").alias("v"), line.alias("y"), (F.col("z") * 12 + offset(PEGASUS_HORIZONTAL)).alias("x0"))
    # equi-join on crossings: each segment names the twelve lines it crosses
    a = vertical.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y0") + 11)))
    b = horizontal.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x0") + 11)))
    internal = a.join(b, ["x", "y"]).select("u", "v")
    external = q.where(F.col("z") < m - 2).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    odd = q.where("k % 2 = 0").select(F.col("id").alias("u"), (F.col("id") + (m - 1)).alias("v"))
    inside = internal.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rest = external.unionByName(odd)
    for end in ("u", "v"):
        rest = rest.join(inside.withColumnRenamed("node", end), end, "left_semi")
    return internal.unionByName(rest.select("u", "v"))


def zephyr(spark: SparkSession, m: int, t: int = 4) -> DataFrame:
    """Edges of Z(m, t): qubit (u, w, k, j, z) has number ((((u (2m+1) + w) t + k) 2 + j) m + z.

    Internal couplers join crossing segments, external ones neighbours in z, odd ones j 0 and 1.
    """
    lines = 2 * m + 1
    total = 2 * lines * t * 2 * m
    q = spark.range(total).select(F.col("id"), (F.col("id") / (lines * t * 2 * m)).cast("int").alias("u"), (F.col("id") / (t * 2 * m) % lines).cast("int").alias("w"), (F.col("id") / (2 * m) % t).cast("int").alias("k"), (F.col("id") / m % 2).cast("int").alias("j"), (F.col("id") % m).cast("int").alias("z"))
    at = 2 * F.col("z") + F.col("j")
    spans = q.withColumn("cross", F.explode(F.array(at, at + 1)))
    a = spans.where("u = 0").select(F.col("id").alias("u"), F.col("w").alias("x"), F.col("cross").alias("y"))
    b = spans.where("u = 1").select(F.col("id").alias("v"), F.col("w").alias("y"), F.col("cross").alias("x"))
    internal = a.join(b, ["x", "y"]).select("u", "v")
    external = q.where(F.col("z") < m - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    first = q.where("j = 0")
    odd = first.select(F.col("id").alias("u"), (F.col("id") + m).alias("v")).unionByName(first.where("z > 0").select(F.col("id").alias("u"), (F.col("id") + m - 1).alias("v")))
    return internal.unionByName(external).unionByName(odd)


TOPOLOGIES: dict[str, tuple[str, tuple[int, ...]]] = {}
FAMILIES = {"chimera": chimera, "pegasus": pegasus, "zephyr": zephyr}


def register_topology(name: str, family: str, *parameters: int) -> None:
    if family not in FAMILIES:
        raise ValueError(f"no such topology family: {family}")
    TOPOLOGIES[name] = (family, parameters)


for _name, _args in {"chimera_4x4x4": (4, 4, 4), "chimera_8x8x4": (8, 8, 4), "chimera_12x12x4": (12, 12, 4), "chimera_16x16x4": (16, 16, 4)}.items():
    register_topology(_name, "chimera", *_args)
for _m in (4, 6, 8, 16):
    register_topology(f"pegasus_{_m}", "pegasus", _m)
for _m in (2, 4, 6, 12):
    register_topology(f"zephyr_{_m}", "zephyr", _m)


def topology(spark: SparkSession, name: str) -> DataFrame:
    if name not in TOPOLOGIES:
        raise ValueError(f"no such topology: {name}")
    family, parameters = TOPOLOGIES[name]
    return FAMILIES[family](spark, *parameters)


def chimera_dimensions(nodes: int, edges: int, t: int = 4) -> tuple[int, int] | None:
    """m and n from node and edge counts: nodes = 2 t m n, edges = t (t m n + (m - 1) n + m (n - 1))."""
    cells, rest = divmod(nodes, 2 * t)
    if rest:
        return None
    return next(((m, cells // m) for m in range(1, cells + 1) if cells % m == 0 and edges == t * (t * cells + 2 * cells - m - cells // m)), None)


# Problem graphs with closed forms.


def _pairs(spark: SparkSession, n: int, keep: Column) -> DataFrame:
    """u < v below n that fit, one task row for each u."""
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("v")).where(keep)


def generate(spark: SparkSession, family: str, *p: int) -> DataFrame:
    """Edges (u, v) of a named family with whole-number parameters."""
    u, v = F.col("u"), F.col("v")
    if family == "complete":
        return _pairs(spark, p[0], F.lit(True))
    if family == "bipartite":
        return spark.range(p[0]).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(p[0]).cast("long"), F.lit(p[0] + p[1] - 1).cast("long"))).alias("v"))
    if family == "turan":
        return _pairs(spark, p[0], u % p[1] != v % p[1])
    if family in ("grid", "king_graph", "frustrated_square", "triangular_lattice"):
        rows, columns = p
        at = spark.range(rows * columns).select(F.col("id").alias("u"), (F.col("id") % columns).alias("c"), F.floor(F.col("id") / columns).alias("r"))
        steps = {"grid": [(0, 1), (1, 0)], "king_graph": [(0, 1), (1, 0), (1, 1), (1, -1)], "frustrated_square": [(0, 1), (1, 0), (1, 1), (1, -1)], "triangular_lattice": [(0, 1), (1, 0), (1, 1)]}[family]
        moves = at.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])))
        inside = moves.where((F.col("r") + F.col("s.dr") < rows) & (F.col("c") + F.col("s.dc")).between(0, columns - 1))
        return inside.select("u", (u + F.col("s.dr") * columns + F.col("s.dc")).cast("long").alias("v"))
    if family == "cubic_lattice":
        a, b, c = p
        at = spark.range(a * b * c).select(F.col("id").alias("u"), (F.col("id") % c).alias("z"), (F.floor(F.col("id") / c) % b).alias("y"), F.floor(F.col("id") / (b * c)).alias("x"))
        out = at.where(F.col("z") < c - 1).select("u", (u + 1).alias("v"))
        return out.unionByName(at.where(F.col("y") < b - 1).select("u", (u + c).alias("v"))).unionByName(at.where(F.col("x") < a - 1).select("u", (u + b * c).alias("v")))
    if family in ("cycle", "path"):
        line = spark.range(p[0] - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        return line if family == "path" or p[0] < 3 else line.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("u"), F.lit(p[0] - 1).cast("long").alias("v")))
    if family in ("star", "wheel"):
        spokes = spark.range(1, p[0]).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        if family == "star":
            return spokes
        rim = spark.range(1, p[0]).select(F.col("id").alias("u"), F.when(F.col("id") == p[0] - 1, 1).otherwise(F.col("id") + 1).cast("long").alias("v"))
        return spokes.unionByName(rim)
    if family in ("tree", "binary_tree"):
        r, depth = (2, p[0]) if family == "binary_tree" else p
        n = sum(r**d for d in range(depth + 1))
        return spark.range(1, n).select(F.floor((F.col("id") - 1) / r).cast("long").alias("u"), F.col("id").alias("v"))
    if family == "hypercube":
        bit = F.explode(F.sequence(F.lit(0), F.lit(p[0] - 1)))
        return spark.range(1 << p[0]).select(F.col("id").alias("u"), bit.alias("b")).select("u", u.bitwiseXOR(F.pow(F.lit(2), F.col("b")).cast("long")).alias("v")).where("u < v")
    if family == "circulant":
        n, *offsets = p
        moved = spark.range(n).select(F.col("id").alias("u"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o"))
        return undirected(moved.select("u", ((u + F.col("o")) % n).alias("v")))
    if family == "generalized_petersen":
        n, k = p
        at = spark.range(n).select(F.col("id").alias("u"))
        outer = at.select("u", ((u + 1) % n).alias("v"))
        inner = at.select((u + n).alias("u"), (n + (u + k) % n).alias("v"))
        return undirected(outer.unionByName(at.select("u", (u + n).alias("v"))).unionByName(inner))
    if family in ("johnson", "kneser"):
        n, k = p
        shared = k - 1 if family == "johnson" else 0
        subsets = spark.range(1 << n).where(F.bit_count("id") == k).withColumn("node", F.row_number().over(Window.orderBy("id")) - 1).cache()
        a = subsets.select(F.col("id").alias("a"), F.col("node").cast("long").alias("u"))
        b = subsets.select(F.col("id").alias("b"), F.col("node").cast("long").alias("v"))
        return a.join(b, (F.col("u") < F.col("v")) & (F.bit_count(F.col("a").bitwiseAND(F.col("b"))) == shared)).select("u", "v")
    if family == "sudoku":
        b = p[0]
        side = b * b
        box = lambda c: F.floor(F.floor(c / side) / b) * b + F.floor(c % side / b)
        return _pairs(spark, side * side, (F.floor(u / side) == F.floor(v / side)) | (u % side == v % side) | (box(u) == box(v)))
    if family == "random_er":
        n, percent, seed = p
        return _pairs(spark, n, F.pmod(F.xxhash64(u, v, F.lit(seed)), F.lit(10_000)) < percent * 100)
    if family == "random_geometric":
        n, percent, seed = p
        at = lambda c, k: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
        dx, dy = at(u, 0) - at(v, 0), at(u, 1) - at(v, 1)
        return _pairs(spark, n, dx * dx + dy * dy <= (percent / 100) ** 2)
    if family == "random_tree":
        n, seed = p
        return spark.range(1, n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("id")).alias("u"), F.col("id").alias("v"))
    if family == "sbm":
        blocks, size, inside, outside, seed = p
        share = F.when(F.floor(u / size) == F.floor(v / size), inside).otherwise(outside)
        return _pairs(spark, blocks * size, F.pmod(F.xxhash64(u, v, F.lit(seed)), F.lit(10_000)) < share * 100)
    if family in ("honeycomb", "shastry_sutherland"):
        rows, columns = p
        at = spark.range(rows * columns).select(F.col("id").alias("u"), (F.col("id") % columns).alias("c"), F.floor(F.col("id") / columns).alias("r"))
        c, r = F.col("c"), F.col("r")
        right = at.where(c < columns - 1).select("u", (u + 1).alias("v"))
        if family == "honeycomb":  # a brick wall
            return right.unionByName(at.where((r < rows - 1) & ((r + c) % 2 == 0)).select("u", (u + columns).alias("v")))
        down = at.where(r < rows - 1).select("u", (u + columns).alias("v"))
        # cells alternate, and every second one has a diagonal, which rises to the right
        rising = at.where((r > 0) & (c < columns - 1) & ((r + c) % 2 == 0)).select((u - columns + 1).alias("u"), F.col("u").alias("v"))
        return right.unionByName(down).unionByName(rising)
    if family == "kagome":
        return line_graph(generate(spark, "honeycomb", *p))
    if family == "bcc_lattice":
        a, b, c = p
        corner = spark.range(a * b * c).select(F.col("id").alias("u"), (F.col("id") % c).alias("z"), (F.floor(F.col("id") / c) % b).alias("y"), F.floor(F.col("id") / (b * c)).alias("x"))
        steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
        at = corner.withColumn("s", steps).select("u", (F.col("x") - F.col("s.i")).alias("x"), (F.col("y") - F.col("s.j")).alias("y"), (F.col("z") - F.col("s.k")).alias("z"))
        inside = at.where(F.col("x").between(0, a - 2) & F.col("y").between(0, b - 2) & F.col("z").between(0, c - 2))
        return inside.select("u", (a * b * c + (F.col("x") * (b - 1) + F.col("y")) * (c - 1) + F.col("z")).cast("long").alias("v"))
    if family == "barabasi_albert":
        n, m, seed = p
        # copying form of preferential attachment: each of a node's m ends is an earlier node or an earlier end's node
        rng, ends, rows = random.Random(seed), list(range(m)), []
        for new in range(m, n):
            picked: set[int] = set()
            while len(picked) < m:
                picked.add(rng.choice(ends) if ends else rng.randrange(new))
            rows += [(old, new) for old in sorted(picked)]
            ends += [x for old in picked for x in (old, new)]
        return spark.createDataFrame(rows, "u long, v long")
    if family == "watts_strogatz":
        n, k, percent, seed = p
        ring = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d"))
        moved = F.pmod(F.xxhash64("u", "d", F.lit(seed)), F.lit(100)) < percent
        far = F.pmod(F.xxhash64("u", "d", F.lit(seed + 1)), F.lit(n))
        return undirected(ring.select("u", F.when(moved, far).otherwise((u + F.col("d")) % n).alias("v")))
    if family == "weak_strong_cluster":
        clusters, size, between, seed = p
        inside = _pairs(spark, clusters * size, F.floor(u / size) == F.floor(v / size))
        links = spark.range(clusters - 1).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(between - 1))).alias("i"))
        draw = lambda k: F.pmod(F.xxhash64("c", "i", F.lit(seed), F.lit(k)), F.lit(size))
        return inside.unionByName(links.select((F.col("c") * size + draw(0)).alias("u"), ((F.col("c") + 1) * size + draw(1)).alias("v")).distinct())
    if family == "cubic_lcf":
        return _lcf(spark, p[0], p[1:])
    raise ValueError(f"no such graph family: {family}")


# LCF codes of named cubic graphs, node count and repeated shifts.
NAMED_LCF = {
    "heawood": (14, (5, -5)), "dodecahedral": (20, (10, 7, 4, -4, -7, 10, -4, 7, -7, 4)), "pappus": (18, (5, 7, -7, 7, -7, -5)), "desargues": (20, (5, -5, 9, -9)),
    "moebius_kantor": (16, (5, -5)), "frucht": (12, (-5, -2, -4, 2, 5, -2, 2, 5, -2, -5, 4, 2)), "truncated_tetrahedron": (12, (2, 6, -2)), "cubical": (8, (3, -3)), "tutte_coxeter": (30, (-13, -9, 7, -7, 9, 13)),
}


def _lcf(spark: SparkSession, n: int, shifts: tuple[int, ...]) -> DataFrame:
    """A cycle of n nodes with the chords i to i + shift."""
    ring = [(i, (i + 1) % n) for i in range(n)]
    return undirected(spark.createDataFrame(ring + [(i, (i + shifts[i % len(shifts)]) % n) for i in range(n)], "u long, v long"))


def named(spark: SparkSession, name: str) -> DataFrame:
    if name == "petersen":
        return generate(spark, "generalized_petersen", 5, 2)
    if name == "tetrahedral":
        return generate(spark, "complete", 4)
    if name == "octahedral":
        return generate(spark, "turan", 6, 3)
    if name == "icosahedral":
        return undirected(spark.createDataFrame(_icosahedron(), "u long, v long"))
    if name not in NAMED_LCF:
        raise ValueError(f"no such graph: {name}")
    return _lcf(spark, *NAMED_LCF[name])


def _icosahedron() -> list[tuple[int, int]]:
    """Two poles and an antiprism of two rings of five."""
    rings = [(1 + i, 1 + (i + 1) % 5) for i in range(5)] + [(6 + i, 6 + (i + 1) % 5) for i in range(5)]
    poles = [(0, 1 + i) for i in range(5)] + [(11, 6 + i) for i in range(5)]
    return rings + poles + [(1 + i, 6 + i) for i in range(5)] + [(1 + i, 6 + (i + 1) % 5) for i in range(5)]


def line_graph(edges: DataFrame) -> DataFrame:
    """Edges are nodes; those that share an end are joined."""
    e = undirected(edges).withColumn("e", F.xxhash64("u", "v"))
    ends = e.select("e", F.explode(F.array("u", "v")).alias("end"))
    return ends.join(ends.withColumnRenamed("e", "f"), "end").where("e < f").select(F.col("e").alias("u"), F.col("f").alias("v")).distinct()


def spin_glass(edges: DataFrame, seed: int) -> DataFrame:
    """A weight of 1 or -1 for each edge."""
    return edges.withColumn("weight", F.when(F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
