"""Further problem graphs: periodic lattices, lattices counted in cells, regular, planar and application graphs, sweeps.

Edges are (u, v), the smaller end first, each once. Families of many nodes are declared over
`spark.range`; those that are built step by step (`regular`, `random_planar`) hold one graph on
the driver, whose size the caller's parameters bound.
"""

from __future__ import annotations

import itertools
import random
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialforge.operators import graphs

EDGES = "u long, v long"

# Largest scale of each hardware family, least first.
HARDWARE_SCALES = {"chimera": (1, 16), "pegasus": (2, 16), "zephyr": (1, 12)}
# Qubits of a unit cell and least scale, by which a planted graph's hardware is sized.
PLANTED_CELLS = {"chimera": (8, 1), "pegasus": (24, 2), "zephyr": (48, 2)}
# Problems whose instances are random graphs of density one half.
NP_PROBLEMS = ("graph_coloring_k3", "graph_coloring_k4", "max_clique", "max_cut", "mis", "vertex_cover")
# Edges of small named graphs.
SMALL = {
    "bull": ((0, 1), (0, 2), (1, 2), (1, 3), (2, 4)),
    "butterfly": ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (3, 4)),
    "house": ((0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 4)),
    "chvatal": ((0, 1), (0, 4), (0, 6), (0, 9), (1, 2), (1, 5), (1, 7), (2, 3), (2, 6), (2, 8), (3, 4), (3, 7), (3, 9), (4, 5), (4, 8), (5, 10), (5, 11), (6, 10), (6, 11), (7, 8), (7, 11), (8, 10), (9, 10), (9, 11)),
}
# Further cubic graphs by LCF code.
LCF = {"wagner": (8, (4,)), "mcgee": (24, (12, 7, -7)), "franklin": (12, (5, -5))}


def named(spark: SparkSession, name: str) -> DataFrame:
    """A named graph, from here or from `graphs.named`."""
    if name in SMALL:
        return spark.createDataFrame(list(SMALL[name]), EDGES)
    if name in LCF:
        return graphs._lcf(spark, *LCF[name])
    return graphs.named(spark, name)


def _steps(*moves: tuple[int, ...]) -> Column:
    """One row for each move, as a struct of its parts s0, s1, ..."""
    return F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"s{k}") for k, x in enumerate(m)]) for m in moves]))


def periodic(spark: SparkSession, family: str, *sides: int) -> DataFrame:
    """A lattice whose opposite borders meet: cycle of sides (grid), king_graph, frustrated_square, shastry_sutherland, cubic_lattice."""
    if min(sides) < 1:
        raise ValueError("sides are at least 1")
    if family == "cubic_lattice":
        a, b, c = sides
        at = spark.range(a * b * c).select(F.col("id").alias("u"), F.floor(F.col("id") / (b * c)).alias("x"), (F.floor(F.col("id") / c) % b).alias("y"), (F.col("id") % c).alias("z"))
        moved = at.withColumn("s", _steps((1, 0, 0), (0, 1, 0), (0, 0, 1)))
        v = (F.pmod(F.col("x") + F.col("s.s0"), F.lit(a)) * b + F.pmod(F.col("y") + F.col("s.s1"), F.lit(b))) * c + F.pmod(F.col("z") + F.col("s.s2"), F.lit(c))
        return graphs.undirected(moved.select("u", v.cast("long").alias("v")))
    rows, columns = sides
    at = spark.range(rows * columns).select(F.col("id").alias("u"), F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    if family == "grid":
        moved = at.withColumn("s", _steps((0, 1), (1, 0)))
    elif family in ("king_graph", "frustrated_square"):
        moved = at.withColumn("s", _steps((0, 1), (1, 0), (1, 1), (1, -1)))
    elif family == "shastry_sutherland":
        moved = at.withColumn("s", _steps((0, 1), (1, 0), (-1, 1))).where((F.col("s.s0") >= 0) | ((F.col("r") + F.col("c")) % 2 == 0))
    else:
        raise ValueError(f"no periodic form: {family}")
    v = F.pmod(F.col("r") + F.col("s.s0"), F.lit(rows)) * columns + F.pmod(F.col("c") + F.col("s.s1"), F.lit(columns))
    return graphs.undirected(moved.select("u", v.cast("long").alias("v")))


def honeycomb_cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    """m rows and n columns of hexagons: 2 (m + 1)(n + 1) - 2 nodes, numbered by column."""
    tall = 2 * m + 2
    at = spark.range(tall * (n + 1)).select(F.col("id").alias("u"), F.floor(F.col("id") / tall).alias("i"), (F.col("id") % tall).alias("j"))
    up = at.where(F.col("j") < tall - 1).select("u", (F.col("u") + 1).alias("v"))
    across = at.where((F.col("i") < n) & (F.col("i") % 2 == F.col("j") % 2)).select("u", (F.col("u") + tall).alias("v"))
    lone = (tall - 1, n * tall + (tall - 1) * (n % 2))
    kept = up.unionByName(across).where(~F.col("u").isin(*lone) & ~F.col("v").isin(*lone))
    number = lambda x: x - (x > lone[0]).cast("long") - (x > lone[1]).cast("long")
    return kept.select(number(F.col("u")).alias("u"), number(F.col("v")).alias("v"))


def kagome_cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    """Line graph of m by n hexagons."""
    return graphs.line_graph(honeycomb_cells(spark, m, n))


def triangular_cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    """m rows of n triangles; rows lean to alternate sides, and an odd n ends every second row of nodes one earlier."""
    wide = (n + 1) // 2 + 1
    at = spark.range(wide * (m + 1)).select((F.col("id") % wide).alias("i"), F.floor(F.col("id") / wide).alias("j"))
    even = F.col("j") % 2 == 0
    ends = at.withColumn("s", _steps((1, 0), (0, 1), (1, 1), (-1, 1))).select("i", "j", (F.col("i") + F.col("s.s0")).alias("x"), (F.col("j") + F.col("s.s1")).alias("y"), (F.col("s.s0") * F.col("s.s1")).alias("lean"))
    inside = ends.where(F.col("x").between(0, wide - 1) & (F.col("y") <= m) & ((F.col("lean") == 0) | ((F.col("lean") == 1) & ~even) | ((F.col("lean") == -1) & even)))
    present = lambda x, y: (x < wide - 1) | (y % 2 == 0) | F.lit(n % 2 == 0)
    number = lambda x, y: (y * wide + x - (F.floor(y / 2) if n % 2 else F.lit(0))).cast("long")
    kept = inside.where(present(F.col("i"), F.col("j")) & present(F.col("x"), F.col("y")))
    return graphs.undirected(kept.select(number(F.col("i"), F.col("j")).alias("u"), number(F.col("x"), F.col("y")).alias("v")))


def regular(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """A random d-regular graph: a circulant one after ten exchanges of ends for each edge."""
    if n * d % 2 or not 0 <= d < n:
        raise ValueError("n d must be even and d below n")
    edges = [(i, (i + k) % n) for k in range(1, d // 2 + 1) for i in range(n)]
    edges += [(i, i + n // 2) for i in range(n // 2)] if d % 2 else []
    present, rng = {frozenset(e) for e in edges}, random.Random(seed)
    for _ in range(10 * len(edges)):
        i, j = rng.randrange(len(edges)), rng.randrange(len(edges))
        (a, b), (c, e) = edges[i], edges[j]
        if rng.random() < 0.5:
            c, e = e, c
        new = frozenset((a, e)), frozenset((c, b))
        if i != j and min(map(len, new)) == 2 and new[0] != new[1] and not present & set(new):
            present -= {frozenset((a, b)), frozenset((c, e))}
            present |= set(new)
            edges[i], edges[j] = (a, e), (c, b)
    return spark.createDataFrame(sorted((min(e), max(e)) for e in edges), EDGES)


def random_planar(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A random planar graph that no further edge leaves planar (3 n - 6 edges): each new node is put into a random triangle."""
    rng = random.Random(seed)
    label = list(range(n))
    rng.shuffle(label)
    if n < 3:
        rows = [(i, j) for i in range(n) for j in range(i + 1, n)]
    else:
        rows, faces = [(0, 1), (0, 2), (1, 2)], [(0, 1, 2), (0, 1, 2)]
        for new in range(3, n):
            at = rng.randrange(len(faces))
            a, b, c = faces[at]
            faces[at] = (a, b, new)
            faces += [(a, c, new), (b, c, new)]
            rows += [(a, new), (b, new), (c, new)]
    return graphs.undirected(spark.createDataFrame([(label[a], label[b]) for a, b in rows], EDGES))


def power_grid(spark: SparkSession, n: int, kind: str = "radial", seed: int = 0) -> DataFrame:
    """A random tree (radial), or one with up to n / 5 further links (meshed)."""
    if kind not in ("radial", "meshed"):
        raise ValueError("kind is radial or meshed")
    tree = graphs.generate(spark, "random_tree", n, seed)
    if kind == "radial":
        return tree
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    return graphs.undirected(tree.unionByName(spark.range(max(1, n // 5)).select(draw(1).alias("u"), draw(2).alias("v"))))


def hardware_native(spark: SparkSession, family: str, k: int) -> DataFrame:
    """The whole hardware graph at scale k, within the scales that exist."""
    if family not in HARDWARE_SCALES:
        raise ValueError(f"no such hardware family: {family}")
    least, most = HARDWARE_SCALES[family]
    if not least <= k <= most:
        raise ValueError(f"{family} has scales {least} to {most}")
    return graphs.undirected(graphs.FAMILIES[family](spark, k))


def planted_solution(spark: SparkSession, n: int, family: str = "chimera", seed: int = 0) -> DataFrame:
    """Links among n random qubits of a hardware graph, numbered anew; the identity embeds it."""
    if family not in PLANTED_CELLS:
        raise ValueError(f"no such hardware family: {family}")
    cell, least = PLANTED_CELLS[family]
    hardware = graphs.undirected(graphs.FAMILIES[family](spark, max(least, int((n / cell) ** 0.5) + 2)))
    nodes = graphs.both_ways(hardware).select(F.col("u").alias("node")).distinct()
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n)
    number = chosen.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("long").alias("number"))  # n rows
    for end in ("u", "v"):
        hardware = hardware.join(number.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("number", end)
    return graphs.undirected(hardware)


def np_problem(spark: SparkSession, problem: str, n: int, seed: int = 0) -> DataFrame:
    """A random graph of density one half, for one of the known problems."""
    if problem not in NP_PROBLEMS:
        raise ValueError(f"no such problem: {problem}")
    return graphs.generate(spark, "random_er", n, 50, seed)


def portfolio(spark: SparkSession, n: int, covariance: str = "random", seed: int = 0) -> DataFrame:
    """Assets with covariance: all pairs (random), pairs in about sqrt(n) blocks, or three pairs of ten (sparse)."""
    if covariance == "random":
        return graphs.generate(spark, "complete", n)
    if covariance == "sparse":
        return graphs.generate(spark, "random_er", n, 30, seed)
    if covariance != "block":
        raise ValueError("covariance is random, block or sparse")
    size, larger = divmod(n, max(2, round(n**0.5)))
    block = lambda x: F.floor(x / (size + 1)) if not size else F.when(x < larger * (size + 1), F.floor(x / (size + 1))).otherwise(larger + F.floor((x - larger * (size + 1)) / size))
    return graphs._pairs(spark, n, block(F.col("u")) == block(F.col("v")))


#: Generators of this module by family, each called with (spark, *parameters).
GENERATORS = {
    "hardware_native": hardware_native, "honeycomb_cells": honeycomb_cells, "kagome_cells": kagome_cells, "np_problem": np_problem, "planted_solution": planted_solution,
    "portfolio_qubo": portfolio, "power_grid": power_grid, "random_planar": random_planar, "regular": regular, "triangular_cells": triangular_cells,
}


def make(spark: SparkSession, family: str, *parameters: Any) -> DataFrame:
    """Edges of a family of this module or of `graphs.generate`."""
    return GENERATORS[family](spark, *parameters) if family in GENERATORS else graphs.generate(spark, family, *parameters)


def sweep(spark: SparkSession, family: str, first_id: int, last_id: int, **lists: list[Any]) -> DataFrame:
    """One row for each choice from the lists, in their order: graph_id (in sequence), family, name, parameters.

    More choices than ids are an error, as nothing may be left out or overlap the next range.
    """
    choices = list(itertools.product(*lists.values()))
    if len(choices) > last_id - first_id + 1:
        raise ValueError(f"{len(choices)} graphs for {last_id - first_id + 1} ids")
    rows = [(first_id + k, family, "_".join([family, *[f"{key}{x}" for key, x in zip(lists, c)]]), {key: str(x) for key, x in zip(lists, c)}) for k, c in enumerate(choices)]
    return spark.createDataFrame(rows, "graph_id long, family string, name string, parameters map<string,string>")
