"""Structural checks of generated graphs: counts and degrees by closed forms, and a bound for random ones."""

from __future__ import annotations

from math import comb, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.operators import graphs


def expected(family: str, *p: int) -> tuple[int, int, int | None] | None:
    """Nodes, edges and the common degree (None: not regular) of a family; None for families without a closed form."""
    if family == "complete":
        return p[0], comb(p[0], 2), p[0] - 1
    if family == "bipartite":
        return p[0] + p[1], p[0] * p[1], p[0] if p[0] == p[1] else None
    if family == "turan":
        n, r = p
        sizes = [n // r + (k < n % r) for k in range(r)]
        return n, comb(n, 2) - sum(comb(s, 2) for s in sizes), n - sizes[0] if n % r == 0 else None
    if family in ("grid", "triangular_lattice", "king_graph", "frustrated_square"):
        r, c = p
        diagonals = {"grid": 0, "triangular_lattice": 1}.get(family, 2)
        return r * c, r * (c - 1) + c * (r - 1) + diagonals * (r - 1) * (c - 1), None
    if family == "cubic_lattice":
        a, b, c = p
        return a * b * c, (a - 1) * b * c + a * (b - 1) * c + a * b * (c - 1), None
    if family == "cycle":
        return p[0], p[0], 2
    if family == "path":
        return p[0], p[0] - 1, None
    if family == "star":
        return p[0], p[0] - 1, None
    if family == "wheel":
        return p[0], 2 * (p[0] - 1), 3 if p[0] == 4 else None
    if family in ("tree", "binary_tree"):
        r, d = (2, p[0]) if family == "binary_tree" else p
        n = sum(r**k for k in range(d + 1))
        return n, n - 1, None
    if family == "hypercube":
        return 1 << p[0], p[0] << (p[0] - 1), p[0]
    if family == "circulant":
        n, offsets = p[0], {min(o % p[0], -o % p[0]) for o in p[1:]} - {0}
        degree = sum(1 if 2 * o == n else 2 for o in offsets)
        return n, n * degree // 2, degree
    if family == "generalized_petersen":
        return 2 * p[0], 3 * p[0], 3
    if family == "johnson":
        n, k = p
        return comb(n, k), comb(n, k) * k * (n - k) // 2, k * (n - k)
    if family == "kneser":
        n, k = p
        return comb(n, k), comb(n, k) * comb(n - k, k) // 2, comb(n - k, k)
    if family == "sudoku":
        b = p[0]
        degree = 3 * b * b - 2 * b - 1
        return b**4, b**4 * degree // 2, degree
    if family == "barabasi_albert":
        return p[0], (p[0] - p[1]) * p[1], None
    if family == "random_tree":
        return p[0], p[0] - 1, None
    return None


def random_edges_fit(n: int, share: float, edges: int, sigmas: float = 4.0) -> bool:
    """Whether an edge count lies within so many deviations of n(n-1)/2 draws."""
    pairs = comb(n, 2)
    return abs(edges - pairs * share) <= sigmas * sqrt(pairs * share * (1 - share)) + 1e-9


def problems(edges: DataFrame, family: str, *p: int) -> list[str]:
    """What is wrong with a graph: loops, repeated edges, and counts or degrees unlike the family's."""
    found = []
    row = edges.agg(F.count("*").alias("n"), F.count_if(F.col("u") == F.col("v")).alias("loops")).head()
    once = graphs.undirected(edges)
    if row["loops"]:
        found.append("loops")
    if once.count() != row["n"] - row["loops"]:
        found.append("repeated edges")
    about = graphs.degree_properties(once.withColumn("g", F.lit(0)), ["g"]).head()
    if family == "random_er":
        if not random_edges_fit(p[0], p[1] / 100, row["n"]):
            found.append("edge count")
        return found
    if (want := expected(family, *p)) and about:
        nodes, count, degree = want
        if about["n_vertices"] != nodes:
            found.append("node count")
        if about["n_edges"] != count:
            found.append("edge count")
        if degree is not None and not (about["is_regular"] and about["max_degree"] == degree):
            found.append("degrees")
    return found
