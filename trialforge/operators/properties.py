"""Structural properties that need a whole graph: one graph is one group, its size bounded by the library's graphs.

Degree, triangle and clustering properties over all graphs are joins in `graphs`; here are paths,
girth, colouring, cores, cliques and the spectrum, in plain Python and numpy.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "graph_id long, n_vertices int, n_edges int, is_connected boolean, n_components int, largest_fraction double, is_bipartite boolean, avg_path double, diameter int, girth int, degeneracy int, treewidth_bound int, clique_number int, clique_bound boolean, algebraic_connectivity double, is_forest boolean"


def _levels(near: list[list[int]], start: int) -> dict[int, int]:
    seen, todo = {start: 0}, deque([start])
    while todo:
        u = todo.popleft()
        for v in near[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                todo.append(v)
    return seen


def _girth(near: list[list[int]]) -> int | None:
    """Least cycle by a search from each node; a forest has none."""
    best = None
    for s in range(len(near)):
        depth, up, todo = {s: 0}, {s: -1}, deque([s])
        while todo:
            u = todo.popleft()
            if best is not None and 2 * depth[u] >= best:
                break
            for v in near[u]:
                if v not in depth:
                    depth[v], up[v] = depth[u] + 1, u
                    todo.append(v)
                elif v != up[u]:
                    best = min(best or 1 << 30, depth[u] + depth[v] + 1)
    return best


def _degeneracy(near: list[list[int]]) -> int:
    left = {u: set(v) for u, v in enumerate(near)}
    by: dict[int, set[int]] = {}
    for u, v in left.items():
        by.setdefault(len(v), set()).add(u)
    most = 0
    while left:
        d = min(k for k, s in by.items() if s)
        u = by[d].pop()
        most = max(most, d)
        for v in left.pop(u):
            by[len(left[v])].discard(v)
            left[v].discard(u)
            by.setdefault(len(left[v]), set()).add(v)
    return most


def _treewidth_bound(near: list[list[int]]) -> int:
    """Greatest degree met while eliminating nodes of least degree."""
    left = {u: set(v) for u, v in enumerate(near)}
    width = 0
    while left:
        u = min(left, key=lambda x: (len(left[x]), x))
        around = left.pop(u)
        width = max(width, len(around))
        for v in around:
            left[v] |= around
            left[v] -= {u, v}
    return width


def _clique(near: list[list[int]], most: int = 2000) -> tuple[int, bool]:
    """Size of the largest of the first `most` maximal cliques, and whether there were more."""
    sets, best, count = [set(x) for x in near], 0, 0
    todo = [(0, set(range(len(near))), set())]
    while todo:
        size, p, x = todo.pop()
        if not p and not x:
            best, count = max(best, size), count + 1
            if count >= most:
                return best, True
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda u: len(sets[u] & p))
        p, x = set(p), set(x)
        for v in list(p - sets[pivot]):
            todo.append((size + 1, p & sets[v], x & sets[v]))
            p.discard(v)
            x.add(v)
    return best, False


def describe(graph_id: int, edges: list[tuple[int, int]]) -> tuple:
    names = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(names)}
    pairs = {(min(at[u], at[v]), max(at[u], at[v])) for u, v in edges if u != v}
    n = len(names)
    near: list[list[int]] = [[] for _ in range(n)]
    for u, v in sorted(pairs):
        near[u].append(v)
        near[v].append(u)
    left, sizes, bipartite = set(range(n)), [], True
    while left:
        levels = _levels(near, min(left))
        sizes.append(len(levels))
        left -= set(levels)
        bipartite &= all((levels[u] + levels[v]) % 2 for u in levels for v in near[u])
    connected = len(sizes) == 1
    reach = [_levels(near, u) for u in range(n)] if connected and n > 1 else []
    total = sum(sum(r.values()) for r in reach)
    clique, more = _clique(near)
    spectrum = None
    if n > 1:
        laplacian = np.diag([float(len(x)) for x in near])
        for u, v in pairs:
            laplacian[u, v] = laplacian[v, u] = -1.0
        spectrum = float(max(0.0, np.linalg.eigvalsh(laplacian)[1])) if connected else 0.0
    return (graph_id, n, len(pairs), connected, len(sizes), max(sizes, default=0) / n if n else 0.0, bipartite, total / (n * (n - 1)) if reach else None, max((max(r.values()) for r in reach), default=None), _girth(near), _degeneracy(near), _treewidth_bound(near), clique, more, spectrum, len(pairs) == n - len(sizes))


def properties(edges: DataFrame) -> DataFrame:
    """One row for each graph of (graph_id, u, v)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        row = describe(int(frame["graph_id"].iloc[0]), list(zip(frame["u"].tolist(), frame["v"].tolist())))
        return pd.DataFrame([row], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return edges.select("graph_id", "u", "v").groupBy("graph_id").applyInPandas(one, SCHEMA)
