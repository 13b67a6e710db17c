"""Edges of a hardware topology as a table function of its name, for LATERAL joins from rows that name their topology."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

NAME = re.compile(r"(chimera)_(\d+)x(\d+)x(\d+)|(pegasus|zephyr)_(\d+)")
#: Where the tracks of a Pegasus tile are shifted, by track.
SHIFTS = ((2, 10, 6), (6, 2, 10))


def chimera_edges(m: int, n: int, t: int) -> Iterator[tuple[int, int]]:
    at = lambda i, j, side, k: ((i * n + j) * 2 + side) * t + k
    for i in range(m):
        for j in range(n):
            yield from ((at(i, j, 0, a), at(i, j, 1, b)) for a in range(t) for b in range(t))
            for k in range(t):
                if i + 1 < m:
                    yield at(i, j, 0, k), at(i + 1, j, 0, k)
                if j + 1 < n:
                    yield at(i, j, 1, k), at(i, j + 1, 1, k)


def pegasus_edges(m: int) -> Iterator[tuple[int, int]]:
    """Qubits are segments of 12 places across the other orientation's tracks; those without a crossing are left out."""
    at = lambda u, w, k, z: ((u * m + w) * 12 + k) * (m - 1) + z
    crossing: dict[int, list[int]] = {}
    for w in range(m):
        for k in range(12):
            for z in range(m - 1):
                x, low = w * 12 + k, z * 12 + SHIFTS[0][k // 4]
                for y in range(low, low + 12):
                    for z2 in range(m - 1):
                        left = z2 * 12 + SHIFTS[1][y % 12 // 4]
                        if y < 12 * m and left <= x < left + 12:
                            crossing.setdefault(at(0, w, k, z), []).append(at(1, y // 12, y % 12, z2))
    for a, others in crossing.items():
        yield from ((a, b) for b in others)
    kept = {*crossing, *(b for others in crossing.values() for b in others)}
    for u in (0, 1):
        for w in range(m):
            for k in range(12):
                for z in range(m - 1):
                    a = at(u, w, k, z)
                    for b in ([at(u, w, k, z + 1)] if z + 2 < m else []) + ([at(u, w, k + 1, z)] if k % 2 == 0 else []):
                        if a in kept and b in kept:
                            yield a, b


def zephyr_edges(m: int, t: int = 4) -> Iterator[tuple[int, int]]:
    width = 2 * m + 1
    at = lambda u, w, k, j, z: (((u * width + w) * t + k) * 2 + j) * m + z
    for w in range(width):
        for k in range(t):
            for j in (0, 1):
                for z in range(m):
                    for c in (2 * z + j, 2 * z + j + 1):
                        for k2 in range(t):
                            for j2, z2 in ((j2, z2) for j2 in (0, 1) for z2 in range(m) if w in (2 * z2 + j2, 2 * z2 + j2 + 1)):
                                yield at(0, w, k, j, z), at(1, c, k2, j2, z2)
                    for u in (0, 1):
                        a = at(u, w, k, j, z)
                        if z + 1 < m:
                            yield a, at(u, w, k, j, z + 1)
                        if j == 0:
                            yield a, at(u, w, k, 1, z)
                            if z > 0:
                                yield a, at(u, w, k, 1, z - 1)


@udtf(returnType="u: bigint, v: bigint")
class TopologyEdges:
    """Each edge once; none for a name that is no topology's."""

    def eval(self, name: str) -> Iterator[tuple[int, int]]:
        m = NAME.fullmatch(name or "")
        if m and m[1]:
            yield from chimera_edges(int(m[2]), int(m[3]), int(m[4]))
        elif m:
            yield from (pegasus_edges if m[5] == "pegasus" else zephyr_edges)(int(m[6]))


def register(spark: SparkSession) -> None:
    """Make `topology_edges(name)` known to the session's SQL."""
    spark.udtf.register("topology_edges", TopologyEdges)
