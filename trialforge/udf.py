"""Algorithms as grouped functions: a registry, and the kernel that runs a task and infers its status."""

from __future__ import annotations

import importlib.util
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: source edges, target edges, timeout, seed -> {"embedding": {node: [qubits]}} or {}, with optional counters
Solver = Callable[[list[tuple[int, int]], list[tuple[int, int]], float, int], dict[str, Any]]


@dataclass
class Algorithm:
    name: str
    solve: Solver
    version: str = "1"
    supported: list[str] | None = None
    requires: list[str] = field(default_factory=list)

    def available(self) -> bool:
        return all(importlib.util.find_spec(m) is not None for m in self.requires)


ALGORITHMS: dict[str, Algorithm] = {}


def register(name: str, **about: Any) -> Callable[[Solver], Solver]:
    def add(f: Solver) -> Solver:
        ALGORITHMS[name] = Algorithm(name, f, **about)
        return f

    return add


def load_user_algorithms(folder: str) -> list[str]:
    """Import each module of a folder; one that fails is skipped with a warning."""
    loaded = []
    for path in sorted(Path(folder).glob("*.py")):
        try:
            spec = importlib.util.spec_from_file_location(f"user_{path.stem}", path)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
            loaded.append(path.stem)
        except Exception as e:
            warnings.warn(f"{path.name} is skipped: {e}", stacklevel=2)
    return loaded


def check_embedding(source: list[tuple[int, int]], target: list[tuple[int, int]], chains: dict[int, list[int]]) -> str | None:
    """The first check that fails, or None."""
    nodes = {n for e in source for n in e}
    if not nodes <= set(chains):
        return "coverage"
    if any(not c for c in chains.values()):
        return "non_empty_chains"
    near: dict[int, set[int]] = {}
    for u, v in target:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for chain in chains.values():
        left, seen = set(chain), [chain[0]]
        left.discard(chain[0])
        while seen:
            for q in near.get(seen.pop(), set()) & left:
                left.discard(q)
                seen.append(q)
        if left:
            return "connectivity"
    flat = [q for c in chains.values() for q in c]
    if len(flat) != len(set(flat)):
        return "disjointness"
    if any(not any(near.get(a, set()) & set(chains[v]) for a in chains[u]) for u, v in source):
        return "edge_preservation"
    return None


RESULT = "algorithm string, graph_id int, topology_name string, trial int, seed long, status string, success boolean, is_valid boolean, wall_time double, cpu_time double, avg_chain_length double, max_chain_length int, total_qubits_used int, total_couplers_used int, error string"


def run_task(algorithm: Algorithm, source: list[tuple[int, int]], target: list[tuple[int, int]], timeout: float, seed: int) -> dict[str, Any]:
    """Success is never the solver's word: the embedding is checked. A crash counts as a whole timeout."""
    none = {"success": False, "is_valid": False, "avg_chain_length": 0.0, "max_chain_length": 0, "total_qubits_used": 0, "total_couplers_used": 0, "error": None}
    wall, cpu = time.perf_counter(), time.process_time()
    try:
        found = algorithm.solve(source, target, timeout, seed)
    except Exception as e:
        return none | {"status": "CRASH", "wall_time": timeout, "cpu_time": time.process_time() - cpu, "error": str(e)}
    times = {"wall_time": time.perf_counter() - wall, "cpu_time": time.process_time() - cpu}
    chains = {int(k): [int(q) for q in c] for k, c in (found.get("embedding") or {}).items()}
    if not chains:
        return none | times | {"status": "TIMEOUT" if times["wall_time"] >= timeout else "FAILURE"}
    if problem := check_embedding(source, target, chains):
        return none | times | {"status": "INVALID_OUTPUT", "error": f"Layer 1 [{problem}]"}
    sizes = [len(c) for c in chains.values()]
    owner = {q: n for n, c in chains.items() for q in c}
    couplers = sum(1 for u, v in target if owner.get(u, -1) == owner.get(v, -2))
    return times | {"status": "SUCCESS", "success": True, "is_valid": True, "avg_chain_length": sum(sizes) / len(sizes), "max_chain_length": max(sizes), "total_qubits_used": sum(sizes), "total_couplers_used": couplers, "error": None}


def run_tasks(tasks: DataFrame, graphs: dict[int, list[tuple[int, int]]], topologies: dict[str, list[tuple[int, int]]], timeout: float = 60.0) -> DataFrame:
    """Result rows of planned tasks; each task is a slot's work, and its graphs are small by the library's bounds."""
    algorithms = dict(ALGORITHMS)

    def run(frames):
        for frame in frames:
            rows = [{"algorithm": t.algorithm, "graph_id": t.graph_id, "topology_name": t.topology_name, "trial": t.trial, "seed": t.seed} | run_task(algorithms[t.algorithm], graphs[t.graph_id], topologies[t.topology_name], timeout, t.seed) for t in frame.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return tasks.mapInPandas(run, RESULT)


@register("greedy-paths", version="1")
def greedy_paths(source, target, timeout, seed):
    """Place nodes by degree on free qubits, and lengthen chains by shortest free paths."""
    import random
    from collections import deque

    rng, deadline = random.Random(seed), time.perf_counter() + timeout
    near: dict[int, set[int]] = {}
    for u, v in target:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    links: dict[int, set[int]] = {}
    for u, v in source:
        links.setdefault(u, set()).add(v)
        links.setdefault(v, set()).add(u)
    for _ in range(50):
        chains: dict[int, set[int]] = {}
        used: set[int] = set()
        order = sorted(links, key=lambda n: (-len(links[n]), rng.random()))
        ok = True
        for n in order:
            if time.perf_counter() > deadline:
                return {}
            placed = [m for m in links[n] if m in chains]
            free = [q for q in near if q not in used]
            if not free:
                ok = False
                break
            if placed:
                around = [q for m in placed for p in chains[m] for q in near[p] if q not in used]
                start = rng.choice(around) if around else None
            else:
                start = rng.choice(free)
            if start is None:
                ok = False
                break
            chain = {start}
            for m in placed:
                if any(near[q] & chains[m] for q in chain):
                    continue
                back, todo, end = dict.fromkeys(chain), deque(chain), None
                while todo and end is None:
                    q = todo.popleft()
                    for r in near[q]:
                        if r not in back and r not in used:
                            back[r] = q
                            if near[r] & chains[m]:
                                end = r
                                break
                            todo.append(r)
                if end is None:
                    ok = False
                    break
                while end is not None and end not in chain:
                    chain.add(end)
                    end = back[end]
            if not ok:
                break
            chains[n] = chain
            used |= chain
        if ok:
            return {"embedding": {n: sorted(c) for n, c in chains.items()}}
    return {}
