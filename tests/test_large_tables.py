"""Operators whose work used to grow with pairs: the same results from places, stages and earlier checks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from trialforge.operators import graphs, selections, vertex
from trialforge.sources import shared


def test_spans_are_disjoint_and_counts_need_no_pairs(spark):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(5000), 1500))
    there = set(rng.sample(ids, 700)) | {9999}
    specs, want = {}, {}
    for k in range(40):
        parts = [(rng.random() < 0.3, low, low + rng.choice([0, 3, 700, 2500])) for low in rng.choices(range(5000), k=rng.randint(1, 9))]
        specs[k] = ", ".join(f"{'!' * out}{low}-{high}" for out, low, high in parts)
        want[k] = [i for i in ids if any(a <= i <= b for out, a, b in parts if not out) and not any(a <= i <= b for out, a, b in parts if out)]
    named = spark.createDataFrame(list(specs.items()), "selection_id long, spec string")
    presets = spark.createDataFrame([("none", "1")], "name string, selection string")
    table, installed = (spark.createDataFrame([(i,) for i in v], "id long") for v in (ids * 2, sorted(there)))
    chosen = selections.selected(named, table, presets)
    assert sorted(map(tuple, chosen.collect())) == sorted((k, i) for k, v in want.items() for i in v)
    # pairs leave by the last step and are not aggregated
    plan = chosen._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate explode(slice" in plan and "Aggregate" not in plan.split("Generate explode(slice")[0]
    counts = {tuple(r) for r in selections.counted(named, table, installed, presets).collect()}
    assert counts == {(k, len(v), n := len(there.intersection(v)), len(v) - n) for k, v in want.items() if v}


def test_runs_are_few_rows_of_a_shuffle(spark):
    """Pairs shuffle neither as rows nor as a row for every few hundred ids."""
    named = spark.createDataFrame([(k, "*") for k in range(300)], "selection_id long, spec string")
    presets = spark.createDataFrame([("none", "1")], "name string, selection string")
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in iterate(spark.sparkContext._jsc.sc().statusStore())}

    def iterate(store):
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = selections.selected(named, spark.range(100_000), presets)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = set(stages())
        assert chosen.count() == 30_000_000
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert 0 < sum(n for k, n in stages().items() if k not in before) < 100 * 300


def test_source_edges_are_sought_in_stages(spark, monkeypatch):
    rng = random.Random(3)
    chains = {(r, s): rng.sample(range(3000), 200) for r in range(6) for s in range(4)}
    target = {(rng.randrange(3000), rng.randrange(3000)) for _ in range(10)} - {(k, k) for k in range(3000)}
    target |= set(list(zip(chains[0, 0], chains[0, 1]))[:100])  # many couplers: told at an early stage
    source = [(r, s, s + 1) for r in range(6) for s in range(3)]
    want = [(r, u, v) for r, u, v in source if not any((a, b) in target or (b, a) in target for a in chains[r, u] for b in chains[r, v])]
    written, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, name: written.append((name, out := cut(df, name))) or out)
    rows = spark.createDataFrame([(r, s, q) for (r, s), qs in chains.items() for q in qs], "run_id int, src int, qubit long")
    found = graphs.unpreserved(spark.createDataFrame(source, "run_id int, u int, v int"), rows, spark.createDataFrame(sorted(target), "u long, v long"))
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < len(source) - 2
    stages = [df.count() for name, df in written if name == "source-edges"]
    assert len(stages) > 1 and stages[0] == len(source) > stages[-1] >= len(want)


def test_chains_in_two_components_are_not_followed(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("edges of chains were made")

    monkeypatch.setattr(graphs, "inner_edges", fail)
    target = spark.createDataFrame([(0, 1), (1, 2), (10, 11)], "u long, v long")
    nodes = spark.createDataFrame([(r, s) for r in (1, 2, 3) for s in (0, 1)], "run_id int, src int")
    source = spark.createDataFrame([(r, 0, 1) for r in (1, 2, 3)], "run_id int, u int, v int")
    chains = spark.createDataFrame([(1, 0, 0), (1, 0, 10), (1, 1, 1), (2, 0, 0), (3, 0, 0), (3, 0, 99), (3, 1, 1)], "run_id int, src int, qubit long")
    found = {r["run_id"]: (r["passed"], r["check"]) for r in graphs.validate(nodes, source, chains, spark.createDataFrame([], "run_id int, src int"), target).collect()}
    assert found == {1: (False, "connectivity"), 2: (False, "coverage"), 3: (False, "connectivity")}


def test_small_graphs_are_searched_in_one_round(spark, monkeypatch):
    """The same rows from graphs held as rows, from rounds, and from both; small ones take no table for each level."""
    rng = random.Random(11)
    made = {1: [(i, i + 1) for i in range(5)], 2: [(0, 1)], 3: [(a, b) for a in range(5) for b in range(a)], 4: [(a, b) for a in range(3) for b in range(3, 6)]}
    made |= {g: list({tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randint(3, 25))}) for g in range(5, 15)}
    edges = spark.createDataFrame([(g, min(e), max(e)) for g, es in made.items() for e in es], "g long, u long, v long").repartition(3)
    written, found = [], []
    real = vertex.cut
    monkeypatch.setattr(vertex, "cut", lambda df, name: written.append(name) or real(df, name))
    for small, word in ((512, 4), (9, 7)):
        monkeypatch.setattr(vertex, "SMALL", small)
        monkeypatch.setattr(vertex, "WORD", word)
        written.clear()
        found.append(sorted(map(tuple, vertex.graph_properties(edges).collect())))
        assert ("reached" in written) == (small < 512) and len(written) < 6 or small < 512
    assert len(found[0]) == len(made) and all([repr(r) for r in f] == [repr(r) for r in found[0]] for f in found[1:])


def test_factors_at_any_other_place_come_from_neighbours(monkeypatch):
    """op4 judges strings without a search for smaller places; the factors are those that two searches gave."""
    substring = pytest.importorskip("trialforge.llm.substring")
    rng = np.random.default_rng(5)
    for n in (1, 2, 60, 500):
        places, lcp = rng.permutation(n), rng.integers(0, 9, n) * (np.arange(n) > 0)
        both = np.maximum(substring.previous_factors(places, lcp), substring.previous_factors(-places, lcp))
        assert (substring.other_factors(lcp) == both).all()
    sizes = np.array([70, 40, 50], "<u4")
    text = rng.integers(97, 100, 160).astype(np.uint8)
    text[70:110], text[20:60] = text[5:45], text[115:155]
    blob = np.uint32(3).tobytes() + sizes.tobytes() + np.arange(3).astype("<i8").tobytes() + bytes(2 * 12) + bytes(3) + text.tobytes()
    strings = [bytes(text[b + k : b + k + 30]) for b, s in zip((0, 70, 110), sizes.tolist()) for k in range(s - 29)]
    monkeypatch.setattr(substring, "nearest_smaller", None)
    (row,) = substring._decide_bytes(30, False)(substring._blobs([(0, 0, blob)])).to_pylist()
    assert np.unpackbits(np.frombuffer(row["blob"], np.uint8), count=len(strings)).tolist() == [int(strings.count(s) > 1) for s in strings]


def test_components_need_no_pairs_of_parts(spark, tmp_path, monkeypatch):
    """An order of 200 parts writes 199 edges; parts of orders without a priority are alone, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    entry = pytest.importorskip("__spark_entry__")
    rows = [(1, p, 1, k) for k, p in enumerate(range(900, 700, -1))] + [(2, 700, 1, 1), (2, 5, 1, 2), (3, 701, 1, 1), (3, 700, 1, 2), (4, 8, 1, 1), (4, 8, 1, 2), (5, 6, 1, 1), (5, 7, 1, 2), (5, None, 1, 3), (6, 3, 1, 1), (6, 2, 1, 2), (7, 1, 1, 1), (7, 2, 1, 2)]
    orders = [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, None), (6, "b"), (6, "a"), (7, "b"), (9, "a")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    written, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, name: written.append(out := cut(df, name)) or out)
    found = [tuple(r) for r in entry.queries()["components"](spark, str(tmp_path)).collect()]
    tables = "; ".join(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'" for t in ("lineitem", "orders"))
    base = duckdb.connect()
    base.execute(tables)
    want = base.execute(entry.oracle_sql()["components"]).fetchall()
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(want) == 209
    assert max(df.count() for df in written) < 2 * len(rows)


def test_rounds_of_components_halve_the_nodes(spark, monkeypatch):
    """Paths in order, zigzags and random graphs: least labels, in few rounds, also of nodes without edges."""
    rng = random.Random(7)
    names = rng.sample(range(5000), 400)
    made = {1: [(i, i + 1) for i in range(300)], 2: list(zip(names, names[1:])), 3: [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], 4: [(9, k) for k in range(9)] + [(4, 4)]}
    want = {}
    for g, es in made.items():
        label = {x: x for e in es for x in e}
        while any(label[a] != label[b] for a, b in es):
            for a, b in es:
                label[a] = label[b] = min(label[a], label[b])
        want |= {(g, n): x for n, x in label.items()}
    edges = spark.createDataFrame([(g, u, v) for g, es in made.items() for u, v in es], "g long, u long, v long")
    nodes = spark.createDataFrame([*want, (4, 77), (None, 3)], "g long, node long")
    written, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, name: written.append(name) or cut(df, name))
    found = {(r["g"], r["node"]): r["label"] for r in graphs.min_labels(nodes, edges, ["g"]).collect()}
    assert found == want | {(4, 77): 77, (None, 3): 3}
    assert written.count("edges") <= 11
    ends = {(r["g"], r["node"]): r["label"] for r in graphs.min_labels(None, edges, ["g"]).collect()}
    assert ends == {k: x for k, x in want.items() if any(k[1] in e and e[0] != e[1] for e in made[k[0]])}
