"""Queries against DuckDB over the same Parquet tables, and operators on small frames."""

from __future__ import annotations

import glob
import json
import math
import os
import sqlite3

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialforge.functions import special
from trialforge.operators import catalog, derive, filters, graphs, pairwise, plotdata, tables, tasks
from trialforge.plans import more, registry  # noqa: F401
from trialforge.plans.roles import derived
from trialforge.sources import readers, sinks

DUCK = duckdb.connect()
for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
    DUCK.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    key = lambda df: [tuple("" if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) else (f"{v:.5g}" if isinstance(v, float) else f"{v:.0f}" if hasattr(v, "as_integer_ratio") and not isinstance(v, bool) and abs(v) > 2**31 else str(float(v)) if isinstance(v, (int,)) and not isinstance(v, bool) else str(v)) for v in row) for row in df[columns].astype(object).values.tolist()]
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y) and x.dtype != bool:
            x, y = sorted(x.dropna().astype(float)), sorted(y.dropna().astype(float))
            assert len(x) == len(y) and all(math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6) for p, q in zip(x, y)), c
        else:
            assert sorted(map(str, x)) == sorted(map(str, y)), c
    del key


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, sf, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), DUCK.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


# Goldens: identities of published statistics.


@pytest.mark.parametrize("n,w,p", [(37, 0, 2 / 2**37), (15, 0, 2 / 2**15)])
def test_exact_signed_rank(n, w, p):
    assert special.wilcoxon_exact(n, w) == pytest.approx(p, rel=1e-12)


def test_permutation_signed_rank():
    assert special.wilcoxon_permutation([1.0, 2.0, 3.0, 4.0], 0) == 0.125
    assert special.wilcoxon_permutation([1.5, 1.5, 3.0], 0) == 0.25


def test_normal_tail_without_underflow():
    assert special.wilcoxon_log10_p(65, 0, 0) == pytest.approx(math.log10(2.405e-12), abs=2e-3)
    assert -700 < special.log_normal_tail(37) < special.log_normal_tail(24.9)
    assert special.log_normal_tail(25.0001) == pytest.approx(special.log_normal_tail(24.9999), rel=1e-3)


def test_chi_square_tail():
    assert special.chi2_log10_p(10461.3044083891, 3) == pytest.approx(-2270.0326, abs=1e-3)
    assert 10 ** special.chi2_log10_p(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert special.chi2_log10_p(0, 3) == 0


@pytest.mark.parametrize("k,n,cd", [(4, 5150, 0.065358), (5, 5150, 0.085001), (7, 7, 3.405212), (7, 176, 0.679105)])
def test_nemenyi(k, n, cd):
    assert special.nemenyi_distance(k, n) == pytest.approx(cd, abs=1e-6)


def test_friedman(spark, sf):
    r = pairwise.friedman_test(derived(spark, sf))
    assert r["kendalls_w"] == pytest.approx(r["statistic"] / (r["n_problems"] * (r["n_algorithms"] - 1)))
    assert r["n_algorithms"] == 5 and r["rank_order"][0] == min(r["mean_ranks"], key=r["mean_ranks"].get)
    few = derived(spark, sf).where("algorithm in ('BUILDING', 'MACHINERY')")
    assert "error" in pairwise.friedman_test(few)


def test_significance_of_few_pairs_is_null(spark):
    rows = [("a", f"g{k}", True, float(k)) for k in range(3)] + [("b", f"g{k}", True, float(k + 1)) for k in range(3)]
    runs = spark.createDataFrame(rows, "algorithm string, graph_name string, success boolean, avg_chain_length double")
    r = pairwise.significance_tests(runs).head()
    assert r["n_pairs"] == 3 and r["p_value"] is None and r["corrected_p"] is None and not r["significant_005"]


def test_all_pairs_equal(spark):
    rows = [(a, f"g{k}", True, float(k)) for k in range(6) for a in "ab"]
    runs = spark.createDataFrame(rows, "algorithm string, graph_name string, success boolean, avg_chain_length double")
    r = pairwise.significance_tests(runs).head()
    assert r["w_statistic"] == 0 and r["p_value"] is None and r["log10_p"] == 0 and r["effect_size"] == 0 and r["effect_magnitude"] == "negligible"


# Selections and filters.


@pytest.mark.parametrize("spec,ids", [("*", {-1}), ("5", {5}), ("1-10,!5", {1, 2, 3, 4, 6, 7, 8, 9, 10}), ("1,3,7-9", {1, 3, 7, 8, 9}), ("1-6 & !4-5", {1, 2, 3, 6}), ("1–3", {1, 2, 3}), ("quick", {2, 3})])
def test_selection(spec, ids):
    assert filters.parse_selection(spec, {"quick": "2-3"}).ids() == ids


@pytest.mark.parametrize("spec", ["abc", "x-y", "1-"])
def test_bad_selection(spec):
    with pytest.raises(ValueError):
        filters.parse_selection(spec)


def test_presets():
    assert filters.read_presets(["name,selection", "quick,1-5, 7", "named_special,3"]) == {"quick": "1-5, 7", "named_special": "3"}


def test_unknown_category(spark, sf):
    with pytest.raises(ValueError, match="no graphs of category"):
        filters.graph_filter(derived(spark, sf), category="nothing")


@pytest.mark.parametrize("name,category", [("Petersen", "special"), (" K12 ", "complete"), ("random_er_4", "random_er"), ("random_n4", "random"), ("random_planar_3", "random_planar"), ("tree_r2", "tree"), ("binary_tree_3", "binary_tree"), ("ba_n6", "other"), ("er_5", "random_er")])
def test_category(spark, name, category):
    assert spark.range(1).select(derive.category_of(F.lit(name))).head()[0] == category


@pytest.mark.parametrize("name,base,rate", [("t@fr=0.05", "t", 0.05), ("t@fr=1e-05", "t", 1e-5), ("t", "t", 0.0), ("t@fr=x", "t@fr=x", 0.0)])
def test_fault_rate(spark, name, base, rate):
    assert tuple(spark.range(1).select(derive.base_topology(F.lit(name)), derive.fault_rate(F.lit(name))).head()) == (base, rate)


def test_seed(spark):
    assert spark.range(1).select(derive.seed_of(F.lit(42), F.lit("minorminer"), F.lit(1000), F.lit("chimera_4x4x4"), F.lit(0))).head()[0] == 2936429570


def test_missing_metric(spark, sf):
    with pytest.raises(ValueError):
        tables.summary_by_category(derived(spark, sf), "nothing")


def test_prefix_is_no_pattern(spark):
    one = spark.range(1)
    assert not one.select(filters.supports(["chimera_"], F.lit("chimeraX16"))).head()[0]
    assert one.select(filters.supports(["CHIMERA"], F.lit("chimera_16"))).head()[0]


def test_success_heatmap_refuses(spark, sf):
    with pytest.raises(ValueError):
        plotdata.success_heatmap(derived(spark, sf), most=3)


# Graphs.


@pytest.mark.parametrize("name,nodes,edges", [("chimera_16x16x4", 2048, 6016), ("pegasus_16", 5640, 40484), ("zephyr_12", 4800, 45864)])
def test_topology_sizes(spark, name, nodes, edges):
    e = graphs.undirected(graphs.topology(spark, name))
    assert (graphs.both_ways(e).select("u").distinct().count(), e.count()) == (nodes, edges)


def test_chimera_dimensions():
    assert graphs.chimera_dimensions(2048, 6016) == (16, 16)
    assert graphs.chimera_dimensions(7, 9) is None


@pytest.mark.parametrize("family,args,edges", [("generalized_petersen", (5, 2), 15), ("cubic_lattice", (3, 3, 3), 54), ("path", (6,), 5), ("cycle", (6,), 6), ("star", (6,), 5), ("tree", (3, 2), 12), ("triangular_lattice", (3, 3), 16), ("random_tree", (20, 1), 19)])
def test_generators(spark, family, args, edges):
    assert graphs.undirected(graphs.generate(spark, family, *args)).count() == edges


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        graphs.topology(spark, "nothing")
    with pytest.raises(ValueError):
        graphs.generate(spark, "nothing")


def test_components_and_faults(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "u long, v long")
    assert graphs.component_count(nodes, edges) == 3
    bad = spark.createDataFrame([(1,)], "node long")
    assert graphs.without_faults(nodes, edges, bad)[1].collect() == [(3, 4)]
    left, e = graphs.without_faults(nodes, edges, bad_edges=spark.createDataFrame([(3, 4)], "u long, v long"))
    assert {r[0] for r in left.collect()} == {0, 1, 2} and e.count() == 2
    with pytest.raises(ValueError):
        graphs.sample_nodes(10, 1.5, 1)
    assert graphs.sample_nodes(100, 0.1, 7) == graphs.sample_nodes(100, 0.1, 7)


def test_validation_order(spark):
    target = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long")
    nodes = spark.createDataFrame([(r, s) for r in (1, 2, 3, 4) for s in (0, 1)], "run_id int, src int")
    source = spark.createDataFrame([(r, 0, 1) for r in (1, 2, 3, 4)], "run_id int, u int, v int")
    chains = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 0), (3, 0, 2), (3, 1, 1), (4, 0, 0), (4, 1, 3)], "run_id int, src int, qubit long")
    empty = spark.createDataFrame([], "run_id int, src int")
    found = {r["run_id"]: (r["passed"], r["check"]) for r in graphs.validate(nodes, source, chains, empty, target).collect()}
    assert found == {1: (True, None), 2: (False, "coverage"), 3: (False, "connectivity"), 4: (False, "edge_preservation")}


# Sources and sinks.


def test_log_round_trip(spark, tmp_path):
    good = {"algorithm": "a", "graph_name": "g", "graph_id": 1, "topology_name": "t", "trial": 0, "seed": 5, "success": True, "is_valid": True, "status": "SUCCESS", "wall_time": 1.5, "embedding": {"0": [1, 2]}, "chain_lengths": [2, 4], "extra": 1}
    (tmp_path / "worker_1.jsonl").write_text("\n".join([json.dumps(good), "", json.dumps(good | {"wall_time": 2.5}), json.dumps(good | {"trial": 1, "status": "CRASH", "success": False, "problem_name": "p", "graph_name": None}), json.dumps(good)[:40]]))
    log = readers.read_worker_log(spark, str(tmp_path / "worker_1.jsonl"))
    assert log.count() == 3
    out = sinks.compile_batch(log, "b")
    runs = {r["trial"]: r for r in out["runs"].collect()}
    assert len(runs) == 2 and runs[0]["wall_time"] == 1.5 and runs[0]["chain_length_std"] == pytest.approx(2**0.5) and runs[1]["graph_name"] == "p"
    assert out["embeddings"].count() == 1 and out["batches"].head()["n_crash"] == 1
    assert readers.completed_keys(log).count() == 1
    sinks.write_batch(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == 2


def test_sqlite_and_csv_batches(spark, tmp_path):
    columns = "algorithm, graph_id, graph_name, topology_name, trial, success, is_valid, wall_time, avg_chain_length, max_chain_length, total_qubits_used, total_couplers_used, problem_nodes, problem_edges, problem_density, error"
    rows = [("a", 1, "K5", "t@fr=0.1", 0, 1, None, 59.0, 2.0, 3, 10, 4, 5, 10, 1.0, None), ("b", 2, "grid_3x3", "t", 0, 0, 0, 1.0, 0.0, 0, 0, 0, 9, 12, 0.3, "timeout")]
    db = sqlite3.connect(tmp_path / "results.db")
    db.execute(f"CREATE TABLE runs ({columns})")
    db.executemany(f"INSERT INTO runs VALUES ({','.join('?' * 16)})", rows)
    db.execute("CREATE TABLE batches (batch_id, config_json)")
    db.execute("INSERT INTO batches VALUES ('b', '{\"timeout\": 60.0}')")
    db.commit()
    df, config = readers.load_batch(spark, str(tmp_path))
    found = {r["algorithm"]: r for r in df.collect()}
    assert config == {"timeout": 60.0} and found["a"]["success"] is True and found["a"]["is_valid"] is None and found["a"]["is_timeout"] and found["a"]["category"] == "complete" and found["a"]["fault_rate"] == 0.1 and found["b"]["category"] == "grid"
    os.remove(tmp_path / "results.db")
    pd.DataFrame(rows, columns=columns.split(", ")).rename(columns={"graph_name": "problem_name"}).to_csv(tmp_path / "runs.csv", index=False)
    df, config = readers.load_batch(spark, str(tmp_path))
    assert config == {} and {r["algorithm"]: r["success"] for r in df.collect()} == {"a": True, "b": False}
    os.remove(tmp_path / "runs.csv")
    with pytest.raises(FileNotFoundError):
        readers.load_batch(spark, str(tmp_path))


def test_graph_files_and_manifest(spark, tmp_path):
    body = {"id": 7, "name": "K3", "category": "complete", "metadata": {"a": [1]}, "graph": {"directed": False, "nodes": [{"id": 0}], "links": [{"source": 0, "target": 1}, {"source": 1, "target": 2, "weight": 0.5}]}}
    (tmp_path / "7_K3.json").write_text(json.dumps(body))
    heads, edges = readers.read_graphs(spark, str(tmp_path / "7_K3.json"))
    assert heads.head()["name"] == "K3" and {tuple(r) for r in edges.collect()} == {(7, 0, 1, None), (7, 1, 2, 0.5)}
    text = sinks.graph_json(heads, edges).head()["value"]
    assert json.loads(text)["num_nodes"] == 3
    digest = readers.file_hashes(spark, str(tmp_path / "7_K3.json")).head()["hash"]
    entries = {"version": 1, "graphs": [{"id": 7, "name": "K3", "type": "complete", "n": 3, "e": 3, "d": 1.0, "h": digest[:16], "sz": 9, "p": {"n": "3"}, "topo": ["chimera"]}, {"id": 8, "name": "K3", "category": "complete", "nodes": 3, "edges": 3, "density": 1.0, "hash": "00", "p": {"n": "3"}}, {"id": 9, "name": "K3", "type": "complete", "n": 4, "e": 3}]}
    (tmp_path / "manifest.json").write_text(json.dumps(entries))
    m = readers.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert {r["id"]: (r["nodes"], r["type"]) for r in m.collect()} == {7: (3, "complete"), 8: (3, "complete"), 9: (4, "complete")}
    assert {(r["id"], r["canonical"], r["collision"]) for r in catalog.duplicates(m).collect()} == {(7, 7, True), (8, 7, True), (9, 9, True)}
    states = readers.verify_files(m, readers.file_hashes(spark, str(tmp_path / "7_K3.json")))
    assert {r["id"]: r["state"] for r in states.collect()} == {7: "ok", 8: "missing", 9: "missing"}


def test_exports_and_checkpoint(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.12345, None)], "name string, x double, y double")
    assert "a\\_b & 0.123 & —" in sinks.latex(df)
    path = str(tmp_path / "checkpoint.json")
    sinks.write_checkpoint(path, [{"algorithm": "a"}], 4, "now")
    assert sinks.read_checkpoint(path)["completed_count"] == 3
    sinks.delete_checkpoint(path)
    assert sinks.read_checkpoint(path) is None
    assert sinks.write_if_absent(str(tmp_path / "x.txt"), "1") and not sinks.write_if_absent(str(tmp_path / "x.txt"), "2")


def test_experiment_names():
    assert readers.resolve_experiment({"n_trials": None}, {"trials": 3, "workers": 2}, {"n_trials": 1, "timeout": 60}) == {"n_trials": 3, "n_workers": 2, "timeout": 60}


def test_stream_and_compaction(spark, tmp_path):
    from trialforge.streaming import ingest

    logs = tmp_path / "workers"
    logs.mkdir()
    row = {"algorithm": "a", "graph_name": "g", "graph_id": 1, "topology_name": "t", "trial": 0, "seed": 5, "status": "SUCCESS", "success": True, "wall_time": 1.0}
    (logs / "1.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"trial": 1}) + "\n{broken")
    for _ in range(2):
        ingest.start_compaction(ingest.read_log_stream(spark, str(logs)), str(tmp_path / "runs"), str(tmp_path / "ck"), "b").awaitTermination(120)
        (logs / "2.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"trial": 2}) + "\n")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 3
    q = ingest.progress(ingest.read_log_stream(spark, str(logs))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("progress").head()["count"] == 4


def test_solver_kernel(spark):
    from trialforge import udf

    k4 = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    target = [tuple(r) for r in graphs.chimera(spark, 2).collect()]
    udf.register("bad")(lambda s, t, timeout, seed: {"embedding": {0: [0], 1: [0], 2: [1], 3: [2]}})
    udf.register("broken")(lambda s, t, timeout, seed: 1 / 0)
    g = spark.createDataFrame([(1, "K4", 4, 6, None)], "graph_id int, graph_name string, nodes int, edges int, topologies array<string>")
    a = spark.createDataFrame([("greedy-paths", None), ("bad", None), ("broken", None)], "algorithm string, supported array<string>")
    t = spark.createDataFrame([("chimera_2", 32, 80)], "topology_name string, most_nodes int, most_edges int")
    got = {r["algorithm"]: r for r in udf.run_tasks(tasks.plan(g, a, t, 1, 42), {1: k4}, {"chimera_2": target}, 10.0).collect()}
    assert got["greedy-paths"]["status"] == "SUCCESS" and got["greedy-paths"]["total_qubits_used"] >= 6
    assert got["bad"]["status"] == "INVALID_OUTPUT" and got["broken"]["status"] == "CRASH" and got["broken"]["wall_time"] == 10.0
