"""Exact tests by recursion, streams, vertex programs, raw records, selections, topologies and write-back."""

from __future__ import annotations

import itertools
import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trialforge.functions import special, tails
from trialforge.operators import graphs, properties, records, selections, tasks, topology_table, vertex
from trialforge.sources.versioned import VersionedTable
from trialforge.streaming import patience
from trialforge.streaming.live import GrowingLog, KeyedSink, drain, follow, fresh_path

# Exact p values.


def test_exact_tails(spark):
    """Against all choices of signs one by one, the closed recursion, and published values."""
    rng = random.Random(2)
    rows = [("n", str(n), [2 * k for k in range(1, n + 1)], float(w)) for n, w in ((1, 0), (5, 3), (13, 20), (37, 0), (50, 400))]
    ranked = {}
    for k in range(6):
        steps = sorted(rng.choice([2, 3, 3, 6, 9, 12]) for _ in range(rng.randint(1, 10)))
        w = rng.randint(0, sum(steps) // 2) / 2
        ranked[str(k)] = (steps, w)
        rows.append(("r", str(k), steps, w))
    got = {(r[0], r[1]): r["tail"] for r in tails.signed_rank_tails(spark.createDataFrame(rows, "a string, b string, steps array<long>, w double"), ["a", "b"]).collect()}
    for a, b, steps, w in rows:
        if a == "n":
            assert got[a, b] == pytest.approx(special.wilcoxon_exact(int(b), w), rel=1e-12)
        else:
            total = [sum(s for s, on in zip(steps, signs) if on) for signs in itertools.product((0, 1), repeat=len(steps))]
            assert got[a, b] == pytest.approx(min(1.0, 2 * sum(t <= 2 * w for t in total) / len(total)), rel=1e-12)
    assert got["n", "37"] == 1.4551915228366852e-11


def test_normal_tails(spark):
    xs = [0.0, 1e-12, 0.3, 1.7, 2.499999, 2.5, 4.0, 11.0, 25.0, 300.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tails.ln_erfc(F.col("x")).alias("l")).collect()
    for r in got:
        want = math.log(math.erfc(r["x"])) if r["x"] < 26 else special.log_normal_tail(r["x"] * math.sqrt(2)) + math.log(2)
        assert r["l"] == pytest.approx(want, rel=1e-12, abs=1e-12)


# Streams.

EVENT = "event_id long, ts timestamp, kind string"


def log_of(spark, n=60):
    rows = spark.range(n).selectExpr("id event_id", "timestamp_seconds(1000000 + id * 60) ts", "if(id % 2 = 0, 'a', 'b') kind")
    return GrowingLog(rows, 3, F.col("event_id") % 7 == 3, F.col("event_id") % 5 == 0)


def test_growing_log(spark):
    """Every row arrives once or, where repeated, twice; late rows one append later."""
    log = log_of(spark)
    seen = {k: sorted(r["event_id"] for r in log.arriving(k).collect()) for k in range(3)}
    assert sorted(sum(seen.values(), [])) == sorted([*range(60), *range(0, 60, 5)])
    assert 17 in seen[1] and 3 in seen[1] and 5 in seen[0] and 5 in seen[1] and 10 not in seen[0] and 59 in seen[2]


def test_keyed_sink_stores_a_repeated_batch_once(spark):
    sink = KeyedSink(fresh_path(spark, "sink"), ["k"], (F.col("k") % 2).cast("string"))
    first = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "k long, v string")
    sink(first, 0)
    sink(first, 0)  # a micro-batch that ran again
    sink(spark.createDataFrame([(2, "late"), (3, "z")], "k long, v string"), 1)
    sink(first.limit(0), 2)
    assert sorted(map(tuple, sink.rows(spark).collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_streams_survive_restarts(spark):
    log = log_of(spark)
    sink = KeyedSink(fresh_path(spark, "sink"), ["event_id"], F.col("kind"))
    build = lambda stream: stream.withWatermark("ts", log.delay).dropDuplicatesWithinWatermark(["event_id"])
    follow(log, build, sink)
    assert sorted(r["event_id"] for r in sink.rows(spark).collect()) == list(range(60))
    assert build(log.read()).isStreaming


def test_stream_of_an_empty_table(spark):
    log = GrowingLog(spark.createDataFrame([], EVENT), 2)
    sink = KeyedSink(fresh_path(spark, "sink"), ["event_id"], F.col("kind"))
    log.append(0)
    drain(log.read(), sink, fresh_path(spark, "stream"))
    assert sink.schema is None or sink.rows(spark).count() == 0


def test_stall_counter_over_a_log(spark):
    rng = random.Random(5)
    rows = [(k, 1000 + t, t % 3, None if rng.random() < 0.2 else float(rng.randrange(30))) for k in (1, 2, 3) for t in range(16)]
    frame = spark.createDataFrame(rows, "k long, s long, place long, value double").selectExpr("k", "timestamp_seconds(s) ts", "place", "value")
    log = GrowingLog(frame, 2, F.unix_seconds("ts") % 4 == 1)
    sink = KeyedSink(fresh_path(spark, "sink"), ["k", "attempt"], F.col("k").cast("string"))
    with patience.rocksdb(spark):
        follow(log, lambda stream: patience.stalls(stream, "k", 5, log.delay), sink, marker={"k": F.lit(-1).cast("long"), "place": F.lit(0).cast("long")})
    numbered = spark.createDataFrame([(k, t - 999, v) for k, t, _, v in rows], "k long, attempt long, value double")
    want = tasks.attempts_with_patience(numbered, ["k"], 5).select("k", "attempt", "value", "best", "stalled").collect()
    assert sorted(map(tuple, sink.rows(spark).where("k > 0").select("k", "attempt", "value", "best", "stalled").collect()), key=str) == sorted(map(tuple, want), key=str)


# Vertex programs.


def some_graphs():
    rng = random.Random(7)
    out = {1: [(0, 1)], 2: [(0, 1), (1, 2), (0, 2)], 3: [(i, i + 1) for i in range(10)], 4: [(i, (i + 1) % 9) for i in range(9)], 5: [(0, k) for k in range(1, 6)], 6: [(a, b) for a in range(3) for b in range(3, 7)]}
    out[7] = [(0, 1), (2, 3), (3, 4)]
    out[8] = [(a, b) for a in range(6) for b in range(a)]
    for g in range(9, 16):
        out[g] = list({tuple(sorted(rng.sample(range(12), 2))) for _ in range(rng.randint(4, 25))})
    return {g: [(min(e), max(e)) for e in edges] for g, edges in out.items()}


def test_vertex_programs(spark, monkeypatch):
    """Against the single-graph library, by graph, with few sources to a word."""
    monkeypatch.setattr(vertex, "WORD", 5)
    made = some_graphs()
    edges = spark.createDataFrame([(g, *e) for g, es in made.items() for e in es], "g long, u long, v long").repartition(3)
    got = {r["g"]: r for r in vertex.graph_properties(edges).collect()}
    names = [c.split()[0] for c in properties.SCHEMA.split(", ")]
    for g, es in made.items():
        want, r = dict(zip(names, properties.describe(g, es))), got[g]
        assert (r["n_vertices"], r["n_edges"], r["is_connected"], r["n_components"], r["bipartite"], r["degeneracy"]) == tuple(want[k] for k in ("n_vertices", "n_edges", "is_connected", "n_components", "is_bipartite", "degeneracy"))
        assert r["girth"] == want["girth"] and r["largest_fraction"] == pytest.approx(want["largest_fraction"])
        if r["is_connected"]:
            assert r["diameter"] == want["diameter"] and r["avg_path"] == pytest.approx(want["avg_path"])
    assert [got[g]["family"] for g in range(1, 9)] == ["complete", "complete", "path", "cycle", "star", "complete_bipartite", "forest", "complete"]


def test_colour_classes(spark):
    """Relabelled graphs share a class; a hexagon and two triangles do too, as refinement cannot tell them apart."""
    ring = [(i, (i + 1) % 6) for i in range(6)]
    made = {1: ring, 2: [(a * 7 + 3, b * 7 + 3) for a, b in ring], 3: [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], 4: [(i, i + 1) for i in range(5)]}
    rows = [(g, min(e), max(e)) for g, es in made.items() for e in es]
    got = {r["g"]: (r["n_colours"], r["same_as"]) for r in vertex.colour_classes(spark.createDataFrame(rows, "g long, u long, v long")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (3, 4)}


# Raw records.


@pytest.mark.parametrize(
    ("raw", "check"),
    [
        ('{"embedding":{"1":[10],"2":[11,12]},"time":1.5,"cpu_time":2}', None),
        ('{"embedding":{"1":[10],"2":[11]}', "format"),
        ('{"embedding":{"1":[10],"2":[11],"7":[12]}}', "key_validity"),
        ('{"embedding":{"1":[10],"x":[11]}}', "key_validity"),
        ('{"embedding":{"1":[10]}}', "key_validity"),
        ('{"embedding":{"1":[99],"2":"x"}}', "value_validity"),
        ('{"embedding":{"1":"x","2":[99]}}', "chain_format"),
        ('{"embedding":{"1":null,"2":[10]}}', "chain_format"),
        ('{"embedding":{"1":[10.0],"2":[11]}}', "type_correctness"),
        ('{"embedding":{"1":[10,10.0,"q"],"2":[11]}}', "value_validity"),
        ('{"embedding":{},"time":0}', "wall_time_validity"),
        ('{"embedding":{"1":[],"2":[]},"time":"fast"}', "wall_time_validity"),
        ('{"time":null}', "wall_time_validity"),
        ('{"embedding":null,"time":1,"cpu_time":9}', "cpu_time_plausibility"),
        ('{"time":1,"cpu_time":-1}', "cpu_time_plausibility"),
        ('{"cpu_time":-1}', None),
        ('[1, 2]', None),
        (None, "format"),
    ],
)
def test_raw_records(spark, raw, check):
    rows = spark.createDataFrame([(5, raw)], "run_id long, raw string")
    nodes = spark.createDataFrame([(5, 1), (5, 2)], "run_id long, src long")
    found = records.record_failures(rows, nodes, spark.createDataFrame([(10,), (11,), (12,)], "node long"), 4).collect()
    assert [r["check"] for r in found] == ([check] if check else [])
    assert all(r["error"].startswith("returned e") and f"Layer 2 [{check}]: {r['detail']}" in r["error"] for r in found)


# Selections.


def test_selections(spark):
    presets = spark.createDataFrame([("mine", "2-4, !3")], "name string, selection string")
    specs = {1: "mine", 2: "*", 3: "*, !5-1000000000", 4: "7", 5: "1–3 & 9,,!2", 6: "30-40", 7: "!1", 8: "9-3", 9: " mine "}
    chosen = selections.selected(spark.createDataFrame(list(specs.items()), "selection_id long, spec string"), spark.range(1, 11), presets)
    got = {}
    for r in chosen.collect():
        got.setdefault(r["selection_id"], set()).add(r["id"])
    assert got == {1: {2, 4}, 2: set(range(1, 11)), 3: {1, 2, 3, 4}, 4: {7}, 5: {1, 3, 9}, 9: {2, 4}}
    assert "NestedLoop" not in chosen._jdf.queryExecution().toString() and "Cartesian" not in chosen._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="not an id or a range"):
        selections.selected(spark.createDataFrame([(1, "a-b")], "selection_id long, spec string"), spark.range(3), presets).collect()
    assert selections.selected(spark.createDataFrame([], "selection_id long, spec string"), spark.range(3), presets).count() == 0
    left = {tuple(r) for r in selections.still_to_install(chosen, spark.range(3)).where("selection_id in (1, 4)").collect()}
    assert left == {(1, 2, 1, 1), (4, 1, 0, 1)}


# Topologies.


@pytest.mark.parametrize(("name", "make"), [("chimera_3x2x4", lambda s: graphs.chimera(s, 3, 2, 4)), ("pegasus_3", lambda s: graphs.pegasus(s, 3)), ("pegasus_4", lambda s: graphs.pegasus(s, 4)), ("zephyr_2", lambda s: graphs.zephyr(s, 2)), ("zephyr_3", lambda s: graphs.zephyr(s, 3))])
def test_topology_function(spark, name, make):
    topology_table.register(spark)
    got = [tuple(sorted(r)) for r in spark.sql(f"SELECT u, v FROM topology_edges('{name}')").collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(r)) for r in make(spark).collect()}


def test_topology_function_of_other_names(spark):
    topology_table.register(spark)
    named = spark.createDataFrame([("a", "chimera_1x1x4"), ("b", "nothing"), ("c", None)], "run string, topology string")
    got = spark.sql("SELECT run, count(*) n FROM {t} t, LATERAL topology_edges(t.topology) GROUP BY run", t=named).collect()
    assert [tuple(r) for r in got] == [("a", 16)]


# Write-back.


def test_versioned_table(spark):
    rows = spark.range(100).selectExpr("id k", "id * 2 a", "cast(null as string) b")
    kept = VersionedTable(spark, fresh_path(spark, "table"), ["k"], F.col("k") % 10, rows.schema)
    assert kept.rows().count() == 0
    kept.merge(rows)
    kept.merge(spark.createDataFrame([(3, "x"), (103, "new")], "k long, b string"))
    got = {r["k"]: (r["a"], r["b"]) for r in kept.rows().collect()}
    assert len(got) == 101 and got[3] == (6, "x") and got[103] == (None, "new") and got[13] == (26, None)
    # only the part that the merge touched has a new version
    assert {(r["part"], r["version"]) for r in kept.manifest().collect()} == {(str(k), int(k == 3)) for k in range(10)}
    with pytest.raises(ValueError, match="more than once"):
        kept.merge(spark.createDataFrame([(1, "p"), (1, "q")], "k long, b string"))
    broken = spark.createDataFrame([(k, "z") for k in range(30)], "k long, b string").withColumn("b", F.when(F.col("k") == 29, F.raise_error(F.lit("broken"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="broken"):
        kept.merge(broken)
    assert {r["k"]: (r["a"], r["b"]) for r in kept.rows().collect()} == got
    kept.merge(spark.createDataFrame([(4, "after")], "k long, b string"))
    assert {r["k"]: r["b"] for r in kept.rows().where("b is not null").collect()} == {3: "x", 103: "new", 4: "after"}
    assert "dynamicpruning" in kept.rows()._jdf.queryExecution().toString().lower()


def test_queries_are_listed_without_a_session():
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and len(out.stdout.split()) == 2
