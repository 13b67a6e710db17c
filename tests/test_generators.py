"""Generators and whole-graph properties by known values."""

from __future__ import annotations

import pytest

from trialforge.operators import generators, graphs, properties


@pytest.mark.parametrize("family,args,nodes,edges", [("honeycomb", (4, 6), 24, 29), ("shastry_sutherland", (4, 4), 16, 28), ("bcc_lattice", (3, 3, 3), 35, 64), ("barabasi_albert", (30, 3, 1), 30, 81), ("frustrated_square", (3, 3), 9, 20), ("weak_strong_cluster", (2, 4, 1, 1), 8, 13)])
def test_sizes(spark, family, args, nodes, edges):
    e = graphs.undirected(graphs.generate(spark, family, *args))
    assert (graphs.both_ways(e).select("u").distinct().count(), e.count()) == (nodes, edges)


def test_watts_strogatz(spark):
    assert 0.9 * 60 <= graphs.generate(spark, "watts_strogatz", 30, 4, 20, 3).count() <= 60


@pytest.mark.parametrize("name,n,degree,girth,diameter", [("petersen", 10, 3, 5, 2), ("heawood", 14, 3, 6, 3), ("dodecahedral", 20, 3, 5, 5), ("icosahedral", 12, 5, 3, 3), ("desargues", 20, 3, 6, 5), ("pappus", 18, 3, 6, 4), ("cubical", 8, 3, 4, 3), ("moebius_kantor", 16, 3, 6, 4), ("octahedral", 6, 4, 3, 2), ("tutte_coxeter", 30, 3, 8, 4), ("frucht", 12, 3, 3, 4), ("truncated_tetrahedron", 12, 3, 3, 3)])
def test_named(spark, name, n, degree, girth, diameter):
    edges = [tuple(r) for r in graphs.named(spark, name).collect()]
    row = dict(zip([c.split()[0] for c in properties.SCHEMA.split(", ")], properties.describe(1, edges)))
    assert (row["n_vertices"], row["n_edges"], row["girth"], row["diameter"]) == (n, n * degree // 2, girth, diameter)
    assert row["is_connected"] and row["degeneracy"] <= degree


def test_properties(spark):
    rows = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 5, 6)]
    got = {r["graph_id"]: r for r in properties.properties(spark.createDataFrame(rows, "graph_id long, u long, v long")).collect()}
    assert got[1]["is_forest"] and got[1]["is_bipartite"] and got[1]["girth"] is None and got[1]["algebraic_connectivity"] == pytest.approx(1)
    assert not got[2]["is_connected"] and got[2]["clique_number"] == 3 and got[2]["largest_fraction"] == 0.6 and got[2]["diameter"] is None and not got[2]["is_bipartite"]
    assert got[2]["treewidth_bound"] == 2 and got[2]["degeneracy"] == 2
    with pytest.raises(ValueError):
        graphs.named(spark, "nothing")


def test_kagome_is_a_line_graph(spark):
    assert graphs.generate(spark, "kagome", 4, 4).count() > 0


@pytest.mark.parametrize("family,args", [("complete", (7,)), ("bipartite", (3, 5)), ("turan", (11, 3)), ("grid", (4, 5)), ("king_graph", (4, 5)), ("hypercube", (4,)), ("circulant", (12, 1, 6)), ("johnson", (5, 2)), ("kneser", (5, 2)), ("sudoku", (2,)), ("wheel", (7,)), ("tree", (3, 2)), ("random_er", (40, 30, 1)), ("barabasi_albert", (20, 2, 3))])
def test_checker_accepts(spark, family, args):
    from trialforge.operators import verify

    assert verify.problems(graphs.generate(spark, family, *args), family, *args) == []


def test_checker_refuses(spark):
    from trialforge.operators import verify

    bad = spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "u long, v long")
    assert set(verify.problems(bad, "cycle", 4)) == {"loops", "repeated edges", "node count", "edge count", "degrees"}
    assert not verify.random_edges_fit(100, 0.5, 100)


def size(edges):
    e = graphs.undirected(edges)
    assert e.count() == edges.count()
    return graphs.both_ways(e).select("u").distinct().count(), e.count()


@pytest.mark.parametrize("family,sides,nodes,edges", [("grid", (4, 5), 20, 40), ("king_graph", (4, 5), 20, 80), ("frustrated_square", (5, 3), 15, 60), ("cubic_lattice", (3, 3, 4), 36, 108), ("shastry_sutherland", (4, 4), 16, 40), ("grid", (2, 3), 6, 9)])
def test_periodic(spark, family, sides, nodes, edges):
    assert size(generators.periodic(spark, family, *sides)) == (nodes, edges)


@pytest.mark.parametrize("family,args,nodes,edges", [("honeycomb_cells", (1, 1), 6, 6), ("honeycomb_cells", (2, 3), 22, 27), ("triangular_cells", (1, 1), 3, 3), ("triangular_cells", (3, 4), 12, 23), ("triangular_cells", (3, 5), 14, 28), ("regular", (20, 3, 1), 20, 30), ("regular", (11, 4, 2), 11, 22), ("random_planar", (20, 1), 20, 54), ("power_grid", (30, "radial", 1), 30, 29), ("hardware_native", ("chimera", 3), 72, 192), ("portfolio_qubo", (10, "block"), 10, 12), ("portfolio_qubo", (7,), 7, 21), ("kagome_cells", (1, 1), 6, 6)])
def test_further_sizes(spark, family, args, nodes, edges):
    assert size(generators.make(spark, family, *args)) == (nodes, edges)


def test_honeycomb_cells_by_brute_force(spark):
    m, n = 2, 3
    nodes = {(i, j) for i in range(n + 1) for j in range(2 * m + 2)} - {(0, 2 * m + 1), (n, (2 * m + 1) * (n % 2))}
    order = {x: k for k, x in enumerate(sorted(nodes))}
    want = {(order[i, j], order[i, j + 1]) for i, j in nodes if (i, j + 1) in nodes} | {(order[i, j], order[i + 1, j]) for i, j in nodes if (i + 1, j) in nodes and i % 2 == j % 2}
    assert {tuple(r) for r in generators.honeycomb_cells(spark, m, n).collect()} == want


def test_regular_and_planar_degrees(spark):
    both = graphs.both_ways(generators.regular(spark, 24, 5, 3)).groupBy("u").count()
    assert {r["count"] for r in both.collect()} == {5}
    assert [tuple(r) for r in generators.regular(spark, 24, 5, 3).collect()] == [tuple(r) for r in generators.regular(spark, 24, 5, 3).collect()]
    assert {r["count"] for r in graphs.both_ways(generators.named(spark, "chvatal")).groupBy("u").count().collect()} == {4}
    with pytest.raises(ValueError):
        generators.regular(spark, 5, 3)


def test_planted_is_within_hardware(spark):
    rows = generators.planted_solution(spark, 40, "chimera", 2)
    assert rows.count() > 0 and rows.agg({"v": "max"}).head()[0] < 40 and rows.where("u >= v").isEmpty()
    tree = generators.power_grid(spark, 50, "meshed", 4)
    assert 49 < tree.count() <= 59


def test_sweep_and_refusals(spark):
    rows = [tuple(r)[:3] for r in generators.sweep(spark, "grid", 100, 109, m=[2, 3], n=[4, 5]).orderBy("graph_id").collect()]
    assert rows == [(100, "grid", "grid_m2_n4"), (101, "grid", "grid_m2_n5"), (102, "grid", "grid_m3_n4"), (103, "grid", "grid_m3_n5")]
    for call in (lambda: generators.sweep(spark, "grid", 1, 3, m=[2, 3], n=[4, 5]), lambda: generators.hardware_native(spark, "pegasus", 17), lambda: generators.np_problem(spark, "x", 5), lambda: generators.periodic(spark, "star", 3, 3), lambda: generators.portfolio(spark, 5, "x"), lambda: generators.power_grid(spark, 5, "x")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("name,n,m,girth", [("bull", 5, 5, 3), ("butterfly", 5, 6, 3), ("house", 5, 6, 3), ("chvatal", 12, 24, 4), ("wagner", 8, 12, 4), ("mcgee", 24, 36, 7), ("franklin", 12, 18, 4), ("petersen", 10, 15, 5)])
def test_further_named(spark, name, n, m, girth):
    row = dict(zip([c.split()[0] for c in properties.SCHEMA.split(", ")], properties.describe(1, [tuple(r) for r in generators.named(spark, name).collect()])))
    assert (row["n_vertices"], row["n_edges"], row["girth"]) == (n, m, girth)
