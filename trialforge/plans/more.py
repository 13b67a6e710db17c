"""Registered queries on graphs, tasks, catalogues and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialforge.operators import catalog, derive, filters, generators, graphs, tasks
from trialforge.plans.registry import query
from trialforge.plans.roles import derived, table
from trialforge.streaming import ingest


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def copurchase(s: SparkSession, d: str) -> DataFrame:
    """(g, u, v): parts ordered together, by order priority."""
    rows = lines(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("g")), "l_orderkey").select("g", "l_orderkey", "l_partkey")
    return rows.join(rows.withColumnRenamed("l_partkey", "v"), ["g", "l_orderkey"]).where("l_partkey < v").select("g", F.col("l_partkey").alias("u"), "v").distinct()


def order_stars(s: SparkSession, d: str) -> DataFrame:
    """(g, u, v): each part of an order with the order's least one. The nodes and components of `copurchase`, without its pairs."""
    rows = lines(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("g")), "l_orderkey")
    return rows.select("g", F.min("l_partkey").over(Window.partitionBy("l_orderkey")).alias("u"), F.col("l_partkey").alias("v")).where("u < v")


COP = "WITH r AS (SELECT o_orderpriority AS g, l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT DISTINCT a.g, a.l_partkey AS u, b.l_partkey AS v FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), both_ways AS (SELECT g, u, v FROM e UNION ALL SELECT g, v, u FROM e), deg AS (SELECT g, u, count(*) AS d FROM both_ways GROUP BY ALL)"
query("degree_properties", COP + """ SELECT g, count(*) AS n_vertices, (sum(d) / 2)::BIGINT AS n_edges, round(sum(d) / (count(*) * (count(*) - 1.0)), 7) AS density, round(avg(d), 7) AS avg_degree, max(d) AS max_degree, min(d) AS min_degree,
 round(stddev_pop(d), 7) AS degree_std, max(d) = min(d) AS is_regular FROM deg GROUP BY g""")(lambda s, d: graphs.degree_properties(copurchase(s, d), ["g"]))  # fmt: skip
TRI = COP + """, o AS MATERIALIZED (SELECT e.g, CASE WHEN a.d < b.d OR (a.d = b.d AND e.u < e.v) THEN e.u ELSE e.v END AS x, CASE WHEN a.d < b.d OR (a.d = b.d AND e.u < e.v) THEN e.v ELSE e.u END AS y,
  greatest(a.d, b.d) AS dy FROM e JOIN deg a ON a.g = e.g AND a.u = e.u JOIN deg b ON b.g = e.g AND b.u = e.v),
 tri AS (SELECT p.g, least(p.x, p.y, q.y) AS a, p.x + p.y + q.y - least(p.x, p.y, q.y) - greatest(p.x, p.y, q.y) AS b, greatest(p.x, p.y, q.y) AS c
  FROM o p JOIN o q ON p.g = q.g AND p.x = q.x AND (p.dy < q.dy OR (p.dy = q.dy AND p.y < q.y)) JOIN o z ON z.g = p.g AND z.x = p.y AND z.y = q.y)"""
query("triangles", TRI + " SELECT * FROM tri")(lambda s, d: graphs.triangles(copurchase(s, d), ["g"]))
query("clustering", TRI + """, loc AS (SELECT g, u, count(*) AS t FROM (SELECT g, unnest([a, b, c]) AS u FROM tri) GROUP BY ALL), j AS (SELECT deg.g, d, coalesce(t, 0) AS t, d * (d - 1) / 2.0 AS p FROM deg LEFT JOIN loc ON deg.g = loc.g AND deg.u = loc.u)
 SELECT g, (sum(t) / 3)::BIGINT AS triangles, round(coalesce(sum(t) / nullif(sum(p), 0), 0), 7) AS clustering_global, round(avg(CASE WHEN d > 1 THEN t / p ELSE 0 END), 7) AS clustering_avg FROM j GROUP BY g""")(lambda s, d: graphs.clustering(copurchase(s, d), ["g"]))  # fmt: skip
query("assortativity", COP + " SELECT b.g, round(corr(x.d, y.d), 7) AS assortativity FROM both_ways b JOIN deg x ON x.g = b.g AND x.u = b.u JOIN deg y ON y.g = b.g AND y.u = b.v GROUP BY b.g")(lambda s, d: graphs.assortativity(copurchase(s, d), ["g"]))
ROUNDS = 12
LABELS = COP + ", l0 AS (SELECT DISTINCT g, u AS node, u AS label FROM both_ways)" + "".join(
    f", l{k + 1} AS MATERIALIZED (SELECT l.g, l.node, least(min(l.label), coalesce(min(n.label), min(l.label))) AS label FROM l{k} l LEFT JOIN both_ways b ON b.g = l.g AND b.u = l.node LEFT JOIN l{k} n ON n.g = b.g AND n.node = b.v GROUP BY l.g, l.node)" for k in range(ROUNDS)
)
query("components", LABELS + f" SELECT g, node, label FROM l{ROUNDS}")(lambda s, d: graphs.min_labels(None, order_stars(s, d), ["g"]))
query("bfs_levels", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey + 1000000 AS v FROM lineitem), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
 w(node, level) AS (SELECT 1::BIGINT, 0 UNION SELECT b.v, w.level + 1 FROM w JOIN b ON b.u = w.node WHERE w.level < 8) SELECT node, min(level)::INT AS level FROM w GROUP BY node""")(
    lambda s, d: graphs.bfs_levels(lines(s, d).select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")).distinct(), 1))


def chains(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).select((F.col("l_orderkey") % 500).alias("run_id"), F.col("l_linenumber").alias("src"), F.col("l_suppkey").alias("qubit"))


def target(s: SparkSession, d: str) -> DataFrame:
    a = lines(s, d).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("u"))
    b = lines(s, d).select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("v"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("(u * 7 + v) % 5 = 0").select("u", "v")


def source_edges(s: SparkSession, d: str) -> DataFrame:
    return chains(s, d).select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("u")).withColumn("v", F.col("u") + 1)


def source_nodes(s: SparkSession, d: str) -> DataFrame:
    return chains(s, d).select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("src"))


EMB = """WITH c AS (SELECT l_orderkey % 500 AS run_id, l_linenumber AS src, l_suppkey AS qubit FROM lineitem),
 t AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) WHERE (u * 7 + v) % 5 = 0 AND u <> v),
 inner_edges AS (SELECT DISTINCT a.run_id, a.src, t.u, t.v FROM c a JOIN t ON t.u = a.qubit JOIN c b ON b.run_id = a.run_id AND b.src = a.src AND b.qubit = t.v)"""
query("coverage_violations", EMB + " SELECT r.run_id, s.src::INT AS src FROM (SELECT DISTINCT run_id FROM c) r, range(1, 9) s(src) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = r.run_id AND c.src = s.src)")(lambda s, d: graphs.uncovered(source_nodes(s, d), chains(s, d)))
query("overlap_violations", EMB + " SELECT run_id, qubit, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1")(lambda s, d: graphs.overlaps(chains(s, d)))
query("edge_violations", EMB + """, tt AS (SELECT u, v FROM t UNION SELECT v, u FROM t), ok AS (SELECT DISTINCT a.run_id, a.src AS u, b.src AS v FROM c a JOIN tt ON tt.u = a.qubit JOIN c b ON b.run_id = a.run_id AND b.qubit = tt.v AND b.src = a.src + 1)
 SELECT r.run_id, s.u::INT AS u, (s.u + 1)::INT AS v FROM (SELECT DISTINCT run_id FROM c) r, range(1, 7) s(u) WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.run_id = r.run_id AND ok.u = s.u AND ok.v = s.u + 1)""")(lambda s, d: graphs.unpreserved(source_edges(s, d), chains(s, d), target(s, d).where("u <> v")))  # fmt: skip
query("chain_couplers", EMB + " SELECT * FROM inner_edges")(lambda s, d: graphs.inner_edges(chains(s, d), target(s, d)))
query("embedding_metrics", EMB + """, l AS (SELECT run_id, src, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT run_id, count(DISTINCT qubit) AS total_qubits_used FROM c GROUP BY ALL), k AS (SELECT run_id, count(*) AS total_couplers_used FROM inner_edges GROUP BY ALL)
 SELECT l.run_id, round(avg(n), 7) AS avg_chain_length, max(n) AS max_chain_length, round(coalesce(stddev_samp(n), 0), 7) AS chain_length_std, any_value(total_qubits_used) AS total_qubits_used, coalesce(any_value(total_couplers_used), 0) AS total_couplers_used
 FROM l JOIN q USING (run_id) LEFT JOIN k USING (run_id) GROUP BY l.run_id""")(lambda s, d: graphs.embedding_metrics(chains(s, d), target(s, d)))  # fmt: skip
query("validation", EMB.replace("WITH c AS", "WITH RECURSIVE c AS") + """, ie AS (SELECT run_id, src, u, v FROM inner_edges UNION SELECT run_id, src, v, u FROM inner_edges),
 reach(run_id, src, node) AS (SELECT run_id, src, min(qubit) FROM c GROUP BY ALL UNION SELECT r.run_id, r.src, ie.v FROM reach r JOIN ie ON ie.run_id = r.run_id AND ie.src = r.src AND ie.u = r.node),
 tt AS (SELECT u, v FROM t UNION SELECT v, u FROM t), r AS (SELECT DISTINCT run_id FROM c),
 kept AS (SELECT DISTINCT a.run_id, a.src AS u FROM c a JOIN tt ON tt.u = a.qubit JOIN c b ON b.run_id = a.run_id AND b.qubit = tt.v AND b.src = a.src + 1),
 bad AS (SELECT r.run_id, 0 AS k FROM r, range(1, 8) s(src) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = r.run_id AND c.src = s.src)
  UNION ALL SELECT n.run_id, 2 FROM (SELECT run_id, src, count(DISTINCT qubit) AS n FROM c GROUP BY ALL) n JOIN (SELECT run_id, src, count(*) AS n FROM reach GROUP BY ALL) m ON m.run_id = n.run_id AND m.src = n.src WHERE m.n < n.n
  UNION ALL SELECT run_id, 3 FROM c GROUP BY run_id, qubit HAVING count(*) > 1
  UNION ALL SELECT r.run_id, 4 FROM r, range(1, 7) s(u) WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.run_id = r.run_id AND kept.u = s.u)),
 f AS (SELECT run_id, min(k) AS k FROM bad GROUP BY run_id)
 SELECT r.run_id, k IS NULL AS passed, ['coverage', 'non_empty_chains', 'connectivity', 'disjointness', 'edge_preservation'][k + 1] AS "check" FROM r LEFT JOIN f USING (run_id)""")(
    lambda s, d: graphs.validate(source_nodes(s, d).where("src < 8"), source_edges(s, d).where("v < 8"), chains(s, d), chains(s, d).where("false").select("run_id", "src"), target(s, d)))
query("key_problems", EMB + """, n AS (SELECT r.run_id, s.src FROM (SELECT DISTINCT run_id FROM c) r, range(1, 6) s(src))
 SELECT run_id, 'extra_keys' AS problem, count(*) AS n FROM (SELECT DISTINCT run_id, src FROM c WHERE src > 5) GROUP BY run_id
 UNION ALL SELECT run_id, 'missing_keys', count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = n.run_id AND c.src = n.src) GROUP BY run_id
 UNION ALL SELECT run_id, 'value_validity', count(*) FROM c WHERE qubit > 90 GROUP BY run_id""")(
    lambda s, d: graphs.key_problems(source_nodes(s, d).where("src < 6"), chains(s, d), s.range(91).select(F.col("id").alias("node"))))
query("faulted_edges", EMB + " SELECT u, v FROM t WHERE u % 10 <> 3 AND v % 10 <> 3")(lambda s, d: graphs.without_faults(s.range(1, 200_000).select(F.col("id").alias("node")), graphs.undirected(target(s, d)), s.range(1, 200_000).where("id % 10 = 3").select(F.col("id").alias("node")))[1])

query("chimera_edges", """WITH n AS (SELECT i, j, side, k, ((i * 6 + j) * 2 + side) * 4 + k AS id FROM range(5) a(i), range(6) b(j), range(2) c(side), range(4) x(k))
 SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON (a.i = b.i AND a.j = b.j AND a.side = 0 AND b.side = 1) OR (a.side = 0 AND b.side = 0 AND a.k = b.k AND a.j = b.j AND b.i = a.i + 1) OR (a.side = 1 AND b.side = 1 AND a.k = b.k AND a.i = b.i AND b.j = a.j + 1)""")(lambda s, d: graphs.chimera(s, 5, 6, 4))  # fmt: skip
query("pegasus_edges", """WITH q AS (SELECT id, id // 144 AS u, (id // 36) % 4 AS w, (id // 3) % 12 AS k, id % 3 AS z FROM range(288) t(id)),
 a AS (SELECT id, w * 12 + k AS x, z * 12 + [2, 10, 6][k // 4 + 1] AS y0 FROM q WHERE u = 0), b AS (SELECT id, w * 12 + k AS y, z * 12 + [6, 2, 10][k // 4 + 1] AS x0 FROM q WHERE u = 1),
 i AS (SELECT a.id AS u, b.id AS v FROM a JOIN b ON a.x BETWEEN b.x0 AND b.x0 + 11 AND b.y BETWEEN a.y0 AND a.y0 + 11), s AS (SELECT u AS id FROM i UNION SELECT v FROM i),
 r AS (SELECT id AS u, id + 1 AS v FROM q WHERE z < 2 UNION ALL SELECT id, id + 3 FROM q WHERE k % 2 = 0)
 SELECT u, v FROM i UNION ALL SELECT u, v FROM r WHERE u IN (SELECT id FROM s) AND v IN (SELECT id FROM s)""")(lambda s, d: graphs.pegasus(s, 4))
query("zephyr_edges", """WITH q AS (SELECT id, id // 168 AS u, (id // 24) % 7 AS w, (id // 3) % 2 AS j, id % 3 AS z FROM range(336) t(id)), c AS (SELECT *, unnest([2 * z + j, 2 * z + j + 1]) AS cross_ FROM q)
 SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.u = 0 AND b.u = 1 AND a.w = b.cross_ AND a.cross_ = b.w UNION ALL SELECT id, id + 1 FROM q WHERE z < 2 UNION ALL SELECT id, id + 3 FROM q WHERE j = 0 UNION ALL SELECT id, id + 2 FROM q WHERE j = 0 AND z > 0""")(lambda s, d: graphs.zephyr(s, 3))
for _name, _args, _sql in (
    ("complete", (40,), "SELECT u, v FROM range(40) a(u), range(40) b(v) WHERE u < v"),
    ("bipartite", (7, 9), "SELECT u, v FROM range(7) a(u), range(7, 16) b(v)"),
    ("turan", (30, 4), "SELECT u, v FROM range(30) a(u), range(30) b(v) WHERE u < v AND u % 4 <> v % 4"),
    ("grid", (9, 7), "SELECT u, v FROM range(63) a(u), range(63) b(v) WHERE u < v AND abs(u // 7 - v // 7) + abs(u % 7 - v % 7) = 1"),
    ("king_graph", (9, 7), "SELECT u, v FROM range(63) a(u), range(63) b(v) WHERE u < v AND greatest(abs(u // 7 - v // 7), abs(u % 7 - v % 7)) = 1"),
    ("hypercube", (6,), "SELECT u, v FROM range(64) a(u), range(64) b(v) WHERE u < v AND bit_count(xor(u, v)) = 1"),
    ("circulant", (20, 1, 3), "SELECT DISTINCT least(u, w) AS u, greatest(u, w) AS v FROM (SELECT u, (u + o) % 20 AS w FROM range(20) a(u), (VALUES (1), (3)) b(o))"),
    ("kneser", (6, 2), "WITH s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM range(64) a(id) WHERE bit_count(id) = 2) SELECT a.n AS u, b.n AS v FROM s a JOIN s b ON a.n < b.n AND a.id & b.id = 0"),
    ("johnson", (6, 2), "WITH s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM range(64) a(id) WHERE bit_count(id) = 2) SELECT a.n AS u, b.n AS v FROM s a JOIN s b ON a.n < b.n AND bit_count(a.id & b.id) = 1"),
    ("binary_tree", (5,), "SELECT (v - 1) // 2 AS u, v FROM range(1, 63) b(v)"),
    ("wheel", (12,), "SELECT 0 AS u, v FROM range(1, 12) b(v) UNION ALL SELECT v, CASE WHEN v = 11 THEN 1 ELSE v + 1 END FROM range(1, 12) b(v)"),
    ("sudoku", (2,), "SELECT u, v FROM range(16) a(u), range(16) b(v) WHERE u < v AND (u // 4 = v // 4 OR u % 4 = v % 4 OR (u // 8 = v // 8 AND u % 4 // 2 = v % 4 // 2))"),
):
    query(f"graph_{_name}", f"SELECT u::BIGINT AS u, v::BIGINT AS v FROM ({_sql})")(lambda s, d, n=_name, a=_args: graphs.generate(s, n, *a).select(F.col("u").cast("long"), F.col("v").cast("long")))

_GRID = "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT r * {c} + k AS u, (r + dr + {r}) % {r} * {c} + (k + dc + {c}) % {c} AS v FROM range({r}) a(r), range({c}) b(k), (VALUES {moves}) m(dr, dc){where}) WHERE u <> v"
for _name, _call, _sql in (
    ("grid_periodic", lambda s: generators.periodic(s, "grid", 6, 5), _GRID.format(r=6, c=5, moves="(0, 1), (1, 0)", where="")),
    ("king_periodic", lambda s: generators.periodic(s, "king_graph", 6, 5), _GRID.format(r=6, c=5, moves="(0, 1), (1, 0), (1, 1), (1, -1)", where="")),
    ("shastry_sutherland_periodic", lambda s: generators.periodic(s, "shastry_sutherland", 6, 4), _GRID.format(r=6, c=4, moves="(0, 1), (1, 0), (-1, 1)", where=" WHERE dr >= 0 OR (r + k) % 2 = 0")),
    ("shastry_sutherland", lambda s: graphs.generate(s, "shastry_sutherland", 6, 5), "SELECT u, v FROM range(30) a(u), range(30) b(v) WHERE (v = u + 1 AND u % 5 < 4) OR v = u + 5 OR (v = u + 4 AND u % 5 > 0 AND (v // 5 + v % 5) % 2 = 0)"),
    ("cubic_periodic", lambda s: generators.periodic(s, "cubic_lattice", 3, 4, 5), "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT (x * 4 + y) * 5 + z AS u, ((x + i) % 3 * 4 + (y + j) % 4) * 5 + (z + k) % 5 AS v FROM range(3) a(x), range(4) b(y), range(5) c(z), (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) m(i, j, k))"),
    ("portfolio_block", lambda s: generators.portfolio(s, 23, "block"), "WITH n AS (SELECT u, CASE WHEN u < 15 THEN u // 5 ELSE 3 + (u - 15) // 4 END AS b FROM range(23) a(u)) SELECT a.u, b.u AS v FROM n a JOIN n b ON a.u < b.u AND a.b = b.b"),
    ("honeycomb_cells", lambda s: generators.honeycomb_cells(s, 2, 3), "WITH n AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM range(4) a(i), range(6) b(j) WHERE NOT (i IN (0, 3) AND j = 5)) SELECT a.k AS u, b.k AS v FROM n a JOIN n b ON (a.i = b.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND a.j = b.j AND a.i % 2 = a.j % 2)"),
):
    query(f"graph_{_name}", f"SELECT u::BIGINT AS u, v::BIGINT AS v FROM ({_sql})")(lambda s, d, f=_call: f(s).select(F.col("u").cast("long"), F.col("v").cast("long")))

# Tasks.
GRAPHS = "SELECT p_partkey AS graph_id, 'g' || p_partkey AS graph_name, p_size AS nodes, p_size * 3 AS edges, CASE WHEN p_partkey % 3 = 0 THEN ['chi', 'PEG'] END AS topologies FROM part"
PLAN = f"""WITH g AS ({GRAPHS}), a(algorithm, supported) AS (VALUES ('x', NULL), ('y', ['chimera'])), t(topology_name, most_nodes, most_edges) AS (VALUES ('chimera_4', 20, 70), ('pegasus_4', 40, 100)),
 k AS (SELECT * FROM a, t WHERE supported IS NULL OR starts_with(topology_name, supported[1])), tasks AS (SELECT algorithm, graph_id, graph_name, topology_name, trial::INT AS trial, ('0x' || substr(sha256('42:' || algorithm || ':' || graph_id || ':' || topology_name || ':' || trial), 1, 8))::BIGINT AS seed
 FROM g, k, range(-1, 2) r(trial) WHERE CASE WHEN topologies IS NOT NULL THEN starts_with(topology_name, lower(topologies[1])) OR starts_with(topology_name, lower(topologies[2])) ELSE nodes <= most_nodes AND edges <= most_edges END)"""


def task_plan(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "part").select(F.col("p_partkey").alias("graph_id"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("graph_name"), F.col("p_size").alias("nodes"), (F.col("p_size") * 3).alias("edges"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("chi"), F.lit("PEG"))).alias("topologies"))
    a = s.createDataFrame([("x", None), ("y", ["chimera"])], "algorithm string, supported array<string>")
    t = s.createDataFrame([("chimera_4", 20, 70), ("pegasus_4", 40, 100)], "topology_name string, most_nodes int, most_edges int")
    return tasks.plan(g, a, t, trials=2, root=42, warmups=1)


def done_keys(plan: DataFrame) -> DataFrame:
    return plan.where("graph_id % 4 = 1")


query("task_plan", PLAN + " SELECT * FROM tasks")(task_plan)
query("remaining_tasks", PLAN + " SELECT * FROM tasks WHERE graph_id % 4 <> 1")(lambda s, d: tasks.remaining(task_plan(s, d), done_keys(task_plan(s, d))))
query("resumed_tasks", PLAN + " SELECT * FROM tasks WHERE graph_id % 4 <> 1 AND trial >= 0")(lambda s, d: tasks.resumed(task_plan(s, d), task_plan(s, d).where("trial >= 0"), done_keys(task_plan(s, d))))
query("trial_counts", PLAN + " SELECT count(*) AS planned, (SELECT count(*) FROM g) * 8 - count(*) AS skipped FROM tasks WHERE trial >= 0")(lambda s, d: tasks.trial_counts(task_plan(s, d), table(s, d, "part").count() * 4, 2).withColumn("skipped", F.col("skipped").cast("long")))
query("trial_seeds", "SELECT l_orderkey, l_linenumber, ('0x' || substr(sha256('7:algo:' || l_orderkey || ':topo:' || l_linenumber), 1, 8))::BIGINT AS seed FROM lineitem")(lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", derive.seed_of(F.lit(7), F.lit("algo"), F.col("l_orderkey"), F.lit("topo"), F.col("l_linenumber")).alias("seed")))


# Catalogue.
def manifest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") % 3).alias("nodes"), (F.col("p_size") % 2).alias("edges"), (F.col("p_size") / 50).alias("density"), F.array("p_type").alias("topologies"), F.create_map(F.lit("k"), (F.col("p_size") % 2).cast("string")).alias("p"))


MAN = "WITH m AS (SELECT p_partkey AS id, p_brand AS name, p_type AS type, p_size % 3 AS nodes, p_size % 2 AS edges, p_size / 50 AS density FROM part)"
query("type_overview", MAN + " SELECT type, min(id) AS min_id, max(id) AS max_id, count(*) AS total, count(*) FILTER (WHERE id % 2 = 0) AS installed FROM m GROUP BY type")(lambda s, d: catalog.type_overview(manifest(s, d), manifest(s, d).where("id % 2 = 0")))
query("catalog_listing", MAN + " SELECT id, name, type, nodes, edges, round(density, 3) AS density FROM m WHERE type = 'PROMO'")(lambda s, d: catalog.listing(manifest(s, d), "promo"))
query("catalog_search", MAN + " SELECT id, name FROM m WHERE type = 'LARGE' AND nodes >= 1 AND edges <= 1")(lambda s, d: filters.search_graphs(manifest(s, d), "large", min_nodes=1, max_edges=1, topology="LARGE").select("id", "name"))
query("catalog_duplicates", MAN + " SELECT id, name, min(id) OVER (PARTITION BY name, nodes, edges) AS canonical, min(nodes * 10 + edges) OVER (PARTITION BY name) <> max(nodes * 10 + edges) OVER (PARTITION BY name) AS collision FROM m")(lambda s, d: catalog.duplicates(manifest(s, d)))
query("selection_dedup", MAN + """, c AS (SELECT id, min(id) OVER (PARTITION BY name, nodes, edges) AS canonical FROM m), s AS (SELECT id FROM m WHERE id BETWEEN 5 AND 1500)
 SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = s.id AND canonical <> c.id AND canonical IN (SELECT id FROM s))""")(
    lambda s, d: filters.drop_selected_duplicates(manifest(s, d).where("id between 5 and 1500").select("id"), catalog.duplicates(manifest(s, d)).select("id", "canonical")))
query("canonical_redirect", MAN + " SELECT id, min(id) OVER (PARTITION BY name, nodes, edges) AS canonical FROM m")(lambda s, d: catalog.redirect(manifest(s, d).select("id"), catalog.duplicates(manifest(s, d))))


# Event time (extensions).
def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


query("log_progress", "SELECT event_type AS algorithm, 'SUCCESS' AS status, count(*) AS count FROM events GROUP BY event_type")(lambda s, d: ingest.progress(events(s, d).select(F.col("event_type").alias("algorithm"), F.lit("SUCCESS").alias("status"))))
query("tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 7) AS total FROM events GROUP BY ALL")(lambda s, d: ingest.tumbling(events(s, d)))
query("sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * k FOR k IN range(4)]) AS start FROM events) GROUP BY start")(lambda s, d: ingest.sliding(events(s, d)))
query("session_windows", """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL '30 minutes')::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")(lambda s, d: ingest.sessions(events(s, d)))  # fmt: skip
query("event_dedup", "SELECT DISTINCT event_id FROM events")(lambda s, d: ingest.deduplicated(events(s, d)).select("event_id"))
query("categories", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'complete' WHEN c_custkey % 4 = 1 THEN 'random_er' WHEN c_custkey % 4 = 2 THEN 'random' ELSE 'other' END AS category FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", derive.category_of(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" K"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 4 == 1, "random_er_9").when(F.col("c_custkey") % 4 == 2, "Random_x").otherwise("zzz")).alias("category")))
query("run_batches", "WITH r AS (SELECT 'b1' AS batch_id, count(*) AS rows FROM lineitem) SELECT * FROM r")(lambda s, d: derived(s, d).select("batch_id").join(s.createDataFrame([("b1", "{}")], "batch_id string, config_json string"), "batch_id").groupBy("batch_id").agg(F.count("*").alias("rows")))
