"""Registered queries of single columns, selections, catalogue look-ups, logs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialforge.functions import special
from trialforge.operators import catalog, derive, filters, graphs, pairwise, plotdata, tables, tasks
from trialforge.plans.more import EMB, MAN, manifest, target
from trialforge.plans.registry import query
from trialforge.plans.roles import derived, runs, table
from trialforge.sources import readers


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def part(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part")


# Columns.


def by_manifest(s: SparkSession, d: str) -> DataFrame:
    """Categories by the manifest's type where it knows the graph, else by name."""
    rows = runs(s, d).drop("category").withColumnRenamed("graph_name", "problem_name")
    known = manifest(s, d).where("id % 3 = 0").select("id", F.concat(F.lit("m_"), "type").alias("type"))
    return derive.derive(rows, known, 60.0).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("graph_name").alias("n_graphs"))


query("category_resolution", " SELECT CASE WHEN graph_id % 3 = 0 THEN 'm_' || category ELSE 'other' END AS category, count(*) AS n, count(DISTINCT graph_name) AS n_graphs FROM runs GROUP BY 1")(by_manifest)
query("legacy_defaults", " SELECT 0 AS graph_id, graph_name, count(*) AS n FROM runs GROUP BY graph_name")(
    lambda s, d: derive.derive(runs(s, d).drop("graph_id").withColumnRenamed("graph_name", "problem_name")).groupBy("graph_id", "graph_name").agg(F.count("*").alias("n"))
)
query("truth_values", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS flag FROM lineitem")(
    lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", derive.truth(F.when(F.col("l_returnflag") == "A", "True").when(F.col("l_returnflag") == "N", "0")).alias("flag"))
)
query("chain_deviation", "SELECT l_orderkey, round(coalesce(stddev_samp(l_quantity), 0), 7) AS chain_length_std FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: lines(s, d).groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("lengths")).select("l_orderkey", derive.chain_std(F.col("lengths")).alias("chain_length_std"))
)
query("problem_density", "SELECT p_partkey, round(CASE WHEN p_size > 1 THEN 2 * (p_partkey % 97) / (p_size * (p_size - 1)::DOUBLE) ELSE 0 END, 6) AS density FROM part")(
    lambda s, d: part(s, d).select("p_partkey", F.round(derive.density(F.col("p_size"), F.col("p_partkey") % 97), 6).alias("density"))
)
query("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")(
    lambda s, d: part(s, d).select("p_partkey", derive.slug(F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("!"))).alias("slug"))
)
query("directions", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < l_linenumber * 7 THEN 'a < b' WHEN l_quantity > l_linenumber * 7 THEN 'a > b' ELSE 'equal' END AS direction FROM lineitem")(
    lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", derive.direction(F.col("l_quantity"), F.col("l_linenumber") * 7).alias("direction"))
)
query("effect_words", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN '' WHEN l_quantity < 5 THEN 'negligible' WHEN l_quantity < 15 THEN 'small' WHEN l_quantity < 25 THEN 'medium' ELSE 'large' END AS magnitude FROM lineitem")(
    lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", derive.magnitude(F.when(F.col("l_quantity") <= 45, F.col("l_quantity") / 50)).alias("magnitude"))
)
query("significance_flags", "SELECT l_orderkey, l_linenumber, coalesce(p < 0.05, false) AS s1, coalesce(p < 0.01, false) AS s2, coalesce(p < 0.001, false) AS s3 FROM (SELECT *, CASE WHEN l_linenumber < 6 THEN l_discount * l_tax END AS p FROM lineitem)")(
    lambda s, d: lines(s, d).withColumn("p", F.when(F.col("l_linenumber") < 6, F.col("l_discount") * F.col("l_tax"))).select("l_orderkey", "l_linenumber", *[pairwise._flag(F.col("p"), a).alias(n) for n, a in (("s1", 0.05), ("s2", 0.01), ("s3", 0.001))])
)
query("fault_seeds", "SELECT o_orderkey, ('0x' || substr(sha256(o_orderpriority || ':0.05:' || o_custkey), 1, 8))::BIGINT AS seed, o_orderpriority || '@fr=0.05' AS topology_name FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", derive.seed_of(F.col("o_orderpriority"), F.lit("0.05"), F.col("o_custkey")).alias("seed"), F.concat("o_orderpriority", F.lit(derive.virtual_topology("", 0.05))).alias("topology_name"))
)
query("graph_jitter", "SELECT p_partkey, round((('0x' || substr(md5(p_name), 1, 8))::BIGINT / 4294967296 - 0.5) * 0.4, 7) AS jitter FROM part")(lambda s, d: part(s, d).select("p_partkey", derive.jitter(F.col("p_name")).alias("jitter")))
query("storage_folders", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'watts_strogatz_k' || p_size ELSE 'watts_strogatz_other' END AS folder FROM part")(
    lambda s, d: part(s, d).select("p_partkey", derive.storage_folder(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("watts_strogatz"), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("ws_n9_k"), F.col("p_size"), F.lit("_s1.json"))).otherwise("ws.json")).alias("folder"))
)
query("run_log_names", "SELECT p_partkey, replace(replace(p_type || '/x', '/', '_'), ' ', '_') || '__' || replace(replace(p_name, '/', '_'), ' ', '_') || '__' || p_size || '__' || p_partkey || '.log' AS file FROM part")(
    lambda s, d: part(s, d).select("p_partkey", derive.run_log_name(F.concat("p_type", F.lit("/x")), F.col("p_name"), F.col("p_size"), F.col("p_partkey")).alias("file"))
)
query("topology_tags", "SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN n <= 2048 AND e <= 6016 THEN 'chimera' END, CASE WHEN n <= 5640 AND e <= 40484 THEN 'pegasus' END, CASE WHEN n <= 4800 AND e <= 45864 THEN 'zephyr' END] IF x IS NOT NULL], '|') AS topologies, CASE WHEN n >= 0.85 * 5640 THEN 5 ELSE 3 END AS seeds FROM (SELECT p_partkey, p_size * 130 AS n, p_size * 1000 AS e FROM part)")(
    lambda s, d: part(s, d).select("p_partkey", derive.topology_tag(F.col("p_size") * 130, F.col("p_size") * 1000).alias("topologies"), derive.seed_count(F.col("p_size") * 130, 5640).alias("seeds"))
)
query("size_series", "SELECT unnest([4, 5, 6, 8, 10, 12, 15, 19, 24, 30]) AS n")(lambda s, d: s.createDataFrame([(n,) for n in derive.geometric_series(4, 30, 1.25)], "n int"))
query("flat_records", "SELECT l_orderkey, '{' || string_agg('\"' || l_linenumber || '\":[' || l_suppkey || ']', ',' ORDER BY l_linenumber) || '}' AS embedding FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")(
    lambda s, d: lines(s, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")).groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), F.array("l_suppkey"))))).alias("m")).select("l_orderkey", derive.flat_record(F.col("m")).alias("embedding"))
)
query("algorithm_styles", " SELECT algorithm, ((row_number() OVER (ORDER BY algorithm) - 1) % 6)::INT AS colour, ((row_number() OVER (ORDER BY algorithm) - 1) % 4)::INT AS marker FROM (SELECT DISTINCT algorithm FROM runs)")(lambda s, d: tables.styles(derived(s, d), 6, 4))

# Selections, sets and orders.


def selected(s: SparkSession, d: str) -> DataFrame:
    return part(s, d).where(filters.parse_selection("1-60, 80, !7, !20-25 & 1500–1600").condition("p_partkey")).select("p_partkey")


query("id_selection", "SELECT p_partkey FROM part WHERE (p_partkey BETWEEN 1 AND 60 OR p_partkey = 80 OR p_partkey BETWEEN 1500 AND 1600) AND p_partkey <> 7 AND NOT p_partkey BETWEEN 20 AND 25")(selected)
query("id_list", "SELECT i AS id FROM range(1, 13) t(i) WHERE i NOT IN (3, 8, 9)")(lambda s, d: s.createDataFrame([(i,) for i in sorted(filters.parse_selection("1-12,!3,!8-9").ids())], "id long"))
query("id_ranges", " SELECT graph_id, count(*) AS n FROM runs WHERE graph_id BETWEEN 10 AND 40 GROUP BY graph_id")(lambda s, d: derived(s, d).where(filters.view_predicate({"graph_id": "10-40"})).groupBy("graph_id").agg(F.count("*").alias("n")))
query("residual_filters", " SELECT category, base_topology, count(*) AS n FROM runs WHERE category IN ('PROMO', 'LARGE') AND base_topology <> '1-URGENT' GROUP BY ALL")(
    lambda s, d: derived(s, d).where(filters.view_predicate({"category": ["PROMO", "LARGE"], "base_topology": "!1-URGENT"})).groupBy("category", "base_topology").agg(F.count("*").alias("n"))
)
query("size_bounds", MAN + " SELECT id, name FROM m WHERE nodes >= 1 AND nodes <= 1 AND edges >= 1")(lambda s, d: filters.search_graphs(manifest(s, d), min_nodes=1, max_nodes=1, min_edges=1).select("id", "name"))
query("set_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")(
    lambda s, d: lines(s, d).where("l_returnflag = 'A' and l_quantity > 45").select("l_partkey").distinct().join(lines(s, d).where("l_returnflag = 'R' and l_quantity > 25").select("l_partkey").distinct(), "l_partkey", "left_anti")
)
query("algorithm_union", " SELECT DISTINCT algorithm FROM runs WHERE category = 'PROMO' UNION SELECT algorithm FROM runs WHERE category = 'LARGE'")(
    lambda s, d: derived(s, d).where("category = 'PROMO'").select("algorithm").union(derived(s, d).where("category = 'LARGE'").select("algorithm")).distinct()
)
query("ordered_runs", " SELECT topology_name, algorithm, graph_id, trial, seed FROM runs")(lambda s, d: derived(s, d).select("topology_name", "algorithm", "graph_id", "trial", "seed").orderBy("topology_name", "algorithm", "graph_id", "trial", "seed"))
query("rank_order", ", means AS (SELECT graph_name, algorithm, avg(avg_chain_length) AS value FROM runs WHERE success GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY graph_name) AS k FROM means), r AS (SELECT algorithm, rank() OVER (PARTITION BY graph_name ORDER BY value) + (count(*) OVER (PARTITION BY graph_name, value) - 1) / 2.0 AS r FROM n WHERE k >= 2) SELECT string_agg(algorithm, ' < ' ORDER BY m, algorithm) AS rank_order FROM (SELECT algorithm, avg(r) AS m FROM r GROUP BY algorithm)")(
    lambda s, d: pairwise.rank_order(tables.rank_table(derived(s, d)).select("algorithm", "mean_rank"))
)
query("first_few_failures", ", f AS (SELECT DISTINCT algorithm, graph_name FROM runs WHERE NOT success), r AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY graph_name) AS k FROM f) SELECT algorithm, string_agg(graph_name, ', ' ORDER BY graph_name) FILTER (WHERE k <= 5) || CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END AS shown FROM r GROUP BY algorithm")(
    lambda s, d: tables.first_few(derived(s, d).where("not success"), ["algorithm"], "graph_name")
)
query("transposed_summary", " SELECT 'n_success' AS name, " + ", ".join(f"(count(*) FILTER (WHERE success AND algorithm = '{a}'))::DOUBLE AS \"{a}\"" for a in ("AUTOMOBILE", "BUILDING", "FURNITURE")) + " FROM runs UNION ALL SELECT 'n_trials', " + ", ".join(f"(count(*) FILTER (WHERE algorithm = '{a}'))::DOUBLE" for a in ("AUTOMOBILE", "BUILDING", "FURNITURE")) + " FROM runs")(
    lambda s, d: tables.transposed(derived(s, d).groupBy("algorithm").agg(F.count("*").alias("n_trials"), F.count_if("success").alias("n_success")), "algorithm", ["n_trials", "n_success"], ["AUTOMOBILE", "BUILDING", "FURNITURE"])
)
query("attempts_with_patience", """WITH RECURSIVE a AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS attempt, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS value FROM lineitem),
 w AS (SELECT l_suppkey, attempt, value, value AS best, 0::BIGINT AS stalled FROM a WHERE attempt = 1
  UNION ALL SELECT a.l_suppkey, a.attempt, a.value, least(w.best, a.value), CASE WHEN a.value IS NULL THEN w.stalled WHEN w.best IS NULL OR a.value < w.best THEN 0 ELSE w.stalled + 1 END
  FROM w JOIN a ON a.l_suppkey = w.l_suppkey AND a.attempt = w.attempt + 1 WHERE w.stalled < 4) SELECT * FROM w""")(
    lambda s, d: tasks.attempts_with_patience(lines(s, d).select("l_suppkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).cast("long").alias("attempt"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("value")), ["l_suppkey"], 4)
)

# Catalogue and files.

query("manifest_by_id", MAN + " SELECT t.i AS id, name, type, nodes FROM range(0, 5000, 7) t(i) LEFT JOIN m ON m.id = t.i")(lambda s, d: catalog.by_id(manifest(s, d), s.range(0, 5000, 7)).select("id", "name", "type", "nodes"))
query("manifest_by_name", MAN + ", n AS (SELECT DISTINCT p_brand AS name FROM part UNION ALL SELECT 'none') SELECT n.name, x.id, type FROM n LEFT JOIN (SELECT name, max(id) AS id FROM m GROUP BY name) x ON x.name = n.name LEFT JOIN m ON m.id = x.id")(
    lambda s, d: catalog.by_name(manifest(s, d), part(s, d).select(F.col("p_brand").alias("name")).distinct().union(s.createDataFrame([("none",)], "name string"))).select("name", "id", "type")
)


def files(s: SparkSession, d: str) -> DataFrame:
    return part(s, d).where("p_partkey % 5 <> 0").select(F.concat(F.col("p_partkey"), F.lit("_"), F.col("p_brand"), F.lit(".json")).alias("file"), (F.col("p_size") * 100).cast("long").alias("sz"), F.sha2(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise("")), 256).alias("hash"))


def hashed(s: SparkSession, d: str) -> DataFrame:
    full = F.sha2("p_name", 256)
    return part(s, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.substring(full, 1, 16)).otherwise(full).alias("hash"))


query("cache_summary", "SELECT p_type AS type, count(*) AS files, sum(p_size * 100)::BIGINT AS bytes FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_type")(lambda s, d: catalog.cache_summary(manifest(s, d), files(s, d)))
query("file_states", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 AND p_partkey % 4 <> 0 THEN 'corrupt' ELSE 'ok' END AS state FROM part")(lambda s, d: readers.verify_files(hashed(s, d), files(s, d)))
query("completed_keys", " SELECT DISTINCT algorithm, graph_id, topology_name, seed FROM runs WHERE success")(lambda s, d: readers.completed_keys(runs(s, d).where("success")).distinct())

# Graphs and statistics.

query("removed_parts", EMB + " SELECT 'coupler' AS kind, u, v FROM t WHERE u % 10 = 3 OR v % 10 = 3 UNION ALL SELECT 'node', i, NULL FROM range(1, 3000) x(i) WHERE i % 10 = 3")(
    lambda s, d: graphs.removed_parts(s.range(1, 3000).withColumnRenamed("id", "node"), target(s, d), s.range(1, 3000).where("id % 10 <> 3").withColumnRenamed("id", "node"), target(s, d).where("u % 10 <> 3 and v % 10 <> 3"))
)
query("success_rate_grid", """, r AS (SELECT max(greatest(problem_nodes, 1)) AS hi, min(greatest(problem_nodes, 1)) AS lo FROM runs), k AS (SELECT lo, hi, greatest(10, least(40, floor(log2(hi / lo) * 4)))::INT AS n FROM r),
 e AS (SELECT list_sort(list_distinct(list_append([floor(lo * pow((hi + 1) / lo, i / n::DOUBLE))::BIGINT FOR i IN range(0, n)], hi + 1))) AS edges FROM k),
 p AS (SELECT success, len([x FOR x IN edges IF x < problem_nodes]) - 1 AS size_bin, (ceil(round(problem_density / 0.05, 9)) - 1)::BIGINT AS density_bin FROM runs, e)
 SELECT size_bin, density_bin, round(avg(success::INT), 7) AS value, count(*) AS n FROM p WHERE size_bin >= 0 AND density_bin >= 0 GROUP BY ALL""")(
    lambda s, d: plotdata.size_density_grid(derived(s, d), "success_rate", log=True)
)
query("nemenyi_distances", "SELECT k, round(q * sqrt(k * (k + 1) / (6.0 * 50)), 7) AS distance FROM (SELECT unnest([3, 4, 5, 10, 12]) AS k, unnest([2.343, 2.569, 2.728, 3.164, 3.268]) AS q) UNION ALL SELECT 13, NULL")(
    lambda s, d: s.createDataFrame([(k, special.nemenyi_distance(k, 50)) for k in (3, 4, 5, 10, 12, 13)], "k int, distance double")
)
query("chimera_sizes", "SELECT m, n, 8 * m * n AS nodes, 16 * m * n + 4 * ((m - 1) * n + m * (n - 1)) AS edges FROM (SELECT unnest([1, 2, 4, 16]) AS m, unnest([1, 3, 4, 16]) AS n)")(
    lambda s, d: s.createDataFrame([(*graphs.chimera_dimensions(8 * m * n, 16 * m * n + 4 * ((m - 1) * n + m * (n - 1)), 4), 8 * m * n, 16 * m * n + 4 * ((m - 1) * n + m * (n - 1))) for m, n in ((1, 1), (2, 3), (4, 4), (16, 16))], "m int, n int, nodes int, edges int")
)
