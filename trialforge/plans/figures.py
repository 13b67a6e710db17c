"""Registered queries of figures by trial and by algorithm, of skipped tasks, and of runs with empty chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.operators import graphs, plotdata, tables
from trialforge.plans.more import chains, source_edges, source_nodes, target
from trialforge.plans.registry import FAILED, ORACLES, OUTLIERS, POSITIONS, query
from trialforge.plans.roles import derived, table

query("graph_indexed_points", POSITIONS + """, ok AS (SELECT * FROM runs WHERE success),
 m AS (SELECT algorithm, graph_id, graph_name, avg(avg_chain_length) AS v, min(problem_nodes) AS problem_nodes, min(problem_density) AS problem_density FROM ok GROUP BY ALL)
 SELECT algorithm, graph_id, graph_name, topology_name, trial, seed, round(avg_chain_length, 7) AS value, pos.category, position, m.problem_nodes, m.problem_density, round(v, 7) AS mean_value
 FROM ok JOIN m USING (algorithm, graph_id, graph_name) JOIN pos USING (graph_id, graph_name)""")(lambda s, d: plotdata.graph_indexed_points(derived(s, d)))  # fmt: skip

query("success_grid_by_algorithm", """, r AS (SELECT max(greatest(problem_nodes, 1)) AS hi, min(greatest(problem_nodes, 1)) AS lo FROM runs), k AS (SELECT lo, hi, greatest(10, least(40, floor(log2(hi / lo) * 4)))::INT AS n FROM r),
 e AS (SELECT list_sort(list_distinct(list_append([floor(lo * pow((hi + 1) / lo, i / n::DOUBLE))::BIGINT FOR i IN range(0, n)], hi + 1))) AS edges FROM k),
 p AS (SELECT algorithm, success, len([x FOR x IN edges IF x < problem_nodes]) - 1 AS size_bin, (ceil(round(problem_density / 0.05, 9)) - 1)::BIGINT AS density_bin FROM runs, e),
 c AS (SELECT algorithm, size_bin, density_bin, avg(success::INT) AS value, count(*) AS n FROM p WHERE size_bin >= 0 AND density_bin >= 0 GROUP BY ALL)
 SELECT algorithm, size_bin, density_bin, round(value, 7) AS value, n, 0.0::DOUBLE AS v_min, 1.0::DOUBLE AS v_max, max(size_bin) OVER () AS x_max FROM c""")(
    lambda s, d: plotdata.grid_by_algorithm(derived(s, d), "success_rate", log=True))


# Tasks that never ran: pairs of algorithm and topology, and graphs too large for a topology.
ROOM = [("chimera_16x16x4", 2048), ("zephyr_12", 4800), ("pegasus_16", 5640)]


def skipped(s: SparkSession, d: str) -> dict[str, DataFrame]:
    runs = derived(s, d)
    pairs = runs.where("algorithm in ('BUILDING', 'MACHINERY') and base_topology >= '4'").select("algorithm", "topology_name").distinct()
    room = s.createDataFrame(ROOM, "topology_name string, most_nodes int")
    large = table(s, d, "part").select("p_partkey", (F.col("p_size") * 130).alias("nodes")).join(F.broadcast(room), F.col("nodes") > F.col("most_nodes"))
    return {"TOPOLOGY_INCOMPATIBLE": pairs, "GRAPH_TOPOLOGY_INCOMPATIBLE": large}


query("warning_summary_with_skips", OUTLIERS.format(f="10.0::DOUBLE") + FAILED + """, kinds AS (SELECT 'INVALID_OUTPUT' AS kind, count(*) FILTER (status = 'INVALID_OUTPUT') AS n FROM runs UNION ALL SELECT 'CRASH', count(*) FILTER (status = 'CRASH') FROM runs
 UNION ALL SELECT 'TIMING_OUTLIER', coalesce(sum(n_outliers), 0) FROM outliers UNION ALL SELECT 'ALL_ALGORITHMS_FAILED', count(*) FROM failed
 UNION ALL SELECT 'TOPOLOGY_INCOMPATIBLE', count(*) FROM (SELECT DISTINCT algorithm, topology_name FROM runs WHERE algorithm IN ('BUILDING', 'MACHINERY') AND base_topology >= '4')
 UNION ALL SELECT 'GRAPH_TOPOLOGY_INCOMPATIBLE', count(*) FROM part, (VALUES (2048), (4800), (5640)) t(most) WHERE p_size * 130 > most)
 SELECT coalesce(kind, 'TOTAL') AS kind, sum(n)::BIGINT AS n FROM kinds GROUP BY ROLLUP (kind)""")(lambda s, d: tables.warning_summary(derived(s, d), skipped(s, d)))  # fmt: skip


def validated(s: SparkSession, d: str) -> DataFrame:
    """Every eleventh run has an empty chain for its third vertex."""
    nodes = source_nodes(s, d).where("src < 8")
    emptied = (F.col("run_id") % 11 == 4) & (F.col("src") == 3)
    return graphs.validate(nodes, source_edges(s, d).where("v < 8"), chains(s, d).where(~emptied), nodes.where(emptied), target(s, d))


_sql = ORACLES["validation"].replace("FROM lineitem),\n", "FROM lineitem WHERE NOT (l_orderkey % 500 % 11 = 4 AND l_linenumber = 3)),\n", 1)
_sql = _sql.replace("AND c.src = s.src)\n", "AND c.src = s.src) AND NOT (r.run_id % 11 = 4 AND s.src = 3)\n  UNION ALL SELECT run_id, 1 FROM r WHERE run_id % 11 = 4\n", 1)
query("validation_of_empty_chains", _sql)(validated)