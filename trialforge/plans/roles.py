"""A runs-shaped frame over the driver's star schema, for the registered queries.

Orders, customers and parts are joined to their line items; the frame is lazy, so each query
reads only the columns that it needs. RUNS_SQL is the same frame for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.operators.derive import derive

TIMEOUT = 60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    ok = F.col("l_returnflag") == "A"
    late = F.col("l_linestatus") == "F"
    return joined.select(
        F.lit("b1").alias("batch_id"),
        F.col("c_mktsegment").alias("algorithm"),
        F.col("l_partkey").alias("graph_id"),
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("graph_name"),
        F.col("p_type").alias("category"),
        F.concat(F.col("o_orderpriority"), F.when(F.col("l_tax") > 0, F.concat(F.lit("@fr="), F.col("l_tax").cast("string"))).otherwise("")).alias("topology_name"),
        F.col("l_linenumber").alias("trial"),
        F.col("l_orderkey").alias("seed"),
        ok.alias("success"),
        F.when(ok, "SUCCESS").when(F.col("l_returnflag") == "N", F.when(late, "TIMEOUT").otherwise("FAILURE")).otherwise(F.when(late, "CRASH").otherwise("INVALID_OUTPUT")).alias("status"),
        (ok & (F.col("l_linestatus") == "O")).alias("is_valid"),
        (F.col("l_extendedprice") / 997).alias("wall_time"),
        F.col("l_quantity").alias("avg_chain_length"),
        F.ceil(F.col("l_quantity") * 1.5).cast("long").alias("max_chain_length"),
        (F.col("l_quantity") * F.col("p_size")).alias("total_qubits_used"),
        F.floor(F.col("l_quantity") * F.col("p_size") / 2).cast("long").alias("total_couplers_used"),
        F.col("p_size").cast("long").alias("problem_nodes"),
        F.floor(F.col("p_size") * (F.col("p_size") - 1) / 2).cast("long").alias("problem_edges"),
        ((F.col("p_partkey") % 10 + 1) / 10.0).cast("double").alias("problem_density"),
        F.when(~ok, "error").alias("error"),
    )


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(runs(spark, sf_dir), timeout=TIMEOUT)


def success_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).where("success")


RUNS_SQL = """runs AS (
    SELECT *, total_qubits_used / problem_nodes AS qubit_overhead_ratio,
           CASE WHEN problem_edges > 0 THEN total_couplers_used / problem_edges END AS coupler_overhead_ratio,
           max_chain_length / avg_chain_length AS max_to_avg_chain_ratio, wall_time >= 57.0 AS is_timeout
    FROM (
        SELECT c_mktsegment AS algorithm, l_partkey AS graph_id, 'g' || l_partkey AS graph_name, p_type AS category,
               o_orderpriority || CASE WHEN l_tax > 0 THEN '@fr=' || l_tax ELSE '' END AS topology_name, o_orderpriority AS base_topology, l_tax AS fault_rate,
               l_linenumber AS trial, l_orderkey AS seed, l_returnflag = 'A' AS success,
               CASE WHEN l_returnflag = 'A' THEN 'SUCCESS' WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'TIMEOUT' ELSE 'FAILURE' END
                    ELSE CASE WHEN l_linestatus = 'F' THEN 'CRASH' ELSE 'INVALID_OUTPUT' END END AS status,
               l_returnflag = 'A' AND l_linestatus = 'O' AS is_valid, l_extendedprice / 997 AS wall_time, l_quantity AS avg_chain_length,
               ceil(l_quantity * 1.5)::BIGINT AS max_chain_length, l_quantity * p_size AS total_qubits_used, floor(l_quantity * p_size / 2)::BIGINT AS total_couplers_used,
               p_size::BIGINT AS problem_nodes, (p_size * (p_size - 1) // 2)::BIGINT AS problem_edges, (p_partkey % 10 + 1) / 10.0::DOUBLE AS problem_density
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    )
)"""
