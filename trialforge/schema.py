"""Typed star schema: runs, batches, graphs, embeddings, worker records, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(),
    "array<int>": ArrayType(IntegerType()), "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType()),
    "map<string,array<int>>": MapType(StringType(), ArrayType(IntegerType())),
}


def _schema(text: str) -> StructType:
    """Columns as 'name type, ...'; needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split(" ", 1) for c in text.strip().split(", "))])


RUNS = _schema(
    "run_id string, batch_id string, algorithm string, algorithm_version string, graph_id int, graph_name string, topology_name string, trial int, seed bigint, "
    "wall_time double, cpu_time double, status string, success boolean, is_valid boolean, partial boolean, avg_chain_length double, max_chain_length int, chain_length_std double, "
    "total_qubits_used int, total_couplers_used int, problem_nodes int, problem_edges int, problem_density double, "
    "target_node_visits bigint, cost_function_evaluations bigint, embedding_state_mutations bigint, overlap_qubit_iterations bigint, error string, created_at string"
)
BATCHES = _schema("batch_id string, config_json string, started_at string, completed_at string, n_total bigint, n_success bigint, n_invalid_output bigint, n_timeout bigint, n_crash bigint, n_failure bigint")
GRAPHS = _schema("graph_id int, graph_name string, problem_nodes int, problem_edges int, problem_density double")
EMBEDDINGS = _schema("run_id string, embedding map<string,array<int>>")
SUSPENSIONS = _schema("batch_id string, suspended_at string, resumed_at string, reason string")
LAYER4_FLAGS = _schema("run_id string, flag string, detail string")
WORKER_RECORD = _schema(
    "algorithm string, graph_name string, problem_name string, graph_id int, topology_name string, trial int, success boolean, status string, wall_time double, cpu_time double, is_valid boolean, "
    "embedding map<string,array<int>>, chain_lengths array<int>, max_chain_length int, avg_chain_length double, total_qubits_used int, total_couplers_used int, problem_nodes int, problem_edges int, "
    "problem_density double, algorithm_version string, partial boolean, error string, metadata string, target_node_visits bigint, cost_function_evaluations bigint, embedding_state_mutations bigint, "
    "overlap_qubit_iterations bigint, seed bigint, batch_id string"
)
MANIFEST_ENTRY = _schema("id int, name string, type string, category string, n int, nodes int, e int, edges int, d double, density double, h string, hash string, sz bigint, p map<string,string>, topo array<string>, topologies array<string>")

REQUIRED = ("algorithm", "graph_name", "topology_name", "trial", "success", "is_valid", "wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used", "total_couplers_used", "problem_nodes", "problem_edges", "problem_density", "error")
UNIQUE = ("algorithm", "graph_id", "graph_name", "topology_name", "trial", "seed")
STATUSES = ("SUCCESS", "INVALID_OUTPUT", "TIMEOUT", "CRASH", "OOM", "FAILURE")
METRICS = ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used", "total_couplers_used")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of the schema, missing ones as typed nulls."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def check_metric(df: DataFrame, metric: str) -> str:
    if metric not in df.columns:
        raise ValueError(f"no such metric: {metric}")
    return metric
