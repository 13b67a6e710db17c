"""Writers: compaction of worker logs, checkpoints, and text exports of small results."""

from __future__ import annotations

import json
import math
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.operators.derive import chain_std
from trialforge.operators.filters import dedup_keep_first
from trialforge.schema import EMBEDDINGS, GRAPHS, RUNS, UNIQUE, conform


def compile_batch(log: DataFrame, batch_id: str, config: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Star schema of a worker log: runs (first of each unique key), graphs, embeddings and the batch's counters.

    run_id is a hash of the unique key, so compiling again gives the same ids.
    """
    rows = log.withColumns({"batch_id": F.lit(batch_id), "graph_id": F.coalesce("graph_id", F.lit(0)), "success": F.coalesce("success", F.lit(False)), "is_valid": F.coalesce("is_valid", F.lit(False)), "chain_length_std": chain_std(F.coalesce("chain_lengths", F.array().cast("array<int>")))})
    rows = dedup_keep_first(rows, list(UNIQUE), ["wall_time", "status"])
    rows = rows.withColumn("run_id", F.sha2(F.concat_ws("|", F.lit(batch_id), *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in UNIQUE]), 256))
    runs = conform(rows, RUNS)
    graphs = conform(rows.dropDuplicates(["graph_id", "graph_name"]), GRAPHS)
    embeddings = conform(rows.where("success and embedding is not null"), EMBEDDINGS)
    each = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("SUCCESS", "INVALID_OUTPUT", "TIMEOUT", "CRASH", "FAILURE")]
    batches = runs.groupBy("batch_id").agg(F.count("*").alias("n_total"), *each).withColumn("config_json", F.lit(json.dumps(config or {})))
    return {"runs": runs, "graphs": graphs, "embeddings": embeddings, "batches": batches}


def write_batch(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet tables, runs by batch and topology; batches that are written again replace their own partitions only."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        keys = ["batch_id", "topology_name"] if name == "runs" else ["batch_id"] if "batch_id" in df.columns else []
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{name}")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def graph_json(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): node-link JSON of each graph, density to six places."""
    links = edges.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("u").alias("source"), F.col("v").alias("target"))).alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("u", "v"))))).alias("ids"))
    n, e = F.size("ids"), F.size("edges")
    body = F.struct(F.col("id"), F.col("name"), F.col("category"), n.alias("num_nodes"), e.alias("num_edges"), F.round(F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0), 6).alias("density"), F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("nodes"), F.col("edges").alias("edges")).alias("graph"))
    return graphs.join(links, graphs["id"] == links["graph_id"]).select("id", F.to_json(body).alias("value"))


def write_checkpoint(path: str, unfinished: list[dict[str, Any]], total: int, cancelled_at: str, resume_count: int = 0) -> None:
    body = {"unfinished_tasks": unfinished, "total_tasks": total, "completed_count": total - len(unfinished), "cancelled_at": cancelled_at, "resume_count": resume_count}
    with open(path + ".part", "w") as f:
        json.dump(body, f)
    os.replace(path + ".part", path)


def read_checkpoint(path: str) -> dict[str, Any] | None:
    return json.loads(open(path).read()) if os.path.exists(path) else None


def delete_checkpoint(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


def publish(staging: str, final: str, latest: str | None = None) -> str:
    """Move a finished folder into place (across file systems too), and point `latest` to it."""
    import shutil

    shutil.move(staging, final)
    if latest:
        if os.path.islink(latest):
            os.remove(latest)
        os.symlink(os.path.abspath(final), latest)
    return final


def _cell(value: Any, dash: str) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return dash
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def latex(df: DataFrame, caption: str = "") -> str:
    """A booktabs table of a small result; _ % & are escaped."""
    escape = lambda s: s.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{table}", r"\centering"] + ([rf"\caption{{{escape(caption)}}}"] if caption else []) + [rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", " & ".join(map(escape, df.columns)) + r" \\", r"\midrule"]
    lines += [" & ".join(escape(_cell(v, "—")) for v in row) + r" \\" for row in df.collect()]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"


def csv_text(df: DataFrame, digits: str | None = None) -> str:
    rows = [",".join(df.columns)]
    for row in df.collect():
        rows.append(",".join("" if v is None else (digits % v if digits and isinstance(v, float) else str(v)) for v in row))
    return "\n".join(rows) + "\n"


def write_if_absent(path: str, text: str, overwrite: bool = False) -> bool:
    """Whether the file was written; one that is there stays unless told otherwise."""
    if os.path.exists(path) and not overwrite:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return True


def key_value_text(values: dict[str, Any]) -> str:
    return "".join(f"{k}: {v}\n" for k, v in values.items())
