"""Summary tables over runs. Quality metrics look at successful rows, rates at all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.operators import order
from trialforge.schema import METRICS, check_metric
from trialforge.sources.shared import cut

PROBLEM = "graph_name"


def share(c: Column | str) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("int"))


def _ok(metric: str) -> Column:
    return F.when(F.col("success"), F.col(metric))


def overall_summary(runs: DataFrame) -> DataFrame:
    """One row for each algorithm: counts and rates of all rows, moments of successful ones."""
    aggs = [F.count("*").alias("n_trials"), F.count_if("success").alias("n_success"), share("success").alias("success_rate"), share("is_valid").alias("valid_rate")]
    for metric, name in (("wall_time", "time"), ("avg_chain_length", "chain")):
        aggs += [F.avg(_ok(metric)).alias(f"{name}_mean"), F.stddev_samp(_ok(metric)).alias(f"{name}_std")]
    aggs += [F.try_divide(F.stddev_samp(_ok("wall_time")), F.avg(_ok("wall_time"))).alias("cv_time")]
    aggs += [F.avg(_ok("max_chain_length")).alias("max_chain_mean"), F.stddev_samp(_ok("max_chain_length")).alias("max_chain_std")]
    aggs += [F.avg(_ok(c)).alias(n) for c, n in (("total_qubits_used", "qubits_mean"), ("qubit_overhead_ratio", "qubit_overhead_mean"), ("coupler_overhead_ratio", "coupler_overhead_mean"))]
    middle = order.medians(runs, ["algorithm"], {"time_median": _ok("wall_time"), "chain_median": _ok("avg_chain_length")})
    return runs.groupBy("algorithm").agg(*aggs).join(middle, "algorithm", "left")


def summary_by_category(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    check_metric(runs, metric)
    return runs.where("success").groupBy("algorithm", "category").agg(F.avg(metric).alias("mean_value"))


def pivot_categories(long: DataFrame, categories: list[str], value: str = "mean_value") -> DataFrame:
    """Wide form; the category list is explicit, so no extra job looks for it."""
    return long.groupBy("algorithm").pivot("category", categories).agg(F.first(value))


def per_problem_means(runs: DataFrame, metric: str = "avg_chain_length", by: str = PROBLEM) -> DataFrame:
    check_metric(runs, metric)
    return runs.where("success").groupBy(by, "algorithm").agg(F.avg(metric).alias("value"))


def average_ranks(values: DataFrame, keys: list[str], lower: bool = True) -> DataFrame:
    """Ranks within keys, ties sharing the mean rank; null values have none."""
    order = F.col("value").asc() if lower else F.col("value").desc()
    tied = Window.partitionBy(*keys, "value")
    ranked = F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(tied) - 1) / 2.0
    return values.where("value is not null").withColumn("rank", ranked)


def rank_table(runs: DataFrame, metric: str = "avg_chain_length", lower: bool = True) -> DataFrame:
    """Mean ranks over the problems that at least two algorithms solved."""
    means = per_problem_means(runs, metric).withColumn("_n", F.count("*").over(Window.partitionBy(PROBLEM))).where("_n >= 2")
    return average_ranks(means, [PROBLEM], lower).groupBy("algorithm").agg(F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.stddev_samp("rank").alias("std_rank"), F.count("*").alias("n_problems_ranked")).orderBy("mean_rank", "algorithm")


def density_hardness(runs: DataFrame, metric: str = "avg_chain_length", categories: tuple[str, ...] = ("random",)) -> DataFrame:
    rows = runs.where(F.col("success") & F.col("category").isin(*categories))
    return rows.groupBy("algorithm", "problem_nodes", "problem_density").agg(F.avg(metric).alias("mean_value"), F.stddev_samp(metric).alias("std_value"), F.count("*").alias("n")).orderBy("algorithm", "problem_nodes", "problem_density")


def batch_summary(runs: DataFrame) -> DataFrame:
    """By algorithm, graph and topology; deviations of single rows are 0, valid rate is over successes."""
    aggs = [F.count("*").alias("n_trials"), F.count_if("success").alias("n_success"), share("success").alias("success_rate")]
    for m in METRICS:
        aggs += [F.avg(_ok(m)).alias(f"{m}_mean"), F.when(F.count_if("success") > 0, F.coalesce(F.stddev_samp(_ok(m)), F.lit(0.0))).alias(f"{m}_std"), F.median(_ok(m)).alias(f"{m}_median")]
    aggs += [F.coalesce(F.avg(F.when(F.col("success"), F.col("is_valid").cast("int"))), F.lit(0.0)).alias("valid_rate")]
    aggs += [F.min(c).alias(c) for c in ("graph_name", "problem_nodes", "problem_edges", "problem_density")]
    return runs.groupBy("algorithm", "graph_id", "topology_name").agg(*aggs)


def batch_counters(runs: DataFrame) -> DataFrame:
    """Rows of each batch by status (OOM isn't counted apart)."""
    each = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("SUCCESS", "INVALID_OUTPUT", "TIMEOUT", "CRASH", "FAILURE")]
    return runs.groupBy("batch_id").agg(F.count("*").alias("n_total"), *each)


def timing_outliers(runs: DataFrame, factor: float = 10.0) -> DataFrame:
    """Successful rows over `factor` medians of their algorithm and topology, where there are two at least."""
    ok = runs.where("success")
    keys = ["algorithm", "topology_name"]
    medians = order.exact_quantiles(ok, keys, {"wall_time": F.col("wall_time")}).where("n >= 2").select(*keys, F.col("q")[0].alias("_median"))
    return ok.join(medians, keys).groupBy(*keys).agg(F.count_if(F.col("wall_time") > factor * F.col("_median")).alias("n_outliers")).where("n_outliers > 0")


def all_failed(runs: DataFrame) -> DataFrame:
    """(graph, topology) that no algorithm solved; the topology is named where there are several."""
    several = runs.agg((F.min("topology_name") != F.max("topology_name")).alias("_several"))
    rows = runs.groupBy(PROBLEM, "topology_name").agg(F.bool_or("success").alias("_any")).where("not _any").drop("_any")
    label = F.when(F.lit(bool(several.head()[0])), F.concat(F.col(PROBLEM), F.lit(" ["), F.col("topology_name"), F.lit("]"))).otherwise(F.col(PROBLEM))
    return rows.withColumn("label", label).orderBy(PROBLEM, "topology_name")


def inflight_counters(runs: DataFrame) -> DataFrame:
    """Invalid outputs and crashes of each algorithm, with the first error by (graph, topology, trial, seed)."""
    order = F.struct("graph_name", "topology_name", "trial", "seed")
    crash = F.col("status") == "CRASH"
    return runs.groupBy("algorithm").agg(F.count_if(F.col("status") == "INVALID_OUTPUT").alias("n_invalid"), F.count_if(crash).alias("n_crash"), F.min_by(F.when(crash, F.col("error")), F.when(crash, order)).alias("first_error"))


def warning_summary(runs: DataFrame, skipped: dict[str, DataFrame] | None = None) -> DataFrame:
    """Counts of each kind of warning and their total. skipped: tables of tasks that never ran, by kind."""
    kinds = {
        "INVALID_OUTPUT": runs.where("status = 'INVALID_OUTPUT'").agg(F.count("*").alias("n")),
        "CRASH": runs.where("status = 'CRASH'").agg(F.count("*").alias("n")),
        "TIMING_OUTLIER": timing_outliers(runs).agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n")),
        "ALL_ALGORITHMS_FAILED": all_failed(runs).agg(F.count("*").alias("n")),
    }
    kinds |= {kind: tasks.agg(F.count("*").alias("n")) for kind, tasks in (skipped or {}).items()}
    rows = None
    for kind, n in kinds.items():
        one = n.select(F.lit(kind).alias("kind"), F.col("n").cast("long").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.rollup("kind").agg(F.sum("n").alias("n")).select(F.coalesce("kind", F.lit("TOTAL")).alias("kind"), "n")


def correlation_matrix(runs: DataFrame, method: str = "spearman", properties: tuple[str, ...] = ("problem_nodes", "problem_edges", "problem_density"), metrics: tuple[str, ...] = ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used")) -> DataFrame:
    """Property by metric over successful rows; null below three rows or without variance.

    Average ranks come from counts of each distinct value, summed over range partitions.
    """
    rows = runs.where("success").select(*properties, *metrics)
    if method == "spearman":
        rows = rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns])
        ranks = cut(order.average_rank_table(rows, [*properties, *metrics]), "ranks")
        for c in (*properties, *metrics):
            one = ranks.where(F.col("metric") == c).select(F.col("value").alias("_v"), F.col("rank").alias("_r"))
            rows = rows.join(one, F.col(c) == F.col("_v"), "left").drop(c, "_v").withColumnRenamed("_r", c)
    pairs = [(p, m) for p in properties for m in metrics]
    sums = []
    for p, m in pairs:
        both = F.col(p).isNotNull() & F.col(m).isNotNull()
        x, y = F.when(both, F.col(p).cast("double")), F.when(both, F.col(m).cast("double"))
        sums.append(F.struct(F.lit(p).alias("property"), F.lit(m).alias("metric"), F.count(x).alias("n"), F.covar_pop(x, y).alias("cov"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")).alias(f"{p}:{m}"))
    one = rows.agg(*sums)
    long = one.select(F.explode(F.array(*[F.col(f"`{p}:{m}`") for p, m in pairs])).alias("s")).select("s.*")
    r = F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    return long.select("property", "metric", r.alias("correlation"))


def headline(runs: DataFrame) -> DataFrame:
    """Counts with mean and population deviation of time, by algorithm."""
    return runs.groupBy("algorithm").agg(F.count("*").alias("n_trials"), F.count_if("success").alias("n_success"), F.avg(_ok("wall_time")).alias("time_mean"), F.stddev_pop(_ok("wall_time")).alias("time_std"))


def transposed(wide: DataFrame, key: str, columns: list[str], rows: list[str]) -> DataFrame:
    """Columns as rows and the named keys as columns."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = wide.select(key, F.expr(f"stack({len(columns)}, {pairs}) as (name, value)"))
    return long.groupBy("name").pivot(key, rows).agg(F.first("value"))


def first_few(rows: DataFrame, keys: list[str], column: str, most: int = 5) -> DataFrame:
    """The least `most` values of each key joined by commas, with an ellipsis where there are more."""
    ranked = rows.select(*keys, column).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(column))).where(F.col("_r") <= most + 1)
    some = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias("_v"))
    return some.select(*keys, F.concat(F.array_join(F.slice("_v", 1, most), ", "), F.when(F.size("_v") > most, ", ...").otherwise("")).alias("shown"))


def styles(runs: DataFrame, colours: int, markers: int) -> DataFrame:
    """Number of the colour and the marker of each algorithm, by its place among the names; few algorithms exist."""
    place = F.row_number().over(Window.orderBy("algorithm")) - 1
    return runs.select("algorithm").distinct().select("algorithm", (place % colours).alias("colour"), (place % markers).alias("marker"))
