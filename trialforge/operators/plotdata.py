"""The data of each figure as a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.operators.derive import FAMILIES, family_of, success_label
from trialforge.operators import order
from trialforge.operators.tables import PROBLEM, share

RATES = ("success_rate", "wall_time")


def _cells(runs: DataFrame, metric: str, keys: list[str], by: list[str]) -> DataFrame:
    """Means by algorithm and keys: rates and times over all rows, other metrics over successes."""
    if metric == "success_rate":
        return runs.groupBy(*by).agg(share("success").alias("value"))
    rows = runs if metric == "wall_time" else runs.where("success")
    return rows.groupBy(*by).agg(F.avg(metric).alias("value"))


def category_heatmap(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    """algorithm, category, value for a metric, success_rate, wall_time, relative_time or win_rate."""
    if metric == "win_rate":
        return category_win_rate(runs)
    if metric == "relative_time":
        means = _cells(runs, "wall_time", ["category"], ["algorithm", "category"])
        return means.withColumn("value", F.try_divide("value", F.nullif(F.min("value").over(Window.partitionBy("category")), F.lit(0.0))))
    return _cells(runs, metric, ["category"], ["algorithm", "category"])


def graph_winners(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    """The best successful row of each graph; ties go by topology, algorithm and trial."""
    order = F.struct(metric, "topology_name", "algorithm", "trial", "seed")
    return runs.where("success").groupBy("graph_id", "graph_name", "category").agg(F.min_by("algorithm", order).alias("algorithm"))


def category_win_rate(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    """Graphs won over solved graphs of the category; algorithms without wins have 0."""
    winners = graph_winners(runs, metric)
    totals = winners.groupBy("category").agg(F.count("*").alias("total"))
    wins = winners.groupBy("algorithm", "category").agg(F.count("*").alias("wins"))
    grid = runs.select("algorithm").distinct().join(F.broadcast(totals), F.lit(True))  # a few algorithms, a few categories
    return grid.join(wins, ["algorithm", "category"], "left").select("algorithm", "category", (F.coalesce("wins", F.lit(0)) / F.col("total")).alias("value"))


def family_heatmap(runs: DataFrame, metric: str = "avg_chain_length", families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The category heat map, with each category's family; categories without one are left out."""
    family = family_of(F.col("category")) if families is None else _mapped(F.col("category"), families)
    return category_heatmap(runs, metric).withColumn("family", family).where("family is not null")


def _mapped(category: Column, families: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for name, members in families.items():
        out = (F if out is None else out).when(category.isin(*members), name)
    return out


def family_summary(runs: DataFrame, metric: str = "avg_chain_length", families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Mean of the category means by family; win_rate counts graphs; relative_time is over the family's least."""
    families = families or FAMILIES
    if metric == "win_rate":
        winners = graph_winners(runs).withColumn("family", _mapped(F.col("category"), families)).where("family is not null")
        totals = winners.groupBy("family").agg(F.count("*").alias("total"))
        return winners.groupBy("algorithm", "family").agg(F.count("*").alias("wins")).join(totals, "family").select("algorithm", "family", (F.col("wins") / F.col("total")).alias("value"))
    cells = family_heatmap(runs, "wall_time" if metric == "relative_time" else metric, families)
    out = cells.groupBy("algorithm", "family").agg(F.avg("value").alias("value"))
    if metric == "relative_time":
        out = out.withColumn("value", F.try_divide("value", F.nullif(F.min("value").over(Window.partitionBy("family")), F.lit(0.0))))
    return out


def scaling_trend(runs: DataFrame, x: str = "problem_nodes", metric: str = "wall_time", bins: int = 40, include_lowest: bool = False) -> DataFrame:
    """Mean and deviation of a metric in right-closed bins of x, by algorithm. Rows on the lowest edge have no bin unless asked for."""
    rows = runs.where("success").select("algorithm", F.col(x).cast("double").alias("x"), F.col(metric).alias("y"))
    span = rows.groupBy("algorithm").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = span.withColumn("width", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / bins)).cast("double"))
    k = F.ceil((F.col("x") - F.col("lo")) / F.col("width")) - 1
    placed = rows.join(F.broadcast(span), "algorithm").withColumn("bin", F.greatest(k, F.lit(0)) if include_lowest else k).where("bin >= 0")
    return placed.groupBy("algorithm", "bin").agg((F.min("lo") + (F.col("bin") + 0.5) * F.min("width")).alias("x_mid"), F.avg("y").alias("mean_value"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std_value"), F.count("*").alias("n"))


def density_lines(runs: DataFrame, metric: str = "avg_chain_length", categories: tuple[str, ...] = ("random",)) -> DataFrame:
    return runs.where(F.col("success") & F.col("category").isin(*categories)).groupBy("algorithm", "problem_nodes", "problem_density").agg(F.avg(metric).alias("mean_value"))


def log_edges(lo: int | None, hi: int | None) -> list[int]:
    """Whole-numbered edges of node bins in equal ratios, 10 to 40 of them, four for each doubling."""
    lo = max(1, int(lo or 1))
    hi = max(lo, int(hi or lo))
    if hi == lo:
        return [lo, hi + 1]
    n = max(10, min(40, int(math.log2(hi / lo) * 4)))
    edges = sorted({int(lo * ((hi + 1) / lo) ** (k / n)) for k in range(n)} | {hi + 1})
    return edges if len(edges) > 1 else [lo, hi + 1]


def size_density_grid(runs: DataFrame, metric: str = "avg_chain_length", nodes: int = 10, step: float = 0.05, by: list[str] | None = None, log: bool = False) -> DataFrame:
    """Mean in bins of nodes and density (right-closed from the least size; rows without a bin go).

    Rates and times over all rows have node bins in log steps if `log` is set.
    """
    rows = runs if metric in RATES else runs.where("success")
    value = share("success") if metric == "success_rate" else F.avg(metric)
    lo = rows.agg(F.min("problem_nodes")).head()[0] or 0
    x = F.ceil((F.col("problem_nodes") - lo) / float(nodes)).cast("long") - 1
    if log and metric in RATES:
        edges = log_edges(*rows.agg(F.min("problem_nodes"), F.max("problem_nodes")).head())
        # the first edge of at least the size closes its bin
        x = F.coalesce(*[F.when(F.col("problem_nodes") <= e, F.lit(k - 1)) for k, e in enumerate(edges)]).cast("long")
    y = F.ceil(F.round(F.col("problem_density") / step, 9)).cast("long") - 1
    placed = rows.withColumns({"size_bin": x, "density_bin": y}).where("size_bin >= 0 and density_bin >= 0")
    return placed.groupBy(*(by or []), "size_bin", "density_bin").agg(value.alias("value"), F.count("*").alias("n"))


def grid_by_algorithm(runs: DataFrame, metric: str = "avg_chain_length", log: bool = False) -> DataFrame:
    """A grid for each algorithm with the limits that all share (0 and 1 for rates); log: node bins in equal ratios for rates."""
    grid = size_density_grid(runs, metric, by=["algorithm"], log=log)
    every = Window.partitionBy()
    lo, hi = (F.lit(0.0), F.lit(1.0)) if metric == "success_rate" else (F.min("value").over(every), F.max("value").over(every))
    return grid.withColumns({"v_min": lo, "v_max": hi, "x_max": F.max("size_bin").over(every)})


def smoothed(grid: DataFrame, sigma: float = 1.0, least: float = 0.05) -> DataFrame:
    """Gaussian smoothing of a grid that ignores empty cells: G(z w) / G(w), null where the weight is at most `least`.

    Cells are spread over their kernel (4 sigma) and summed by target cell; the kernel is
    reflected at the edges of the grid.
    """
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    total = sum(weights)
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w")) for d, w in zip(range(-reach, reach + 1), weights)])
    box = grid.agg(F.min("size_bin"), F.max("size_bin"), F.min("density_bin"), F.max("density_bin")).head()
    out = grid.select("size_bin", "density_bin", "value", F.lit(1.0).alias("w"))
    for c, (lo, hi) in (("size_bin", box[:2]), ("density_bin", box[2:])):
        if lo is None:
            return out.select("size_bin", "density_bin", "value")
        n = hi - lo + 1
        # a target at t takes from s = t + d, reflected into the grid; every target within reach of s is tried
        # images of s under reflection repeat every 2 n places
        turns = reach // (2 * n) + 1
        spread = out.withColumn("tap", F.explode(taps)).withColumn("k", F.explode(F.sequence(F.lit(-turns), F.lit(turns))))
        at = F.col(c) - lo
        spread = spread.withColumn("image", F.explode(F.array(at, -at - 1))).withColumn("t", F.col("image") + 2 * n * F.col("k") - F.col("tap.d")).where((F.col("t") >= 0) & (F.col("t") < n))
        other = "density_bin" if c == "size_bin" else "size_bin"
        scaled = spread.select((F.col("t") + lo).alias(c), other, (F.col("value") * F.col("w") * F.col("tap.w") if c == "size_bin" else F.col("value") * F.col("tap.w")).alias("value"), (F.col("w") * F.col("tap.w")).alias("w"))
        out = scaled.groupBy("size_bin", "density_bin").agg(F.sum("value").alias("value"), F.sum("w").alias("w"))
    return out.select("size_bin", "density_bin", F.when(F.col("w") > least, F.col("value") / F.col("w")).alias("value"))


def pareto_points(runs: DataFrame, x: str = "wall_time", y: str = "avg_chain_length") -> DataFrame:
    return runs.where("success").groupBy("algorithm", PROBLEM).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def pareto_front(points: DataFrame, keys: list[str] | None = None, maximise: bool = False) -> DataFrame:
    """Points that no other point beats in both coordinates; both are minimised unless asked otherwise.

    First the least y of each x, then a running minimum over x by range partitions.
    """
    sign = -1 if maximise else 1
    pts = points.withColumns({"_x": sign * F.col("x"), "_y": sign * F.col("y")})
    keys = keys or []
    best = pts.groupBy(*keys, "_x").agg(F.min("_y").alias("_b"))
    best = order.running(best.withColumn("_all", F.lit(0)), [*keys, "_all"], ["_x"], "_b", "_before", "min")
    front = best.where("_before is null or _b < _before").select(*keys, "_x", F.col("_b").alias("_y"))
    return pts.join(front, [*keys, "_x", "_y"], "left_semi").drop("_x", "_y")


def distribution(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    """Quartiles, range and count by algorithm."""
    ok = runs.where("success")
    quartiles = order.exact_quantiles(ok, ["algorithm"], {metric: F.col(metric)}, (0.25, 0.5, 0.75)).select("algorithm", "q")
    return ok.groupBy("algorithm").agg(F.min(metric).alias("v_min"), F.max(metric).alias("v_max"), F.count("*").alias("n")).join(quartiles, "algorithm", "left").select("algorithm", "v_min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "v_max", "n")


def _macro(runs: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.when(F.col("success"), F.col("avg_chain_length"))
    middle = order.medians(runs, [*keys, "category"], {"tm": F.col("wall_time")})
    cells = runs.groupBy(*keys, "category").agg(share("success").alias("s"), F.avg(ok).alias("c"), F.avg("wall_time").alias("ta")).join(middle, [*keys, "category"], "left")
    return cells.groupBy(*keys).agg(F.avg("s").alias("success_rate"), F.avg("c").alias("chain_mean"), F.avg("tm").alias("time_median"), F.avg("ta").alias("time_mean"))


def balanced_summary(runs: DataFrame) -> DataFrame:
    """Means over categories of success rate and chain length."""
    return _macro(runs, ["algorithm"]).select("algorithm", "success_rate", "chain_mean")


def balanced_time(runs: DataFrame) -> DataFrame:
    """Means over categories of the median and the mean time of all rows."""
    return _macro(runs, ["algorithm"]).select("algorithm", "time_median", "time_mean")


def per_topology(runs: DataFrame) -> DataFrame:
    return _macro(runs, ["base_topology", "algorithm"]).drop("time_mean")


def consistency(runs: DataFrame) -> DataFrame:
    """Mean coefficient of variation over problems with two rows at least and a mean that isn't 0."""
    rows = runs.where("success").groupBy("algorithm", PROBLEM).agg(*[f(c).alias(f"{n}_{c}") for c in ("wall_time", "avg_chain_length") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    cv = lambda c: F.avg(F.try_divide(f"s_{c}", F.nullif(F.col(f"m_{c}"), F.lit(0.0))))
    return rows.groupBy("algorithm").agg(cv("wall_time").alias("cv_time"), cv("avg_chain_length").alias("cv_chain"))


def topology_comparison(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    return runs.where("success").groupBy("algorithm", "topology_name").agg(F.avg(metric).alias("mean_value"))


def deep_dive(runs: DataFrame, graph: str) -> DataFrame:
    """One graph: moments of time and chain over successes (deviation 0 for one), with counts."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    std = lambda c: F.when(F.count_if("success") > 0, F.coalesce(F.stddev_samp(ok(c)), F.lit(0.0)))
    return runs.where(F.col(PROBLEM) == graph).groupBy("algorithm").agg(F.avg(ok("wall_time")).alias("time_mean"), std("wall_time").alias("time_std"), F.avg(ok("avg_chain_length")).alias("chain_mean"), std("avg_chain_length").alias("chain_std"), F.count_if("success").alias("n_success"), F.count_if("is_valid").alias("n_valid"), F.count("*").alias("n_total"))


def kernel_density(runs: DataFrame, metric: str = "avg_chain_length", points: int = 64) -> DataFrame:
    """Gaussian kernel density on a grid over each algorithm's range (Scott's bandwidth).

    Samples are counted by distinct value first; an algorithm without variance has the one point
    at its mean, of null density. Each counted value adds to the grid points, which are summed.
    """
    rows = runs.where("success").groupBy("algorithm", F.col(metric).cast("double").alias("v")).agg(F.count("*").alias("c"))
    stats = runs.where("success").groupBy("algorithm").agg(F.count("*").alias("n"), F.stddev_samp(metric).alias("sd"), F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)
    joined = rows.join(F.broadcast(stats), "algorithm").where("sd > 0").withColumn("h", h)
    flat = stats.where("sd is null or sd = 0").select("algorithm", F.lit(0).alias("i"), F.col("lo").alias("x"), F.lit(None).cast("double").alias("density"))
    at = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    part = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return at.groupBy("algorithm", "i", "x").agg(F.sum(part).alias("density")).unionByName(flat)


def success_heatmap(runs: DataFrame, percent: bool = True, most: int | None = None) -> DataFrame:
    """Successes of each algorithm and graph, with a label; more than `most` graphs are refused."""
    if most is not None and runs.select(PROBLEM).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} graphs")
    out = runs.groupBy("algorithm", PROBLEM).agg(F.count_if("success").alias("n_ok"), F.count("*").alias("n_total"))
    return out.withColumns({"rate": F.col("n_ok") / F.col("n_total"), "label": success_label(F.col("n_ok"), F.col("n_total"), percent)})


def success_by_nodes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("algorithm", "problem_nodes").agg(share("success").alias("success_rate"))


def success_by_density(runs: DataFrame, bins: int = 10) -> DataFrame:
    """Success in equal, right-closed bins of each algorithm's densities; the least density is in the first."""
    span = runs.groupBy("algorithm").agg(F.min("problem_density").alias("lo"), F.max("problem_density").alias("hi"))
    at = F.ceil(F.round(F.try_divide((F.col("problem_density") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), 9))
    placed = runs.join(F.broadcast(span), "algorithm").withColumn("bin", F.least(F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)), F.lit(bins)).cast("long"))
    return placed.groupBy("algorithm", "bin").agg(share("success").alias("success_rate"), F.count("*").alias("n"))


def graph_positions(runs: DataFrame) -> DataFrame:
    """Place of each graph on a categorical axis: by category, id and name.

    A running count over range partitions, so no window spans all graphs or a whole category.
    """
    graphs = runs.select("category", "graph_id", PROBLEM).distinct().withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")})
    placed = order.running(graphs, ["_all"], ["category", "graph_id", PROBLEM], "_one", "position")
    return placed.select("category", "graph_id", PROBLEM, F.coalesce("position", F.lit(0).cast("long")).alias("position"))


def graph_indexed_chain(runs: DataFrame) -> DataFrame:
    """Mean chain of each algorithm and graph, with the graph's place, nodes and density."""
    means = runs.where("success").groupBy("algorithm", "graph_id", PROBLEM).agg(F.avg("avg_chain_length").alias("mean_value"), F.count("*").alias("n"), F.min("problem_nodes").alias("problem_nodes"), F.min("problem_density").alias("problem_density"))
    return means.join(graph_positions(runs), ["graph_id", PROBLEM])


def graph_indexed_points(runs: DataFrame) -> DataFrame:
    """Each successful trial with its graph's place, nodes and density, and the mean of its algorithm on the graph."""
    means = graph_indexed_chain(runs).select("algorithm", "graph_id", PROBLEM, "category", "position", "problem_nodes", "problem_density", "mean_value")
    points = runs.where("success").select("algorithm", "graph_id", PROBLEM, "topology_name", "trial", "seed", F.col("avg_chain_length").alias("value"))
    return points.join(means, ["algorithm", "graph_id", PROBLEM])


def graph_indexed_time(runs: DataFrame) -> DataFrame:
    return runs.select("algorithm", "graph_id", PROBLEM, "topology_name", "trial", "seed", "wall_time", "is_timeout")


def sections(positions: DataFrame) -> DataFrame:
    """First and last place of each run of one category.

    A place whose predecessor has another category begins a run; places are without gaps, so the
    predecessor comes by a join. Only the beginnings are then brought in order.
    """
    before = positions.select((F.col("position") + 1).alias("position"), F.col("category").alias("_last"))
    begins = positions.join(before, "position", "left").where("_last is null or _last <> category").select("category", F.col("position").alias("first"))
    one, last = F.lit(1).cast("long"), positions.agg(F.max("position")).head()[0] or 0
    begins = begins.withColumns({"_all": F.lit(0), "_one": one, "_back": -F.col("first")})
    # how many begin before, and the least that begins after: sums over range partitions
    numbered = order.running(begins, ["_all"], ["first"], "_one", "island")
    ended = order.running(numbered, ["_all"], ["_back"], "first", "_next", "min")
    runs_ = ended.select(F.coalesce("island", F.lit(0).cast("long")).alias("island"), "category", "first", F.coalesce(F.col("_next") - 1, F.lit(last)).cast("long").alias("last"))
    return runs_.withColumn("n", F.col("last") - F.col("first") + 1)


COMPARED = ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used", "total_couplers_used")


def intersection_comparison(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Metric means of two algorithms on the graphs that both solved and on all their successes, over the best shared mean."""
    ok = runs.where(F.col("success") & F.col("algorithm").isin(a, b))
    both = ok.groupBy(PROBLEM).agg(F.countDistinct("algorithm").alias("_k")).where("_k = 2").select(PROBLEM, F.lit(True).alias("_both"))
    rows = ok.join(both, PROBLEM, "left")
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in COMPARED)
    long = rows.select("algorithm", PROBLEM, "_both", F.expr(f"stack({len(COMPARED)}, {stack}) as (metric, v)"))
    means = long.groupBy("algorithm", "metric").agg(F.avg(F.when(F.col("_both"), F.col("v"))).alias("shared_mean"), F.avg("v").alias("all_mean"), F.count_if("_both").alias("n_shared"), F.count("*").alias("n_success"))
    best = F.min("shared_mean").over(Window.partitionBy("metric"))
    best = F.when(best == 0, 1.0).otherwise(best)
    return means.withColumns({"shared_ratio": F.col("shared_mean") / best, "all_ratio": F.col("all_mean") / best})
