"""Comparisons of algorithms by pairs, and rank tests over complete problems.

The statistics that need every row (ranks, signed-rank sums, tie sums) are aggregated by Spark;
one row for each pair of algorithms is left for the tails, which are column expressions too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.functions import special, tails
from trialforge.operators import order
from trialforge.operators.derive import direction, magnitude
from trialforge.operators.tables import PROBLEM, average_ranks, per_problem_means
from trialforge.sources.shared import cut


def paired(means: DataFrame, key: str = PROBLEM) -> DataFrame:
    """Problems that both algorithms of a pair solved: algo_a < algo_b, va, vb."""
    a = means.select(key, F.col("algorithm").alias("algo_a"), F.col("value").alias("va"))
    b = means.select(key, F.col("algorithm").alias("algo_b"), F.col("value").alias("vb"))
    return a.join(b, key).where("algo_a < algo_b")


def win_rate_matrix(runs: DataFrame, metric: str = "avg_chain_length", lower: bool = True) -> DataFrame:
    """Share of problems that algo_a wins over algo_b, of those that either solved.

    A win is a better mean, or to succeed where the other doesn't; ties count for neither.
    Wins over both-solved problems come from the paired join; the rest follows from counts.
    """
    means = per_problem_means(runs, metric)
    better = F.col("va") < F.col("vb") if lower else F.col("va") > F.col("vb")
    worse = F.col("va") > F.col("vb") if lower else F.col("va") < F.col("vb")
    both = paired(means).groupBy("algo_a", "algo_b").agg(F.count("*").alias("n_both"), F.count_if(better).alias("wins"), F.count_if(worse).alias("losses"))
    both = both.unionByName(both.select(F.col("algo_b").alias("algo_a"), F.col("algo_a").alias("algo_b"), "n_both", F.col("losses").alias("wins"), F.col("wins").alias("losses")))
    solved = means.groupBy("algorithm").agg(F.count("*").alias("n"))
    a = solved.select(F.col("algorithm").alias("algo_a"), F.col("n").alias("na"))
    b = solved.select(F.col("algorithm").alias("algo_b"), F.col("n").alias("nb"))
    pairs = a.join(b, F.col("algo_a") != F.col("algo_b")).join(both, ["algo_a", "algo_b"], "left").fillna(0, ["n_both", "wins"])
    either = F.col("na") + F.col("nb") - F.col("n_both")
    return pairs.select("algo_a", "algo_b", either.alias("n_problems"), ((F.col("wins") + F.col("na") - F.col("n_both")) / either).alias("win_rate"))


def head_to_head(runs: DataFrame, metric: str = "avg_chain_length", lower: bool = True) -> DataFrame:
    better = F.col("va") < F.col("vb") if lower else F.col("va") > F.col("vb")
    return paired(per_problem_means(runs, metric)).groupBy("algo_a", "algo_b").agg(F.count("*").alias("n_pairs"), F.count_if(better).alias("a_wins"), F.count_if((F.col("va") != F.col("vb")) & ~better).alias("b_wins"))


def signed_rank_sums(runs: DataFrame, metric: str = "avg_chain_length") -> DataFrame:
    """For each pair: n_pairs, medians, m (pairs that differ), W+, W-, tie sum, and the ranks where n_pairs is 13 at most."""
    pairs = paired(per_problem_means(runs, metric)).withColumn("d", F.col("va") - F.col("vb"))
    keys = ["algo_a", "algo_b"]
    middle = order.medians(pairs, keys, {"median_a": F.col("va"), "median_b": F.col("vb")})
    base = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs")).join(middle, keys)
    # |d| with equal values counted once: ranks come from running counts
    by = pairs.where("d <> 0").groupBy(*keys, F.abs("d").alias("v")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    by = order.running(by, keys, ["v"], "t", "before").withColumn("rank", F.coalesce("before", F.lit(0)) + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    sums = by.groupBy(*keys).agg(F.sum("t").alias("m"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"), F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 14, F.struct("rank", "t")))), 1, 14).alias("ranks"))
    return base.join(sums, keys, "left").fillna(0, ["m", "w_plus", "w_minus", "ties"])


def signed_rank_p(sums: DataFrame) -> DataFrame:
    """`sums` with p and log10_p: exact by all choices of signs where pairs are few, else the normal approximation.

    Without ties or zeros p is exact up to 50 pairs, with them up to 13. log10_p is the normal approximation always,
    0 where there is no variance. One row for each pair of algorithms.
    """
    m, w, keys = F.col("m"), F.col("w_statistic"), ["algo_a", "algo_b"]
    distinct = (m == F.col("n_pairs")) & (F.col("ties") == 0) & (F.col("n_pairs") <= 50)
    given = F.flatten(F.transform("ranks", lambda r: F.array_repeat((2 * r["rank"]).cast("long"), r["t"].cast("int"))))
    steps = F.when(distinct, F.transform(F.sequence(F.lit(1).cast("long"), m.cast("long")), lambda r: 2 * r)).when(F.col("n_pairs") <= 13, given)
    sums = cut(sums, "signed-ranks")
    exact = tails.signed_rank_tails(sums.where(m > 0).select(*keys, steps.alias("steps"), w.alias("w")).where("steps is not null"), keys)
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48
    score = F.when((m > 0) & (variance > 0), F.abs(w - m * (m + 1) / 4) / F.sqrt(variance))
    ln_p = tails.ln_erfc(score / math.sqrt(2))
    known = sums.join(exact, keys, "left").withColumn("_ln", ln_p)
    return known.withColumn("p", F.coalesce("tail", F.when(F.col("_ln").isNotNull(), F.least(F.lit(1.0), F.exp("_ln"))))).withColumn("log10_p", F.coalesce(F.least(F.lit(0.0), F.col("_ln") / math.log(10.0)), F.lit(0.0))).drop("_ln", "tail")


def holm(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """corrected_p by Holm over the non-null p values; others stay null. One row for each pair of algorithms."""
    known = tests.where(F.col(p).isNotNull())
    order = Window.orderBy(p, "algo_a", "algo_b")
    m = F.count("*").over(Window.partitionBy())
    step = known.withColumn("_s", F.col(p) * (m - F.row_number().over(order) + 1))
    fixed = step.withColumn("corrected_p", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
    return fixed.unionByName(tests.where(F.col(p).isNull()).withColumn("corrected_p", F.lit(None).cast("double")))


def effect_sizes(sums: DataFrame) -> DataFrame:
    """Median difference, direction, W and rank-biserial effect, from signed-rank sums."""
    m = F.col("m")
    w = F.least("w_plus", "w_minus")
    r = F.when(m > 0, 1 - 2 * w / (m * (m + 1) / 2.0)).otherwise(F.lit(0.0))
    return sums.select("algo_a", "algo_b", "n_pairs", "median_a", "median_b", (F.col("median_a") - F.col("median_b")).alias("median_diff"), direction(F.col("median_a"), F.col("median_b")).alias("direction"), w.alias("w_statistic"), r.alias("effect_size"), "m", "ties", "ranks")


def _flag(p: Column, alpha: float) -> Column:
    return F.coalesce(p < alpha, F.lit(False))


def significance_tests(runs: DataFrame, metric: str = "avg_chain_length", min_pairs: int = 5) -> DataFrame:
    """Wilcoxon signed-rank tests of all pairs with Holm correction; below min_pairs the statistics are null."""
    tests = effect_sizes(signed_rank_sums(runs, metric))
    tests = signed_rank_p(tests)
    enough = F.col("n_pairs") >= min_pairs
    p = F.when(enough, F.col("p"))
    tests = tests.select("algo_a", "algo_b", "n_pairs", *[F.when(enough, F.col(c)).alias(c) for c in ("median_a", "median_b", "median_diff", "direction", "w_statistic")], p.alias("p_value"), F.when(enough, F.col("log10_p")).alias("log10_p"), F.when(enough, F.col("effect_size")).alias("effect_size"))
    out = holm(tests)
    for name, alpha in (("significant_005", 0.05), ("significant_001", 0.01), ("significant_0001", 0.001)):
        out = out.withColumn(name, _flag(F.col("corrected_p"), alpha))
    return out.withColumn("effect_magnitude", magnitude(F.col("effect_size")))


def rank_sums(runs: DataFrame, metric: str = "avg_chain_length", lower: bool = True) -> DataFrame:
    """Over the problems that all algorithms solved: each algorithm's mean rank, with n, k and the tie sum."""
    means = per_problem_means(runs, metric)
    k = runs.where("success").select(F.countDistinct("algorithm")).head()[0]
    whole = means.withColumn("_n", F.count("*").over(Window.partitionBy(PROBLEM))).where(F.col("_n") == k).drop("_n")
    ranked = average_ranks(whole, [PROBLEM], lower)
    ties = ranked.groupBy(PROBLEM, "value").agg(F.count("*").cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0))).head()[0]
    return ranked.groupBy("algorithm").agg(F.count("*").alias("n_problems"), F.sum("rank").alias("rank_sum"), F.avg("rank").alias("mean_rank")).withColumn("k", F.lit(k)).withColumn("ties", F.lit(ties))


def friedman_statistic(sums: DataFrame) -> DataFrame:
    """One row: chi square with tie correction, Kendall's W, n and k."""
    one = sums.agg(F.max("n_problems").alias("n"), F.max("k").alias("k"), F.max("ties").alias("ties"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"))
    n, k = F.col("n"), F.col("k")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    chi = F.try_divide(raw, 1 - F.col("ties") / (n * k * (k * k - 1.0)))
    return one.select("n", "k", chi.alias("chi2")).withColumn("kendall_w", F.try_divide("chi2", n * (k - 1)))


def friedman_test(runs: DataFrame, metric: str = "avg_chain_length", lower: bool = True) -> dict:
    """The test's numbers, or {"error": ...} for fewer than three algorithms or complete problems."""
    sums = rank_sums(runs, metric, lower)
    rows = sums.orderBy("mean_rank", "algorithm").collect()
    if len(rows) < 3 or rows[0]["n_problems"] < 3:
        return {"error": "at least three algorithms and three complete problems are needed"}
    s = friedman_statistic(sums).head()
    log10_p = special.chi2_log10_p(s["chi2"], s["k"] - 1)
    p = 10.0**log10_p
    return {
        "statistic": s["chi2"], "p_value": p, "log10_p": log10_p, "significant_005": p < 0.05, "significant_001": p < 0.01, "significant_0001": p < 0.001,
        "n_problems": s["n"], "n_algorithms": s["k"], "kendalls_w": s["kendall_w"], "mean_ranks": {r["algorithm"]: round(r["mean_rank"], 6) for r in rows},
        "rank_order": [r["algorithm"] for r in rows], "nemenyi_cd": special.nemenyi_distance(s["k"], s["n"]),
    }


def rank_order(ranks: DataFrame) -> DataFrame:
    """One row: the algorithms from best to worst mean rank, ties by name. One entry for each algorithm."""
    ordered = F.array_sort(F.collect_list(F.struct("mean_rank", "algorithm")))
    return ranks.agg(F.concat_ws(" < ", F.transform(ordered, lambda r: r["algorithm"])).alias("rank_order"))
