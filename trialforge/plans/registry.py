"""Registered queries of the analytics engine, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.operators import filters, pairwise, plotdata, tables
from trialforge.plans.roles import RUNS_SQL, derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 7) -> DataFrame:
    """Doubles to a fixed number of places, so that sums in another order compare equal."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, places: int = 7) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql is not None:
            ORACLES[name] = f"WITH {RUNS_SQL}{sql}" if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return add


def _r(*names: str) -> str:
    """round(expression, 7) AS name for 'expression AS name'."""
    return ", ".join(f"round({e}, 7) AS {n}" for e, n in (x.rsplit(" AS ", 1) for x in names))


OK = "FILTER (WHERE success)"

query("overall_summary", f""" SELECT algorithm, count(*) AS n_trials, count(*) {OK} AS n_success, {_r("avg(success::INT) AS success_rate", "avg(is_valid::INT) AS valid_rate",
 f"avg(wall_time) {OK} AS time_mean", f"stddev_samp(wall_time) {OK} AS time_std", f"median(wall_time) {OK} AS time_median", f"avg(avg_chain_length) {OK} AS chain_mean",
 f"stddev_samp(avg_chain_length) {OK} AS chain_std", f"median(avg_chain_length) {OK} AS chain_median", f"stddev_samp(wall_time) {OK} / avg(wall_time) {OK} AS cv_time",
 f"avg(max_chain_length) {OK} AS max_chain_mean", f"stddev_samp(max_chain_length) {OK} AS max_chain_std", f"avg(total_qubits_used) {OK} AS qubits_mean",
 f"avg(qubit_overhead_ratio) {OK} AS qubit_overhead_mean", f"avg(coupler_overhead_ratio) {OK} AS coupler_overhead_mean")} FROM runs GROUP BY algorithm""")(lambda s, d: tables.overall_summary(derived(s, d)))  # fmt: skip

query("summary_by_category", f" SELECT algorithm, category, {_r('avg(avg_chain_length) AS mean_value')} FROM runs WHERE success GROUP BY ALL")(lambda s, d: tables.summary_by_category(derived(s, d)))

query("summary_by_category_wide", """ SELECT algorithm, """ + ", ".join(f"round(avg(avg_chain_length) FILTER (WHERE category = '{c}'), 7) AS {c}" for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM runs WHERE success GROUP BY algorithm")(
    lambda s, d: tables.pivot_categories(tables.summary_by_category(derived(s, d)), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]))

MEANS = ", means AS (SELECT graph_name, algorithm, avg(avg_chain_length) AS value FROM runs WHERE success GROUP BY ALL)"
query("per_problem_means", MEANS + " SELECT graph_name, algorithm, round(value, 7) AS value FROM means")(lambda s, d: tables.per_problem_means(derived(s, d)))

RANKED = """, ranked AS (SELECT *, rank() OVER (PARTITION BY graph_name ORDER BY value) + (count(*) OVER (PARTITION BY graph_name, value) - 1) / 2.0 AS r
 FROM (SELECT *, count(*) OVER (PARTITION BY graph_name) AS n FROM means) WHERE n >= 2)"""
query("average_ranks", MEANS + RANKED + " SELECT graph_name, algorithm, round(value, 7) AS value, round(r::DOUBLE, 7) AS rank FROM ranked")(
    lambda s, d: tables.average_ranks(filters.at_least(tables.per_problem_means(derived(s, d)), ["graph_name"]), ["graph_name"]))
query("rank_table", MEANS + RANKED + f" SELECT algorithm, {_r('avg(r) AS mean_rank', 'median(r)::DOUBLE AS median_rank', 'stddev_samp(r) AS std_rank')}, count(*) AS n_problems_ranked FROM ranked GROUP BY algorithm")(
    lambda s, d: tables.rank_table(derived(s, d)))

query("density_hardness", f" SELECT algorithm, problem_nodes, problem_density, {_r('avg(avg_chain_length) AS mean_value', 'stddev_samp(avg_chain_length) AS std_value')}, count(*) AS n FROM runs WHERE success AND category IN ('PROMO', 'SMALL') GROUP BY ALL")(
    lambda s, d: tables.density_hardness(derived(s, d), categories=("PROMO", "SMALL")))

query("win_rate_matrix", MEANS + """, algos AS (SELECT DISTINCT algorithm FROM means), grid AS (
 SELECT a.algorithm AS algo_a, b.algorithm AS algo_b, g.graph_name, ma.value AS va, mb.value AS vb FROM algos a JOIN algos b ON a.algorithm <> b.algorithm
 CROSS JOIN (SELECT DISTINCT graph_name FROM means) g LEFT JOIN means ma ON ma.graph_name = g.graph_name AND ma.algorithm = a.algorithm
 LEFT JOIN means mb ON mb.graph_name = g.graph_name AND mb.algorithm = b.algorithm WHERE ma.value IS NOT NULL OR mb.value IS NOT NULL)
 SELECT algo_a, algo_b, count(*) AS n_problems, round(count(*) FILTER (WHERE va < vb OR vb IS NULL) / count(*), 7) AS win_rate FROM grid GROUP BY ALL""")(lambda s, d: pairwise.win_rate_matrix(derived(s, d)))  # fmt: skip

PAIRED = MEANS + """, paired AS (SELECT a.graph_name, a.algorithm AS algo_a, b.algorithm AS algo_b, a.value AS va, b.value AS vb, a.value - b.value AS d
 FROM means a JOIN means b ON a.graph_name = b.graph_name AND a.algorithm < b.algorithm)"""
query("paired_observations", PAIRED + " SELECT graph_name, algo_a, algo_b, round(va, 7) AS va, round(vb, 7) AS vb FROM paired")(lambda s, d: pairwise.paired(tables.per_problem_means(derived(s, d))))
query("head_to_head", PAIRED + " SELECT algo_a, algo_b, count(*) AS n_pairs, count(*) FILTER (WHERE va < vb) AS a_wins, count(*) FILTER (WHERE va > vb) AS b_wins FROM paired GROUP BY ALL")(lambda s, d: pairwise.head_to_head(derived(s, d)))

SIGNED = PAIRED + """, signed AS (SELECT algo_a, algo_b, d, rank() OVER (PARTITION BY algo_a, algo_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY algo_a, algo_b, abs(d)) - 1) / 2.0 AS r FROM paired WHERE d <> 0),
 sums AS (SELECT algo_a, algo_b, count(*) AS m, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus FROM signed GROUP BY ALL),
 ties AS (SELECT algo_a, algo_b, sum(t * t * t - t) AS ties FROM (SELECT algo_a, algo_b, count(*)::DOUBLE AS t FROM signed GROUP BY algo_a, algo_b, abs(d)) GROUP BY ALL),
 base AS (SELECT algo_a, algo_b, count(*) AS n_pairs, median(va) AS median_a, median(vb) AS median_b FROM paired GROUP BY ALL)"""
query("wilcoxon_statistics", SIGNED + f""" SELECT algo_a, algo_b, n_pairs, {_r("median_a AS median_a", "median_b AS median_b", "median_a - median_b AS median_diff")},
 CASE WHEN median_a < median_b THEN 'a < b' WHEN median_a > median_b THEN 'a > b' ELSE 'equal' END AS direction, least(w_plus, w_minus) AS w_statistic,
 {_r("1 - 2 * least(w_plus, w_minus) / (m * (m + 1) / 2.0) AS effect_size")}, m, ties FROM base JOIN sums USING (algo_a, algo_b) JOIN ties USING (algo_a, algo_b)""")(
    lambda s, d: pairwise.effect_sizes(pairwise.signed_rank_sums(derived(s, d))).drop("ranks"))
query("wilcoxon_normal_score", SIGNED + """ SELECT algo_a, algo_b, round(abs(least(w_plus, w_minus) - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48), 7) AS z
 FROM sums JOIN ties USING (algo_a, algo_b)""")(lambda s, d: pairwise.signed_rank_sums(derived(s, d)).selectExpr("algo_a", "algo_b", "abs(least(w_plus, w_minus) - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48) AS z"))  # fmt: skip
query("holm_correction", PAIRED + """, tests AS (SELECT algo_a, algo_b, avg((va < vb)::INT) / 10 AS p_value FROM paired GROUP BY ALL),
 stepped AS (SELECT *, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, algo_a, algo_b) + 1) AS s FROM tests)
 SELECT algo_a, algo_b, round(p_value, 7) AS p_value, round(least(1.0, max(s) OVER (ORDER BY p_value, algo_a, algo_b ROWS UNBOUNDED PRECEDING)), 7) AS corrected_p FROM stepped""")(
    lambda s, d: pairwise.holm(pairwise.paired(tables.per_problem_means(derived(s, d))).groupBy("algo_a", "algo_b").agg((F.avg((F.col("va") < F.col("vb")).cast("int")) / 10).alias("p_value"))))

COMPLETE = MEANS + """, whole AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY graph_name) AS n FROM means) WHERE n = (SELECT count(DISTINCT algorithm) FROM means)),
 fr AS (SELECT *, rank() OVER (PARTITION BY graph_name ORDER BY value) + (count(*) OVER (PARTITION BY graph_name, value) - 1) / 2.0 AS r FROM whole),
 ft AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM fr GROUP BY graph_name, value)),
 fs AS (SELECT algorithm, count(*) AS n, sum(r)::DOUBLE AS rs, avg(r)::DOUBLE AS mr FROM fr GROUP BY algorithm)"""
query("friedman_mean_ranks", COMPLETE + " SELECT algorithm, n AS n_problems, round(rs, 7) AS rank_sum, round(mr, 7) AS mean_rank FROM fs")(
    lambda s, d: pairwise.rank_sums(derived(s, d)).select("algorithm", "n_problems", "rank_sum", "mean_rank"))
query("friedman_statistic", COMPLETE + """, one AS (SELECT max(n) AS n, count(*) AS k, sum(rs * rs) AS ss FROM fs)
 SELECT n, k, round(chi2, 7) AS chi2, round(chi2 / (n * (k - 1)), 7) AS kendall_w FROM (SELECT n, k, (12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))) AS chi2 FROM one, ft)""")(
    lambda s, d: pairwise.friedman_statistic(pairwise.rank_sums(derived(s, d))).withColumn("k", F.col("k").cast("long")))

PROPS, CORR = ("problem_nodes", "problem_edges", "problem_density"), ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used")
query("correlation_pearson", " " + " UNION ALL ".join(f"SELECT '{p}' AS property, '{m}' AS metric, round(corr({p}, {m}), 7) AS correlation FROM runs WHERE success" for p in PROPS for m in CORR))(lambda s, d: tables.correlation_matrix(derived(s, d), "pearson"))
query("correlation_spearman", ", k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in PROPS + CORR) + " FROM runs WHERE success) " + " UNION ALL ".join(f"SELECT '{p}' AS property, '{m}' AS metric, round(corr({p}, {m}), 7) AS correlation FROM k" for p in PROPS for m in CORR))(lambda s, d: tables.correlation_matrix(derived(s, d)))

_stats = ", ".join(f"round(avg({m}) {OK}, 7) AS {m}_mean, CASE WHEN count(*) {OK} > 0 THEN round(coalesce(stddev_samp({m}) {OK}, 0), 7) END AS {m}_std, round(median({m}) {OK}, 7) AS {m}_median" for m in ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used", "total_couplers_used"))
query("batch_summary", f" SELECT algorithm, graph_id, topology_name, count(*) AS n_trials, count(*) {OK} AS n_success, {_r('avg(success::INT) AS success_rate')}, {_stats}, round(coalesce(avg(is_valid::INT) {OK}, 0), 7) AS valid_rate, min(graph_name) AS graph_name, min(problem_nodes) AS problem_nodes, min(problem_edges) AS problem_edges, min(problem_density) AS problem_density FROM runs GROUP BY algorithm, graph_id, topology_name")(lambda s, d: tables.batch_summary(derived(s, d)))
query("batch_counters", " SELECT 'b1' AS batch_id, count(*) AS n_total, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x.lower()}" for x in ("SUCCESS", "INVALID_OUTPUT", "TIMEOUT", "CRASH", "FAILURE")) + " FROM runs")(lambda s, d: tables.batch_counters(derived(s, d)))
OUTLIERS = ", outliers AS (SELECT algorithm, topology_name, count(*) FILTER (WHERE wall_time > f * med) AS n_outliers FROM (SELECT *, median(wall_time) OVER (PARTITION BY algorithm, topology_name) AS med, count(*) OVER (PARTITION BY algorithm, topology_name) AS n, {f} AS f FROM runs WHERE success) WHERE n >= 2 GROUP BY ALL)"
query("timing_outliers", OUTLIERS.format(f="1.5::DOUBLE") + " SELECT * FROM outliers WHERE n_outliers > 0")(lambda s, d: tables.timing_outliers(derived(s, d), 1.5))
FAILED = ", failed AS (SELECT graph_name, topology_name FROM runs GROUP BY ALL HAVING NOT bool_or(success))"
query("all_algorithms_failed", FAILED + " SELECT graph_name, topology_name, graph_name || ' [' || topology_name || ']' AS label FROM failed")(lambda s, d: tables.all_failed(derived(s, d)))
query("inflight_counters", " SELECT algorithm, count(*) FILTER (WHERE status = 'INVALID_OUTPUT') AS n_invalid, count(*) FILTER (WHERE status = 'CRASH') AS n_crash, CASE WHEN count(*) FILTER (WHERE status = 'CRASH') > 0 THEN 'error' END AS first_error FROM runs GROUP BY algorithm")(lambda s, d: tables.inflight_counters(derived(s, d)))
query("warning_summary", OUTLIERS.format(f="10.0::DOUBLE") + FAILED + """, kinds AS (SELECT status AS kind, count(*) AS n FROM runs WHERE status IN ('INVALID_OUTPUT', 'CRASH') GROUP BY status
 UNION ALL SELECT 'TIMING_OUTLIER', coalesce(sum(n_outliers), 0) FROM outliers UNION ALL SELECT 'ALL_ALGORITHMS_FAILED', count(*) FROM failed)
 SELECT coalesce(kind, 'TOTAL') AS kind, sum(n)::BIGINT AS n FROM kinds GROUP BY ROLLUP (kind)""")(lambda s, d: tables.warning_summary(derived(s, d)))  # fmt: skip
query("headline", f" SELECT algorithm, count(*) AS n_trials, count(*) {OK} AS n_success, {_r(f'avg(wall_time) {OK} AS time_mean', f'stddev_pop(wall_time) {OK} AS time_std')} FROM runs GROUP BY algorithm")(lambda s, d: tables.headline(derived(s, d)))

# Heat maps and figures.
WINNERS = ", winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY avg_chain_length, topology_name, algorithm, trial, seed) AS k FROM runs WHERE success) WHERE k = 1)"
query("heat_metric", f" SELECT algorithm, category, {_r('avg(avg_chain_length) AS value')} FROM runs WHERE success GROUP BY ALL")(lambda s, d: plotdata.category_heatmap(derived(s, d)))
query("heat_success_rate", f" SELECT algorithm, category, {_r('avg(success::INT) AS value')} FROM runs GROUP BY ALL")(lambda s, d: plotdata.category_heatmap(derived(s, d), "success_rate"))
query("heat_wall_time", f" SELECT algorithm, category, {_r('avg(wall_time) AS value')} FROM runs GROUP BY ALL")(lambda s, d: plotdata.category_heatmap(derived(s, d), "wall_time"))
query("heat_relative_time", ", t AS (SELECT algorithm, category, avg(wall_time) AS v FROM runs GROUP BY ALL) SELECT algorithm, category, round(v / min(v) OVER (PARTITION BY category), 7) AS value FROM t")(lambda s, d: plotdata.category_heatmap(derived(s, d), "relative_time"))
query("heat_win_rate", WINNERS + """, t AS (SELECT category, count(*) AS total FROM winners GROUP BY ALL), w AS (SELECT algorithm, category, count(*) AS wins FROM winners GROUP BY ALL)
 SELECT a.algorithm, t.category, round(coalesce(wins, 0) / total, 7) AS value FROM (SELECT DISTINCT algorithm FROM runs) a CROSS JOIN t LEFT JOIN w ON w.algorithm = a.algorithm AND w.category = t.category""")(lambda s, d: plotdata.category_heatmap(derived(s, d), "win_rate"))  # fmt: skip
FAMILIES = {"big": ("LARGE", "STANDARD"), "small": ("SMALL", "ECONOMY", "MEDIUM")}
FAMILY = "CASE WHEN category IN ('LARGE', 'STANDARD') THEN 'big' WHEN category IN ('SMALL', 'ECONOMY', 'MEDIUM') THEN 'small' END AS family"
query("family_heatmap", f" SELECT algorithm, category, {_r('avg(avg_chain_length) AS value')}, {FAMILY} FROM runs WHERE success AND category <> 'PROMO' GROUP BY ALL")(lambda s, d: plotdata.family_heatmap(derived(s, d), families=FAMILIES))
query("family_summary", f", c AS (SELECT algorithm, category, {FAMILY}, avg(avg_chain_length) AS v FROM runs WHERE success GROUP BY ALL) SELECT algorithm, family, round(avg(v), 7) AS value FROM c WHERE family IS NOT NULL GROUP BY ALL")(lambda s, d: plotdata.family_summary(derived(s, d), families=FAMILIES))
query("family_relative_time", f", c AS (SELECT algorithm, category, {FAMILY}, avg(wall_time) AS v FROM runs GROUP BY ALL), m AS (SELECT algorithm, family, avg(v) AS v FROM c WHERE family IS NOT NULL GROUP BY ALL) SELECT algorithm, family, round(v / min(v) OVER (PARTITION BY family), 7) AS value FROM m")(lambda s, d: plotdata.family_summary(derived(s, d), "relative_time", FAMILIES))
query("family_win_rate", WINNERS + f", f AS (SELECT algorithm, {FAMILY} FROM winners), t AS (SELECT family, count(*) AS total FROM f GROUP BY family) SELECT algorithm, family, round(count(*) / any_value(total), 7) AS value FROM f JOIN t USING (family) GROUP BY algorithm, family")(lambda s, d: plotdata.family_summary(derived(s, d), "win_rate", FAMILIES))
query("scaling_trend", """, x AS (SELECT algorithm, problem_nodes::DOUBLE AS x, wall_time AS y FROM runs WHERE success), span AS (SELECT algorithm, min(x) AS lo, greatest(1, floor((max(x) - min(x)) / 40))::DOUBLE AS width FROM x GROUP BY ALL),
 b AS (SELECT algorithm, (ceil((x - lo) / width) - 1)::BIGINT AS bin, lo, width, y FROM x JOIN span USING (algorithm))
 SELECT algorithm, bin, round(min(lo) + (min(bin) + 0.5) * min(width), 7) AS x_mid, round(avg(y), 7) AS mean_value, round(coalesce(stddev_samp(y), 0), 7) AS std_value, count(*) AS n FROM b WHERE bin >= 0 GROUP BY algorithm, bin""")(lambda s, d: plotdata.scaling_trend(derived(s, d)))  # fmt: skip
query("density_lines", f" SELECT algorithm, problem_nodes, problem_density, {_r('avg(avg_chain_length) AS mean_value')} FROM runs WHERE success AND category = 'PROMO' GROUP BY ALL")(lambda s, d: plotdata.density_lines(derived(s, d), categories=("PROMO",)))
GRID = ", g AS (SELECT *, (ceil((problem_nodes - (SELECT min(problem_nodes) FROM runs WHERE success)) / 10.0) - 1)::BIGINT AS size_bin, (ceil(round(problem_density / 0.05, 9)) - 1)::BIGINT AS density_bin FROM runs WHERE success)"
query("size_density_grid", GRID + f" SELECT size_bin, density_bin, {_r('avg(avg_chain_length) AS value')}, count(*) AS n FROM g WHERE size_bin >= 0 AND density_bin >= 0 GROUP BY ALL")(lambda s, d: plotdata.size_density_grid(derived(s, d)))
query("grid_by_algorithm", GRID + ", c AS (SELECT algorithm, size_bin, density_bin, avg(avg_chain_length) AS value, count(*) AS n FROM g WHERE size_bin >= 0 AND density_bin >= 0 GROUP BY ALL) SELECT algorithm, size_bin, density_bin, round(value, 7) AS value, n, round(min(value) OVER (), 7) AS v_min, round(max(value) OVER (), 7) AS v_max, max(size_bin) OVER () AS x_max FROM c")(lambda s, d: plotdata.grid_by_algorithm(derived(s, d)))
_PASS = """, {out} AS (SELECT {keys}, sum(s.value * k.w{times}) AS value, sum(s.w * k.w) AS w FROM {box} CROSS JOIN k CROSS JOIN LATERAL (SELECT ((t + d - lo) % (2 * n) + 2 * n) % (2 * n) AS m) f
 JOIN {src} s ON s.{c} = lo + CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL)"""
SMOOTH = GRID + """, g0 AS (SELECT size_bin, density_bin, avg(avg_chain_length) AS value, 1.0::DOUBLE AS w FROM g WHERE size_bin >= 0 AND density_bin >= 0 GROUP BY ALL),
 k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM range(-4, 5) x(d)),
 bs AS (SELECT unnest(range(lo, hi + 1)) AS t, lo, hi - lo + 1 AS n FROM (SELECT min(size_bin) AS lo, max(size_bin) AS hi FROM g0)),
 bd AS (SELECT unnest(range(lo, hi + 1)) AS t, lo, hi - lo + 1 AS n FROM (SELECT min(density_bin) AS lo, max(density_bin) AS hi FROM g0))""" + _PASS.format(out="g1", keys="t AS size_bin, s.density_bin", box="bs", src="g0", c="size_bin", times="") + _PASS.format(
    out="g2", keys="s.size_bin, t AS density_bin", box="bd", src="g1", c="density_bin", times="")
query("smoothed_grid", SMOOTH + " SELECT size_bin, density_bin, CASE WHEN w > 0.05 THEN round(value / w, 7) END AS value FROM g2")(lambda s, d: plotdata.smoothed(plotdata.size_density_grid(derived(s, d))))
POINTS = ", p AS (SELECT algorithm, graph_name, avg(wall_time) AS x, avg(avg_chain_length) AS y FROM runs WHERE success GROUP BY ALL)"
query("pareto_points", POINTS + " SELECT algorithm, graph_name, round(x, 7) AS x, round(y, 7) AS y FROM p")(lambda s, d: plotdata.pareto_points(derived(s, d)))
query("pareto_front", POINTS + " SELECT algorithm, graph_name, round(x, 7) AS x, round(y, 7) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y))")(lambda s, d: plotdata.pareto_front(plotdata.pareto_points(derived(s, d))))
query("pareto_front_by_algorithm", POINTS + " SELECT algorithm, graph_name, round(x, 7) AS x, round(y, 7) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.algorithm = p.algorithm AND q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y))")(lambda s, d: plotdata.pareto_front(plotdata.pareto_points(derived(s, d)), ["algorithm"]))
query("distribution", f" SELECT algorithm, min(avg_chain_length) AS v_min, {_r('quantile_cont(avg_chain_length, 0.25) AS q1', 'median(avg_chain_length) AS q2', 'quantile_cont(avg_chain_length, 0.75) AS q3')}, max(avg_chain_length) AS v_max, count(*) AS n FROM runs WHERE success GROUP BY algorithm")(lambda s, d: plotdata.distribution(derived(s, d)))
MACRO = ", c AS (SELECT {k}, category, avg(success::INT) AS s, avg(avg_chain_length) FILTER (WHERE success) AS c, median(wall_time) AS tm, avg(wall_time) AS ta FROM runs GROUP BY ALL)"
query("balanced_summary", MACRO.format(k="algorithm") + f" SELECT algorithm, {_r('avg(s) AS success_rate', 'avg(c) AS chain_mean')} FROM c GROUP BY algorithm")(lambda s, d: plotdata.balanced_summary(derived(s, d)))
query("balanced_time", MACRO.format(k="algorithm") + f" SELECT algorithm, {_r('avg(tm) AS time_median', 'avg(ta) AS time_mean')} FROM c GROUP BY algorithm")(lambda s, d: plotdata.balanced_time(derived(s, d)))
query("per_topology_summary", MACRO.format(k="base_topology, algorithm") + f" SELECT base_topology, algorithm, {_r('avg(s) AS success_rate', 'avg(c) AS chain_mean', 'avg(tm) AS time_median')} FROM c GROUP BY base_topology, algorithm")(lambda s, d: plotdata.per_topology(derived(s, d)))
query("consistency", ", c AS (SELECT algorithm, graph_name, stddev_samp(wall_time) / avg(wall_time) AS t, stddev_samp(avg_chain_length) / avg(avg_chain_length) AS c FROM runs WHERE success GROUP BY ALL) SELECT algorithm, round(avg(t), 7) AS cv_time, round(avg(c), 7) AS cv_chain FROM c GROUP BY algorithm")(lambda s, d: plotdata.consistency(derived(s, d)))
query("topology_comparison", f" SELECT algorithm, topology_name, {_r('avg(avg_chain_length) AS mean_value')} FROM runs WHERE success GROUP BY ALL")(lambda s, d: plotdata.topology_comparison(derived(s, d)))
_dive = lambda c, n: f"round(avg({c}) {OK}, 7) AS {n}_mean, CASE WHEN count(*) {OK} > 0 THEN round(coalesce(stddev_samp({c}) {OK}, 0), 7) END AS {n}_std"
query("deep_dive", f" SELECT algorithm, {_dive('wall_time', 'time')}, {_dive('avg_chain_length', 'chain')}, count(*) {OK} AS n_success, count(*) FILTER (WHERE is_valid) AS n_valid, count(*) AS n_total FROM runs WHERE graph_name = 'g7' GROUP BY algorithm")(lambda s, d: plotdata.deep_dive(derived(s, d), "g7"))
KDE = """, st AS (SELECT algorithm, count(*) AS n, stddev_samp({m}) * pow(count(*), -0.2) AS h, min({m}) AS lo, max({m}) AS hi FROM runs WHERE success GROUP BY algorithm),
 v AS (SELECT algorithm, {m}::DOUBLE AS v, count(*) AS c FROM runs WHERE success GROUP BY ALL), pts AS (SELECT algorithm, i, lo + (hi - lo) * i / 63 AS x, n, h FROM st, range(64) r(i))
 SELECT algorithm, i::INT AS i, round(x, 7) AS x, round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (n * h * sqrt(2 * pi()))), 7) AS density FROM pts JOIN v USING (algorithm) GROUP BY algorithm, i, x"""
query("chain_density", KDE.format(m="avg_chain_length"))(lambda s, d: plotdata.kernel_density(derived(s, d)))
query("max_chain_density", KDE.format(m="max_chain_length"))(lambda s, d: plotdata.kernel_density(derived(s, d), "max_chain_length"))
HEAT = ", h AS (SELECT algorithm, graph_name, count(*) {ok} AS n_ok, count(*) AS n_total FROM runs GROUP BY ALL) SELECT algorithm, graph_name, n_ok, n_total, round(n_ok / n_total, 7) AS rate, {label} AS label FROM h"
query("success_heatmap", HEAT.format(ok=OK, label="CASE WHEN n_total > 5 THEN round_even(100 * n_ok / n_total, 0)::INT || '%' ELSE n_ok || '/' || n_total END"))(lambda s, d: plotdata.success_heatmap(derived(s, d)))
query("graph_indexed_success", HEAT.format(ok=OK, label="n_ok || '/' || n_total"))(lambda s, d: plotdata.success_heatmap(derived(s, d), percent=False))
query("success_by_nodes", f" SELECT algorithm, problem_nodes, {_r('avg(success::INT) AS success_rate')} FROM runs GROUP BY ALL")(lambda s, d: plotdata.success_by_nodes(derived(s, d)))
query("success_by_density", ", b AS (SELECT algorithm, success, least(greatest(ceil(round((problem_density - lo) * 10 / (hi - lo), 9)), 1), 10)::BIGINT AS bin FROM runs JOIN (SELECT algorithm, min(problem_density) AS lo, max(problem_density) AS hi FROM runs GROUP BY ALL) USING (algorithm)) SELECT algorithm, bin, round(avg(success::INT), 7) AS success_rate, count(*) AS n FROM b GROUP BY ALL")(lambda s, d: plotdata.success_by_density(derived(s, d)))
POSITIONS = ", pos AS (SELECT category, graph_id, graph_name, row_number() OVER (ORDER BY category, graph_id, graph_name) - 1 AS position FROM (SELECT DISTINCT category, graph_id, graph_name FROM runs))"
query("graph_positions", POSITIONS + " SELECT * FROM pos")(lambda s, d: plotdata.graph_positions(derived(s, d)))
query("graph_indexed_chain", POSITIONS + ", m AS (SELECT algorithm, graph_id, graph_name, avg(avg_chain_length) AS v, count(*) AS n, min(problem_nodes) AS problem_nodes, min(problem_density) AS problem_density FROM runs WHERE success GROUP BY ALL) SELECT algorithm, graph_id, graph_name, round(v, 7) AS mean_value, n, problem_nodes, problem_density, category, position FROM m JOIN pos USING (graph_id, graph_name)")(lambda s, d: plotdata.graph_indexed_chain(derived(s, d)))
query("graph_indexed_time", " SELECT algorithm, graph_id, graph_name, topology_name, trial, seed, round(wall_time, 7) AS wall_time, is_timeout FROM runs")(lambda s, d: plotdata.graph_indexed_time(derived(s, d)))
query("category_sections", POSITIONS + ", s AS (SELECT *, sum(coalesce(c, 0)) OVER (ORDER BY position) AS island FROM (SELECT *, (category <> lag(category) OVER (ORDER BY position))::INT AS c FROM pos)) SELECT island::BIGINT AS island, category, min(position) AS first, max(position) AS last, count(*) AS n FROM s GROUP BY island, category")(lambda s, d: plotdata.sections(plotdata.graph_positions(derived(s, d))))
_M = ("wall_time", "avg_chain_length", "max_chain_length", "total_qubits_used", "total_couplers_used")
query("intersection_comparison", ", o AS (SELECT * FROM runs WHERE success AND algorithm IN ('BUILDING', 'MACHINERY')), shared AS (SELECT graph_name FROM o GROUP BY graph_name HAVING count(DISTINCT algorithm) = 2), l AS (" + " UNION ALL ".join(f"SELECT algorithm, graph_name, '{m}' AS metric, {m}::DOUBLE AS v FROM o" for m in _M) + """),
 m AS (SELECT algorithm, metric, avg(v) FILTER (WHERE b.graph_name IS NOT NULL) AS sm, avg(v) AS am, count(b.graph_name) AS n_shared, count(*) AS n_success FROM l LEFT JOIN shared b USING (graph_name) GROUP BY algorithm, metric), z AS (SELECT *, CASE WHEN min(sm) OVER (PARTITION BY metric) = 0 THEN 1 ELSE min(sm) OVER (PARTITION BY metric) END AS best FROM m)
 SELECT algorithm, metric, round(sm, 7) AS shared_mean, round(am, 7) AS all_mean, n_shared, n_success, round(sm / best, 7) AS shared_ratio, round(am / best, 7) AS all_ratio FROM z""")(lambda s, d: plotdata.intersection_comparison(derived(s, d), "BUILDING", "MACHINERY"))  # fmt: skip

# Filters and set operations.
query("derived_columns", " SELECT algorithm, graph_id, topology_name, trial, seed, category, round(qubit_overhead_ratio, 7) AS qubit_overhead_ratio, round(coupler_overhead_ratio, 7) AS coupler_overhead_ratio, round(max_to_avg_chain_ratio, 7) AS max_to_avg_chain_ratio, is_timeout, base_topology, fault_rate FROM runs")(
    lambda s, d: derived(s, d).select("algorithm", "graph_id", "topology_name", "trial", "seed", "category", "qubit_overhead_ratio", "coupler_overhead_ratio", "max_to_avg_chain_ratio", "is_timeout", "base_topology", "fault_rate"))
query("graph_filter", " SELECT algorithm, graph_id, trial, seed FROM runs WHERE graph_id BETWEEN 1 AND 100 AND NOT graph_id BETWEEN 41 AND 50 AND category = 'PROMO'")(lambda s, d: filters.graph_filter(derived(s, d), "1-100 & !41–50", "promo").select("algorithm", "graph_id", "trial", "seed"))
query("shared_graphs", " SELECT algorithm, graph_id, trial, seed, success FROM runs WHERE graph_name IN (SELECT graph_name FROM runs WHERE success GROUP BY graph_name HAVING count(DISTINCT algorithm) = 5)")(lambda s, d: filters.shared_graphs(derived(s, d)).select("algorithm", "graph_id", "trial", "seed", "success"))
query("complete_cases", MEANS + " SELECT graph_name, algorithm, round(value, 7) AS value FROM (SELECT *, count(*) OVER (PARTITION BY graph_name) AS n FROM means) WHERE n = 5")(lambda s, d: filters.complete_cases(tables.per_problem_means(derived(s, d)), ["graph_name"], 5))
query("view_union", """ SELECT algorithm, graph_id, seed, trial, 'x' AS source_batch FROM runs WHERE algorithm IN ('BUILDING', 'MACHINERY') AND category <> 'PROMO' UNION ALL
 SELECT algorithm, graph_id, seed, trial, 'y' FROM runs WHERE graph_id BETWEEN 5 AND 90 AND fault_rate = 0.02 AND success""")(
    lambda s, d: filters.view([(derived(s, d), {"algorithm": ["BUILDING", "MACHINERY"], "category": "!PROMO"}, "x"), (derived(s, d), {"graph_id": "5-90", "fault_rate": 0.02, "success": True}, "y")]).select("algorithm", "graph_id", "seed", "trial", "source_batch"))
query("dedup_keep_first", " SELECT seed, trial, algorithm, graph_id FROM (SELECT *, row_number() OVER (PARTITION BY seed, trial ORDER BY graph_id, topology_name, wall_time) AS k FROM runs) WHERE k = 1")(
    lambda s, d: filters.dedup_keep_first(derived(s, d), ["seed", "trial"], ["graph_id", "topology_name", "wall_time"]).select("seed", "trial", "algorithm", "graph_id"))
query("solved_by_both", " SELECT graph_name FROM runs WHERE success AND algorithm = 'BUILDING' INTERSECT SELECT graph_name FROM runs WHERE success AND algorithm = 'MACHINERY'")(
    lambda s, d: derived(s, d).where("success and algorithm = 'BUILDING'").select("graph_name").intersect(derived(s, d).where("success and algorithm = 'MACHINERY'").select("graph_name")))
