"""Registered queries of the signed-rank tests, with exact and approximate p values in SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.operators import pairwise
from trialforge.plans.registry import MEANS, SIGNED, query
from trialforge.plans.roles import RUNS_SQL, derived, table

#: From the signed ranks of each pair to the table of tests. The null distribution adds one rank at a time; the normal
#: tail is the power series of erf near 0 and the continued fraction of erfc further out.
TESTED = """,
 given AS (SELECT algo_a, algo_b, list((2 * r)::BIGINT ORDER BY r) AS ranks FROM signed GROUP BY ALL),
 facts AS (SELECT b.*, coalesce(m, 0) AS m, coalesce(least(w_plus, w_minus), 0) AS w, coalesce(ties, 0) AS ties, ranks
  FROM base b LEFT JOIN sums USING (algo_a, algo_b) LEFT JOIN ties USING (algo_a, algo_b) LEFT JOIN given USING (algo_a, algo_b)),
 steps AS (SELECT algo_a, algo_b, w, CASE WHEN m = n_pairs AND ties = 0 AND n_pairs <= 50 THEN list_transform(range(1, m + 1), lambda r: 2 * r)
  WHEN n_pairs <= 13 THEN ranks END AS ranks FROM facts WHERE m > 0),
 spread(algo_a, algo_b, k, s, ways) AS (
  SELECT algo_a, algo_b, 0, 0::BIGINT, 1::BIGINT FROM steps WHERE ranks IS NOT NULL
  UNION ALL
  SELECT d.algo_a, d.algo_b, d.k + 1, d.s + v.x * t.ranks[d.k + 1], sum(d.ways)::BIGINT
  FROM spread d JOIN steps t ON t.algo_a = d.algo_a AND t.algo_b = d.algo_b, (VALUES (0), (1)) v(x) WHERE d.k < len(t.ranks) GROUP BY ALL),
 exact AS (SELECT d.algo_a, d.algo_b, least(1.0::DOUBLE, 2 * sum(CASE WHEN d.s <= 2 * t.w THEN d.ways ELSE 0 END) / pow(2.0::DOUBLE, max(d.k))) AS p
  FROM spread d JOIN steps t ON t.algo_a = d.algo_a AND t.algo_b = d.algo_b AND d.k = len(t.ranks) GROUP BY ALL),
 scores AS (SELECT *, CASE WHEN m > 0 AND m * (m + 1) * (2 * m + 1) / 24.0 > ties / 48
  THEN abs(w - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48) / sqrt(2.0::DOUBLE) END AS x FROM facts),
 logs AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 0
  WHEN x < 2.5 THEN ln(1 - 2 / sqrt(pi()) * exp(-x * x) * x * list_sum(list_transform(range(0, 81), lambda n: exp(n * ln(2 * x * x) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1)))))
  ELSE -x * x - 0.5 * ln(pi()) - ln(x + list_reduce(list_prepend(0.0::DOUBLE, range(200, 0, -1)::DOUBLE[]), lambda a, n: n / 2 / (x + a))) END AS l FROM scores),
 raw AS (SELECT l.*, CASE WHEN n_pairs >= 5 THEN coalesce(e.p, CASE WHEN l.l IS NOT NULL THEN least(1.0, exp(l.l)) END) END AS p,
  CASE WHEN n_pairs >= 5 THEN coalesce(least(0.0, l.l / ln(10)), 0.0) END AS log10_p,
  CASE WHEN n_pairs >= 5 THEN CASE WHEN m > 0 THEN 1 - 2 * w / (m * (m + 1) / 2.0) ELSE 0 END END AS effect
  FROM logs l LEFT JOIN exact e USING (algo_a, algo_b)),
 stepped AS (SELECT algo_a, algo_b, p * (count(*) OVER () - row_number() OVER (ORDER BY p, algo_a, algo_b) + 1) AS s, p FROM raw WHERE p IS NOT NULL),
 holm AS (SELECT algo_a, algo_b, least(1.0, max(s) OVER (ORDER BY p, algo_a, algo_b ROWS UNBOUNDED PRECEDING)) AS c FROM stepped)
 SELECT algo_a, algo_b, n_pairs, CASE WHEN n_pairs >= 5 THEN round(median_a, 7) END AS median_a, CASE WHEN n_pairs >= 5 THEN round(median_b, 7) END AS median_b,
  CASE WHEN n_pairs >= 5 THEN round(median_a - median_b, 7) END AS median_diff,
  CASE WHEN n_pairs >= 5 THEN CASE WHEN median_a < median_b THEN 'a < b' WHEN median_a > median_b THEN 'a > b' ELSE 'equal' END END AS direction,
  CASE WHEN n_pairs >= 5 THEN w::DOUBLE END AS w_statistic, round(p, {places}) AS p_value, round(log10_p, 7) AS log10_p, round(effect, 7) AS effect_size,
  round(c, {places}) AS corrected_p, coalesce(c < 0.05, false) AS significant_005, coalesce(c < 0.01, false) AS significant_001, coalesce(c < 0.001, false) AS significant_0001,
  CASE WHEN effect IS NULL THEN '' WHEN effect < 0.1 THEN 'negligible' WHEN effect < 0.3 THEN 'small' WHEN effect < 0.5 THEN 'medium' ELSE 'large' END AS effect_magnitude
 FROM raw LEFT JOIN holm USING (algo_a, algo_b)"""

query("significance_tests", "WITH RECURSIVE " + RUNS_SQL + SIGNED + TESTED.format(places=7))(lambda s, d: pairwise.significance_tests(derived(s, d)))


def by_place(s: SparkSession, d: str, level: str, value: str) -> DataFrame:
    """Runs whose problem is a nation or region, so that pairs are few: mean order values by market segment."""
    orders, customers = table(s, d, "orders"), table(s, d, "customer")
    nations, regions = table(s, d, "nation"), table(s, d, "region")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_mktsegment").alias("algorithm"), F.col(level).alias("graph_name"), F.expr(value).alias("wall_time"), F.lit(True).alias("success"))


def coarse(tests: DataFrame) -> DataFrame:
    """All but the p values to 7 places."""
    return tests.withColumns({c: F.round(c, 7) for c in ("median_a", "median_b", "median_diff", "log10_p", "effect_size")})


def _means(level: str, value: str) -> str:
    return f"""WITH RECURSIVE means AS (SELECT {level} AS graph_name, c_mktsegment AS algorithm, avg({value}) AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


# 25 nations: no ties, so p is exact. 5 regions and a value of few levels: ties and zeros, all choices of signs.
for _name, _level, _value, _sql in (
    ("significance_by_nation", "n_name", "o_totalprice", "o_totalprice"),
    ("significance_by_region", "r_name", "case when o_orderkey % 2 = 0 then 1D else 0.5D end", "CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"),
    ("significance_with_ties", "r_name", "double(c_mktsegment in ('BUILDING', 'MACHINERY'))", "(c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT::DOUBLE"),
):
    _tail = (SIGNED + TESTED.format(places=12)).removeprefix(MEANS)
    query(_name, _means(_level, _sql) + _tail, places=12)(lambda s, d, a=_level, v=_value: coarse(pairwise.significance_tests(by_place(s, d, a, v), "wall_time")))
