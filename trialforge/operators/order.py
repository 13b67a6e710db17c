"""Running totals, exact quantiles and average ranks without a sort of a whole group in one task.

Rows are range-partitioned by (keys, order) and stored; totals of the partitions before give each
partition its start, and rows are summed within partitions only. A group with a third of all rows
spreads over as many partitions as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.sources.shared import cut


def running(rows: DataFrame, keys: list[str], order: list[str], column: str, out: str, how: str = "sum") -> DataFrame:
    """The rows with the sum (or least, or greatest) of `column` over all earlier rows of their keys; null for the first.

    Rows of one keys and order should be distinct; ties have an arbitrary order.
    """
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    ranged = cut(rows.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id()), "ranged")
    # a row for each partition, and one more for each key at most
    parts = ranged.groupBy(*keys, "_part").agg(f(column).alias("_whole"))
    before = f("_whole").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_start"))
    within = f(column).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = ranged.withColumn("_within", within).join(starts, same)
    both = {"sum": F.coalesce(F.col("_start") + F.col("_within"), "_start", "_within"), "min": F.least("_start", "_within"), "max": F.greatest("_start", "_within")}[how]
    return joined.select(*rows.columns, both.alias(out))


def long_values(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """(keys, metric, value, n): how often each value of each column occurs."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in columns.items()])
    flat = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.value").where("value is not null")
    return flat.groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))


def exact_quantiles(rows: DataFrame, keys: list[str], columns: dict[str, Column], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, metric, n, q): the exact quantiles (linear between neighbours) of each column, as an array."""
    counted = running(long_values(rows, keys, columns), [*keys, "metric"], ["value"], "n", "before").withColumn("before", F.coalesce("before", F.lit(0)))
    total = counted.groupBy(*keys, "metric").agg(F.sum("n").alias("total"))
    joined = counted.join(total, [*keys, "metric"])
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("total") - 1) * F.lit(share)
        for name, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value"))).alias(f"{name}{i}"))
    found = joined.groupBy(*keys, "metric", "total").agg(*picks)
    q = []
    for i, share in enumerate(shares):
        at = (F.col("total") - 1) * F.lit(share)
        q.append(F.col(f"lo{i}") + (at - F.floor(at)) * (F.col(f"hi{i}") - F.col(f"lo{i}")))
    return found.select(*keys, "metric", F.col("total").alias("n"), F.array(*q).alias("q"))


def medians(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """(keys, a column for each metric): exact medians, null without values."""
    found = exact_quantiles(rows, keys, columns)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("q")[0])).alias(m) for m in columns])


def average_rank_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value, rank): ranks of the values of each column over all rows, ties sharing the mean rank."""
    counted = running(long_values(rows, [], {c: F.col(c) for c in columns}), ["metric"], ["value"], "n", "before")
    return counted.select("metric", "value", (F.coalesce("before", F.lit(0)) + (F.col("n") + 1) / 2.0).alias("rank"))
