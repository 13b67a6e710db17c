"""Tails of distributions as column expressions, so that tests need no Python on the way."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From here on the continued fraction is used; below, the power series.
CROSSING = 2.5


def ln_erfc(x: Column) -> Column:
    """ln erfc(x) for x >= 0: one less the series of erf, and further out the continued fraction, which does not underflow."""
    square = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, n: F.struct((acc["term"] * 2 * square / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * square / (2 * n + 1)).alias("total")),
        lambda acc: acc["total"],
    )
    near = F.log(1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series)
    fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, n: n / 2 / (x + acc))
    return F.when(x < CROSSING, near).otherwise(-square - 0.5 * math.log(math.pi) - F.log(x + fraction))


def signed_rank_tails(sums: DataFrame, key: list[str]) -> DataFrame:
    """(key, tail): the two-sided exact p of the least signed-rank sum, over all choices of signs.

    `sums` has a row for each key with `steps` (the ranks times two, as an array of longs) and `w` (the least sum).
    A recursive query adds one rank at a time to an array of how many choices give each sum.
    """
    keys = ", ".join(key)
    return sums.sparkSession.sql(
        f"""WITH RECURSIVE spread({keys}, steps, w, k, ways) AS (
          SELECT {keys}, steps, w, 0, array(1L) FROM {{sums}}
          UNION ALL
          SELECT {keys}, steps, w, k + 1, zip_with(concat(ways, array_repeat(0L, steps[k]::int)), concat(array_repeat(0L, steps[k]::int), ways), (x, y) -> x + y)
          FROM spread WHERE k < size(steps))
        SELECT {keys}, least(1D, 2 * aggregate(slice(ways, 1, floor(2 * w)::int + 1), 0L, (x, y) -> x + y) / pow(2D, size(steps))) AS tail
        FROM spread WHERE k = size(steps)""",
        sums=sums,
    )
