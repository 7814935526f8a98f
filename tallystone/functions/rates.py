"""Aggregates and statistics that the metrics share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smoothed_rate(hit: Column) -> Column:
    """Hits over one more than the rows; 0 for no rows."""
    return F.count_if(hit) / (F.count(F.lit(1)) + 1)


def density(n: Column, size: Column) -> Column:
    """Number per 1,000 of size; 0 where the size is 0."""
    return F.coalesce(F.try_divide(n * 1000.0, size), F.lit(0.0))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at half the number of rows of the sorted values, by ranks: no group is collected."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(order).alias("__r"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    return ranked.where(F.col("__r") == F.expr("__n div 2") + 1).select(*keys, F.col(value).alias("upper_median"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: n1, n2, U of the first sample, rank-biserial r = 1 - 2U / (n1 n2), z and two-sided p.

    Average ranks come from counts per distinct value, so ties are one row and the window runs over distinct values.
    p is the tie-corrected normal approximation with continuity correction; the exact distribution is used
    by ``exact_p`` where the smaller sample has 8 or fewer and there are no ties.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(first).alias("a"), F.count("*").alias("n"))
    ranked = per.withColumn("rank", F.sum("n").over(Window.orderBy("v")) - (F.col("n") - 1) / 2)
    one = ranked.agg(F.sum("a").alias("n1"), (F.sum("n") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5), sd)
    return one.select("n1", "n2", u.alias("u"), (1 - F.try_divide(2 * u, n1 * n2)).alias("rank_biserial"), z.alias("z"), F.col("ties"))


def normal_p(z: float | None) -> float:
    """Two-sided tail of the standard normal distribution."""
    return 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: the share of arrangements as extreme, by counting arrangements with each U."""
    counts = {(0, j): {0: 1} for j in range(n2 + 1)}
    for i in range(1, n1 + 1):
        for j in range(n2 + 1):
            own: dict[int, int] = {}
            for k, w in counts[(i - 1, j)].items():  # the largest value is of the first sample: it beats j others
                own[k + j] = own.get(k + j, 0) + w
            if j:
                for k, w in counts[(i, j - 1)].items():
                    own[k] = own.get(k, 0) + w
            counts[(i, j)] = own
    all_ways = counts[(n1, n2)]
    low = min(u, n1 * n2 - u)
    return min(1.0, 2 * sum(w for k, w in all_ways.items() if k <= low) / sum(all_ways.values()))


def group_summary(df: DataFrame, keys: list[str], value: str, high: float) -> DataFrame:
    """Rows, mean, interpolated median and percentage above ``high`` of each group; nulls are left out of all but the row count."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), (100 * F.avg(F.when(v.isNotNull(), (v > high).cast("int")))).alias("pct_high"))
