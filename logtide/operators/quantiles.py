"""Exact discrete percentiles without holding a group's values anywhere.

Values are counted first, one row per (group, value). A group is cut at
approximate percentiles of its different values into ``BUCKETS`` buckets, so each
bucket holds a like share of them however far apart they lie. Running counts over
the buckets find the one that holds the wanted rank; its smallest and largest
value select the rows inside, which are cut again, ``levels`` times in all. Only
what is left then, a share of some 1 in 1,024 of a group's values a level, is ranked by a running sum.

Cuts only decide where to look: ranks come from exact counts, and a bucket is
named by its values, so nothing hangs on how the cuts came out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
LEVELS = 1


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, ``value``, ``n``: occurrences of each non-null value in each group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def with_place(df: DataFrame, cuts: Column, value: Column, buckets: int, name: str) -> DataFrame:
    """``df`` plus ``name``: how many of the ascending ``cuts`` (at most ``buckets`` - 1, a power of 2 less 1) are at or below ``value``.

    A binary search, a projection for each step, so that it is compiled with the plan around it.
    """
    df, step = df.withColumn(name, F.lit(0)), buckets // 2
    while step:
        up = F.when(F.get(cuts, F.col(name) + (step - 1)) <= value, step).otherwise(0)
        df, step = df.withColumn(name, F.col(name) + up), step // 2
    return df


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def _others(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def _inside(rows: DataFrame, keys: list[str], value: str, wanted: Column | None) -> DataFrame:
    """The rows of the bucket that holds the rank: keys, name, value, n, rank (now inside the bucket).

    ``wanted`` turns ``_all`` into an array of (name, rank) at the first level;
    later ``name`` is one of the keys and ``rank`` a column.
    """
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(4 * BUCKETS)).alias("_cuts"), F.sum("n").alias("_all"))
    placed = with_place(rows.join(cuts.select(*_others(keys), "_cuts", "_all"), _same(keys)), F.col("_cuts"), F.col(value), BUCKETS, "_bucket")
    ranked = [F.first("rank").alias("rank")] if wanted is None else [F.first("_all").alias("_all")]
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), *ranked)
    group = Window.partitionBy(*keys)
    sums = sums.withColumn("_upto", F.sum("_n").over(group.orderBy("_bucket")))
    if wanted is not None:
        sums = sums.withColumn("_w", F.explode(wanted)).select("*", "_w.*")
    hits = sums.filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    hits = hits.withColumn("rank", F.col("rank") - (F.col("_upto") - F.col("_n")))
    hits = hits.select(*_others(keys), *([F.col("name")] if wanted is not None else []), "rank", "_lo", "_hi")
    found = rows.drop("rank").join(hits, _same(keys) & F.col(value).between(F.col("_lo"), F.col("_hi")))
    return found.select(*dict.fromkeys([*keys, "name", value, "n", "rank"]))


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float], levels: int = LEVELS) -> DataFrame:
    """keys and, for each (name, p) of ``shares``, the smallest value with at least a share p of the group at or below it.

    Same as SQL ``percentile_disc``. Null keys are a group of their own. Each
    further level cuts what is left of a group by ``BUCKETS`` once more, for groups of more than some 10^9 different values.
    """
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for name, p in shares.items()])
    # The helper columns are rank and name; keys of these names are kept apart.
    own = {k: f"key_{i}" for i, k in enumerate(keys)}
    rows = counts.select(*[F.col(k).alias(own[k]) for k in keys], F.col(value).alias("value"), F.col("n"))
    groups = list(own.values())
    rows = _inside(rows, groups, "value", wanted)
    for _ in range(1, levels):
        rows = _inside(rows, [*groups, "name"], "value", None)
    upto = F.sum("n").over(Window.partitionBy(*groups, "name").orderBy("value"))
    found = rows.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("rank"))
    out = found.groupBy(*groups).agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(f"share_{i}") for i, name in enumerate(shares)])
    return out.toDF(*keys, *shares)
