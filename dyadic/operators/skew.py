"""Results per key where a few keys hold most rows (problem 3), by value-frequency compression.

Rows are first grouped by key and value, with the number of rows as weight: that key is spread over as many tasks
as its values fill, and repeated values shrink to one weighted row before and after the shuffle. Results per key
come from the weighted rows. Counts, distinct counts, bests and modes are partial aggregates again, so of a hot key
each task sends on one row. Exact quantiles need the values in order: the weighted rows are range-partitioned by key and
value, running weights are summed within a partition, and each partition gets the weight that its key has before it.

Null and missing values have no part in distinct counts, bests, modes and quantiles but count as rows; null keys
form a group, as in GROUP BY, and callers filter it. Of equally frequent values the mode is the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import Workspace, is_missing


def compress(df: DataFrame, key: Column, value: Column, best: Column | None = None) -> DataFrame:
    """key, value, weight and the best (largest) of each pair of key and value."""
    top = [F.max("_best").alias("best")] if best is not None else []
    rows = df.select(key.alias("key"), value.alias("value"), *([best.alias("_best")] if best is not None else []))
    return rows.groupBy("key", "value").agg(F.count("*").alias("weight"), *top)


def per_key(weighted: DataFrame) -> DataFrame:
    """key, n_rows, n_distinct, mode, and best where there is one."""
    best = [F.max("best").alias("best")] if "best" in weighted.columns else []
    mode = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("weight"), F.col("value")))).alias("mode")
    return weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"), mode, *best)


def _upto(weighted: DataFrame) -> DataFrame:
    """key, value, the weight that its key has up to and with value (upto), and in all (total)."""
    work = Workspace(weighted.sparkSession, "quantiles")
    ordered = weighted.where("value IS NOT NULL").select("key", "value", "weight").repartitionByRange("key", "value")
    ordered = work.save(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("key", "part").agg(F.sum("weight").alias("w"))
    span = Window.partitionBy("key")
    before = sums.select(F.col("key").alias("_key"), F.col("part").alias("_part"), (F.sum("w").over(span.orderBy("part")) - F.col("w")).alias("before"), F.sum("w").over(span).alias("total"))
    upto = F.col("before") + F.sum("weight").over(Window.partitionBy("key", "part").orderBy("value"))
    return ordered.join(before, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))).select("key", "value", upto.alias("upto"), "total")


def quantiles(weighted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """key and, for each name in shares, the smallest value below or at which that share of the key's rows lies."""
    return _upto(weighted).groupBy("key").agg(*(F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("value"))).alias(name) for name, q in shares.items()))


def interpolated(weighted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """key, total, and for each name in shares the value at that share of the way from the first to the last row, between two rows in proportion."""
    at = {name: q * (F.col("total") - 1) for name, q in shares.items()}
    value = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    ends = [value(f(c)).alias(f"_{end}_{name}") for name, c in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))]
    out = _upto(weighted).groupBy("key").agg(F.max("total").alias("total"), *ends)
    return out.select("key", "total", *((F.col(f"_lo_{n}") + (c - F.floor(c)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, c in at.items()))


def upper_medians(weighted: DataFrame) -> DataFrame:
    """key and upper_median, the value of row n // 2, counted from 0, of the n rows in order."""
    return _upto(weighted).groupBy("key").agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("value"))).alias("upper_median"))


def known(column: str) -> Column:
    """The value as stored, null where it is missing."""
    return F.when(~is_missing(column), F.col(column))


def identity(fident: str = "fident") -> Column:
    """The fraction: above 1 it is a percentage; null where it isn't a number."""
    f = F.col(fident)
    return F.when(~F.isnan(f), F.when(f > 1, f / 100).otherwise(f))


def hot_keys(keys: DataFrame, n_rows: int, share: float) -> DataFrame:
    """Of per_key's result, the keys with at least share of n_rows."""
    return keys.where(F.col("key").isNotNull() & (F.col("n_rows") >= share * n_rows))


#: A key with at least one of so many parts of the rows is hot; there are at most so many, so they can be broadcast.
HOT_PARTS = 1000


def total_weight(lookup: DataFrame, weight: str) -> int:
    return max(1, lookup.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])


def meet(rows: DataFrame, lookup: DataFrame, on: str, weight: str, values: list[str], total: int | None = None) -> DataFrame:
    """rows with values of the lookup row whose key equals theirs; rows without one are left out.

    lookup: a written table of distinct keys with weight, no less than the number of rows that hold each. The rows of hot
    keys stay where they are and meet the hot lookup rows by broadcast. A key is hot from one HOT_PARTS-th of the sum of
    all weights, so that no more than HOT_PARTS keys are. The others are shuffled. total: total_weight(lookup), where it
    has been taken before.
    """
    total = total_weight(lookup, weight) if total is None else total
    is_hot = F.col("_weight") * HOT_PARTS >= total
    side = lookup.select(F.col(on).alias("_on"), F.col(weight).alias("_weight"), *values)
    hot = F.broadcast(side.where(is_hot).drop("_weight"))
    here = rows.join(hot, F.col(on) == F.col("_on"), "inner")
    rest = rows.join(hot.select("_on"), F.col(on) == F.col("_on"), "left_anti").join(side.where(~is_hot).drop("_weight"), F.col(on) == F.col("_on"), "inner")
    return here.unionByName(rest).drop("_on")
