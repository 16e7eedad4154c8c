"""Running sums and ranks over whole tables and over groups of any size, without one task for a group.

Rows are range-partitioned by group and order and written, so that partition numbers stay as they are. Sums run
within each part of a group; a small table, a row for each group and partition, tells what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import Workspace


def running(df: DataFrame, within: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums up to each row, that row included; order should leave no ties."""
    work = Workspace(df.sparkSession, "running")
    given = df.columns
    parted = df.withColumns({f"_s_{k}": c for k, c in sums.items()}).repartitionByRange(*within, *order)
    parted = work.save(parted.withColumn("_part", F.spark_partition_id()), "parted")
    sizes = parted.groupBy(*within, "_part").agg(*(F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums))
    span = (Window.partitionBy(*within) if within else Window).orderBy("_part")
    same = [F.col(f"_{w}").eqNullSafe(F.col(w)) for w in within]
    ahead = sizes.select(*(F.col(w).alias(f"_{w}") for w in within), F.col("_part").alias("__part"), *((F.sum(f"_t_{k}").over(span) - F.col(f"_t_{k}")).alias(f"_a_{k}") for k in sums))
    on = F.col("_part") == F.col("__part")
    for s in same:
        on = on & s
    rows = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(ahead, on).select(*(F.col(f"`{c}`") for c in given), *((F.sum(f"_s_{k}").over(rows) + F.col(f"_a_{k}")).alias(k) for k in sums))


def ranked(df: DataFrame, within: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """df with the number of each row in its group, from 1."""
    return running(df, within, order, {out: F.lit(1).cast("long")})


def numbered(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """ranked() over the whole table, shuffled once: places within a part are given as the part is written."""
    work = Workspace(df.sparkSession, "numbered")
    parted = work.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "parted")
    parted = parted.withColumn("_part", F.shiftright("_at", 33))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))  # a row for each part
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead") + 1
    return parted.join(F.broadcast(ahead), "_part").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(out))


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """The i-th row of left beside the i-th of right, each in its order; the shorter one ends the result.

    Only for files whose order is their only link.
    """
    return ranked(left, [], left_order, "_n").join(ranked(right, [], right_order, "_n"), "_n").drop("_n")


def runs(df: DataFrame, within: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """For each run of rows with one value that follow each other in order: within, value, first and last place (from 1), n_rows."""
    placed = ranked(df, within, order, "_n")
    follow = placed.select(*(F.col(w).alias(f"_{w}") for w in within), (F.col("_n") + 1).alias("__n"), F.col(value).alias("_before"))
    same = F.col("_n") == F.col("__n")
    for w in within:
        same = same & F.col(f"_{w}").eqNullSafe(F.col(w))
    marked = placed.join(follow, same, "left").withColumn("_starts", F.when(F.col("__n").isNull() | ~F.col(value).eqNullSafe(F.col("_before")), 1).otherwise(0)).select(*within, value, "_n", "_starts")
    numbered = running(marked, within, [F.col("_n")], {"_run": F.col("_starts")})
    return numbered.groupBy(*within, "_run", value).agg(F.min("_n").alias("first_place"), F.max("_n").alias("last_place"), F.count("*").alias("n_rows")).drop("_run")
