"""Element-wise pooling of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elementwise(df: DataFrame, by: str, vector: str) -> DataFrame:
    """For each value of by the mean, max and min at every position of its vectors, as arrays as long as the longest.

    Null elements, and positions that a shorter vector lacks, are left out.
    """
    at = df.select(by, F.posexplode(vector).alias("_i", "_x")).withColumn("_x", F.col("_x").cast("double"))
    each = at.groupBy(by, "_i").agg(F.avg("_x").alias("mean"), F.max("_x").alias("max"), F.min("_x").alias("min"))

    def joined(c: str) -> Column:
        return F.transform(F.col("_all"), lambda x: x[c]).alias(c)

    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", "mean", "max", "min"))).alias("_all")).select(by, *map(joined, ("mean", "max", "min")))


def symmetrised(df: DataFrame, by: str, i: str, j: str, weight: str) -> DataFrame:
    """Entries of a square matrix and of its transpose together: by, i <= j, and the mean of both, an entry without counterpart halved.

    Symmetrised attention: each pair of positions has one weight whatever its order; on the diagonal it stays.
    """
    lo, hi = F.least(i, j), F.greatest(i, j)
    total = F.sum(F.col(weight).cast("double"))
    return df.groupBy(by, lo.alias("i"), hi.alias("j")).agg(total.alias("_t")).select(by, "i", "j", F.when(F.col("i") == F.col("j"), F.col("_t")).otherwise(F.col("_t") / 2).alias("weight"))


def attention_pooled(df: DataFrame, attention: DataFrame, by: str, position: str, vector: str) -> DataFrame:
    """For each value of by the mean of its vectors weighted by the attention that their positions get (symmetrised(): i, j, weight).

    Positions without weight count as 0; by without any weight has no row.
    """
    ends = attention.select(by, F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("_p"), "weight")
    share = ends.groupBy(by, "_p").agg(F.sum("weight").alias("_w")).where("_w <> 0")
    rows = df.select(by, F.col(position).alias("_p"), vector).join(share, [by, "_p"])
    at = rows.select(by, "_w", F.posexplode(vector).alias("_i", "_x"))
    each = at.groupBy(by, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_all")).select(by, F.transform("_all", lambda x: x["_m"]).alias("pooled"))
