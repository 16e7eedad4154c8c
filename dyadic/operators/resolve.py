"""Lookups by prioritised keys: vocabularies with fallback, identifier cascades, best entry of a group, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(facts: DataFrame, candidates: Sequence[Column], dictionary: DataFrame, key: str, values: Sequence[str], default: dict[str, Column] | None = None, prefix: str = "") -> DataFrame:
    """facts with the values of the first candidate that dictionary knows.

    One left join a candidate; dictionary keys must be distinct. Adaptive execution broadcasts a dictionary only where its
    measured size allows. matched_by is the number of the candidate, from 1, null where none is known.
    """
    out = facts
    n = len(candidates)
    for i, c in enumerate(candidates):
        side = dictionary.select(F.col(key).alias(f"_k{i}"), F.lit(True).alias(f"_hit{i}"), *(F.col(v).alias(f"_v{i}_{v}") for v in values))
        out = out.withColumn("_c", c).join(side, F.col("_c") == F.col(f"_k{i}"), "left").drop("_c")
    which = F.coalesce(*(F.when(F.col(f"_hit{i}"), F.lit(i + 1)) for i in range(n)))
    picked = []
    for v in values:
        c = F.coalesce(*(F.when(F.col(f"_hit{i}"), F.col(f"_v{i}_{v}")) for i in range(n)))
        picked.append(F.when(which.isNotNull(), c).otherwise((default or {}).get(v, F.lit(None))).alias(prefix + v))
    return out.select(*(f"`{c}`" for c in facts.columns), *picked, which.alias(f"{prefix}matched_by"))


def misses(facts: DataFrame, term: Column, dictionary: DataFrame, key: str) -> DataFrame:
    """Distinct terms that dictionary doesn't know."""
    return facts.select(term.alias("term")).where("term IS NOT NULL").distinct().join(dictionary.select(F.col(key).alias("term")), "term", "left_anti")


def best_of(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def longest(df: DataFrame, by: Sequence[str], length: Column, key: str, out: str) -> DataFrame:
    """Of each group the key of the row of greatest length, the largest key of equals: a partial aggregate, no sort."""
    return df.groupBy(*by).agg(F.max_by(key, F.struct(length, F.col(key))).alias(out))


def both_ends(pairs: DataFrame, a: str, b: str, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs whose two ends are known, with a_value and b_value."""
    side = lambda x: dictionary.select(F.col(key).alias(f"_{x}"), F.col(value).alias(f"{x}_{value}"))
    return pairs.join(side("a"), F.col(a) == F.col("_a")).join(side("b"), F.col(b) == F.col("_b")).drop("_a", "_b")


def coverage(pairs: DataFrame, a: str, b: str, dictionary: DataFrame, key: str) -> DataFrame:
    """metric and value: pairs, pairs with both, one or no end known, and distinct ends that aren't known."""
    ids = dictionary.select(F.col(key).alias("_id")).distinct()
    known = lambda x: ids.select(F.col("_id").alias(f"_{x}"))
    n = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    rows = pairs.join(known("a"), F.col(a) == F.col("_a"), "left").join(known("b"), F.col(b) == F.col("_b"), "left")
    counts = rows.select(F.explode(F.array(F.lit("pairs"), F.element_at(F.array(F.lit("no_end"), F.lit("one_end"), F.lit("both_ends")), n + 1))).alias("metric")).groupBy("metric").agg(F.count("*").alias("value"))
    lost = pairs.select(F.explode(F.array(a, b)).alias("_id")).where("_id IS NOT NULL").distinct().join(ids, "_id", "left_anti")
    return counts.unionByName(lost.agg(F.lit("missing_ids").alias("metric"), F.count("*").alias("value")))


def resolved_vectors(ids: DataFrame, candidates: Sequence[Column], vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """ids with the vector of the first candidate that is known, else size zeros; matched_by as in cascade()."""
    return cascade(ids, candidates, vectors, key, [vector], {vector: F.array_repeat(F.lit(0.0).cast("float"), size)})


def exploded(facts: DataFrame, locus: str, accessions: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """facts once for each accession of their locus, with the greatest weight that it has there."""
    best = accessions.groupBy(F.col(key).alias("_locus"), value).agg(F.max(weight).alias(weight))
    return facts.join(best, F.col(locus) == F.col("_locus")).drop("_locus")


def pair_lengths(pairs: DataFrame, a: str, b: str, lengths: DataFrame, key: str, length: str) -> DataFrame:
    """pairs with pair_length, the sum of both ends' lengths; an unknown one counts 0."""
    side = lambda x: lengths.select(F.col(key).alias(f"_{x}"), F.col(length).alias(f"_len_{x}"))
    out = pairs.join(side("a"), F.col(a) == F.col("_a"), "left").join(side("b"), F.col(b) == F.col("_b"), "left")
    return out.withColumn("pair_length", F.coalesce("_len_a", F.lit(0)) + F.coalesce("_len_b", F.lit(0))).drop("_a", "_b", "_len_a", "_len_b")


def fetched(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that chosen names by keys (such as file and row number), whole."""
    return rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi")
