"""Quality gates: each is a count of violations; those of one table come from one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.text import null_sentinel


def missing(c: str) -> Column:
    """Null, empty, or a spelling of null."""
    return null_sentinel(F.col(c).cast("string")).isNull()


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """gate, violations and status of each rule; a rule is true for a row that violates it."""
    counts = df.agg(*(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("gate"), F.col(name).alias("violations")) for name in rules))
    return counts.select(F.inline(pairs)).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_missing of each column, in one scan."""
    counts = df.agg(*(F.count_if(missing(c)).alias(c) for c in columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns))))


def forbidden_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return sorted(set(df.columns) & set(names))


def closure(df: DataFrame, value: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """Distinct values that the vocabulary doesn't have, with their number of rows."""
    known = vocabulary.select(F.col(term).alias("value")).distinct()
    return df.select(F.col(value).alias("value")).where(~missing(value)).groupBy("value").agg(F.count("*").alias("n_rows")).join(known, "value", "left_anti")


def conservation(df: DataFrame, by: Sequence[str], rejected: Column) -> DataFrame:
    """n_input, n_normalized, n_rejected and the percentage of each group; the first is the sum of the other two."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n_input"), F.count_if(~rejected).alias("n_normalized"), F.count_if(rejected).alias("n_rejected"))
    return counts.withColumn("rejection_rate_pct", F.round(100 * F.col("n_rejected") / F.col("n_input"), 4)).withColumn("conserved", F.col("n_input") == F.col("n_normalized") + F.col("n_rejected"))


def same_set(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """only_left and only_right: numbers of distinct keys that just one side has; both 0 where the sets are equal."""
    keys = left.select(*columns).distinct().withColumn("_side", F.lit(1)).unionByName(right.select(*columns).distinct().withColumn("_side", F.lit(2)))
    return keys.groupBy(*columns).agg(F.sum("_side").alias("_s")).agg(F.count_if(F.col("_s") == 1).alias("only_left"), F.count_if(F.col("_s") == 2).alias("only_right"))


def gate(name: str, violations: DataFrame) -> DataFrame:
    """gate, violations and status of a check that is the number of rows of violations."""
    return violations.agg(F.lit(name).alias("gate"), F.count("*").alias("violations")).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def checksums(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """path and what of each file that differs from the registry (path, sha256): missing, unknown, empty, changed."""
    have = manifest.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_have"))
    what = F.when(F.col("_have").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("_size") == 0, "empty").when(F.col("_have") != F.col("sha256"), "changed")
    return registry.join(have, "path", "full_outer").withColumn("what", what).where("what IS NOT NULL").select("path", "what")


def forbidden(df: DataFrame, names: Sequence[str], gate_name: str = "forbidden_columns") -> DataFrame:
    """The gate that none of these columns is there; read from the schema."""
    n = len(forbidden_columns(df, names))
    return df.sparkSession.range(1).select(F.lit(gate_name).alias("gate"), F.lit(n).cast("long").alias("violations"), F.lit("FAIL" if n else "PASS").alias("status"))


def rejection_gate(counts: DataFrame, most_pct: float) -> DataFrame:
    """The gate that no group of conservation() rejects most_pct per cent or more."""
    return gate("rejection_rate", counts.where(F.col("rejection_rate_pct") >= most_pct))


def no_aggregation(df: DataFrame, pair: str) -> DataFrame:
    """pairs, and the records beyond the first of their pair, which shows that records aren't merged; always PASS."""
    return df.groupBy(pair).agg(F.count("*").alias("_n")).agg(F.lit("no_pair_aggregation").alias("gate"), F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_beyond_first"), F.lit("PASS").alias("status"))


def schema_gate(df: DataFrame, expected: dict[str, str], gate_name: str = "schema") -> DataFrame:
    """The gate that df has these columns, of these types, in this order; violations are the places that differ."""
    have, want = df.dtypes, list(expected.items())
    n = sum(x != y for x, y in zip(have, want)) + abs(len(have) - len(want))
    return df.sparkSession.range(1).select(F.lit(gate_name).alias("gate"), F.lit(n).cast("long").alias("violations"), F.lit("FAIL" if n else "PASS").alias("status"))
