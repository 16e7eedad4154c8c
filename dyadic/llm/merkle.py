r"""Finds records that differ in formatting or field order only (problem 4): bottom-up hashing.

A record is a tree. Leaves are texts, normalised to their ASCII letters and digits in upper case; an unordered
node has the digest of its children's sorted digests, an ordered node that of its children's digests in order.
Every row's key, root digest and normalised tree are written once. Rows are grouped by root digest alone, with the
smallest and the largest tree of each group: where these are equal, all trees of the group are, which confirms it by full
comparison. Trees that differ under one digest are grouped by digest and tree.

Groups are aggregated before they are shuffled, so a group that holds a third of all rows is a few partial rows; when
rows are given their group's first key, they carry key and digest only, and the rows of large groups aren't
shuffled. Rows without any content (no leaf left) have no copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.operators.skew import meet
from dyadic.session import Workspace, is_missing


@dataclass(frozen=True)
class Leaf:
    value: Column


@dataclass(frozen=True)
class Node:
    children: Sequence[Leaf | Node]
    ordered: bool = False


def normalised(value: Column) -> Column:
    """The ASCII letters and digits, in upper case."""
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def _digest(tree: Leaf | Node) -> Column:
    """Root digest of a tree of normalised leaves; a leaf's and a node's differ even over equal text."""
    if isinstance(tree, Leaf):
        return _hash(F.concat(F.lit("leaf:"), tree.value))
    parts = F.array(*map(_digest, tree.children))
    return _hash(F.concat(F.lit("list:" if tree.ordered else "set:"), F.array_join(parts if tree.ordered else F.array_sort(parts), ",")))


def _canonical(tree: Leaf | Node) -> Column:
    """The whole record as text, children of unordered nodes sorted; equal only for equal records."""
    if isinstance(tree, Leaf):
        return tree.value
    parts = F.array(*map(_canonical, tree.children))
    return F.concat(F.lit("[" if tree.ordered else "{"), F.array_join(parts if tree.ordered else F.array_sort(parts), ","), F.lit("]" if tree.ordered else "}"))


def _with_leaves(tree: Leaf | Node, put: Callable[[Leaf], Leaf]) -> Leaf | Node:
    return put(tree) if isinstance(tree, Leaf) else Node([_with_leaves(c, put) for c in tree.children], tree.ordered)


def hashed(df: DataFrame, keep: Sequence[str | Column], tree: Leaf | Node) -> DataFrame:
    """keep, digest and content (the normalised tree) of each row; every leaf is normalised once."""
    leaves: list[Column] = []

    def put(leaf: Leaf) -> Leaf:
        leaves.append(F.coalesce(normalised(leaf.value), F.lit("")).alias(f"_leaf{len(leaves)}"))
        return Leaf(F.col(f"_leaf{len(leaves) - 1}"))

    flat = _with_leaves(tree, put)
    kept = df.select(*keep, *leaves)
    return kept.select(*(f"`{c}`" for c in kept.columns[: len(keep)]), F.unhex(_digest(flat)).alias("digest"), _canonical(flat).alias("content"))


def _groups(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """digest, first_key and n_copies of the digests that one tree has; and digest, content, first_key, n_copies of the others, if any."""
    merged = [F.min("_key").alias("first_key"), F.count("*").alias("n_copies")]
    groups = work.save(rows.groupBy("digest").agg(*merged, F.min("content").alias("_lo"), F.max("content").alias("_hi")), "groups")
    mixed = groups.where("_lo <> _hi").select("digest")
    several = None if mixed.isEmpty() else work.save(rows.join(mixed, "digest", "left_semi").groupBy("digest", "content").agg(*merged), "several")
    return groups.where("_lo = _hi").select("digest", "first_key", "n_copies"), several


def copy_groups(df: DataFrame, key: str, tree: Leaf | Node, is_empty: Column) -> DataFrame:
    """first_key (the smallest) and n_copies of each record that has content."""
    work = Workspace(df.sparkSession, "merkle")
    groups, several = _groups(work.save(hashed(df.where(~is_empty), [F.col(key).alias("_key")], tree), "rows"), work)
    groups = groups.select("first_key", "n_copies")
    return groups if several is None else groups.unionByName(several.select("first_key", "n_copies"))


def copies(df: DataFrame, key: str, tree: Leaf | Node, is_empty: Column) -> DataFrame:
    """key, first_key and n_copies of each row that has copies."""
    work = Workspace(df.sparkSession, "merkle")
    rows = work.save(hashed(df.where(~is_empty), [F.col(key).alias("_key")], tree), "rows")
    groups, several = _groups(rows, work)
    out = meet(rows.select("_key", "digest"), groups.where("n_copies > 1"), "digest", "n_copies", ["first_key", "n_copies"]).drop("digest")
    if several is not None:
        out = out.unionByName(rows.join(several.where("n_copies > 1"), ["digest", "content"]).select("_key", "first_key", "n_copies"))
    return out.select(F.col("_key").alias(key), "first_key", "n_copies")


def pair_tree(df: DataFrame, key: str, a: str = "participant_a_id", b: str = "participant_b_id", pair_key: str = "canonical_pair_key") -> tuple[DataFrame, Node, Column]:
    """key and the two ids of each row, the tree of an unordered pair of them, and whether a row has none.

    Both ids are from pair_key where one is missing, null where there is none; they are separated by a run
    of | ~ ; : , or blanks, or failing that by one underscore. Each step is a projection of its own, so that nothing is computed twice.
    """
    lost = is_missing(a) | is_missing(b) | ~F.col(a).rlike("[A-Za-z0-9]") | ~F.col(b).rlike("[A-Za-z0-9]")
    rows = df.select(F.col(key).alias("_id"), F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(pair_key).alias("_k"), lost.alias("_lost"))
    whole = F.when(F.col("_lost") & ~is_missing("_k"), F.regexp_replace("_k", r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    rows = rows.select("_id", "_a", "_b", "_lost", whole.alias("_whole"))
    rows = rows.select("_id", "_a", "_b", "_lost", F.split("_whole", r"[|~;:,\s]+").alias("_marks"), F.split("_whole", "_").alias("_lines"))
    parts = F.when(F.size("_marks") == 2, F.col("_marks")).when((F.size("_marks") == 1) & (F.size("_lines") == 2), F.col("_lines"))
    rows = rows.select("_id", "_a", "_b", "_lost", parts.alias("_parts"))
    ids = [F.when(F.col("_lost"), F.col("_parts")[i]).otherwise(F.col(x)).alias(y) for i, x, y in ((0, "_a", "_left"), (1, "_b", "_right"))]
    return rows.select(F.col("_id").alias(key), *ids), Node([Leaf(F.col("_left")), Leaf(F.col("_right"))]), F.col("_left").isNull() | F.col("_right").isNull()
