"""Leak-free partitions of a pair graph: test vertices, hold-outs, quotas, folds, and the audit of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.operators.ordering import ranked


def unit_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the values and the seed only; md5, so that other engines have the same."""
    text = F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def label_by_test_vertices(pairs: DataFrame, a: str, b: str, test: DataFrame, vertex: str, names: tuple[str, str, str] = ("C1", "C2", "C3")) -> DataFrame:
    """pairs with partition: none, one or both ends among the test vertices."""
    side = lambda x: test.select(F.col(vertex).alias(f"_{x}")).distinct()
    known = pairs.join(side("a"), F.col(a) == F.col("_a"), "left").join(side("b"), F.col(b) == F.col("_b"), "left")
    n = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    return known.withColumn("partition", F.element_at(F.array(*map(F.lit, names)), n + 1)).drop("_a", "_b")


def degree_safe_holdout(edges: DataFrame, u: str, v: str, share: float, seed: int = 42) -> DataFrame:
    """edges with held_out: up to share of them, such that every vertex keeps an edge that isn't.

    Every vertex protects its edge of smallest hash; of the others those of smallest hash are held out. Where fewer
    are free than the share asks for, all free ones are.
    """
    hashed = edges.withColumn("_h", F.md5(F.concat_ws("|", F.col(u), F.col(v), F.lit(str(seed)))))
    ends = hashed.select("_h", F.explode(F.array(u, v)).alias("_node"))
    kept = ends.groupBy("_node").agg(F.min("_h").alias("_h")).select("_h").distinct()
    free = ranked(hashed.join(kept, "_h", "left_anti"), [], [F.col("_h"), F.col(u), F.col(v)], "_rank")
    quota = int(edges.count() * share)
    out = free.where(F.col("_rank") <= quota).select("_h", F.lit(True).alias("held_out"))
    return hashed.join(out, "_h", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False))).drop("_h")


def take_best(df: DataFrame, pool: str, quotas: dict[str, int], score: str, ids: Sequence[str], seed: int = 42, cap: bool = False) -> DataFrame:
    """Of each pool its quota of rows by score, ties by hash; a pool that is too small is an error unless cap."""
    if not cap:
        sizes = {r[pool]: r["n"] for r in df.where(F.col(pool).isin(*quotas)).groupBy(pool).agg(F.count("*").alias("n")).collect()}
        short = {p: q for p, q in quotas.items() if sizes.get(p, 0) < q}
        if short:
            raise ValueError(f"pools with too few rows: {short}")
    most = F.create_map(*(F.lit(x) for item in quotas.items() for x in item))
    rows = df.where(F.col(pool).isin(*quotas)).withColumn("_tie", F.md5(F.concat_ws("|", *ids, F.lit(str(seed)))))
    place = F.row_number().over(Window.partitionBy(pool).orderBy(F.col(score).desc_nulls_last(), F.col("_tie"), *map(F.col, ids)))
    # the largest quota, a literal, limits each pool before the shuffle
    return rows.withColumn("rank", place).where(F.col("rank") <= max(quotas.values())).where(F.col("rank") <= most[F.col(pool)]).withColumn("rank", F.col("rank").cast("long")).drop("_tie")


def folds(df: DataFrame, ids: Sequence[str], k: int, by: Sequence[str] = (), seed: int = 42, out: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1: rows in the order of a hash go to the folds in turn, within each class of by."""
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", *ids, F.lit(str(seed)))))
    return ranked(rows, list(by), [F.col("_h"), *map(F.col, ids)], "_rank").withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank")


def stratified_holdout(df: DataFrame, ids: Sequence[str], share: float, by: Sequence[str], seed: int = 42) -> DataFrame:
    """df with held_out: of each class of by the given share, rounded down, by hash."""
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", *ids, F.lit(str(seed)))))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_n")
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return ranked(rows, list(by), [F.col("_h"), *map(F.col, ids)], "_rank").join(sizes, on).withColumn("held_out", F.col("_rank") <= F.floor(F.col("_n") * share)).select(*df.columns, "held_out")


def both_orders(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair in both orders, with swapped."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    orders = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b), F.lit(False).alias("swapped")), F.struct(F.col(b).alias(a), F.col(a).alias(b), F.lit(True).alias("swapped")))
    return pairs.select(F.inline(orders), *rest)


def random_order(pairs: DataFrame, a: str, b: str, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Pairs of which a hash swaps about half."""
    swap = unit_hash(*ids, seed=seed) < 0.5
    return pairs.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))})


def audit(partitioned: DataFrame, a: str, b: str, name: str, expected: dict[str, float], tolerance: float, given: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """check, result, target and passed of a partition into C1 (train), C2, C3 and maybe C4 (both test), in one table.

    No pair may be in two partitions, C3 and C4 share no vertex with C1, every C2 pair has just one end among the
    vertices of C1's side, and the shares are within tolerance. given and key: the rows that were to be partitioned; each key
    must be there exactly once, and no other.
    """
    rows = partitioned.groupBy(F.col(name).alias("p")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("all", F.sum("n").over(Window.partitionBy()))  # a row a partition of the pairs
    shares = rows.select(F.concat(F.lit("share_"), F.col("p")).alias("check"), (F.col("n") / F.col("all")).alias("result"), F.element_at(F.create_map(*(F.lit(x) for kv in expected.items() for x in kv)), F.col("p")).alias("target"))

    def exact(check: str, wrong: DataFrame) -> DataFrame:
        return wrong.agg(F.lit(check).alias("check"), F.count("*").cast("double").alias("result"), F.lit(0.0).alias("target"))

    checks = [exact("pairs_in_two_partitions", partitioned.groupBy(F.least(a, b), F.greatest(a, b)).agg(F.count_distinct(name).alias("n")).where("n > 1"))]
    sides = F.when(F.col(name) == "C1", "train").when(F.col(name).isin("C3", "C4"), "test")
    ends = partitioned.select(F.explode(F.array(a, b)).alias("v"), sides.alias("side")).where("v IS NOT NULL")
    kept = ends.where("side IS NOT NULL").groupBy("v").agg(F.count_distinct("side").alias("n"), F.min("side").alias("side"))
    checks.append(exact("vertices_in_train_and_test", kept.where("n > 1")))
    if key is not None and given is not None:
        both = given.select(key, F.lit(1).alias("_n"), F.lit(0).alias("_m")).unionByName(partitioned.select(key, F.lit(0).alias("_n"), F.lit(1).alias("_m")))
        checks.append(exact("rows_lost_or_doubled", both.groupBy(key).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).where("_n <> _m")))
        known = lambda x: kept.select(F.col("v").alias(x), F.col("side").alias(f"_{x}"))
        cut = partitioned.where(F.col(name) == "C2").select(F.col(a).alias("x"), F.col(b).alias("y"))
        checks.append(exact("cut_pairs_on_one_side", cut.join(known("x"), "x").join(known("y"), "y").where("_x = _y")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("passed", F.col("result") == F.col("target")).unionByName(shares.withColumn("passed", F.abs(F.col("result") - F.col("target")) <= tolerance))


def overlaps(members: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Number of keys that occur in more than one part, and in how many; no row: all parts are disjoint."""
    return members.groupBy(*keys).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1").groupBy("n_parts").agg(F.count("*").alias("n_keys"))
