"""Train, validation and test splits that keep related records together (problem 6): random-mate contraction.

Records are linked by what they share. Every shared value gets the smallest key of the records that hold it, and those
keys are the vertices: a record links the keys of its values. Each round every vertex throws a coin (a hash of the
vertex and the round); a vertex with tails joins its smallest neighbour with heads. One grouped pass gives every vertex
its new label, joins relabel the edges, which are made distinct, until none is left; a quarter or more of the
vertices with edges is expected to go each round. Unwinding the rounds backwards gives every vertex its family, and a record
has the family of any of its values. A record without a value is a family of its own.

Families are then split by cumulative weight (rows). Those over GIANT of all rows, fewer than 1 / GIANT, are placed
one by one, the largest first, each where most room is left for it in proportion; the others follow in the order
of a hash of the family and fill what each split lacks. The running sum is taken within hash buckets, whose sums are
a small table, so no task sums all families. Shares miss the given ones by less than a family at each border.

Rows meet their family's row by a join that leaves the rows of large families where they are.

Nulls and missing values link nothing; repeated records, ties and both columns holding one value need no care. An
empty table gives an empty result. Rows with equal keys are one record, and come out once; a row without
a key is no record.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm import contraction
from dyadic.operators.skew import meet
from dyadic.session import Workspace

GIANT = 0.001  # share of the rows from which a family is placed by itself
BUCKET_FAMILIES = 50_000  # families that one running sum holds, on average


def _heads(vertex: str) -> Column:
    """The coin of a vertex in the round that column turn numbers; a column, so that all rounds run the same code."""
    return F.xxhash64(F.col(vertex), F.col("turn")) % 2 == 0


def _last_rounds(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The same rounds over numbered ends, in one task, with coins from a generator: the last label of each number."""
    label, coins = np.arange(n), np.random.default_rng(n)
    while len(a):
        heads = coins.integers(0, 2, n).astype(bool)
        mate = np.full(n, n)
        for x, y in ((a, b), (b, a)):
            joins = ~heads[x] & heads[y]
            np.minimum.at(mate, x[joins], y[joins])
        mate = np.where(mate < n, mate, np.arange(n))
        label = mate[label]
        a, b = contraction.kept_edges(mate[a], mate[b], n)
    return label


def _mates(edges: DataFrame, work: Workspace, k: int) -> DataFrame:
    """Each vertex and its mate: its smallest neighbour with heads where it has tails, else itself."""
    ends = contraction.directed(edges).withColumn("turn", F.lit(k))
    mate = F.coalesce(F.min(F.when(~_heads("c") & _heads("n"), F.col("n"))), F.col("c"))
    return work.save(ends.groupBy("c").agg(mate.alias("p")), f"mates{k}")


def families(records: DataFrame, key: str, shared: list[Column], work: Workspace | None = None) -> DataFrame:
    """key and first_key of every record: the smallest key of all records that are linked with it.

    shared: texts that link records; null links nothing. Columns whose values must not meet need prefixes.
    """
    work = work or Workspace(records.sparkSession, "families")
    values = F.array_compact(F.array(*shared))
    if not isinstance(records.schema[key].dataType, T.IntegralType):
        # numbers in the order of the keys stand for them
        keys = records.select(F.col(key).alias("_name")).where("_name IS NOT NULL").distinct().repartitionByRange("_name").sortWithinPartitions("_name")
        keys = work.save(keys.select("_name", F.monotonically_increasing_id().alias("_number")), "keys")
        numbered = records.select(F.col(key).alias("_name"), values.alias("_values")).join(keys, "_name").select("_number", "_values")
        found = families(numbered, "_number", [F.col("_values")], work)
        names = lambda x, out: keys.select(F.col("_number").alias(x), F.col("_name").alias(out))
        return found.join(names("_number", key), "_number").join(names("first_key", "_first"), "first_key").select(key, F.col("_first").alias("first_key"))
    if len(shared) == 1 and isinstance(records.select(shared[0]).schema[0].dataType, T.ArrayType):
        values = shared[0]
    rows = work.save(records.select(F.col(key).alias("_key"), values.alias("_values")).where("_key IS NOT NULL"), "rows")
    held = rows.select("_key", F.explode("_values").alias("_value"))
    owners = work.save(held.groupBy("_value").agg(F.min("_key").alias("_owner"), F.count("*").alias("n")), "owners")
    # of each record the distinct owners of its values, no more than it has values
    owned = meet(held, owners, "_value", "n", ["_owner"]).select("_key", "_owner").unionByName(rows.where("size(_values) = 0").select("_key", F.lit(None).cast("long").alias("_owner")))
    stars = work.save(owned.groupBy("_key").agg(F.array_sort(F.collect_set("_owner")).alias("_owners")), "stars")
    links = stars.where("size(_owners) > 1").select(F.col("_owners")[0].alias("u"), F.explode(F.expr("slice(_owners, 2, size(_owners))")).alias("v")).distinct()
    labels = contraction.contracted(work.save(links, "edges0"), work, lambda e, k: _mates(e, work, k), _last_rounds)
    first = stars.where("size(_owners) > 0").select("_key", F.col("_owners")[0].alias("_vertex"))
    least = first.groupBy("_vertex").agg(F.count("*").alias("n"))
    if labels is None:
        least = least.withColumn("first_key", F.col("_vertex"))
    else:
        labels = work.save(labels, "labels")
        smallest = labels.groupBy("p").agg(F.min("c").alias("_least")).select(F.col("p").alias("_p"), "_least")
        known = labels.join(smallest, F.col("p") == F.col("_p")).select("c", "_least")
        least = least.join(known, F.col("_vertex") == F.col("c"), "left").select("_vertex", "n", F.coalesce("_least", "_vertex").alias("first_key"))
    together = meet(first, work.save(least, "least"), "_vertex", "n", ["first_key"]).select("_key", "first_key")
    alone = stars.where("size(_owners) = 0").select("_key", F.col("_key").alias("first_key"))
    return together.unionByName(alone).select(F.col("_key").alias(key), "first_key")


def split_by_weight(members: DataFrame, key: str, shares: dict[str, float], work: Workspace | None = None, seed: int = 42) -> DataFrame:
    """key, first_key and split for the result of families(): whole families, close to shares of the rows."""
    work = work or Workspace(members.sparkSession, "split")
    members = work.save(members, "members")
    weights = work.save(members.groupBy("first_key").agg(F.count("*").alias("weight")), "weights")
    total, n = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    whole = sum(shares.values())
    room = {name: total * share / whole for name, share in shares.items()}
    giants = weights.where(F.col("weight") > GIANT * total).collect()  # fewer than 1 / GIANT
    placed: dict[str, list] = {name: [] for name in shares}
    for row in sorted(giants, key=lambda r: (-r["weight"], str(r["first_key"]))):
        name = max(room, key=lambda x: (min(0.0, room[x] - row["weight"]), room[x]))
        placed[name].append(row["first_key"])
        room[name] -= row["weight"]
    left = total - sum(r["weight"] for r in giants)
    open_room = {name: max(0.0, r) for name, r in room.items()}
    scale = left / (sum(open_room.values()) or 1)
    order, at = [], 0.0
    for name, r in open_room.items():
        at += r * scale
        order.append((name, at))

    buckets = 1 + n // BUCKET_FAMILIES
    rest = weights.where(F.col("weight") <= GIANT * total).withColumn("_h", F.xxhash64("first_key", F.lit(seed)))
    rest = rest.withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    ahead = rest.groupBy("_bucket").agg(F.sum("weight").alias("_w"))
    ahead = ahead.select("_bucket", (F.sum("_w").over(Window.orderBy("_bucket")) - F.col("_w")).alias("_ahead"))  # a row for BUCKET_FAMILIES families
    running = F.sum("weight").over(Window.partitionBy("_bucket").orderBy("_h", "first_key"))
    middle = running - F.col("weight") / 2 + F.col("_ahead")
    tag = reduce(lambda c, x: c.when(middle < x[1], F.lit(x[0])), order[:-1], F).otherwise(F.lit(order[-1][0])) if len(order) > 1 else F.lit(order[-1][0])
    tagged = rest.join(ahead, "_bucket").select("first_key", "weight", tag.alias("split"))
    for name, keys in placed.items():
        if keys:
            tagged = tagged.unionByName(weights.where(F.col("first_key").isin(keys)).select("first_key", "weight", F.lit(name).alias("split")))
    return meet(members, work.save(tagged, "tagged"), "first_key", "weight", ["split"]).select(key, "first_key", "split")
