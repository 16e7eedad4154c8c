"""Test vertices for leak-free partitions: growth from a seed, then refinement at the border, over many restarts.

The pairs of a graph are counted between communities, at most MOST_GROUPS of them: where there are more, communities
share a group by hash, so what a restart works on is bounded, whatever the number of pairs. Every restart is a row, and
restarts run side by side on the executors; each reads the counts as one array. The best of all, by squared error of
the two shares, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import Workspace, ship_package

MOST_GROUPS = 1024  # groups that one restart works on; at most half a million counts, 6 MB
INWARD = 2.8  # fixed value: worth of a pair into the test side over one that leaves it, while it grows


def grow_and_refine(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, cut_share: float, test_share: float, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """The squared error of the shares of cut pairs and of pairs inside the test side, and the test side, of one restart.

    a, b, n: groups of the ends and number of pairs. The side grows from a random group by the group of best score until
    pairs inside reach their share; then single groups at the border change sides while that lessens the error.
    """
    r = np.random.default_rng(seed)
    total = float(n.sum())
    own = np.bincount(a[a == b], n[a == b], size)
    x, y, w = a[a != b], b[a != b], n[a != b].astype(float)
    heads, tails, w = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
    order = np.argsort(heads, kind="stable")
    heads, tails, w = heads[order], tails[order], w[order]
    start = np.searchsorted(heads, np.arange(size + 1))
    degree = np.bincount(heads, w, size)
    inside, inward = np.zeros(size, bool), np.zeros(size)
    two = one = 0.0

    def flip(v: int) -> None:
        nonlocal one, two
        sign = -1 if inside[v] else 1
        two += sign * (own[v] + inward[v])
        one += sign * (degree[v] - 2 * inward[v])
        inside[v] = ~inside[v]
        inward[tails[start[v] : start[v + 1]]] += sign * w[start[v] : start[v + 1]]

    def error(c2: np.ndarray, c3: np.ndarray) -> np.ndarray:
        return (c2 / total - cut_share) ** 2 + (c3 / total - test_share) ** 2

    flip(int(r.integers(size)))
    while two < test_share * total and not inside.all():
        score = np.where(inside, -np.inf, INWARD * (inward + own) - (degree - inward))
        near = score[inward > 0] if (~inside & (inward > 0)).any() else None
        if near is None:  # nothing is linked with the side: a new seed
            flip(int(r.choice(np.flatnonzero(~inside))))
        else:
            flip(int(np.where(inward > 0, score, -np.inf).argmax()))
    for _ in range(steps):
        sign = np.where(inside, -1, 1)
        after = error(one + sign * (degree - 2 * inward), two + sign * (own + inward))
        best = int(after.argmin())
        if after[best] >= error(np.float64(one), np.float64(two)):
            break
        flip(best)
    return float(error(np.float64(one), np.float64(two))), inside


def _trials(size: int, cut_share: float, test_share: float, seed: int, steps: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for restart, links in zip(rows["restart"], rows["links"]):
            a, b, n = (np.array([x[k] for x in links]) for k in ("a", "b", "n"))
            loss, side = grow_and_refine(a, b, n, size, cut_share, test_share, seed + restart, steps)
            yield pd.DataFrame({"restart": [restart], "loss": [loss], "groups": [np.flatnonzero(side)]})


def bisect(pairs: DataFrame, a: str, b: str, communities: DataFrame, cut_share: float, test_share: float, restarts: int = 35, steps: int = 600, seed: int = 42) -> DataFrame:
    """vertex and is_test: whole communities become test vertices so that the share of pairs with one test end comes near cut_share
    and that with two near test_share.

    communities: node, component. No pairs: no test vertices.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    work = Workspace(spark, "bisect")

    def group(component: str) -> Column:
        return F.pmod(F.xxhash64(component), F.lit(MOST_GROUPS)).cast("int")

    side = lambda x: communities.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_k{x}"))
    known = pairs.join(side("a"), F.col(a) == F.col("_a")).join(side("b"), F.col(b) == F.col("_b")).select("_ka", "_kb")
    small = known.select(F.explode(F.array("_ka", "_kb")).alias("k")).distinct().orderBy("k").limit(MOST_GROUPS + 1).withColumn("g", F.row_number().over(Window.orderBy("k")) - 1)  # no more than MOST_GROUPS + 1 rows
    small = work.save(small, "groups")
    few = small.count() <= MOST_GROUPS  # then each community is a group of its own
    numbered = communities.join(F.broadcast(small), F.col("component") == F.col("k")).select("node", F.col("g").alias("_g")) if few else communities.select("node", group("component").alias("_g"))
    of = lambda x: numbered.select(F.col("node").alias(f"_{x}"), F.col("_g").alias(f"_g{x}"))
    counts = pairs.join(of("a"), F.col(a) == F.col("_a")).join(of("b"), F.col(b) == F.col("_b")).groupBy(F.least("_ga", "_gb").alias("a"), F.greatest("_ga", "_gb").alias("b")).agg(F.count("*").alias("n"))
    links = work.save(counts.agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("links")), "links")  # a row a pair of groups
    if not small.isEmpty():
        tried = spark.range(0, restarts, 1, restarts).select(F.col("id").alias("restart")).withColumn("_one", F.lit(1)).join(F.broadcast(links.withColumn("_one", F.lit(1))), "_one").drop("_one")  # the one row beside each
        trials = tried.mapInPandas(partial(_trials, MOST_GROUPS, cut_share, test_share, seed, steps), "restart long, loss double, groups array<int>")
        best = work.save(trials.groupBy().agg(F.min_by("groups", F.struct("loss", "restart")).alias("groups")), "best")
        chosen = best.select(F.explode("groups").alias("_t"))
        return numbered.join(F.broadcast(chosen), F.col("_g") == F.col("_t"), "left").select(F.col("node").alias("vertex"), F.col("_t").isNotNull().alias("is_test"))
    return communities.select(F.col("node").alias("vertex"), F.lit(False).alias("is_test"))
