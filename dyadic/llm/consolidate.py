"""Groups everything that pairwise matches link, directly or through others (problem 1): Borůvka hooking.

Each round every component selects its smallest outgoing edge, an edge being ordered by its smaller
and then its larger end. Of the edges at one component that is the edge to its smallest neighbour, so the selection is a
groupBy with a partial minimum, however many neighbours a component has. The selections form trees apart from one
pair in each tree whose two components select each other; the smaller of the two is the tree's root. Pointer
doubling collapses the trees, going on only with the components that haven't found their root yet; edges are relabelled
with the roots, made distinct, and the rest goes to the next round. Each round at least halves the components that
still have edges.

A root is the smallest of its tree: on the way from x to the root every second component is no larger than the
one two before it, since that is a neighbour of the one between, and of the root's pair the smaller is taken. So the
labels of the roots are the smallest members, and unwinding the rounds gives every member its group's.

Nulls: an edge with a null end or equal ends links nothing. Repeated edges and both directions count once. No
edges: an empty result. Joins on a common label are split by adaptive execution; all tables between rounds are
written to the shared folder. Numbers instead of names were tried: to put them in, and names back, took more than the rounds
saved, since the first round leaves a tenth of the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.llm import contraction
from dyadic.session import Workspace


def distinct_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair of different ends once, as u < v."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()


def _hooks(edges: DataFrame) -> DataFrame:
    """Each component and its parent: the smallest neighbour, or itself at a root."""
    picks = contraction.directed(edges).groupBy("c").agg(F.min("n").alias("p"))
    # two that pick each other are a row twice; by pairs, so that a parent of many is no hot key
    mutual = picks.groupBy(F.least("c", "p").alias("_root"), F.greatest("c", "p").alias("_other")).agg(F.count("*").alias("_n")).where("_n = 2").select("_root")
    return picks.join(mutual, F.col("c") == F.col("_root"), "left").select("c", F.coalesce("_root", "p").alias("p"))


def _roots(edges: DataFrame, work: Workspace, k: int) -> DataFrame:
    """Each component and the root of its tree: pointer doubling.

    A component is done when its pointer is known to be a root. Those that aren't take their parent's pointer, and
    are done if the parent is; a step writes only them.
    """
    hooks = work.save(_hooks(edges), f"hooks{k}")
    done, left, step = hooks.where("c = p"), hooks.where("c <> p"), 0
    while True:
        pointers = lambda d, flag: d.select(F.col("c").alias("_c"), F.col("p").alias("_p"), F.lit(flag).alias("done"))
        known = pointers(left, False).unionByName(pointers(done, True))
        new = work.save(left.join(known, F.col("p") == F.col("_c")).select("c", F.col("_p").alias("p"), "done"), f"step{k}_{step}")
        done, left, step = done.unionByName(new.where("done").drop("done")), new.where("NOT done").drop("done"), step + 1
        if left.isEmpty():
            return done


def _last_rounds(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The same rounds over numbered ends, in one task: the root of each number."""
    label, own = np.arange(n), np.arange(n)
    while len(a):
        parent = np.full(n, n)
        np.minimum.at(parent, a, b)
        np.minimum.at(parent, b, a)
        parent = np.where(parent < n, parent, own)
        parent = np.where((parent[parent] == own) & (own < parent), own, parent)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        a, b = contraction.kept_edges(parent[a], parent[b], n)
    return label


def connected_groups(edges: DataFrame, a: str, b: str, member: str = "member", group: str = "group_id") -> DataFrame:
    """member and group: every end of an edge, with the smallest member that is linked with it."""
    work = Workspace(edges.sparkSession, "boruvka")
    left = work.save(distinct_edges(edges, a, b), "edges0")
    labels = contraction.contracted(left, work, lambda e, k: _roots(e, work, k), _last_rounds)
    if labels is None:
        return left.select(F.col("u").alias(member), F.col("v").alias(group))
    return labels.select(F.col("c").alias(member), F.col("p").alias(group))


#: What surrounds ids: white space of ASCII and the no-break space.
AROUND = " \t\n\v\f\r\u00a0"


def alignment_matches(alignments: DataFrame, least_identity: float = 0.5) -> DataFrame:
    """query and target, stripped and in upper case, of the rows that match; a fident above 1 is a percentage.

    Null and not-a-number never match, nor do rows without one of the ids. least_identity is at most 1, so that no row
    whose fident is below it as it stands can match, which the scan can tell by itself.
    """
    fident = F.col("fident")
    share = F.when(fident > 1, fident / 100).otherwise(fident)
    clean = [F.upper(F.btrim(F.col(c), F.lit(AROUND))).alias(c) for c in ("query", "target")]
    return alignments.where((fident >= least_identity) & ~F.isnan(fident) & (share >= least_identity)).select(*clean).where("query <> target and query <> '' and target <> ''")
