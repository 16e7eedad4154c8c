"""Similarity graphs: edges, components, redundant pairs, greedy representatives, cluster statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.operators.single import FEW_ROWS, in_one_task
from dyadic.session import Workspace


def identity_fraction(fident: Column) -> Column:
    """Null where it isn't a number; above 1 it is a percentage."""
    return F.when(~F.isnan(fident), F.when(fident > 1, fident / 100).otherwise(fident))


def similarity_edges(alignments: DataFrame, least_identity: float, least_coverage: float, most_evalue: float = 1e-3) -> DataFrame:
    """u < v and their greatest identity over all segments in both directions that are homologous."""
    f = identity_fraction(F.col("fident"))
    q, t = (F.upper(F.trim(c)) for c in ("query", "target"))
    # no fident below the least as it stands can pass, which the scan can tell by itself
    passing = (F.col("fident") >= least_identity) & (f >= least_identity) & (F.least("qcov", "tcov") >= least_coverage) & F.col("qcov").isNotNull() & F.col("tcov").isNotNull() & (F.col("evalue") <= most_evalue)
    return alignments.where(passing).select(F.least(q, t).alias("u"), F.greatest(q, t).alias("v"), f.alias("s")).where("u <> v").groupBy("u", "v").agg(F.max("s").alias("similarity"))


def both_directions(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Symmetric closure; other columns are kept."""
    rest = [c for c in edges.columns if c not in (u, v)]
    ends = F.array(F.struct(F.col(u).alias(u), F.col(v).alias(v)), F.struct(F.col(v).alias(u), F.col(u).alias(v)))
    return edges.select(F.inline(ends), *rest)


def mutual(edges: DataFrame) -> DataFrame:
    """x, y, s: both directions of edges."""
    return both_directions(edges).select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("similarity").alias("s"))


def reflexive(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """x, y, s: both directions of edges, and each node with itself at similarity 1."""
    return mutual(edges).unionByName(nodes.select(F.col(node).alias("x"), F.col(node).alias("y"), F.lit(1.0).alias("s")))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node and component (its smallest node) of every node, alone or not, by alternating large and small stars.

    Each step links the larger (then the smaller) neighbours of a node to its smallest one, until nothing changes;
    steps are O(log^2 n), and a step is two aggregations with partial minima and two joins, written once.
    """
    work = Workspace(edges.sparkSession, "stars")
    current = work.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "e0")
    seen, k = None, 0
    while True:
        around = both_directions(current)
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        k += 1
        current = work.save(small, f"e{k}")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(f"e{k - 1}")
        if state == seen:
            break
        seen = state
    to = current.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return nodes.select(F.col(node).alias("node")).distinct().join(to, F.col("node") == F.col("_u"), "left").select("node", F.coalesce("_v", "node").alias("component"))


def component_keys(pairs: DataFrame, a: str, b: str, parts: DataFrame) -> DataFrame:
    """pairs with component_key, the two ends' components in order; pairs with different keys aren't similar."""
    side = lambda x: parts.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_k{x}"))
    out = pairs.join(side("a"), F.col(a) == F.col("_a")).join(side("b"), F.col(b) == F.col("_b"))
    return out.withColumn("component_key", F.concat_ws("|", F.least("_ka", "_kb"), F.greatest("_ka", "_kb"))).drop("_a", "_b", "_ka", "_kb")


FILTER_BITS = 1 << 23  # in words of 64 bits, so that no more than 2^17 rows are broadcast


def maybe_among(rows: DataFrame, on: str, nodes: DataFrame, node: str) -> DataFrame:
    """rows whose value is among nodes, and a few others: those whose hash meets one of theirs, more as the nodes fill FILTER_BITS.

    To be used before a join, so that most of the rows that it would drop aren't shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = nodes.select(place(node).alias("_h")).groupBy(F.expr("_h div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_h % 64 AS int)))").alias("_bits"))
    placed = rows.withColumn("_h", place(on))
    met = (F.expr("_h div 64") == F.col("_word")) & F.expr("shiftrightunsigned(_bits, cast(_h % 64 AS int)) % 2 <> 0")
    return placed.join(F.broadcast(words), met, "left_semi").drop("_h")


def redundant_pairs(pairs: DataFrame, key: str | Callable[[str, str], Column], a: str, b: str, homologs: DataFrame, distinct: bool = False) -> DataFrame:
    """key_1 < key_2 and similarity of the pairs that are alike: the better of both ways to set ends against ends.

    key: a column, or what makes it of both ends in whatever order, so that it isn't written beside them. homologs: mutual() or
    reflexive(), as each node counts as its own homolog at similarity 1; read once, as pairs are if distinct, else twice.
    distinct: no two pairs have the same ends, in whatever order. Pairs of other ends differ on one side at least, so each match
    is begun at a link of two different homologs, from the end with fewer pairs, and closed on the other side by that side's
    homologs or by the pairs of the link's other end, whichever are fewer. Rows so follow the links and the matches; to expand
    both ends of every pair would make the product of a hub's pairs and its homologs. Pairs of the same ends are met apart.
    """
    work = Workspace(pairs.sparkSession, "alike")
    links = work.save(homologs.where("x <> y").groupBy("x", "y").agg(F.max("s").alias("s")), "links")
    families = links.groupBy("x").agg(F.count("*").alias("n"))
    # pairs by each end that has homologs
    ends = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    turned = maybe_among(pairs.select(F.inline(ends), *([] if callable(key) else [F.col(key).alias("key")])), "x", families, "x")
    near = work.save(turned.join(families, "x", "left_semi"), "near")
    near_of = lambda x, y, k: near.select(F.col("x").alias(x), F.col("y").alias(y), (key("x", "y") if callable(key) else F.col("key")).alias(k))
    n_pairs = lambda x: near.groupBy(F.col("x").alias(f"_{x}")).agg(F.count("*").alias(f"_n{x}"))

    begun = links.select(F.col("x").alias("_c"), F.col("y").alias("_a"), F.col("s").alias("_s")).join(n_pairs("c"), "_c").join(n_pairs("a"), "_a")
    begun = begun.where(F.struct("_nc", "_c") < F.struct("_na", "_a")).join(near_of("_c", "_d", "_k"), "_c").select("_a", "_d", "_s", "_k", "_na")
    begun = work.save(begun, "begun")
    sides = begun.select("_a", "_d", "_na").distinct().join(families.select(F.col("x").alias("_d"), F.col("n").alias("_nd")), "_d", "left")
    sides = work.save(sides.withColumn("_nd", F.coalesce("_nd", F.lit(0)) + 1), "sides")
    other = links.select(F.col("x").alias("_d"), F.col("y").alias("_b"), F.col("s").alias("_t"))
    other = other.unionByName(sides.select("_d", F.col("_d").alias("_b"), F.lit(1.0).alias("_t")).distinct())
    closed = [
        sides.where("_nd <= _na").join(other, "_d").join(near_of("_a", "_b", "_l"), ["_a", "_b"]),
        sides.where("_nd > _na").join(near_of("_a", "_b", "_l"), "_a").join(other, ["_d", "_b"]),
    ]
    closed = closed[0].select("_a", "_d", "_l", "_t").unionByName(closed[1].select("_a", "_d", "_l", "_t"))
    met = begun.join(closed, ["_a", "_d"]).where("_k <> _l").select(F.least("_k", "_l").alias("key_1"), F.greatest("_k", "_l").alias("key_2"), F.least("_s", "_t").alias("_s"))
    if not distinct:
        same = pairs.groupBy(F.least(a, b).alias("_p"), F.greatest(a, b).alias("_q")).agg(F.collect_list(key(a, b) if callable(key) else key).alias("_keys")).where("size(_keys) > 1 AND _p IS NOT NULL AND _q IS NOT NULL")
        same = same.select(F.explode("_keys").alias("key_1"), "_keys").select("key_1", F.explode("_keys").alias("key_2"), F.lit(1.0).alias("_s"))
        met = met.unionByName(same.where("key_1 < key_2"))
    return met.groupBy("key_1", "key_2").agg(F.max("_s").alias("similarity"))


def _greedy_tail(links: pa.Table) -> pa.RecordBatch:
    """The members among the ends of links (hi before lo), node by node in order."""
    hi, lo = (links.column(i).to_numpy() for i in (0, 1))
    taken: set[int] = set()
    order = np.lexsort((hi, lo))
    for h, x in zip(hi[order].tolist(), lo[order].tolist()):
        if x not in taken and h not in taken:
            taken.add(x)
    return pa.RecordBatch.from_arrays([pa.array(sorted(taken), pa.int64())], names=["taken"])


def greedy_members(links: DataFrame, work: Workspace) -> DataFrame | None:
    """lo and first: in order of rank, each node still free takes its free neighbours; of each node taken, the first that would.

    links: a written table of distinct ranks hi < lo, read several times. Rounds decide many
    nodes at once: a node none of whose undecided neighbours comes before it is a representative, its undecided neighbours are
    members. That is exactly the sequential result. Links that are
    left when they are few are decided one after the other by one task, so that a long chain in order of rank needs no round
    for every two of its nodes. None without links.
    """
    left, taken, k = links, None, 0
    while n := left.count():
        if n <= FEW_ROWS:
            new = work.save(in_one_task(left.select("hi", "lo"), _greedy_tail, "taken long"), f"taken{k}")
        else:
            heads = left.select("hi").distinct().join(left.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
            new = work.save(left.join(heads, "hi", "left_semi").select(F.col("lo").alias("taken")).distinct(), f"taken{k}")
        taken = new if taken is None else taken.unionByName(new)
        if n <= FEW_ROWS:
            break
        # what is taken has no more say; heads that lose all edges are done
        kept = left.join(new, F.col("hi") == F.col("taken"), "left_anti").join(new, F.col("lo") == F.col("taken"), "left_anti")
        left = work.save(kept, f"left{k + 1}")
        work.drop(f"left{k}")
        k += 1
    if taken is None:
        return None
    free = links.join(taken, F.col("hi") == F.col("taken"), "left_anti").groupBy("lo").agg(F.min("hi").alias("first"))
    return free.join(taken, F.col("lo") == F.col("taken"), "left_semi")


BLOCK = 1 << 16  # ranks whose nodes are placed by one task


def greedy_clusters(nodes: DataFrame, node: str, links: DataFrame, rank: str) -> DataFrame:
    """node, representative, is_representative and cluster_id, consecutive in the order of representatives, by greedy_members().

    nodes: with ranks from 1 without gaps; links as there. All nodes are shuffled once, by blocks of ranks, in which they meet
    what was decided: a representative's id is its rank less the members before it.
    """
    work = Workspace(links.sparkSession, "clusters")
    named = nodes.select(F.col(rank).alias("r"), F.col(node).alias("node"))
    members = greedy_members(links, work)
    if members is None:
        return named.select("node", F.col("node").alias("representative"), F.lit(True).alias("is_representative"), F.col("r").alias("cluster_id"))
    members = work.save(members, "members")
    block = F.expr(f"r div {BLOCK}").alias("_block")
    counts = named.select(block, F.lit(0).alias("_n")).unionByName(members.select(F.col("lo").alias("r")).select(block, F.lit(1).alias("_n"))).groupBy("_block").agg(F.sum("_n").alias("_n"))
    ahead = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_ahead"))
    rows = named.unionByName(members.select(F.col("lo").alias("r"), "first"), True).unionByName(members.select(F.col("first").alias("r"), F.lit(True).alias("head")).distinct(), True)
    rows = rows.withColumn("_block", block).repartition("_block").groupBy("_block", "r").agg(*(F.max(c).alias(c) for c in ("node", "first", "head")))
    before = F.count("first").over(Window.partitionBy("_block").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    placed = work.save(rows.join(ahead, "_block").select("r", "node", "first", "head", (F.col("r") - F.col("_ahead") - before).alias("cluster_id")), "placed")
    heads = placed.where("head").select(F.col("r").alias("first"), F.col("node").alias("representative"), F.lit(False).alias("is_representative"), "cluster_id")
    alone = placed.where("first IS NULL").select("node", F.col("node").alias("representative"), F.lit(True).alias("is_representative"), "cluster_id")
    return alone.unionByName(placed.where("first IS NOT NULL").select("node", "first").join(heads, "first").drop("first"))


def greedy_representatives(nodes: DataFrame, node: str, edges: DataFrame, rank: str) -> DataFrame:
    """node, representative and is_representative, by greedy_members().

    nodes: a written table, read several times. edges: u, v. rank: distinct whole numbers, the smallest first, null for a node
    without edges; they stand for the nodes in all rounds.
    """
    work = Workspace(edges.sparkSession, "greedy")
    ranks = nodes.select(F.col(node).alias("node"), F.col(rank).cast("long").alias("r")).where("r IS NOT NULL")
    side = lambda x: ranks.select(F.col("node").alias(x), F.col("r").alias(f"r_{x}"))
    directed = edges.join(side("u"), "u").join(side("v"), "v").where("r_u <> r_v")
    links = work.save(directed.select(F.least("r_u", "r_v").alias("hi"), F.greatest("r_u", "r_v").alias("lo")).distinct(), "links")
    members = greedy_members(links, work)
    if members is None:
        return nodes.select(F.col(node).alias("node"), F.col(node).alias("representative"), F.lit(True).alias("is_representative"))
    name = lambda r, out: ranks.select(F.col("r").alias(r), F.col("node").alias(out))
    member = members.join(name("lo", "_node"), "lo").join(name("first", "_rep"), "first").select("_node", "_rep")
    placed = nodes.select(F.col(node).alias("node")).join(member, F.col("node") == F.col("_node"), "left")
    return placed.select("node", F.coalesce("_rep", "node").alias("representative"), F.col("_rep").isNull().alias("is_representative"))


def priority(order: list[Column], nodes: DataFrame, out: str = "rank") -> DataFrame:
    """nodes with their number in order."""
    from dyadic.operators.ordering import ranked

    return ranked(nodes, [], order, out)


def cluster_statistics(members: DataFrame, cluster: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Clusters, mean, largest, smallest and smallest non-singleton size, singletons, and clusters of several."""
    sizes = members.groupBy(*by, cluster).agg(F.count("*").alias("n"))
    n = F.col("n")
    return sizes.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.sum(n).alias("n_members"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"), F.min(n).alias("min_size"), F.min(F.when(n > 1, n)).alias("min_multi_size"), F.count_if(n == 1).alias("n_singletons"), F.count_if(n > 1).alias("n_multi"))


SALT_MEMBERS = 2_000  # members of a cluster that meet the others under one key


def intra_cluster_pairs(members: DataFrame, cluster: str, key: str) -> DataFrame:
    """cluster, key_1 < key_2 of all pairs within a cluster; as many as there are, so cluster_density counts without them.

    The second members of a cluster are spread over as many salts as their number asks for.
    """
    rows = members.select(F.col(cluster).alias("cluster"), F.col(key).alias("_key"))
    salts = rows.groupBy("cluster").agg(F.expr(f"1 + (count(*) - 1) div {SALT_MEMBERS}").cast("int").alias("_salts"))
    left = rows.join(salts, "cluster").select("cluster", F.col("_key").alias("key_1"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    right = rows.join(salts, "cluster").select("cluster", F.col("_key").alias("key_2"), F.pmod(F.xxhash64("_key"), F.col("_salts")).cast("int").alias("_salt"))
    return left.join(right, ["cluster", "_salt"]).where("key_1 < key_2").select("cluster", "key_1", "key_2")


def cluster_density(members: DataFrame, cluster: str, key: str, similar: DataFrame, least: float) -> DataFrame:
    """Of each cluster with two members or more: size, pairs, pairs of similarity least or more, density, and their statistics.

    Pairs that similar (key_1, key_2, similarity) doesn't have are of similarity 0; only known ones are joined, and the
    pairs are counted from the size.
    """
    sizes = members.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")).where("n > 1").withColumn("n_pairs", F.expr("n * (n - 1) div 2"))
    of = lambda x: members.select(F.col(key).alias(x), F.col(cluster).alias(f"_c{x}"))
    inside = similar.join(of("key_1"), "key_1").join(of("key_2"), "key_2").where("_ckey_1 = _ckey_2")
    known = inside.groupBy(F.col("_ckey_1").alias("cluster")).agg(F.count("*").alias("n_known"), F.count_if(F.col("similarity") >= least).alias("n_similar"), F.sum("similarity").alias("total"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("least_known"))
    full = F.coalesce("n_known", F.lit(0)) == F.col("n_pairs")
    return sizes.join(known, "cluster", "left").select("cluster", "n", "n_pairs", F.coalesce("n_similar", F.lit(0)).alias("n_similar"), (F.coalesce("n_similar", F.lit(0)) / F.col("n_pairs")).alias("density"), (F.coalesce("total", F.lit(0.0)) / F.col("n_pairs")).alias("mean_similarity"), F.when(full, F.col("least_known")).otherwise(0.0).alias("min_similarity"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def sweep(edges: DataFrame, nodes: DataFrame, node: str, grid: list[tuple[float, float]], similarity: str, coverage: str) -> DataFrame:
    """Component statistics at every point (least similarity, least coverage) of a grid, in one run.

    An edge takes part in every point that it satisfies; components are those of (point, node).
    """
    points = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(s).alias("theta"), F.lit(c).alias("coverage_min")) for i, (s, c) in enumerate(grid)))
    name = lambda p, n: F.concat_ws(":", p, n)
    at = edges.select("u", "v", F.col(similarity).alias("_s"), F.col(coverage).alias("_c"), F.explode(points).alias("_p")).where("_s >= _p.theta AND _c >= _p.coverage_min")
    e = at.select(name(F.col("_p.point"), F.col("u")).alias("u"), name(F.col("_p.point"), F.col("v")).alias("v"))
    n = nodes.select(F.explode(points).alias("_p"), F.col(node)).select(name(F.col("_p.point"), F.col(node)).alias("node"))
    stats = cluster_statistics(components(n, e).withColumn("point", F.substring_index("node", ":", 1).cast("int")), "component", ("point",))
    thetas = F.create_map(*(F.lit(x) for i, (s, c) in enumerate(grid) for x in (i, s)))
    covers = F.create_map(*(F.lit(x) for i, (s, c) in enumerate(grid) for x in (i, c)))
    return stats.withColumn("theta", F.element_at(thetas, F.col("point"))).withColumn("coverage_min", F.element_at(covers, F.col("point"))).drop("point")


def top_groups(members: DataFrame, group: str, n: int) -> DataFrame:
    return members.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.desc("size"), group).limit(n)


def hubs(edges: DataFrame, u: str, v: str, weight: Column, n: int) -> DataFrame:
    """node and weight of the n nodes of greatest weighted degree, ties by node; a top-n, so no more than n rows are gathered."""
    ends = edges.select(F.inline(F.array(F.struct(F.col(u).alias("node"), weight.alias("w")), F.struct(F.col(v).alias("node"), weight.alias("w")))))
    return ends.where("node IS NOT NULL").groupBy("node").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "node").limit(n)


def hub_edges(edges: DataFrame, u: str, v: str, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among nodes, a result of hubs(), whose n bounds what is broadcast."""
    side = lambda x: nodes.select(F.col("node").alias(x))
    return edges.join(F.broadcast(side(u)), u, "left_semi").join(F.broadcast(side(v)), v, "left_semi")
