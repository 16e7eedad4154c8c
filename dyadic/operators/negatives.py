"""Candidate negatives: pairs with disjoint categories, less known positives and their interologs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.numeric import bits_set
from dyadic.operators.ordering import numbered
from dyadic.session import Workspace, ship_package


def category_mask(rows: DataFrame, key: str, bit: Column) -> DataFrame:
    """key and the mask of all its categories, given as bit numbers below 31."""
    return rows.groupBy(key).agg(bits_set(bit).alias("mask"))


CHUNK = 5  # bits by which prefixes of masks grow
SALT_ROWS = 10_000  # items of one mask that meet its partners under one key


def fitting_masks(masks: DataFrame, mask: str) -> DataFrame:
    """mask_u and mask_v of all pairs of the distinct masks (below 2^31, not 0) that have no bit in common.

    Prefixes of CHUNK bits more are matched from step to step, so that masks that clash early go no further; each step
    is two equi-joins, and only the number of bits comes to the driver.
    """
    bits = (masks.agg(F.max(mask)).first()[0] or 0).bit_length()
    low = lambda k: F.col(mask).bitwiseAND(F.lit((1 << min(k, 31)) - 1))
    pairs = None
    for k in range(0, bits, CHUNK):
        grown = masks.select(low(k).alias("_from"), low(k + CHUNK).alias("_to")).distinct()
        of = lambda x: grown.select(F.col("_from").alias(f"_{x}"), F.col("_to").alias(x))
        apart = F.col("mask_u").bitwiseAND(F.col("mask_v")) == 0
        if pairs is None:
            pairs = of("mask_u").join(of("mask_v"), F.col("_mask_u") == F.col("_mask_v")).where(apart).select("mask_u", "mask_v")
        else:
            known = pairs.toDF("_u", "_v")
            pairs = known.join(of("mask_u"), F.col("_u") == F.col("_mask_u")).join(of("mask_v"), F.col("_v") == F.col("_mask_v")).where(apart).select("mask_u", "mask_v")
    return masks.limit(0).select(F.col(mask).alias("mask_u"), F.col(mask).alias("mask_v")) if pairs is None else pairs


def disjoint_pairs(items: DataFrame, key: str, mask: str) -> DataFrame:
    """u < v and their masks, of all items whose masks are not 0 and have no bit in common.

    Distinct masks are matched with each other first; items then meet by equi-join on the mask
    that fits theirs, so that no pair is made that doesn't belong to the result. Items of a mask are spread over as many salts
    as their number asks for; the others go to each of them.
    """
    known = items.where(F.col(mask) > 0).select(F.col(key).alias("id"), F.col(mask).alias("mask"))
    counts = known.groupBy("mask").agg(F.expr(f"1 + (count(*) - 1) div {SALT_ROWS}").cast("int").alias("_salts"))
    salts = counts.select(F.col("mask").alias("_m"), "_salts")
    targets = fitting_masks(counts, "mask").join(salts, F.col("mask_v") == F.col("_m")).select("mask_u", "mask_v", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    left = known.join(targets, F.col("mask") == F.col("mask_u")).select(F.col("id").alias("u"), "mask_u", "mask_v", "_salt")
    right = known.join(salts, F.col("mask") == F.col("_m")).select(F.col("id").alias("v"), F.col("mask").alias("mask_v"), F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int").alias("_salt"))
    return left.join(right, ["mask_v", "_salt"]).where("u < v").select("u", "v", "mask_u", "mask_v")


def without(pairs: DataFrame, prohibited: DataFrame) -> DataFrame:
    """pairs (u < v) that are not prohibited (u < v); pairs with a null end stay."""
    return pairs.join(prohibited.select("u", "v"), ["u", "v"], "left_anti")


def interologs(positives: DataFrame, homologs: DataFrame) -> DataFrame:
    """Distinct u < v: every pair of homologs of the two ends of a positive pair (u, v), the ends among them.

    homologs: x, y with each x among its own.
    """
    side = lambda x: homologs.select(F.col("x").alias(f"_{x}"), F.col("y").alias(f"_y{x}"))
    grown = positives.select("u", "v").join(side("u"), F.col("u") == F.col("_u")).join(side("v"), F.col("v") == F.col("_v"))
    return grown.select(F.least("_yu", "_yv").alias("u"), F.greatest("_yu", "_yv").alias("v")).where("u <> v").distinct()


CELL_SIDES = 6  # parts of the nodes, at least; a task for every two of them
NAMES = 1 << 12  # nodes whose names make one row
PART_NODES = 1 << 20  # nodes of a part, at most
LINK, PAIR, NAME = range(3)  # kinds of a cell's rows
CELL_ROWS = 1 << 19  # pairs that a task makes at a time, but for a node that alone has more


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, counts[i] of them, for every i."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _members(nodes: np.ndarray, links: tuple[np.ndarray, np.ndarray], first: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the sorted nodes (by its place) the homologs from first to before after, itself among them, in order of places."""
    x, y = links
    inside = (y >= first) & (y < after)
    x, y = x[inside], y[inside]
    at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
    known, own = nodes[at] == x, np.flatnonzero((nodes >= first) & (nodes < after))
    at, y = np.concatenate([at[known], own]), np.concatenate([y[known], nodes[own]])
    order = np.argsort(at, kind="stable")
    return at[order], y[order]


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = left << 32 | right
    codes.sort()
    codes = codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes
    return codes >> 32, codes & 0xFFFFFFFF


def _cell_pairs(pairs: tuple[np.ndarray, np.ndarray], links: tuple[np.ndarray, np.ndarray], i: int, j: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct u < v, u of part i and v of part j, with u homologous to the first and v to the second end of a pair."""
    a, b = _distinct(*pairs)
    a_nodes, a_starts, a_counts = np.unique(a, return_index=True, return_counts=True)
    b_nodes, b_at = np.unique(b, return_inverse=True)
    of_b, v = _members(b_nodes, links, j * size, j * size + size)
    b_counts = np.bincount(of_b, minlength=len(b_nodes))
    b_starts = np.cumsum(b_counts) - b_counts
    of_a, u = _members(a_nodes, links, i * size, i * size + size)
    order = np.argsort(u, kind="stable")
    of_a, u = of_a[order], u[order]
    # a piece ends where a node's rows end
    before = np.cumsum(np.add.reduceat(b_counts[b_at], a_starts)[of_a]) if len(a) else a
    ends = np.flatnonzero(np.append(u[1:] != u[:-1], True)) + 1 if len(u) else u
    reach, begin = before[ends - 1], 0
    while begin < len(u):
        reached = np.searchsorted(reach, (before[begin - 1] if begin else 0) + CELL_ROWS, "right")
        end = int(ends[max(reached - 1, np.searchsorted(ends, begin, "right"))])
        h, w = of_a[begin:end], u[begin:end]
        w, to = _distinct(np.repeat(w, a_counts[h]), b_at[_ragged(a_starts[h], a_counts[h])])
        w, z = np.repeat(w, b_counts[to]), v[_ragged(b_starts[to], b_counts[to])]
        if i == j:
            w, z = w[w < z], z[w < z]
        yield _distinct(w, z)
        begin = end


def _cell(cells: list[tuple[int, int]], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell, by name, from its rows: names of its two parts, links into them, and pairs that reach both."""
    held, named, cell = {LINK: [], PAIR: []}, {}, None
    for rows in batches:
        if not rows.num_rows:
            continue
        cell = rows.column("cell")[0].as_py()
        for kind, into in held.items():
            some = rows.filter(pc.equal(rows.column("kind"), kind))
            into.append([some.column(c).to_numpy() for c in "xy"])
        some = rows.filter(pc.equal(rows.column("kind"), NAME))
        named |= dict(zip(some.column("x").to_pylist(), (x.values for x in some.column("names"))))
    if cell is None:
        return
    (i, j), (links, pairs) = cells[cell], (tuple(np.concatenate(x) for x in zip(*v)) for v in held.values())
    if not len(pairs[0]):
        return
    first, second = (pa.concat_arrays([named[k] for k in sorted(named) if k // size == part]) for part in (i, j))
    for u, v in _cell_pairs(pairs, links, i, j, size):
        if len(u):
            yield pa.RecordBatch.from_arrays([first.take(pa.array(u - i * size)), second.take(pa.array(v - j * size))], names=["u", "v"])


def interologs_in_cells(positives: DataFrame, homologs: DataFrame, names: int = NAMES) -> DataFrame:
    """interologs() of so many positives that their expansion can't be shuffled; each node is its own homolog, whether homologs has it or not.

    Nodes are numbered in order and cut into parts; a task makes all pairs of two parts, so that no other makes them. What goes to it
    are the names of both, the links into them, and the positives whose ends have homologs there: of a hub's positive, a row
    for each part. The expansion itself is made, freed of repetitions and returned piece by piece. names: nodes whose names make
    one row; parts are multiples of it.
    """
    spark = positives.sparkSession
    ship_package(spark)
    work = Workspace(spark, "interologs")
    positives = work.save(positives.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"), "positives")
    links = work.save(homologs.where("x <> y").select("x", "y").distinct(), "links")
    nodes = positives.select(F.explode(F.array("u", "v")).alias("node")).union(links.select("x")).union(links.select("y")).distinct()
    nodes = work.save(numbered(nodes, [F.col("node")]).select("node", (F.col("rank") - 1).alias("n")), "nodes")
    n = nodes.count()
    parts = max(CELL_SIDES, -(-n // PART_NODES))
    size = max(1, -(-n // (parts * names))) * names
    parts = max(1, -(-n // size))
    cells = [(i, j) for i in range(parts) for j in range(i, parts)]

    part = lambda c: F.expr(f"{c} div {size}").cast("int")
    number = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
    links = work.save(links.join(number("x"), "x").join(number("y"), "y").select("x", "nx", "ny"), "numbers")
    reach = links.groupBy(F.col("x").alias("node")).agg(F.collect_set(part("ny")).alias("_parts"))
    reach = work.save(nodes.join(reach, "node", "left").select("node", "n", F.array_union(F.array(part("n")), F.coalesce("_parts", F.array().cast("array<int>"))).alias("parts")), "reach")
    end = lambda x: reach.select(F.col("node").alias(x), F.struct("n", "parts").alias(f"_{x}"))
    both = positives.join(end("u"), "u").join(end("v"), "v").select(F.inline(F.array(F.struct(F.col("_u").alias("a"), F.col("_v").alias("b")), F.struct(F.col("_v").alias("a"), F.col("_u").alias("b")))))
    cell = F.expr(f"i * {parts} - i * (i - 1) div 2 + j - i").cast("int").alias("cell")
    in_cells = both.select("a", "b", F.explode("a.parts").alias("i")).select(F.col("a.n").alias("x"), F.col("b.n").alias("y"), "i", F.explode(F.expr("filter(b.parts, p -> p >= i)")).alias("j"))
    beside = lambda df, c: df.select("*", part(c).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_q")).withColumns({"i": F.least("_p", "_q"), "j": F.greatest("_p", "_q")})
    block = nodes.groupBy(F.expr(f"n div {names} * {names}").alias("x")).agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("_rows")).select("x", F.col("_rows.node").alias("names"))
    row = lambda df, kind: df.select(cell, F.lit(kind).alias("kind"), "x", "y" if "y" in df.columns else F.lit(0).cast("long").alias("y"), "names" if "names" in df.columns else F.lit(None).cast("array<string>").alias("names"))
    rows = row(in_cells, PAIR).unionByName(row(beside(links.select(F.col("nx").alias("x"), F.col("ny").alias("y")), "y"), LINK)).unionByName(row(beside(block, "x"), NAME))
    return rows.repartitionById(len(cells), F.col("cell")).mapInArrow(partial(_cell, cells, size), "u string, v string")


def union_with_support(sources: dict[str, DataFrame]) -> DataFrame:
    """Distinct pairs of all sources with the sorted names of those that have them."""
    rows = [df.select("u", "v").withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("u", "v").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count_distinct("source").alias("n_sources"))
