"""Fills containers of fixed capacity with documents (problem 8), by linear grouping.

Documents of one size are alike to a plan, and sizes are whole numbers up to the capacity, so the plan is made
from the histogram of sizes: at most capacity + 1 numbers, whatever the count of documents. The driver

1. puts the large sizes (over capacity / LARGE_PARTS) in descending order into GROUPS groups of equal
   cardinality and rounds each size up to the largest of its group,
2. optimises configurations of the few rounded sizes by column generation (a linear program whose columns come
   from a knapsack over the capacity), rounds their numbers down, and packs the bounded rest best-fit,
3. substitutes actual sizes: a slot for a group takes that group's next documents, which can only be smaller,
4. fills what is left best-fit with the small sizes in descending order, run by run.

Its result is a list of rules "documents i .. i+k of the order by size go to containers c .. c+k", whose number
depends on the capacity, not on the documents. Executors number the documents within each size and look the rules up. A
size of more than BUCKET_ROWS documents is divided into buckets by a hash of the key, as many as its number in the histogram
asks for, so that no size, however common, is numbered by one task; a table of those buckets only tells how many
documents are in the ones before.

Every row gets exactly one container for each budget, whole, unless it exceeds the capacity: then its full parts
fill containers of their own and the rest is packed like a document (piece_no counts from 1). Documents
without tokens (null, empty) take no room; they go to the containers in turn. Repeated keys and rows are packed
as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import warnings
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadic.llm import bpe
from dyadic.llm.tokens import count_tokens
from dyadic.session import Workspace, ship_package

GROUPS = 32  # groups of rounded sizes
LARGE_PARTS = 8  # a size over capacity / LARGE_PARTS is large
BUCKET_ROWS = 50_000  # rows that one numbering window holds, on average
PRICING_ROUNDS = 400  # columns that the configurations' linear program takes in


@dataclass
class Plan:
    """Rules as parallel arrays, ordered by the first document: document first[j] + x goes to container to[j] + x."""

    capacity: int
    containers: int = 0
    first: list[int] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    priced_out: bool = True  # whether the linear program ended before PRICING_ROUNDS
    offset: dict[int, int] = field(default_factory=dict)  # of each size in the order by size, descending


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth, as copies of each size."""
    most = int(capacity // sizes.min())
    best = np.zeros(capacity + 1)
    took = []
    for _ in range(most):
        new, choice = best.copy(), np.full(capacity + 1, -1)
        for g, (s, w) in enumerate(zip(sizes, worth)):
            if w > 1e-12:
                better = best[: capacity + 1 - s] + w > new[s:] + 1e-12
                new[s:][better] = (best[: capacity + 1 - s] + w)[better]
                choice[s:][better] = g
        took.append(choice)
        best = new
    copies, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(took):
        if choice[room] >= 0:
            copies[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), copies


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = PRICING_ROUNDS) -> tuple[list[tuple[np.ndarray, int]], bool]:
    """Configurations (copies of each size) and how often to use each, covering no more than demand; and whether they are optimal.

    Revised simplex: the basis starts with one size a container; a column enters while its worth at the basis'
    prices exceeds 1. Stopping after any round leaves a feasible basis.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(k)
    optimal = False
    for _ in range(rounds):
        use = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, cost)
        low = int(price.argmin())
        if price[low] < -1e-9:
            column, c = -np.eye(k)[low], 0.0
        else:
            worth, copies = _knapsack(sizes, np.maximum(price, 0), capacity)
            if worth <= 1 + 1e-7:
                optimal = True
                break
            column, c = copies.astype(float), 1.0
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, c
    use = np.linalg.solve(basis, demand.astype(float))
    found = []
    left = demand.copy()
    for j in np.argsort(-use):
        copies = np.maximum(np.rint(basis[:, j]), 0).astype(np.int64)
        if cost[j] and use[j] > 0 and copies.any():
            often = min(int(np.floor(use[j] + 1e-6)), *(int(left[g] // copies[g]) for g in np.flatnonzero(copies)))
            if often > 0:
                left = left - copies * often
                found.append((copies, often))
    return found, optimal


class _Runs:
    """Containers by the room that is left: runs of consecutive containers with equal room."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, room: int, first: int, count: int) -> None:
        if count > 0 and room > 0:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, count))

    def tightest(self, size: int) -> int | None:
        at = bisect.bisect_left(self.rooms, size)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """The first container and the number taken of one run, at most most."""
        runs = self.by_room[room]
        first, count = runs.pop()
        if count > most:
            runs.append((first + most, count - most))
            count = most
        if not runs:
            self.rooms.pop(bisect.bisect_left(self.rooms, room))
        return first, count


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large_parts: int = LARGE_PARTS) -> Plan:
    """Rules for documents whose sizes (0 to capacity) occur as often as histogram says."""
    p = Plan(capacity)
    runs = _Runs()
    rules: list[tuple[int, int]] = []
    sizes = sorted((s for s in histogram if s > 0 and histogram[s] > 0), reverse=True)
    at = 0
    for s in sizes:
        if s > capacity:
            raise ValueError("a size exceeds the capacity")
        p.offset[s] = at
        at += histogram[s]
    p.offset[0] = at
    ends = np.array([p.offset[s] + histogram[s] for s in sizes], np.int64)
    large = [s for s in sizes if s * large_parts > capacity]
    n_large = p.offset[large[-1]] + histogram[large[-1]] if large else 0
    used = 0

    def best_fit(i: int, n: int, s: int) -> None:
        nonlocal used
        while n:
            room = runs.tightest(s)
            if room is not None:
                first, count = runs.take(room, n)
                rules.append((i, first))
                runs.put(room - s, first, count)
                i, n = i + count, n - count
                continue
            each = capacity // s
            full = n // each
            for _ in range(each if full else 0):
                rules.append((i, used))
                i += full
            runs.put(capacity - each * s, used, full)
            used, n = used + full, n - full * each
            if n:  # fewer than fill a container
                for k in range(n):
                    rules.append((i + k, used))
                runs.put(capacity - n * s, used, 1)
                used, n = used + 1, 0

    if n_large:
        # 1. groups of equal cardinality, in the order by size; a group's size is that of its first document
        bounds = np.unique(np.linspace(0, n_large, min(groups, n_large) + 1).astype(np.int64))
        top = np.array([sizes[int(np.searchsorted(ends, b, "right"))] for b in bounds[:-1]], np.int64)
        # 2. and 3.
        nxt = bounds[:-1].copy()
        rounded, member = np.unique(top, return_inverse=True)
        demand = np.bincount(member, weights=np.diff(bounds)).astype(np.int64)
        queue = {r: [g for g in range(len(top)) if member[g] == r] for r in range(len(rounded))}
        found, p.priced_out = configurations(rounded, demand, capacity)
        for copies, often in found:
            slots: list[list[tuple[int, int]]] = []  # of each slot, (first document, number) over the run of containers
            for r in np.flatnonzero(copies):
                for _ in range(int(copies[r])):
                    need, parts = often, []
                    while need:
                        g = queue[r][0]
                        k = int(min(need, bounds[g + 1] - nxt[g]))
                        if k:
                            parts.append((int(nxt[g]), k))
                            nxt[g] += k
                            need -= k
                        if nxt[g] == bounds[g + 1]:
                            queue[r].pop(0)
                    slots.append(parts)
            cuts = {0, often}
            for parts in slots:
                x = 0
                for i, k in parts:
                    rules.append((i, used + x))
                    inner = ends[np.searchsorted(ends, i, "right") : np.searchsorted(ends, i + k, "left")]
                    cuts.update((x + int(e) - i for e in inner), (x,))
                    x += k
            edges = np.array(sorted(cuts), np.int64)
            load = np.zeros(len(edges) - 1, np.int64)
            of = np.array(sizes, np.int64)
            for parts in slots:
                x = 0
                for i, k in parts:
                    a, b = np.searchsorted(edges, (x, x + k))
                    load[a:b] += of[np.searchsorted(ends, i + edges[a:b] - x, "right")]
                    x += k
            for e, n, filled in zip(edges[:-1].tolist(), np.diff(edges).tolist(), load.tolist()):
                runs.put(capacity - filled, used + e, n)
            used += often
        for g in range(len(top)):  # what rounding the numbers down has left: a bounded number of containers
            i = int(nxt[g])
            while i < bounds[g + 1]:
                j = int(np.searchsorted(ends, i, "right"))
                n = int(min(ends[j], bounds[g + 1]) - i)
                best_fit(i, n, sizes[j])
                i += n
    # 4.
    for s in sizes[len(large) :]:
        best_fit(p.offset[s], histogram[s], s)
    p.containers = used
    rules.sort()
    p.first, p.to = [i for i, _ in rules], [c for _, c in rules]
    return p


def pack_sizes(sizes: DataFrame, key: str, size: str, budgets: list[tuple[int, int]]) -> DataFrame:
    """A row for each piece and budget: key, budget_id, piece_no, n_tokens, container_id (from 0 in each budget).

    budgets: number and capacity. sizes should be a written table; it is read twice.
    """
    ship_package(sizes.sparkSession)
    s = F.col("_size")
    options = F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in budgets))
    items = (
        sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
        .select("_key", "_size", F.inline(options))
        .select("_key", "budget_id", "capacity", F.posexplode(F.when(s <= F.col("capacity"), F.array(s)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((s - 1) / F.col("capacity"))), lambda k: F.least(F.col("capacity"), s - k * F.col("capacity"))))).alias("_no", "n_tokens"))
    )
    counted = items.groupBy("budget_id", "n_tokens").count().collect()  # at most capacity + 1 rows a budget
    histogram: dict[int, dict[int, int]] = {b: {} for b, _ in budgets}
    for r in counted:
        histogram[r["budget_id"]][r["n_tokens"]] = r["count"]
    plans = {b: plan(histogram[b], c) for b, c in budgets}
    for b, p in plans.items():
        if not p.priced_out:
            warnings.warn(f"budget {b}: the configurations weren't optimal after {PRICING_ROUNDS} rounds; more containers than needed may be used", stacklevel=2)
    # the sizes that need several buckets, at most capacity + 1 a budget
    common = [(r["budget_id"], r["n_tokens"], 1 + r["count"] // BUCKET_ROWS) for r in counted if r["count"] > BUCKET_ROWS]
    buckets = F.broadcast(sizes.sparkSession.createDataFrame(common, "_b int, _n long, _buckets long"))
    items = items.select("_key", "budget_id", (F.col("_no") + 1).alias("piece_no"), "n_tokens")
    items = items.join(buckets, (F.col("budget_id") == F.col("_b")) & (F.col("n_tokens") == F.col("_n")), "left").drop("_b", "_n")
    by = ["budget_id", "n_tokens", "_bucket"]
    items = items.withColumn("_bucket", F.pmod(F.xxhash64("_key", "piece_no"), F.coalesce("_buckets", F.lit(1).cast("long"))))
    numbered = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "piece_no")) - 1)
    if common:
        ahead = items.where("_buckets IS NOT NULL").groupBy(*by).count().select(*by, (F.sum("count").over(Window.partitionBy(*by[:2]).orderBy("_bucket")) - F.col("count")).alias("_ahead"))
        numbered = numbered.join(ahead, by, "left").withColumn("_rank", F.col("_rank") + F.coalesce("_ahead", F.lit(0)))

    rules = {b: (np.array(p.first, np.int64), np.array(p.to, np.int64), p) for b, p in plans.items()}
    known = {b: (first, to, np.array([p.offset.get(x, 0) for x in range(p.capacity + 1)], np.int64), max(1, p.containers)) for b, (first, to, p) in rules.items()}

    @F.pandas_udf("long")
    def container(budget: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(budget), np.int64)
        which, n, k = budget.to_numpy(), size.to_numpy(), rank.to_numpy()
        for b, (first, to, offset, containers) in known.items():
            rows = which == b
            i = offset[n[rows]] + k[rows]
            if len(first):
                j = np.searchsorted(first, i, "right") - 1
                c = to[j] + i - first[j]
            else:
                c = np.zeros(len(i), np.int64)
            out[rows] = np.where(n[rows] == 0, k[rows] % containers, c)
        return pd.Series(out)

    return numbered.select(F.col("_key").alias(key), "budget_id", "piece_no", "n_tokens", container("budget_id", "n_tokens", "_rank").alias("container_id"))


def pack_texts(df: DataFrame, key: str, text: str, budgets: list[tuple[int, int]], rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """pack_sizes of documents, sized in tokens; the texts are encoded once for all budgets."""
    work = Workspace(df.sparkSession, "pack")
    sizes = work.save(count_tokens(df, key, text, "n_tokens", rank_file), "sizes")
    return pack_sizes(sizes, key, "n_tokens", budgets)
