"""What the contractions of problems 1 and 6 share: edges are relabelled round by round until none is left.

A round gives every vertex that still has an edge its new label (c, p). The labels of later rounds are looked up
backwards, from the last round to the first, each round's vertices being in the one before. Hubs, which are on many edges,
meet their one label in joins that adaptive execution splits. Once no more than TAIL_EDGES edges are left, one
task of an executor goes on with the same rounds in numpy: at that size a round of joins takes its fixed time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.session import Workspace, ship_package

TAIL_EDGES = 1 << 15  # edges, a MB or so, that one task finishes

Rounds = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def directed(edges: DataFrame) -> DataFrame:
    """c, n: every edge from both of its ends."""
    ends = F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("n")), F.struct(F.col("v").alias("c"), F.col("u").alias("n")))
    return edges.select(F.inline(ends))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct edges between different labels, u < v. labels: c and p of every end."""
    of = lambda x: labels.select(F.col("c").alias(x), F.col("p").alias(f"p{x}"))
    return edges.join(of("u"), "u").join(of("v"), "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()


def _finish(rounds: Rounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held])
        vertices = pc.unique(ends)
        vertices = vertices.take(pc.sort_indices(vertices))
        place = pc.index_in(ends, value_set=vertices).to_numpy().astype(np.int64)
        label = rounds(*np.split(place, 2), len(vertices))
        yield pa.RecordBatch.from_arrays([vertices, vertices.take(pa.array(label))], names=["c", "p"])


def in_one_task(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """c and its last label p, for no more than TAIL_EDGES edges. rounds: of ends numbered in order, the label of each number."""
    ship_package(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").coalesce(1).mapInArrow(partial(_finish, rounds), f"c {kind}, p {kind}")


def kept_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges of different ends, the smaller first."""
    code = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
    return code // n, code % n


def contracted(edges: DataFrame, work: Workspace, one_round: Callable[[DataFrame, int], DataFrame], last_rounds: Rounds) -> DataFrame | None:
    """c and its last label p of every end of the written edges (u < v, distinct), the table edges0; None for no edges.

    one_round: of the edges and the number of the round, a written table of c and p.
    """
    left, rounds = edges, []
    while n := left.count():
        k = len(rounds)
        if n <= TAIL_EDGES:
            rounds.append(work.save(in_one_task(left, last_rounds), f"tail{k}"))
            break
        rounds.append(one_round(left, k))
        left = work.save(relabelled(left, rounds[k]), f"edges{k + 1}")
        work.drop(f"edges{k}")
    labels = None
    for r in reversed(rounds):
        if labels is None:
            labels = r
        else:
            known = labels.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
            labels = r.join(known, F.col("p") == F.col("_c"), "left").select("c", F.coalesce("_p", "p").alias("p"))
    return labels
