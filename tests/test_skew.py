import random
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F

from dyadic.operators import ordering, skew


def data(n=3000, seed=3):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["a", "b", None, "-"]), r.choice(["x", "y", "z", None, "NA"]), r.choice([0.5, 0.7, None, float("nan"), 71.0])) for _ in range(n)]


def test_results_per_key(spark):
    table = data()
    df = spark.createDataFrame(table, "k string, v string, s double")
    got = {r.key: r for r in skew.per_key(skew.compress(df, skew.known("k"), skew.known("v"), skew.identity("s"))).collect()}
    groups = defaultdict(list)
    for k, v, s in table:
        groups[None if k == "-" else k].append((None if v == "NA" else v, s))
    assert set(got) == set(groups)
    for k, values in groups.items():
        n = Counter(v for v, _ in values if v)
        best = max((s / 100 if s > 1 else s for _, s in values if s is not None and s == s), default=None)
        assert (got[k].n_rows, got[k].n_distinct, got[k].best) == (len(values), len(n), best)
        assert got[k].mode == min(n, key=lambda v: (-n[v], v))
    assert [r.key for r in skew.hot_keys(skew.per_key(skew.compress(df, skew.known("k"), F.col("v"))), len(table), 0.5).collect()] == ["hot"]


def test_quantiles_are_exact(spark):
    r = random.Random(5)
    table = [(k, float(r.randint(0, 50))) for k in ["hot"] * 2000 + ["b"] * 7 + ["c"]]
    df = spark.createDataFrame(table, "k string, v double")
    got = {x.key: (x.q50, x.q90) for x in skew.quantiles(skew.compress(df, F.col("k"), F.col("v")), {"q50": 0.5, "q90": 0.9}).collect()}
    for k in ("hot", "b", "c"):
        values = sorted(v for q, v in table if q == k)
        want = tuple(next(v for i, v in enumerate(values, 1) if i >= q * len(values)) for q in (0.5, 0.9))
        assert got[k] == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    weighted = skew.compress(df, F.col("k"), F.col("v"))
    assert skew.per_key(weighted).count() == 0 and skew.quantiles(weighted, {"q": 0.5}).count() == 0


def test_medians(spark):
    table = [(k, float(v)) for k, n in (("a", 1), ("b", 4), ("c", 501)) for v in [(i * 37) % 101 for i in range(n)]] + [(None, 3.0), (None, 4.0), ("d", None)]
    weighted = skew.compress(spark.createDataFrame(table, "k string, v double"), F.col("k"), F.col("v"))
    groups = defaultdict(list)
    for k, v in table:
        if v is not None:
            groups[k].append(v)
    assert {r.key: r.upper_median for r in skew.upper_medians(weighted).collect()} == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    got = {r.key: (r.total, r.q1, r.q2) for r in skew.interpolated(weighted, {"q1": 0.25, "q2": 0.5}).collect()}
    assert {k: (n, round(a, 9), round(b, 9)) for k, (n, a, b) in got.items()} == {k: (len(v), *(round(float(np.percentile(v, q)), 9) for q in (25, 50))) for k, v in groups.items()}


def test_running_sums(spark):
    table = [(i % 3 if i % 7 else None, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(table, "g int, i int, x int")
    got = {r.i: (r.total, r.n) for r in ordering.running(df, ["g"], [F.col("i")], {"total": F.col("x"), "n": F.lit(1)}).collect()}
    seen = defaultdict(lambda: (0, 0))
    for g, i, x in table:
        seen[g] = (seen[g][0] + x, seen[g][1] + 1)
        assert got[i] == seen[g]
    assert sorted(r.rank for r in ordering.ranked(df, [], [F.col("i").desc()]).collect()) == list(range(1, 501))


def test_meet(spark):
    table = data()
    df = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(table)] + [("lone%d" % i, -i) for i in range(1, 2000)], "k string, i int")
    counts = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = {(r.k, r.i): r["first"] for r in skew.meet(df, counts, "k", "n", ["first", "n"]).collect()}
    first = {}
    for k, i in sorted(((r.k, r.i) for r in df.where("k is not null").collect()), key=lambda x: x[1]):
        first.setdefault(k, i)
    assert got == {(r.k, r.i): first[r.k] for r in df.where("k is not null").collect()}
