"""Consolidation, families and copies against sequential versions."""

import random
from collections import Counter, defaultdict

import pytest
from oracle import DATA, connection, same
from pyspark.sql import functions as F

from dyadic.llm import consolidate, contraction, merkle, queries, splits


def labels(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shapes(seed):
    r = random.Random(seed)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    order = r.sample(range(80), 80)
    shuffled = [(f"s{a:03}", f"s{b:03}") for a, b in zip(order, order[1:])]
    star = [("hub", f"l{i:03}") for i in range(100)]
    loose = [(f"r{r.randint(0, 90):02}", f"r{r.randint(0, 90):02}") for _ in range(70)]
    return chain + shuffled + star + loose


@pytest.mark.parametrize("seed", range(2))
def test_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(contraction, "TAIL_EDGES", 40 * seed)  # rounds of joins only, or the last ones in one task
    links = shapes(seed)
    rows = links + [(b, a) for a, b in links[::3]] + links[:20] + [(None, "c000"), ("c000", None), ("alone", "alone")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "a string, b string, u string")
    ends = [(u, v) for u, v in links if u != v]
    want = labels({x for e in ends for x in e}, ends)
    assert {r.member: r.group_id for r in consolidate.connected_groups(df, "a", "b").collect()} == want
    assert consolidate.connected_groups(df.limit(0), "a", "b").count() == 0
    assert consolidate.connected_groups(df.where("a = b"), "a", "b").count() == 0


def test_matches(spark):
    rows = [("a ", "B", 0.5), ("A", "b", 0.4), ("c", "D", 50.0), ("e", "f", 1.0), ("g", "h", float("nan")), ("i", "j", None), ("K", " k", 0.9), (None, "x", 0.9), ("l", "m", 49.0)]
    got = consolidate.alignment_matches(spark.createDataFrame(rows, "query string, target string, fident double"))
    assert sorted(tuple(r) for r in got.collect()) == [("A", "B"), ("C", "D"), ("E", "F")]


@pytest.mark.parametrize("seed", range(2))
def test_families(spark, monkeypatch, seed):
    monkeypatch.setattr(contraction, "TAIL_EDGES", 40 * (seed % 2))  # rounds of joins only, or the last ones in one task
    r = random.Random(seed)
    rows = [(i, r.choice([None, "-", *(f"p{k}" for k in range(40))]) if i % 3 else f"only{i}", r.choice([None, "NA", "", f"q{r.randint(0, 60)}"]), r.choice([None, -1, r.randint(0, 50)])) for i in range(120)] + [(500 + i, "giant", f"x{i}", None) for i in range(60)] + [(900, None, None, None), (901, None, "nan", -1)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "k long, a string, b string, c long, first_key int")
    ok = lambda c: F.when(~F.coalesce(F.col(c).isin("", "-", "NA", "nan"), F.lit(True)), F.concat(F.lit("p"), F.col(c)))
    got = {x.k: x.first_key for x in splits.families(df, "k", [ok("a"), ok("b"), F.when(F.col("c") >= 0, F.concat(F.lit("c"), F.col("c")))]).collect()}
    links = defaultdict(list)
    for k, a, b, c in rows:
        for v in {("p", x) for x in (a, b) if x not in (None, "", "-", "NA", "nan")} | ({("c", c)} if c is not None and c >= 0 else set()):
            links[v].append(k)
    assert got == labels([x[0] for x in rows], [(ks[0], k) for ks in links.values() for k in ks[1:]])
    assert splits.families(df.limit(0), "k", [ok("a")]).count() == 0
    named = df.where("k < 60").select(F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("k"), "a", "b").union(df.limit(1).selectExpr("NULL", "a", "b"))
    want = {(f"r{x.k:03}", f"r{x.first_key:03}") for x in splits.families(df.where("k < 60"), "k", [ok("a"), ok("b")]).collect()}
    assert {tuple(x) for x in splits.families(named, "k", [ok("a"), ok("b")]).collect()} == want


def test_shares(spark):
    r = random.Random(7)
    sizes = [4000, 900] + [r.randint(1, 12) for _ in range(1500)]
    rows = [(f"{i}-{j}", f"f{i:05}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "k string, first_key string")
    got = splits.split_by_weight(df, "k", {"train": 80.0, "validation": 10.0, "test": 10.0}).collect()
    assert len(got) == len(rows) and len({(x.first_key, x.split) for x in got}) == len(sizes)
    n = Counter(x.split for x in got)
    assert all(abs(n[s] / len(rows) - w) < 0.005 for s, w in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    one = spark.createDataFrame([("a", "a"), ("b", "a")], "k string, first_key string")
    assert {x.split for x in splits.split_by_weight(one, "k", {"train": 0.8, "test": 0.2}).collect()} == {"train"}
    assert splits.split_by_weight(df.limit(0), "k", {"train": 1.0, "test": 1.0}).count() == 0


def test_split_queries(spark):
    d = str(DATA / "sf0.01")
    got = queries.p6_splits(spark, d)
    assert got.groupBy("first_row_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{d}/ara_positive_c4_test_id0_50_cov0_80.parquet").count()


def test_split_summary(spark):
    d = str(DATA / "sf0.001")
    got = {r.split: r for r in queries.p6_summary(spark, d).collect()}
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/ara_positive_c4_test_id0_50_cov0_80.parquet").collect()]
    of = {r.row_id: r.split for r in queries.p6_splits(spark, d).collect()}
    proteins = defaultdict(set)
    for r in rows:
        proteins[of[r["row_id"]]] |= {p for p in (r["participant_a_id"], r["participant_b_id"]) if p is not None and p.strip() not in ("", "-", "NA", "nan")}
    assert {k: (r.n_rows, r.n_proteins) for k, r in got.items()} == {k: (n, len(proteins[k])) for k, n in Counter(of.values()).items()}
    assert sum(r.given_share for r in got.values()) == pytest.approx(1) and all(r.share == r.n_rows / len(rows) for r in got.values())


PAIR = "pair_id string, canonical_pair_key string, participant_a_id string, participant_b_id string, digest int"


@pytest.mark.parametrize("hasher", [lambda c: F.sha2(c, 256), lambda c: F.substring(F.sha2(c, 256), 1, 0), lambda c: F.lit("AB")])
def test_copies(spark, monkeypatch, hasher):
    """Also with digests that all records share: trees that differ stay apart."""
    rows = [("p1", None, "A-1", "b"), ("p2", "", " B.", "a_1"), ("p3", "A|B", "A", "B"), ("p4", "a-1 ~ B", None, "B"), ("p5", "B_A-1", "-", None), ("p6", "x", "nan", "B"), ("p7", None, "é", "B"), ("p8", " A-1|B. ", "NA", "q"), ("p9", None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [("p4", "a-1 ~ B", None, "B", 2)], PAIR)
    pairs, tree, empty = merkle.pair_tree(df, "pair_id")
    monkeypatch.setattr(merkle, "_hash", hasher)
    got = {(r.pair_id, r.first_key) for r in merkle.copies(pairs, "pair_id", tree, empty).collect()}
    assert got == {(p, "p1") for p in ("p1", "p2", "p4", "p5", "p8")}
    groups = {r.first_key: r.n_copies for r in merkle.copy_groups(pairs, "pair_id", tree, empty).collect()}
    assert groups == {"p1": 6, "p3": 1}
    assert merkle.copies(pairs.limit(0), "pair_id", tree, empty).count() == 0


def test_trees(spark):
    L, N = merkle.Leaf, merkle.Node
    df = spark.createDataFrame([("x y", "b", "c"), ("XY", "c", "B"), ("xy", "bc", ""), ("b", "xy", "c")], "a string, b string, c string")
    unordered = N([L(F.col("a")), N([L(F.col("b")), L(F.col("c"))])], ordered=True)
    got = [(r[0], r[1]) for r in merkle.hashed(df, [], unordered).collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and len({x for x, _ in got}) == len({y for _, y in got})


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    same(spark, connection("sf0.001"), queries.QUERIES[name], queries.SQL[name], "sf0.001")
