"""Operators of pair graphs against sequential versions and the published synthetic cases."""

import random

import pytest
from pyspark.sql import functions as F

from dyadic.functions import numeric as N
from dyadic.functions import text as X
from dyadic.operators import graph as G
from dyadic.operators import metrics as M
from dyadic.operators.bisection import bisect
from dyadic.operators import negatives, pairs
from dyadic.operators import partition as S
from dyadic.operators import resolve as R

ALIGNED = "query string, target string, fident double, qcov double, tcov double, evalue double"


def test_homology_thresholds(spark):
    rows = [("P1", "P2", 0.6, 0.85, 0.9, 1e-10), ("P1", "P3", 0.6, 0.6, 0.9, 1e-10), ("P1", "P4", 0.45, 0.9, 0.9, 1e-10), ("P1", "P5", 0.6, 0.9, 0.9, 0.05), ("P1", "P1", 1.0, 1.0, 1.0, 0.0), ("P6", "P1", None, 0.9, 0.9, 0.0)]
    got = G.similarity_edges(spark.createDataFrame(rows, ALIGNED), 0.5, 0.8).collect()
    assert [(r.u, r.v, r.similarity) for r in got] == [("P1", "P2", 0.6)]


@pytest.mark.parametrize(("sims", "want"), [((0.85, 0.65, 0.10, 0.15), 0.65), ((0.20, 0.10, 0.90, 0.55), 0.55), ((0.95, None, None, None), None)])
def test_pair_similarity(spark, sims, want):
    edges = [(u, v, s) for (u, v), s in zip((("a", "c"), ("b", "d"), ("a", "d"), ("b", "c")), sims) if s]
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    homologs = G.reflexive(spark.createDataFrame(edges, "u string, v string, similarity double"), nodes, "node")
    both = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "k string, a string, b string")
    got = [r.similarity for r in G.redundant_pairs(both, "k", "a", "b", homologs).collect()]
    assert got == ([] if want is None else [want])


def _alike(rows, near):
    """redundant_pairs, each pair against each."""
    s = lambda x, y: 1.0 if x == y else near.get((x, y), near.get((y, x)))
    found = {}
    for i, (k, a, b) in enumerate(rows):
        for l, c, d in rows[i + 1:]:
            ways = [min(x, y) for x, y in ((s(a, c), s(b, d)), (s(a, d), s(b, c))) if x and y]
            if ways:
                found[min(k, l), max(k, l)] = max(ways)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_redundant_pairs_as_all_against_all(spark, seed):
    """Hubs among pairs and among homologs, pairs that are homologs themselves, pairs of the same ends under two keys, turned ends."""
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    near = {tuple(sorted(r.sample(names, 2))): r.choice([0.5, 0.625, 0.75]) for _ in range(25)} | {("n00", x): 0.875 for x in names[5:15]}
    ends = {tuple(r.sample(names, 2)) for _ in range(40)} | {("n00", x) for x in names[10:22]} | {(x, "n01") for x in names[8:20]} | {("n03", "n04"), ("n04", "n03")}
    rows = [(f"k{i:03}", a, b) for i, (a, b) in enumerate(r.sample(sorted(ends), len(ends)))]
    edges = spark.createDataFrame([(u, v, s) for (u, v), s in near.items()], "u string, v string, similarity double")
    homologs = G.reflexive(edges, spark.createDataFrame([(x,) for x in names], "node string"), "node")
    got = G.redundant_pairs(spark.createDataFrame(rows, "k string, a string, b string"), "k", "a", "b", homologs).collect()
    assert len(got) == len({(x.key_1, x.key_2) for x in got}) and {(x.key_1, x.key_2): x.similarity for x in got} == _alike(rows, near)


def shuffled(spark):
    """Rows that each stage so far has shuffled, by its number."""
    jvm, none = spark._jvm, spark._sc._gateway.new_array(spark._jvm.double, 0)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("name", ["cluster_density", "cluster_ids", "greedy_reps", "redundant_edges"])
def test_queries_over_a_hub(spark, tmp_path, name):
    """A hub's pairs times its homologs are never made: what a stage shuffles follows the links, not their product."""
    import duckdb
    from oracle import table
    from dyadic.plans import graphs

    n = 300
    hits = [("H", f"h{i}", 0.9) for i in range(n)] + [(x, f"p{i}", 0.3) for i in range(n) for x in ("H", f"h{i}")] + [("H", "p0", 0.2)]
    columns = ALIGNED + ", bits int"
    at = str(tmp_path / "ara_prot_all_vs_all.parquet")
    spark.createDataFrame([(q, t, f, 0.9, 0.9, 1e-9, 50 + i % 7) for i, (q, t, f) in enumerate(hits)], columns).coalesce(1).write.parquet(at)
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graphs.QUERIES[name](spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW ara_prot_all_vs_all AS SELECT * FROM '{at}/*.parquet'")
    want = con.execute(graphs.SQL[name])
    assert table(df.columns, got) == table([c[0] for c in want.description], want.fetchall())
    assert max(rows for stage, rows in shuffled(spark).items() if stage not in before) < 20 * n


@pytest.mark.parametrize("seed", range(3))
def test_components_and_greedy(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    links = {tuple(sorted(r.sample(nodes, 2))) for _ in range(35)}
    df = spark.createDataFrame(list(links), "u string, v string")
    frame = spark.createDataFrame([(n,) for n in nodes], "node string")
    label = {n: n for n in nodes}
    for _ in nodes:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    assert {x.node: x.component for x in G.components(frame, df).collect()} == label
    order = r.sample(nodes, len(nodes))
    rep = {}
    for n in order:
        if n not in rep:
            rep[n] = n
            for u, v in links:
                for x, y in ((u, v), (v, u)):
                    if x == n and y not in rep:
                        rep[y] = n
    ranks = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "node string, rank long")
    assert {x.node: x.representative for x in G.greedy_representatives(ranks, "node", df, "rank").collect()} == rep


def test_interologs_and_filter(spark):
    edges = spark.createDataFrame([("A", "C", 0.9), ("B", "D", 0.9)], "u string, v string, similarity double")
    homologs = G.reflexive(edges, spark.createDataFrame([(x,) for x in "ABCDE"], "node string"), "node")
    rules = negatives.interologs(spark.createDataFrame([("C", "D")], "u string, v string"), homologs)
    assert {tuple(r) for r in rules.collect()} == {("C", "D"), ("A", "D"), ("B", "C"), ("A", "B")}
    candidates = spark.createDataFrame([("A", "B"), ("A", "E"), ("C", "D"), ("D", "E"), (None, "A")], "u string, v string")
    assert {tuple(r) for r in negatives.without(candidates, rules).collect()} == {("A", "E"), ("D", "E"), (None, "A")}


def test_disjoint_pairs(spark):
    items = [(i, m) for i, m in enumerate([1, 2, 3, 4, 0, 1, 6])]
    got = {(r.u, r.v) for r in negatives.disjoint_pairs(spark.createDataFrame(items, "id long, m int"), "id", "m").collect()}
    assert got == {(i, j) for i, a in items for j, b in items if i < j and a and b and not a & b}


def test_quotas(spark):
    df = spark.createDataFrame([("p", i, float(s)) for i, s in enumerate([100, 200, 150])], "pool string, id int, s double")
    assert [r.s for r in S.take_best(df, "pool", {"p": 10}, "s", ["id"], cap=True).orderBy("rank").collect()] == [200, 150, 100]
    with pytest.raises(ValueError, match="too few"):
        S.take_best(df, "pool", {"p": 10}, "s", ["id"])


def test_holdout_keeps_degrees(spark):
    r = random.Random(1)
    links = list({tuple(sorted(r.sample(range(60), 2))) for _ in range(300)})
    got = S.degree_safe_holdout(spark.createDataFrame(links, "u long, v long"), "u", "v", 0.1).collect()
    assert sum(x.held_out for x in got) == int(len(links) * 0.1) and len(got) == len(links)
    train = {y for x in got if not x.held_out for y in (x.u, x.v)}
    assert all(x.u in train and x.v in train for x in got if x.held_out)


def test_bisection_keeps_communities(spark):
    r = random.Random(2)
    rows = [(f"{c}{r.randint(0, 9)}", f"{c if r.random() < 0.8 else r.choice('abcdefghij')}{r.randint(0, 9)}") for c in "abcdefghijklmnopqrst" for _ in range(50)]
    df = spark.createDataFrame(rows, "a string, b string")
    communities = df.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.substring("node", 1, 1))
    chosen = bisect(df, "a", "b", communities, 0.1, 0.1)
    assert chosen.groupBy(F.substring("vertex", 1, 1)).agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    share = {x["partition"]: x["count"] / len(rows) for x in S.label_by_test_vertices(df, "a", "b", chosen.where("is_test"), "vertex").groupBy("partition").count().collect()}
    assert abs(share["C3"] - 0.1) < 0.05 and abs(share["C2"] - 0.1) < 0.08
    audit = {x["check"]: x.passed for x in S.audit(S.label_by_test_vertices(df, "a", "b", chosen.where("is_test"), "vertex"), "a", "b", "partition", {"C1": 0.8, "C2": 0.1, "C3": 0.1}, 0.2).collect()}
    assert all(audit.values()) and len(audit) == 5


def test_ranking_metrics_ties_and_one_class(spark):
    rows = [("t", 0.9, 1), ("t", 0.5, 1), ("t", 0.5, 0), ("t", 0.1, 0), ("one", 0.3, 1), ("one", 0.2, 1)]
    got = {r.task: r for r in M.ranking_metrics(spark.createDataFrame(rows, "task string, s double, y int"), ["task"], "s", "y").collect()}
    assert got["t"].average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and got["t"].auroc == pytest.approx(3.5 / 4)
    assert got["one"].auroc is None and got["one"].average_precision == 1
    assert (got["t"].best_f1, got["t"].best_threshold) == (pytest.approx(0.8), 0.5)


def test_scores_and_expressions(spark):
    one = spark.range(1)
    value = lambda *c: tuple(one.select(*c).first())
    n = F.lit
    assert [round(x, 4) for x in value(N.confidence(n(1), n(5)), N.confidence(n(1), n(10)))] == [0.6293, 0.7191]
    assert value(N.tier(n(0.6293)), N.tier(n(0.7191)), N.tier(n(0.72)), N.tier(n(0.6))) == ("medium", "medium", "high", "low")
    assert value(*N.unpacked_edge(N.packed_edge(n(7), n(5)))) == (5, 7)
    assert value(N.mask_names(n(5), ["x", "y", "z"])) == ("x|z",)
    assert value(*N.crop_lengths(n(2000), n(20))) == (1009, 20) and value(*N.crop_lengths(n(500), n(500))) == (500, 500)
    assert value(X.molecule_type(n('psi-mi:"MI:0319"(deoxyribonucleic acid)'), n("x")), X.molecule_type(n("gene"), n("x")), X.molecule_type(n("-"), n("-")), X.molecule_type(n("?"), n("CHEBI:1"))) == ("dna", "gene", "missing", "small_molecule")
    assert value(X.namespace(n("a:b:c")), X.namespace(n("x")), X.namespace(n("-"))) == (("a", "b:c"), ("unresolved", "x"), None)
    assert value(X.gene_symbol(n("x:1(y)|u:MER(gene name)")), X.tagged_item(n("a:1|intact:2"), ["intact:"])) == ("MER", "intact:2")
    assert value(N.dot(F.array(n(1.0), n(2.0)), F.array(n(3.0), n(4.0)))) == (11.0,)
    text = spark.createDataFrame([(None, True, "a\tb", "")], "a string, b boolean, c string, d string")
    assert tuple(X.sanitised(text).first()) == ("NA", "TRUE", "a b", "NA")


def test_core_filter(spark):
    rows = [("MI:0915", "MI:0018", False, 3702, 3702, "protein"), ("MI:0915", "MI:0018", True, 3702, 3702, "protein"), ("MI:0000", "x", False, 3702, 3702, "protein"), ("MI:0915 MI:2364", "x", False, 3702, 3702, "protein"), ("MI:0915", "MI:1314", False, 3702, 3702, "protein"), ("MI:0915", None, False, 3702, None, "protein"), ("MI:0915", "x", False, 3702, 3702, "rna")]
    df = spark.createDataFrame(rows, "k string, m string, n boolean, ta int, tb int, mol string")
    rules = pairs.core_rules(F.col("k"), F.col("m"), F.col("n"), (F.col("ta"), F.col("tb")), (F.col("mol"), F.lit("protein")), 3702)
    assert {r.reason: r.n for r in pairs.reason_counts(pairs.waterfall(df, rules)).collect()} == {"kept": 1, "negative": 1, "not_core": 1, "proximity_type": 1, "proximity_method": 1, "other_species": 1, "not_protein": 1}


def test_cascade_and_ends(spark):
    d = spark.createDataFrame([("A", 1), ("B", 2)], "id string, v int")
    facts = spark.createDataFrame([("A-1",), ("B",), ("X",), (None,)], "raw string")
    got = {r.raw: (r.v, r.matched_by) for r in R.cascade(facts, [F.col("raw"), X.isoform_base(F.col("raw"))], d, "id", ["v"], {"v": F.lit(0)}).collect()}
    assert got == {"A-1": (1, 2), "B": (2, 1), "X": (0, None), None: (0, None)}
    ends = R.both_ends(spark.createDataFrame([("A", "B"), ("A", "X")], "a string, b string"), "a", "b", d, "id", "v").collect()
    assert [(r.a_v, r.b_v) for r in ends] == [(1, 2)]


def test_fixed_values(spark):
    from dyadic.functions import fixed

    known = fixed.techniques(spark)
    assert known.count() == known.select("raw_name").distinct().count() == 74
    methods = spark.createDataFrame([("p", ["Two-hybrid", "two hybrid", "pull down"]), ("q", ["magic"])], "k string, m array<string>")
    assert {r.k: r.technique_total for r in pairs.technique_totals(methods, "k", F.col("m"), known).collect()} == {"p": 7.5, "q": 1.0}
    notes = spark.createDataFrame([("a1", "G1", "IDA"), ("A1", "G2", "IEA"), ("B1", "G9", "TAS")], "locus string, term string, evidence_code string")
    terms = spark.createDataFrame([("G1", "nucleus"), ("G2", "vacuole")], "term string, compartment string")
    assert {r.locus: (r.mask, r.weight) for r in fixed.annotation_summary(notes, terms).collect()} == {"A1": (1 + 128, 3), "B1": (0, 2)}
    one = spark.createDataFrame([(3, None, 500, 300)], "wa int, wb int, la int, lb int")
    assert one.select(fixed.priority_score((F.col("wa"), F.col("wb")), (F.col("la"), F.col("lb")))).first()[0] == 40_000_800


def representatives(spark, lengths, weights):
    from dyadic.functions.fixed import priority_score

    similar = spark.createDataFrame([("A1", "A2", 0.9), ("B1", "B2", 0.9)], "u string, v string, similarity double")
    homologs = G.reflexive(similar, spark.createDataFrame([(n,) for n in lengths], "node string"), "node")
    rows = [("A1", "B1"), ("A1", "B2"), ("A2", "B1"), ("A2", "B2"), ("S1", "S2")]
    both = spark.createDataFrame([(f"{a}|{b}", a, b, weights.get(a, 1), weights.get(b, 1), lengths[a], lengths[b]) for a, b in rows], "k string, a string, b string, wa int, wb int, la int, lb int")
    scored = both.withColumn("score", priority_score((F.col("wa"), F.col("wb")), (F.col("la"), F.col("lb"))))
    links = G.redundant_pairs(both, "k", "a", "b", homologs).where("similarity >= 0.5").select(F.col("key_1").alias("u"), F.col("key_2").alias("v"))
    ranks = G.priority([F.desc("score"), F.col("a"), F.col("b")], scored)
    return {r.node: r.representative for r in G.greedy_representatives(ranks, "k", links, "rank").collect()}


def test_redundancy_end_to_end(spark):
    lengths = {"A1": 500, "A2": 300, "B1": 600, "B2": 200, "S1": 400, "S2": 450}
    got = representatives(spark, lengths, {"A1": 3, "B1": 3})
    assert set(got.values()) == {"A1|B1", "S1|S2"} and sum(k != v for k, v in got.items()) == 3


def test_evidence_comes_before_length(spark):
    lengths = {"A1": 500, "A2": 300, "B1": 600, "B2": 200, "S1": 400, "S2": 450}
    assert set(representatives(spark, lengths, {"A2": 3, "B2": 3}).values()) == {"A2|B2", "S1|S2"}


def test_components_decouple(spark):
    edges = spark.createDataFrame([("A1", "A2"), ("B1", "B2")], "u string, v string")
    parts = G.components(spark.createDataFrame([(x,) for x in ("A1", "A2", "B1", "B2", "C1", "D1")], "node string"), edges)
    assert parts.select("component").distinct().count() == 4
    both = spark.createDataFrame([("A1", "B1"), ("B2", "A2"), ("C1", "D1")], "a string, b string")
    assert [r.component_key for r in G.component_keys(both, "a", "b", parts).orderBy("a").collect()] == ["A1|B1", "A1|B1", "C1|D1"]


def test_pools_and_quotas(spark):
    test = [f"T{i}" for i in range(1, 9)]
    pool = lambda k, n: [(f"{k}{i}", f"{k}{j}") for i in range(1, n) for j in range(i + 1, n)]
    rows = pool("T", 6) + [("T1", f"U{i}") for i in range(1, 7)] + [("X", "Y")] + pool("U", 5)
    df = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate(rows)], "a string, b string, s double")
    named = S.label_by_test_vertices(df, "a", "b", spark.createDataFrame([(t,) for t in test], "v string"), "v", ("none", "cut", "inner"))
    assert {r["partition"]: r["count"] for r in named.groupBy("partition").count().collect()} == {"inner": 10, "cut": 6, "none": 7}
    taken = S.take_best(named, "partition", {"inner": 8, "cut": 4, "none": 4}, "s", ["a", "b"])
    assert {r["partition"]: r["count"] for r in taken.groupBy("partition").count().collect()} == {"inner": 8, "cut": 4, "none": 4}
    assert taken.where("partition = 'cut'").agg(F.min("s")).first()[0] == 12.0


def test_interologs_of_every_pair(spark):
    from dyadic.plans import graphs

    d = "/root/testdata/sf0.001"
    found = {(r.u, r.v) for r in graphs.QUERIES["interolog_rules_all"](spark, d).collect()}
    assert {(r.a, r.b) for r in graphs.low_pairs(spark, d).collect()} <= found
    assert {(r.u, r.v) for r in graphs.interolog_rules(spark, d).collect()} < found


def test_stacking_follows_the_scores(spark):
    r = random.Random(4)
    rows = [(i, y, y + r.gauss(0, 0.6), y + r.gauss(0, 0.6), r.gauss(0, 1)) for i in range(300) for y in (i % 2,)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double, noise double")
    got = M.stacked(df, ["a", "b", "noise"], "y", penalties=(0.01, 1.0), k=3).select("id", "y", "stacked_score").collect()
    assert len(got) == 300 and all(0 <= x.stacked_score <= 1 for x in got)
    auroc = lambda score: M.ranking_metrics(score, ["t"], "s", "y").first().auroc
    stacked = spark.createDataFrame([("t", x.stacked_score, x.y) for x in got], "t string, s double, y int")
    alone = df.select(F.lit("t").alias("t"), F.col("a").alias("s"), "y")
    assert auroc(stacked) > auroc(alone)


def test_masks_fit(spark):
    r = random.Random(5)
    masks = sorted({r.getrandbits(30) | 1 << r.randrange(30) for _ in range(60)} | {1 << k for k in range(30)} | {2**30 - 1, 1, 2})
    got = {tuple(x) for x in negatives.fitting_masks(spark.createDataFrame([(m,) for m in masks], "m int"), "m").collect()}
    assert got == {(x, y) for x in masks for y in masks if not x & y}
    assert negatives.fitting_masks(spark.createDataFrame([], "m int"), "m").count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 15])
def test_greedy_by_rounds_and_in_one_task(spark, monkeypatch, few):
    r = random.Random(few)
    monkeypatch.setattr(G, "FEW_ROWS", few)
    n = 60
    links = [(f"n{i}", f"n{i + 1}") for i in range(0, n - 1, 2)] + [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(90)]
    order = r.sample(range(1, n + 1), n)
    rank = {f"n{i}": k for i, k in enumerate(order)}
    near = {x: set() for x in rank}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    of = {}
    for x in sorted(rank, key=rank.get):
        if x not in of:
            of |= {y: x for y in near[x] if y not in of} | {x: x}
    nodes = spark.createDataFrame(list(rank.items()), "node string, rank int")
    edges = spark.createDataFrame([(a, b) for a, b in links if a != b], "u string, v string")
    got = {x.node: (x.representative, x.is_representative) for x in G.greedy_representatives(nodes, "node", edges, "rank").collect()}
    assert got == {x: (y, x == y) for x, y in of.items()}


def test_bisection_of_many_groups(spark):
    """More communities than MOST_GROUPS share groups, and stay whole."""
    r = random.Random(3)
    rows = [(f"v{r.randrange(3000)}", f"v{r.randrange(3000)}") for _ in range(6000)]
    df = spark.createDataFrame(rows, "a string, b string")
    communities = df.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    chosen = bisect(df, "a", "b", communities, 0.1, 0.1, restarts=4, steps=50)
    assert chosen.count() == communities.count()
    share = {x["partition"]: x["count"] / len(rows) for x in S.label_by_test_vertices(df, "a", "b", chosen.where("is_test"), "vertex").groupBy("partition").count().collect()}
    assert 0.02 < share["C3"] < 0.2
    none = bisect(df.limit(0), "a", "b", communities.limit(0), 0.1, 0.1)
    assert none.count() == 0


@pytest.mark.parametrize(("name", "most"), [("cluster_ids", 6), ("greedy_reps", 6), ("redundant_edges", 4)])
def test_queries_shuffle_pairs_without_links_few_times(spark, tmp_path, name, most):
    """Pairs that nothing is like are by far the most; a query's disk follows how often all of them are shuffled."""
    from dyadic.plans import graphs

    n = 1000
    hits = [(f"a{i}", f"b{i}", 0.3) for i in range(n)] + [("a1", "a2", 0.9), ("b1", "b2", 0.9)]
    rows = [(q, t, f, 0.9, 0.9, 1e-9, 50 + i % 7) for i, (q, t, f) in enumerate(hits)]
    spark.createDataFrame(rows, ALIGNED + ", bits int").coalesce(1).write.parquet(str(tmp_path / "ara_prot_all_vs_all.parquet"))
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graphs.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == (1 if name == "redundant_edges" else n)
    assert sum(k for stage, k in shuffled(spark).items() if stage not in before) < most * n


@pytest.mark.parametrize("few", [0, 1 << 15])
@pytest.mark.parametrize("n_links", [0, 1, 150])
def test_clusters_over_several_blocks(spark, monkeypatch, few, n_links):
    """Ids count through from block to block; blocks may have no members, or heads only."""
    monkeypatch.setattr(G, "FEW_ROWS", few)
    monkeypatch.setattr(G, "BLOCK", 16)
    r = random.Random(n_links)
    n = 100
    links = {tuple(sorted(r.sample(range(1, n - 40), 2))) for _ in range(n_links)}
    of = {}
    for x in range(1, n + 1):
        if x not in of:
            of |= {y: x for h, y in sorted(links) if h == x and y not in of} | {x: x}
    ids = {x: i + 1 for i, x in enumerate(sorted(set(of.values())))}
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(1, n + 1)], "node string, rank long")
    edges = G.Workspace(spark, "test").save(spark.createDataFrame(sorted(links), "hi long, lo long"), "links")
    got = [tuple(x) for x in G.greedy_clusters(nodes, "node", edges, "rank").select("node", "representative", "is_representative", "cluster_id").collect()]
    assert sorted(got) == sorted((f"n{x}", f"n{y}", x == y, ids[y]) for x, y in of.items())


def test_numbered_as_ranked(spark):
    from dyadic.operators.ordering import numbered

    r = random.Random(6)
    rows = sorted({(r.choice([None, 1, 2, 3]), r.randrange(10_000)) for _ in range(3000)}, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "a int, b int")
    got = {x["rank"]: (x.a, x.b) for x in numbered(df, [F.desc("a"), F.col("b")]).collect()}
    assert got == {i + 1: x for i, x in enumerate(rows)}


@pytest.mark.parametrize("seed", range(3))
def test_interologs_in_cells(spark, seed):
    """Many parts and small pieces give what the joins give; pairs may be repeated, and homologs be without pairs."""
    r = random.Random(seed)
    draw = lambda k: [f"n{r.randint(0, 40)}" for _ in range(k)]
    positives = [*zip(draw(60), draw(60)), ("n1", "alone"), ("n1", None), ("n2", "n2")]
    links = {tuple(sorted(p)) for p in zip(draw(30), draw(30)) if p[0] != p[1]} | {("n1", "n2"), ("n3", "unpaired")}
    pairs_of = spark.createDataFrame(positives, "u string, v string")
    edges = spark.createDataFrame([(u, v, 0.9) for u, v in links], "u string, v string, similarity double")
    nodes = spark.createDataFrame([(x,) for x in {y for p in positives for y in p if y}], "node string")
    want = {tuple(x) for x in negatives.interologs(pairs_of, G.reflexive(edges, nodes, "node")).collect()}
    got = [tuple(x) for x in negatives.interologs_in_cells(pairs_of, G.mutual(edges), names=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    none = negatives.interologs_in_cells(pairs_of.where("u = 'x'"), G.mutual(edges.where("u = 'x'")))
    assert none.columns == ["u", "v"] and none.count() == 0


def test_pieces_of_a_cell(monkeypatch):
    """Pieces hold whole nodes, so that no pair is made twice."""
    import numpy as np

    r = np.random.default_rng(1)
    a, b, x, y = (r.integers(0, 50, 400) for _ in range(4))
    near = lambda n, lo: {n} & set(range(lo, lo + 25)) | {q for p, q in zip(x.tolist(), y.tolist()) if p == n and lo <= q < lo + 25}
    for limit in (1, 300, 1 << 19):
        monkeypatch.setattr(negatives, "CELL_ROWS", limit)
        for i, j in ((0, 0), (0, 1), (1, 1)):
            want = {(u, v) for p, q in zip(a.tolist(), b.tolist()) for u in near(p, 25 * i) for v in near(q, 25 * j) if u < v}
            got = [t for u, v in negatives._cell_pairs((a, b), (x, y), i, j, 25) for t in zip(u.tolist(), v.tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_interologs_of_a_hub_are_not_shuffled(spark, tmp_path):
    """A hub's homologs times its pairs are returned, as many as there are, but no stage shuffles them."""
    import duckdb
    from oracle import table
    from dyadic.plans import graphs

    n = 200
    hits = [("H", f"h{i}", 0.9) for i in range(n)] + [("H", f"p{i}", 0.3) for i in range(n)] + [("q", "h0", 0.2)]
    at = str(tmp_path / "ara_prot_all_vs_all.parquet")
    spark.createDataFrame([(q, t, f, 0.9, 0.9, 1e-9, 50) for q, t, f in hits], ALIGNED + ", bits int").coalesce(1).write.parquet(at)
    before = set(shuffled(spark))
    df = graphs.QUERIES["interolog_rules_all"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) > n * n
    assert max(rows for stage, rows in shuffled(spark).items() if stage not in before) < 20 * n
    con = duckdb.connect()
    con.execute(f"CREATE VIEW ara_prot_all_vs_all AS SELECT * FROM '{at}/*.parquet'")
    want = con.execute(graphs.SQL["interolog_rules_all"])
    assert table(df.columns, got) == table([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize(("name", "most"), [("greedy_reps", 4), ("redundant_edges", 2)])
def test_pairs_without_links_are_not_shuffled_to_find_links(spark, tmp_path, name, most):
    """Pairs neither of whose ends has homologs are dropped where they are, before they are joined with the links."""
    from dyadic.plans import graphs

    n = 1000
    hits = [(f"a{i}", f"b{i}", 0.3) for i in range(n)] + [("a1", "a2", 0.9), ("b1", "b2", 0.9)]
    rows = [(q, t, f, 0.9, 0.9, 1e-9, 50 + i % 7) for i, (q, t, f) in enumerate(hits)]
    spark.createDataFrame(rows, ALIGNED + ", bits int").coalesce(1).write.parquet(str(tmp_path / "ara_prot_all_vs_all.parquet"))
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graphs.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == (1 if name == "redundant_edges" else n)
    assert sum(k for stage, k in shuffled(spark).items() if stage not in before) < most * n


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 23])
def test_maybe_among_keeps_all_that_are(spark, monkeypatch, bits):
    """A filter that is full keeps all rows; none drops a row whose value is among the nodes, or repeats one."""
    monkeypatch.setattr(G, "FILTER_BITS", bits)
    rows = spark.createDataFrame([(f"n{i % 400}", i) for i in range(800)] + [(None, -1)], "x string, i int")
    got = [r.i for r in G.maybe_among(rows, "x", spark.createDataFrame([(f"n{i}",) for i in range(0, 400, 2)] * 2, "node string"), "node").collect()]
    sure = {i for i in range(800) if i % 2 == 0}
    assert len(got) == len(set(got)) and sure <= set(got)
    assert bits < 1 << 20 or set(got) - {-1} == sure


def written(spark):
    """Rows that each stage so far has written to tables, by its number."""
    jvm, none = spark._jvm, spark._sc._gateway.new_array(spark._jvm.double, 0)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).outputRecords() for i in range(stages.size())}


def test_redundant_edges_write_no_table_of_all_pairs(spark, tmp_path):
    """What is written on the way follows the pairs with links; keys are made of the ends where they are read."""
    from dyadic.plans import graphs

    n = 1000
    hits = [(f"a{i}", f"b{i}", 0.3) for i in range(n)] + [("a1", "a2", 0.9), ("b1", "b2", 0.9)]
    spark.createDataFrame([(q, t, f, 0.9, 0.9, 1e-9, 50) for q, t, f in hits], ALIGNED + ", bits int").coalesce(1).write.parquet(str(tmp_path / "ara_prot_all_vs_all.parquet"))
    before = set(written(spark))
    got = graphs.QUERIES["redundant_edges"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("A1|B1", "A2|B2", 0.9)]
    assert sum(k for stage, k in written(spark).items() if stage not in before) < n // 10
