"""Queries over alignments, pair graphs, candidate negatives, partitions and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadic.operators import graph as G
from dyadic.operators import metrics as M
from dyadic.operators import negatives as N
from dyadic.operators import pairs as P
from dyadic.operators import partition as S
from dyadic.operators import skew
from dyadic.operators.bisection import bisect
from dyadic.operators.ordering import numbered
from dyadic.plans.catalogue import Catalogue
from dyadic.session import Workspace, is_missing, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

THETA, COVERAGE, EVALUE = 0.5, 0.8, 1e-3
F_OK = "CASE WHEN NOT isnan(fident) THEN CASE WHEN fident > 1 THEN fident / 100 ELSE fident END END"
EDGES = f"""SELECT least(upper(trim(query)), upper(trim(target))) AS u, greatest(upper(trim(query)), upper(trim(target))) AS v, max({F_OK}) AS similarity
FROM ara_prot_all_vs_all WHERE {F_OK} >= {{0}} AND qcov >= {{1}} AND tcov >= {{1}} AND evalue <= {EVALUE} AND upper(trim(query)) <> upper(trim(target)) GROUP BY 1, 2"""
CORE_EDGES = EDGES.format(THETA, COVERAGE)
#: Pairs to be made non-redundant: hits of low identity, with score and evidence by their segments.
PAIRS = f"""SELECT a || '|' || b AS pair_key, a, b, max(bits) AS bits, count(*) AS n_segments FROM (SELECT least(upper(trim(query)), upper(trim(target))) AS a, greatest(upper(trim(query)), upper(trim(target))) AS b, bits FROM ara_prot_all_vs_all
WHERE {F_OK} < {THETA} AND upper(trim(query)) <> upper(trim(target))) GROUP BY a, b"""
NODES = "SELECT upper(trim(query)) AS node FROM ara_prot_all_vs_all UNION SELECT upper(trim(target)) FROM ara_prot_all_vs_all"
HOMOLOGS = f"SELECT u AS x, v AS y, similarity AS s FROM ({CORE_EDGES}) UNION ALL SELECT v, u, similarity FROM ({CORE_EDGES}) UNION ALL SELECT node, node, 1.0 FROM ({NODES})"
COMPONENTS = f"""WITH RECURSIVE e AS ({CORE_EDGES}), s AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e),
g(node, component) USING KEY (node) AS (
  SELECT node, node FROM ({NODES})
  UNION
  SELECT s.b, min(g.component) FROM g JOIN s ON s.a = g.node JOIN recurring.g AS r ON r.node = s.b WHERE g.component < r.component GROUP BY s.b)
"""


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ara_prot_all_vs_all")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.similarity_edges(alignments(spark, d), THETA, COVERAGE, EVALUE)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d).select(F.explode(F.array(*(F.upper(F.trim(c)) for c in ("query", "target")))).alias("node")).distinct()


def low_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, t = (F.upper(F.trim(c)) for c in ("query", "target"))
    rows = alignments(spark, d).where((G.identity_fraction(F.col("fident")) < THETA) & (q != t))
    return rows.groupBy(F.least(q, t).alias("a"), F.greatest(q, t).alias("b")).agg(F.max("bits").alias("bits"), F.count("*").alias("n_segments")).withColumn("pair_key", P.canonical_key("a", "b"))


def homologs(spark: SparkSession, d: str) -> DataFrame:
    return G.reflexive(edges(spark, d), nodes(spark, d), "node")


@query(CORE_EDGES)
def sim_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"SELECT least(upper(trim(query)), upper(trim(target))) AS u, greatest(upper(trim(query)), upper(trim(target))) AS v, max({F_OK}) AS similarity, count(*) AS n_segments FROM ara_prot_all_vs_all GROUP BY 1, 2")
def dedupe_hsp(spark: SparkSession, d: str) -> DataFrame:
    q, t = (F.upper(F.trim(c)) for c in ("query", "target"))
    return alignments(spark, d).groupBy(F.least(q, t).alias("u"), F.greatest(q, t).alias("v")).agg(F.max(G.identity_fraction(F.col("fident"))).alias("similarity"), F.count("*").alias("n_segments"))


@query(COMPONENTS + "SELECT node, component FROM g")
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(nodes(spark, d), edges(spark, d))


@query(COMPONENTS + f"SELECT pair_key, least(x.component, y.component) || '|' || greatest(x.component, y.component) AS component_key FROM ({PAIRS}) AS p JOIN g AS x ON x.node = p.a JOIN g AS y ON y.node = p.b")
def component_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = G.components(nodes(spark, d), edges(spark, d))
    return G.component_keys(low_pairs(spark, d), "a", "b", parts).select("pair_key", "component_key")


REDUNDANT = f"""WITH h AS ({HOMOLOGS}), p AS ({PAIRS}),
g AS (SELECT p.pair_key AS key_1, least(ha.y, hb.y) AS a, greatest(ha.y, hb.y) AS b, least(ha.s, hb.s) AS s FROM p JOIN h AS ha ON ha.x = p.a JOIN h AS hb ON hb.x = p.b),
r AS (SELECT key_1, p.pair_key AS key_2, max(s) AS similarity FROM g JOIN p ON p.a = g.a AND p.b = g.b WHERE key_1 < p.pair_key GROUP BY ALL)
"""


def _homologs(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark, "redundancy").save(G.mutual(edges(spark, d)), "homologs")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """low_pairs and homologs, written: each is read several times."""
    return Workspace(spark, "redundancy").save(low_pairs(spark, d), "pairs"), _homologs(spark, d)


def _redundant(pairs: DataFrame, known: DataFrame, key: str = "pair_key") -> DataFrame:
    return G.redundant_pairs(pairs, key, "a", "b", known, distinct=True)


@query(REDUNDANT + "SELECT key_1, key_2, similarity FROM r")
def redundant_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.redundant_pairs(low_pairs(spark, d).select("a", "b"), P.canonical_key, "a", "b", _homologs(spark, d), distinct=True)


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of all pairs. Their places in order stand for them throughout; names are put in where they are placed."""
    order = [F.desc("bits"), F.desc("n_segments"), F.col("a"), F.col("b")]
    pairs = numbered(low_pairs(spark, d).select("a", "b", "bits", "n_segments"), order).select("rank", "a", "b")
    work = Workspace(spark, "greedy_pairs")
    links = work.save(_redundant(pairs, _homologs(spark, d), "rank").where(F.col("similarity") >= THETA).select(F.col("key_1").alias("hi"), F.col("key_2").alias("lo")), "links")
    return G.greedy_clusters(pairs.select("rank", P.canonical_key("a", "b").alias("node")), "node", links, "rank")


#: Nodes with links in order of priority, one after the other, with the list of representatives so far.
GREEDY = (
    REDUNDANT.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", o AS (SELECT pair_key, row_number() OVER (ORDER BY bits DESC, n_segments DESC, a, b) AS rank FROM p),
k AS (SELECT x.rank AS hi, y.rank AS lo FROM r JOIN o AS x ON x.pair_key = r.key_1 JOIN o AS y ON y.pair_key = r.key_2 WHERE similarity >= {THETA}),
d AS (SELECT least(hi, lo) AS hi, greatest(hi, lo) AS lo FROM k),
n AS (SELECT rank, row_number() OVER (ORDER BY rank) AS i FROM (SELECT hi AS rank FROM d UNION SELECT lo FROM d)),
m AS MATERIALIZED (SELECT n.i, n.rank, coalesce(list(d.hi) FILTER (d.hi IS NOT NULL), []) AS before FROM n LEFT JOIN d ON d.lo = n.rank GROUP BY n.i, n.rank),
w(i, reps) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT m.i, CASE WHEN list_has_any(before, reps) THEN reps ELSE list_append(reps, m.rank) END FROM w JOIN m ON m.i = w.i + 1),
f AS (SELECT reps FROM w ORDER BY i DESC LIMIT 1),
t AS (SELECT m.rank, list_min(list_intersect(before, reps)) AS rep FROM m, f WHERE list_has_any(before, reps)),
z AS (SELECT o.pair_key, o.rank, coalesce(t.rep, o.rank) AS rep FROM o LEFT JOIN t USING (rank))
"""
)


@query(GREEDY + "SELECT z.pair_key AS node, o.pair_key AS representative, z.rep = z.rank AS is_representative FROM z JOIN o ON o.rank = z.rep")
def greedy_reps(spark: SparkSession, d: str) -> DataFrame:
    return _greedy(spark, d).drop("cluster_id")


@query(GREEDY + "SELECT z.pair_key, o.pair_key AS representative, z.rep = z.rank AS is_representative, dense_rank() OVER (ORDER BY z.rep) AS cluster_id FROM z JOIN o ON o.rank = z.rep")
def cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    """Members with consecutive cluster ids, in the order of their representatives."""
    return _greedy(spark, d).withColumnRenamed("node", "pair_key")


@query(
    COMPONENTS
    + """, z AS (SELECT component, count(*) AS n FROM g GROUP BY component)
SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_members, avg(n) AS mean_size, max(n) AS max_size, min(n) AS min_size, min(n) FILTER (n > 1) AS min_multi_size, count(*) FILTER (n = 1) AS n_singletons, count(*) FILTER (n > 1) AS n_multi FROM z"""
)
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.cluster_statistics(G.components(nodes(spark, d), edges(spark, d)), "component")


@query(COMPONENTS + "SELECT component, count(*) AS size FROM g GROUP BY component ORDER BY size DESC, component LIMIT 20")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return G.top_groups(G.components(nodes(spark, d), edges(spark, d)), "component", 20)


GRID = [(0.4, 0.5), (0.5, 0.8), (0.7, 0.7), (0.9, 0.9)]


@query(
    "WITH RECURSIVE n AS (SELECT p, node FROM (" + NODES + ") CROSS JOIN (SELECT unnest(range(4)) AS p)), s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS p, u AS a, v AS b FROM ({EDGES.format(t, c)}) UNION ALL SELECT {i}, v, u FROM ({EDGES.format(t, c)})" for i, (t, c) in enumerate(GRID))
    + """), g(p, node, component) USING KEY (p, node) AS (SELECT p, node, node FROM n UNION
  SELECT s.p, s.b, min(g.component) FROM g JOIN s ON s.p = g.p AND s.a = g.node JOIN recurring.g AS r ON r.p = s.p AND r.node = s.b WHERE g.component < r.component GROUP BY s.p, s.b),
z AS (SELECT p, component, count(*) AS n FROM g GROUP BY p, component)
SELECT [0.4, 0.5, 0.7, 0.9][p + 1]::DOUBLE AS theta, [0.5, 0.8, 0.7, 0.9][p + 1]::DOUBLE AS coverage_min, count(*) AS n_clusters, sum(n)::BIGINT AS n_members, avg(n) AS mean_size, max(n) AS max_size, min(n) AS min_size, min(n) FILTER (n > 1) AS min_multi_size, count(*) FILTER (n = 1) AS n_singletons, count(*) FILTER (n > 1) AS n_multi FROM z GROUP BY p"""
)
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    q, t = (F.upper(F.trim(c)) for c in ("query", "target"))
    f = G.identity_fraction(F.col("fident"))
    # a point's edge needs one segment that satisfies both limits, so segments stay apart
    rows = alignments(spark, d).where((F.col("evalue") <= EVALUE) & (q != t) & f.isNotNull() & F.col("qcov").isNotNull() & F.col("tcov").isNotNull())
    loosest = rows.select(F.least(q, t).alias("u"), F.greatest(q, t).alias("v"), f.alias("s"), F.least("qcov", "tcov").alias("c")).where(F.col("s") >= min(g[0] for g in GRID)).distinct()
    return G.sweep(loosest, nodes(spark, d), "node", GRID, "s", "c")


C4 = "ara_positive_c4_test_id0_50_cov0_80"


@query(
    REDUNDANT
    + """, c AS (SELECT pair_key AS k, split_part(pair_key, '|', 1) AS c FROM p), z AS (SELECT c, count(*) AS n FROM c GROUP BY c HAVING count(*) > 1),
i AS (SELECT x.c, r.similarity FROM r JOIN c AS x ON x.k = key_1 JOIN c AS y ON y.k = key_2 WHERE x.c = y.c),
j AS (SELECT c, count(*) AS k, count(*) FILTER (similarity >= 0.5) AS good, sum(similarity) AS total, max(similarity) AS most, min(similarity) AS least FROM i GROUP BY c)
SELECT z.c AS cluster, n, n * (n - 1) // 2 AS n_pairs, coalesce(good, 0) AS n_similar, round(coalesce(good, 0) / (n * (n - 1) // 2), 6) AS density, round(coalesce(total, 0) / (n * (n - 1) // 2), 6) AS mean_similarity, CASE WHEN coalesce(k, 0) = n * (n - 1) // 2 THEN least ELSE 0.0 END AS min_similarity, coalesce(most, 0.0) AS max_similarity FROM z LEFT JOIN j USING (c)"""
)
def cluster_density(spark: SparkSession, d: str) -> DataFrame:
    pairs, known = _tables(spark, d)
    members = pairs.select("pair_key", F.substring_index("pair_key", "|", 1).alias("cluster"))
    out = G.cluster_density(members, "cluster", "pair_key", _redundant(pairs, known), THETA)
    return out.withColumns({c: F.round(c, 6) for c in ("density", "mean_similarity")})


@query(f"SELECT cluster_id, list_sort(list(hippie_score))[count(hippie_score) // 2 + 1] AS upper_median FROM {C4} WHERE cluster_id >= 0 AND hippie_score IS NOT NULL GROUP BY cluster_id")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, C4).where("cluster_id >= 0 AND hippie_score IS NOT NULL")
    return skew.upper_medians(skew.compress(rows, F.col("cluster_id"), F.col("hippie_score"))).withColumnRenamed("key", "cluster_id")


@query(f"SELECT x.cluster_id AS cluster, x.row_id AS key_1, y.row_id AS key_2 FROM {C4} AS x JOIN {C4} AS y ON x.cluster_id = y.cluster_id AND x.row_id < y.row_id WHERE x.cluster_id >= 0")
def intra_cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.intra_cluster_pairs(table(spark, d, C4).where("cluster_id >= 0"), "cluster_id", "row_id")


MASKS = "SELECT vec_id, bit_or((1 << (CASE WHEN k = 0 THEN label ELSE (vec_id * 7) % 10 END)::INT)::INT) AS mask FROM embeddings CROSS JOIN (VALUES (0), (1)) AS t(k) GROUP BY vec_id"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    bits = F.explode(F.array(F.col("label").cast("long"), (F.col("vec_id") * 7) % 10))
    return N.category_mask(table(spark, d, "embeddings").select("vec_id", bits.alias("bit")), "vec_id", F.col("bit"))


@query(MASKS)
def mask_bits(spark: SparkSession, d: str) -> DataFrame:
    return _masks(spark, d)


DISJOINT = f"WITH m AS ({MASKS}), c AS (SELECT x.vec_id AS u, y.vec_id AS v, x.mask AS mask_u, y.mask AS mask_v FROM m AS x JOIN m AS y ON x.vec_id < y.vec_id AND x.mask & y.mask = 0)"
NEXT = "SELECT least(vec_id, n) AS u, greatest(vec_id, n) AS v FROM (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY {}) AS n FROM embeddings) WHERE n IS NOT NULL"
BY_ID, BY_VALUE = NEXT.format("vec_id"), NEXT.format("embedding[1], vec_id")
CHAIN = "SELECT x.vec_id AS u, y.vec_id AS v FROM embeddings AS x JOIN embeddings AS y ON y.vec_id = x.vec_id + 1"
KNOWN = f"{BY_ID} UNION {BY_VALUE} UNION {CHAIN}"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return N.disjoint_pairs(_masks(spark, d), "vec_id", "mask")


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Known pairs by three sources: neighbours by number, and within a label by number and by first coordinate."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"))
    after = lambda *order: F.lead("vec_id").over(Window.partitionBy("label").orderBy(*order))
    pair = lambda df: df.where("n IS NOT NULL").select(F.least("vec_id", "n").alias("u"), F.greatest("vec_id", "n").alias("v"))
    chain = v.select(F.col("vec_id").alias("u")).join(v.select((F.col("vec_id") - 1).alias("u"), F.col("vec_id").alias("v")), "u")
    return {"by_id": pair(v.withColumn("n", after("vec_id"))), "by_value": pair(v.withColumn("n", after("x", "vec_id"))), "chain": chain}


def _known(spark: SparkSession, d: str) -> DataFrame:
    return N.union_with_support(_sources(spark, d)).select("u", "v")


@query(DISJOINT + "SELECT * FROM c")
def mask_disjoint_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query(DISJOINT + f"SELECT c.* FROM c ANTI JOIN ({KNOWN}) AS k USING (u, v)")
def blacklist_anti(spark: SparkSession, d: str) -> DataFrame:
    return N.without(_candidates(spark, d), _known(spark, d))


@query(f"SELECT u, v, string_agg(s, '|' ORDER BY s) AS sources, count(*) AS n_sources FROM (SELECT u, v, 'by_id' AS s FROM ({BY_ID}) UNION SELECT u, v, 'by_value' FROM ({BY_VALUE}) UNION SELECT u, v, 'chain' FROM ({CHAIN})) GROUP BY u, v")
def blacklist_support(spark: SparkSession, d: str) -> DataFrame:
    return N.union_with_support(_sources(spark, d))


RULES = f"h AS ({HOMOLOGS}), p AS ({PAIRS}), q AS (SELECT a, b FROM p WHERE bits >= 400), f AS (SELECT DISTINCT least(x.y, y.y) AS u, greatest(x.y, y.y) AS v FROM q JOIN h AS x ON x.x = q.a JOIN h AS y ON y.x = q.b WHERE x.y <> y.y)"


def _interologs(spark: SparkSession, d: str) -> DataFrame:
    """Of the low pairs that reach 400 bits only: interolog_anti takes positives and candidates from one table, and a positive is its own interolog."""
    positives = low_pairs(spark, d).where("bits >= 400").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return N.interologs(positives, homologs(spark, d))


@query(f"WITH {RULES} SELECT u, v FROM f")
def interolog_rules(spark: SparkSession, d: str) -> DataFrame:
    return _interologs(spark, d)


@query(f"WITH h AS ({HOMOLOGS}), p AS ({PAIRS}) SELECT DISTINCT least(x.y, y.y) AS u, greatest(x.y, y.y) AS v FROM p JOIN h AS x ON x.x = p.a JOIN h AS y ON y.x = p.b WHERE x.y <> y.y")
def interolog_rules_all(spark: SparkSession, d: str) -> DataFrame:
    """The expansion of every low pair, whatever its bits."""
    return N.interologs_in_cells(low_pairs(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v")), G.mutual(edges(spark, d)))


@query(f"WITH {RULES} SELECT a AS u, b AS v FROM p ANTI JOIN f ON p.a = f.u AND p.b = f.v")
def interolog_anti(spark: SparkSession, d: str) -> DataFrame:
    return N.without(low_pairs(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v")), _interologs(spark, d))


#: Test vertices by hash, whole clusters at a time.
C4_MISS = "('', '-', 'NA', 'nan')"
CLEAN = f"SELECT row_id, participant_a_id AS a, participant_b_id AS b, cluster_id, hippie_score, evidence_count FROM {C4} WHERE trim(participant_a_id) NOT IN {C4_MISS} AND trim(participant_b_id) NOT IN {C4_MISS}"
TEST = f"SELECT DISTINCT v FROM (SELECT a AS v FROM ({CLEAN}) UNION SELECT b FROM ({CLEAN})) WHERE ('0x' || substr(md5(v), 1, 4))::INT < 19661"
LABELLED = f"WITH r AS ({CLEAN}), t AS ({TEST}), l AS (SELECT r.*, CASE (a IN (FROM t))::INT + (b IN (FROM t))::INT WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' ELSE 'C3' END AS partition FROM r)"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, C4).where(~is_missing("participant_a_id") & ~is_missing("participant_b_id"))
    return rows.select("row_id", F.col("participant_a_id").alias("a"), F.col("participant_b_id").alias("b"), "cluster_id", "hippie_score", "evidence_count")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d)
    vertices = rows.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    test = vertices.where(F.conv(F.substring(F.md5("v"), 1, 4), 16, 10).cast("int") < 19661)
    return S.label_by_test_vertices(rows, "a", "b", test, "v")


@query(LABELLED + "SELECT row_id, partition FROM l")
def split_label(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("row_id", "partition")


@query(
    LABELLED
    + """, n AS (SELECT partition AS p, count(*) AS n, sum(count(*)) OVER () AS total FROM l GROUP BY partition)
SELECT 'share_' || p AS "check", round(n / total, 6) AS result, CASE p WHEN 'C1' THEN 0.49 WHEN 'C2' THEN 0.42 ELSE 0.09 END::DOUBLE AS target, abs(n / total - CASE p WHEN 'C1' THEN 0.49 WHEN 'C2' THEN 0.42 ELSE 0.09 END) <= 0.2 AS passed FROM n
UNION ALL SELECT 'vertices_in_train_and_test', count(*)::DOUBLE, 0.0, count(*) = 0 FROM (SELECT v FROM (SELECT a AS v, partition FROM l UNION SELECT b, partition FROM l) WHERE partition IN ('C1', 'C3') GROUP BY v HAVING count(DISTINCT partition) > 1)
UNION ALL SELECT 'pairs_in_two_partitions', count(*)::DOUBLE, 0.0, count(*) = 0 FROM (SELECT least(a, b), greatest(a, b) FROM l GROUP BY ALL HAVING count(DISTINCT partition) > 1)"""
)
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    return S.audit(_labelled(spark, d), "a", "b", "partition", {"C1": 0.49, "C2": 0.42, "C3": 0.09}, 0.2).withColumn("result", F.round("result", 6))


@query(LABELLED + "SELECT n_parts, count(*) AS n_keys FROM (SELECT v, count(DISTINCT partition) AS n_parts FROM (SELECT a AS v, partition FROM l UNION ALL SELECT b, partition FROM l) GROUP BY v HAVING count(DISTINCT partition) > 1) GROUP BY n_parts")
def set_disjoint(spark: SparkSession, d: str) -> DataFrame:
    ends = _labelled(spark, d).select(F.explode(F.array("a", "b")).alias("v"), "partition")
    return S.overlaps(ends, ["v"], "partition")


def _bisected(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d)
    links = rows.select(F.col("a").alias("u"), F.col("b").alias("v"))
    vertices = links.select(F.explode(F.array("u", "v")).alias("node"))
    # communities: a vertex with the cluster of its first pair, else by itself
    first = rows.where("cluster_id >= 0").select(F.explode(F.array("a", "b")).alias("node"), "cluster_id").groupBy("node").agg(F.min("cluster_id").cast("string").alias("c"))
    communities = vertices.distinct().join(first, "node", "left").select("node", F.coalesce("c", "node").alias("component"))
    chosen = bisect(rows, "a", "b", communities, 0.1, 0.1)
    return S.label_by_test_vertices(rows, "a", "b", chosen.where("is_test"), "vertex")


@query()
def bisection(spark: SparkSession, d: str) -> DataFrame:
    """Test vertices grown from seeds over the communities of the pair graph, and the partition that follows."""
    return _bisected(spark, d).select("row_id", "partition")


@query(
    """SELECT "check", true AS passed FROM (VALUES ('pairs_in_two_partitions'), ('vertices_in_train_and_test'), ('rows_lost_or_doubled'), ('cut_pairs_on_one_side'), ('share_C1'), ('share_C2'), ('share_C3')) AS t("check")"""
)
def bisection_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the partition of bisection must satisfy; which vertices are chosen, SQL can't tell."""
    parted = Workspace(spark, "bisection").save(_bisected(spark, d), "parted")
    return S.audit(parted, "a", "b", "partition", {"C1": 0.8, "C2": 0.1, "C3": 0.1}, 0.05, _clean(spark, d), "row_id").select("check", "passed")


LINKS = f"SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM ({CLEAN}) WHERE a <> b"


@query(
    f"""WITH e AS (SELECT u, v, md5(u || '|' || v || '|42') AS h FROM ({LINKS})), k AS (SELECT DISTINCT h FROM (SELECT x, min(h) AS h FROM (SELECT u AS x, h FROM e UNION ALL SELECT v, h FROM e) GROUP BY x)),
f AS (SELECT h, row_number() OVER (ORDER BY h, u, v) AS i FROM e WHERE h NOT IN (FROM k)) SELECT u, v, e.h IN (SELECT h FROM f WHERE i <= (SELECT floor(count(*) * 0.05) FROM e)) AS held_out FROM e"""
)
def degree_safe_holdout(spark: SparkSession, d: str) -> DataFrame:
    links = _clean(spark, d).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return S.degree_safe_holdout(links, "u", "v", 0.05)


@query(LABELLED + ", s AS (SELECT partition, count(*) AS n FROM l GROUP BY partition) SELECT row_id, partition, hippie_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY hippie_score DESC NULLS LAST, md5(row_id || '|42'), row_id) AS rank FROM l) JOIN s USING (partition) WHERE rank <= CASE partition WHEN 'C1' THEN 3 WHEN 'C2' THEN 2 ELSE 1 END * n // 10")
def topk_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """Quotas are shares of the pools, so that each pool fills its own; one that didn't would be an error."""
    rows = _labelled(spark, d)
    tenths = {"C1": 3, "C2": 2, "C3": 1}
    quotas = {r["partition"]: tenths[r["partition"]] * r["n"] // 10 for r in rows.groupBy("partition").agg(F.count("*").alias("n")).collect()}  # three rows
    return S.take_best(rows, "partition", quotas, "hippie_score", ["row_id"]).select("row_id", "partition", "hippie_score", "rank")


@query(LABELLED + "SELECT partition, count(*) AS n_positive, 10 * count(*) AS n_wanted, sum(evidence_count)::BIGINT AS n_evidence FROM l GROUP BY partition")
def ratio_check(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("partition").agg(F.count("*").alias("n_positive"), (10 * F.count("*")).alias("n_wanted"), F.sum("evidence_count").alias("n_evidence"))


PRED = "SELECT pair_id, coalesce(interaction_level, 'none') AS task, hippie_score AS score, (pmid_count >= 2)::INT AS label FROM (SELECT *, hippie_confidence_level AS x, throughput_classes AS interaction_level FROM tomato_positive_pairs_deduplicated) WHERE hippie_score IS NOT NULL AND NOT isnan(hippie_score) AND pmid_count IS NOT NULL"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tomato_positive_pairs_deduplicated").where("hippie_score IS NOT NULL AND NOT isnan(hippie_score) AND pmid_count IS NOT NULL")
    return rows.select("pair_id", F.coalesce("throughput_classes", F.lit("none")).alias("task"), F.col("hippie_score").alias("score"), (F.col("pmid_count") >= 2).cast("int").alias("label"))


@query(f"SELECT pair_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(pair_id || '|42'), pair_id) - 1) % 10)::INT AS fold FROM ({PRED})")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.folds(predictions(spark, d), ["pair_id"], 10, ["label"]).select("pair_id", "label", "fold")


@query(f"SELECT pair_id, ((row_number() OVER (ORDER BY md5(pair_id || '|63'), pair_id) - 1) % 5)::INT AS fold FROM ({PRED})")
def plain_kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.folds(predictions(spark, d), ["pair_id"], 5, seed=63).select("pair_id", "fold")


@query(f"SELECT pair_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(pair_id || '|42'), pair_id) <= floor(count(*) OVER (PARTITION BY label) * 0.1) AS held_out FROM ({PRED})")
def strat_holdout(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_holdout(predictions(spark, d), ["pair_id"], 0.1, ["label"]).select("pair_id", "label", "held_out")


@query(f"SELECT row_id, round(avg(s), 6) AS mean_score, count(*) AS n_scores FROM (SELECT row_id, hippie_score * length(a) / (length(a) + length(b)) AS s FROM ({CLEAN}) UNION ALL SELECT row_id, hippie_score * length(b) / (length(a) + length(b)) FROM ({CLEAN})) GROUP BY row_id")
def order_swap_avg(spark: SparkSession, d: str) -> DataFrame:
    long = S.both_orders(_clean(spark, d), "a", "b").withColumn("s", F.col("hippie_score") * F.length("a") / (F.length("a") + F.length("b")))
    return M.ensemble_mean(long, ["row_id"], "s").withColumn("mean_score", F.round("mean_score", 6))


@query(
    f"""WITH c AS (SELECT task, count(*) FILTER (score > 0.62 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score > 0.62 AND label = 0)::DOUBLE AS fp, count(*) FILTER (score <= 0.62 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score <= 0.62 AND label = 0)::DOUBLE AS tn FROM ({PRED}) GROUP BY task)
SELECT task, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c"""
)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    out = M.threshold_metrics(predictions(spark, d), ["task"], "score", "label", 0.62)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "specificity", "f1", "mcc")})


CURVE = f"""WITH p AS ({PRED}), s AS (SELECT task, score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY task, score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n, sum(pos) OVER (PARTITION BY task) AS ap, sum(neg) OVER (PARTITION BY task) AS an FROM s WINDOW w AS (PARTITION BY task ORDER BY score DESC)),
m AS (SELECT *, tp / n AS precision, tp / ap AS recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, lag(precision, 1, 1.0) OVER (PARTITION BY task ORDER BY score DESC) AS before FROM m)
"""


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return M.ranking_metrics(predictions(spark, d), ["task"], "score", "label")


@query(CURVE + "SELECT task, round(sum(pos / ap * precision), 6) AS average_precision FROM f GROUP BY task")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("task", F.round("average_precision", 6).alias("average_precision"))


@query(CURVE + "SELECT task, round(sum(pos / ap * (precision + before) / 2), 6) AS pr_auc FROM f GROUP BY task")
def pr_auc_trapz(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("task", F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH p AS ({PRED}), r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS mid FROM p) SELECT task, round((sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0), 6)::DOUBLE AS auroc FROM r GROUP BY task")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("task", F.round("auroc", 6).alias("auroc"))


@query(CURVE + "SELECT task, round(max(f1), 6) AS best_f1, arg_max(score, (f1, -score)) AS best_threshold FROM f GROUP BY task")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("task", F.round("best_f1", 6).alias("best_f1"), "best_threshold")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, pair_id) AS i FROM ({PRED})) SELECT task, k, round(avg(label), 6) AS precision_at_k FROM r JOIN (VALUES (10), (20), (50)) AS t(k) ON i <= k GROUP BY task, k")
def prec_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.precision_at(predictions(spark, d), ["task"], "score", "label", ["pair_id"], [10, 20, 50]).withColumn("precision_at_k", F.round("precision_at_k", 6))


@query(CURVE + ", a AS (SELECT task, sum(pos / ap * precision) AS v FROM f GROUP BY task), b AS (SELECT task, avg(label) AS b FROM p WHERE task <> 'none' GROUP BY task) SELECT task, round(v, 6) AS average_precision, round(b, 6) AS baseline_average_precision, round(v - b, 6) AS delta FROM a LEFT JOIN b USING (task)")
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    base = predictions(spark, d).where("task <> 'none'").groupBy("task").agg(F.avg("label").alias("average_precision"))
    out = M.delta(_ranking(spark, d).select("task", "average_precision"), base, ["task"], "average_precision")
    return out.withColumns({c: F.round(c, 6) for c in ("average_precision", "baseline_average_precision", "delta")})


@query("WITH b AS (SELECT o_orderpriority AS mode, o_custkey AS checkpoint, max(o_totalprice) AS score FROM orders GROUP BY ALL) SELECT mode, checkpoint, score, row_number() OVER (PARTITION BY mode ORDER BY score DESC, checkpoint) AS rank FROM b QUALIFY rank <= 5")
def best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_custkey").alias("checkpoint"), F.col("o_totalprice").alias("score"))
    return M.best_checkpoints(rows, ["mode"], "checkpoint", "score", 5)


@query()
def stacking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tomato_positive_pairs_deduplicated").where("hippie_score IS NOT NULL AND NOT isnan(hippie_score) AND pmid_count IS NOT NULL AND evidence_count IS NOT NULL")
    features = rows.select("pair_id", "hippie_score", F.col("evidence_count").cast("double").alias("evidence"), F.length("detection_methods").cast("double").alias("breadth"), (F.col("pmid_count") >= 2).cast("int").alias("label")).na.fill(0.0)
    return M.stacked(features, ["hippie_score", "evidence", "breadth"], "label").select("pair_id", "stacked_score")


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
