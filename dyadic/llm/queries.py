"""Queries of the problems tagged llm, bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadic.llm import consolidate, cutting, merkle, packing, splits, tokens
from dyadic.session import Workspace, is_missing, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    matches = consolidate.alignment_matches(table(spark, d, "ara_prot_all_vs_all"))
    return consolidate.connected_groups(matches, "query", "target", "protein_id", "group_id").select("group_id", "protein_id")


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_members"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, merkle.Node, Column]:
    return merkle.pair_tree(table(spark, d, "tomato_positive_pairs_deduplicated"), "pair_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, tree, empty = _pairs(spark, d)
    found = merkle.copies(pairs, "pair_id", tree, empty)
    return found.where("pair_id <> first_key").select(F.col("first_key").alias("first_pair_id"), F.col("pair_id").alias("copy_pair_id"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each pair and its number of copies; a row without two ids is a record of its own."""
    pairs, tree, empty = _pairs(spark, d)
    groups = merkle.copy_groups(pairs, "pair_id", tree, empty).select(F.col("first_key").alias("pair_id"), "n_copies")
    return groups.unionByName(pairs.where(empty).select("pair_id", F.lit(1).cast("long").alias("n_copies")))


def _families(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "ara_positive_c4_test_id0_50_cov0_80").select("row_id", "participant_a_id", "participant_b_id", "cluster_id")
    shared = [F.when(~is_missing(c), F.concat(F.lit("p:"), c)) for c in ("participant_a_id", "participant_b_id")]
    return splits.families(records, "row_id", [*shared, F.when(F.col("cluster_id") >= 0, F.concat(F.lit("c:"), F.col("cluster_id")))])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d).where("row_id <> first_key").select(F.col("first_key").alias("first_row_id"), "row_id")


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    given = table(spark, d, "summary_positive_c1234_partitions").where("identity_theta = 0.5 and coverage_cmin = 0.8").first()
    return {"train": given["c1_train_pct"], "validation": given["c2_test_pct"], "test": given["c3_test_pct"] + given["c4_test_pct"]}


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    found = splits.split_by_weight(_families(spark, d), "row_id", _shares(spark, d))
    return found.select("row_id", F.col("first_key").alias("first_row_id"), "split")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each split its rows, their share and the given one, and its distinct proteins."""
    shares = _shares(spark, d)
    given = F.create_map(*(F.lit(x) for name, pct in shares.items() for x in (name, pct / sum(shares.values()))))
    records = table(spark, d, "ara_positive_c4_test_id0_50_cov0_80").select("row_id", *(F.when(~is_missing(c), F.col(c)).alias(c) for c in ("participant_a_id", "participant_b_id")))
    rows = records.join(p6_splits(spark, d), "row_id").withColumn("_all", F.lit(records.count()))
    sizes = rows.groupBy("split").agg(F.count("*").alias("n_rows"), (F.count("*") / F.first("_all")).alias("share"))
    proteins = rows.select("split", F.explode(F.array("participant_a_id", "participant_b_id")).alias("p")).groupBy("split").agg(F.count_distinct("p").alias("n_proteins"))
    return sizes.join(proteins, "split").withColumn("given_share", given[F.col("split")])


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What p6_splits must satisfy, checked over all its rows; a hash decides which family goes where, which SQL can't tell."""
    shares = _shares(spark, d)
    given = F.create_map(*(F.lit(x) for name, pct in shares.items() for x in (name, pct / sum(shares.values()))))
    records = table(spark, d, "ara_positive_c4_test_id0_50_cov0_80")
    rows = Workspace(spark, "checks").save(records.join(p6_splits(spark, d), "row_id", "full_outer"), "rows")
    families = rows.groupBy("first_row_id").agg(F.count_distinct("split").alias("n"), F.count("*").alias("size"))
    largest, n = families.agg(F.max("size"), F.sum("size")).first()  # two numbers
    ends = rows.select("split", F.explode(F.array(*(F.when(~is_missing(c), F.col(c)) for c in ("participant_a_id", "participant_b_id")))).alias("p")).where("p IS NOT NULL")
    off = F.abs(F.col("n") / n - given[F.col("split")])
    checks = {
        "every_row_once": rows.agg((F.count("split") == F.count_distinct("row_id")).alias("passed")),
        "families_whole": families.agg((F.max("n") <= 1).alias("passed")),
        "proteins_in_one_split": ends.groupBy("p").agg(F.count_distinct("split").alias("n")).agg((F.coalesce(F.max("n"), F.lit(1)) <= 1).alias("passed")),
        # no split misses its share by more than the largest family, or a hundredth
        "shares_kept": rows.groupBy("split").agg(F.count("*").alias("n")).agg((F.max(off) <= max(0.01, largest / n)).alias("passed")),
    }
    out = [df.select(F.lit(name).alias("check"), "passed") for name, df in checks.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """MD5 of the text that the ids of each document decode to: the document's own text must come back."""
    decoded = tokens.decode(p7_ids(spark, d), "doc_id", "ids")
    return decoded.select("doc_id", F.md5("text").alias("text_md5"))


def _budgets(spark: SparkSession, d: str, purpose: str) -> list[tuple[int, int, int]]:
    rows = table(spark, d, "token_budgets").where(F.col("purpose") == purpose).collect()  # a fixed table of 4 rows
    return sorted((r["budget_id"], r["max_tokens"], r["overlap_tokens"]) for r in rows)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", [(b, most) for b, most, _ in _budgets(spark, d, "pack")])


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: documents, containers over it, documents divided though they fit, and whether no more than a hundredth is unused."""
    rows = Workspace(spark, "checks").save(p8_containers(spark, d), "rows")
    budgets = table(spark, d, "token_budgets").select("budget_id", "max_tokens")
    full = rows.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("load")).join(F.broadcast(budgets), "budget_id")
    containers = full.groupBy("budget_id").agg(F.count_if(F.col("load") > F.col("max_tokens")).alias("n_overfull"), (F.count("*") <= 1 + 1.01 * F.ceil(F.sum("load") / F.first("max_tokens"))).alias("little_unused"))
    documents = rows.groupBy("budget_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size")).join(F.broadcast(budgets), "budget_id")
    counts = documents.groupBy("budget_id").agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("max_tokens"))).alias("n_divided_though_fitting"))
    return counts.join(containers, "budget_id").select("budget_id", "n_documents", "n_overfull", "n_divided_though_fitting", "little_unused")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.cut_texts(table(spark, d, "documents"), "doc_id", "text", _budgets(spark, d, "cut"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each limit: documents with pieces, pieces over it, and pieces that don't follow the one before with the given overlap."""
    budgets = table(spark, d, "token_budgets").select("budget_id", "max_tokens", F.col("overlap_tokens").alias("given"))
    rows = p9_pieces(spark, d).select("budget_id", "doc_id", "piece_no", "start_token", "end_token", "n_tokens", "overlap_tokens")
    before = F.lag("end_token").over(Window.partitionBy("budget_id", "doc_id").orderBy("piece_no"))  # the pieces of one document
    beside = rows.withColumn("before", before).join(F.broadcast(budgets), "budget_id")
    shared = F.col("before") - F.col("start_token")
    follows = F.when(F.col("piece_no") == 1, F.col("start_token") == 0).otherwise((shared == F.col("overlap_tokens")) & (shared >= F.col("given")) & (shared <= F.col("given") + 3))
    return beside.groupBy("budget_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("n_over_limit"), F.count_if(~F.coalesce(follows, F.lit(False))).alias("n_not_following"))


QUERIES = {q.__name__: q for q in (p1_found, p1_group_sizes, p4_found, p4_records, p6_found, p6_splits, p6_summary, p6_checks, p7_ids, p7_checks, p8_containers, p8_checks, p9_pieces, p9_checks)}

_GROUPS = """
WITH RECURSIVE clean AS (
  SELECT upper(trim(query)) AS a, upper(trim(target)) AS b, CASE WHEN fident > 1 THEN fident / 100 ELSE fident END AS f
  FROM ara_prot_all_vs_all WHERE fident IS NOT NULL AND NOT isnan(fident)),
e AS (SELECT DISTINCT a, b FROM clean WHERE f >= 0.5 AND a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
g(id, label) USING KEY (id) AS (
  SELECT a, min(least(a, b)) FROM s GROUP BY a
  UNION
  SELECT s.b, min(g.label) FROM g JOIN s ON s.a = g.id JOIN recurring.g AS r ON r.id = s.b WHERE g.label < r.label GROUP BY s.b)
"""
_PAIR = r"""
WITH norm AS (
  SELECT pair_id, canonical_pair_key AS k,
    upper(regexp_replace(participant_a_id, '[^A-Za-z0-9]', '', 'g')) AS a, upper(regexp_replace(participant_b_id, '[^A-Za-z0-9]', '', 'g')) AS b,
    coalesce(trim(participant_a_id) IN ('', '-', 'NA', 'nan'), true) OR coalesce(trim(participant_b_id) IN ('', '-', 'NA', 'nan'), true) AS lost
  FROM tomato_positive_pairs_deduplicated),
parts AS (SELECT *, string_split_regex(CASE WHEN k NOT IN ('', '-', 'NA', 'nan') THEN trim(k, ' .') END, '[|~;:,\s]+') AS p FROM norm),
pairs AS (
  SELECT pair_id, CASE WHEN lost THEN CASE WHEN len(p) = 2 THEN upper(regexp_replace(p[1], '[^A-Za-z0-9]', '', 'g')) END ELSE a END AS a,
    CASE WHEN lost THEN CASE WHEN len(p) = 2 THEN upper(regexp_replace(p[2], '[^A-Za-z0-9]', '', 'g')) END ELSE b END AS b FROM parts)
"""
_FAMILIES = """
WITH RECURSIVE v AS (
  SELECT row_id, 'p:' || participant_a_id AS x FROM ara_positive_c4_test_id0_50_cov0_80 WHERE trim(participant_a_id) NOT IN ('', '-', 'NA', 'nan')
  UNION SELECT row_id, 'p:' || participant_b_id FROM ara_positive_c4_test_id0_50_cov0_80 WHERE trim(participant_b_id) NOT IN ('', '-', 'NA', 'nan')
  UNION SELECT row_id, 'c:' || cluster_id FROM ara_positive_c4_test_id0_50_cov0_80 WHERE cluster_id >= 0),
s AS (SELECT DISTINCT 'r:' || row_id AS a, x AS b FROM v UNION SELECT DISTINCT x, 'r:' || row_id FROM v),
g(id, label) USING KEY (id) AS (
  SELECT a, min(CASE WHEN starts_with(a, 'r:') THEN substr(a, 3)::BIGINT ELSE substr(b, 3)::BIGINT END) FROM s GROUP BY a
  UNION
  SELECT s.b, min(g.label) FROM g JOIN s ON s.a = g.id JOIN recurring.g AS r ON r.id = s.b WHERE g.label < r.label GROUP BY s.b)
"""
SQL = {
    "p1_found": _GROUPS + "SELECT label AS group_id, id AS protein_id FROM g",
    "p1_group_sizes": _GROUPS + "SELECT label AS group_id, count(*) AS n_members FROM g GROUP BY label",
    "p4_found": _PAIR + "SELECT f AS first_pair_id, pair_id AS copy_pair_id FROM (SELECT pair_id, min(pair_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS f FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL) WHERE f <> pair_id",
    "p4_records": _PAIR + "SELECT min(pair_id) AS pair_id, count(*) AS n_copies FROM pairs GROUP BY CASE WHEN a IS NULL OR b IS NULL THEN pair_id END, least(a, b), greatest(a, b)",
    "p6_checks": """SELECT "check", true AS passed FROM (VALUES ('every_row_once'), ('families_whole'), ('proteins_in_one_split'), ('shares_kept')) AS t("check")""",
    "p7_checks": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p8_checks": "SELECT budget_id, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_divided_though_fitting, true AS little_unused FROM token_budgets WHERE purpose = 'pack'",
    "p9_checks": "SELECT budget_id, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_over_limit, 0::BIGINT AS n_not_following FROM token_budgets WHERE purpose = 'cut'",
    "p6_found": _FAMILIES + "SELECT label AS first_row_id, substr(id, 3)::BIGINT AS row_id FROM g WHERE starts_with(id, 'r:') AND substr(id, 3)::BIGINT <> label",
}
