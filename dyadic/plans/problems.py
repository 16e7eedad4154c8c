"""Queries of the general problems, bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.operators import packed, rejects, skew
from dyadic.session import table

PACKED_FIELDS = {"detection_methods": False, "pmids": True, "sources": False, "interaction_types": False}
HOT_SHARE = 0.025


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "tomato_positive_pairs_deduplicated"), "pair_id", PACKED_FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "tomato_positive_pairs_deduplicated"), "pair_id", PACKED_FIELDS, labels=False)


def _alignments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "ara_prot_all_vs_all")
    return rows, skew.compress(rows, skew.known("query"), skew.known("target"), skew.identity())


def _interactions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "tomato_positive_pairs_deduplicated")
    return rows, skew.compress(rows, skew.known("participant_a_id"), skew.known("participant_b_id"), F.col("hippie_score"))


_TABLES = {"ara_prot_all_vs_all": _alignments, "tomato_positive_pairs_deduplicated": _interactions}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name, weighted in _TABLES.items():
        rows, pairs = weighted(spark, d)
        hot = skew.hot_keys(skew.per_key(pairs), rows.count(), HOT_SHARE)
        found.append(hot.select(F.lit(name).alias("table_name"), F.col("key").alias("key_value")))
    return found[0].unionByName(found[1])


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    found = [skew.per_key(weighted(spark, d)[1]).where("key IS NOT NULL").withColumn("table_name", F.lit(name)) for name, weighted in _TABLES.items()]
    both = found[0].unionByName(found[1])
    return both.select("table_name", F.col("key").alias("key_value"), "n_rows", F.col("n_distinct").alias("n_partners"), F.col("mode").alias("most_frequent_partner"), "best")


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ara_prot_all_vs_all")
    weighted = skew.compress(rows.where(skew.known("query").isNotNull()), F.col("query"), skew.identity())
    return skew.quantiles(weighted, {"median_fident": 0.5, "p90_fident": 0.9}).withColumnRenamed("key", "query")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assay_mapping").select("source_term")


def _lines(spark: SparkSession, d: str, load: bool) -> DataFrame:
    return rejects.judge_lines(table(spark, d, "raw_evidence_lines"), ["line_id", "source_id", "source_file", "source_row", "layout"], "layout", "raw_line", _vocabulary(spark, d), load)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """All rows of combine_evidence with their reasons."""
    return rejects.judge_terms(table(spark, d, "combine_evidence"), "detection_method_raw", "interaction_type_raw", _vocabulary(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, load=False).where("reason IS NOT NULL").select(F.lit("raw_evidence_lines").alias("table_name"), F.col("line_id").alias("record_key"), "reason")
    evidence = _judged(spark, d).where("reason IS NOT NULL").select(F.lit("combine_evidence").alias("table_name"), F.col("evidence_id").alias("record_key"), "reason")
    return lines.unionByName(evidence.distinct())


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The good lines: their checked fields typed, and all of their 42 or 32 fields as texts."""
    return _lines(spark, d, load=True).where("reason IS NULL").drop("reason")


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The good rows of combine_evidence, each record once, with all columns; NA, which marks a column that carries nothing, is null, so that copies are equal."""
    rows = _judged(spark, d).where("reason IS NULL").drop("reason")
    filled = [F.when(F.col(f.name) != "NA", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema]
    return rows.select(*filled).distinct()


def p5_source_files(spark: SparkSession, d: str) -> DataFrame:
    """The true counts of each source file of phase2_progress; null where a file has no records here."""
    by = ["source_id", "source_file"]
    records = _lines(spark, d, load=False).select(*by, "reason").unionByName(_judged(spark, d).select("evidence_id", *by, "reason").distinct().drop("evidence_id"))
    counts = records.groupBy(*by).agg(F.count("*").alias("n_input"), F.count_if(F.col("reason").isNull()).alias("n_normalized"), F.count("reason").alias("n_rejected"))
    return table(spark, d, "phase2_progress").select(*by).join(counts, by, "left").withColumn("rejection_rate_pct", F.round(100 * F.col("n_rejected") / F.col("n_input"), 4))


QUERIES = {q.__name__: q for q in (p2_found, p2_values, p3_found, p3_keys, p3_quantiles, p5_found, p5_loaded, p5_evidence, p5_source_files)}

_KNOWN = "CASE WHEN trim({0}) NOT IN ('', '-', 'NA', 'nan') THEN {0} END"
_FIDENT = "CASE WHEN NOT isnan(fident) THEN CASE WHEN fident > 1 THEN fident / 100 ELSE fident END END"
_BOTH = f"""
SELECT 'ara_prot_all_vs_all' AS table_name, {_KNOWN.format("query")} AS k, {_KNOWN.format("target")} AS v, {_FIDENT} AS s FROM ara_prot_all_vs_all
UNION ALL SELECT 'tomato_positive_pairs_deduplicated', {_KNOWN.format("participant_a_id")}, {_KNOWN.format("participant_b_id")}, hippie_score FROM tomato_positive_pairs_deduplicated
"""
_METHODS = "(SELECT list(lower(source_term)) FROM assay_mapping)"
_TERMS = rf"""
WITH t AS (SELECT DISTINCT evidence_id, source_id, source_file, detection_method_raw AS m, interaction_type_raw AS i FROM combine_evidence),
r AS (SELECT *, CASE WHEN length(replace(coalesce(m, ''), '"', '')) % 2 <> length(coalesce(m, '')) % 2 OR length(replace(coalesce(i, ''), '"', '')) % 2 <> length(coalesce(i, '')) % 2 THEN 'broken_quoting'
  WHEN NOT (m IS NULL OR m IN ('', '-', 'NA') OR list_contains({_METHODS}, lower(m)) OR regexp_full_match(m, 'psi-mi:"MI:[0-9]{{4}}"\([^()]+\)'))
    OR NOT (i IS NULL OR i IN ('', '-', 'NA') OR lower(i) IN ('physical', 'genetic') OR regexp_full_match(i, 'psi-mi:"MI:[0-9]{{4}}"\([^()]+\)')) THEN 'invalid_value' END AS reason FROM t)
"""
def _term(c: str, words: str) -> str:
    return rf"""({c} IN ('', '-', 'NA') OR {words} OR regexp_full_match({c}, 'psi-mi:"MI:[0-9]{{4}}"\([^()]+\)'))"""


_N = r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_DATE = r"(f[{0}] = '-' OR (regexp_full_match(f[{0}], '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') AND try_strptime(f[{0}], '%Y/%m/%d') IS NOT NULL))"
_JUDGED = rf"""
, l AS (SELECT line_id, source_id, source_file, layout, regexp_replace(coalesce(raw_line, ''), '[\r\n]+$', '') AS x FROM raw_evidence_lines),
k AS (SELECT *, CASE WHEN layout = 'mitab27' THEN string_split(x, chr(9)) ELSE list_transform(regexp_extract_all(',' || x, ',("(?:[^"]|"")*"[^,]*|[^,]*)', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(regexp_extract(f, '^"((?:[^"]|"")*)"', 1), '""', '"') ELSE f END) END AS f
  FROM l WHERE regexp_replace(x, '\s+', '', 'g') <> '' AND NOT starts_with(x, '#')),
j AS (SELECT line_id, source_id, source_file, CASE WHEN (length(x) - length(replace(x, '"', ''))) % 2 = 1 THEN 'broken_quoting'
  WHEN len(f) <> CASE layout WHEN 'mitab27' THEN 42 ELSE 32 END THEN 'column_count'
  WHEN layout = 'mitab27' THEN CASE WHEN f[1] IN ('', '-') AND f[2] IN ('', '-') THEN 'missing_participants'
    WHEN NOT ({_term("f[7]", f"list_contains({_METHODS}, lower(f[7]))")} AND {_term("f[12]", "lower(f[12]) IN ('physical', 'genetic')")} AND regexp_full_match(f[10], '-|taxid:[0-9]+(\([^()]+\))?') AND regexp_full_match(f[11], '-|taxid:[0-9]+(\([^()]+\))?')
      AND (f[15] = '-' OR (regexp_full_match(f[15], 'intact-miscore:{_N}') AND coalesce(try_cast(substr(f[15], 16) AS DOUBLE) <= 1, false))) AND {_DATE.format(31)} AND {_DATE.format(32)} AND f[36] IN ('-', 'true', 'false')) THEN 'invalid_value' END
  WHEN f[30] = '' AND f[31] = '' THEN 'missing_participants'
  WHEN NOT (regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[10], '[+-]?{_N}') AND coalesce(try_cast(f[10] AS DOUBLE) >= 0, false) AND regexp_full_match(f[11], '[+-]?{_N}') AND f[15] IN ('Inter-Protein', 'Intra-Protein')) THEN 'invalid_value' END AS reason FROM k)
"""
#: Values of well-formed fields; RE2 has no look-ahead, so it takes every quote that opens a value for one that closes, too.
_V = r"[\pL\pM\pN\-.:''()\[\]{}]"
_UNIT = rf"""{_V}+(?:(?:/|"MI:[0-9]+"(?:\([^()]*\))?){_V}*)*"""
_QUOTES = """"(?:[^"]|"")*"|''(?:[^'']|'''')*''|"""
_PLAIN = """CASE WHEN starts_with(m, '"') THEN replace(substr(m, 2, length(m) - 2), '""', '"') WHEN starts_with(m, '''') THEN replace(substr(m, 2, length(m) - 2), '''''', '''') ELSE m END"""
_MATCHES = " UNION ALL ".join(f"SELECT pair_id, '{c}' AS field_name, regexp_extract_all({c}, '{_QUOTES}{_UNIT}{'' if blanks else f'(?: +{_UNIT})*'}') AS found FROM tomato_positive_pairs_deduplicated" for c, blanks in PACKED_FIELDS.items())
_VALUES = "SELECT pair_id, field_name, list_filter(list_transform(found, lambda m: {'m': m, 'v': trim(" + _PLAIN + ")}), lambda x: x.v NOT IN ('', '-', 'NA', 'nan')) AS v FROM (" + _MATCHES + ")"
_NUMBERED = f"(SELECT pair_id, field_name, i, v[i].v AS value, v[i].m AS m FROM (SELECT pair_id, field_name, v, unnest(range(1, len(v) + 1)) AS i FROM ({_VALUES})))"
_CLOSED = r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}"
_LOOSE = f"regexp_replace(regexp_replace(m, '{_CLOSED}', '', 'g'), '{_CLOSED}', '', 'g')"
_ENCLOSED = "(starts_with(m, chr(34)) OR regexp_full_match(m, chr(39) || '(?:[^' || chr(39) || ']|' || chr(39) || chr(39) || ')*' || chr(39)))"
#: The columns of combine_evidence that aren't text.
_PLAIN_COLUMNS = ("source_row_number", "participant_a_taxid", "participant_b_taxid", "publication_year", "string_combined_score", "string_experimental_score", "string_database_score", "string_textmining_score", "intact_miscore", "retrieval_date")
SQL = {
    "p2_found": f"SELECT pair_id, field_name, i::INT AS value_no, value AS field_value FROM {_NUMBERED}",
    "p2_values": rf"""SELECT pair_id, field_name, i::INT AS value_no, value AS field_value, CASE WHEN {_ENCLOSED} THEN 'quoted' WHEN regexp_matches(m, '{_CLOSED}') THEN 'bracketed' ELSE 'bare' END AS alternative,
CASE WHEN starts_with(m, chr(39)) AND NOT {_ENCLOSED} THEN 'unclosed_quote' WHEN {_ENCLOSED} THEN NULL WHEN regexp_matches({_LOOSE}, '[(\[{{]') THEN 'unclosed_bracket' WHEN regexp_matches({_LOOSE}, '[)\]}}]') THEN 'unopened_bracket' END AS error FROM {_NUMBERED}""",
    "p3_found": f"SELECT table_name, k AS key_value FROM (SELECT table_name, k, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_name) AS total FROM ({_BOTH}) GROUP BY table_name, k) WHERE k IS NOT NULL AND n >= 0.025 * total",
    "p3_keys": f"""WITH w AS (SELECT table_name, k, v, count(*) AS w, max(s) AS s FROM ({_BOTH}) WHERE k IS NOT NULL GROUP BY ALL)
SELECT table_name, k AS key_value, sum(w)::BIGINT AS n_rows, count(v) AS n_partners, max(s) AS best, arg_min(v, (-w, v)) FILTER (v IS NOT NULL) AS most_frequent_partner FROM w GROUP BY table_name, k""",
    "p3_quantiles": f"SELECT query, quantile_disc({_FIDENT}, 0.5) AS median_fident, quantile_disc({_FIDENT}, 0.9) AS p90_fident FROM ara_prot_all_vs_all WHERE trim(query) NOT IN ('', '-', 'NA', 'nan') GROUP BY query HAVING count({_FIDENT}) > 0",
    "p5_found": _TERMS + _JUDGED + "SELECT 'raw_evidence_lines' AS table_name, line_id AS record_key, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT 'combine_evidence', evidence_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_loaded": _TERMS
    + _JUDGED
    + r""", g AS (SELECT k.*, source_row FROM k JOIN (SELECT line_id FROM j WHERE reason IS NULL) USING (line_id) JOIN (SELECT line_id, source_row FROM raw_evidence_lines) USING (line_id))
SELECT line_id, source_id, source_file, source_row, layout, CASE WHEN layout = 'mitab27' THEN f[1] ELSE f[30] END AS participant_a, CASE WHEN layout = 'mitab27' THEN f[2] ELSE f[31] END AS participant_b,
CASE WHEN layout = 'mitab27' THEN f[7] END AS detection_method, CASE WHEN layout = 'mitab27' THEN f[12] END AS interaction_type,
CASE WHEN layout = 'mitab27' THEN nullif(regexp_extract(f[10], '^taxid:([0-9]+)', 1), '') END AS taxon_a, CASE WHEN layout = 'mitab27' THEN nullif(regexp_extract(f[11], '^taxid:([0-9]+)', 1), '') END AS taxon_b,
CASE WHEN layout = 'mitab27' THEN try_cast(replace(f[15], 'intact-miscore:', '') AS DOUBLE) ELSE try_cast(f[11] AS DOUBLE) END AS score,
CASE WHEN layout = 'mitab27' THEN try_strptime(f[31], '%Y/%m/%d')::DATE END AS recorded_on, CASE WHEN layout = 'mitab27' THEN try_strptime(f[32], '%Y/%m/%d')::DATE END AS updated_on, CASE WHEN layout = 'mitab27' AND f[36] <> '-' THEN f[36] = 'true' END AS is_negative,
CASE WHEN layout <> 'mitab27' THEN f[1] END AS spectrum_no, CASE WHEN layout <> 'mitab27' THEN try_cast(f[10] AS DOUBLE) END AS e_value, CASE WHEN layout <> 'mitab27' THEN f[15] = 'Inter-Protein' END AS is_inter_protein, f AS fields FROM g""",
    "p5_evidence": _TERMS
    + f"SELECT DISTINCT {', '.join(_PLAIN_COLUMNS)}, nullif(COLUMNS(* EXCLUDE ({', '.join(_PLAIN_COLUMNS)})), 'NA') FROM combine_evidence SEMI JOIN (SELECT evidence_id FROM r WHERE reason IS NULL) USING (evidence_id)",
    "p5_source_files": _TERMS
    + _JUDGED
    + """, c AS (SELECT source_id, source_file, count(*) AS n_input, count(*) FILTER (reason IS NULL) AS n_normalized, count(reason) AS n_rejected FROM (SELECT source_id, source_file, reason FROM j UNION ALL SELECT source_id, source_file, reason FROM r) GROUP BY ALL)
SELECT p.source_id, p.source_file, c.n_input, c.n_normalized, c.n_rejected, round(100 * c.n_rejected / c.n_input, 4) AS rejection_rate_pct FROM phase2_progress AS p LEFT JOIN c USING (source_id, source_file)""",
}
