"""Queries over evidence records and pair tables: projection, filters, lookups, aggregates, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions import numeric as N
from dyadic.functions import text as X
from dyadic.operators import gates as G
from dyadic.operators import ordering as O
from dyadic.operators import pairs as P
from dyadic.operators import pooling
from dyadic.operators import resolve as R
from dyadic.operators import skew
from dyadic.plans.catalogue import Catalogue
from dyadic.session import Workspace, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

PLANTS = (3702, 3847, 4081, 4577, 39947, 4530)
HOLDOUT = (4577, 4081, 3847)
MISS = "('', '-', 'NA', 'nan', 'None')"
TECHNIQUES = """
WITH techniques AS (SELECT lower(source_term) AS raw_name, normalized_assay_family AS technique,
  CASE WHEN supports_direct_binding THEN 5.0 WHEN supports_physical_association THEN 2.5 ELSE 1.0 END AS weight
  FROM assay_mapping WHERE normalized_assay_family IS NOT NULL),
"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combine_evidence")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tomato_positive_pairs_deduplicated")


CONSOLIDATED = f"""
SELECT least(participant_a_id_value, participant_b_id_value) AS participant_a_id, greatest(participant_a_id_value, participant_b_id_value) AS participant_b_id,
  count(*) AS evidence_count,
  coalesce(string_agg(DISTINCT source_resource, '|' ORDER BY source_resource) FILTER (source_resource NOT IN {MISS}), '') AS sources,
  coalesce(string_agg(DISTINCT interaction_type_raw, '|' ORDER BY interaction_type_raw) FILTER (interaction_type_raw NOT IN {MISS}), 'physical') AS interaction_types,
  coalesce(string_agg(DISTINCT detection_method_raw, '|' ORDER BY detection_method_raw) FILTER (detection_method_raw NOT IN {MISS}), 'unspecified') AS detection_methods,
  count(DISTINCT pmid) FILTER (pmid NOT IN {MISS}) AS pmid_count,
  coalesce(string_agg(DISTINCT pmid, '|' ORDER BY pmid) FILTER (pmid NOT IN {MISS}), '') AS pmids,
  coalesce(string_agg(DISTINCT publication_year::VARCHAR, '|' ORDER BY publication_year::VARCHAR) FILTER (publication_year IS NOT NULL), '') AS publication_years,
  coalesce(array_to_string((list_sort(list(DISTINCT source_record_id) FILTER (source_record_id NOT IN {MISS})))[1:10], '|'), '') AS source_record_ids,
  max(intact_miscore) FILTER (NOT isnan(intact_miscore)) AS max_score,
  least(participant_a_id_value, participant_b_id_value) || '|' || greatest(participant_a_id_value, participant_b_id_value) AS pair_key,
  CASE WHEN participant_a_id_value = participant_b_id_value THEN 'homomer' ELSE 'heteromer' END AS pair_type
FROM combine_evidence WHERE participant_a_id_value IS NOT NULL AND participant_b_id_value IS NOT NULL GROUP BY ALL
"""


@query(CONSOLIDATED)
def pair_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return P.consolidate(evidence(spark, d), "participant_a_id_value", "participant_b_id_value", "source_resource", "interaction_type_raw", "detection_method_raw", "pmid", "publication_year", "source_record_id", "intact_miscore")


@query(
    f"""SELECT a AS participant_a_id, b AS participant_b_id, CASE WHEN f.x NOT IN {MISS} THEN f.x END AS participant_a_name, CASE WHEN f.y NOT IN {MISS} THEN f.y END AS participant_b_name
FROM (SELECT least(participant_a_id_value, participant_b_id_value) AS a, greatest(participant_a_id_value, participant_b_id_value) AS b,
  arg_min(CASE WHEN participant_a_id_value <= participant_b_id_value THEN {{'x': participant_a_original_name, 'y': participant_b_original_name}} ELSE {{'x': participant_b_original_name, 'y': participant_a_original_name}} END, (source_id, source_file, source_row_number, evidence_id)) AS f
FROM combine_evidence WHERE participant_a_id_value IS NOT NULL AND participant_b_id_value IS NOT NULL GROUP BY ALL)"""
)
def pair_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of each pair of pair_consolidate; combine_evidence has no authors."""
    return P.names(evidence(spark, d), "participant_a_id_value", "participant_b_id_value", "participant_a_original_name", "participant_b_original_name", ["source_id", "source_file", "source_row_number", "evidence_id"])


SCORED = (
    TECHNIQUES
    + f"""c AS ({CONSOLIDATED}),
m AS (SELECT pair_key, unnest(string_split(detection_methods, '|')) AS m FROM c),
k AS (SELECT DISTINCT pair_key, technique, weight FROM m LEFT JOIN techniques ON raw_name = lower(trim(CASE WHEN contains(m, '(') THEN regexp_extract(m, '\\(([^()]+)\\)\\s*$', 1) ELSE m END))),
t AS (SELECT pair_key, coalesce(sum(weight), 1.0) AS technique_total FROM k GROUP BY pair_key),
s AS (SELECT c.*, technique_total, 0.6 * (2 / (1 + exp(-2.3 * greatest(pmid_count, 1))) - 1) + 0.3 * CASE WHEN technique_total > 0 THEN 2 / (1 + exp(-0.2 * technique_total)) - 1 ELSE 0 END AS score FROM c JOIN t USING (pair_key)),
scored AS (SELECT *, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.62 THEN 'medium' ELSE 'low' END AS tier FROM s)
"""
)


def _techniques(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("supports_direct_binding"), 5.0).when(F.col("supports_physical_association"), 2.5).otherwise(1.0)
    return table(spark, d, "assay_mapping").where("normalized_assay_family IS NOT NULL").select(F.lower("source_term").alias("raw_name"), F.col("normalized_assay_family").alias("technique"), weight.alias("weight"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    # written, since the pairs meet what is derived from them
    merged = Workspace(spark, "consolidated").save(pair_consolidate(spark, d), "pairs")
    names = F.transform(F.split("detection_methods", r"\|"), lambda m: F.coalesce(F.when(m.contains("("), X.mi_name(m)), m))
    totals = P.technique_totals(merged, "pair_key", names, _techniques(spark, d))
    return P.scored(merged.join(totals, "pair_key"), F.col("pmid_count"), F.col("technique_total"))


@query(SCORED + "SELECT pair_key, evidence_count, pmid_count, technique_total, round(score, 6) AS score, tier FROM scored")
def pair_score_tier(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("pair_key", "evidence_count", "pmid_count", "technique_total", F.round("score", 6).alias("score"), "tier")


@query(
    SCORED
    + """, r AS (SELECT tier, participant_a_id AS a, participant_b_id AS b FROM scored UNION ALL SELECT 'high+medium', participant_a_id, participant_b_id FROM scored WHERE tier IN ('high', 'medium')),
e AS (SELECT tier, a AS p FROM r UNION SELECT tier, b FROM r)
SELECT tier, count(*) AS n_pairs, count(*) FILTER (a <> b) AS n_hetero, count(*) FILTER (a = b) AS n_homo, (SELECT count(*) FROM e WHERE e.tier = r.tier) AS n_proteins, round(100.0 * count(*) FILTER (a <> b) / count(*), 4) AS pct_hetero FROM r GROUP BY tier"""
)
def tier_topology(spark: SparkSession, d: str) -> DataFrame:
    return P.tier_topology(_scored(spark, d), "participant_a_id", "participant_b_id", "tier")


@query(SCORED + "SELECT participant_a_id, participant_b_id, tier FROM scored WHERE tier IN ('high', 'medium') AND participant_a_id <> participant_b_id")
def tier_exports(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("tier IN ('high', 'medium') AND participant_a_id <> participant_b_id").select("participant_a_id", "participant_b_id", "tier")


@query("SELECT sources, count(*) AS n_pairs FROM (" + CONSOLIDATED + ") GROUP BY sources")
def source_combo(spark: SparkSession, d: str) -> DataFrame:
    return pair_consolidate(spark, d).groupBy("sources").agg(F.count("*").alias("n_pairs"))


@query("SELECT n_sources, count(*) AS n_keys FROM (SELECT unordered_pair_key_provisional AS k, count(DISTINCT source_resource) AS n_sources FROM combine_evidence GROUP BY k) GROUP BY n_sources")
def support_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.support_histogram(evidence(spark, d), ["unordered_pair_key_provisional"], "source_resource")


@query(
    r"""
WITH r AS (SELECT CASE
  WHEN eligible_for_training = 'FALSE' AND is_external_holdout = 'TRUE' THEN 'holdout'
  WHEN NOT coalesce(regexp_matches(interaction_type_raw, 'physical|association|direct'), false) THEN 'not_core'
  WHEN coalesce(regexp_matches(interaction_type_raw, 'proximity|colocalization'), false) THEN 'proximity_type'
  WHEN coalesce(regexp_matches(detection_method_raw, 'confocal|proximity'), false) THEN 'proximity_method'
  WHEN NOT coalesce(participant_a_taxid = participant_b_taxid, false) THEN 'other_species'
  WHEN participant_a_id_value = participant_b_id_value THEN 'self' END AS reason FROM combine_evidence)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def filter_waterfall(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    rules = {
        "holdout": F.expr("eligible_for_training = 'FALSE' AND is_external_holdout = 'TRUE'"),
        "not_core": ~has("interaction_type_raw", "physical|association|direct"),
        "proximity_type": has("interaction_type_raw", "proximity|colocalization"),
        "proximity_method": has("detection_method_raw", "confocal|proximity"),
        "other_species": ~F.coalesce(F.col("participant_a_taxid") == F.col("participant_b_taxid"), F.lit(False)),
        "self": F.col("participant_a_id_value") == F.col("participant_b_id_value"),
    }
    return P.reason_counts(P.waterfall(evidence(spark, d), rules))


@query(
    r"""SELECT evidence_id, least(participant_a_id_value, participant_b_id_value) || '|' || greatest(participant_a_id_value, participant_b_id_value) AS pair_key FROM combine_evidence
WHERE source_resource = 'BioGRID' AND interaction_semantics = 'physical' AND NOT coalesce(regexp_matches(detection_method_raw, 'confocal|proximity'), false) AND participant_a_taxid = participant_b_taxid"""
)
def biogrid_physical(spark: SparkSession, d: str) -> DataFrame:
    keep = "source_resource = 'BioGRID' AND interaction_semantics = 'physical' AND NOT coalesce(detection_method_raw RLIKE 'confocal|proximity', false) AND participant_a_taxid = participant_b_taxid"
    return evidence(spark, d).where(keep).select("evidence_id", P.canonical_key("participant_a_id_value", "participant_b_id_value").alias("pair_key"))


@query("SELECT evidence_id, string_experimental_score, string_database_score FROM combine_evidence WHERE source_resource = 'STRING' AND (string_experimental_score > 0 OR string_database_score > 0)")
def string_channels(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).where("source_resource = 'STRING' AND (string_experimental_score > 0 OR string_database_score > 0)").select("evidence_id", "string_experimental_score", "string_database_score")


@query(
    f"""SELECT source_resource, count(*) AS n_input, count(*) FILTER (NOT bad) AS n_normalized, count(*) FILTER (bad) AS n_rejected, round(100.0 * count(*) FILTER (bad) / count(*), 4) AS rejection_rate_pct, true AS conserved
FROM (SELECT source_resource, (detection_method_raw IS NULL OR detection_method_raw IN {MISS}) AND (interaction_type_raw IS NULL OR interaction_type_raw IN {MISS}) AS bad FROM combine_evidence) GROUP BY source_resource"""
)
def record_conservation(spark: SparkSession, d: str) -> DataFrame:
    return G.conservation(evidence(spark, d), ["source_resource"], G.missing("detection_method_raw") & G.missing("interaction_type_raw"))


@query(
    """SELECT 'taxid' AS counter, t::VARCHAR AS item, count(*) AS n FROM (SELECT unnest([participant_a_taxid, participant_b_taxid]) AS t FROM combine_evidence) WHERE t IS NOT NULL GROUP BY t
UNION ALL SELECT 'assay', assay_family, count(*) FROM combine_evidence WHERE assay_family IS NOT NULL GROUP BY assay_family
UNION ALL SELECT 'semantics', interaction_semantics, count(*) FROM combine_evidence WHERE interaction_semantics IS NOT NULL GROUP BY interaction_semantics
UNION ALL SELECT 'eligible', eligible_for_training, count(*) FROM combine_evidence WHERE eligible_for_training IS NOT NULL GROUP BY eligible_for_training"""
)
def counters(spark: SparkSession, d: str) -> DataFrame:
    named = {"taxid": "participant_a_taxid", "taxid ": "participant_b_taxid", "assay": "assay_family", "semantics": "interaction_semantics", "eligible": "eligible_for_training"}
    items = F.array(*(F.struct(F.lit(k.strip()).alias("counter"), F.col(c).cast("string").alias("item")) for k, c in named.items()))
    return evidence(spark, d).select(F.inline(items)).where("item IS NOT NULL").groupBy("counter", "item").agg(F.count("*").alias("n"))


@query(
    """SELECT evidence_id, coalesce(participant_a_taxid = participant_b_taxid, false) AS same_species, coalesce(participant_a_taxid IN (3702, 3847, 4081, 4577, 39947, 4530), false) AND coalesce(participant_b_taxid IN (3702, 3847, 4081, 4577, 39947, 4530), false) AS both_plants,
coalesce(participant_a_taxid IN (3702, 3847, 4081, 4577, 39947, 4530), false) <> coalesce(participant_b_taxid IN (3702, 3847, 4081, 4577, 39947, 4530), false) AS one_plant,
coalesce(participant_a_taxid IN (4577, 4081, 3847) OR participant_b_taxid IN (4577, 4081, 3847), false) AS holdout FROM combine_evidence"""
)
def taxon_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = P.taxon_flags(F.col("participant_a_taxid"), F.col("participant_b_taxid"), PLANTS, HOLDOUT)
    return evidence(spark, d).select("evidence_id", *(c.alias(k) for k, c in flags.items()))


@query("SELECT evidence_id, sha256(coalesce(unordered_pair_key_provisional, 'NA') || '|' || coalesce(pmid, 'NA') || '|' || coalesce(assay_family, 'NA') || '|' || coalesce(source_id, 'NA')) AS fingerprint FROM combine_evidence")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("evidence_id", P.fingerprint(*map(F.col, ("unordered_pair_key_provisional", "pmid", "assay_family", "source_id"))).alias("fingerprint"))


@query(
    r"""SELECT evidence_id, nullif(regexp_extract(detection_method_raw, '(MI:\d{4})', 1), '') AS mi, nullif(regexp_extract(detection_method_raw, '\(([^()]+)\)\s*$', 1), '') AS mi_name, nullif(regexp_extract(publication_id_raw, 'pubmed:(\d+)', 1), '') AS pubmed,
lpad(source_row_number::VARCHAR, 8, '0') AS row_text, json_extract_string(raw_fields_json, '$.pub') AS raw_pub FROM combine_evidence"""
)
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("detection_method_raw")
    return evidence(spark, d).select("evidence_id", X.mi_accession(m).alias("mi"), X.mi_name(m).alias("mi_name"), X.extract(F.col("publication_id_raw"), r"pubmed:(\d+)").alias("pubmed"), F.format_string("%08d", "source_row_number").alias("row_text"), F.get_json_object("raw_fields_json", "$.pub").alias("raw_pub"))


_NS = f"CASE WHEN participant_a_original_id IS NOT NULL AND trim(participant_a_original_id) NOT IN {MISS} THEN {{}} END"


@query(f"SELECT evidence_id, {_NS.format(chr(10) + 'CASE WHEN contains(participant_a_original_id, chr(58)) THEN split_part(trim(participant_a_original_id), chr(58), 1) ELSE ' + chr(39) + 'unresolved' + chr(39) + ' END')} AS namespace, {_NS.format('CASE WHEN contains(participant_a_original_id, chr(58)) THEN substr(trim(participant_a_original_id), instr(trim(participant_a_original_id), chr(58)) + 1) ELSE trim(participant_a_original_id) END')} AS value FROM combine_evidence")
def namespace_split(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("evidence_id", X.namespace(F.col("participant_a_original_id")).alias("n")).select("evidence_id", F.col("n.namespace").alias("namespace"), F.col("n.value").alias("value"))


@query(f"SELECT evidence_id, coalesce(CASE WHEN participant_a_id_value NOT IN {MISS} THEN participant_a_id_value END, CASE WHEN participant_a_original_name NOT IN {MISS} THEN participant_a_original_name END, CASE WHEN participant_a_original_id NOT IN {MISS} THEN participant_a_original_id END) AS chosen FROM combine_evidence")
def id_precedence(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("evidence_id", X.first_of(*map(F.col, ("participant_a_id_value", "participant_a_original_name", "participant_a_original_id"))).alias("chosen"))


@query(
    r"""SELECT evidence_id, CASE WHEN contains(lower(throughput_raw), 'high') THEN 'high' WHEN contains(lower(throughput_raw), 'low') THEN 'low' ELSE 'unknown' END AS throughput,
'EV_' || upper(source_resource) || '_' || CASE WHEN length(source_row_number::VARCHAR) > 8 THEN source_row_number::VARCHAR ELSE lpad(source_row_number::VARCHAR, 8, '0') END AS surrogate FROM combine_evidence"""
)
def classify_rows(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("evidence_id", X.throughput_class(F.coalesce("throughput_raw", F.lit(""))).alias("throughput"), X.surrogate_key(F.concat(F.lit("EV_"), F.upper("source_resource")), F.col("source_row_number")).alias("surrogate"))


@query("SELECT pair_id, regexp_replace(regexp_replace(sources, '^\\s+', ''), '\\s+$', '') AS sources, printf('%.4f', hippie_score) AS score_text, replace(pair_id, '_', '@') AS export_id FROM tomato_positive_pairs_deduplicated")
def trim_ws(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("pair_id", X.strip_ws(F.col("sources")).alias("sources"), N.fixed4(F.col("hippie_score")).alias("score_text"), F.replace("pair_id", F.lit("_"), F.lit("@")).alias("export_id"))


_SAN = lambda c, quote="": f"coalesce(nullif(regexp_replace({c}::VARCHAR, '[\\t\\r\\n]', ' ', 'g'), ''), 'NA') AS {c}"
_SAN_COLUMNS = ("pair_id", "canonical_pair_key", "participant_a_id", "sources", "pmids", "evidence_count")


@query(f"SELECT {', '.join(_SAN(c) for c in _SAN_COLUMNS)} FROM tomato_positive_pairs_deduplicated")
def sanitize_export(spark: SparkSession, d: str) -> DataFrame:
    return X.sanitised(pairs(spark, d).select(*_SAN_COLUMNS))


@query("""SELECT event_id, '{"user_id":"' || user_id || '","event_type":"' || event_type || '"}' AS packed FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL""")
def json_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    return rows.select("event_id", X.json_row({"user_id": F.col("user_id"), "event_type": F.col("event_type")}).alias("packed"))


@query(
    """WITH v AS (SELECT lower(source_term) AS k, psi_mi_accession AS a, normalized_assay_family AS f FROM assay_mapping),
e AS (SELECT evidence_id, nullif(regexp_extract(detection_method_raw, '(MI:\\d{4})', 1), '') AS mi, lower(coalesce(nullif(regexp_extract(detection_method_raw, '\\(([^()]+)\\)\\s*$', 1), ''), detection_method_raw)) AS term FROM combine_evidence)
SELECT evidence_id, CASE WHEN v1.a IS NOT NULL THEN v1.f WHEN v2.k IS NOT NULL THEN v2.f ELSE 'unknown' END AS family, CASE WHEN v1.a IS NOT NULL THEN 1 WHEN v2.k IS NOT NULL THEN 2 END AS matched_by, v1.a IS NULL AND v2.k IS NULL AS needs_review
FROM e LEFT JOIN v AS v1 ON e.mi = v1.a LEFT JOIN v AS v2 ON e.term = v2.k"""
)
def vocab_fallback(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = table(spark, d, "assay_mapping").select(F.col("psi_mi_accession").alias("k"), F.col("normalized_assay_family").alias("family")).unionByName(table(spark, d, "assay_mapping").select(F.lower("source_term").alias("k"), F.col("normalized_assay_family").alias("family")))
    m = F.col("detection_method_raw")
    found = R.cascade(evidence(spark, d).select("evidence_id", "detection_method_raw"), [X.mi_accession(m), F.lower(F.coalesce(X.mi_name(m), m))], vocabulary, "k", ["family"], {"family": F.lit("unknown")})
    return found.select("evidence_id", "family", "matched_by", F.col("matched_by").isNull().alias("needs_review"))


@query("SELECT DISTINCT lower(detection_method_raw) AS term FROM combine_evidence WHERE detection_method_raw IS NOT NULL AND lower(detection_method_raw) NOT IN (SELECT lower(source_term) FROM assay_mapping)")
def vocab_misses(spark: SparkSession, d: str) -> DataFrame:
    return R.misses(evidence(spark, d), F.lower("detection_method_raw"), table(spark, d, "assay_mapping").select(F.lower("source_term").alias("k")), "k")


_DICT = "SELECT upper(query) AS id, max(qlen) AS len FROM ara_prot_all_vs_all GROUP BY 1"


@query(
    f"""WITH t AS ({_DICT}), e AS (SELECT DISTINCT target AS raw FROM ara_prot_all_vs_all)
SELECT raw, coalesce(a.len, b.len, c.len, 0) AS len, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 WHEN c.id IS NOT NULL THEN 3 END AS matched_by
FROM e LEFT JOIN t AS a ON a.id = raw LEFT JOIN t AS b ON b.id = upper(trim(raw)) LEFT JOIN t AS c ON c.id = regexp_replace(upper(trim(raw)), '-\\d+$', '')"""
)
def id_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ara_prot_all_vs_all")
    lengths = rows.groupBy(F.upper("query").alias("id")).agg(F.max("qlen").alias("len"))
    raw, clean = F.col("raw"), F.upper(F.trim("raw"))
    return R.cascade(rows.select(F.col("target").alias("raw")).distinct(), [raw, clean, X.isoform_base(clean)], lengths, "id", ["len"], {"len": F.lit(0)})


@query("SELECT p_brand, p_type, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) = 1")
def id_canonical(spark: SparkSession, d: str) -> DataFrame:
    return R.best_of(table(spark, d, "part"), ["p_brand", "p_type"], [F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey", "p_size")


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS longest FROM orders GROUP BY o_custkey")
def longest_per_alias(spark: SparkSession, d: str) -> DataFrame:
    return R.longest(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice"), "o_orderkey", "longest")


@query(
    """WITH k AS (SELECT DISTINCT participant_a_id_value AS id FROM combine_evidence WHERE source_resource = 'IntAct'), e AS (SELECT participant_a_id_value AS a, participant_b_id_value AS b FROM combine_evidence),
n AS (SELECT (a IN (SELECT id FROM k WHERE id IS NOT NULL))::INT AS x, (b IN (SELECT id FROM k WHERE id IS NOT NULL))::INT AS y FROM e)
SELECT 'pairs' AS metric, count(*) AS value FROM e UNION ALL SELECT CASE coalesce(x, 0) + coalesce(y, 0) WHEN 0 THEN 'no_end' WHEN 1 THEN 'one_end' ELSE 'both_ends' END, count(*) FROM n GROUP BY 1
UNION ALL SELECT 'missing_ids', count(*) FROM (SELECT a FROM e UNION SELECT b FROM e) AS u(i) WHERE i IS NOT NULL AND i NOT IN (SELECT id FROM k WHERE id IS NOT NULL)"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence(spark, d)
    return R.coverage(rows, "participant_a_id_value", "participant_b_id_value", rows.where("source_resource = 'IntAct'"), "participant_a_id_value")


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey DESC) AS i FROM region) USING (i)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    return O.zipped(table(spark, d, "nation"), table(spark, d, "region"), [F.col("n_nationkey")], [F.col("r_regionkey").desc()]).select("n_name", "r_name")


@query("SELECT r.pair_id, coalesce(m.evidence_count, 1) AS evidence_count, coalesce(m.score, 0.72) AS score FROM tomato_positive_pairs_deduplicated AS r LEFT JOIN (SELECT pair_id, evidence_count, hippie_score AS score FROM tomato_positive_pairs_deduplicated WHERE hippie_confidence_level = 'high') AS m USING (pair_id)")
def metadata_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d)
    known = rows.where("hippie_confidence_level = 'high'").select("pair_id", "evidence_count", F.col("hippie_score").alias("score"))
    return rows.select("pair_id").join(known, "pair_id", "left").select("pair_id", F.coalesce("evidence_count", F.lit(1)).alias("evidence_count"), F.coalesce("score", F.lit(0.72)).alias("score"))


@query("SELECT node, count(*) AS degree FROM (SELECT participant_a_id AS node FROM ara_positive_c4_test_id0_50_cov0_80 UNION ALL SELECT participant_b_id FROM ara_positive_c4_test_id0_50_cov0_80 WHERE participant_b_id IS DISTINCT FROM participant_a_id) WHERE node IS NOT NULL GROUP BY node")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return P.endpoint_degree(table(spark, d, "ara_positive_c4_test_id0_50_cov0_80"), "participant_a_id", "participant_b_id")


@query("SELECT source_resource, count(DISTINCT p) AS n_proteins FROM (SELECT source_resource, participant_a_id_value AS p FROM combine_evidence UNION ALL SELECT source_resource, participant_b_id_value FROM combine_evidence) GROUP BY source_resource")
def endpoint_count(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select("source_resource", F.explode(F.array("participant_a_id_value", "participant_b_id_value")).alias("p")).groupBy("source_resource").agg(F.count_distinct("p").alias("n_proteins"))


@query(
    """SELECT hippie_confidence_level AS tier, count(s) AS n, min(s) AS least, max(s) AS most, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75,
round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) AS iqr FROM (SELECT hippie_confidence_level, hippie_score AS s FROM tomato_positive_pairs_deduplicated WHERE hippie_score IS NOT NULL AND NOT isnan(hippie_score)) GROUP BY 1"""
)
def dist_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("hippie_score")
    rows = pairs(spark, d).where(s.isNotNull() & ~F.isnan(s))
    plain = rows.groupBy(F.col("hippie_confidence_level").alias("tier")).agg(F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"))
    q = skew.interpolated(skew.compress(rows, F.col("hippie_confidence_level"), s), {"median": 0.5, "q25": 0.25, "q75": 0.75}).withColumn("iqr", F.col("q75") - F.col("q25"))
    return plain.join(q, F.col("tier").eqNullSafe(F.col("key"))).select("tier", F.col("total").alias("n"), "least", "most", "mean", *(F.round(c, 6).alias(c) for c in ("median", "q25", "q75", "iqr")))


_GATES = {"no_evidence_id": f"evidence_id IS NULL OR evidence_id IN {MISS}", "no_source": f"source_id IS NULL OR source_id IN {MISS}", "no_species": f"participant_a_species IS NULL OR participant_a_species IN {MISS}", "holdout_in_training": "is_external_holdout = 'TRUE' AND eligible_for_training = 'TRUE'", "bad_taxon": "participant_a_taxid IS NULL OR participant_a_taxid <= 0", "late_row_number": "source_row_number IS NULL OR source_row_number < 1"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS gate, count(*) FILTER (coalesce({v}, false)) AS violations, CASE WHEN count(*) FILTER (coalesce({v}, false)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM combine_evidence" for k, v in _GATES.items()))
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    rules = {k: F.expr(v) for k, v in _GATES.items()}
    rules |= {"no_evidence_id": G.missing("evidence_id"), "no_source": G.missing("source_id"), "no_species": G.missing("participant_a_species")}
    return G.gates(evidence(spark, d), rules)


_PROVENANCE = ("source_id", "source_resource", "source_file", "source_record_id", "pmid", "doi", "assay_family", "screen_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR {c} IN {MISS}) AS n_missing FROM combine_evidence" for c in _PROVENANCE))
def missing_provenance(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_share(evidence(spark, d), _PROVENANCE)


@query("SELECT participant_a_species AS species, count(*) AS n_rows, count(*) FILTER (eligible_for_training = 'TRUE') AS n_eligible, count(*) FILTER (is_external_holdout = 'TRUE' AND eligible_for_training = 'TRUE') AS n_leaked FROM combine_evidence GROUP BY 1")
def holdout_leak(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).groupBy(F.col("participant_a_species").alias("species")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("eligible_for_training") == "TRUE").alias("n_eligible"), F.count_if((F.col("is_external_holdout") == "TRUE") & (F.col("eligible_for_training") == "TRUE")).alias("n_leaked"))


@query(f"SELECT detection_method_raw AS value, count(*) AS n_rows FROM combine_evidence WHERE detection_method_raw NOT IN {MISS} AND detection_method_raw NOT IN (SELECT source_term FROM assay_mapping WHERE source_term IS NOT NULL) GROUP BY 1")
def vocab_closure(spark: SparkSession, d: str) -> DataFrame:
    """Methods, as written, that the vocabulary doesn't have."""
    return G.closure(evidence(spark, d), "detection_method_raw", table(spark, d, "assay_mapping"), "source_term")


@query(
    """WITH l AS (SELECT DISTINCT source_id, source_file FROM combine_evidence), r AS (SELECT DISTINCT source_id, source_file FROM phase2_progress)
SELECT (SELECT count(*) FROM (FROM l EXCEPT FROM r)) AS only_left, (SELECT count(*) FROM (FROM r EXCEPT FROM l)) AS only_right"""
)
def set_equal(spark: SparkSession, d: str) -> DataFrame:
    return G.same_set(evidence(spark, d), table(spark, d, "phase2_progress"), ["source_id", "source_file"])


@query("SELECT DISTINCT participant_a_id_value AS id FROM combine_evidence WHERE participant_a_id_value IS NOT NULL AND participant_a_id_value NOT IN (SELECT participant_b_id_value FROM combine_evidence WHERE participant_b_id_value IS NOT NULL)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence(spark, d)
    return rows.select(F.col("participant_a_id_value").alias("id")).where("id IS NOT NULL").distinct().join(rows.select(F.col("participant_b_id_value").alias("id")), "id", "left_anti")


@query("SELECT evidence_id AS id, source_id FROM combine_evidence UNION ALL SELECT line_id, source_id FROM raw_evidence_lines")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).select(F.col("evidence_id").alias("id"), "source_id").unionByName(table(spark, d, "raw_evidence_lines").select(F.col("line_id").alias("id"), "source_id"), allowMissingColumns=True)


@query("SELECT source_id, evidence_id FROM (SELECT DISTINCT source_id, evidence_id FROM combine_evidence) QUALIFY (row_number() OVER (PARTITION BY source_id ORDER BY evidence_id) - 1) % 25 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence(spark, d).select("source_id", "evidence_id").distinct()
    return O.ranked(rows, ["source_id"], [F.col("evidence_id")], "i").where((F.col("i") - 1) % 25 == 0).select("source_id", "evidence_id")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN la + lb > 1020 THEN least(la, greatest(50, floor(1020.0 * la / (la + lb)))) ELSE la END::BIGINT AS crop_a, CASE WHEN la + lb > 1020 THEN least(lb, greatest(50, 1020 - greatest(50, floor(1020.0 * la / (la + lb))))) ELSE lb END::BIGINT AS crop_b
FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 30 AS la, (l_partkey % 50 + 1)::BIGINT * 25 AS lb FROM lineitem)"""
)
def crop_budget(spark: SparkSession, d: str) -> DataFrame:
    """Lengths up to 1,500 and 1,250 cropped to the published 1,020 and 50."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 30).alias("la"), ((F.col("l_partkey") % 50 + 1) * 25).alias("lb"))
    a, b = N.crop_lengths(F.col("la"), F.col("lb"))
    return rows.select("l_orderkey", "l_linenumber", a.cast("long").alias("crop_a"), b.cast("long").alias("crop_b"))


@query(
    """SELECT label, list(round(mean, 6) ORDER BY i) AS mean, list(hi ORDER BY i) AS max, list(lo ORDER BY i) AS min
FROM (SELECT label, i, avg(x) AS mean, max(x) AS hi, min(x) AS lo FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) GROUP BY label"""
)
def elementwise_pools(spark: SparkSession, d: str) -> DataFrame:
    out = pooling.elementwise(table(spark, d, "embeddings"), "label", "embedding")
    return out.withColumn("mean", F.transform("mean", lambda x: F.round(x, 6)))


@query("SELECT label, list(round(mean, 6) ORDER BY i) AS pooled FROM (SELECT label, i, avg(x) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) GROUP BY label")
def elementwise_pool(spark: SparkSession, d: str) -> DataFrame:
    """The mean at every position."""
    return pooling.elementwise(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("pooled"))


@query("SELECT n_nationkey, round(sqrt(n_nationkey) * cos(n_nationkey * 2.399963229728653), 6) AS x, round(sqrt(n_nationkey) * sin(n_nationkey * 2.399963229728653), 6) AS y FROM nation")
def spiral_layout(spark: SparkSession, d: str) -> DataFrame:
    x, y = N.spiral(F.col("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    """SELECT evidence_id, CASE WHEN e.assay_family = 'genetic' THEN 'genetic' WHEN e.assay_family = 'computational' THEN 'computational' WHEN regexp_matches(interaction_type_raw, 'MI:0407') THEN 'direct_binary' WHEN regexp_matches(interaction_type_raw, 'MI:0914|MI:0915') THEN 'physical_association' WHEN regexp_matches(interaction_type_raw, 'MI:0462') THEN 'functional'
WHEN supports_direct_binding THEN 'direct_binary' WHEN supports_proximity_only THEN 'proximity' WHEN supports_physical_association THEN 'physical_association' ELSE 'unknown' END AS semantics
FROM combine_evidence AS e LEFT JOIN (SELECT DISTINCT lower(source_term) AS k, supports_direct_binding, supports_proximity_only, supports_physical_association FROM assay_mapping) AS v ON v.k = lower(detection_method_raw)"""
)
def infer_semantics(spark: SparkSession, d: str) -> DataFrame:
    flags = ["supports_direct_binding", "supports_proximity_only", "supports_physical_association"]
    vocabulary = table(spark, d, "assay_mapping").select(F.lower("source_term").alias("k"), *flags).distinct()
    rows = R.cascade(evidence(spark, d).select("evidence_id", "assay_family", "interaction_type_raw", "detection_method_raw"), [F.lower("detection_method_raw")], vocabulary, "k", flags)
    family = F.col("assay_family")
    return rows.select("evidence_id", P.semantics(family == "genetic", family == "computational", F.col("interaction_type_raw"), *map(F.col, flags)).alias("semantics"))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
