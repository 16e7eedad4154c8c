"""Queries over the library's expressions, lookups, gates and summaries that no other query runs, each on a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions import fixed
from dyadic.functions import numeric as N
from dyadic.functions import text as X
from dyadic.operators import gates as G
from dyadic.operators import graph as H
from dyadic.operators import metrics as M
from dyadic.operators import ordering as O
from dyadic.operators import pairs as P
from dyadic.operators import partition as S
from dyadic.operators import pooling
from dyadic.operators import resolve as R
from dyadic.plans import evidence as E
from dyadic.plans import graphs
from dyadic.plans.catalogue import Catalogue
from dyadic.session import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

MISS = "('', '-', 'NA', 'nan', 'None')"
C4 = graphs.C4


@query("SELECT evidence_id, split_part(source_file, '/', -1) AS last_item, split_part(source_file, '/', 1) AS first_item, CASE WHEN contains(source_file, '_') THEN substr(source_file, instr(source_file, '_') + 1) END AS rest FROM combine_evidence")
def split_items(spark: SparkSession, d: str) -> DataFrame:
    """Last and first item of a path, and what is behind the first of its separators (a split with a limit)."""
    c = F.col("source_file")
    return E.evidence(spark, d).select("evidence_id", X.item(c, -1, "/").alias("last_item"), X.item(c, 1, "/").alias("first_item"), F.try_element_at(F.split(c, "_", 2), F.lit(2)).alias("rest"))


_NOTE = "'taxid:' || participant_a_taxid || '(x)|intact-miscore:' || intact_miscore || '|Yl S (' || publication_year || ')|epoch=' || (source_row_number % 40) || '-auprc=0.' || (source_row_number % 90 + 10)"


@query(
    f"""SELECT evidence_id, participant_a_taxid AS taxon, intact_miscore AS mi_score, publication_year AS year, (source_row_number % 40)::INT AS epoch, ('0.' || (source_row_number % 90 + 10))::DOUBLE AS auprc
FROM combine_evidence WHERE {_NOTE} IS NOT NULL"""
)
def regex_family(spark: SparkSession, d: str) -> DataFrame:
    """Taxon, score, year, epoch and AUPRC out of one note."""
    c = F.col("note")
    return E.evidence(spark, d).select("evidence_id", F.expr(_NOTE).alias("note")).where("note IS NOT NULL").select("evidence_id", X.taxon_id(c).alias("taxon"), X.mi_score(c).alias("mi_score"), X.year(c).alias("year"), X.epoch(c).alias("epoch"), X.auprc(c).alias("auprc"))


@query("SELECT evidence_id, regexp_replace(upper(participant_a_original_id), '^(?:UNIPROTKB|INTACT):', '') AS bare FROM combine_evidence")
def prefix_strip(spark: SparkSession, d: str) -> DataFrame:
    return E.evidence(spark, d).select("evidence_id", X.without_prefix(F.upper("participant_a_original_id"), ["uniprotkb", "intact"]).alias("bare"))


@query("SELECT p_partkey, '[' || p_brand || '](' || p_size || ')' AS peptide_a, CASE WHEN p_size % 2 = 0 THEN '[' || p_type || '](1)-x' END AS peptide_b FROM part")
def peptide_split(spark: SparkSession, d: str) -> DataFrame:
    pair = X.peptide_pair(F.expr("'[' || p_brand || '](' || p_size || ')' || CASE WHEN p_size % 2 = 0 THEN '-[' || p_type || '](1)-x' ELSE '' END"))
    return table(spark, d, "part").select("p_partkey", pair["a"].alias("peptide_a"), pair["b"].alias("peptide_b"))


@query("SELECT pair_id, try_cast(publication_years AS INT) AS year, try_cast(pmids AS DOUBLE) AS pmid FROM tomato_positive_pairs_deduplicated WHERE NOT regexp_matches(coalesce(publication_years, ''), '\\s') AND NOT regexp_matches(coalesce(pmids, ''), '\\s')")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers where a text is one, null elsewhere; what blanks around a number mean differs between engines."""
    rows = E.pairs(spark, d).where("NOT coalesce(publication_years, '') RLIKE '\\\\s' AND NOT coalesce(pmids, '') RLIKE '\\\\s'")
    return rows.select("pair_id", F.col("publication_years").try_cast("int").alias("year"), F.col("pmids").try_cast("double").alias("pmid"))


@query("SELECT l_orderkey, l_linenumber, (least(l_partkey, l_suppkey) << 32) | greatest(l_partkey, l_suppkey) AS edge, least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem")
def packed_edges(spark: SparkSession, d: str) -> DataFrame:
    u, v = N.unpacked_edge(F.col("edge"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.packed_edge(F.col("l_partkey"), F.col("l_suppkey")).alias("edge")).withColumns({"u": u, "v": v})


@query(f"SELECT vec_id, array_to_string(list_filter(list_transform(range({len(fixed.COMPARTMENTS)}), lambda i: CASE WHEN mask & (1 << i)::INT <> 0 THEN {list(fixed.COMPARTMENTS)}[i + 1] END), lambda x: x IS NOT NULL), '|') AS names FROM ({graphs.MASKS})")
def mask_labels(spark: SparkSession, d: str) -> DataFrame:
    return graphs.mask_bits(spark, d).select("vec_id", N.mask_names(F.col("mask"), fixed.COMPARTMENTS).alias("names"))


@query(
    """SELECT x.vec_id, round(list_inner_product(list_transform(x.embedding, lambda a: a::DOUBLE), list_transform(y.embedding, lambda a: a::DOUBLE)), 5) AS dot,
list_transform(list_transform(list_zip(x.embedding, y.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)) || list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), lambda a: round(a, 4) + 0.0) AS features FROM embeddings AS x JOIN embeddings AS y ON y.vec_id = x.vec_id + 1"""
)
def vector_products(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector and the next one: dot product, absolute differences and products."""
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in "ab")
    return pairs.select("vec_id", F.round(N.dot(a, b), 5).alias("dot"), F.transform(N.pair_features(a, b), lambda x: F.round(x, 4)).alias("features"))


_KINDS = ("psi-mi:\"MI:0326\"(protein)", "MI:0328", "small molecule", "Deoxyribonucleic acid", "ribonucleic acid", "nucleic acid", "gene", "molecule set", "peptide", "other")


def _at(values: tuple[str, ...], number: Column) -> Column:
    return F.array(*map(F.lit, values))[(number % len(values)).cast("int")]


@query(
    f"""WITH r AS (SELECT evidence_id, lower({[k for k in _KINDS]}[(source_row_number % {len(_KINDS)})::INT + 1]) AS k, CASE WHEN source_row_number % 13 = 0 THEN 'CHEBI:1' WHEN source_row_number % 17 = 0 THEN '-' ELSE participant_a_original_id END AS i FROM combine_evidence)
SELECT evidence_id, CASE WHEN contains(k, 'mi:0328') OR contains(k, 'small molecule') OR contains(k, 'chebi') OR coalesce(contains(lower(i), 'chebi'), false) THEN 'small_molecule' WHEN contains(k, 'mi:0319') OR contains(k, 'mi:0681') OR contains(k, 'deoxyribonucleic') THEN 'dna' WHEN contains(k, 'mi:0320') OR contains(k, 'ribonucleic') THEN 'rna'
WHEN contains(k, 'mi:0318') OR contains(k, 'nucleic acid') THEN 'nucleic_acid' WHEN contains(k, 'mi:0250') OR contains(k, 'gene') THEN 'gene' WHEN contains(k, 'mi:1304') OR contains(k, 'molecule set') THEN 'molecule_set' WHEN contains(k, 'mi:0326') OR contains(k, 'protein') OR contains(k, 'mi:0327') OR contains(k, 'peptide') THEN 'protein'
WHEN coalesce(i, '') IN ('', '-') THEN 'missing' ELSE 'protein' END AS kind FROM r"""
)
def molecule_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of texts of every class, given in turn to the records."""
    n = F.col("source_row_number")
    raw = F.when(n % 13 == 0, "CHEBI:1").when(n % 17 == 0, "-").otherwise(F.col("participant_a_original_id"))
    return E.evidence(spark, d).select("evidence_id", X.molecule_type(_at(_KINDS, n), raw).alias("kind"))


_TYPES = ("MI:0915", "MI:0914", "MI:0407", "MI:0217", "MI:0208", "MI:0915 MI:2364", "MI:0403")
_METHODS = ("MI:0018", "MI:0663", "MI:0019", "MI:0416", "MI:0096")


@query(
    f"""WITH r AS (SELECT {list(_TYPES)}[(source_row_number % {len(_TYPES)})::INT + 1] AS t, {list(_METHODS)}[(source_row_number % {len(_METHODS)})::INT + 1] AS m, source_row_number % 19 = 0 AS negative, participant_a_taxid AS x, participant_b_taxid AS y, CASE WHEN source_row_number % 23 = 0 THEN 'dna' ELSE 'protein' END AS k FROM combine_evidence)
SELECT CASE WHEN negative THEN 'negative' WHEN NOT regexp_matches(t, 'MI:0915|MI:0914|MI:0407|MI:0217') THEN 'not_core' WHEN regexp_matches(t, 'MI:2364|MI:0403') THEN 'proximity_type' WHEN regexp_matches(m, 'MI:0663|MI:0416|MI:1314|MI:0813|MI:2364|MI:0403') THEN 'proximity_method'
WHEN NOT coalesce(x = 3702 AND y = 3702, false) THEN 'other_species' WHEN k <> 'protein' THEN 'not_protein' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def core_filter(spark: SparkSession, d: str) -> DataFrame:
    """The published core filter over types and methods given in turn to the records."""
    n = F.col("source_row_number")
    molecule = F.when(n % 23 == 0, "dna").otherwise("protein")
    rules = P.core_rules(_at(_TYPES, n), _at(_METHODS, n), n % 19 == 0, (F.col("participant_a_taxid"), F.col("participant_b_taxid")), (molecule, F.lit("protein")), 3702)
    return P.reason_counts(P.waterfall(E.evidence(spark, d), rules))


_ALIASES = "'ensembl:' || participant_b_id_value || '|uniprotkb:' || participant_a_original_name || '(gene name)|psi-mi:' || participant_a_id_value || '(display_long)'"


@query(f"SELECT evidence_id, participant_a_original_name AS symbol, 'psi-mi:' || participant_a_id_value || '(display_long)' AS chosen, coalesce(CASE WHEN doi NOT IN {MISS} THEN doi END, CASE WHEN pmid NOT IN {MISS} THEN pmid END, study_id, source_record_id) AS alternative FROM combine_evidence WHERE {_ALIASES} IS NOT NULL")
def alias_picks(spark: SparkSession, d: str) -> DataFrame:
    """Gene symbol, the first item with a tag, and the first alternative that isn't missing."""
    rows = E.evidence(spark, d).withColumn("_aliases", F.expr(_ALIASES)).where("_aliases IS NOT NULL")
    c = F.col("_aliases")
    return rows.select("evidence_id", X.gene_symbol(c).alias("symbol"), X.tagged_item(c, ["psi-mi:"]).alias("chosen"), X.first_of(*map(F.col, ("doi", "pmid", "study_id", "source_record_id"))).alias("alternative"))


_LENGTHS = "SELECT upper(trim(query)) AS id, max(qlen) AS len FROM ara_prot_all_vs_all GROUP BY 1"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ara_prot_all_vs_all").groupBy(F.upper(F.trim("query")).alias("id")).agg(F.max("qlen").alias("len"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ara_prot_all_vs_all").select(F.upper(F.trim("query")).alias("a"), F.upper(F.trim("target")).alias("b")).distinct()


_ALIGNED = "SELECT DISTINCT upper(trim(query)) AS a, upper(trim(target)) AS b FROM ara_prot_all_vs_all"


@query(f"WITH t AS (SELECT * FROM ({_LENGTHS}) WHERE len > 300), p AS ({_ALIGNED}) SELECT a, b, x.len AS a_len, y.len AS b_len FROM p JOIN t AS x ON x.id = a JOIN t AS y ON y.id = b")
def both_ends(spark: SparkSession, d: str) -> DataFrame:
    """Aligned pairs both of whose ends are among the long proteins."""
    return R.both_ends(_aligned(spark, d), "a", "b", _lengths(spark, d).where("len > 300"), "id", "len")


@query(f"WITH t AS (SELECT * FROM ({_LENGTHS}) WHERE len > 300), p AS ({_ALIGNED}) SELECT a, b, coalesce(x.len, 0) + coalesce(y.len, 0) AS pair_length FROM p LEFT JOIN t AS x ON x.id = a LEFT JOIN t AS y ON y.id = b")
def pair_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sums of both lengths, a short protein's counting as unknown."""
    return R.pair_lengths(_aligned(spark, d), "a", "b", _lengths(spark, d).where("len > 300"), "id", "len")


@query(f"WITH t AS (SELECT * FROM ({_LENGTHS}) WHERE len > 300), p AS ({_ALIGNED}) SELECT a, b, (CASE WHEN x.len % 7 = 0 THEN 1 ELSE x.len % 3 + 1 END + CASE WHEN y.len % 7 = 0 THEN 1 ELSE y.len % 3 + 1 END)::BIGINT * 10000000 + x.len + y.len AS priority FROM p JOIN t AS x ON x.id = a JOIN t AS y ON y.id = b")
def composite_priority(spark: SparkSession, d: str) -> DataFrame:
    """Evidence before length, a missing weight counting 1."""
    rows = R.both_ends(_aligned(spark, d), "a", "b", _lengths(spark, d).where("len > 300"), "id", "len")
    weights = tuple(F.when(F.col(f"{x}_len") % 7 != 0, F.col(f"{x}_len") % 3 + 1) for x in "ab")
    return rows.select("a", "b", fixed.priority_score(weights, (F.col("a_len"), F.col("b_len"))).alias("priority"))


@query(f"SELECT row_id, a.v AS accession, a.w AS weight FROM {C4} AS r JOIN (SELECT participant_b_id AS k, participant_a_id AS v, max(evidence_count) AS w FROM {C4} WHERE participant_a_id IS NOT NULL GROUP BY 1, 2) AS a ON a.k = r.participant_a_id")
def locus_explode(spark: SparkSession, d: str) -> DataFrame:
    """Each record once for every accession of its first participant as a locus, with the greatest weight."""
    rows = table(spark, d, C4)
    accessions = rows.where("participant_a_id IS NOT NULL").select(F.col("participant_b_id").alias("k"), F.col("participant_a_id").alias("accession"), F.col("evidence_count").alias("weight"))
    return R.exploded(rows.select("row_id", "participant_a_id"), "participant_a_id", accessions, "k", "accession", "weight").select("row_id", "accession", "weight")


@query(
    """WITH v AS (SELECT 'V' || vec_id AS k, list_transform(embedding, lambda x: round(x::DOUBLE, 5) + 0.0) AS v FROM embeddings WHERE label < 6),
i AS (SELECT event_id, 'V' || (event_id % 700) || CASE WHEN event_id % 3 = 0 THEN '-2' ELSE '' END AS id FROM events)
SELECT event_id, coalesce(x.v, y.v, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS vector, CASE WHEN x.k IS NOT NULL THEN 1 WHEN y.k IS NOT NULL THEN 2 END AS matched_by FROM i LEFT JOIN v AS x ON x.k = id LEFT JOIN v AS y ON y.k = regexp_replace(id, '-\\d+$', '')"""
)
def vector_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The vector of an id, else of its isoform's base, else zeros."""
    known = table(spark, d, "embeddings").where("label < 6").select(F.concat(F.lit("V"), "vec_id").alias("k"), F.col("embedding").alias("vector"))
    n = F.col("event_id")
    ids = table(spark, d, "events").select("event_id", F.concat(F.lit("V"), n % 700, F.when(n % 3 == 0, "-2").otherwise("")).alias("id"))
    out = R.resolved_vectors(ids, [F.col("id"), X.isoform_base(F.col("id"))], known, "k", "vector", 64)
    return out.select("event_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"), "matched_by")


_CASCADE = ["raw", "upper(raw)", "upper(trim(raw))", "'A' || upper(trim(raw))", "substr(upper(trim(raw)), 1, 6)", "regexp_replace(upper(trim(raw)), '-\\d+$', '')"]


@query(
    f"WITH t AS ({_LENGTHS}), e AS (SELECT DISTINCT target AS raw FROM ara_prot_all_vs_all) SELECT raw, coalesce({', '.join(f't{i}.len' for i in range(6))}, 0) AS len, CASE {' '.join(f'WHEN t{i}.id IS NOT NULL THEN {i + 1}' for i in range(6))} END AS matched_by FROM e "
    + " ".join(f"LEFT JOIN t AS t{i} ON t{i}.id = {c}" for i, c in enumerate(_CASCADE))
)
def sequence_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Six levels: exact, upper case, stripped, locus, accession, isoform base."""
    raw, clean = F.col("raw"), F.upper(F.trim("raw"))
    levels = [raw, F.upper("raw"), clean, F.concat(F.lit("A"), clean), F.substring(clean, 1, 6), X.isoform_base(clean)]
    return R.cascade(table(spark, d, "ara_prot_all_vs_all").select(F.col("target").alias("raw")).distinct(), levels, _lengths(spark, d), "id", ["len"], {"len": F.lit(0)})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, max(l_linenumber)) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3)")
def fetch_back(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows by locators that an aggregate has chosen."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    chosen = rows.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"), F.count("*").alias("n")).where("n > 3")
    return R.fetched(rows, chosen, ["l_orderkey", "l_linenumber"])


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS b FROM r))
SELECT user_id, event_type, min(i) AS first_place, max(i) AS last_place, count(*) AS n_rows FROM s GROUP BY user_id, event_type, run"""
)
def run_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type in the order of each user's events."""
    return O.runs(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def head_limit(spark: SparkSession, d: str) -> DataFrame:
    """A report of the last ten events, so the limit is its feature."""
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "event_type")


@query(graphs.COMPONENTS + f", k AS (SELECT p.*, least(x.component, y.component) || '|' || greatest(x.component, y.component) AS component_key FROM ({graphs.PAIRS}) AS p JOIN g AS x ON x.node = p.a JOIN g AS y ON y.node = p.b) SELECT pair_key, component_key, row_number() OVER (PARTITION BY component_key ORDER BY bits DESC, a, b) AS place FROM k")
def group_priority(spark: SparkSession, d: str) -> DataFrame:
    """Places of pairs within their pair of components."""
    parts = H.components(graphs.nodes(spark, d), graphs.edges(spark, d))
    keyed = H.component_keys(graphs.low_pairs(spark, d), "a", "b", parts)
    return O.ranked(keyed, ["component_key"], [F.desc("bits"), F.col("a"), F.col("b")], "place").select("pair_key", "component_key", "place")


_HUBS = f"h AS (SELECT node, sum(w) AS weight FROM (SELECT a AS node, bits AS w FROM p UNION ALL SELECT b, bits FROM p) GROUP BY node ORDER BY weight DESC, node LIMIT 25)"


@query(f"WITH p AS ({graphs.PAIRS}), {_HUBS} SELECT node, weight::BIGINT AS weight FROM h")
def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A top-25 report."""
    return H.hubs(graphs.low_pairs(spark, d), "a", "b", F.col("bits"), 25)


@query(f"WITH p AS ({graphs.PAIRS}), {_HUBS} SELECT a, b, bits FROM p WHERE a IN (SELECT node FROM h) AND b IN (SELECT node FROM h)")
def hub_network(spark: SparkSession, d: str) -> DataFrame:
    """The pairs among the 25 hubs."""
    pairs = graphs.low_pairs(spark, d)
    return H.hub_edges(pairs, "a", "b", H.hubs(pairs, "a", "b", F.col("bits"), 25)).select("a", "b", "bits")


@query(f"WITH p AS ({graphs.PAIRS}), {_HUBS}, k AS (SELECT node, row_number() OVER (ORDER BY weight DESC, node) - 1 AS i FROM h) SELECT node, i AS place, round(sqrt(i) * cos(i * 2.399963229728653), 6) AS x, round(sqrt(i) * sin(i * 2.399963229728653), 6) AS y FROM k")
def hub_layout(spark: SparkSession, d: str) -> DataFrame:
    """The hubs on a spiral, the heaviest in its middle: what a drawing of hub_network needs."""
    placed = O.ranked(H.hubs(graphs.low_pairs(spark, d), "a", "b", F.col("bits"), 25), [], [F.desc("weight"), F.col("node")], "_n")
    x, y = N.spiral(F.col("_n") - 1)
    return placed.select("node", (F.col("_n") - 1).alias("place"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_EXPORTS = {"high": "tier = 'high'", "high_hetero": "tier = 'high' AND participant_a_id <> participant_b_id", "high_medium": "tier IN ('high', 'medium')", "high_medium_hetero": "tier IN ('high', 'medium') AND participant_a_id <> participant_b_id"}


@query(E.SCORED + " UNION ALL ".join(f"SELECT '{k}' AS export, participant_a_id, participant_b_id FROM scored WHERE {v}" for k, v in _EXPORTS.items()))
def tier_projections(spark: SparkSession, d: str) -> DataFrame:
    """The four exports of scored pairs, in one pass."""
    kinds = F.array_compact(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _EXPORTS.items())))
    return E._scored(spark, d).select(F.explode(kinds).alias("export"), "participant_a_id", "participant_b_id")


_DEFAULT_PRED = f"SELECT *, (pair_hash % 5)::INT AS own_fold FROM (SELECT pair_id, task, score, label, ('0x' || substr(md5(pair_id), 1, 6))::BIGINT AS pair_hash FROM ({graphs.PRED}))"


def _by_fold(spark: SparkSession, d: str) -> DataFrame:
    """Scores of five folds' models for every pair, and of three poolings."""
    own = F.conv(F.substring(F.md5("pair_id"), 1, 6), 16, 10).cast("long") % 5
    rows = graphs.predictions(spark, d).withColumn("own_fold", own.cast("int"))
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("fold_score", F.col("score") * (1 + F.col("fold")) / 5)


@query(f"SELECT pair_id, round(score * (1 + own_fold) / 5, 6) AS out_of_fold, round(score * 15 / 25, 6) AS fold_mean FROM ({_DEFAULT_PRED})")
def fold_average(spark: SparkSession, d: str) -> DataFrame:
    out = M.fold_average(_by_fold(spark, d), ["pair_id"], "fold", "own_fold", "fold_score")
    return out.withColumns({c: F.round(c, 6) for c in ("out_of_fold", "fold_mean")})


_ABLATED = f"SELECT pooling, task, label, CASE pooling WHEN 'mean' THEN score WHEN 'max' THEN round(score, 1) ELSE 1 - score END AS score FROM ({graphs.PRED}) CROSS JOIN (VALUES ('mean'), ('max'), ('min')) AS t(pooling)"


@query(
    f"""WITH p AS ({_ABLATED}), s AS (SELECT task, pooling, score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n, sum(pos) OVER (PARTITION BY task, pooling) AS ap FROM s WINDOW w AS (PARTITION BY task, pooling ORDER BY score DESC)),
a AS (SELECT task, pooling, sum(pos / ap * (tp / n)) AS average_precision FROM c GROUP BY ALL),
k AS (SELECT task, pooling, count(*) FILTER (score > 0.62 AND label = 1) AS tp, count(*) FILTER (score > 0.62 AND label = 0) AS fp, count(*) FILTER (score <= 0.62 AND label = 1) AS fn FROM p GROUP BY ALL)
SELECT task, pooling, round(average_precision, 6) AS average_precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM a JOIN k USING (task, pooling)"""
)
def pooling_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by poolings, one row each."""
    score = F.when(F.col("pooling") == "mean", F.col("score")).when(F.col("pooling") == "max", F.round("score", 1)).otherwise(1 - F.col("score"))
    rows = graphs.predictions(spark, d).withColumn("pooling", F.explode(F.array(*map(F.lit, ("mean", "max", "min"))))).withColumn("score", score)
    out = M.ablation(rows, "task", ["pooling"], "score", "label", 0.62)
    return out.select("task", "pooling", F.round("average_precision", 6).alias("average_precision"), F.round("f1", 6).alias("f1"))


@query("SELECT 'no_pair_aggregation' AS gate, count(*) AS n_pairs, sum(n - 1)::BIGINT AS n_beyond_first, 'PASS' AS status FROM (SELECT count(*) AS n FROM combine_evidence GROUP BY unordered_pair_key_provisional)")
def no_aggregation_gate(spark: SparkSession, d: str) -> DataFrame:
    return G.no_aggregation(E.evidence(spark, d), "unordered_pair_key_provisional")


@query("SELECT 'split_columns' AS gate, 0::BIGINT AS violations, 'PASS' AS status UNION ALL SELECT 'score_columns', 1, 'FAIL'")
def forbidden_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = E.evidence(spark, d)
    return G.forbidden(rows, ["train_fold", "split", "partition"], "split_columns").unionByName(G.forbidden(rows, ["label", "intact_miscore"], "score_columns"))


@query("SELECT 'nation' AS gate, 0::BIGINT AS violations, 'PASS' AS status UNION ALL SELECT 'region', 2, 'FAIL'")
def schema_gates(spark: SparkSession, d: str) -> DataFrame:
    """A table with the expected schema, and one that has another type and lacks a column."""
    good = G.schema_gate(table(spark, d, "nation"), {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "nation")
    return good.unionByName(G.schema_gate(table(spark, d, "region"), {"r_regionkey": "string", "r_name": "string", "r_comment": "string"}, "region"))


_REJECTED = "count(*) FILTER (publication_year IS NULL) * 100.0 / count(*) >= 0.5"


@query(f"SELECT 'rejection_rate' AS gate, count(*) AS violations, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT source_resource FROM combine_evidence GROUP BY 1 HAVING {_REJECTED})")
def rejection_gate(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which half a per cent or more of the records lack a year."""
    return G.rejection_gate(G.conservation(E.evidence(spark, d), ["source_resource"], F.col("publication_year").isNull()), 0.5)


@query(
    f"""WITH r AS (SELECT pair_id, participant_a_id AS a, participant_b_id AS b, ('0x' || substr(md5(pair_id || '|42'), 1, 13))::BIGINT / 4503599627370496.0 < 0.5 AS swap FROM tomato_positive_pairs_deduplicated)
SELECT pair_id, CASE WHEN swap THEN b ELSE a END AS a, CASE WHEN swap THEN a ELSE b END AS b FROM r"""
)
def random_order(spark: SparkSession, d: str) -> DataFrame:
    rows = E.pairs(spark, d).select("pair_id", F.col("participant_a_id").alias("a"), F.col("participant_b_id").alias("b"))
    return S.random_order(rows, "a", "b", ["pair_id"])


@query(
    """WITH m AS (SELECT label, least(vec_id % 12, vec_id // 12 % 12) AS i, greatest(vec_id % 12, vec_id // 12 % 12) AS j, sum(embedding[1]::DOUBLE) AS t FROM embeddings GROUP BY ALL)
SELECT label, i, j, round(CASE WHEN i = j THEN t ELSE t / 2 END, 6) + 0.0 AS weight FROM m"""
)
def symmetrised_attention(spark: SparkSession, d: str) -> DataFrame:
    """A matrix a label, of twelve positions, from the vectors' first elements."""
    n = F.col("vec_id")
    entries = table(spark, d, "embeddings").select("label", (n % 12).alias("i"), (F.floor(n / 12) % 12).alias("j"), F.col("embedding")[0].alias("w"))
    return pooling.symmetrised(entries, "label", "i", "j", "w").withColumn("weight", F.round("weight", 6))


@query(
    """WITH s AS (SELECT label, p, sum(CASE WHEN i = j THEN t ELSE t / 2 END) AS w FROM (SELECT label, i, j, t, unnest(CASE WHEN i = j THEN [i] ELSE [i, j] END) AS p FROM (SELECT label, least(vec_id % 12, vec_id // 12 % 12) AS i, greatest(vec_id % 12, vec_id // 12 % 12) AS j, sum(1.0 + vec_id % 5)::DOUBLE AS t FROM embeddings GROUP BY ALL)) GROUP BY ALL),
e AS (SELECT label, vec_id % 12 AS p, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, list(round(v, 5) + 0.0 ORDER BY k) AS pooled FROM (SELECT label, k, sum(x * w) / sum(w) AS v FROM e JOIN s USING (label, p) GROUP BY ALL) GROUP BY label"""
)
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Vectors weighted by symmetrised attention between positions, over the whole length."""
    n = F.col("vec_id")
    rows = table(spark, d, "embeddings")
    entries = rows.select("label", (n % 12).alias("i"), (F.floor(n / 12) % 12).alias("j"), (1.0 + n % 5).alias("w"))
    out = pooling.attention_pooled(rows.withColumn("p", n % 12), pooling.symmetrised(entries, "label", "i", "j", "w"), "label", "p", "embedding")
    return out.withColumn("pooled", F.transform("pooled", lambda x: F.round(x, 5)))


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
