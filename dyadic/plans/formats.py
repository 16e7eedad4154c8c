"""Round trips through files: a test table is written in a format, or as it stands, and comes back through its reader.

Files go to the shared folder and are gone when the JVM ends. Each query runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic import sinks
from dyadic.functions import fixed
from dyadic.operators import gates as G
from dyadic.operators import pairs as P
from dyadic.plans.catalogue import Catalogue
from dyadic.session import Workspace, table
from dyadic.sources import lines as L
from dyadic.sources import readers as R
from dyadic.streaming import ingest

CATALOGUE = Catalogue()
query = CATALOGUE.query

MISS = "('', '-', 'NA', 'nan', 'None')"
C4 = "ara_positive_c4_test_id0_50_cov0_80"


def _place(spark: SparkSession, name: str) -> str:
    return f"{Workspace(spark, 'formats').root}/{name}"


def _text(df: DataFrame, line: Column, at: str, **options: str) -> str:
    df.select(line.alias("value")).write.options(**options).text(at)
    return at


def _delimited(df: DataFrame, at: str, sep: str, header: bool = True, **options: str) -> str:
    """Fields as they stand, without quotes; each file has the header."""
    df.write.options(sep=sep, header=header, quote="", nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(at)
    return at


#: The physical lines of the lines of a layout, and their fields.
MITAB_LINES = f"""WITH l AS (SELECT unnest(string_split_regex(raw_line, '\\r\\n|\\r|\\n')) AS x FROM raw_evidence_lines WHERE layout = 'mitab27'),
f AS (SELECT x, string_split(x, chr(9)) AS f FROM l WHERE trim(x) <> '' AND NOT starts_with(x, '#')),
j AS (SELECT *, CASE WHEN len(f) < 42 THEN 'column count ' || len(f) || ' < 42' WHEN f[1] IN ('', '-') AND f[2] IN ('', '-') THEN 'missing participants' END AS reason FROM f)
"""


def _mitab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "raw_evidence_lines").where("layout = 'mitab27' AND raw_line IS NOT NULL")
    return R.mitab(spark, _text(lines, F.col("raw_line"), _place(spark, "x.mitab27.txt")))


def _known(c: str, name: str) -> str:
    return f"CASE WHEN {c} NOT IN {MISS} THEN {c} END AS {name}"


@query(MITAB_LINES + f"SELECT {_known('f[1]', 'id_a')}, {_known('f[2]', 'id_b')}, {_known('f[7]', 'detection_method')}, {_known('f[10]', 'taxid_a')}, {_known('f[14]', 'interaction_ids')}, {_known('f[36]', 'negative')} FROM j WHERE reason IS NULL")
def read_mitab(spark: SparkSession, d: str) -> DataFrame:
    return _mitab(spark, d)[0].select("id_a", "id_b", "detection_method", "taxid_a", "interaction_ids", "negative")


@query(
    MITAB_LINES
    + f"""SELECT least(f[1], f[2]) AS participant_a_id, greatest(f[1], f[2]) AS participant_b_id, coalesce(array_to_string((list_sort(list(DISTINCT f[8]) FILTER (f[8] NOT IN {MISS})))[1:5], '|'), '') AS first_authors
FROM j WHERE reason IS NULL AND f[1] NOT IN {MISS} AND f[2] NOT IN {MISS} GROUP BY 1, 2"""
)
def pair_authors(spark: SparkSession, d: str) -> DataFrame:
    """The first five authors of each pair of the interaction lines, which have them where combine_evidence has none."""
    rows = _mitab(spark, d)[0]
    return P.names(rows, "id_a", "id_b", "aliases_a", "aliases_b", ["source_file", "line_no"], author="first_author").select("participant_a_id", "participant_b_id", "first_authors")


@query(MITAB_LINES + "SELECT 'SRC' AS source_id, reason, x AS raw_record FROM j WHERE reason IS NOT NULL")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records as the dead-letter sink has them; tabs within are what the file's own delimiter was."""
    at = _place(spark, "rejects")
    sinks.write_rejects(_mitab(spark, d)[1], at, "SRC")
    back = spark.read.options(header=True, sep="\t", quote='"', escape="\\").csv(at)
    return back.select("source_id", "reason", "raw_record")


def _tab3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "combine_evidence")
    given = {0: "evidence_id", 1: "participant_a_taxid", 2: "participant_b_taxid", 5: "participant_a_original_name", 6: "participant_b_original_name", 11: "detection_method_raw", 14: "publication_id_raw", 15: "participant_a_taxid", 16: "participant_b_taxid", 17: "throughput_raw", 23: "pmid", 24: "participant_a_id_value", 26: "study_id", 27: "participant_b_id_value"}
    return rows.select(*((F.coalesce(F.col(given[i]).cast("string"), F.lit("-")) if i in given else F.lit("-")).alias(f"c{i}") for i in range(37)))


@query(
    f"""SELECT evidence_id AS biogrid_id, {_known('detection_method_raw', 'system')}, {_known('throughput_raw', 'throughput')},
coalesce(CASE WHEN pmid NOT IN {MISS} THEN pmid END, CASE WHEN participant_a_id_value NOT IN {MISS} THEN participant_a_id_value END, CASE WHEN participant_a_original_name NOT IN {MISS} THEN participant_a_original_name END, participant_a_taxid::VARCHAR, evidence_id) AS id_a,
coalesce(CASE WHEN study_id NOT IN {MISS} THEN study_id END, CASE WHEN participant_b_id_value NOT IN {MISS} THEN participant_b_id_value END, CASE WHEN participant_b_original_name NOT IN {MISS} THEN participant_b_original_name END, participant_b_taxid::VARCHAR, evidence_id) AS id_b FROM combine_evidence"""
)
def read_tab3(spark: SparkSession, d: str) -> DataFrame:
    """Ids by precedence of the six id columns."""
    good, _ = R.tab3(spark, _delimited(_tab3(spark, d), _place(spark, "x.tab3.txt"), "\t"))
    return good.select("biogrid_id", "system", "throughput", "id_a", "id_b")


_SCORES = "FROM combine_evidence WHERE source_resource = 'STRING'"


def _links(spark: SparkSession, d: str, full: bool) -> DataFrame:
    s = table(spark, d, "combine_evidence").where("source_resource = 'STRING'")
    ends = [F.concat(F.col(f"participant_{x}_taxid").cast("string"), F.lit("."), F.col(f"participant_{x}_id_value")).alias(x) for x in "ab"]
    n = {k: F.coalesce(F.col(f"string_{k}_score").cast("string"), F.lit("x")).alias(k) for k in ("experimental", "database", "textmining", "combined")}
    zero = lambda k: F.lit("0").alias(k)
    order = [*ends, zero("h"), n["experimental"], zero("et"), n["database"], zero("dt"), n["textmining"], zero("tt"), n["combined"]] if full else [*ends, n["experimental"], n["database"], n["textmining"], n["combined"]]
    name = "links.full.txt.gz" if full else "links.detailed.txt.gz"
    at = _delimited(s.where("participant_a_taxid IS NOT NULL AND participant_b_taxid IS NOT NULL AND participant_a_id_value IS NOT NULL AND participant_b_id_value IS NOT NULL").select(*order), _place(spark, name), " ", compression="gzip")
    return R.string_links(spark, at, R.string_layout(at))[0].select("a", "b", "experimental", "database", "textmining", "combined")


_LINKS = f"SELECT participant_a_id_value AS a, participant_b_id_value AS b, string_experimental_score AS experimental, string_database_score AS database, string_textmining_score AS textmining, string_combined_score AS combined {_SCORES} AND participant_a_taxid IS NOT NULL AND participant_b_taxid IS NOT NULL AND participant_a_id_value IS NOT NULL AND participant_b_id_value IS NOT NULL"


@query(_LINKS)
def read_string_detailed(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, full=False)


@query(_LINKS)
def read_string_full(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, full=True)


_PEPTIDE = "'[' || p_brand || '](' || p_size || ')-[' || p_type || '](1)'"


@query(f"SELECT p_partkey AS spectrum, '[' || p_brand || '](' || p_size || ')' AS peptide_a, '[' || p_type || '](1)' AS peptide_b, p_name AS linker, p_retailprice AS score, p_brand AS a, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS b FROM part WHERE p_size % 5 <> 0")
def read_xlms(spark: SparkSession, d: str) -> DataFrame:
    """Cross-link records made of part; a line break within the linker's quotes, no participants where the size is a multiple of 5."""
    p = table(spark, d, "part")
    none, some = F.lit(""), F.col("p_size") % 5 != 0
    given = {0: F.col("p_partkey").cast("string"), 4: F.expr(_PEPTIDE), 6: F.concat("p_name", F.lit('"\n,')), 9: F.lit("0.5"), 10: F.col("p_retailprice").cast("string"), 14: F.lit("Inter-Protein"), 29: F.when(some, F.col("p_brand")).otherwise(none), 30: F.when(some & (F.col("p_size") % 3 != 0), F.col("p_type")).otherwise(none)}
    at = _place(spark, "x.csv")
    p.select(*(given.get(i, none).alias(f"h{i}") for i in range(32))).write.options(header=True, quote='"', escape='"', emptyValue="").csv(at)
    back = R.xlms(spark, at)
    return back.select("spectrum", "peptide_a", "peptide_b", F.expr("substr(linker, 1, length(linker) - 3)").alias("linker"), "score", "a", "b")


@query("SELECT query, target, round(CASE WHEN fident > 1 THEN fident / 100 ELSE fident END, 9) AS fident, alnlen, evalue, bits::DOUBLE AS bits, CASE WHEN qcov > 1 THEN qcov / 100 ELSE qcov END AS qcov, tcov FROM ara_prot_all_vs_all")
def read_alignments(spark: SparkSession, d: str) -> DataFrame:
    """All alignment rows by the names of the header, whose columns are in another order."""
    rows = table(spark, d, "ara_prot_all_vs_all")
    at = _delimited(rows.select("target", "query", "bits", "fident", "alnlen", "evalue", "tcov", "qcov"), _place(spark, "x.tsv"), "\t")
    return R.alignments(spark, at).select("query", "target", F.round("fident", 9).alias("fident"), "alnlen", "evalue", "bits", "qcov", "tcov")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, NULL::VARCHAR AS genes FROM supplier")
def read_by_name(spark: SparkSession, d: str) -> DataFrame:
    at = _delimited(table(spark, d, "supplier"), _place(spark, "x.tsv.gz"), "\t", compression="gzip")
    return R.by_name(spark, at, {"s_suppkey": "id", "Gene Names": "genes", "s_name": "name"})


_CODES = ("IDA", "TAS", "IEA", "EXP", "IC", "ISS", "IPI")
_ANN = f"""WITH g AS (SELECT ' locx' || p_size AS locus, CASE WHEN p_partkey % 11 = 0 THEN 'NOT|part_of' ELSE '' END AS q, 'GO:' || (p_partkey % 12) AS term, {list(_CODES)}[(p_partkey % {len(_CODES)})::INT + 1] AS code, CASE WHEN p_partkey % 4 = 0 THEN 'P' ELSE 'C' END AS aspect FROM part),
k AS (SELECT * FROM g WHERE aspect = 'C' AND NOT contains(q, 'NOT'))
"""


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.array(*map(F.lit, _CODES))[(key % len(_CODES)).cast("int")]
    line = F.concat_ws("\t", F.lit("D"), F.concat(F.lit(" locx"), "p_size"), "p_name", F.when(key % 11 == 0, "NOT|part_of").otherwise(""), F.concat(F.lit("GO:"), (key % 12).cast("string")), F.lit("R"), code, F.lit("w"), F.when(key % 4 == 0, "P").otherwise("C"))
    rows = table(spark, d, "part")
    return R.annotations(spark, _text(rows, F.explode(F.array(F.lit("!comment"), line, F.lit("short\tline"))), _place(spark, "x.gaf.gz"), compression="gzip"))[0]


@query(_ANN + "SELECT locus, term, code AS evidence_code FROM k")
def read_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d)


@query(
    _ANN
    + f""", t AS (SELECT 'GO:' || i AS term, i AS bit FROM range({len(fixed.COMPARTMENTS)}) AS r(i))
SELECT upper(trim(locus)) AS locus, coalesce(bit_or((1 << bit)::INT), 0) AS mask, max(CASE WHEN code IN {fixed.EXPERIMENTAL_CODES} THEN 3 WHEN code IN {fixed.CURATED_CODES} THEN 2 ELSE 1 END) AS weight FROM k LEFT JOIN t USING (term) GROUP BY 1"""
)
def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mask of compartments and greatest weight of evidence for each locus."""
    terms = spark.createDataFrame([(f"GO:{i}", c) for i, c in enumerate(fixed.COMPARTMENTS)], "term string, compartment string")
    return fixed.annotation_summary(_annotations(spark, d), terms)


@query("SELECT 'P' || p_partkey AS id, upper(md5(p_name) || md5(p_type) || md5(p_brand)) AS sequence FROM part UNION ALL SELECT 'S' || p_partkey, upper(md5(p_name) || md5(p_type) || md5(p_brand)) FROM part WHERE p_size % 2 = 0")
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences wrapped by the writer; headers hold > and, at even sizes, a second accession."""
    p = table(spark, d, "part")
    header = F.concat(F.lit("P"), "p_partkey", F.lit(" kinase A->B >x"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" secondary_acc=S"), "p_partkey")).otherwise(""))
    at = _place(spark, "x.fasta")
    sinks.write_fasta(p.select(header.alias("h"), F.upper(F.concat(F.md5("p_name"), F.md5("p_type"), F.md5("p_brand"))).alias("s")), at, "h", "s")
    return R.fasta(spark, at).select("id", "sequence")


@query("SELECT 'v' || vec_id AS id, 'marked' AS layout, list_transform(embedding, lambda x: round(x::DOUBLE, 5) + 0.0) AS vector FROM embeddings UNION ALL SELECT 'v' || vec_id, 'tabbed', list_transform(embedding, lambda x: round(x::DOUBLE, 5) + 0.0) FROM embeddings")
def read_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in both layouts; records of other sizes, one beside each vector, are rejects."""
    e = table(spark, d, "embeddings")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    name = F.concat(F.lit("v"), "vec_id")
    marked = _text(e, F.concat(F.lit(">"), name, F.lit("\n"), numbers, F.lit("\n>short\n1 2 x")), _place(spark, "x.vec"))
    tabbed = _text(e, F.explode(F.array(F.concat(name, F.lit("\t"), numbers), F.lit("short\t1 2"))), _place(spark, "x.tab"))
    good = [R.vectors(spark, at, 64, tab)[0].select("id", F.lit(layout).alias("layout"), "vector") for at, tab, layout in ((marked, False, "marked"), (tabbed, True, "tabbed"))]
    return good[0].unionByName(good[1]).withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 5)))


@query("SELECT n_regionkey + 1 AS n_tables, ['T' || n_nationkey] AS labels, [n_name] AS captions FROM nation")
def read_table_wraps(spark: SparkSession, d: str) -> DataFrame:
    """One article a nation, with tables that have no id, one of them with label and caption."""
    n = table(spark, d, "nation")
    article = F.concat(F.lit("<article><table-wrap><label>T"), "n_nationkey", F.lit("</label><caption><title>"), "n_name", F.lit("</title></caption></table-wrap>"), F.expr("repeat('<table-wrap/>', n_regionkey)"), F.lit("</article>"))
    at = _text(n, article, _place(spark, "xml"), maxRecordsPerFile="1")
    return R.table_wraps(spark, at).drop("source_file")


@query(f"SELECT participant_a_id AS a, participant_b_id AS b, CASE WHEN row_id % 3 = 0 THEN (row_id % 2)::INT WHEN row_id % 3 = 1 THEN evidence_count ELSE 1 END AS label FROM {C4} WHERE NOT regexp_matches(participant_a_id, '\\s') AND NOT regexp_matches(participant_b_id, '\\s') AND participant_a_id <> '' AND participant_b_id <> ''")
def read_pair_list(spark: SparkSession, d: str) -> DataFrame:
    """Label last, third or not given; header lines and comments among the lines are skipped."""
    rows = table(spark, d, C4).where("NOT participant_a_id RLIKE '[ \\\\s]' AND NOT participant_b_id RLIKE '[ \\\\s]' AND participant_a_id <> '' AND participant_b_id <> ''")
    r = F.col("row_id")
    label = F.when(r % 3 == 0, F.concat(F.lit(" x "), (r % 2).cast("string"))).when(r % 3 == 1, F.concat(F.lit(" "), F.col("evidence_count").cast("string"), F.lit(" x"))).otherwise("")
    line = F.concat("participant_a_id", F.lit(" "), "participant_b_id", label)
    return R.pair_list(spark, _text(rows, F.explode(F.array(F.lit("# note"), F.lit("Protein A B"), F.lit("alone"), line)), _place(spark, "x.pairs")))[0]


@query("SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation")
def read_id_map(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string"))))).alias("j"))  # 25 entries
    return R.id_map(spark, _text(whole, F.col("j"), _place(spark, "x.json")))


@query("SELECT n_name AS value, n_nationkey::BIGINT * 2 + 2 AS line_no FROM nation")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Physical numbers: each name behind a blank line, in one file."""
    n = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return L.numbered_lines(spark, _text(n, F.concat(F.lit("\n"), "n_name"), _place(spark, "x.txt"))).where("value <> ''").select("value", "line_no")


@query("SELECT r_regionkey, r_name FROM region")
def chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern matches nothing, the second the chunks of region."""
    root = _place(spark, "chunks")
    for k in range(2):
        table(spark, d, "region").where(F.col("r_regionkey") % 2 == k).write.parquet(f"{root}/part_{k}")
    return R.first_existing(spark, [f"{root}/chunk_*", f"{root}/part_*"])


@query("SELECT p_partkey, true AS known FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def feature_presence(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    have, lack = R.with_features(table(spark, d, "part").select("p_partkey"), features, "p_partkey")
    return have.withColumn("known", F.lit(True)).unionByName(lack.withColumn("known", F.lit(False)))


@query("SELECT layout, pair_id, hippie_score AS score, pmid_count AS label FROM tomato_positive_pairs_deduplicated CROSS JOIN (VALUES ('long'), ('short')) AS t(layout)")
def read_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Both prediction layouts."""
    rows = table(spark, d, "tomato_positive_pairs_deduplicated")
    out = []
    for layout, names in (("long", ("pair_id", "pred_score", "true_label")), ("short", ("name", "prediction", "label"))):
        at = _place(spark, f"{layout}.csv")
        rows.select(*(F.col(c).alias(n) for c, n in zip(("pair_id", "hippie_score", "pmid_count"), names))).write.option("header", True).csv(at)
        out.append(R.predictions(spark, at).withColumn("layout", F.lit(layout)))
    return out[0].unionByName(out[1])


@query("SELECT shard, o_orderkey FROM (SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // ((count(*) OVER () + 2) // 3))::INT AS shard FROM orders)")
def shards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey")
    parts = [R.shard(rows, [F.col("o_orderkey")], k, 3).withColumn("shard", F.lit(k)) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT source_id, evidence_id FROM (SELECT source_id, evidence_id, row_number() OVER (PARTITION BY source_id ORDER BY evidence_id) AS i FROM (SELECT DISTINCT source_id, evidence_id FROM combine_evidence)) WHERE (i - 1) % 20 = 0 AND i <= 20 * 5")
def source_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling report, so a limit is its feature: every 20th record of a source, five at most."""
    return R.per_source_sample(table(spark, d, "combine_evidence").select("source_id", "evidence_id").distinct(), "source_id", [F.col("evidence_id")], 20, 5)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(l_quantity) AS quantity, true AS small_files FROM lineitem GROUP BY ALL")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """lineitem in hive partitions, of at most 5,000 rows a file."""
    at = _place(spark, "partitioned")
    sinks.write_partitioned(table(spark, d, "lineitem"), at, ["l_returnflag", "l_linestatus"], rows_per_file=5_000)
    back = spark.read.parquet(at).withColumn("_file", F.input_file_name())
    files = back.groupBy("l_returnflag", "l_linestatus", "_file").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return files.groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n_rows"), F.sum("q").alias("quantity"), (F.max("n") <= 5_000).alias("small_files"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_name FROM customer")
def tsv_sink(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "tsv")
    sinks.write_tsv(table(spark, d, "customer"), at, ["c_custkey", "c_mktsegment", "c_name"])
    return spark.read.options(header=True, sep="\t").csv(at)


@query("""SELECT coalesce(nullif(regexp_replace(pair_id, '[\\t\\r\\n]', ' ', 'g'), ''), 'NA') AS pair_id, coalesce(nullif(regexp_replace(pmids, '[\\t\\r\\n]', ' ', 'g'), ''), 'NA') AS pmids, coalesce(evidence_count::VARCHAR, 'NA') AS evidence_count FROM tomato_positive_pairs_deduplicated""")
def sanitised_sink(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "sanitised")
    sinks.write_sanitised(table(spark, d, "tomato_positive_pairs_deduplicated").select("pair_id", "pmids", "evidence_count"), at)
    return spark.read.options(header=True, sep="\t", escape="\\").csv(at)


_ENDS = f"participant_a_id NOT IN ('', '-', 'NA', 'nan') AND participant_b_id NOT IN ('', '-', 'NA', 'nan')"


@query(
    f"""WITH l AS (SELECT DISTINCT participant_a_id AS id, 'L' || length(participant_a_id) AS locus FROM {C4} WHERE {_ENDS}),
r AS (SELECT participant_a_id AS a, participant_b_id AS b, 1 - (row_id % 2)::INT AS label, 'C' || (1 + row_id % 3) AS partition FROM {C4} WHERE {_ENDS})
SELECT r.a AS participant_a_id, r.b AS participant_b_id, r.label::VARCHAR AS label, r.partition, x.locus AS locus_a, y.locus AS locus_b FROM r LEFT JOIN l AS x ON x.id = r.a LEFT JOIN l AS y ON y.id = r.b"""
)
def benchmark_sink(spark: SparkSession, d: str) -> DataFrame:
    """Even rows as positives, odd ones as negatives, by partition."""
    rows = table(spark, d, C4).where(_ENDS).select("row_id", "participant_a_id", "participant_b_id", F.concat(F.lit("C"), 1 + F.col("row_id") % 3).alias("partition"))
    loci = rows.select(F.col("participant_a_id").alias("id")).distinct().withColumn("locus", F.concat(F.lit("L"), F.length("id")))
    at = _place(spark, "benchmark")
    sinks.write_benchmark(rows.where("row_id % 2 = 0").drop("row_id"), rows.where("row_id % 2 = 1").drop("row_id"), loci, at)
    return spark.read.options(header=True, sep="\t").csv(at).select("participant_a_id", "participant_b_id", "label", "partition", "locus_a", "locus_b")


_AUDIT = "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


@query(
    f"""WITH a AS ({_AUDIT}) SELECT 'tsv' AS kind, region || chr(9) || n AS line FROM a UNION ALL
SELECT 'markdown', unnest(['## Regions', '', '| region | n |', '| --- | --- |'] || (SELECT list('| ' || region || ' | ' || n || ' |' ORDER BY region) FROM a)) UNION ALL
SELECT 'json', '{{' || string_agg('"' || region || '": ' || n, ', ' ORDER BY region) || '}}' FROM a"""
)
def audits(spark: SparkSession, d: str) -> DataFrame:
    """An audit in its three forms, line by line."""
    metrics = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    at = _place(spark, "audit")
    sinks.audit_tsv(metrics, at)
    text = [("markdown", x) for x in sinks.audit_markdown(metrics, "Regions").splitlines()] + [("json", sinks.audit_json(metrics, "region", "n"))]
    rows = spark.read.options(header=True, sep="\t").csv(at).select(F.lit("tsv").alias("kind"), F.concat_ws("\t", "region", "n").alias("line"))
    return rows.unionByName(spark.createDataFrame(text, "kind string, line string"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    at = _text(table(spark, d, "nation"), F.col("n_name"), _place(spark, "files"), maxRecordsPerFile="1")
    return sinks.manifest(spark, at).where(~F.col("path").endswith("_SUCCESS"))


@query("SELECT length(n_name) + 1 AS size, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation, hashed by the executors."""
    return _manifest(spark, d).select("size", "sha256")


@query("SELECT sha256(n_name || chr(10)) AS sha256, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' WHEN n_nationkey % 5 = 1 THEN 'unknown' END AS what FROM nation WHERE n_nationkey % 5 < 2 UNION ALL SELECT NULL, 'missing'")
def checksum_gate(spark: SparkSession, d: str) -> DataFrame:
    """The files against a registry that has some wrong, lacks some, and names one that isn't there."""
    found = Workspace(spark, "manifest").save(_manifest(spark, d), "found")
    names = table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat("n_name", F.lit("\n")).cast("binary"), 256).alias("own"))
    listed = found.join(names, found.sha256 == names.own).where("n_nationkey % 5 <> 1")
    registry = listed.select("path", F.when(F.col("n_nationkey") % 5 == 0, "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("nowhere", "0")], "path string, sha256 string"))
    return G.checksums(found, registry).join(found.select("path", "sha256"), "path", "left").select("sha256", "what")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def resumed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """events as two deliveries, each read once, though the ingestion is started three times."""
    rows, root = table(spark, d, "events"), _place(spark, "ingest")
    for k in range(2):
        rows.where(F.col("event_id") % 2 == k).write.parquet(f"{root}/in/d{k}")
        for _ in range(k + 1):
            ingest.ingest(ingest.file_stream(spark, f"{root}/in/*", rows.schema), f"{root}/out", f"{root}/state", lambda b: b.select("event_id", "event_type")).awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT DISTINCT source_id, source_file FROM combine_evidence WHERE (source_id, source_file) NOT IN (SELECT (source_id, source_file) FROM phase2_progress WHERE lower(status) = 'completed' AND n_input % 2 = 0)")
def pending_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source files of the evidence that the manifest, of which only entries with even counts are taken, doesn't call completed."""
    keys = ["source_id", "source_file"]
    return ingest.pending(table(spark, d, "combine_evidence").select(*keys).distinct(), table(spark, d, "phase2_progress").where("n_input % 2 = 0"), keys)


QUERIES, SQL = CATALOGUE.queries, CATALOGUE.sql
