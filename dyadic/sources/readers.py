"""Readers of the interaction, annotation, sequence and prediction formats.

Readers of records that can be malformed give (records, rejects); schemas are declared, never inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions import text as X
from dyadic.sources.lines import field, numbered_lines, split_records

ALIGNMENT_SCHEMA = "query string, target string, fident double, alnlen int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, evalue double, bits double, qlen int, tlen int, qcov double, tcov double"

#: Fields of the tab-separated interaction format, from 0.
MITAB = {"id_a": 0, "id_b": 1, "aliases_a": 4, "aliases_b": 5, "detection_method": 6, "first_author": 7, "publication": 8, "taxid_a": 9, "taxid_b": 10, "interaction_type": 11, "source_db": 12, "interaction_ids": 13, "confidence": 14, "type_a": 20, "type_b": 21, "created": 30, "updated": 31, "negative": 35}
TAB3 = {"biogrid_id": 0, "entrez_a": 1, "entrez_b": 2, "systematic_a": 5, "systematic_b": 6, "symbol_a": 7, "symbol_b": 8, "system": 11, "system_type": 12, "author": 13, "publication": 14, "taxid_a": 15, "taxid_b": 16, "throughput": 17, "score": 18, "swissprot_a": 23, "trembl_a": 24, "swissprot_b": 26, "trembl_b": 27}


#: A field of a comma-separated record behind its comma, quoted or not.
_CSV_FIELD = r',(?:"[^"]*+(?:""[^"]*+)*+"?[^,]*+|[^,]*+)'


def _columns(layout: dict[str, int]) -> list[Column]:
    return [X.null_sentinel(field(k)).alias(name) for name, k in layout.items()]


def _no_id(a: int, b: int) -> Column:
    empty = lambda k: F.get(F.col("f"), F.lit(k)).isin("", "-")
    return empty(a) & empty(b)


def mitab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """42 or more tab-separated fields; lines that start with # are headers."""
    good, bad = split_records(numbered_lines(spark, path), "\t", 42, ("#",), missing=_no_id(0, 1))
    return good.select("source_file", "line_no", *_columns(MITAB)), bad


def tab3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """37 or more tab-separated fields behind one header line; ids by precedence, first of a list."""
    good, bad = split_records(numbered_lines(spark, path), "\t", 37, header_lines=1)
    rows = good.select("source_file", "line_no", *_columns(TAB3))
    first = lambda c: X.item(F.col(c), 1)
    for side in "ab":
        ordered = [first(f"swissprot_{side}"), first(f"trembl_{side}"), first(f"systematic_{side}"), first(f"symbol_{side}"), first(f"entrez_{side}"), F.col("biogrid_id")]
        rows = rows.withColumn(f"id_{side}", X.first_of(*ordered))
    return rows, bad


def string_links(spark: SparkSession, path: str, full: bool, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blank-separated links behind a header line; the channels' places depend on the layout."""
    place = {"experimental": 3, "transferred": 4, "database": 5, "textmining": 7, "combined": 9} if full else {"experimental": 2, "database": 3, "textmining": 4, "combined": 5}
    # a compressed file is read by one task, and what follows is spread again
    lines = numbered_lines(spark, path)
    good, bad = split_records(lines.repartition(F.col("line_no")) if path.endswith(".gz") else lines, r"\s+", 10 if full else 6, header_lines=1)
    number = [field(k).try_cast("int").alias(name) for name, k in place.items()]
    rows = good.select("source_file", "line_no", X.without_prefix(field(0), [r"\d+"]).alias("a"), X.without_prefix(field(1), [r"\d+"]).alias("b"), *number)
    rows = rows.withColumns({c: F.regexp_replace(c, r"^\d+\.", "") for c in ("a", "b")})
    return (rows if most is None else rows.limit(most)), bad


def string_layout(path: str) -> bool:
    """Whether a file's name says that it has the full layout."""
    return "full" in path.rsplit("/", 1)[-1]


def xlms(spark: SparkSession, path: str) -> DataFrame:
    """The good records of xlms_records, without their places."""
    return xlms_records(spark, path)[0].drop("source_file", "record_no")


def xlms_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Quoted cross-link records of 32 or more fields, which may contain line breaks; the second participant is the first where it is missing.

    record_no counts a file's records, its header as 1; blank lines aren't counted. Short records, and those without both participants, are rejects.
    """
    schema = ", ".join(f"c{i} string" for i in range(32)) + ", _raw string"
    read = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_raw").csv(path)
    rows = read.select("*", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("_id"))
    # a file with line breaks inside records is read by one task, so its numbers are consecutive
    first = rows.groupBy("source_file").agg(F.min("_id").alias("_first"))
    text = F.regexp_replace("_raw", r"[\r\n]+$", "")
    n = F.size(F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_CSV_FIELD), F.lit(0)))
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    reason = F.when(n < 32, F.format_string("column count %d < 32", n)).when(given("c29").isNull() & given("c30").isNull(), "missing participants")
    whole = F.coalesce(text, F.concat_ws(",", *(F.coalesce(f"c{i}", F.lit("")) for i in range(32))))
    judged = rows.join(first, "source_file").withColumns({"record_no": F.col("_id") - F.col("_first") + 2, "reason": reason, "raw_record": whole})
    peptides = X.peptide_pair(F.col("c4"))
    good = judged.where("reason IS NULL").select("source_file", "record_no", F.col("c0").try_cast("bigint").alias("spectrum"), peptides["a"].alias("peptide_a"), peptides["b"].alias("peptide_b"), F.col("c6").alias("linker"), F.col("c9").try_cast("double").alias("e_value"), F.col("c10").try_cast("double").alias("score"), F.col("c14").alias("kind"), given("c29").alias("a"), F.coalesce(given("c30"), given("c29")).alias("b"))
    return good, judged.where("reason IS NOT NULL").select("source_file", "record_no", "reason", "raw_record")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated columns, by name where the first line is a header that names fident or pident, else 16 by position.

    pident is a percentage; fident, qcov and tcov are where they are above 1. A named file's missing columns are null, but coverages and evalue 0.
    """
    types = dict(x.split() for x in ALIGNMENT_SCHEMA.split(", "))
    head = spark.read.text(path).first()
    names = [x.strip().lower() for x in head[0].split("\t")] if head else []
    named = bool({"query", "target"} & set(names)) and bool({"fident", "pident"} & set(names))
    place = {n: names.index(n) for n in (*types, "pident") if n in names} if named else {n: i for i, n in enumerate(types)}
    rows = spark.read.schema(", ".join(f"c{i} string" for i in range(max(16, len(names))))).option("sep", "\t").csv(path)
    header = [F.coalesce(F.lower(F.trim(f"c{place[n]}")) == n, F.lit(False)) for n in ("query", "target") if n in place]
    rows = rows.where(~(header[0] & header[-1]))
    absent = {"qcov": 0.0, "tcov": 0.0, "evalue": 0.0}
    typed = {n: F.col(f"c{place[n]}").try_cast(kind) if n in place else F.lit(absent.get(n)).cast(kind) for n, kind in types.items()}
    fraction = lambda c: F.when(c > 1, c / 100).otherwise(c)
    typed |= {n: fraction(typed[n]) for n in ("fident", "qcov", "tcov")}
    if "fident" not in place:
        typed["fident"] = F.col(f"c{place['pident']}").try_cast("double") / 100
    return rows.select(*(c.alias(n) for n, c in typed.items()))


def by_name(spark: SparkSession, path: str, wanted: dict[str, str], sep: str = "\t") -> DataFrame:
    """Columns of a file with a header by name: source name to result name; a column that isn't there is null."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    return rows.select(*((F.col(f"`{k}`") if k in rows.columns else F.lit(None).cast("string")).alias(v) for k, v in wanted.items()))


def annotations(spark: SparkSession, path: str, aspect: str = "C") -> tuple[DataFrame, DataFrame]:
    """locus, term and evidence code of annotation lines of one aspect that aren't negated; lines with ! are comments. Lines of fewer than 9 fields are rejects."""
    good, bad = split_records(numbered_lines(spark, path), "\t", 9, ("!",))
    keep = (field(8) == aspect) & ~F.coalesce(field(3).contains("NOT"), F.lit(False))
    return good.where(keep).select(field(1).alias("locus"), field(4).alias("term"), field(6).alias("evidence_code")), bad


def _marked_records(spark: SparkSession, path: str) -> DataFrame:
    """source_file and value of records that begin with > at the start of a line, without that mark."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    return rows.where(~F.col("value").rlike(r"^\s*$"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, header and sequence of multi-line records; an id is the accession of db|ACC|NAME, else the header's first word.

    A record begins where a line begins with >. A header's secondary_acc= gives a second row with the same sequence.
    """
    records = _marked_records(spark, path)
    at = F.instr("value", "\n")
    header = X.strip_ws(F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value")))
    sequence = F.when(at > 0, F.regexp_replace(F.substring("value", at + 1, F.length("value")), r"\s+", "")).otherwise("")
    parsed = records.select(header.alias("header"), sequence.alias("sequence"))
    word = F.regexp_extract("header", r"^\S*", 0)
    first = F.when(word.rlike(r"^\w+\|[^|]+\|"), F.split(word, r"\|")[1]).otherwise(word)
    ids = F.array_compact(F.array(first, X.extract(F.col("header"), r"secondary_acc=(\S+)")))
    return parsed.select(F.explode(ids).alias("id"), "header", "sequence")


def vectors(spark: SparkSession, path: str, size: int, tabbed: bool = False) -> tuple[DataFrame, DataFrame]:
    """id and vector of records '>id' newline numbers, or of lines 'id' tab numbers; those that aren't size numbers are rejects."""
    if tabbed:
        rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("source_file"), "value")
    else:
        rows = _marked_records(spark, path)
    parts = F.split(X.strip_ws(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = rows.select("source_file", "value", parts[0].alias("id"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("_texts"))
    rows = rows.withColumn("vector", F.transform("_texts", lambda x: x.try_cast("float")))
    reason = F.when(F.size("vector") != size, F.format_string(f"%d numbers for {size}", F.size("vector"))).when(F.exists("vector", lambda x: x.isNull()), "not a number")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("id", "vector"), judged.where("reason IS NOT NULL").select("source_file", "id", "reason", F.col("value").alias("raw_record"))


def table_wraps(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n_tables, and the labels and caption titles or texts of an article's tables."""
    whole = spark.read.option("wholetext", True).text(path).withColumn("source_file", F.col("_metadata.file_path"))
    texts = lambda at: F.xpath("value", F.lit(f"//table-wrap/{at}/text()"))
    count = F.xpath_int("value", F.lit("count(//table-wrap)"))
    return whole.select("source_file", count.alias("n_tables"), texts("label").alias("labels"), texts("caption//*").alias("captions"))


def pair_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """a, b and label of blank-separated lines: the last word where it is 0 or 1, else the third where it is a number, else 1. Lines of one word are rejects."""
    good, bad = split_records(numbered_lines(spark, path), r"\s+", 2, ("#", "Protein", "participant_a_id"))
    last = F.element_at("f", -1)
    label = F.when((F.size("f") > 2) & last.isin("0", "1"), last.cast("int")).otherwise(F.coalesce(F.get(F.col("f"), F.lit(2)).try_cast("int"), F.lit(1)))
    return good.select(field(0).alias("a"), field(1).alias("b"), label.alias("label")), bad


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a JSON object."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")))


def first_existing(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """The Parquet files of the first pattern that matches any."""
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            return spark.read.parquet(pattern)
    raise FileNotFoundError(", ".join(patterns))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, score and label of either prediction layout."""
    rows = spark.read.option("header", True).csv(path)
    names = ("pair_id", "pred_score", "true_label") if "pred_score" in rows.columns else ("name", "prediction", "label")
    return rows.select(F.col(names[0]).alias("pair_id"), F.col(names[1]).try_cast("double").alias("score"), F.col(names[2]).try_cast("int").alias("label"))


def with_features(ids: DataFrame, features: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The ids that have features, and those that lack them."""
    known = features.select(key)
    return ids.join(known, key, "left_semi"), ids.join(known, key, "left_anti")


def shard(df: DataFrame, order: Sequence[Column], k: int, of: int) -> DataFrame:
    """The k-th (from 0) of contiguous slices of ceil(n / of) rows."""
    from dyadic.operators.ordering import ranked

    size = -(-df.count() // of)
    return ranked(df, [], order, "_i").where(F.floor((F.col("_i") - 1) / max(1, size)) == k).drop("_i")


def per_source_sample(df: DataFrame, source: str, order: Sequence[Column], step: int, most: int) -> DataFrame:
    """Every step-th row of each source, at most so many of each."""
    from dyadic.operators.ordering import ranked

    return ranked(df, [source], order, "_i").where(((F.col("_i") - 1) % step == 0) & (F.col("_i") <= step * most)).drop("_i")
