"""Text expressions over raw interaction records; all are columns, none is a Python function over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that stand for null in one file format or another.
SENTINELS = ("", "-", "NA", "nan", "None")


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_sentinel(c: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    return F.when(~c.isin(*sentinels), c)


def item(c: Column, k: int, sep: str = r"\|") -> Column:
    """The k-th of the separated items, from 1, or from the end if negative; null where there is none."""
    return F.try_element_at(F.split(c, sep), F.lit(k))


def namespace(c: Column) -> Column:
    """struct(namespace, value), split at the first colon; without one unresolved, and null for a missing text."""
    whole = null_sentinel(strip_ws(c))
    at = F.instr(whole, ":")
    return F.when(whole.isNotNull(), F.struct(F.when(at > 0, F.substring_index(whole, ":", 1)).otherwise("unresolved").alias("namespace"), F.when(at > 0, F.substring(whole, at + 1, F.length(whole))).otherwise(whole).alias("value")))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null, not an empty text, where nothing matches."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def mi_accession(c: Column) -> Column:
    return extract(c, r"(MI:\d{4})")


def mi_name(c: Column) -> Column:
    return extract(c, r"\(([^()]+)\)\s*$")


def taxon_id(c: Column) -> Column:
    return extract(c, r"taxid:(-?\d+)").try_cast("int")


def year(c: Column) -> Column:
    return extract(c, r"\b((?:19|20)\d{2})\b").try_cast("int")


def mi_score(c: Column) -> Column:
    return extract(c, r"intact-miscore:([0-9.]+)").try_cast("double")


def epoch(c: Column) -> Column:
    """The number of a checkpoint's epoch in its name."""
    return extract(c, r"epoch[=_-]?(\d+)").try_cast("int")


def auprc(c: Column) -> Column:
    """The AUPRC in a checkpoint's name."""
    return extract(c, r"(?i)auprc[=_-]?(\d+(?:\.\d+)?)").try_cast("double")


def without_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    """Without a leading prefix and colon, letter case aside."""
    return F.regexp_replace(c, f"(?i)^(?:{'|'.join(prefixes)}):", "")


def isoform_base(c: Column) -> Column:
    """An accession without its isoform number."""
    return F.regexp_replace(c, r"-\d+$", "")


def peptide_pair(c: Column) -> Column:
    """struct(a, b) of linked peptides, split behind the first ')' that a hyphen follows; without it, all is a."""
    at = F.instr(c, ")-")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at)).otherwise(c).alias("a"), F.when(at > 0, F.substring(c, at + 2, F.length(c))).alias("b"))


def tagged_item(c: Column, tags: Sequence[str], sep: str = r"\|") -> Column:
    """Of the separated items the first that holds one of the tags, else the first."""
    items = F.split(c, sep)
    has = lambda x: F.exists(F.array(*map(F.lit, tags)), lambda t: x.contains(t))
    return F.coalesce(F.try_element_at(F.filter(items, has), F.lit(1)), F.try_element_at(items, F.lit(1)))


def gene_symbol(aliases: Column) -> Column:
    """The value of the first alias that is a gene name or a short display name, else of the first alias."""
    return namespace(F.regexp_replace(tagged_item(aliases, ("(gene name)", "(display_short)")), r"\([^()]*\)$", ""))["value"]


def first_of(*candidates: Column) -> Column:
    """Identifier precedence: the first candidate that isn't missing."""
    return F.coalesce(*(null_sentinel(c) for c in candidates))


def throughput_class(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("high"), "high").when(low.contains("low"), "low").otherwise("unknown")


#: What a molecule's type text holds, in the order in which it is tested.
MOLECULE_TERMS = (
    ("small_molecule", ("mi:0328", "small molecule", "chebi")),
    ("dna", ("mi:0319", "mi:0681", "deoxyribonucleic")),
    ("rna", ("mi:0320", "ribonucleic")),
    ("nucleic_acid", ("mi:0318", "nucleic acid")),
    ("gene", ("mi:0250", "gene")),
    ("molecule_set", ("mi:1304", "molecule set")),
    ("protein", ("mi:0326", "protein", "mi:0327", "peptide")),
)


def molecule_type(kind: Column, raw_id: Column) -> Column:
    low, out = F.lower(F.coalesce(kind, F.lit(""))), F
    for name, terms in MOLECULE_TERMS:
        test = F.lit(False)
        for t in terms:
            test = test | low.contains(t)
        out = out.when(test | F.coalesce(F.lower(raw_id).contains("chebi"), F.lit(False)) if name == "small_molecule" else test, name)
    return out.when(F.coalesce(raw_id, F.lit("")).isin("", "-"), "missing").otherwise("protein")


def json_row(fields: dict[str, Column]) -> Column:
    """A JSON object of texts, names in the given order; null fields are left out."""
    return F.to_json(F.struct(*(c.cast("string").alias(name) for name, c in fields.items())))


def surrogate_key(prefix: Column | str, number: Column, width: int = 8) -> Column:
    return F.format_string(f"%s_%0{width}d", F.lit(prefix) if isinstance(prefix, str) else prefix, number)


def sanitised(df: DataFrame) -> DataFrame:
    """All columns as text for export: null and empty as NA, booleans in capitals, tabs and line ends as blanks."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.upper(c.cast("string")) if kind == "boolean" else F.regexp_replace(c.cast("string"), r"[\t\r\n]", " ")
        out.append(F.coalesce(F.when(text != "", text), F.lit("NA")).alias(name))
    return df.select(*out)
