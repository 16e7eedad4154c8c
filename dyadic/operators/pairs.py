"""Evidence records to canonical pairs: keys, filters with reasons, consolidation, scores and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.functions import numeric as N
from dyadic.functions import text as X

#: Interaction types of core evidence, and types and methods that only show proximity.
CORE_TYPES = ("MI:0915", "MI:0914", "MI:0407", "MI:0217")
PROXIMITY_TYPES = ("MI:2364", "MI:0403")
PROXIMITY_METHODS = ("MI:0663", "MI:0416", "MI:1314", "MI:0813", "MI:2364", "MI:0403")


def canonical_key(a: str | Column, b: str | Column, sep: str = "|") -> Column:
    """The two ids in byte order; null where one is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.concat(F.least(a, b), F.lit(sep), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("NA")) for p in parts)), 256)


def waterfall(df: DataFrame, rules: dict[str, Column], out: str = "reason") -> DataFrame:
    """With the name of the first rule that holds for a row; null where none does. A rule that is null doesn't hold."""
    reason = F
    for name, rule in rules.items():
        reason = reason.when(rule, name)
    return df.withColumn(out, reason.otherwise(F.lit(None).cast("string")))


def core_rules(kind: Column, method: Column, negative: Column, taxa: tuple[Column, Column], molecules: tuple[Column, Column], taxon: int) -> dict[str, Column]:
    """Reasons for which a record isn't core physical evidence within one species, in order."""
    any_of = lambda c, terms: F.coalesce(c.rlike("|".join(terms)), F.lit(False))
    return {
        "negative": negative,
        "not_core": ~any_of(kind, CORE_TYPES),
        "proximity_type": any_of(kind, PROXIMITY_TYPES),
        "proximity_method": any_of(method, PROXIMITY_METHODS),
        "other_species": ~F.coalesce((taxa[0] == taxon) & (taxa[1] == taxon), F.lit(False)),
        "not_protein": (molecules[0] != "protein") | (molecules[1] != "protein"),
    }


def reason_counts(df: DataFrame, reason: str = "reason", kept: str = "kept") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))


def taxon_flags(a: Column, b: Column, plants: tuple[int, ...], holdout: tuple[int, ...]) -> dict[str, Column]:
    """same_species, both_plants, one_plant (exactly one) and holdout; null taxa give false."""
    plant = lambda c: F.coalesce(c.isin(*plants), F.lit(False))
    return {
        "same_species": F.coalesce(a == b, F.lit(False)),
        "both_plants": plant(a) & plant(b),
        "one_plant": plant(a) != plant(b),
        "holdout": F.coalesce(a.isin(*holdout) | b.isin(*holdout), F.lit(False)),
    }


def joined_set(c: Column, default: str | None = None) -> Column:
    """Aggregate: the distinct values that aren't missing, sorted and joined."""
    out = F.array_join(F.array_sort(F.collect_set(X.null_sentinel(c))), "|")
    return out if default is None else F.when(out == "", default).otherwise(out)


def consolidate(evidence: DataFrame, a: str, b: str, source: str, kind: str, method: str, pmid: str, year: str, record: str, score: str) -> DataFrame:
    """One row for each unordered pair with what its evidence says.

    Distinct values are sets within a pair, so partial aggregation keeps a pair's repetitions off the shuffle; their
    size is bounded by the vocabularies and by the publications of one pair. Record ids, as many as the rows,
    are cut to the first ten of each pair before they are shuffled.
    """
    pmids = F.collect_set(X.null_sentinel(F.col(pmid)))
    ends = [F.least(a, b).alias("participant_a_id"), F.greatest(a, b).alias("participant_b_id")]
    known = evidence.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    main = known.groupBy(*ends).agg(
        F.count("*").alias("evidence_count"),
        joined_set(F.col(source)).alias("sources"),
        joined_set(F.col(kind), default="physical").alias("interaction_types"),
        joined_set(F.col(method), default="unspecified").alias("detection_methods"),
        F.size(pmids).alias("pmid_count"),
        F.array_join(F.array_sort(pmids), "|").alias("pmids"),
        joined_set(F.col(year).cast("string")).alias("publication_years"),
        F.max(F.when(~F.isnan(F.col(score)), F.col(score))).alias("max_score"),
    )
    keys = ["participant_a_id", "participant_b_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_r"))
    first = known.select(*ends, X.null_sentinel(F.col(record)).alias("_r")).where("_r IS NOT NULL").distinct().withColumn("_at", place).where("_at <= 10")
    records = first.groupBy(*keys).agg(joined_set(F.col("_r")).alias("source_record_ids"))
    out = main.join(records, keys, "left").withColumn("source_record_ids", F.coalesce("source_record_ids", F.lit("")))
    return out.withColumn("pair_key", canonical_key(*keys)).withColumn("pair_type", F.when(F.col(keys[0]) == F.col(keys[1]), "homomer").otherwise("heteromer"))


def names(evidence: DataFrame, a: str, b: str, name_a: str, name_b: str, order: list[str], author: str | None = None, most: int = 5) -> DataFrame:
    """For each unordered pair the names in its first row by order, each with its own id, and its first most authors, sorted, joined."""
    known = evidence.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left = F.col(a) <= F.col(b)
    name = [X.null_sentinel(F.when(left, x).otherwise(y)) for x, y in ((F.col(name_a), F.col(name_b)), (F.col(name_b), F.col(name_a)))]
    first = F.min(F.struct(*order, *(c.alias(f"_{i}") for i, c in enumerate(name))))
    authors = [] if author is None else [F.array_join(F.slice(F.array_sort(F.collect_set(X.null_sentinel(F.col(author)))), 1, most), "|").alias("first_authors")]
    out = known.groupBy(F.least(a, b).alias("participant_a_id"), F.greatest(a, b).alias("participant_b_id")).agg(first.alias("_first"), *authors)
    return out.withColumns({"participant_a_name": F.col("_first._0"), "participant_b_name": F.col("_first._1")}).drop("_first")


def technique_totals(pairs: DataFrame, key: str, methods: Column, techniques: DataFrame) -> DataFrame:
    """key and the summed weight of its distinct canonical techniques; 1.0 where none is known.

    methods: array of names. techniques: raw_name (lower case), technique, weight, a small fixed table.
    """
    named = pairs.select(key, F.explode_outer(methods).alias("_m")).select(key, F.lower(X.strip_ws(F.col("_m"))).alias("raw_name"))
    known = named.join(techniques, "raw_name", "left").select(key, "technique", "weight").distinct()
    return known.groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(1.0)).alias("technique_total"))


def scored(pairs: DataFrame, studies: Column, techniques: Column) -> DataFrame:
    out = pairs.withColumn("score", N.confidence(F.greatest(studies, F.lit(1)), techniques))
    return out.withColumn("tier", N.tier(F.col("score")))


def tier_topology(pairs: DataFrame, a: str, b: str, tier: str) -> DataFrame:
    """Counts of each tier and of tiers high and medium together: pairs, heteromers, homomers, share, proteins.

    One pass: every pair goes to its own tier and, if it is one of the two, to their union.
    """
    spans = F.when(F.col(tier).isin("high", "medium"), F.array(F.col(tier), F.lit("high+medium"))).otherwise(F.array(F.col(tier)))
    rows = pairs.select(a, b, F.explode(spans).alias("tier"))
    n = rows.groupBy("tier").agg(F.count("*").alias("n_pairs"), F.count_if(F.col(a) != F.col(b)).alias("n_hetero"), F.count_if(F.col(a) == F.col(b)).alias("n_homo"))
    ends = rows.select("tier", F.explode(F.array(a, b)).alias("_p")).groupBy("tier").agg(F.count_distinct("_p").alias("n_proteins"))
    return n.join(ends, "tier").withColumn("pct_hetero", F.round(100 * F.col("n_hetero") / F.col("n_pairs"), 4))


def endpoint_degree(edges: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of edges at each end; a self pair counts once."""
    ends = edges.select(*by, F.explode(F.array_distinct(F.array(a, b))).alias("node"))
    return ends.where("node IS NOT NULL").groupBy(*by, "node").agg(F.count("*").alias("degree"))


def support_histogram(sets: DataFrame, keys: list[str], source: str) -> DataFrame:
    """How many keys are supported by how many distinct sources."""
    return sets.groupBy(*keys).agg(F.count_distinct(source).alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_keys"))


def semantics(genetic: Column, computational: Column, kind: Column, direct: Column, proximity: Column, physical: Column) -> Column:
    """What an interaction means: by the assay's nature, then the interaction type, then what the assay supports."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda *terms: yes(kind.rlike("|".join(terms)))
    by_type = F.when(yes(genetic), "genetic").when(yes(computational), "computational").when(has("MI:0407"), "direct_binary").when(has("MI:0914", "MI:0915"), "physical_association").when(has("MI:0462"), "functional")
    return by_type.when(yes(direct), "direct_binary").when(yes(proximity), "proximity").when(yes(physical), "physical_association").otherwise("unknown")
