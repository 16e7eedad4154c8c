"""Fixed values of published definitions, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions.numeric import bits_set

#: Names of detection techniques, the technique that each means, and its weight.
TECHNIQUE_WEIGHTS = (
    ("two-hybrid", "two-hybrid", 5.0),
    ("two hybrid", "two-hybrid", 5.0),
    ("two hybrid array", "two hybrid array", 5.0),
    ("two hybrid fragment pooling approach", "two hybrid fragment pooling approach", 5.0),
    ("two hybrid prey pooling approach", "two hybrid fragment pooling approach", 5.0),
    ("validated two hybrid", "validated two hybrid", 5.0),
    ("cr-two hybrid", "cr-two hybrid", 5.0),
    ("reverse two hybrid", "reverse two hybrid", 5.0),
    ("three hybrid", "three hybrid", 5.0),
    ("protein three hybrid", "protein three hybrid", 5.0),
    ("co-fractionation", "co-fractionation", 1.0),
    ("co-purification", "co-purification", 2.0),
    ("copurification", "co-purification", 2.0),
    ("blue native page", "blue native page", 3.0),
    ("comigration in gel electrophoresis", "comigration in gel electrophoresis", 3.0),
    ("comigration in non denaturing gel electrophoresis", "comigration in non denaturing gel electrophoresis", 3.0),
    ("molecular sieving", "molecular sieving", 2.0),
    ("cosedimentation in solution", "cosedimentation in solution", 2.0),
    ("cosedimentation through density gradient", "cosedimentation through density gradient", 2.0),
    ("co-crystal structure", "co-crystal structure", 10.0),
    ("x-ray crystallography", "x-ray crystallography", 10.0),
    ("reconstituted complex", "reconstituted complex", 10.0),
    ("surface plasmon resonance", "surface plasmon resonance", 10.0),
    ("isothermal titration calorimetry", "isothermal titration calorimetry", 10.0),
    ("nuclear magnetic resonance", "nuclear magnetic resonance", 10.0),
    ("light scattering", "light scattering", 10.0),
    ("x ray scattering", "x ray scattering", 9.0),
    ("biochemical activity", "biochemical activity", 5.0),
    ("biochemical", "biochemical", 1.0),
    ("biophysical", "biophysical", 1.0),
    ("protein kinase assay", "protein kinase assay", 7.5),
    ("in-gel kinase assay", "in-gel kinase assay", 7.5),
    ("enzymatic study", "enzymatic study", 1.0),
    ("enzyme linked immunosorbent assay", "enzyme linked immunosorbent assay", 5.0),
    ("chromatin immunoprecipitation assay", "chromatin immunoprecipitation assay", 2.0),
    ("electrophoretic mobility shift assay", "electrophoretic mobility shift assay", 2.0),
    ("affinity capture-ms", "affinity capture-ms", 5.0),
    ("tandem affinity purification", "tandem affinity purification", 5.0),
    ("affinity capture-western", "affinity capture-western", 5.0),
    ("affinity capture-luminescence", "affinity capture-luminescence", 5.0),
    ("affinity capture-rna", "affinity capture-rna", 2.0),
    ("affinity chromatography technology", "affinity chromatography technology", 5.0),
    ("affinity technology", "affinity technology", 5.0),
    ("anti bait coimmunoprecipitation", "anti bait coimmunoprecipitation", 5.0),
    ("anti tag coimmunoprecipitation", "anti tag coimmunoprecipitation", 5.0),
    ("coimmunoprecipitation", "coimmunoprecipitation", 5.0),
    ("pull down", "pull down", 2.5),
    ("cross-linking study", "cross-linking study", 5.0),
    ("cross-linking-ms (xl-ms)", "cross-linking study", 5.0),
    ("protein cross-linking with a bifunctional reagent", "protein cross-linking with a bifunctional reagent", 5.0),
    ("fret", "fret", 6.0),
    ("fluorescent resonance energy transfer", "fret", 6.0),
    ("classical fluorescence spectroscopy", "classical fluorescence spectroscopy", 7.5),
    ("far western blotting", "far western blotting", 5.0),
    ("far western", "far western blotting", 5.0),
    ("solid phase assay", "solid phase assay", 1.0),
    ("protein array", "protein array", 5.0),
    ("filter binding", "filter binding", 5.0),
    ("phage display", "phage display", 6.0),
    ("lambda phage display", "lambda phage display", 6.0),
    ("electron microscopy", "electron microscopy", 5.0),
    ("competition binding", "competition binding", 5.0),
    ("protein-peptide", "protein-peptide", 5.0),
    ("protein-rna", "protein-rna", 0.0),
    ("experimental interaction detection", "experimental interaction detection", 1.0),
    ("protein complementation assay", "protein complementation assay", 5.0),
    ("pca", "protein complementation assay", 5.0),
    ("bimolecular fluorescence complementation", "bimolecular fluorescence complementation", 5.0),
    ("bifc", "bimolecular fluorescence complementation", 5.0),
    ("ubiquitin reconstruction", "ubiquitin reconstruction", 5.0),
    ("split firefly luciferase complementation", "split firefly luciferase complementation", 5.0),
    ("split renilla luciferase complementation", "split renilla luciferase complementation", 5.0),
    ("fluorescent protein-protein interaction-visualization", "fluorescent protein-protein interaction-visualization", 5.0),
    ("reverse ras recruitment system", "reverse ras recruitment system", 5.0),
)

#: Compartments in the order of their bits; evidence codes of experiments and of curators.
COMPARTMENTS = ("nucleus", "cytosol_cytoplasm", "chloroplast_plastid", "mitochondrion", "plasma_membrane", "endoplasmic_reticulum", "golgi_apparatus", "vacuole", "peroxisome", "extracellular_apoplast")
EXPERIMENTAL_CODES = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")
CURATED_CODES = ("TAS", "NAS", "IC")


def techniques(spark: SparkSession) -> DataFrame:
    """raw_name, technique and weight."""
    return spark.createDataFrame(list(TECHNIQUE_WEIGHTS), "raw_name string, technique string, weight double")


def evidence_weight(code: Column) -> Column:
    clean = F.upper(F.trim(code))
    return F.when(clean.isin(*EXPERIMENTAL_CODES), 3).when(clean.isin(*CURATED_CODES), 2).otherwise(1)


def compartment_bit(name: Column) -> Column:
    """The number of a compartment's bit; null for other names."""
    place = F.array_position(F.array(*map(F.lit, COMPARTMENTS)), name)
    return F.when(place > 0, place - 1)


def annotation_summary(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """locus, mask of its compartments (0 where none is known) and weight of its best evidence.

    annotations: locus, term, evidence_code. terms: term, compartment, a given table.
    """
    rows = annotations.withColumn("locus", F.upper(F.trim("locus"))).join(terms, "term", "left")
    mask = bits_set(compartment_bit(F.col("compartment")))
    return rows.groupBy("locus").agg(F.coalesce(mask, F.lit(0)).alias("mask"), F.max(evidence_weight(F.col("evidence_code"))).alias("weight"))


def priority_score(weights: tuple[Column, Column], lengths: tuple[Column, Column]) -> Column:
    """Evidence before length: the sum of the weights times 10^7, plus the sum of the lengths; null counts 1 and 0."""
    w = sum((F.coalesce(x, F.lit(1)) for x in weights), F.lit(0))
    return w.cast("long") * 10_000_000 + sum((F.coalesce(x, F.lit(0)) for x in lengths), F.lit(0))
