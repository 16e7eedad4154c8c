"""Arithmetic expressions: scores, masks, packed edges, vectors, crops, confusion measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the confidence score: slope and weight of studies, techniques and other organisms; least scores of the tiers.
SLOPES = {"studies": 2.3, "techniques": 0.2, "organisms": 1.6}
WEIGHTS = {"studies": 0.6, "techniques": 0.3, "organisms": 0.1}
TIERS = (("high", 0.72), ("medium", 0.62))


def saturating(n: Column, slope: float) -> Column:
    return F.when(n > 0, 2 / (1 + F.exp(-slope * n)) - 1).otherwise(0.0)


def confidence(studies: Column, techniques: Column, organisms: Column | None = None) -> Column:
    parts = {"studies": studies, "techniques": techniques, "organisms": F.lit(0) if organisms is None else organisms}
    return sum((WEIGHTS[k] * saturating(c, SLOPES[k]) for k, c in parts.items()), F.lit(0.0))


def tier(score: Column) -> Column:
    out = F
    for name, least in TIERS:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def fixed4(score: Column) -> Column:
    return F.format_string("%.4f", score)


def packed_edge(a: Column, b: Column) -> Column:
    """Two ids below 2^31 in one bigint, the smaller in the upper half."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long"))


def unpacked_edge(e: Column) -> tuple[Column, Column]:
    return F.shiftright(e, 32), e.bitwiseAND(F.lit(0xFFFFFFFF))


def bits_set(bit: Column) -> Column:
    """Aggregate: the mask in which the given bits, below 31, are set; null bits are left out."""
    return F.bit_or(F.pow(F.lit(2), bit).cast("int"))


def mask_names(mask: Column, names: Sequence[str], sep: str = "|") -> Column:
    given = F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)))
    return F.array_join(given, sep)


def crop_lengths(a: Column, b: Column, most: int = 1020, least: int = 50) -> tuple[Column, Column]:
    """Lengths to which two sequences are cropped so that together they take most, in proportion."""
    over = a + b > most
    first = F.greatest(F.lit(least), F.floor(most * a / (a + b)))
    return F.when(over, F.least(a, first)).otherwise(a), F.when(over, F.least(b, F.greatest(F.lit(least), most - first))).otherwise(b)


def spiral(rank: Column, angle: float = 2.399963229728653) -> tuple[Column, Column]:
    """Place of the rank-th point, from 0, of a golden-angle spiral."""
    return F.sqrt(rank) * F.cos(rank * angle), F.sqrt(rank) * F.sin(rank * angle)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def pair_features(a: Column, b: Column) -> Column:
    """Absolute differences and products of two vectors, one after the other; the same for both orders."""
    return F.concat(abs_difference(a, b), product(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def confusion_measures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
