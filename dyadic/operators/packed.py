"""Splits packed fields into one value per row (problem 2), by a parsing expression grammar.

    field     <- (value / unclosed / malformed)*
    value     <- quoted(") / quoted(') / bracketed / bare
    quoted(q) <- q (!q . / q q)* q &(blank* (separator / end))
    bracketed <- (plain / reference / slash / blank+ &(plain / "("))* group rest
    group     <- "(" inner ")" / "[" inner "]" / "{" inner "}"
    bare      <- unit+ rest
    rest      <- (unit / blank+ &unit)*
    unit      <- reference / plain / bracket / slash
    plain     <- (letter / digit / [-.:'])+
    reference <- &(after ":") '"MI:' digit+ '"' ("(" (!")" .)* ")")?
    slash     <- "/" without a blank before or after it
    unclosed  <- '"' where a value may begin, and no quote behind it
    malformed <- &('"' where a value may begin, and a quote behind it)

An opening quote without a fitting end makes the quoted alternative fail; the parser goes back to the quote and reads
on with the next alternative. The value that follows is flagged unclosed_quote where the field has no other quote behind it,
and malformed_quote where it has one, but with more of the value beside it. A bracket without its counterpart makes
the bracketed alternative fail in the same way; the bare value is flagged unclosed_bracket or unopened_bracket. Everything that
is no value separates. The grammar runs as one regular expression inside the JVM, once for a field: a scan, projections and
two generators, without shuffle or Python.

Null, empty and missing fields (-, NA, nan) give no rows, nor do missing values within a field, which aren't
counted either. Repeated rows are split as often as they come. A text of any length is read whole. Only the
key and the fields are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.peg import END, Rule, ahead, behind, choice, many, maybe, none_of, not_ahead, not_behind, one_of, some, text
from dyadic.session import MISSING

PLAIN = r"\p{L}\p{M}\p{N}\-.:'"
BRACKETS = r"()\[\]{}"
BLANK = one_of(" ")


def grammar(blanks_separate: bool = False) -> Rule:
    """A value, or the mark of a quote that doesn't enclose one."""
    slash = not_behind(one_of(r"\s")) + text("/") + not_ahead(one_of(r"\s"))
    parting = (behind(one_of(r"\s")) + text("/")) / (text("/") + ahead(one_of(r"\s")))
    other = none_of(f"{PLAIN}{BRACKETS}/" + ("" if blanks_separate else " "))
    follows = ahead((Rule("") if blanks_separate else many(BLANK)) + (END / other / parting))

    def quoted(q: str) -> Rule:
        return text(q) + many(none_of(q)) + many(text(q + q) + many(none_of(q))) + text(q) + follows

    reference = behind(text(":")) + text('"MI:') + some(one_of("0-9")) + text('"') + maybe(text("(") + many(none_of("()")) + text(")"))
    plain = some(one_of(PLAIN))
    unit = reference / plain / some(one_of(BRACKETS)) / slash
    blanks = lambda follower: [] if blanks_separate else [some(BLANK) + ahead(follower)]
    rest = many(choice(unit, *blanks(unit)))
    openers = one_of(r"(\[{")

    def group(left: str, right: str) -> Rule:
        return text(left) + many(choice(plain, slash, *blanks(plain / text(right)))) + text(right)

    groups = choice(group("(", ")"), group("[", "]"), group("{", "}"))
    # bracketed and bare begin alike, so what they share is read once before the choice
    lead = choice(reference, plain, slash) + many(choice(reference, plain, slash, *blanks(plain / openers)))
    bracketed, bare = groups + rest, some(one_of(BRACKETS)) + rest
    opening = not_behind(one_of(PLAIN + BRACKETS)) + text('"')
    later = many(none_of('"')) + text('"')
    return choice(quoted('"'), quoted("'"), lead + choice(bracketed, rest), bracketed, bare, opening + not_ahead(later), ahead(opening + later))


_TRIM = r"^\s+|\s+$"
#: What an enclosed value, a closed group, and a bracket look like in the text of a value.
_DOUBLE, _SINGLE = r'^"[^"]*(?:""[^"]*)*"$', r"^'[^']*(?:''[^']*)*'$"
_CLOSED = r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}"


def matches(field: Column, blanks_separate: bool = False) -> Column:
    """Array of what the grammar finds in field, in order."""
    return F.regexp_extract_all(field, F.lit(grammar(blanks_separate).pattern), F.lit(0))


def values_of(found: Column, labels: bool = True) -> Column:
    """Array of (value and, with labels, alternative and error) of matches(), missing values left out."""

    def value(m: Column, before: Column) -> Column:
        # tests that a first character decides come first, so that most values meet no pattern
        double, single = m.startswith('"') & (F.length(m) > 1) & m.rlike(_DOUBLE), m.startswith("'") & (F.length(m) > 1) & m.rlike(_SINGLE)
        inner = F.substring(m, F.lit(2), F.length(m) - 2)
        enclosed = lambda q: F.regexp_replace(F.replace(inner, F.lit(q + q), F.lit(q)), _TRIM, "")
        # other values begin and end with what belongs to them
        parts = [F.when(double, enclosed('"')).when(single, enclosed("'")).otherwise(m).alias("value"), m.isin("", '"').alias("mark")]
        if labels:
            parts.append(F.when(double | single, "quoted").when(m.rlike(_CLOSED), "bracketed").otherwise("bare").alias("alternative"))
            open_ended = m
            for _ in range(4):  # groups within groups
                open_ended = F.regexp_replace(open_ended, _CLOSED, "")
            bracket = F.when(~(double | single) & m.rlike(r"[()\[\]{}]"), F.when(open_ended.rlike(r"[(\[{]"), "unclosed_bracket").when(open_ended.rlike(r"[)\]}]"), "unopened_bracket"))
            parts.append(F.when((before == '"') | (~single & m.startswith("'")), "unclosed_quote").when(before == "", "malformed_quote").otherwise(bracket).alias("error"))
        return F.struct(*parts)

    if not labels:
        return F.filter(F.transform(found, lambda m: value(m, m)), lambda x: ~x["mark"] & ~x["value"].isin(*MISSING))
    # each match beside the one before it; the last match stands alone at the end, and its null value goes with the filter
    beside = F.zip_with(found, F.concat(F.array(F.lit("-")), found), value)
    return F.filter(beside, lambda x: ~x["mark"] & ~x["value"].isin(*MISSING))


def unpack(df: DataFrame, key: str, fields: dict[str, bool], labels: bool = True) -> DataFrame:
    """A row for each value: key, field_name, value_no (from 1), field_value and, with labels, alternative and error.

    fields: names of the packed columns, and whether blanks separate in them.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), matches(F.col(f), blanks).alias("_found")) for f, blanks in fields.items()))
    return (
        df.select(key, *fields)
        .select(key, F.inline(each))
        .select(key, "field_name", F.posexplode(values_of(F.col("_found"), labels)).alias("_at", "_v"))
        .select(key, "field_name", (F.col("_at") + 1).alias("value_no"), F.col("_v.value").alias("field_value"), *(F.col(f"_v.{x}").alias(x) for x in ("alternative", "error") if labels))
    )
