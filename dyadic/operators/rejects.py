"""Separates rows that fail to parse from those that load (problem 5).

Lines are parsed in Arrow batches by pyarrow's CSV reader with an invalid-row callback: a line goes in behind its
number in the batch, so the callback names the lines with a wrong number of fields, and the others come out as
columns of text. Vector expressions then check the fields and label the first that fails; a method that is neither missing
nor a reference is looked up in the vocabulary by a join afterwards. A text with an odd number of
double quotes never reaches the reader, which could take the next line for its rest; one with an even number of which
the last opens a field is split here.

Blank lines and lines that start with # are no records. A null line is a blank one. A line's end (CR, LF) isn't
part of it; line breaks inside it are. Repeated line ids are judged line by line. Columns of evidence are checked
inside the JVM. All of it is one pass without a shuffle, apart from making failed keys distinct and counting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.session import ship_package

#: What a readable term may look like, besides the known words; and numbers.
REFERENCE = r'psi-mi:"MI:[0-9]{4}"\([^()]+\)'
INTERACTION_WORDS = ("physical", "genetic")
NO_TERM = ("", "-", "NA")
NUMBER = r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
MITAB_FIELDS, XLMS_FIELDS = 42, 32
#: A field of a comma-separated line: quoted, or up to the next comma. The closed ones end their quotes.
_FIELD = re.compile(r',("(?:[^"]|"")*"[^,]*|[^,]*)')
_CLOSED = re.compile(r'(?:,(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+))++')
_CHECKED = (0, 9, 10, 14, 29, 30)
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
LAYOUTS = ("mitab27", "xlms_csv")
REASONS = (None, "column_count", "missing_participants", "invalid_value", "broken_quoting", "unknown_layout")

#: The checked fields, typed (numbers of any length are texts of digits), and all fields of the line as texts, 42 or 32, in its order.
LOADED = T.StructType([T.StructField("participant_a", T.StringType()), T.StructField("participant_b", T.StringType()), T.StructField("detection_method", T.StringType()), T.StructField("interaction_type", T.StringType()), T.StructField("taxon_a", T.StringType()), T.StructField("taxon_b", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("recorded_on", T.DateType()), T.StructField("updated_on", T.DateType()), T.StructField("is_negative", T.BooleanType()), T.StructField("spectrum_no", T.StringType()), T.StructField("e_value", T.DoubleType()), T.StructField("is_inter_protein", T.BooleanType()), T.StructField("fields", T.ArrayType(T.StringType()))])
_ARROW = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.DateType(): pa.date32(), T.BooleanType(): pa.bool_(), T.ArrayType(T.StringType()): pa.list_(pa.string())}


def _full(column: pa.ChunkedArray, pattern: str) -> pa.ChunkedArray:
    return pc.match_substring_regex(column, rf"\A(?:{pattern})\z")


def _in(column: pa.ChunkedArray, words: tuple[str, ...]) -> pa.ChunkedArray:
    return pc.is_in(column, value_set=pa.array(words, pa.string()))


def _any(*tests: pa.ChunkedArray) -> pa.ChunkedArray:
    out = tests[0]
    for t in tests[1:]:
        out = pc.or_(out, t)
    return out


def _all(*tests: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.invert(_any(*(pc.invert(t) for t in tests)))


def _readable(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Missing, or a reference."""
    return _any(_in(column, NO_TERM), _full(column, REFERENCE))


def _number(column: pa.ChunkedArray, sign: str = "[+-]?") -> pa.ChunkedArray:
    """As double; null where it isn't one."""
    return pc.if_else(_full(column, sign + NUMBER), column, pa.scalar(None, pa.string())).cast(pa.float64())


def _whole(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The digits; null where there is anything else."""
    return pc.if_else(_full(column, "[0-9]+"), column, pa.scalar(None, pa.string()))


def _date(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """As date; null where it isn't a real one."""
    shaped = pc.if_else(_full(column, "[0-9]{4}/[0-9]{2}/[0-9]{2}"), column, pa.scalar(None, pa.string()))
    at = pc.strptime(shaped, format="%Y/%m/%d", unit="s", error_is_null=True)
    return pc.if_else(pc.fill_null(pc.equal(pc.strftime(at, format="%Y/%m/%d"), shaped), False), at, pa.scalar(None, at.type)).cast(pa.date32())


def _mitab(c: list[pa.ChunkedArray]) -> tuple[pa.ChunkedArray, pa.ChunkedArray, dict[str, pa.ChunkedArray]]:
    none = ("", "-")
    lost = _all(_in(c[0], none), _in(c[1], none))
    taxon = r"-|taxid:[0-9]+(\([^()]+\))?"
    score = _number(pc.replace_substring_regex(c[14], r"\Aintact-miscore:", ""), "")
    scored = _all(pc.match_substring_regex(c[14], r"\Aintact-miscore:"), pc.fill_null(pc.and_(pc.greater_equal(score, 0.0), pc.less_equal(score, 1.0)), False))
    dates = [_date(x) for x in (c[30], c[31])]
    good = _all(_any(_readable(c[11]), _in(pc.utf8_lower(c[11]), INTERACTION_WORDS)), _full(c[9], taxon), _full(c[10], taxon), _any(_in(c[14], ("-",)), scored), *(_any(_in(x, ("-",)), pc.is_valid(d)) for x, d in zip((c[30], c[31]), dates)), _in(c[35], ("-", "true", "false")))
    digits = [_whole(pc.replace_substring_regex(pc.replace_substring_regex(x, r"\Ataxid:", ""), r"\(.*\z", "")) for x in (c[9], c[10])]
    negative = pc.if_else(_in(c[35], ("-",)), pa.scalar(None, pa.bool_()), pc.equal(c[35], "true"))
    return lost, good, {"participant_a": c[0], "participant_b": c[1], "detection_method": c[6], "interaction_type": c[11], "taxon_a": digits[0], "taxon_b": digits[1], "score": score, "recorded_on": dates[0], "updated_on": dates[1], "is_negative": negative}


def _xlms(c: list[pa.ChunkedArray]) -> tuple[pa.ChunkedArray, pa.ChunkedArray, dict[str, pa.ChunkedArray]]:
    lost = _all(pc.equal(c[29], ""), pc.equal(c[30], ""))
    e_value, score = _number(c[9]), _number(c[10])
    kinds = ("Inter-Protein", "Intra-Protein")
    good = _all(_full(c[0], "[0-9]+"), pc.fill_null(pc.greater_equal(e_value, 0.0), False), pc.is_valid(score), _in(c[14], kinds))
    return lost, good, {"participant_a": c[29], "participant_b": c[30], "spectrum_no": _whole(c[0]), "e_value": e_value, "score": score, "is_inter_protein": pc.equal(c[14], kinds[0])}


def _closed(line: str) -> str:
    """A line in which the quote that opens a field is never closed, with every field quoted; other lines as they are.

    The reader would take the following lines for the rest of such a field. It ends at the next comma instead and keeps
    its quote. A checked field is only what its quotes enclose, nothing where they stay open.
    """
    if '"' not in line or _CLOSED.fullmatch("," + line):
        return line
    fields = []
    for i, f in enumerate(_FIELD.findall("," + line)):
        if f.startswith('"'):
            m = _QUOTED.match(f)
            rest = "" if i in _CHECKED else f[m.end() if m else 0 :]
            f = (m[1].replace('""', '"') if m else "") + rest
        fields.append(f.replace('"', '""'))
    return ",".join(f'"{f}"' for f in fields)


def _rows(columns: list[pa.ChunkedArray], n: int) -> pa.ListArray:
    """The n rows of the columns as lists."""
    width = len(columns)
    flat = pa.chunked_array([chunk for c in columns for chunk in c.chunks], pa.string())
    at = np.arange(width * n).reshape(width, n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.concat_arrays(flat.take(pa.array(at)).chunks) if n else pa.array([], pa.string()))


def _stand_ins(text: str, n: int) -> list[str]:
    """The first n private characters, then others, that text doesn't hold."""
    held = set(text)
    return list(islice((c for c in map(chr, range(0xE000, 0x110000)) if c not in held), n))


def parse(lines: list[str], layout: str, load: bool = True) -> tuple[np.ndarray, pa.Array, pa.Table]:
    """Of each line the number of its reason in REASONS, the method to look up where it may load, and the columns of LOADED.

    Lines have even numbers of double quotes. A number of 0 stands for a line that loads if its method is null or known. The
    columns are null for lines that fail. Without load the lists of all fields aren't built.
    """
    width, delimiter, quote, check = (MITAB_FIELDS, "\t", False, _mitab) if layout == LAYOUTS[0] else (XLMS_FIELDS, ",", '"', _xlms)
    schema = pa.schema([(f.name, _ARROW[f.dataType]) for f in LOADED])
    if not lines:
        return np.zeros(0, np.int64), pa.array([], pa.string()), schema.empty_table()
    if quote:
        lines = [_closed(x) if '"' in x else x for x in lines]
    whole = "\n".join(lines)
    breaks = []
    if "\r" in whole or whole.count("\n") >= len(lines):
        # line breaks inside lines: characters that none of the lines holds stand for them while the reader works
        breaks = list(zip("\n\r", _stand_ins(whole, 2)))
        for mark, other in breaks:
            lines = [x.replace(mark, other) for x in lines]
    wrong: list[int] = []

    def skip(row: csv.InvalidRow) -> str:
        wrong.append(int(row.text.split(delimiter, 1)[0]))
        return "skip"

    raw = "".join(f"{i}{delimiter}{x}\n" for i, x in enumerate(lines)).encode("utf-8", "surrogatepass")
    names = ["_at", *(f"f{i}" for i in range(width))]
    read = csv.read_csv(
        pa.py_buffer(raw),
        csv.ReadOptions(use_threads=False, block_size=min(len(raw) + 1, 2**31 - 1), column_names=names),
        csv.ParseOptions(delimiter=delimiter, quote_char=quote, double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=skip),
        csv.ConvertOptions(check_utf8=False, column_types={n: pa.int64() if n == "_at" else pa.string() for n in names}, strings_can_be_null=False),
    )
    if read.num_rows + len(wrong) != len(lines):
        raise ValueError("the reader didn't give every line back")
    columns = read.columns[1:]
    for mark, other in breaks:
        columns = [pc.replace_substring(c, other, mark) for c in columns]
    lost, good, values = check(columns)
    word = pc.if_else(_readable(columns[6]), pa.scalar(None, pa.string()), columns[6]) if layout == LAYOUTS[0] else pa.nulls(read.num_rows, pa.string())
    if load:
        values["fields"] = _rows(columns, read.num_rows)
    at = read.column(0).to_numpy()
    reasons = np.zeros(len(lines), np.int64)
    reasons[wrong] = 1
    reasons[at] = np.where(lost.to_numpy(), 2, np.where(good.to_numpy(), 0, 3))
    place = np.full(len(lines), -1)
    place[at] = np.arange(len(at))
    place[reasons != 0] = -1
    rows = pa.array(place, mask=place < 0)
    loaded = pa.table({f.name: (values[f.name].cast(f.type) if f.name in values else pa.nulls(len(at), f.type)) for f in schema})
    word = word.take(rows)
    return reasons, word.combine_chunks() if isinstance(word, pa.ChunkedArray) else word, loaded.take(rows)


def _judge(keep: int, load: bool, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of the kept columns, layout and line; gives the kept columns, reason, word to look up and, with load, LOADED."""
    named = pa.array(REASONS, pa.string())
    for batch in batches:
        layout, text = pc.fill_null(batch.column(keep), ""), pc.utf8_rtrim(pc.fill_null(batch.column(keep + 1), ""), "\r\n")
        record = pc.invert(pc.or_(pc.equal(pc.utf8_trim_whitespace(text), ""), pc.starts_with(text, "#"))).to_numpy(zero_copy_only=False)
        odd = pc.count_substring(text, '"').to_numpy(zero_copy_only=False) % 2 == 1
        of = {name: pc.equal(layout, name).to_numpy(zero_copy_only=False) for name in LAYOUTS}
        known = of[LAYOUTS[0]] | of[LAYOUTS[1]]
        parts = []
        for reason, rows in ((4, np.flatnonzero(record & odd)), (5, np.flatnonzero(record & ~odd & ~known))):
            empty = pa.table({f.name: pa.nulls(len(rows), _ARROW[f.dataType]) for f in LOADED})
            parts.append((rows, np.full(len(rows), reason), pa.nulls(len(rows), pa.string()), empty))
        for name in LAYOUTS:
            rows = np.flatnonzero(record & ~odd & of[name])
            parts.append((rows, *parse(text.take(pa.array(rows)).to_pylist(), name, load)))
        index = pa.array(np.concatenate([p[0] for p in parts]))
        if not len(index):
            continue
        columns = [c.take(index) for c in batch.columns[:keep]] + [named.take(pa.array(np.concatenate([p[1] for p in parts]))), pa.concat_arrays([p[2] for p in parts])]
        if load:
            columns += [c.combine_chunks() for c in pa.concat_tables([p[3] for p in parts]).columns]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], schema=schema)


def _looked_up(df: DataFrame, word: Column, vocabulary: DataFrame) -> DataFrame:
    """df with _unknown: whether word isn't null and isn't in the vocabulary. Adaptive execution broadcasts it where its measured size allows."""
    terms = vocabulary.select(F.lower(vocabulary.columns[0]).alias("_term")).where("_term IS NOT NULL").distinct()
    asked = df.withColumn("_asked", F.lower(word))
    return asked.join(terms, F.col("_asked") == F.col("_term"), "left").withColumn("_unknown", F.col("_asked").isNotNull() & F.col("_term").isNull()).drop("_asked", "_term")


def judge_lines(df: DataFrame, keep: list[str], layout: str, line: str, vocabulary: DataFrame, load: bool = True) -> DataFrame:
    """For each record the columns keep, reason (null: it loads) and, with load, the columns of LOADED.

    vocabulary: its first column has the known methods, whatever their letter case.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(df.sparkSession)
    fields = [df.schema[c] for c in keep] + [T.StructField("reason", T.StringType()), T.StructField("_word", T.StringType())] + (list(LOADED) if load else [])
    arrow = pa.schema([pa.field(f.name, _ARROW.get(f.dataType) or to_arrow_type(f.dataType)) for f in fields])
    judged = df.select(*keep, layout, line).mapInArrow(partial(_judge, len(keep), load, arrow), T.StructType(fields))
    judged = _looked_up(judged, F.col("_word"), vocabulary)
    reason = F.when(F.col("_unknown"), "invalid_value").otherwise(F.col("reason"))
    loaded = [F.when(~F.col("_unknown"), F.col(f.name)).alias(f.name) for f in LOADED] if load else []
    return judged.select(*(f"`{c}`" for c in keep), reason.alias("reason"), *loaded)


def judge_terms(df: DataFrame, method: str, interaction: str, vocabulary: DataFrame) -> DataFrame:
    """df with reason: why one of the two terms can't be read; null where both can."""

    def odd(c: str) -> Column:
        return F.coalesce((F.length(c) - F.length(F.replace(F.col(c), F.lit('"'), F.lit("")))) % 2 == 1, F.lit(False))

    def plain(c: str) -> Column:
        return F.when(~(F.col(c).isin(*NO_TERM) | F.col(c).rlike(rf"\A{REFERENCE}\z")), F.col(c))

    bad = F.coalesce(~F.lower(plain(interaction)).isin(*INTERACTION_WORDS), F.lit(False))
    judged = _looked_up(df, plain(method), vocabulary)
    return judged.withColumn("reason", F.when(odd(method) | odd(interaction), "broken_quoting").when(F.col("_unknown") | bad, "invalid_value")).drop("_unknown")
