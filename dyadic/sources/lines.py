"""Text lines with their physical numbers, and delimited records split from what can't be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, source_file and line_no (from 1, headers and blank lines counted).

    Files are split as usual; the lines before each split come from a small table, a row for each split, so lines
    aren't shuffled. Compressed files are one split each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    ahead = blocks.select("source_file", "_block", "_first", (F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block")) - F.col("_n")).alias("_ahead"))
    return lines.join(ahead, ["source_file", "_block"]).select("value", "source_file", (F.col("_id") - F.col("_first") + F.col("_ahead") + 1).alias("line_no"))


def split_records(lines: DataFrame, sep: str, least: int, comments: Sequence[str] = (), header_lines: int = 0, missing: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (source_file, line_no, f: array) and rejects (source_file, line_no, reason, raw_record).

    Blank lines, header lines and lines that start with a comment mark are neither. sep is a regular expression.
    missing: of f, true where no participant is given.
    """
    text = F.regexp_replace("value", r"[\r\n]+$", "")
    skip = (F.trim(text) == "") | (F.col("line_no") <= header_lines)
    for mark in comments:
        skip = skip | text.startswith(mark)
    parted = lines.where(~skip).select("source_file", "line_no", text.alias("raw_record"), F.split(text, sep, -1).alias("f"))
    reason = F.when(F.size("f") < least, F.format_string(f"column count %d < {least}", F.size("f")))
    if missing is not None:
        reason = reason.when(missing, "missing participants")
    judged = parted.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("source_file", "line_no", "f"), judged.where("reason IS NOT NULL").select("source_file", "line_no", "reason", "raw_record")


def field(k: int) -> Column:
    """The k-th field, from 0; null where the record is shorter or it is empty."""
    c = F.get(F.col("f"), F.lit(k))
    return F.when(c != "", c)
