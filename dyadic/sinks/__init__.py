"""Writers: partitioned Parquet, exports, dead letters, audits, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions.text import sanitised
from dyadic.session import ship_package

#: Text sinks keep blanks at the ends of values, which Spark's writer would cut off.
AS_THEY_STAND = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 1_000_000, mode: str = "append") -> None:
    """Hive-partitioned Parquet in files of at most so many rows; readers see a job's files together, when it commits.

    Partitions are counted first: one of n rows is spread over n / rows_per_file salts, so that a task writes few
    partitions, and a large partition is written by as many tasks as it fills files. The salt is a hash of the row, so that a
    task that runs again gives its rows the same; equal rows share one. df is read twice.
    """
    salts = df.groupBy(*by).agg(F.expr(f"1 + (count(*) - 1) div {rows_per_file}").alias("_salts")).select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), "_salts")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    hashed = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind]
    salted = df.join(salts, same).withColumn("_salt", F.pmod(F.xxhash64(*hashed) if hashed else F.lit(0), F.col("_salts")))
    spread = salted.repartition(*by, "_salt").drop("_salt", "_salts", *(f"_by_{i}" for i in range(len(by))))
    spread.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], missing: str = "") -> None:
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).options(nullValue=missing, emptyValue="", **AS_THEY_STAND).csv(path)


def write_sanitised(df: DataFrame, path: str) -> None:
    """All columns as text, NA for what is missing."""
    write_tsv(sanitised(df), path, df.columns)


def write_rejects(rejects: DataFrame, path: str, source_id: str) -> None:
    rejects.select(F.lit(source_id).alias("source_id"), "source_file", F.col("line_no").alias("source_row"), "reason", "raw_record").write.mode("append").options(sep="\t", header=True, **AS_THEY_STAND).csv(path)


def write_benchmark(positives: DataFrame, negatives: DataFrame, loci: DataFrame, path: str) -> None:
    """Positives with label 1 and negatives with label 0, with the loci of both ends, partitioned by partition."""
    rows = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)), allowMissingColumns=True)
    for side in "ab":
        rows = rows.join(loci.select(F.col("id").alias(f"_{side}"), F.col("locus").alias(f"locus_{side}")), F.col(f"participant_{side}_id") == F.col(f"_{side}"), "left").drop(f"_{side}")
    out = rows.select("participant_a_id", "participant_b_id", "label", "partition", *(F.coalesce(f"locus_{s}", F.lit("")).alias(f"locus_{s}") for s in "ab"))
    out.write.mode("overwrite").partitionBy("partition").options(sep="\t", header=True, **AS_THEY_STAND).csv(path)


def write_fasta(df: DataFrame, path: str, key: str, sequence: str, width: int = 60) -> None:
    """Records in the order of their keys, sequences wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
    df.orderBy(key).select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), wrapped)).write.mode("overwrite").text(path)


def audit_json(metrics: DataFrame, key: str, value: str) -> str:
    """A small table of metrics as a JSON object."""
    return json.dumps({r[key]: r[value] for r in metrics.select(key, value).collect()}, sort_keys=True)


def audit_tsv(metrics: DataFrame, path: str) -> None:
    """A table of metrics as one tab-separated file with a header."""
    write_tsv(metrics.coalesce(1), path, metrics.columns)


def audit_markdown(metrics: DataFrame, title: str) -> str:
    """A small table of metrics as a Markdown section, rows in the order of their columns."""
    lines = [f"## {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + " --- |" * len(metrics.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |" for r in metrics.orderBy(*metrics.columns).collect()]
    return "\n".join(lines) + "\n"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            fs, at = pa.fs.FileSystem.from_uri(path)
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(at, compression=None) as f:
                while part := f.read(1 << 22):
                    digest.update(part)
                    size += len(part)
            out.append((path, size, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["path", "size", "sha256"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of each file below path, sorted by path; executors read the files in pieces of 4 MB, whatever their size."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.mapInArrow(_hashes, "path string, size long, sha256 string").orderBy("path")
