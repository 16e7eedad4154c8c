"""Resumable ingestion: files are read as a stream, each once, and a restart goes on where the last run ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> StreamingQuery:
    """Writes what normalise makes of each batch, then ends when no file is left.

    A batch goes to a folder of its own number and overwrites it, so a batch that is run again after a failure leaves
    no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = normalise(batch).write.mode("overwrite")
        (done.partitionBy(*by) if by else done).parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(sources: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sources that no completed entry of the manifest names."""
    return sources.join(manifest.where(F.lower("status") == "completed").select(*keys), list(keys), "left_anti")
