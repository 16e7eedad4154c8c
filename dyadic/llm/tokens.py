"""Token ids and token counts of a text column (problem 7).

One narrow pass: no shuffle, one Python stage over (key, text) Arrow batches, the vocabulary broadcast once
(a fixed file of under 1 MB). Null and empty texts have an empty list of ids and a count of 0; blank texts are
encoded as any other. Texts of any length are encoded whole. Repeated keys and rows stay as they are; columns
other than key and text aren't read, so names that clash with the results' don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dyadic.llm import bpe
from dyadic.session import ship_package

BATCH_IDS = 1 << 20  # ids after which a batch is handed to the JVM
TEXT_BYTES = 8 << 20  # bytes of text that are Python strings at a time, if more than one text


def vocabulary(spark: SparkSession, rank_file: str = bpe.DEFAULT_RANKS) -> Broadcast:
    """The rank file's bytes for all executors; they needn't have the file."""
    ship_package(spark)
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose second column holds at most TEXT_BYTES, or one text; empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(size, dtype=np.int64), 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _ids(ranks: Broadcast, key: str, out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = bpe.loaded(ranks.value)
    kind = pa.list_(pa.int32())
    for batch in by_bytes(batches):
        raw, offsets, begin = bytearray(), [0], 0
        n = 0
        for n, (_, ids) in enumerate(coder.encode_each(batch.column(1).to_pylist()), 1):
            raw += ids
            offsets.append(len(raw) // 4)
            if offsets[-1] >= BATCH_IDS:
                yield _list_batch(batch.column(0).slice(begin, n - begin), offsets, raw, key, out, kind)
                raw, offsets, begin = bytearray(), [0], n
        if n > begin:
            yield _list_batch(batch.column(0).slice(begin, n - begin), offsets, raw, key, out, kind)


def _list_batch(keys: pa.Array, offsets: list[int], raw: bytearray, key: str, out: str, kind: pa.DataType) -> pa.RecordBatch:
    lists = pa.ListArray.from_buffers(kind, len(keys), [None, pa.array(offsets, pa.int32()).buffers()[1]], children=[pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(bytes(raw))])])
    return pa.RecordBatch.from_arrays([keys, lists], names=[key, out])


def _counts(ranks: Broadcast, key: str, out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = bpe.loaded(ranks.value)
    for batch in by_bytes(batches):
        sizes = [len(ids) // 4 for _, ids in coder.encode_each(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, out])


def encode(df: DataFrame, key: str, text: str, out: str = "ids", rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """key and the ids of text, without special tokens."""
    schema = T.StructType([df.schema[key], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    return df.select(key, text).mapInArrow(partial(_ids, vocabulary(df.sparkSession, rank_file), key, out), schema)


def count_tokens(df: DataFrame, key: str, text: str, out: str = "n_tokens", rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """key and the number of ids of text."""
    schema = T.StructType([df.schema[key], T.StructField(out, T.LongType(), False)])
    return df.select(key, text).mapInArrow(partial(_counts, vocabulary(df.sparkSession, rank_file), key, out), schema)


def _texts(ranks: Broadcast, key: str, out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = dict((int(rank), base64.b64decode(word)) for word, rank in (line.split() for line in ranks.value.splitlines() if line))
    words = pa.array([held.get(i) for i in range(max(held) + 1)], pa.large_binary())
    for batch in batches:
        ids = batch.column(1)
        for begin in range(0, batch.num_rows, 256):
            part = ids.slice(begin, 256)
            texts = [b"".join(words.take(row.values).to_pylist()).decode("utf-8", "replace") if row.is_valid else None for row in part]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 256), pa.array(texts, pa.string())], names=[key, out])


def decode(df: DataFrame, key: str, ids: str, out: str = "text", rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """key and the text that ids stand for; an empty list gives an empty text, null gives null, and bytes that are no text come out as U+FFFD."""
    schema = T.StructType([df.schema[key], T.StructField(out, T.StringType())])
    return df.select(key, ids).mapInArrow(partial(_texts, vocabulary(df.sparkSession, rank_file), key, out), schema)
