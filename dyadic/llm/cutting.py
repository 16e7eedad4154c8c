"""Cuts long texts into overlapping pieces at natural boundaries (problem 9).

The text is encoded once; prefix sums of the tokens' bytes give every token its place in the text. Places where
a paragraph, line, sentence or word ends are mapped to token numbers and kept as two sorted arrays, the stronger
ends and the ends of words. A piece that starts at token s may end at s + limit; a binary search finds the last
strong end there, else the last end of a word, else the cut is hard, at a token that ends a character. The next
piece starts the overlap before that end, so neighbours share exactly that many tokens, or up to three more where
the token there begins within a character. All limits are cut from one encoding.

Null, empty and blank texts: a text without tokens gives no piece; a blank one is a text as any other. A text
within the limit is one piece. Keys that occur again give their pieces again. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dyadic.llm import bpe
from dyadic.llm.tokens import by_bytes, vocabulary

#: Sentence ends outside ASCII, as bytes.
WIDE_ENDS = tuple(x.encode() for x in ("\u3002", "\uff01", "\uff1f", "\u2026"))
#: Of each byte, as bits: white space, , ; |, closing quotes and brackets, . ! ?
CLASS = np.zeros(256, np.uint8)
for bit, members in ((1, b" \t\n\v\f\r"), (2, b",;|"), (4, b"\"')]"), (8, b".!?")):
    CLASS[list(members)] |= bit
HOW = ("end", "strong", "word", "hard")
BACK = 16  # tokens by which a hard cut goes back for an end that keeps the overlap
OUT_BYTES = 8 << 20  # text after which a batch is handed to the JVM


def cut(n: int, limit: int, overlap: int, strong: np.ndarray, words: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and kind (number in HOW) of each piece of n tokens.

    strong, words: token numbers where the text may end. whole: for each token number up to n, whether a character begins there.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if not whole.all():
        # an end must let the next piece start at a character, too
        strong, words = (x[(x >= overlap) & whole[np.maximum(x - overlap, 0)]] for x in (strong, words))
    start = 0
    while n:
        if start + limit >= n:
            yield start, n, 0
            return
        end, kind = 0, 0
        least = start + overlap + 3  # beyond this, the next piece starts after this one
        for kind, ends in ((1, strong), (2, words)):
            at = int(np.searchsorted(ends, start + limit, "right")) - 1
            if at >= 0 and ends[at] > least:
                end = int(ends[at])
                break
        else:
            kind = 3
            near = range(start + limit, max(least, start + limit - BACK), -1)
            end = next((e for e in near if whole[e] and whole[e - overlap]), 0) or next((e for e in range(start + limit, start + 1, -1) if whole[e]), start + limit)
        yield start, end, kind
        step = max(end - overlap, start + 1)
        back = step
        while back > start + 1 and back > step - 3 and not whole[back]:
            back -= 1
        start = back if whole[back] else step


def places(raw: bytes, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a strong end, and whether the end of a word, is before each byte and behind the last one.

    Strong: behind a run of white space with a line break in it, behind . ! ? and closing quotes or brackets (at most
    two) before white space, or behind a wide mark. Words end before and behind white space and behind , ; |.
    """
    n = len(data)
    kind = CLASS[data]
    blank = np.append((kind & 1).astype(bool), True)
    strong, words = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    words[1:] = (blank[1:] != blank[:-1]) | (kind & 2).astype(bool)
    run_ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1  # behind each run of white space that isn't the last
    breaks = np.append(0, np.cumsum(data == 10))
    starts = np.flatnonzero(blank[:-1] & ~np.append(False, blank[: n - 1]))[: len(run_ends)]
    strong[run_ends[breaks[run_ends] > breaks[starts]]] = True
    closing = np.append((kind & 4).astype(bool), False)
    stop = np.append(False, (kind & 8).astype(bool))  # behind the mark
    if len(raw) and any(w in raw for w in WIDE_ENDS):
        for w in WIDE_ENDS:
            at = raw.find(w)
            while at >= 0:
                stop[at + len(w)] = strong[at + len(w)] = True
                at = raw.find(w, at + 1)
    for _ in range(3):
        strong |= stop & blank
        stop = np.append(False, stop[:-1] & closing[:-1])
    return strong, words


def pieces_of(text: str, ids: bytes, coder: bpe.ByteBpe, limits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int, str, str]]:
    """Of each limit (number, tokens, overlap): number, piece number from 1, start and end token, tokens shared with the piece before, kind of end, piece text."""
    n = len(ids) // 4
    if n <= min(limit for _, limit, _ in limits):
        for number, _, _ in limits:
            if n:
                yield number, 1, 0, n, 0, HOW[0], text
        return
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(coder.bytes_of[np.frombuffer(ids, np.int32)], out=ends[1:])
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    whole = np.ones(n + 1, bool) if len(raw) == len(text) else np.append((data & 0xC0) != 0x80, True)[ends]
    strong, words = (np.flatnonzero(mask[ends]) for mask in places(raw, data))
    for number, limit, overlap in limits:
        before = 0
        for k, (a, b, kind) in enumerate(cut(n, limit, overlap, strong, words, whole), 1):
            shared, before = before - a, b
            yield number, k, a, b, shared, HOW[kind], raw[ends[a] : ends[b]].decode("utf-8", "replace")


def _pieces(ranks: Broadcast, limits: list[tuple[int, int, int]], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = bpe.loaded(ranks.value)
    for batch in by_bytes(batches):
        index: list[int] = []
        columns: list[list] = [[] for _ in range(7)]
        held = 0
        for row, (text, ids) in enumerate(coder.encode_each(batch.column(1).to_pylist())):
            for piece in pieces_of(text, ids, coder, limits):
                index.append(row)
                for c, x in zip(columns, piece):
                    c.append(x)
                held += len(piece[6])
            if held >= OUT_BYTES:
                yield _piece_batch(batch.column(0), index, columns, schema)
                index, columns, held = [], [[] for _ in range(7)], 0
        if index:
            yield _piece_batch(batch.column(0), index, columns, schema)


def _piece_batch(keys: pa.Array, index: list[int], columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    number, piece, start, end, shared, how, text = columns
    size = (np.array(end, np.int64) - np.array(start, np.int64)).astype(np.int32)
    values = [number, piece, start, end, size, shared, how, text]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(index)), *(pa.array(v, f.type) for v, f in zip(values, list(schema)[1:]))], schema=schema)


def cut_texts(df: DataFrame, key: str, text: str, limits: list[tuple[int, int, int]], rank_file: str = bpe.DEFAULT_RANKS) -> DataFrame:
    """A row for each piece: key, budget_id, piece_no, start_token, end_token, n_tokens, overlap_tokens, ends_at, piece_text.

    limits: number, most tokens and overlap of each budget. Tokens are those of the whole text's encoding.
    """
    names = {"budget_id": T.IntegerType(), "piece_no": T.IntegerType(), "start_token": T.IntegerType(), "end_token": T.IntegerType(), "n_tokens": T.IntegerType(), "overlap_tokens": T.IntegerType(), "ends_at": T.StringType(), "piece_text": T.StringType()}
    kinds = {T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    schema = T.StructType([df.schema[key], *(T.StructField(k, v, False) for k, v in names.items())])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(key, to_arrow_type(df.schema[key].dataType)), *(pa.field(k, kinds[v]) for k, v in names.items())])
    return df.select(key, text).mapInArrow(partial(_pieces, vocabulary(df.sparkSession, rank_file), limits, arrow), schema)
