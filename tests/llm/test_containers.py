"""Packing and cutting: invariants over generated sizes and texts."""

import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dyadic.llm import bpe, cutting, packing, tokens

DATA = "/root/testdata/sf0.001"


def loads(sizes, plan):
    items = [s for s in sorted(sizes, reverse=True) if s]
    out = Counter()
    for i, s in enumerate(items):
        j = bisect.bisect_right(plan.first, i) - 1
        out[plan.to[j] + i - plan.first[j]] += s
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(8, 300), st.lists(st.integers(0, 300), max_size=200))
def test_plans_fit(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    plan = packing.plan(Counter(sizes), capacity)
    got = loads(sizes, plan)
    assert all(v <= capacity for v in got.values()) and sum(got.values()) == sum(sizes)
    assert sorted(got) == list(range(plan.containers))


@pytest.mark.parametrize("seed", range(4))
def test_plans_waste_little(seed):
    r = random.Random(seed)
    sizes = [min(2048, int(r.lognormvariate(5, 1))) for _ in range(5000)]
    plan = packing.plan(Counter(sizes), 2048)
    assert plan.containers <= -(-sum(sizes) // 2048) * 1.01 + 1


def test_large_only_close_to_bound():
    r = random.Random(9)
    sizes = [r.randint(300, 1000) for _ in range(20_000)]
    plan = packing.plan(Counter(sizes), 2048)
    assert all(v <= 2048 for v in loads(sizes, plan).values())
    assert plan.containers <= sum(sizes) / 2048 * 1.06


def test_rules_dont_grow_with_documents():
    sizes = Counter({s: 1 + s % 7 for s in range(1, 513)})
    few, many = packing.plan(sizes, 512), packing.plan({s: n * 100_000 for s, n in sizes.items()}, 512)
    assert many.containers > 10_000 * few.containers and len(many.first) < 40_000


@pytest.mark.parametrize("bucket_rows", [packing.BUCKET_ROWS, 40])
def test_pack_sizes(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket_rows)
    rows = [(i, n) for i, n in enumerate([0, None, 5, 64, 65, 200, 1, 1, 1, 30, 34] + [10] * 500)] + [(2, 5), (2, 5)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, n long, container_id int").repartition(4)
    got = packing.pack_sizes(df, "doc_id", "n", [(1, 64), (2, 1000)]).collect()
    for budget, capacity in ((1, 64), (2, 1000)):
        mine = [r for r in got if r.budget_id == budget]
        load, per_doc = Counter(), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.n_tokens
            per_doc[r.doc_id].append((r.piece_no, r.n_tokens))
        assert max(load.values()) <= capacity
        assert {k: sum(n for _, n in v) for k, v in per_doc.items()} == {k: sum(n or 0 for i, n in rows if i == k) for k, _ in rows}
        divided = {k for k, v in per_doc.items() if max(p for p, _ in v) > 1}
        assert divided == {i for i, n in rows if (n or 0) > capacity}
    assert packing.pack_sizes(df.limit(0), "doc_id", "n", [(1, 64)]).count() == 0
    assert {r.container_id for r in packing.pack_sizes(df.where("n = 0"), "doc_id", "n", [(1, 64)]).collect()} == {0}


def test_pack_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = packing.pack_texts(docs, "doc_id", "text", [(1, 2048), (2, 8192)]).collect()
    assert {(r.budget_id, r.doc_id) for r in got} == {(b, r.doc_id) for b in (1, 2) for r in docs.collect()}
    for b, capacity in ((1, 2048), (2, 8192)):
        load = Counter()
        for r in got:
            if r.budget_id == b:
                load[r.container_id] += r.n_tokens
        assert max(load.values()) <= capacity and len(load) <= sum(load.values()) / capacity * 1.03 + 1


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(8, 60), st.integers(0, 4), st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_cuts(n, limit, overlap, strong, words):
    array = lambda s: np.array(sorted(x for x in s if x <= n), np.int64)
    got = list(cutting.cut(n, limit, overlap, array(strong), array(words), np.ones(n + 1, bool)))
    if not n:
        assert not got
        return
    assert got[0][0] == 0 and got[-1][1] == n and all(0 < b - a <= limit for a, b, _ in got)
    for (_, b, kind), (c, _, _) in zip(got, got[1:]):
        assert b - c == overlap
        assert kind == 3 or b in (strong if kind == 1 else words)
    assert all(a < c for (a, _, _), (c, _, _) in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=120), st.integers(24, 60), st.integers(0, 8), st.data())
def test_cuts_within_characters(widths, limit, overlap, data):
    """Characters of several tokens: pieces end and begin at characters, and share the overlap or up to three tokens more."""
    n = sum(widths)
    whole = np.zeros(n + 1, bool)
    whole[np.append(0, np.cumsum(widths)).astype(int)] = True
    ends = np.array(sorted(data.draw(st.sets(st.sampled_from(np.flatnonzero(whole).tolist())))), np.int64)
    got = list(cutting.cut(n, limit, overlap, ends, ends[::2], whole))
    assert not n or (got[0][0] == 0 and got[-1][1] == n)
    for (a, b, _), (c, _, _) in zip(got, got[1:]):
        assert 0 < b - a <= limit and whole[b] and whole[c] and a < c and overlap <= b - c <= overlap + 4
    if set(widths) <= {1}:
        assert all(b - c == overlap for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_overlap_below_limit():
    with pytest.raises(ValueError, match="overlap"):
        list(cutting.cut(10, 4, 4, np.array([]), np.array([]), np.ones(11, bool)))


def test_natural_places():
    raw = 'A b. C d!  \n\n e "f." g; h? (i?) 東京。 j\n'.encode()
    strong, _ = cutting.places(raw, np.frombuffer(raw, np.uint8))
    assert [raw[:i].decode().strip()[-3:] for i in np.flatnonzero(strong)] == [" b.", " d!", " d!", 'f."', " h?", "i?)", "東京。"]
    for empty in (b"", b"\n", b" a", b"..."):
        cutting.places(empty, np.frombuffer(empty, np.uint8))


def test_pieces_of_texts(spark):
    texts = [None, "", "   ", "short", "One sentence here. " * 200, "x" * 20_000, "東京都。大阪府。" * 800, "\U0001f600" * 3000, "word " * 3000, "a\n\n" * 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "short", 1)], "doc_id long, text string, piece_no int")
    limits = [(3, 512, 64), (4, 256, 32)]
    got = cutting.cut_texts(df, "doc_id", "text", limits).collect()
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        coder = bpe.ByteBpe(f.read())
    size = [len(coder.encode(t)) for t in texts]
    assert {r.doc_id for r in got} == {i for i, n in enumerate(size) if n}
    for number, limit, overlap in limits:
        for i, text in enumerate(texts):
            mine = sorted((r for r in got if r.doc_id == i and r.budget_id == number), key=lambda r: (r.piece_no, r.start_token))
            if i == 3 or not mine:
                assert len(mine) == (2 if i == 3 else 0)
                continue
            assert [r.piece_no for r in mine] == list(range(1, len(mine) + 1)) and mine[-1].end_token == size[i]
            assert all(r.n_tokens == r.end_token - r.start_token <= limit and r.piece_text in text for r in mine)
            for a, b in zip(mine, mine[1:]):
                assert b.overlap_tokens == a.end_token - b.start_token == overlap
            assert mine[0].piece_text == text[: len(mine[0].piece_text)] and text.endswith(mine[-1].piece_text)
    assert cutting.cut_texts(df.limit(0), "doc_id", "text", limits).count() == 0


def test_slices_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 10)
    texts = [None, "", "abc", "x" * 25, "abcdefg", "abcd", "", "e" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["k", "t"])
    parts = [b.column(1).to_pylist() for b in tokens.by_bytes(iter([batch.slice(0, 0), batch, batch.slice(3, 2)]))]
    assert [x for p in parts for x in p] == texts + texts[3:5]
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)
