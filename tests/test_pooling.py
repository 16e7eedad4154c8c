from dyadic.operators import pooling
from dyadic.plans import evidence

DATA = "/root/testdata/sf0.001"


def test_every_position(spark):
    rows = evidence.QUERIES["elementwise_pools"](spark, DATA).collect()
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    assert {r.label for r in rows} == {r.label for r in source}
    for r in rows:
        at = list(zip(*(s.embedding for s in source if s.label == r.label)))
        assert len(at) == len(r["mean"]) == len(r["max"]) == len(r["min"]) == 64
        assert r["max"] == [max(x) for x in at] and r["min"] == [min(x) for x in at]
        assert all(abs(m - sum(x) / len(x)) < 1e-5 for m, x in zip(r["mean"], at))


def test_lengths_and_nulls(spark):
    df = spark.createDataFrame([("a", [1.0, None, 5.0]), ("a", [3.0, -2.0]), ("b", [float(i) for i in range(12)])], "k string, v array<float>")
    got = {r.k: (r["mean"], r["max"], r["min"]) for r in pooling.elementwise(df, "k", "v").collect()}
    assert got == {"a": ([2.0, -2.0, 5.0], [3.0, -2.0, 5.0], [1.0, -2.0, 5.0]), "b": ([float(i) for i in range(12)],) * 3}
