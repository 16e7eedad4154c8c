from dyadic.operators import pairs


def test_names_and_authors(spark):
    rows = [("B", "A", "nb", "na", 2, "Z"), ("A", "B", "other", "x", 3, "NA"), *(("A", "B", "x", "x", 4 + i, f"W{i}") for i in range(6)), ("C", "C", "NA", "c", 1, None), ("D", None, "d", "e", 1, "Q")]
    df = spark.createDataFrame(rows, "a string, b string, n string, m string, at int, author string")
    got = {(r.participant_a_id, r.participant_b_id): (r.participant_a_name, r.participant_b_name, r.first_authors) for r in pairs.names(df, "a", "b", "n", "m", ["at"], "author").collect()}
    assert got == {("A", "B"): ("na", "nb", "W0|W1|W2|W3|W4"), ("C", "C"): (None, "c", "")}
