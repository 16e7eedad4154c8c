import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from dyadic import sinks
from dyadic.sources import lines, readers
from dyadic.streaming import ingest


def write(path, text):
    path.write_text(text)
    return str(path)


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        write(tmp_path / name, "".join(f"{name}{i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 8000
    assert all(r.value == f"{r.source_file.rsplit('/', 1)[-1]}{r.line_no}" for r in got)


def test_mitab(spark, tmp_path):
    good = ["uniprotkb:A", "uniprotkb:B"] + ["-"] * 40
    path = write(tmp_path / "x.txt", "\n".join(["#header", "\t".join(good), "", "short\tline", "\t".join(["-", "-"] + good[2:])]) + "\n")
    rows, bad = readers.mitab(spark, path)
    assert [(r.line_no, r.id_a, r.detection_method) for r in rows.collect()] == [(2, "uniprotkb:A", None)]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(4, "column count 2 < 42"), (5, "missing participants")]


def test_tab3_string_pairs(spark, tmp_path):
    f = [str(i) for i in range(37)]
    f[23], f[24], f[26], f[27], f[5] = "-", "T1|T2", "-", "-", "SYS"
    f[6] = "-"
    rows, bad = readers.tab3(spark, write(tmp_path / "t.txt", "head\n" + "\t".join(f) + "\nx\ty\n"))
    r = rows.first()
    assert (r.id_a, r.id_b, bad.count()) == ("T1", "8", 1)
    with gzip.open(tmp_path / "links.detailed.txt.gz", "wt") as g:
        g.write("protein1 protein2 experimental database textmining combined_score\n3702.A 3702.B 10 0 5 99\n3702.A x 1\n")
    path = str(tmp_path / "links.detailed.txt.gz")
    rows, bad = readers.string_links(spark, path, readers.string_layout(path))
    assert [(r.a, r.b, r.experimental, r.combined, r.line_no) for r in rows.collect()] == [("A", "B", 10, 99, 2)] and bad.count() == 1
    pairs, bad = readers.pair_list(spark, write(tmp_path / "p.txt", "Protein1 Protein2 label\nA B 0\nA C\nB C 7 x\nB D x 1\nalone\n"))
    assert [r.raw_record for r in bad.collect()] == ["alone"]
    assert [tuple(r) for r in pairs.orderBy("a", "b").collect()] == [("A", "B", 0), ("A", "C", 1), ("B", "C", 7), ("B", "D", 1)]


def test_xlms_alignments_by_name(spark, tmp_path):
    f = [f"h{i}" for i in range(32)]
    row = [""] * 32
    row[0], row[4], row[9], row[10], row[29] = "7", '"AB(2)-CD(1), x"', "1e-3", "2.5", "P"
    r = readers.xlms(spark, write(tmp_path / "x.csv", ",".join(f) + "\n" + ",".join(row) + "\n")).first()
    assert (r.spectrum, r.peptide_a, r.peptide_b, r.e_value, r.a, r.b) == (7, "AB(2)", "CD(1), x", 1e-3, "P", "P")
    a = "q\tt\t{}\t1\t1\t1\t1\t1\t1\t1\t1e-5\t50\t10\t10\t0.9\t0.8"
    got = readers.alignments(spark, write(tmp_path / "a.tsv", "query\ttarget" + "\tx" * 14 + "\n" + a.format("85") + "\n" + a.format("bad") + "\n")).collect()
    assert sorted((x.fident or 0, x.evalue) for x in got) == [(0, 1e-5), (0.85, 1e-5)]
    named = readers.by_name(spark, write(tmp_path / "u.tsv", "Entry\tSequence\nP1\tMA\n"), {"Entry": "id", "Gene Names": "genes"})
    assert [tuple(x) for x in named.collect()] == [("P1", None)]


def test_annotations_fasta_vectors(spark, tmp_path):
    g = ["d", "L1", "s", "", "GO:1", "r", "IDA", "w", "C"]
    neg, other = g[:3] + ["NOT|part_of"] + g[4:], g[:8] + ["P"]
    got, bad = readers.annotations(spark, write(tmp_path / "g.gaf", "!c\n" + "\n".join("\t".join(x) for x in (g, neg, other)) + "\nshort\tline\n"))
    assert [(r.line_no, r.raw_record) for r in bad.collect()] == [(5, "short\tline")]
    assert [tuple(x) for x in got.collect()] == [("L1", "GO:1", "IDA")]
    got = readers.fasta(spark, write(tmp_path / "f.fa", ">sp|P1|N desc\nMA\nGG\n>Q2 secondary_acc=Q9\nMK\n"))
    assert sorted((x.id, x.sequence) for x in got.collect()) == [("P1", "MAGG"), ("Q2", "MK"), ("Q9", "MK")]
    got = readers.fasta(spark, write(tmp_path / "g.fa", "\n>P1 kinase A->B transfer >x\r\nMA\r\nGG\r\n>P2\nMK"))
    assert sorted((x.id, x.header, x.sequence) for x in got.collect()) == [("P1", "P1 kinase A->B transfer >x", "MAGG"), ("P2", "P2", "MK")]
    got, bad = readers.vectors(spark, write(tmp_path / "v.txt", ">a\n1 2\n3\n>b\n1 2\n>c\n1 x 3\n"), 3)
    assert [(x.id, x.vector) for x in got.collect()] == [("a", [1.0, 2.0, 3.0])]
    assert sorted((x.id, x.reason) for x in bad.collect()) == [("b", "2 numbers for 3"), ("c", "not a number")]
    got, bad = readers.vectors(spark, write(tmp_path / "w.txt", "A\t1 2 3\n\nB\t1\n"), 3, tabbed=True)
    assert [(x.id, x.vector) for x in got.collect()] == [("A", [1.0, 2.0, 3.0])] and [x.id for x in bad.collect()] == ["B"]


def test_documents_maps_predictions(spark, tmp_path):
    got = readers.table_wraps(spark, write(tmp_path / "x.xml", '<a><table-wrap id="1"><label>T1</label></table-wrap><table-wrap><caption><title>On x</title></caption></table-wrap></a>')).first()
    assert (got.n_tables, got.labels, got.captions) == (2, ["T1"], ["On x"])
    assert [tuple(x) for x in readers.id_map(spark, write(tmp_path / "m.json", '{"a": "b"}')).collect()] == [("a", "b")]
    one = readers.predictions(spark, write(tmp_path / "p1.csv", "pair_id,pred_score,true_label\nx,0.5,1\n"))
    two = readers.predictions(spark, write(tmp_path / "p2.csv", "name,label,prediction\nx,1,0.5\n"))
    assert one.collect() == two.collect()
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    have, lack = readers.with_features(ids, spark.createDataFrame([("a",)], "id string"), "id")
    assert [r.id for r in have.collect()] == ["a"] and [r.id for r in lack.collect()] == ["b"]
    parts = [[r.id for r in readers.shard(spark.range(10), [F.col("id")], k, 3).collect()] for k in range(3)]
    assert [sorted(p) for p in parts] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    spark.range(3).write.parquet(str(tmp_path / "part_1"))
    assert readers.first_existing(spark, [str(tmp_path / "none*"), str(tmp_path / "part*")]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "none*")])
    sample = readers.per_source_sample(spark.range(100).withColumn("s", F.col("id") % 2), "s", [F.col("id")], 10, 3)
    assert sorted(r.id for r in sample.collect()) == [0, 1, 20, 21, 40, 41]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, True, "x\ty"), ("b", None, False, "")], "k string, n int, flag boolean, t string")
    sinks.write_partitioned(df, str(tmp_path / "p"), ["k"], rows_per_file=1)
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 'a'").count() == 1
    sinks.write_sanitised(df, str(tmp_path / "s"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1", "TRUE", "x y"), ("b", "NA", "FALSE", "NA")]
    sinks.write_fasta(spark.createDataFrame([("P2", "A" * 5), ("P1", "B" * 4)], "id string, s string"), str(tmp_path / "f"), "id", "s", 2)
    assert sorted((r.id, r.sequence) for r in readers.fasta(spark, str(tmp_path / "f")).collect()) == [("P1", "BBBB"), ("P2", "AAAAA")]
    pos = spark.createDataFrame([("A", "B", "C1")], "participant_a_id string, participant_b_id string, partition string")
    neg = spark.createDataFrame([("A", "C", "C1")], pos.schema)
    sinks.write_benchmark(pos, neg, spark.createDataFrame([("A", "L1")], "id string, locus string"), str(tmp_path / "b"))
    got = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "b")).collect()
    assert sorted((r.participant_b_id, r.label, r.locus_a, r.locus_b) for r in got) == [("B", "1", "L1", None), ("C", "0", "L1", None)]
    rejects = spark.createDataFrame([("f", 3, "short", "raw")], "source_file string, line_no long, reason string, raw_record string")
    sinks.write_rejects(rejects, str(tmp_path / "r"), "SRC")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r")).columns == ["source_id", "source_file", "source_row", "reason", "raw_record"]
    assert sinks.audit_json(df, "k", "n") == '{"a": 1, "b": null}'
    (tmp_path / "raw").mkdir()
    held = {"a.txt": b"x" * 5_000_000, "b.gz": gzip.compress(b"text")}
    for name, text in held.items():
        (tmp_path / "raw" / name).write_bytes(text)
    got = {r.path.rsplit("/", 1)[-1]: (r.size, r.sha256) for r in sinks.manifest(spark, str(tmp_path / "raw")).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in held.items()}
    assert sinks.audit_markdown(df.select("k", "n"), "T") == "## T\n\n| k | n |\n| --- | --- |\n| a | 1 |\n| b |  |\n"
    many = spark.range(1000).withColumn("k", F.when(F.col("id") < 990, "hot").otherwise("cold"))
    sinks.write_partitioned(many, str(tmp_path / "hot"), ["k"], rows_per_file=50)
    files = spark.read.parquet(str(tmp_path / "hot")).groupBy("k", F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] <= 50 and files.where("k = 'hot'").count() >= 20 and files.agg(F.sum("count")).first()[0] == 1000


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.range(5).write.parquet(f"{src}/a")
    stream = lambda: ingest.file_stream(spark, f"{src}/*", spark.range(1).schema)
    for expected in (5, 5):
        ingest.ingest(stream(), out, state, lambda b: b.withColumn("twice", F.col("id") * 2)).awaitTermination()
        assert spark.read.parquet(out).count() == expected
    spark.range(5, 8).write.parquet(f"{src}/b")
    ingest.ingest(stream(), out, state, lambda b: b.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    left = ingest.pending(spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("a", "COMPLETED"), ("b", "pending")], "f string, status string"), ["f"])
    assert [r.f for r in left.collect()] == ["b"]


def test_xlms_rejects(spark, tmp_path):
    def row(n=32, **given):
        f = [""] * n
        for k, v in ({"f0": "7", "f9": "1", "f10": "2"} | given).items():
            f[int(k[1:])] = v
        return ",".join(f)

    lines = [",".join(f"h{i}" for i in range(32)), row(f29="P", f30="Q"), row(20, f3='"a, ""b"""'), row(f29=" "), row(f3='"two\nlines"', f29="P"), row(33, f30="Q"), row(33)]
    good, bad = readers.xlms_records(spark, write(tmp_path / "x.csv", "\n".join(lines) + "\n"))
    assert sorted(tuple(r) for r in good.select("record_no", "a", "b").collect()) == [(2, "P", "Q"), (5, "P", "P"), (6, None, "Q")]
    got = {r.record_no: (r.reason, r.raw_record) for r in bad.collect()}
    assert got == {3: ("column count 20 < 32", lines[2]), 4: ("missing participants", lines[3]), 7: ("missing participants", lines[6])}
    assert readers.xlms(spark, str(tmp_path / "x.csv")).count() == 3


def test_alignments_by_header(spark, tmp_path):
    text = "target\tevalue\tPident\tquery\tqcov\ttcov\nT\t1e-5\t0.9\tQ\t85\t0.7\nU\t1e-6\t90\tQ\t0.5\tx\n"
    got = {r.target: r for r in readers.alignments(spark, write(tmp_path / "a.tsv", text)).collect()}
    assert {k: (r.query, r.evalue, r.qcov, r.tcov, r.bits) for k, r in got.items()} == {"T": ("Q", 1e-5, 0.85, 0.7, None), "U": ("Q", 1e-6, 0.5, None, None)}
    assert abs(got["T"].fident - 0.009) < 1e-12 and abs(got["U"].fident - 0.9) < 1e-12
    plain = "q\tt\t85\t1\t1\t1\t1\t1\t1\t1\t1e-5\t50\t10\t10\t90\t0.8\n"
    r = readers.alignments(spark, write(tmp_path / "b.tsv", plain)).first()
    assert (r.query, r.fident, r.qcov, r.tcov) == ("q", 0.85, 0.9, 0.8)
