import csv
import io
import re
from datetime import datetime

from dyadic.operators import rejects
from dyadic.plans import problems

DATA = "/root/testdata/sf0.001"
NUMBER = r"(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def term(x, words):
    return x in (None, "", "-", "NA") or x.lower() in words or bool(re.fullmatch(r'psi-mi:"MI:[0-9]{4}"\([^()]+\)', x))


def real_date(x):
    try:
        return x == "-" or bool(re.fullmatch(r"\d{4}/\d{2}/\d{2}", x) and datetime.strptime(x, "%Y/%m/%d"))
    except ValueError:
        return False


def line_reason(layout, line, methods):
    """None: good; "" : no record."""
    x = (line or "").rstrip("\r\n")
    if not x.strip() or x.startswith("#"):
        return ""
    if x.count('"') % 2:
        return "broken_quoting"
    if layout == "mitab27":
        f = x.split("\t")
        if len(f) != 42:
            return "column_count"
        if f[0] in ("", "-") and f[1] in ("", "-"):
            return "missing_participants"
        taxon = all(re.fullmatch(r"-|taxid:\d+(\([^()]+\))?", f[i]) for i in (9, 10))
        score = f[14] == "-" or bool(re.fullmatch("intact-miscore:" + NUMBER, f[14]) and 0 <= float(f[14][15:]) <= 1)
        good = term(f[6], methods) and term(f[11], ("physical", "genetic")) and taxon and score and real_date(f[30]) and real_date(f[31]) and f[35] in ("-", "true", "false")
        return None if good else "invalid_value"
    f = next(csv.reader(io.StringIO(x, newline="")))
    if len(f) != 32:
        return "column_count"
    if not f[29] and not f[30]:
        return "missing_participants"
    good = re.fullmatch(r"\d+", f[0]) and re.fullmatch("[+-]?" + NUMBER, f[9]) and float(f[9]) >= 0 and re.fullmatch("[+-]?" + NUMBER, f[10]) and f[14] in ("Inter-Protein", "Intra-Protein")
    return None if good else "invalid_value"


def tables(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    return read("raw_evidence_lines").collect(), read("combine_evidence").select("evidence_id", "source_file", "detection_method_raw", "interaction_type_raw").collect(), {r.source_term.lower() for r in read("assay_mapping").collect()}


def evidence_reason(r, methods):
    m, i = r.detection_method_raw, r.interaction_type_raw
    if (m or "").count('"') % 2 or (i or "").count('"') % 2:
        return "broken_quoting"
    return None if term(m, methods) and term(i, ("physical", "genetic")) else "invalid_value"


def test_found_loaded_and_counts(spark):
    lines, evidence, methods = tables(spark)
    judged = {r.line_id: line_reason(r.layout, r.raw_line, methods) for r in lines}
    want = {("raw_evidence_lines", k, v) for k, v in judged.items() if v} | {("combine_evidence", r.evidence_id, x) for r in evidence if (x := evidence_reason(r, methods))}
    assert {tuple(r) for r in problems.p5_found(spark, DATA).collect()} == want
    assert {r.line_id for r in problems.p5_loaded(spark, DATA).collect()} == {k for k, v in judged.items() if v is None}
    bad = {}
    for f, x in [(r.source_file, judged[r.line_id]) for r in lines] + list({r.evidence_id: (r.source_file, evidence_reason(r, methods)) for r in evidence}.values()):
        bad[f] = bad.get(f, 0) + bool(x)
    assert {r.source_file: r.n_rejected for r in problems.p5_source_files(spark, DATA).collect()} == bad


def mitab(**given):
    f = ["-"] * 42
    f[0], f[1], f[6], f[11], f[35] = "u:A", "u:B", "pull down", "physical", "false"
    for k, v in given.items():
        f[int(k[1:])] = v
    return "\t".join(f)


def xlms(**given):
    f = [""] * 32
    f[0], f[9], f[10], f[14], f[29], f[30] = "7", "1e-3", "4.5", "Inter-Protein", "A", "B"
    for k, v in given.items():
        f[int(k[1:])] = v
    return ",".join(f)


def test_lines(spark):
    cases = [
        ("mitab27", mitab(), None), ("mitab27", mitab() + "\r\n", None), ("mitab27", mitab() + "\tx", "column_count"), ("mitab27", "a\tb", "column_count"),
        ("mitab27", mitab(f0="-", f1=""), "missing_participants"), ("mitab27", mitab(f6="magic"), "invalid_value"), ("mitab27", mitab(f30="2021/02/29"), "invalid_value"), ("mitab27", mitab(f30="2020/02/29"), None),
        ("mitab27", mitab(f14="intact-miscore:1.01"), "invalid_value"), ("mitab27", mitab(f14="intact-miscore:1"), None), ("mitab27", mitab(f9="taxid:3(a)(b)"), "invalid_value"), ("mitab27", mitab(f4='say "x'), "broken_quoting"),
        ("mitab27", mitab(f4='"a\tb"'), "column_count"), ("mitab27", mitab(f5="in\nside"), None), ("mitab27", mitab(f6="pull\ndown"), "invalid_value"), ("mitab27", "# comment", ""), ("mitab27", "  ", ""), ("mitab27", None, ""), ("mitab27", "", ""),
        ("xlms_csv", xlms(), None), ("xlms_csv", xlms(f3='"a, ""b"""'), None), ("xlms_csv", xlms(f3='"two\nlines"'), None), ("xlms_csv", xlms(f3='"a,b'), "broken_quoting"), ("xlms_csv", xlms(f3="a,b"), "column_count"), ("xlms_csv", xlms(f29="", f30=""), "missing_participants"),
        ("xlms_csv", xlms(f29=""), None), ("xlms_csv", xlms(f9="-1"), "invalid_value"), ("xlms_csv", xlms(f9="0"), None), ("xlms_csv", xlms(f10="4,5"), "column_count"), ("xlms_csv", xlms(f10="nan"), "invalid_value"), ("xlms_csv", xlms(f0="7a"), "invalid_value"), ("xlms_csv", xlms(f5="x" * 3_000_000), None),
        ("other", "text", "unknown_layout"),
    ]
    df = spark.createDataFrame([(str(i), layout, line, 1) for i, (layout, line, _) in enumerate(cases)], "id string, layout string, line string, reason int")
    words = spark.createDataFrame([("Pull Down", 1), (None, 2), ("pull down", 3)], "term string, reason int")
    got = {r.id: r.reason for r in rejects.judge_lines(df.repartition(2), ["id"], "layout", "line", words).collect()}
    for i, (_, line, want) in enumerate(cases):
        assert got.get(str(i), "") == want, line and line[:200]
    assert rejects.judge_lines(df.limit(0), ["id"], "layout", "line", words).count() == 0
    twice = df.where("id = '3'").unionByName(df.where("id = '3'"))
    assert rejects.judge_lines(twice, ["id"], "layout", "line", words.limit(0), load=False).count() == 2


def test_loaded_fields(spark):
    lines, _, _ = tables(spark)
    text = {r.line_id: (r.layout, r.raw_line.rstrip("\r\n")) for r in lines if r.raw_line}
    got = problems.p5_loaded(spark, DATA).collect()
    assert {r.layout for r in got} == {"mitab27", "xlms_csv"}
    for r in got:
        layout, x = text[r.line_id]
        assert list(r.fields) == (x.split("\t") if layout == "mitab27" else next(csv.reader(io.StringIO(x, newline=""))))
        if layout == "mitab27":
            assert r.updated_on == (None if r.fields[31] == "-" else datetime.strptime(r.fields[31], "%Y/%m/%d").date())


def test_good_evidence(spark):
    _, evidence, methods = tables(spark)
    rows = problems.p5_evidence(spark, DATA)
    assert rows.columns == spark.read.parquet(f"{DATA}/combine_evidence.parquet").columns and len(rows.columns) == 80
    assert sorted(r.evidence_id for r in rows.collect()) == sorted({r.evidence_id for r in evidence if evidence_reason(r, methods) is None})
    assert problems.p5_evidence(spark, "/root/testdata/sf0.1").groupBy("evidence_id").count().where("count > 1").count() == 0


def test_open_quotes(spark):
    """The last quote opens a field: the line ends the field, and the following lines are read; the SQL says the same."""
    from oracle import connection

    lines = [xlms(f3='a"b', f5='"c'), xlms(), xlms(f3='a"b', f31='"c'), xlms(f3='a"b', f5='"c,d'), xlms(f3='a"b', f29="", f30='"B'), xlms(f3='a"b', f0='"7'), xlms(f3='a"b"', f5='"x, ""y"""'), xlms(f3='a"b', f5='"c""', f6='"e""f"'), xlms(f29="", f30="")]
    df = spark.createDataFrame([(f"l{i}", "s", "f", i, "xlms_csv", x) for i, x in enumerate(lines)], "line_id string, source_id string, source_file string, source_row long, layout string, raw_line string").coalesce(1)
    rows = {r.line_id: r for r in rejects.judge_lines(df, ["line_id"], "layout", "raw_line", spark.createDataFrame([("pull down",)], "term string")).collect()}
    assert len(rows) == len(lines)
    con = connection("sf0.001")
    con.execute("CREATE OR REPLACE TEMP TABLE given AS SELECT unnest($ids) AS line_id, 's' AS source_id, 'f' AS source_file, 'xlms_csv' AS layout, unnest($lines) AS raw_line", {"ids": [f"l{i}" for i in range(len(lines))], "lines": lines})
    con.execute("CREATE OR REPLACE VIEW raw_evidence_lines AS SELECT * FROM given")
    want = dict(con.execute(problems.SQL["p5_found"].split("SELECT 'raw_evidence_lines'")[0] + "SELECT line_id, reason FROM j").fetchall())
    assert {k: r.reason for k, r in rows.items()} == want
    assert rows["l1"].reason is None and rows["l8"].reason == "missing_participants"
    assert rows["l2"].reason is None and rows["l2"].fields[3] == 'a"b' and rows["l2"].fields[31] == '"c'


def test_nothing_is_lost_or_changed(spark):
    """Numbers of any length stay, and so do characters that could stand for line breaks, beside lines with breaks."""
    odd = "a\ue000b\ue001c\ue00ad\ue00d"
    lines = [xlms(f0="9" * 45), xlms(f3=odd), xlms(f3='"two\nli\rnes"'), xlms(f29="", f30=odd)]
    df = spark.createDataFrame([(i, "xlms_csv", x) for i, x in enumerate(lines)] + [(9, "mitab27", mitab(f9="taxid:" + "1" * 30, f5="x\ny", f4=odd))], "id int, layout string, line string").coalesce(1)
    rows = {r.id: r for r in rejects.judge_lines(df, ["id"], "layout", "line", spark.createDataFrame([("pull down",)], "term string")).collect()}
    assert {r.reason for r in rows.values()} == {None}
    assert rows[0].spectrum_no == "9" * 45 and rows[1].fields[3] == odd and rows[2].fields[3] == "two\nli\rnes" and rows[3].participant_b == odd
    assert rows[9].taxon_a == "1" * 30 and rows[9].fields[5] == "x\ny" and rows[9].fields[4] == odd
