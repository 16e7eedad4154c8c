import pytest

from dyadic.operators.packed import unpack
from dyadic.plans import problems

DATA = "/root/testdata/sf0.001"


def is_value(c: str) -> bool:
    return c.isalnum() or c in "-.:'()[]{}"


def slash_belongs(s: str, i: int) -> bool:
    return not (i > 0 and s[i - 1].isspace()) and not (i + 1 < len(s) and s[i + 1].isspace())


def brute(s: str, blanks: bool) -> list[str]:
    """Character by character, without regular expressions."""
    out, i, n = [], 0, len(s)

    def ends(k: int) -> bool:
        while not blanks and k < n and s[k] == " ":
            k += 1
        return k >= n or (not slash_belongs(s, k) if s[k] == "/" else not is_value(s[k]))

    while i < n:
        q = s[i]
        if q in "\"'":
            j, inner, closed = i + 1, "", False
            while j < n:
                if s[j] == q and s[j + 1 : j + 2] == q:
                    inner, j = inner + q, j + 2
                elif s[j] == q:
                    closed = ends(j + 1)
                    break
                else:
                    inner, j = inner + s[j], j + 1
            if closed:
                out.append(inner.strip())
                i = j + 1
                continue
        if not (is_value(q) or (q == "/" and slash_belongs(s, i))):
            i += 1
            continue
        j = i
        while j < n:
            k = j
            while not blanks and k < n and s[k] == " ":
                k += 1
            if k > j:
                if k < n and is_value(s[k]):
                    j = k
                    continue
                break
            if s.startswith('"MI:', j) and s[j - 1 : j] == ":" and (e := s.find('"', j + 1)) > j + 4 and s[j + 4 : e].isdigit():
                j = e + 1
                if s[j : j + 1] == "(" and (e := s.find(")", j)) > 0 and "(" not in s[j + 1 : e]:
                    j = e + 1
            elif is_value(s[j]) or (s[j] == "/" and slash_belongs(s, j)):
                j += 1
            else:
                break
        out.append(s[i:j].strip())
        i = j
    return [v for v in out if v not in ("", "-", "NA", "nan")]


def values(spark, rows, texts, blanks=False):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "id string, packed string, value_no string")
    return {i: [r[3] for r in rows(unpack(df, "id", {"packed": blanks}).orderBy("value_no")) if r[0] == str(i)] for i in range(len(texts))}, unpack(df, "id", {"packed": blanks}).collect()


CASES = ['A|B', "A ; B", "'x; y'|A", '"a ""b"" c"; d', 'psi-mi:"MI:1234"(two, words)|x', "3'-capture, z", "In/Out / B", None, "", "-", "NA|x|nan", '"open; b', "'open; b", "a\tb\nc", "  A  ", "A||B", '"NA"|q', "''", '""', "x/", "/x", "a  b", "é ü|ß", "'the \"b\" c'", '"a, b" (c, d)', "(x, y", "a (b c) d|e)", "((a) b", "x (y/ z) w", "[a b]{c}|( )|()", 'q:"MI:12"(a, b) (c)|z', "a )b", '"" "x', "a (b|c", '"a"b"c"']


@pytest.mark.parametrize("blanks", [False, True])
def test_cases_against_brute_force(spark, rows, blanks):
    df = spark.createDataFrame(list(enumerate(CASES)), "id int, packed string")
    got = {}
    assert sorted((r.id, r.value_no, r.field_value) for r in unpack(df, "id", {"packed": blanks}, labels=False).collect()) == sorted((r.id, r.value_no, r.field_value) for r in unpack(df, "id", {"packed": blanks}).collect())
    for r in unpack(df, "id", {"packed": blanks}).collect():
        got.setdefault(r.id, []).append((r.value_no, r.field_value))
    for i, text in enumerate(CASES):
        assert [v for _, v in sorted(got.get(i, []))] == brute(text or "", blanks), text
        assert [n for n, _ in sorted(got.get(i, []))] == list(range(1, len(got.get(i, [])) + 1))


def test_flags(spark):
    texts = ['"open; b', "'a'|x", 'psi-mi:"MI:1234"(a)', "'open; b", '"a, b" (c, d)', "(x, y", "a (b c)|d)", "((a) b)", '"q (r"']
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id int, packed string")
    got = {}
    for r in sorted(unpack(df, "id", {"packed": False}).collect(), key=lambda r: (r.id, r.value_no)):
        got.setdefault(r.id, []).append((r.field_value, r.alternative, r.error))
    assert got == {
        1: [("open", "bare", "unclosed_quote"), ("b", "bare", None)],
        2: [("a", "quoted", None), ("x", "bare", None)],
        3: [('psi-mi:"MI:1234"(a)', "bracketed", None)],
        4: [("'open", "bare", "unclosed_quote"), ("b", "bare", None)],
        5: [("a", "bare", "malformed_quote"), ("b", "bare", None), ("(c", "bare", "unclosed_bracket"), ("d)", "bare", "unopened_bracket")],
        6: [("(x", "bare", "unclosed_bracket"), ("y", "bare", None)],
        7: [("a (b c)", "bracketed", None), ("d)", "bare", "unopened_bracket")],
        8: [("((a) b)", "bracketed", None)],
        9: [("q (r", "quoted", None)],
    }


def test_very_long_and_empty(spark):
    long = "|".join(f'"value ""{i}"" x"' for i in range(50_000))
    df = spark.createDataFrame([("1", long, None), ("1", long, None)], "id string, packed string, field_name string")
    assert unpack(df, "id", {"packed": False}).count() == 100_000
    one = spark.createDataFrame([("1", "x" * 1_000_000 + "'" * 99_999)], "id string, packed string")
    assert unpack(one, "id", {"packed": False}).count() == 1
    assert unpack(df.limit(0), "id", {"packed": False}).count() == 0


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/tomato_positive_pairs_deduplicated.parquet").collect()
    want = {(r.pair_id, f, k, v) for r in table for f, blanks in problems.PACKED_FIELDS.items() for k, v in enumerate(brute(r[f] or "", blanks), 1)}
    assert {tuple(r) for r in problems.p2_found(spark, DATA).collect()} == want
