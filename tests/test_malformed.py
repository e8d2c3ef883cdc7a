import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import malformed as m

SCHEMA = "line_id BIGINT, recordtype STRING, key STRING, value STRING, reason STRING, _corrupt STRING"


def parse(text):
    """Fields by a character automaton, None if badly quoted."""
    out, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            field, i = "", i + 1
            while True:
                if i >= len(text):
                    return None
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        field, i = field + '"', i + 2
                        continue
                    i += 1
                    break
                field, i = field + text[i], i + 1
            if i < len(text) and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            j = len(text) if j < 0 else j
            field, i = text[i:j], j
            if '"' in field:
                return None
        out.append(field)
        if i >= len(text):
            return out
        i += 1


def is_int(s):
    return bool(re.fullmatch(r"[+-]?[0-9]+", s)) and -(1 << 63) <= int(s) < 1 << 63


def is_float(s):
    return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", s)) and abs(float(s)) < float("inf")


def is_date(s):
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s):
        return False
    try:
        date.fromisoformat(s)
        return True
    except ValueError:
        return False


def reason(kind, key, value):
    if value is None:
        return "quoting"
    f = parse(value[:-1] if value.endswith("\r") else value)
    if f is None:
        return "quoting"
    if kind not in ("0", "1"):
        return "type"
    if len(f) != (3 if kind == "0" else 9):
        return "arity"
    if not (is_int(f[1]) and is_int(f[2]) if kind == "0" else is_int(f[8]) and is_float(f[3]) and is_date(f[2])):
        return "value"
    return None if key == f[0 if kind == "0" else 1] else "key"


def check(spark, rows):
    df = spark.createDataFrame([(i, *r, "old", "x") for i, r in enumerate(rows)], SCHEMA)
    got = {r.line_id: r.reason for r in m.rejected(df).collect()}
    want = {i: x for i, r in enumerate(rows) if (x := reason(*r))}
    assert got == want, [(i, rows[i], got.get(i), want.get(i)) for i in {*got, *want} if got.get(i) != want.get(i)][:5]
    ok = {r.line_id for x in (m.RANKING, m.VISIT) for r in m.valid_rows(df, x, "line_id").collect()}
    assert ok == set(range(len(rows))) - set(want)


VISIT = "1.2.3.4,u,2000-02-29,1.5,a,b,c,d,7"
CASES = [
    ("0", "u", "u,1,2"), ("0", "u", "u,1,2\r"), ("0", "u", "u,1,2\r\r"), ("0", "u", "u,+1,-2"), ("0", "u", "u,9223372036854775807,0"), ("0", "u", "u,9223372036854775808,0"),
    ("0", "u", "u,1,"), ("0", "u", "u,1"), ("0", "u", ""), ("0", "", ",1,2"), ("0", None, "u,1,2"), ("0", "v", "u,1,2"), (None, "u", "u,1,2"), ("0 ", "u", "u,1,2"), ("0", "u", None),
    ("0", "u", '"u",1,"2"'), ("0", 'u"', '"u""",1,2'), ("0", "a,b", '"a,b",1,2'), ("0", "a\nb", '"a\nb",1,2'), ("0", "u", ' "u",1,2'), ("0", "u", '"u" ,1,2'), ("0", "u", 'u,"1"x,2'),
    ("0", "u", 'u,1"2,3'), ("0", "u", 'u,1,"2'), ("0", "", '"",1,2'), ("0", '"', '"""",1,2'), ("2", "u", 'u,"'), ("0", "u", "u, 1,2"), ("0", "u", "u,１,2"), ("0", "u", "u,1,2\n"),
    ("1", "u", VISIT), ("1", "u", VISIT.replace("02-29", "02-30")), ("1", "u", VISIT.replace("1.5", "1e400")), ("1", "u", VISIT.replace("1.5", ".5E-3")), ("1", "u", VISIT.replace("1.5", ".")),
    ("1", "u", VISIT.replace("1.5", "1.5d")), ("1", "u", VISIT.replace("1.5", "NaN")), ("1", "u", VISIT.replace("2000-", "02000-")), ("1", "u", VISIT + ","), ("1", "u", VISIT.replace("u", '"u"')),
    ("0", "a\x01b,c", '"a\x01b,c",1,2'), ("0", "\x01b", '"\x01b",1,2'), ("1", "u", VISIT.replace("a,b", ",")), ("0", "u", "u," * 30000), ("0", "u", '"u' + '""' * 40000 + '",1,2'), ("0", "x" * 70000, "x" * 70000 + ",1,2"),
    ("0", "u", "\x00u,1,2"), ("0", "#u", "#u,1,2"), ("0", "u\\", "u\\,1,2"), ("1", "u", VISIT.replace("2000-02-29", "0000-00-00")),
]


def test_cases(spark):
    check(spark, CASES)


def test_no_row_fails_the_job(spark):
    many = "," * 20_000
    check(spark, [("0", "u", "," * 2_000_000), ("1", "u", "," * 2_000_000), ("0", "u", "u,1,2"), ("0", many, f'"{many}",1,2'), ("1", "u", VISIT.replace(",a,", f',"{many}",')), ("0", "u", "\n" * 100_000 + ",,"), ("0", "u", '"' * 99_999)])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["0", "1", "01", None]), st.sampled_from(["u", "", ",", '"', None]), st.lists(st.sampled_from(['"', '""', ",", "u", "1", "\n", "\r", " ", "\x01", "b", "2001-01-01"]), max_size=12).map("".join)), min_size=1, max_size=60))
def test_random(spark, rows):
    check(spark, rows)


def test_typed(spark):
    df = spark.createDataFrame([(1, "0", "u", 'u,"+0012",3', "", ""), (2, "1", "u", VISIT.replace(",a,", ",,"), "", "")], SCHEMA)
    assert [tuple(r) for r in m.valid_rows(df, m.RANKING, "line_id").collect()] == [(1, "u", 12, 3)]
    assert [tuple(r) for r in m.valid_rows(df, m.VISIT, "line_id").collect()] == [(2, "1.2.3.4", "u", date(2000, 2, 29), 1.5, "", "b", "c", "d", 7)]


def test_empty(spark):
    assert m.rejected(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text", ["", "a,b", '"a,""b"', '""', 'x,"",y', "\x01a,\x01"])
def test_split(spark, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(m.split_record(F.lit(text))).first()[0] == parse(text)
