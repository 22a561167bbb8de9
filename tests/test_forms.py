"""Form expressions, rules over submissions, lint, codebook and variants."""

import pytest
from pyspark.sql import functions as F

from fieldloom import sources
from fieldloom.operators import forms
from fieldloom.operators.forms import Bind, FormError, Scope, compiled

ROSTER = "array<struct<line:int,relation:string,serial:string,temp:double>>"


@pytest.fixture(scope="module")
def homes(spark):
    rows = [
        ("a", 3, "1", "2026-06-03", "10.5 7.1 0 20", "12", "H", [(1, "1", "480001", 4.0), (2, "2", "480002", 9.5), (3, "3", None, None)]),
        ("b", 2, "1", "2026-07-01", "10.5 7.1 0 200", "", "H B", [(1, "2", "480001", 1.0), (2, "1", "480001", 5.0)]),
        ("c", None, "3", None, "", "7", "", []),
        ("d", 4, "1", "2026-06-05", None, None, None, None),
    ]
    return spark.createDataFrame(rows, f"hh string, size int, result string, day string, gps string, team string, assets string, roster {ROSTER}")


REPEATS = {"roster": ["line", "relation", "serial", "temp"]}


@pytest.mark.parametrize("text,want", [
    ("${size} >= 1 and ${size} <= 3", [True, True, False, False]),
    ("${size} != 3", [False, True, True, True]),
    ("not(${size} = 3) or ${result} = '3'", [False, True, True, True]),
    ("date(${day}) >= date('2026-06-01') and ${day} <= date('2026-06-14')", [True, False, False, True]),
    ("${day} = today()", [True, False, False, False]),
    ("number(selected-at(${gps}, 0)) >= 10.2 and number(selected-at(${gps}, 3)) <= 100", [True, False, False, False]),
    ("selected(${assets}, 'H') and count-selected(${assets}) > 1", [False, True, False, False]),
    ("count(${relation}[. = '1']) = 1", [True, True, False, False]),
    ("count(${temp}[. > 8.0]) + count(${temp}[. < 2.0]) > 0", [True, True, False, False]),
    ("count(/data/roster/serial[. = '480001']) = 2", [False, True, False, False]),
    ("if(${team} = '', 'none', concat('T', ${team})) = 'T12'", [True, False, False, False]),
    ("string-length(${hh}) = 1 and regex(${hh}, '[a-b]')", [True, True, False, False]),
    ("round(${size} * 10 div 4, 0) = 8", [True, False, False, False]),
    ("-${size} + 5 mod 3 = -1", [True, False, False, False]),
    ("int(7.9) = 7 and substr('abc', 1, 2) = 'b'", [True] * 4),
])
def test_expressions(homes, text, want):
    scope = Scope(set(homes.columns), REPEATS, "2026-06-03")
    got = homes.select("hh", compiled(text, scope).truth().alias("x")).orderBy("hh").collect()
    assert [r.x for r in got] == want


@pytest.mark.parametrize("text", ["${nobody} = 1", "(1 = 1", "foo(1)", "1 = = 2", "regex(1)", "count(${size})", ". = 1", "a @ b", ""])
def test_what_cannot_be_read(homes, text):
    with pytest.raises(FormError):
        compiled(text, Scope(set(homes.columns), REPEATS))


def test_rules_over_submissions(spark, homes):
    staff = spark.createDataFrame([("12", "T1"), ("7", "T2")], "name string, code string")
    form = [
        Bind("/data/size", "int", ". <= 3", "", "true()"), Bind("/data/day", "date", "", "${result} = '1'", "true()"),
        Bind("/data/code", calculate="pulldata('staff', 'code', 'name', ${team})"), Bind("/data/n", calculate="count(${line})"),
        Bind("/data/team", constraint="pulldata('staff', 'code', 'name', .) = 'T1'"), Bind("/data/gate", constraint=". = ${n}"),
    ]
    known = forms.derived(homes, form, REPEATS, {"staff": staff})
    assert [(r.code, r.n) for r in known.orderBy("hh").collect()] == [("T1", 3.0), ("", 2.0), ("T2", 0.0), ("", 0.0)]
    bad = forms.violations(known.withColumn("gate", F.col("size")), form, ["hh"], REPEATS, {"staff": staff})
    got = {(r.hh, r.field, r.violation) for r in bad.collect()}
    assert got == {("d", "size", "constraint"), ("c", "size", "missing"), ("c", "team", "constraint"), ("d", "gate", "constraint")}
    with pytest.raises(FormError):
        forms.violations(known, form, ["hh"], REPEATS, {})


def test_group_relevance_and_entries(spark, homes):
    form = [Bind("/data/g", relevant="${result} = '1'"), Bind("/data/g/team", required="true()"), Bind("/data/g/serial", constraint="regex(., '[0-9]{6}') and count(/data/roster/serial[. = current()/.]) = 1")]
    assert {(r.hh, r.field, r.violation) for r in forms.violations(homes, form, ["hh"], REPEATS).collect()} == {("b", "team", "missing"), ("d", "team", "missing"), ("c", "team", "answered_but_skipped")}
    people = forms.entries(homes, "roster", "n")
    got = forms.violations(people, form, ["hh", "n"], REPEATS).where("field = 'serial'").collect()
    assert {(r.hh, r.n, r.violation) for r in got} == {("b", 1, "constraint"), ("b", 2, "constraint")}


def test_lint_codebook_and_variants(spark, tmp_path):
    xml = """<h><model><bind nodeset="/data/s1/size" type="int" constraint=". &gt;= 1" required="true()"/>
    <bind nodeset="/data/s1" relevant="/data/result = '1'"/><bind nodeset="/data/result" type="string"/>
    <bind nodeset="/data/n" calculate="count(/data/none)"/></model></h>"""
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(xml.replace(". &gt;= 1", ". &gt;= 0").replace("count(/data/none)", "1"))
    a, b = (sources.xform_binds(spark, str(tmp_path / n)) for n in ("a.xml", "b.xml"))
    form = forms.load(a)
    assert [(x.name, x.enforcement) for x in form] == [("size", "constraint"), ("s1", "skip"), ("result", "none"), ("n", "derived")]
    assert [r.field for r in forms.lint(spark, form).collect()] == ["n"]
    assert [r.field for r in forms.lint(spark, [Bind("/d/x", constraint="1 = 1"), Bind("/d/x")]).collect()] == ["x", "x"]
    book = {r.field: (r.section, r.table_name, r.storage, r.value_set) for r in forms.codebook(spark, form, choices={"result": [str(k) for k in range(16)]}).collect()}
    assert book["size"] == ("s1", "submission", "integer", "") and "s1" not in book and book["result"][3].endswith("13; and 2 more") and book["n"][2] == "derived"
    assert {(r.nodeset, r.attribute) for r in forms.differences(a, b, ["n"]).collect()} == {("/data/s1/size", "constraint")}
