import random

from fieldloom.llm.linededup import dedup_lines

from .util import docs


def brute(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first, last = {}, {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k], last[k] = min(first.get(k, i), i), max(last.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] != last[key(x)] and first[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_equals_brute_force_for_any_batches(spark):
    rng = random.Random(5)
    pool = [f"Line number {k} of Ä pool" for k in range(12)] + ["short", "", "  LINE number 3 of Ä pool\t", "äÄ" * 5]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(70, None), (71, ""), (72, "common line here\n" * 4000)]
    want = brute(rows)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        assert got(dedup_lines(docs(spark, rows), batches, fanout)) == want


def test_repeated_rows_clashing_columns_and_empty(spark):
    rows = [(1, "same long line\nsame long line"), (1, "same long line\nsame long line"), (2, "same long line"), (3, "x")]
    df = docs(spark, rows).selectExpr("*", "1 as n_lines", "2 as h1", "3 as _extra")
    out = dedup_lines(df)
    assert "h1" in out.columns and out.columns.count("n_lines") == 1
    assert [(r.doc_id, r.n_dropped) for r in out.orderBy("doc_id").collect()] == [(1, 0), (1, 0), (2, 1), (3, 0)]
    assert dedup_lines(docs(spark, [])).count() == 0


def test_clashing_names_pass(spark):
    names = ["_doc", "_row", "_gone", "doc", "hash", "gone", "row", "key", "at", "h1", "batch", "_text", "_host"]
    df = docs(spark, [(1, "one repeated line\nx"), (2, "one repeated line\ny")]).selectExpr("*", *[f"doc_id * {k + 2} as {n}" for k, n in enumerate(names)])
    out = sorted(dedup_lines(df).collect())
    assert [r.text for r in out] == ["one repeated line\nx", "y"]
    assert all(r[n] == r.doc_id * (k + 2) for r in out for k, n in enumerate(names))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
