"""The pipeline against plain Python over the same rows, and its stages on empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .test_linededup import brute as brute_lines
from .test_neardup import jaccard, shingles
from .util import docs

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in "".join(" " if c in BLANKS else c for c in text).split(" ") if w]


def brute_quality(rows):
    host = {i: s or "" for i, _, _, s in rows}
    key = lambda line: " ".join(words(line)).lower()
    texts, held = defaultdict(set), defaultdict(set)
    for i, t, _, _ in rows:
        t = t or ""
        texts[host[i]].add(i)
        for line in t.split("\n"):
            if key(line):
                held[host[i], key(line)].add(i)
    above = {k for k, v in held.items() if len(v) > 20 and len(v) > 0.1 * len(texts[k[0]])}
    out = []
    for i, t, lang, s in rows:
        w, lines = words(t or ""), (t or "").split("\n")
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(windows)
        again = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(8)}
        gone = [x for x in lines if (host[i], key(x)) in above]
        left = len(w) - sum(len(words(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        if not failed and not (gone and (left < 0.2 * len(w) or left < 20 and 2 * left < len(w))):
            out.append((i, "\n".join(x for x in lines if (host[i], key(x)) not in above), lang, s))
    return out


def brute_hits(rows, items):
    def split(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c >= "\x80" or c.isdigit() and c < "\x80" or "a" <= c <= "z" else " " for c in lower).split(" ")

    phrases = set()
    for _, t in items:
        w = [x for x in split(t) if x]
        phrases |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    hit = set()
    for i, t, *_ in rows:
        w = [x for x in split(t) if x]
        if any(tuple(w[k : k + n]) in phrases for n in {len(p) for p in phrases} for k in range(len(w) - n + 1)):
            hit.add(i)
    return hit


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice("sea sky blue light water stone Wood iron over under never".split()) + str(rng.randint(0, 300))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    banner = "this banner stands on every page of the host and says nothing at all"
    rows = []
    for i in range(60):
        text = "\n".join(line(rng.randint(25, 60)) for _ in range(rng.randint(1, 3)))
        rows.append((i, (banner + "\n" + text) if i % 2 else text, "en", f"s{i % 2}"))
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(6)]
    rows += [(200 + i, rows[i][1].replace(".", " end.", 1), "en", "s0") for i in range(6)]
    rows += [(300, None, None, None), (301, "", "en", "s0"), (302, "again " * 80, "en", "s0"), (303, line(400) + "\n" + rows[3][1].split("\n")[1], "en", None)]
    items = [(1, " ".join(words(rows[8][1])[4:30])), (2, " ".join(words(rows[20][1])[2:9])), (3, None)]
    return rows, items


def near_classes(texts):
    """Classes of texts whose five-word shingles have a Jaccard similarity of at least 0.8."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_stages_equal_plain_python(spark, tmp_path):
    rows, items = corpus()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_quality(rows)
    assert any(len(w[1]) < len(r[1] or "") for w in want for r in rows if r[0] == w[0]) and len(want) < len(rows)
    lines = {i: t for i, t, *_ in brute_lines([(i, t) for i, t, _, _ in want])}
    want = sorted((i, lines[i], lang, s) for i, _, lang, s in want)
    label = near_classes([t for _, t, _, _ in want])
    least = {}
    for (i, *_), c in zip(want, label):
        least[c] = min(least.get(c, i), i)
    want = [w for w, c in zip(want, label) if least[c] == w[0]]
    hit = brute_hits(want, items)
    want = [w for w in want if w[0] not in hit]
    assert hit and len(want) > 30
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert sorted((r.doc_id, r.text, r.lang, r.source) for r in now.collect()) == want
    assert now.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {w[0] for w in want}
    per = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert per.where("n <> t").count() == 0


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
