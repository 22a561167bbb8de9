"""Classifiers by held-out accuracy, packing by an exact round trip, extraction by planted pages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import html_extract, langid, packing, quality_classifier
from fieldloom.llm.queries import tokenizer_file

from .util import docs

EDGES = [(900, None), (901, ""), (902, " 12 !! "), (903, "word " * 60000), (None, "the sea and the sky"), (5, "the sea and the sky"), (5, "the sea and the sky")]


def speak(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    tongues = {"aa": "the sea and sky with thing other".split(), "bb": "der und die schön über einen haus".split(), "cc": "él niño que está mañana cosa".split()}
    rows = [(i, speak(rng, tongues[t], rng.randint(3, 80)).title(), t) for i, t in enumerate(rng.choice(list(tongues)) for _ in range(300))] + EDGES
    out = langid.identify(docs(spark, rows).selectExpr("*", "1 as score")).collect()
    assert len(out) == len(rows)
    want = {r[0]: r[2] for r in rows if len(r) > 2}
    assert all(r.lang_pred == want[r.doc_id] for r in out if r.doc_id in want and r.doc_id != 5)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "no language told")])).collect()} == {"und"}


def test_language_model_ignores_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, speak(rng, ["sea", "sky"], 9), "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i in range(80)]
    assert langid.fit(docs(spark, rows))["langs"] == ["aa"]


def test_quality(spark):
    rng = random.Random(3)
    words = "the sea and sky with some thing other than blue light over water".split()
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        n = rng.randint(8, 90)
        junk = rng.choice([lambda: " ".join(w + "$$$" for w in speak(rng, words, n).split()), lambda: (rng.choice(words) + " ") * n, lambda: speak(rng, words, n).upper() + "!!"])
        rows.append((i, speak(rng, words, n).capitalize() + "." if good else junk()))
        labels.append((i, int(good)))
    told = spark.createDataFrame([*labels, (None, 1), (7, None), (900, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs(spark, rows + EDGES).selectExpr("*", "1 as quality"), told).collect()
    assert len(out) == len(rows) + len(EDGES)
    want = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in want and r.doc_id != 5]
    assert len(held) > 60 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_classifier.classify(docs(spark, []), told).count() == 0
    alone = quality_classifier.classify(docs(spark, EDGES), told.where("quality = 1")).collect()
    assert {r.predicted for r in alone} == {1}


def slow_counts(text):
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode()]
    raw = [b for k, b in enumerate(raw) if b != 32 or k == 0 or raw[k - 1] != 32]
    out = [0] * langid.BUCKETS
    for size in range(1, 5):
        for k in range(len(raw) - size + 1):
            code = 0
            for b in raw[k : k + size]:
                code = (code * 257 + b) % 2**32
            out[((code + size) * 2654435761 % 2**32) >> 20] += 1
    return np.array(out)


def test_grams_equal_plain_python_in_any_blocks(monkeypatch):
    rng = random.Random(7)
    texts = ["", "a", " 12 ", "Éa 日", *["".join(rng.choice("ab éß1 .日") for _ in range(rng.randint(1, 120))) for _ in range(40)]]
    for block in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert all((langid.counts(t) == slow_counts(t)).all() for t in texts)


def test_language_equals_plain_cosine(spark):
    rng = random.Random(9)
    rows = [(i, speak(rng, ["sea", "sky", "haus", "über", "niño"][k : k + 3], rng.randint(1, 30)), f"l{k}") for i, k in enumerate(rng.choice([0, 1, 2]) for _ in range(90))] + EDGES
    model = langid.fit(docs(spark, rows))
    for r in langid.identify(docs(spark, [x for x in rows if x[0] != 5 or len(x) > 2]), model).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        own = np.log1p(slow_counts(text[:3000] if len(text) > 9999 else text)) * model["weight"]
        if len(text) > 9999 or r.lang_pred == "und":
            continue
        near = [float(own @ c) / float(np.linalg.norm(own)) for c in model["centres"]]
        assert model["langs"][model["of"][int(np.argmax(near))]] == r.lang_pred and r.score == pytest.approx(max(near), abs=1e-5)


def test_quality_equals_a_plain_scorer(spark):
    rng = random.Random(6)
    rows = [(i, speak(rng, ["Sea", "sky,", "$$", "x" * 70, "WORD"] if i % 2 else ["one", "two", "Three."], rng.randint(1, 40))) for i in range(200)] + EDGES
    told = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_classifier.fit(docs(spark, rows), told)
    net, rng = model.network, random.Random(1)
    for r in rng.sample(quality_classifier.classify(docs(spark, [x for k, x in enumerate(rows) if x[0] != 5 or k == 5]), told, model).collect(), 60):
        text = next(t for i, t in rows if i == r.doc_id) or ""
        vectors = [model.vectors[model.row[t]] for t in quality_classifier._stream(text) if t in model.row]
        x = np.mean(vectors, axis=0) if vectors else np.zeros(quality_classifier.SIZE)
        hidden = [np.tanh(sum((x[i] - net.middle[i]) / net.spread[i] * net.w[0][i, j] for i in range(len(x))) + net.w[1][j]) for j in range(len(net.w[1]))]
        logit = sum(h * w for h, w in zip(hidden, net.w[2])) + net.w[3][0]
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=1e-4)


def test_every_piece_of_a_long_word_counts():
    one, two = (quality_classifier._stream("a" * 48 + x) for x in ("zzzz", "qqqq"))
    assert one != two and len(quality_classifier._stream("日" * 1000)) == 2 * -(-1000 // quality_classifier.PIECE)


def test_long_words_are_not_remembered():
    encoder = packing.Encoder(tokenizer_file())
    first = encoder.ids([b"short " + b"x" * 5000 + b" " + b"y" * 90 + b"., end"])
    assert all(len(w) <= packing.KNOWN_BYTES for w in encoder.known) and b"short" in encoder.known
    assert encoder.ids([b"short " + b"x" * 5000 + b" " + b"y" * 90 + b"., end"]) == first


def test_plan_is_optimal():
    rng = random.Random(4)
    for _ in range(30):
        at = sorted(rng.sample(range(1, 9000), 200))
        at = [0] + sorted(set(at) | set(range(256, at[-1], 256)))
        cost = [0.0] + [rng.choice([0.0, 2.0, 12.0]) for _ in at[1:]]
        pad = lambda n: 0 if n in packing.SHORT or n == 2048 else 2048 - n
        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + pad(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 2048) + cost[j] + packing.NEW_WINDOW)
        ends = packing.plan(at, cost)
        total, last = 0.0, 0
        for j in ends:
            total += pad(at[j] - at[last]) + cost[j] + packing.NEW_WINDOW
            last = j
        assert ends[-1] == len(at) - 1 and total == pytest.approx(best[-1])


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = ["The", "sea,", "sky.", "it's", "Don't!", "naïve", "É́é", "日本", "x2y", "...", "a.b", "I V", "A\x1cB", "ﬁ", "q,", "é,", "<|endoftext|>", "<|ENDOFTEXT|>", "İ"]
    rows = [(i, speak(rng, words, rng.choice([0, 1, 40, 900, 5000]))) for i in range(60)] + [e for e in EDGES if e[0] not in (5, None)] + [(77, "x" * 20000)]
    df = docs(spark, rows).selectExpr("*", "1 as start").repartition(3)
    out = packing.pack(df, tokenizer_file(), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file())
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 2048
    sizes = [sum(r.length for r in own) for own in sequences.values()]
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.03 * sum(sizes)
    assert packing.pack(docs(spark, []), tokenizer_file()).count() == 0
    assert packing.pack(docs(spark, [(5, "a"), (5, "a"), (None, None)]), tokenizer_file()).agg(F.sum("length")).first()[0] == 5


def test_words_alone_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    encoder, tokenizer, rng = packing.Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file()), random.Random(1)
    parts = ["a", "B", "é", "e\u0301", "\u0301", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u200b", "\u3000", ".", "...", "'s", "’s", "23", "$", "-", "<|endoftext|>", "<|", "İ", "ß", "ſ", "中", "한", "ा", "क", "\u0958", "😀", "\x00", "#", "ﬁ", "I'll", "²"]
    texts = ["İ$", "क़#", "कÅİ#", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(8000)]]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])]
    want = [e.ids + [1] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_packing_in_small_stretches(spark, monkeypatch):
    rng = random.Random(6)
    encoder = packing.Encoder(tokenizer_file())
    monkeypatch.setattr(packing, "STRETCH", 9000)
    packer, ids, out = packing.Packer(encoder.sentence_ends, 0, True), {}, []
    for i in range(150):
        ids[i] = encoder.ids([speak(rng, ["sea", "sky.", "Thing"], rng.randint(0, 3000)).encode()])[0]
        out += packer.add(i, ids[i])
    out += packer.flush(True)
    for i, raw in ids.items():
        assert np.concatenate([r[7] for r in sorted(r for r in out if r[0] == i for r in [r[:7] + (r[7].tolist(),)])]).tolist() == np.frombuffer(raw, "<u4").tolist()
    totals = {}
    for r in out:
        totals[r[5]] = totals.get(r[5], 0) + r[2]
    assert max(totals.values()) <= 2048 and sorted(totals) == list(range(len(totals)))


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="home">
<div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <article>no</article> -->
<aside>side {n}</aside><div class="ad">Buy {n}</div>{body}<footer>&copy; host</footer></body></html>"""


def test_extraction(spark):
    rng = random.Random(7)
    words = "sea sky blue light water stone".split()
    rows, want = [], {}
    for i in range(200):
        parts = [speak(rng, words, rng.randint(3, 30)) + f" {i}" for _ in range(rng.randint(1, 5))]
        host = "a.example" if i % 3 else f"h{i % 7}.example"
        if host == "a.example":
            body = f"<article class=x><h1>Head &amp; {i}</h1><p>{'</p><p>'.join(parts)}</p><p>Thank you for reading this</p><form><input>Sign up</form><div class='comments'><p>First!</p></div></article>"
            want[i] = "\n\n".join([f"Head & {i}", *parts])
        else:
            body = f"<div class=content><h2>Head\n {i}</h2><p><b>{'<br><p>'.join(parts)}</div>"
            want[i] = "\n\n".join([f"Head {i}", *parts])
        rows.append((i, f"http://{host}/p/{i}", PAGE.format(n=i, body=body)))
    df = spark.createDataFrame(rows + [(500, "u", None), (501, None, ""), (502, "http://x", "plain &lt;text&gt; <b>cut"), (503, "http://x", "<p>a<p"), (504, "::", "<a " * 9000), (505, "http://y", "<p>" + "w " * 50000)], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.extract(df.selectExpr("*", "1 as text", "2 as _group")).collect()}
    assert {i: out[i].text for i in want} == want
    assert out[500].text == "" and out[501].text == "" and out[502].text == "plain <text> cut" and out[503].text == "a" and out[505].n_chars == 99999
    assert out[504].text == "" and html_extract.extract(df.where("page_id < 0")).count() == 0


def test_copies_are_not_template(spark):
    page = PAGE.format(n=1, body="<article><p>the same words on every page</p></article>")
    df = spark.createDataFrame([(i, "http://a/", page) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"the same words on every page"}
