"""Periodic runs against brute force: every text's runs, the method's steps, the query's modified texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import queries, tandem

from .util import docs


def slow_runs(words, least, exponent):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            found.setdefault((k, end + q - k), q)  # the smallest period of a stretch comes first
            k = end + 1
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, exponent * q))


def numbers(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def suffix_squares(words):
    """All repeats as tuples of words with their period."""
    n = len(words)
    return {tuple(words[i : i + 2 * k]) for k in range(1, n // 2 + 1) for i in range(n - 2 * k + 1) if words[i : i + k] == words[i + k : i + 2 * k]}


CASES = ["", "a", "aa", "aaaaaaaa", "abababab", "abaababaabaababaababaabaababaabaab", "aabaabaabcaabaabaab", "abcabcabcabcabcabx" * 3, "xyzzyx" * 9 + "q" + "ab" * 8, "abcd" * 30 + "e" + "bcda" * 7]


@pytest.mark.parametrize("text", CASES)
def test_whole_vocabulary(text):
    words = numbers(text)
    if len(words) < 2:
        return
    tree = tandem.Tree(suffixes := tandem.Suffixes(words), *tandem.covering(suffixes, len(words) // 2))
    node, period = tree.vocabulary()
    got = [tuple(words[tree.least[v] : tree.least[v] + 2 * k].tolist()) for v, k in zip(node.tolist(), period.tolist())]
    assert len(set(got)) == len(got) and set(got) == suffix_squares(words.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (6, 4), (1, 3), (4, 2)]))
def test_runs_of_small_alphabets(words, bounds):
    assert tandem.runs_of(np.array(words, np.int64), *bounds) == slow_runs(words, *bounds)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=8), st.sampled_from([(6, 4), (2, 2), (9, 6)]))
def test_stretches_lose_no_run(pieces, bounds):
    words = [w for p, many in pieces for w in p * many]
    want = slow_runs(words, *bounds)
    got = [(a + s, n, q) for a, b in tandem.stretches(np.array(words, np.int64), 4, *bounds) for s, n, q in tandem.runs_of(np.array(words[a:b]), *bounds)]
    assert sorted(got) == want


def test_lempel_ziv_blocks():
    words = numbers("abaabcababaab")
    cut = tandem.blocks(tandem.Suffixes(words))[:-1].tolist()
    text = "abaabcababaab"
    for a, b in zip(cut, cut[1:]):
        longest = max((n for n in range(1, len(text) - a + 1) if any(text[j : j + n] == text[a : a + n] for j in range(a))), default=1)
        assert b - a == longest


def test_words_and_numbers_in_plenty():
    rng = random.Random(1)
    words = [rng.randrange(50) for _ in range(3000)]
    words[700:1500] = [words[700 + k % 37] for k in range(800)]
    words[2000:2400] = [words[2000 + k % 3] for k in range(400)]
    assert tandem.runs_of(np.array(words)) == slow_runs(words, 6, 4)
    assert tandem._primes(360) == (2, 3, 5) and tandem._primes(97) == (97,) and tandem._primes(1) == ()


def test_one_word_a_hundred_thousand_times():
    assert tandem.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "no no no no no no yes"), (5, "a b a b a b a b x " * 2), (6, "one two\nthree " * 20 + "end"), (None, "la " * 7), (6, "one two\nthree " * 20 + "end"),
    (7, "word " * 30000), (8, "x y " * 6), (9, "a a a a a b b b b b b c"), (10, "p q r s t u v w x y z"), (11, "ü ü ü ü ü ü"), (12, "Ü ü Ü ü Ü ü Ü ü"),
]


def test_documents(spark):
    got = tandem.tandem_runs(docs(spark, TEXTS).repartition(3).selectExpr("*", "1 as runs", "2 as collapsed")).collect()
    assert len(got) == len(TEXTS)
    want = sorted((repr(i), *_slow(t)) for i, t in TEXTS)
    assert sorted((repr(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got) == want
    assert tandem.tandem_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        tandem.tandem_runs(docs(spark, []), exponent=1)


def _slow(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    if len(set(words)) == 1:  # brute force would take too long
        runs = [(0, len(words), 1)] if len(words) >= 6 else []
    else:
        runs = slow_runs(words, 6, 4)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return runs, " ".join(w for k, w in enumerate(words) if k not in gone)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))) for k in range(120)] + TEXTS[:6] + TEXTS[9:]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_tandem_runs(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text in rows:
        words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, collapsed = _slow(" ".join(words))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want.append((doc_id, len(runs), *one, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 8
