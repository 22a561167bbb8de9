import random

import numpy as np
import xxhash

from fieldloom.llm import simhash
from fieldloom.llm.simhash import components, fingerprint, near_duplicates, shard_links

from .util import docs


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints, radius=4):
    label = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One TWO three", "a b c d", "ÄÖ ß\x0bx y"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (4, 5, 50, 700)]
    assert [fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


def near_prints(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_links_and_components_equal_all_pairs(spark):
    prints = near_prints(random.Random(3), 150)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    root = {r.v: r.root for r in components(shard_links(df)).collect()}
    label = classes(prints)
    for i in range(len(prints)):
        for j in range(i):
            same = root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])
            assert same == (label[i] == label[j])


def test_forest_in_small_frontiers(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    rng = random.Random(9)
    prints = near_prints(rng, 200)
    rng.shuffle(prints)
    got = simhash.Forest(np.zeros(200, np.int64), np.array(prints, np.uint64), 4).link_all()
    assert got.tolist() == classes(prints)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_documents(spark):
    rng = random.Random(4)
    words = [" ".join(rng.choice(["red", "blue", "green", "sea", "sky"]) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(12)]
    rows = [(i, w) for i, w in enumerate(words)] + [(50 + i, w + " End") for i, w in enumerate(words)] + [(90, None), (91, "  "), (5, words[5]), (None, words[0])]
    got = near_duplicates(docs(spark, rows).selectExpr("*", "1 as fp")).collect()
    prints = [slow_print(t) for _, t in rows]
    label = classes(prints)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i or -1, p if p < 1 << 63 else p - (1 << 64), least[c]) for (i, _), p, c in zip(rows, prints, label))
    assert sorted((r.doc_id or -1, r.fp, r.component_id) for r in got) == want
    assert near_duplicates(docs(spark, [])).count() == 0
