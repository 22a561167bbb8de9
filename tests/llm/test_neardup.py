"""The near_dedup stage against all pairs by five-word shingles."""

import random

import corpus_pipeline
from fieldloom.llm import neardup

from .util import docs


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 9999)}"
    rows, at = [(900, None), (901, " \t"), (902, "one two"), (903, "One  two"), (904, "one three"), (None, "one two")], 0
    for n in (100, 200, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            rows.append((at, " ".join(base)))
            for k in range(1, 4):
                changed = list(base)
                for place in rng.sample(range(n), max(1, n * k // 90)):
                    changed[place] = word()
                rows.append((at + k, " ".join(changed)))
            at += 10
    rng.shuffle(rows)
    return rows


def test_stage_drops_near_copies_down_to_four_fifths(spark):
    rows = corpus()
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    shares = []
    for i in range(len(rows)):
        for j in range(i):
            share = jaccard(sets[i], sets[j])
            shares.append(share)
            if share >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert all(any(low <= s < low + 0.05 for s in shares) for low in (0.75, 0.8, 0.85, 0.9))
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [i for (i, _), c in zip(rows, label) if i is None or least[c] == i]
    got = corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()
    number = lambda i: -1 if i is None else i
    assert sorted(number(r.doc_id) for r in got) == sorted(map(number, want))
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), "").count() == 0


def test_hot_shards_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    test_stage_drops_near_copies_down_to_four_fifths(spark)


def test_joins_equal_all_pairs():
    rng = random.Random(2)
    for size in (4, 9, 60, 300):
        sets, shard = [], []
        for _ in range(30):
            base = [rng.getrandbits(64) for _ in range(size)]
            for k in range(6):
                gone = k * size // 40
                sets.append(base[gone:] + [rng.getrandbits(64) for _ in range(gone // 2 + (k == 5))])
        order = list(range(len(sets)))
        rng.shuffle(order)
        sets = [sets[i] for i in order]
        shard = neardup.np.sort(neardup.np.array([rng.randint(0, 2) for _ in sets]))
        label = neardup.joins(shard, [neardup.np.array(sorted(s), neardup.np.uint64) for s in sets]).tolist()
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if shard[i] == shard[j] and jaccard(set(sets[i]), set(sets[j])) >= 0.8:
                    old, new = max(want[i], want[j]), min(want[i], want[j])
                    want = [new if x == old else x for x in want]
        assert label == want


def test_the_radius_loses_no_pair_at_four_fifths():
    rng, most = random.Random(3), 0
    for shared in (4, 8, 16, 40, 80, 200, 400):
        for _ in range(1500 if shared < 100 else 300):
            a = neardup.np.array([rng.getrandbits(64) for _ in range(shared + shared // 4)], neardup.np.uint64)
            left = rng.randint(0, shared // 4)
            one, two = neardup.np.r_[a[:shared], a[shared : shared + left]], neardup.np.r_[a[:shared], a[shared + left :]]
            most = max(most, (neardup.majority(one, len(one)) ^ neardup.majority(two, len(two))).bit_count())
    assert most <= neardup.RADIUS


def test_rows_of_one_id_are_told_apart_by_their_text(spark):
    rng = random.Random(8)
    long = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
    a, b, c = long(), long(), long()
    rows = [(1, a, "aa"), (2, a, "aa"), (2, b, "aa"), (3, c, "bb"), (3, c, "aa"), (4, c, "aa"), (None, a, "aa"), (None, a, "aa"), (5, b + " more", "aa"), (6, None, "aa"), (7, "", "aa")]
    for _ in range(2):
        rng.shuffle(rows)
        got = corpus_pipeline.near_dedup(spark, docs(spark, rows).repartition(3), None).collect()
        want = [(1, a, "aa"), (2, b, "aa"), (3, c, "aa"), (None, a, "aa"), (None, a, "aa"), (6, None, "aa")]
        assert sorted(((r.doc_id, r.text, r.lang) for r in got), key=repr) == sorted(want, key=repr)
