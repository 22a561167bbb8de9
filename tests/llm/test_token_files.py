"""Token files: exact round trips, access to any document, the encoder against the tokenizer itself, damaged files."""

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import token_files as tf
from fieldloom.llm.elias_fano import EliasFano
from fieldloom.llm.queries import tokenizer_file

from .util import docs

PATH = tokenizer_file("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tf.Encoder(PATH)


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def encoded(texts):
    return [np.frombuffer(b, ENCODER.kind).tolist() for b in ENCODER.ids(texts)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Zé1.,!'\n\t\r  ᠎\x1c\x85<|>endoftx中ß"))), max_size=6))
def test_encoder_gives_the_tokenizers_ids(texts):
    assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoded([text, text + " end.", " " + text]) == [plain(text), plain(text + " end."), plain(" " + text)]


def test_encoder_on_odd_texts():
    texts = [
        None, "", " ", "  ", "a  b   c", "it's we'll I'd x's. y!? end...", "one.\nTwo,\n\nThree\n four \n five", "x <|endoftext|> y  <|endoftext|>z",
        "ǆa, ɐb, ħ.", "don't. can't! 12,000.50", "word " * 3000, "w" * 5000, "a." * 500, "tail. ", "tail.\n", "\n", " \n a",
    ]
    for _ in range(2):
        assert encoded(texts) == [plain(t) for t in texts]
    assert all(len(k) <= tf.KNOWN_BYTES for k in [*ENCODER.known, *ENCODER.words])


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 20)
    small, rng = tf.Encoder(PATH), random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choice(["alpha.", "beta", "gamma,\nx"]) + str(rng.randrange(40)) for _ in range(9))
        assert [np.frombuffer(b, small.kind).tolist() for b in small.ids([text])] == [plain(text)]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 2, 3], list(range(0, 100000, 7)), [2**63, 2**64 - 1], [0] * 600 + [10**12] * 600, [3, 3, 4, 10**6]])
def test_elias_fano(values):
    ef = EliasFano.of(np.array(values, np.uint64))
    again = EliasFano.of_parts(ef.n, ef.parts())
    assert again[np.arange(len(values))].tolist() == values
    with pytest.raises(IndexError):
        again[len(values)]
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_elias_fano_space():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(1, 1400, 50_000))
    ef = EliasFano.of(values)
    bits = 8 * sum(map(len, ef.parts())) / len(values)
    assert bits < 3.2 + np.log2(values[-1] / len(values)) and (ef[rng.integers(0, 50_000, 999)] <= values[-1]).all()
    at = rng.integers(0, 50_000, 999)
    assert (ef[at].astype(np.int64) == values[at]).all()


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = plain(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1 << 27, 50])
def test_round_trip(spark, tmp_path, file_ids):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "gamma\n", "été", "x  y"]) for _ in range(rng.randrange(0, 40)))) for k in range(-40, 160)]
    rows += [(10**15, "long " * 20000), (-(2**63), None), (2**63 - 1, "")]
    path = str(tmp_path / "ids")
    mixed = rows[:]
    rng.shuffle(mixed)
    tf.write(docs(spark, mixed).repartition(5).selectExpr("*", "1 as at", "2 as ids"), path, PATH, file_ids=file_ids)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tf.read(spark, path, range_ids=100).collect()]
    want = expected(sorted(rows))
    assert sorted(got) == sorted(want)
    for place in (0, 1, 77, len(rows) - 1):
        doc_id, ids = tf.document(path, place)
        assert (doc_id, len(ids), zlib.crc32(ids.tobytes())) == (want[place][0], *want[place][2:])
    with pytest.raises(IndexError):
        tf.document(path, len(rows))


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(None, "first null"), (5, "five a"), (None, None), (5, "five b"), (5, "five a"), (1, "one")]
    tf.write(docs(spark, rows).coalesce(1), str(tmp_path / "ids"), PATH)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tf.read(spark, str(tmp_path / "ids")).collect()]
    assert got == expected([rows[0], rows[2], rows[5], rows[1], rows[3], rows[4]])


def test_empty_table(spark, tmp_path):
    tf.write(docs(spark, []), str(tmp_path / "ids"), PATH)
    assert tf.read(spark, str(tmp_path / "ids")).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    path = str(tmp_path / "ids")
    tf.write(docs(spark, [(k, "some words here") for k in range(50)]).coalesce(1), path, PATH)
    (name,) = [f for f in os.listdir(path) if f.endswith(".bin")]
    raw = open(f"{path}/{name}", "rb").read()
    for bad in (raw[:-1], raw[10:], raw[:-60] + bytes([raw[-60] ^ 1]) + raw[-59:], b""):
        open(f"{path}/{name}", "wb").write(bad)
        with pytest.raises(Exception):
            tf.read(spark, path).collect()
    open(f"{path}/stray-{name}", "wb").write(b"left by a lost executor")
    open(f"{path}/{name}", "wb").write(raw)
    assert tf.read(spark, path).count() == 50
