"""A quality classifier over random-indexing word vectors.

Every word gives two tokens, its lower-cased letters and its shape (upper, lower, digit, other
letters and marks, runs shortened), and a third where it repeats the word before. A word longer than
PIECE characters (text without white space, encoded data) counts as its pieces of that length, all of them. A token's index
vector is sparse, ternary and drawn from its hash; its word vector is the sum of the index vectors
that stand near it, normalised. A document is the mean of its tokens' vectors, and a two-layer
network in numpy, with a temperature fitted on rows set aside, gives the probability of label 1.

The network and the word vectors are fitted on at most SAMPLE labelled rows of at most LONGEST
characters (of rows that repeat a doc_id, the least text); scoring covers every whole text, long ones too. Null and empty texts score the network's
value of an empty mean; where both labels are not there to learn from, the score is the share of
label 1 (or one half); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounded sample that the classifier is fitted on.
SAMPLE, LONGEST = 3000, 100_000
SIZE, MARKS, REACH = 64, 6, 3
MOST_WORDS, LEAST_COUNT = 20_000, 3
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 300, 0.01, 1e-3, 3
THRESHOLD = 0.3
#: Characters of the longest word that counts as one, and words whose tokens a worker remembers; so a bound in bytes, too.
PIECE, REMEMBERED = 48, 400_000

_CLASSES = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), None)]
_RUN = re.compile(r"(.)\1+", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    def kind(m: re.Match) -> str:
        w = m[0]
        return "X" if len(w) > 1 and w.isupper() else "Xx" if w[0].isupper() else "x"

    return _RUN.sub(r"\1\1", _LETTERS.sub(kind, re.sub(r"[0-9]+", "9", word)))


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[low : low + PIECE] for low in range(0, len(word), PIECE)]


def tokens(word: str) -> tuple[str, ...]:
    """The tokens of a word of at most PIECE characters."""
    body, mark = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
    if body.isalpha() and body.isascii():  # the same as below, for most words
        kind = "X" if len(body) > 1 and body.isupper() else "Xx" if body[0].isupper() else "x"
        return body.lower(), f"\x01{kind}{mark}"
    return "".join(_LETTERS.findall(word)).lower(), "\x01" + shape(word)


AGAIN = "\x02"


def _stream(text: str) -> list[str]:
    out, last = [], None
    for word in text.split():
        for piece in pieces(word):
            out += tokens(piece)
        if word == last:
            out.append(AGAIN)
        last = word
    return out


def _index(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's index vector, from its hash."""
    place, sign = np.zeros((len(names), MARKS), np.int64), np.zeros((len(names), MARKS))
    for k, name in enumerate(names):
        draw = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode("utf-8", "replace"))))
        place[k] = draw.choice(SIZE, MARKS, replace=False)
        sign[k] = draw.integers(0, 2, MARKS) * 2 - 1
    return place, sign


def word_vectors(streams: list[list[str]]) -> tuple[dict[str, int], np.ndarray]:
    count = Counter(t for s in streams for t in s)
    names = sorted(sorted(t for t in count if count[t] >= LEAST_COUNT), key=lambda t: -count[t])[:MOST_WORDS]
    row = {t: k for k, t in enumerate(names)}
    place, sign = _index(names)
    flat = np.zeros(len(names) * SIZE)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def spread() -> None:
        nonlocal flat
        if waiting:
            a, b = (np.concatenate(x) for x in zip(*waiting))
            for k in range(MARKS):
                flat += np.bincount(a * SIZE + place[b, k], weights=sign[b, k], minlength=len(flat))
            waiting.clear()

    held = 0
    for s in streams:
        ids = np.array([row.get(t, -1) for t in s], np.int64)
        for reach in range(1, REACH + 1):
            a, b = ids[:-reach], ids[reach:]
            both = (a >= 0) & (b >= 0)
            waiting += [(a[both], b[both]), (b[both], a[both])]
            held += 2 * int(both.sum())
        if held > 2_000_000:
            spread()
            held = 0
    spread()
    vectors = flat.reshape(-1, SIZE)
    return row, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Network:
    """Two layers, fitted by Adam; probabilities are calibrated by a temperature."""

    def __init__(self, rng: np.random.Generator, size: int):
        self.w = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.middle, self.spread, self.temperature = np.zeros(size), np.ones(size), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.middle) / self.spread @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        aside = np.arange(len(y)) % 5 == 0
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        z, t = (x[~aside] - self.middle) / self.spread, y[~aside]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ self.w[0] + self.w[1])
            off = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30))) - t) / len(t)
            back = np.outer(off, self.w[2]) * (1 - h * h)
            grads = [z.T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ off + DECAY * self.w[2], np.array([off.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        raw, t = self.logits(x[aside]), y[aside]
        loss = lambda temp: np.logaddexp(0, np.where(t == 1, -raw, raw) / temp).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if len(t) else 1.0
        return self


class Model:
    def __init__(self, row: dict[str, int], vectors: np.ndarray, network: Network | None, share: float):
        self.row, self.vectors, self.network, self.share = row, vectors, network, share
        self._seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def _rows(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The rows of words not met before; long ones are not remembered."""
        if len(self._seen) > REMEMBERED:
            self._seen = {}
        new = {w: tuple(self.row[t] for p in pieces(w) for t in tokens(p) if t in self.row) for w in words}
        self._seen.update((w, r) for w, r in new.items() if len(w) <= PIECE)
        return new

    def document(self, text: str) -> np.ndarray:
        """The mean of the vectors of the text's tokens."""
        words, total, n = text.split(), np.zeros(SIZE), 0
        for low in range(0, len(words), 1 << 14):
            part = words[low : low + (1 << 14)]
            rows = list(map(self._seen.get, part))
            if None in rows:
                new = self._rows({w for w, r in zip(part, rows) if r is None})
                rows = [new[w] if r is None else r for w, r in zip(part, rows)]
            ids = np.fromiter(chain.from_iterable(rows), np.int64)
            for k in range(0, len(ids), 1 << 16):
                total += self.vectors[ids[k : k + (1 << 16)]].sum(axis=0)
            n += len(ids)
        if AGAIN in self.row and (again := sum(map(str.__eq__, words, words[1:]))):
            total, n = total + again * self.vectors[self.row[AGAIN]], n + again
        return total / max(n, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.scores(np.stack([self.document(t) for t in texts]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From at most sample labelled rows outside the held-out ones, drawn by a hash of doc_id."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = marked.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("_y"))
    ids = ids.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", F.col("text").cast("string").alias("_t"))
    rows = sorted(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y")).collect())
    share = float(np.mean([r._y for r in rows])) if rows else 0.5
    streams = [_stream(r._t) for r in rows]
    row, vectors = word_vectors(streams)
    model = Model(row, vectors, None, share)
    if rows and 0 < share < 1:
        x, y = np.stack([model.document(r._t) for r in rows]), np.array([r._y for r in rows], float)
        model.network = Network(np.random.default_rng(SEED), SIZE).fit(x, y)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                scores = m.scores([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores.astype(float))], names=["doc_id", "held_out", "score"])

    return run


def classify(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = model or fit(documents, labels)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # at most MOST_WORDS vectors
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(sent), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
