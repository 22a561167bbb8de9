"""Packing tokens into sequences by an order-preserving dynamic program.

A task takes its documents in the order of its input split, with no shuffle, and tokenizes them
whole. Windows may be cut at document ends (free), sentence ends (a small penalty) and, so that
every stretch can be cut, at places inside long sentences (a larger one). dp[j] is the least padding
plus penalties of windows that end at cut j. A window's padding falls by one with each token, so
the best start of the last 2048 tokens comes from a monotone queue in constant time; starts a power
of two away, which need no padding, are looked up. Plans run over stretches of about STRETCH tokens;
the last windows of a stretch are planned again with the next, so memory is bounded by the longest
document. The same split gives the same windows, so a lost task is simply run again.

Null and empty texts are the end id alone; a null doc_id passes through; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID = 2048, 1
#: In tokens of padding: what a cut inside a document costs at a sentence end and elsewhere, and what each window costs.
SENTENCE_CUT, OTHER_CUT, NEW_WINDOW = 2.0, 12.0, 0.5
#: Tokens between the places where a sentence may be cut.
CUT_EVERY = 256
STRETCH = 1 << 19
SHORT = tuple(1 << k for k in range(5, 11))
#: Pieces of text whose ids a worker remembers, and the bytes of the longest; so a bound in bytes, too.
KNOWN, KNOWN_BYTES = 600_000, 64
#: Marks that may follow a word; the apostrophe is not among them, as it opens contractions.
MARKS = b".,!?;:&$%*#|()-\""
END = np.array([END_ID], "<u4").tobytes()
#: The letters that byte-level vocabularies write for bytes which are not printable as they are, in the order of those bytes.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _letters(word: bytes) -> str:
    """The word composed and in lower case if it is then all letters, else ''; some letters become a letter and a mark."""
    text = word.decode()
    if not text.isalpha():
        return ""
    text = unicodedata.normalize("NFC", text)
    lower = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # the vocabulary knows no final form
    return lower if lower.isalpha() else ""


class Encoder:
    """Ids of texts as bytes. What stands between white space is encoded alone and remembered: the vocabulary's words never span it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        words = self.tokenizer.get_vocab()
        self.sentence_ends = np.zeros(max(words.values()) + 1, bool)
        self.sentence_ends[[words[t] for t in (".</w>", "!</w>", "?</w>", "...</w>", ".", "!", "?") if t in words]] = True

    def _encode(self, words: dict[bytes, str | None]) -> None:
        """Learns words, given with their letters or None; one of letters alone is a single word to the vocabulary and goes to its merges directly."""
        known, merge, alone = self.known, self.model.tokenize, []
        for w, letters in words.items():
            if w in known:
                continue
            if w.isalpha():
                letters = w.lower().decode()
            else:
                letters = _letters(w) if letters is None else letters
                if not letters:
                    alone.append((w, w.decode()))
                    continue
                letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
            known[w] = array("I", [t.id for t in merge(letters)]).tobytes()
        for (w, _), e in zip(alone, self.tokenizer.encode_batch_fast([t for _, t in alone], add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """Learns words; gives those too long to be remembered after this once."""
        if len(self.known) > KNOWN:
            self.known, self.before = {}, self.known
        known, before, tailed = self.known, self.before, []
        plain: dict[bytes, str | None] = {}
        for w in missing:
            if w in before:
                known[w] = before[w]
                continue
            # marks after letters are a word of their own to the vocabulary, whose words are letters or marks alone
            core = w.rstrip(MARKS)
            letters = None
            if len(core) < len(w) and core and (core.isalpha() or (letters := _letters(core))):
                tail = w[len(core) :]
                tailed.append((w, core, tail))
                plain[core], plain[tail] = letters, ""
            else:
                plain[w] = None
        self._encode(plain)
        for w, core, tail in tailed:
            known[w] = known[core] + known[tail]
        if max(map(len, missing)) <= KNOWN_BYTES:
            return []
        return [w for w in chain(missing, plain) if len(w) > KNOWN_BYTES]

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Of UTF-8 texts the ids, each with the end id."""
        # lower-casing ASCII first changes nothing but the spelling of special tokens
        words = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        # a small table for these texts alone stays in the processor's cache; the large one is asked once a word
        here = dict.fromkeys(chain.from_iterable(words))
        found = list(map(self.known.get, here))
        if None in found:
            long = self._learn([w for w, f in zip(here, found) if f is None])
            known = self.known
            found = [known[w] if f is None else f for w, f in zip(here, found)]
            for w in long:
                known.pop(w, None)
        here = dict(zip(here, found))
        return [b"".join(map(here.__getitem__, w)) + END for w in words]


def plan(at: list[int], cost: list[float]) -> list[int]:
    """Cut places at (from 0, rising) and what ending a window there costs -> the indexes of the chosen ends."""
    n = len(at)
    total, back, index = [0.0] * n, [0] * n, {at[0]: 0}
    queue, keys, head = [0], [float(at[0])], 0
    for j in range(1, n):
        p = at[j]
        low = p - WINDOW
        while at[queue[head]] < low:
            head += 1
        best, start = keys[head] + WINDOW - p, queue[head]
        for size in SHORT:
            i = index.get(p - size)
            if i is not None and total[i] < best:
                best, start = total[i], i
        best += cost[j] + NEW_WINDOW
        total[j], back[j] = best, start
        index[p] = j
        key = best + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class Packer:
    """Takes documents in order and gives the pieces of finished windows."""

    def __init__(self, sentence_ends: np.ndarray, first_sequence: int, with_ids: bool):
        self.sentence_ends, self.sequence, self.with_ids = sentence_ends, first_sequence, with_ids
        self.docs: list[tuple[int | None, int, bytes, int]] = []  # id, ids already out, the rest of the ids, all ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids) // 4))
        self.tokens += len(ids) // 4
        return self.flush(False) if self.tokens >= STRETCH else []

    def _cuts(self, last: bool) -> tuple[list[int], list[float]]:
        ids = np.frombuffer(b"".join([d[2] for d in self.docs]), "<u4")
        base, doc_ends = len(ids), np.cumsum([len(d[2]) // 4 for d in self.docs])
        ends = self.sentence_ends[ids]
        ends[np.maximum(doc_ends - 2, 0)] = False  # the end id stays with its sentence
        ends[doc_ends - 1] = True
        place = np.r_[0, np.flatnonzero(ends) + 1]
        cost = np.full(len(place), SENTENCE_CUT)
        cost[0] = cost[np.searchsorted(place, doc_ends)] = 0
        gaps = np.diff(place)
        if wide := [np.arange(place[k] + CUT_EVERY, place[k + 1], CUT_EVERY) for k in np.flatnonzero(gaps > CUT_EVERY)]:
            more = np.concatenate(wide)
            order = np.argsort(np.r_[place, more], kind="stable")
            place, cost = np.r_[place, more][order], np.r_[cost, np.full(len(more), OTHER_CUT)][order]
        if last:  # the tail may be cut anywhere, so that it falls into unpadded windows
            tail = np.setdiff1d(np.arange(max(1, base - WINDOW), base), place)
            place, cost = np.concatenate([place, tail]), np.concatenate([cost, np.full(len(tail), OTHER_CUT)])
            order = np.argsort(place, kind="stable")
            place, cost = place[order], cost[order]
        return place.tolist(), cost.tolist()

    def flush(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        at, cost = self._cuts(last)
        ends = [at[j] for j in plan(at, cost)]
        if not last:
            ends = [e for e in ends if e <= self.tokens - 4 * WINDOW]
        out, k, base, begin = [], 0, 0, 0
        rest: list[tuple[int | None, int, bytes, int]] = []
        stop = ends[-1] if ends else 0
        for doc_id, done, ids, total in self.docs:
            n, used = len(ids) // 4, 0
            while used < n and base + used < stop:
                if base + used == ends[k]:
                    begin, k = ends[k], k + 1
                    self.sequence += 1
                size = min(n - used, ends[k] - base - used)
                piece = ids[4 * used : 4 * (used + size)]
                row = (doc_id, done + used, size, zlib.crc32(piece), total, self.sequence, base + used - begin)
                out.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if self.with_ids else row)
                used += size
            if used < n:
                rest.append((doc_id, done + used, ids[4 * used :], total))
            base += n
        if ends:
            self.sequence += 1
        self.docs, self.tokens = rest, sum(len(d[2]) // 4 for d in rest)
        return out


PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, Encoder] = {}


def _pack(path: str, with_ids: bool):
    schema = pa.schema([*PIECE, ("ids", pa.list_(pa.int32()))] if with_ids else PIECE)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        gc.disable()  # a task makes millions of words and no cycles; it would only count them again and again
        packer = Packer(encoder.sentence_ends, TaskContext.get().partitionId() << 40, with_ids)
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 32):
                    part = batch.slice(low, 32)
                    rows: list[tuple] = []
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                        rows += packer.add(doc_id, ids)
                    if rows:
                        yield batch_of(rows)
            yield batch_of(packer.flush(True))
        finally:
            gc.enable()

    return run


def pack(documents: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of at most WINDOW ids; tokenizer is a vocabulary file's path on every executor."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, with_ids), PIECE_DDL + (", ids array<int>" if with_ids else ""))
