"""Language identification by the nearest of several centroids per language.

Texts become vectors of hashed character n-grams (of 1 to 4 bytes, lower-cased, everything but
letters taken as one space), weighted by TF-IDF and normalised. Document frequencies cover every
training row. Up to SAMPLE rows of each language are clustered on the driver into CENTROIDS unit
vectors; a text takes the language of the centroid with the largest cosine. A cosine below what the
language's own training rows have (their REJECT quantile, less a margin) marks the row as rejected.

Null texts and texts without a letter are `und` with score 0, and so is every text where nothing was
learned; rows without lang teach nothing; a null doc_id counts as not held out; repeats and ties are
resolved alike (the first language by name); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldloom.llm.common import small

BUCKETS = 1 << 12
#: Training rows per language that the centroids are fitted on, and how they are fitted.
SAMPLE, CENTROIDS, ROUNDS, SEED = 300, 4, 12, 7
REJECT, MARGIN = 0.01, 0.05
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are neither ASCII letters nor part of other characters count as a space.
FOLD = np.where((np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128), np.arange(256), 32).astype(np.uint8)
MIX = np.uint32(2654435761)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur; a long text is hashed in blocks."""
    folded = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    space = folded == 32
    folded = folded[~(space & np.r_[False, space[:-1]])]
    grams, n = np.zeros(BUCKETS, np.int64), len(folded)
    for low in range(0, n, BLOCK):
        code = np.zeros(0, np.uint32)
        for size in range(1, min(4, n) + 1):
            part = folded[low + size - 1 : min(low + BLOCK, n - size + 1) + size - 1].astype(np.uint32)
            code = part if size == 1 else code[: len(part)] * np.uint32(257) + part
            grams += np.bincount(((code + np.uint32(size)) * MIX) >> np.uint32(20), minlength=BUCKETS)
    return grams


def _vectors(texts: list[str], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        out[k] = np.log1p(counts(text)) * weight
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            for text in batch.slice(low, 256).column(0).to_pylist():
                total += counts(text) > 0
                rows += 1
    bucket = np.r_[np.arange(BUCKETS), -1]
    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.r_[total, rows])], names=["bucket", "n"])


def _sampled(weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = _vectors(part.column(1).to_pylist(), weight).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in made], pa.binary())], names=["lang", "vector"])

    return run


def _cluster(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit(documents: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """The model, from rows with text and lang that are not held out."""
    taught = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = taught.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = {r.bucket: r.n for r in taught.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    rows = found.pop(-1, 0)
    if not rows:
        return {"langs": [], "of": np.zeros(0, int), "centres": np.zeros((0, BUCKETS), np.float32), "weight": np.ones(BUCKETS, np.float32), "least": np.zeros(0)}
    df = np.array([found.get(b, 0) for b in range(BUCKETS)])
    weight = (np.log((1 + rows) / (1 + df)) + 0.1).astype(np.float32)
    each = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    near = taught.withColumn("_draw", draw).join(small(each), "lang").where(F.col("_draw") / float(1 << 30) < F.lit(2.0 * sample) / F.col("_n"))
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id")
    chosen = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("lang", "text")
    got = chosen.mapInArrow(_sampled(weight), "lang string, vector binary").collect()
    langs, centres, of, least = sorted({r.lang for r in got}), [], [], []
    for k, lang in enumerate(langs):
        own = np.stack([np.frombuffer(r.vector, np.float16) for r in sorted(got) if r.lang == lang]).astype(np.float32)
        made = _cluster(own, centroids, np.random.default_rng(SEED))
        centres.append(made)
        of += [k] * len(made)
        least.append(float(np.quantile((own @ made.T).max(axis=1), REJECT)) - MARGIN)
    return {"langs": langs, "of": np.array(of), "centres": np.concatenate(centres), "weight": weight, "least": np.array(least)}


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                known = [bool(m["langs"]) and LETTER.search(t) is not None for t in texts]
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if any(known):
                    near = _vectors(texts, m["weight"]) @ m["centres"].T
                    which = near.argmax(axis=1)
                    best, score = m["of"][which], near[np.arange(len(texts)), which].clip(0, 1).astype(float)
                lang = [m["langs"][b] if k else UNKNOWN for b, k in zip(best, known)]
                out = [bool(k) and s < m["least"][b] for b, s, k in zip(best, score, known)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(out, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(documents: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; model is fitted on documents unless given."""
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # centroids and weights: a few hundred kB per language
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
