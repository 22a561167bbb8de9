"""SimHash near-duplicates at a similarity, for corpus stages: BK-trees over fingerprints, every link proven.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8;
classes are what links join. At that similarity a 64-bit fingerprint of the shingles differs in some
ten bits, so blocks of equal bits would lose links, and no radius alone separates copies from others.
Shards are therefore dealt by 32 MinHash bands of four values (a pair at 0.8 shares none with a
probability of 5e-8). Each shard's fingerprints stand in a BK-tree, a search follows only the edges
within RADIUS (24 bits, over four standard deviations above what such a pair differs by), and each
link found is proven on the shingles themselves, so no false one joins a class.

Only the texts of shards with several members travel, and of shards with the same members one. A
subtree that lies wholly in the searcher's class is passed over, so a dense group costs about its
size. A shard of more than BLOCK members is compared in pairs of blocks, so no task holds more than
two blocks of one.

Null and blank texts have no shingle and link with each other; a text of fewer words than a shingle is
one shingle; texts with the same shingles are compared once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import packed, small, stored, unpacked
from fieldloom.llm.simhash import Forest, components, majority

SHINGLE_WORDS, SEED, BANDS, BAND_ROWS, RADIUS = 5, 42, 32, 4, 24
#: Members of a shard that are compared at once, and those of several shards that share a forest.
BLOCK, TOGETHER = 2048, 1024

_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    last = ends[min(SHINGLE_WORDS, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def bands(own: np.ndarray) -> list[int]:
    """A signed key for each band of the set's least values."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for low in range(0, len(own), 4096):
        np.minimum(least, ((own[low : low + 4096, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    raw, width = least.tobytes(), 8 * BAND_ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity is at least 0.8, that is 9 x shared >= 4 x (both sizes)."""
    need = 4 * (len(a) + len(b))
    return 9 * min(len(a), len(b)) >= need and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= need


def joins(shard: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first of its class; links lie inside a shard, and shard is sorted."""
    prints = np.array([majority(own, len(own)) for own in sets], np.uint64)
    return Forest(shard, prints, RADIUS, lambda i, j: alike(sets[i], sets[j])).link_all()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            told = pa.array([xxhash.xxh128_digest(own.tobytes()) for own in sets], pa.binary())
            keys = pa.array([bands(own) for own in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), told, keys], names=["digest", "doc_id", "told", "bands"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards, names, sets = [], [], []

    def done() -> pa.RecordBatch:
        label = joins(np.array(shards, np.int64), sets)
        tied = np.flatnonzero(label != np.arange(len(label))).tolist()
        ends = [pa.array([names[k] for k in side], pa.binary()) for side in (label[tied].tolist(), tied)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            for shard, name, text in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns)):
                if len(names) >= TOGETHER and shard != shards[-1]:
                    yield done()
                    shards, names, sets = [], [], []
                shards.append(shard)
                names.append(name)
                sets.append(shingles(text))
    yield done()


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the class's smallest doc_id, of every row; digest (MD5 of the text) and root (the class itself) tell rows of one doc_id apart."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "doc_id", "text")
    rows = stored(docs.mapInArrow(_banded, "digest binary, doc_id long, told binary, bands array<long>"), "bands")
    # of texts with the same shingles one stands for all
    texts = stored(rows.groupBy("told").agg(F.min("digest").alias("digest"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "shingle-sets")
    keys = texts.select("digest", F.explode("bands").alias("key"))
    told = [F.bit_xor(F.xxhash64(F.lit(k), "digest")).alias(f"x{k}") for k in (0, 1)]
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *told).where("n > 1")
    buckets = stored(buckets.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = keys.join(small(buckets), "key").select("digest", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("digest"), blocks).alias("own"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least("own", o), F.greatest("own", o)))
    members = stored(members.select("digest", F.explode(pairs).alias("shard")), "members")
    wanted = small(stored(members.select("digest").distinct(), "digests"))
    own = docs.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "text")
    dealt = members.join(own, "digest").select("shard", "digest", "text").repartition("shard").sortWithinPartitions("shard", "digest")
    links = components(dealt.mapInArrow(_linked, "a binary, b binary").distinct())
    rooted = texts.select("told", "digest", "least").join(links.withColumnRenamed("v", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of_root, "root").select("told", "component_id", "root")
    return rows.select("told", "doc_id", "digest").join(named, "told").select("doc_id", "component_id", "digest", "root")


def first_of_classes(documents: DataFrame) -> DataFrame:
    """documents less near copies: of each class the row with the smallest doc_id, of equal ones that with the smallest digest.

    Of rows with one doc_id and one text the first by their other columns stays. Rows without a doc_id all stay.
    """
    found = stored(near_copies(documents), "classes").where("doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    each = found.groupBy("doc_id", "digest", "root").agg(F.count(F.lit(1)).alias("n")).join(first, "root")
    chosen = F.struct("doc_id", "digest") == F.col("first")
    gone = small(stored(each.where(~chosen | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), chosen.alias("_stays")), "gone"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = packed(documents).withColumn("id", F.col("row.doc_id").cast("long")).withColumn("text_digest", F.unhex(F.md5(text.cast("binary"))))
    same = (F.col("id") == F.col("_id")) & (F.col("text_digest") == F.col("_digest"))
    kept = rows.join(gone, same, "left_anti").select("row")
    repeated = rows.join(gone.where("_stays"), same, "left_semi").groupBy("id", "text_digest").agg(F.min("row").alias("row")).select("row")
    whole = kept.unionByName(repeated)
    return whole.select(*unpacked(whole))
