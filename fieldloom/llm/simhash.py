"""SimHash near-duplicates through BK-trees.

Every text gets a 64-bit fingerprint; only distinct fingerprints are compared. The 64 bits are cut
into six blocks, so two fingerprints that differ in at most four bits agree in two whole blocks.
Each of the fifteen pairs of blocks, with its bits, names a shard, and every link lies inside one.
A shard's BK-tree has children keyed by their integer distance to the parent; a search follows only
the edges within the radius. All trees of a partition are built and searched together in numpy.

A tree of the whole corpus can't be broadcast within a proven size, nor collected on the driver, so
shards are dealt out by a shuffle and each tree lives in the task that holds its shard. A search does
not emit its pairs: links join local classes, and a subtree that lies wholly in the searcher's class
is passed over, so a dense group costs about its size and leaves one edge per member. The edges of
all shards then meet in star contraction, which needs a few rounds of joins.

Null and blank texts have fingerprint zero and link like others; a null doc_id gets a fingerprint
and the class's smallest doc_id; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, stored

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Lowest bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Pairs of a search that are held at once.
FRONTIER = 1 << 19

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray, n: int, counts: np.ndarray | None = None) -> int:
    """The bits that are set in more than half of n hashes; counts are those of hashes before."""
    counts = np.zeros((8, 8), np.int64) if counts is None else counts
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts[k] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
    bits = (2 * counts.reshape(64) > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_in: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bits set in more than half of the hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    counts, n = np.zeros((8, 8), np.int64), len(words) - words_in + 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        pairs = zip(starts[low:high].tolist(), ends[low + words_in - 1 : high + words_in - 1].tolist())
        found = majority(np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, high - low), n, counts)
    return found


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the classes of each a and b one; a class's label is its smallest index."""
    while len(a):
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label[:] = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


class Forest:
    """BK-trees over the fingerprints of many shards, one tree for each shard."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray, radius: int, proof: Callable[[int, int], bool] | None = None):
        """shard is sorted; with a proof, fingerprints within the radius link only if it holds for their places."""
        self.prints, self.radius, self.proof, n = prints, radius, proof, len(prints)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.label = np.arange(n)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = np.flatnonzero(~first)
        at, keys, children = self.root[waiting], [], []
        while len(waiting):
            apart = self._apart(waiting, at)
            near = apart <= radius
            self._link(waiting[near], at[near])
            key, index, back = np.unique(at * 65 + apart, return_index=True, return_inverse=True)
            child = waiting[index]
            keys.append(key)
            children.append(child)
            self.levels.append((key // 65, child))
            rest = np.ones(len(waiting), bool)
            rest[index] = False
            waiting, at = waiting[rest], child[back][rest]
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.zeros(0, np.int64)
        self.edge = np.concatenate(keys)[order] if keys else np.zeros(0, np.int64)
        self.child = np.concatenate(children)[order] if keys else np.zeros(0, np.int64)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.proof:
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            proven = []
            for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = top(int(self.label[i])), top(int(self.label[j]))
                if x != y and self.proof(i, j):
                    up[max(x, y)] = min(x, y)
                    proven.append(k)
            a, b = a[proven], b[proven]
        _merge(self.label, a, b)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).astype(np.int64)

    def _spread(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest class in each node's subtree."""
        low, high = self.label.copy(), self.label.copy()
        for parent, child in reversed(self.levels):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return low, high

    def link_all(self) -> np.ndarray:
        """Searches every member's tree for it; afterwards label holds the classes."""
        n = len(self.prints)
        step = max(1024, n // 16)
        for begin in range(0, n, step):
            low, high = self._spread()
            seekers = np.arange(begin, min(n, begin + step))
            stack = [(seekers, self.root[seekers])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                    continue
                todo = (low[node] != high[node]) | (low[node] != self.label[q])
                q, node = q[todo], node[todo]
                apart = self._apart(q, node)
                near = apart <= self.radius
                self._link(q[near], node[near])
                start = np.searchsorted(self.edge, node * 65 + np.maximum(apart - self.radius, 0))
                stop = np.searchsorted(self.edge, node * 65 + np.minimum(apart + self.radius, 64), side="right")
                many = stop - start
                total = int(many.sum())
                if total:
                    slot = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(total)
                    stack.append((np.repeat(q, many), self.child[slot]))
        return self.label


def _link_shards(radius: int):
    def linked(shard: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        _, back, many = np.unique(shard, return_inverse=True, return_counts=True)
        several = many[back] > 1
        shard, prints = shard[several], prints[several]
        label = Forest(shard, prints.view(np.uint64), radius).link_all()
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[tied]), pa.array(prints[label[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, prints = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on
            if whole > 1 << 16:
                yield linked(shard[:whole], prints[:whole])
                shard, prints = shard[whole:], prints[whole:]
        yield linked(shard, prints)

    return run


def shard_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints(fp), distinct -> edges (a, b) that join all fingerprints linked inside a shard."""
    block = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in BLOCKS]
    shards = [
        (F.shiftleft(block[i], BLOCKS[j][1]).bitwiseOR(block[j]) + F.lit(k << 22)).cast("int")
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))
    ]
    dealt = prints.select(F.explode(F.array(*shards)).alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_link_shards(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, root) for each vertex, by alternating large and small stars."""
    order = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(order(edges))
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut(order(large))
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.withColumnRenamed("a", "u").join(least, "u")
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(order(star))
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row."""
    prints = stored(fingerprints(documents), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = components(shard_links(classes.select("fp"), radius))
    rooted = classes.join(links.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of_root, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
