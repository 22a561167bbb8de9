"""The most similar of many names for each name, exactly, without comparing all with all.

The measure (functions.text.similarity) is 2M / S: M characters in blocks that follow one another in both names, of
S characters in both. Three bounds hold for it, each cheaper than the measure:

* blocks form a common subsequence, so M is at most the longest one's length, and that at most the number of
  characters in common, whatever their places;
* two blocks are never side by side in both names (the first found would have taken the other in), so each gap
  takes one of the S - 2M unmatched characters, there are at most 1 + S - 2M blocks, and at least
  3M - S - 1 pairs of letters stand in both names.

For a threshold above 2/3 the last bound gives a least number of common pairs, and so an index: the pairs of a
name are ordered by how rare they are, and two names with enough in common share one among the first of each. Names
meet by a join on those, the number of common pairs is checked, and only what is left is measured. What reaches
the threshold is settled: no other name can be better. Thresholds fall from ring to ring.

Before that, names meet those that are one letter longer or shorter, by a join on the names without each of their letters.
With two letters or more in one name alone the measure is at most n / (n + 1) for a name of n letters; what is above is
settled. So names that have nearly all letters in common, in which no pair is rare, need no index.

Names that no ring settles meet all others in blocks of bounded size (as all do where one block holds everything, or where
names have so much in common that the index would meet a large share of all pairs). There the first two bounds are
computed for a whole block at once and only names that may beat the best so far, or equal it and come before it, are measured.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import similarity
from fieldloom.operators.ordering import numbered
from fieldloom.session import cut

#: Thresholds of the index, falling; the bound on common pairs says nothing at 2/3 and below.
RINGS = (0.9, 0.75)
#: Names of each side that meet in one task.
BLOCK = 2048
#: Kinds of characters that are counted apart; more kinds than these share a count, which only raises the bound.
KINDS = 64
EPS = 1e-9
#: Names up to this length are sought without one of their letters.
SHORT = 64
#: A pair met by the index costs as much as this many in a block.
DEAR = 16


def _pairs(names: DataFrame, name: str) -> DataFrame:
    """name, and its pairs of letters with the number of the occurrence: a set as large as the name has pairs."""
    at = F.when(F.length(name) > 1, F.sequence(F.lit(1), F.length(name) - 1)).otherwise(F.array().cast("array<int>"))
    each = names.select(name, F.explode(F.transform(at, lambda i: F.substring(F.col(name), i, F.lit(2)))).alias("pair"))
    many = each.groupBy(name, "pair").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return many.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat("pair", F.lit(" "), k.cast("string")))).alias("gram"))


def _ordered(grams: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """name and its grams, the rarest of the authority first."""
    known = grams.join(often, "gram", "left").select(name, F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram").alias("g"))
    return known.groupBy(name).agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gram"]).alias("grams"))


def _least_length(length: Column, t: float) -> Column:
    return F.ceil(length * (t / (2 - t)) - EPS)


def _least_common(total: Column, t: float) -> Column:
    """Pairs of letters that two names of total characters share if their similarity is t or more."""
    return 3 * F.ceil(total * (t / 2) - EPS) - total - 1


def _prefix(name: str, t: float) -> Column:
    """The grams of which two similar names share one at least; null where the bound says nothing."""
    length = F.length(name)
    least = F.ceil((length + _least_length(length, t)) * (1.5 * t - 1) - 1 - EPS)
    return F.when(least > 0, F.slice("grams", F.lit(1), F.greatest(F.size("grams") - least + 1, F.lit(0)).cast("int")))


def _ring(open_: DataFrame, keys: DataFrame, t: float) -> DataFrame:
    """(k, key, score) of all pairs that reach t, and of others that may, for the open names the index can settle."""
    mine = open_.select("k", F.col("grams").alias("mine"), F.explode(_prefix("k", t)).alias("gram"))
    theirs = keys.select("key", F.col("grams").alias("theirs"), F.explode(F.coalesce(_prefix("key", t), F.col("grams"))).alias("gram"))
    total = F.length("k") + F.length("key")
    near = (F.length("key") >= _least_length(F.length("k"), t)) & (F.length("k") >= _least_length(F.length("key"), t))
    met = mine.join(theirs, "gram").where(near).where(F.size(F.array_intersect("mine", "theirs")) >= _least_common(total, t))
    return met.select("k", "key").distinct().withColumn("score", similarity(F.col("k"), F.col("key")))


def _meetings(open_: DataFrame, keys: DataFrame, t: float) -> int:
    """How often names meet in that ring."""
    of = lambda df, c, prefix: df.select(F.explode(prefix).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias(c))
    mine, theirs = of(open_, "n", _prefix("k", t)), of(keys, "m", F.coalesce(_prefix("key", t), F.col("grams")))
    return int(mine.join(theirs, "gram").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("m"))).first()[0] or 0)


def _shortened(names: DataFrame, name: str, longest: int) -> DataFrame:
    """name, and as `less` what is left without one of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.substring(F.col(name), i + 1, F.length(name))))
    return names.where(F.length(name).between(1, longest)).select(name, F.explode(F.array_distinct(without)).alias("less"))


def _one_letter(open_: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, key, score) of all pairs that are equal or differ by one letter more or less, for k of up to SHORT letters."""
    mine, theirs = open_.where(F.length("k") <= SHORT).select("k"), keys.select("key")
    same = mine.join(theirs, mine["k"] == theirs["key"])
    longer = _shortened(mine, "k", SHORT).join(theirs.withColumn("less", F.col("key")), "less").select("k", "key")
    shorter = mine.withColumn("less", F.col("k")).join(_shortened(theirs, "key", SHORT + 1), "less").select("k", "key")
    return same.unionByName(longer).unionByName(shorter).withColumn("score", similarity(F.col("k"), F.col("key")))


def _counts(names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), KINDS), np.int16)
    for row, name in zip(out, names):
        for c in name:
            row[ord(c) % KINDS] += 1
    return out


class _Block:
    """Names that many others are held against."""

    def __init__(self, names: list[str], places: list[int] | None = None):
        self.names, self.counts = names, _counts(names)
        self.places = np.arange(len(names)) if places is None else np.array(places)
        self.lengths = np.array([len(n) for n in names])
        self.short = self.lengths <= 63
        self.masks: dict[str, np.ndarray] = {}
        for k, name in enumerate(names):
            if len(name) <= 63:
                for p, c in enumerate(name):
                    if c not in self.masks:
                        self.masks[c] = np.zeros(len(names), np.uint64)
                    self.masks[c][k] |= np.uint64(1 << p)

    def common(self, name: str, rows: np.ndarray) -> np.ndarray:
        """At least the longest common subsequence's length: that itself for names of up to 63 characters, bit by bit for all rows."""
        out = np.minimum(self.counts[rows], _counts([name])[0]).sum(1).astype(np.int64)
        short = self.short[rows]
        at = rows[short]
        free = np.full(len(at), np.uint64(2**64 - 1))
        for c in name:
            if c in self.masks:
                held = free & self.masks[c][at]
                free = (free + held) | (free - held)
        out[short] = np.minimum(out[short], 64 - np.bitwise_count(free).astype(np.int64))
        return out

    def best(self, name: str, floor: float) -> tuple[int, float] | None:
        """(row, similarity) of the name that is most like it, if at least floor; of equals the one with the least place."""
        total = self.lengths + len(name)
        shared = np.minimum(self.counts, _counts([name])[0]).sum(1)
        rows = np.flatnonzero((2 * shared >= floor * total - EPS) & (total > 0))
        if not len(rows):
            return None
        bound = 2 * self.common(name, rows) / total[rows]
        may = bound >= floor - EPS
        rows, bound = rows[may], bound[may]
        found = None
        for k in np.lexsort((self.places[rows], -bound)):
            if bound[k] < floor - EPS:
                break
            later = found is not None and self.places[rows[k]] > self.places[found[0]]
            if later and bound[k] <= floor + EPS:
                continue
            score = SequenceMatcher(None, name, self.names[rows[k]]).ratio()
            if score > floor or score == floor and not later:
                found, floor = (int(rows[k]), score), score
        return found


def _blocks_best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    block, out = _Block(theirs["key"].tolist(), theirs["place"].tolist()), []
    for k, floor in zip(mine["k"], mine["floor"]):
        found = block.best(k, floor)
        if found:
            out.append((k, block.names[found[0]], found[1]))
    return pd.DataFrame(out, columns=["k", "key", "score"])


def _by_blocks(open_: DataFrame, keys: DataFrame, n: int, m: int, block: int) -> DataFrame:
    """(k, key, score) for n rows of open_(k, floor) against all m keys(key, place): the best of each k in each block, if it reaches its floor."""
    across, down = max(1, math.ceil(m / block)), max(1, math.ceil(n / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = open_.select("k", "floor", F.pmod(F.xxhash64("k"), F.lit(down)).cast("int").alias("q"), every(across).alias("p"))
    theirs = keys.select("key", "place", F.pmod(F.xxhash64("key"), F.lit(across)).cast("int").alias("p"), every(down).alias("q"))
    return mine.groupBy("q", "p").cogroup(theirs.groupBy("q", "p")).applyInPandas(_blocks_best, "k string, key string, score double")


def most_similar(names: DataFrame, authority: DataFrame, rings: tuple[float, ...] = RINGS, block: int = BLOCK) -> DataFrame:
    """names(k), distinct, against authority(key, first), keys distinct: k, score, and the key with the highest score.

    Of equally similar keys the one with the smallest `first` counts. A name that shares no character with any key has no row,
    nor has an empty one.
    """
    if any(t <= 2 / 3 for t in rings):
        raise ValueError("the bound on common pairs says nothing at 2/3 and below")
    open_ = cut(names.select("k").where("k <> ''").distinct())
    n = open_.count()
    if not n:
        return open_.select("k", F.lit(0.0).alias("score"), F.lit("").alias("key"))
    keys = cut(numbered(authority.select("key", "first").where("key <> ''"), ["first"], "place"))
    m = keys.count()
    if n * m <= block * block:  # one block at most: no index pays
        return _first_best(_by_blocks(open_.withColumn("floor", F.lit(0.0)), keys, n, m, block), keys)
    found = cut(_one_letter(open_, keys))
    settled = found.where(F.col("score") * (F.length("k") + 1) > F.length("k") + EPS).select("k").distinct()
    own = cut(open_.join(settled, "k", "left_anti"))
    if rings and not own.isEmpty():
        often = _pairs(keys, "key").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
        own, all_keys = cut(_ordered(_pairs(own, "k"), often, "k")), cut(_ordered(_pairs(keys, "key"), often, "key"))
        for t in rings:
            if _meetings(own, all_keys, t) * DEAR > own.count() * m:
                break  # the prefixes of lower thresholds are longer, and meet more
            scored = cut(_ring(own, all_keys, t))
            done = scored.where(F.col("score") >= t).select("k").distinct()
            found, settled = found.unionByName(scored), settled.unionByName(done)
            own = cut(own.join(done, "k", "left_anti"))
            if own.isEmpty():
                break
    seen = found.groupBy("k").agg(F.max("score").alias("floor"))
    rest = cut(open_.join(settled, "k", "left_anti").join(seen, "k", "left").select("k", F.coalesce("floor", F.lit(0.0)).alias("floor")))
    if not rest.isEmpty():
        found = found.unionByName(_by_blocks(rest, keys, rest.count(), m, block))
    return _first_best(found, keys)


def _first_best(found: DataFrame, keys: DataFrame) -> DataFrame:
    best = found.where("score > 0").join(keys, "key").groupBy("k").agg(F.min_by(F.struct("score", "key"), F.struct(-F.col("score"), F.col("first"))).alias("best"))
    return best.select("k", "best.score", "best.key")
