"""Periodic stretches of words by the linear tandem-repeat method of Gusfield and Stoye.

A tandem repeat is a string of words twice in a row; a run is a longest stretch with a period. The method, for one
stretch of words:

1. The Lempel-Ziv blocks: each the longest that also begins earlier, else one word. The first occurrence of a
   tandem repeat never lies inside a block, so at each block's ends, for each period, common extensions to both
   sides give a set of repeats from which all first occurrences follow by rotation to the right.
2. Of that set each node of the suffix tree keeps what starts at its smallest leaf, and the repeats are marked
   at their places on the tree's edges, from the leaves up.
3. From each mark the suffix link leads to the repeat less its first word; if that word also follows there, the
   rotation is a repeat too and is marked. A walk ends at a mark or a word that doesn't follow. Now the whole
   vocabulary of tandem repeats is marked, each once.
4. Those whose half is no repetition itself are located by the leaves below them. Occurrences of a period that
   begin side by side merge into runs.

The suffix tree comes from sorted suffixes (ranks of stretches of 1, 2, 4, ... words, which also answer the common
extensions) and their common prefixes. Texts first are cut at triples of words too rare to be in a run, again
and again; a run of four periods has each of its triples three times, so no run is lost, and most texts are
done then. Documents are not shuffled: each is the work of one task, in memory of some 20 bytes a word
and power of two. The cost grows with the words times the logarithm of the longest stretch.

Null and blank texts have no words, no runs and an empty collapsed text; words are what stands between
`[\\x20\\x09-\\x0D]`; a null doc_id passes through; repeated rows are each worked on; other columns are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, EXPONENT = 6, 4
#: Words of documents that are looked at together.
TOGETHER = 1 << 18
#: Times that stretches are cut again; more would only save work.
CUTS = 8


@cache
def _primes(k: int) -> tuple[int, ...]:
    """The prime divisors of k."""
    out, d = [], 2
    while d * d <= k:
        if k % d == 0:
            out.append(d)
            while k % d == 0:
                k //= d
        d += 1
    return (*out, k) if k > 1 else tuple(out)


class Suffixes:
    """The sorted suffixes of a sequence of words, and common extensions of any two places."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.words, self.levels, step = rank, [rank.astype(np.int32)], 1
        while rank.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        self.order = np.argsort(rank, kind="stable")

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are the same, a and b being different; either may be the end."""
        a, b, last = a.copy(), b.copy(), self.n - 1
        begin = a.copy()
        for t in range(len(self.levels) - 1, -1, -1):
            level = self.levels[t]
            same = (level[np.minimum(a, last)] == level[np.minimum(b, last)]) & (np.maximum(a, b) <= last)
            a += same << t
            b += same << t
        return a - begin

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words just before a and before b are the same."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for t in range(len(self.levels) - 1, -1, -1):
            level = self.levels[t]
            same = (np.minimum(a, b) >= 1 << t) & (level[np.maximum(a - (1 << t), 0)] == level[np.maximum(b - (1 << t), 0)])
            a -= same << t
            b -= same << t
        return begin - a


def blocks(suffixes: Suffixes) -> np.ndarray:
    """The starts of the Lempel-Ziv blocks, and twice the end."""
    n, order = suffixes.n, suffixes.order.tolist()
    left, right, stack = [-1] * n, [-1] * n, []
    for p in order:  # of each place the nearest smaller ones before and after it in the order of suffixes
        while stack and stack[-1] > p:
            right[stack.pop()] = p
        left[p] = stack[-1] if stack else -1
        stack.append(p)
    longest, here = np.zeros(n, np.int64), np.arange(n)
    for other in (np.array(left), np.array(right)):
        there = np.flatnonzero(other >= 0)
        longest[there] = np.maximum(longest[there], suffixes.ahead(here[there], other[there]))
    size, out, at = longest.tolist(), [], 0
    while at < n:
        out.append(at)
        at += size[at] or 1
    return np.array([*out, n, n])


def covering(suffixes: Suffixes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods (at most `most`) of repeats of which all first occurrences are rotations to the right."""
    cut = blocks(suffixes)
    begin, end, beyond = cut[:-2], cut[1:-1], cut[2:]

    def periods(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.minimum(sizes, most)
        of = np.repeat(np.arange(len(sizes)), sizes)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

    # repeats that begin in a block and end after it: the word after the block has its pair in the block
    of, k = periods(np.where(end < suffixes.n, end - begin, 0))
    right = end[of]
    q = right - k
    ahead, behind = suffixes.ahead(q, right), suffixes.behind(q, right)
    start = np.maximum(q - behind, q - k + 1)
    found = (ahead + behind >= k) & (ahead > 0)
    starts, sizes = [start[found]], [k[found]]
    # repeats that begin before a block with their middle in it: the block's first word has its pair in it or the next
    of, k = periods(np.where(begin > 0, beyond - begin, 0))
    left = begin[of]
    q = left + k
    inside = q < suffixes.n
    of, k, left, q = of[inside], k[inside], left[inside], q[inside]
    ahead, behind = suffixes.ahead(left, q), suffixes.behind(left, q)
    start = np.maximum(left - behind, left - k + 1)
    found = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (start + k <= end[of])
    return np.concatenate([*starts, start[found]]), np.concatenate([*sizes, k[found]])


class Tree:
    """The suffix tree: leaves 0..n-1 by their place, then inner nodes, the root first."""

    def __init__(self, suffixes: Suffixes, starts: np.ndarray, periods: np.ndarray):
        """Builds the tree from the sorted suffixes and marks the repeats on the way up."""
        self.suffixes, n = suffixes, suffixes.n
        order, common = suffixes.order, np.zeros(n + 1, np.int64)
        common[1:n] = suffixes.ahead(order[:-1], order[1:])
        self.common = common
        due: dict[int, list[int]] = {}
        for i, k in sorted(set(zip(starts.tolist(), periods.tolist()))):
            due.setdefault(i, []).append(2 * k)  # the longest last
        # an end of text counts as a word of its own
        depth, low, high, least = (n + 1 - np.arange(n)).tolist() + [0], suffixes.rank.tolist() + [0], suffixes.rank.tolist() + [n - 1], [*range(n), n]
        parent, owner, self.marks = [-1] * (n + 1), [n] * (n + 1), []
        open_nodes, sizes = [n], common.tolist()

        def hang(child: int, node: int) -> None:
            parent[child] = node
            i = least[child]
            if i < least[node]:
                least[node] = i
            if i in due:
                lengths, above = due[i], depth[node]
                while lengths and lengths[-1] > above:
                    self.marks.append((child, lengths.pop()))

        for r, p in enumerate(order.tolist(), 1):
            size, child = sizes[r], p
            node = open_nodes[-1]
            while depth[node] > size:
                hang(child, node)
                high[node] = r - 1
                child = open_nodes.pop()
                node = open_nodes[-1]
            if depth[node] < size:
                node = len(depth)
                depth.append(size)
                low.append(low[child])
                high.append(0)
                least.append(n)
                parent.append(-1)
                open_nodes.append(node)
            hang(child, node)
            owner[r] = node
        self.depth, self.low, self.high, self.least, self.parent, self.owner = depth, low, high, least, parent, owner

    def links(self) -> list[int]:
        """Each inner node's suffix link, by its number less n: the node over its first and last leaf's next suffixes."""
        n, rank, order = self.suffixes.n, self.suffixes.rank, self.suffixes.order
        nodes = np.arange(n, len(self.depth))
        depth = np.array(self.depth[n:])
        link = np.full(len(nodes), n)
        deep = np.flatnonzero(depth > 1)
        if len(deep):
            a, b = rank[order[np.array(self.low[n:])[deep]] + 1], rank[order[np.array(self.high[n:])[deep]] + 1]
            a, b = np.minimum(a, b) + 1, np.maximum(a, b)
            # the place of the smallest common prefix between the two, by minima over powers of two
            least = [self.common * (n + 1) + np.arange(n + 1)]
            span = np.frexp(b - a + 1)[1] - 1
            for t in range(int(span.max())):
                least.append(np.minimum(least[-1][: -(1 << t)], least[-1][1 << t :]))
            at = np.empty(len(deep), np.int64)
            for t in np.unique(span):
                of = span == t
                at[of] = np.minimum(least[t][a[of]], least[t][b[of] + 1 - (1 << t)])
            link[deep] = np.array(self.owner)[at % (n + 1)]
        return link.tolist()

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The tree's places of all repeats: the node at or below each, and its period."""
        if not self.marks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, depth, least, parent, link = self.suffixes.n, self.depth, self.least, self.parent, self.links()
        words = self.suffixes.words.tolist()
        some = max(words) + 2
        pairs = np.array(parent), np.array(depth), np.array(least)
        children = np.r_[np.arange(n), np.arange(n + 1, len(depth))]
        above = pairs[0][children]
        first = np.append(self.suffixes.words, some - 1)[pairs[2][children] + pairs[1][above]]
        child = dict(zip((above * some + first).tolist(), children.tolist()))
        width = n + 2
        marked = {v * width + size for v, size in self.marks}
        for v, size in self.marks:
            target = size - 1
            while True:
                i = least[v]
                first = words[i]
                up = parent[v]
                node = n if up == n else link[up - n]
                # down along the words after the first, edge by edge
                below = node
                while depth[below] < target:
                    node = below
                    below = child[node * some + words[i + 1 + depth[node]]]
                if depth[below] == target:
                    v = child.get(below * some + first, -1)
                    if v < 0:
                        break
                else:
                    at = least[below] + target
                    if at >= n or words[at] != first:
                        break
                    v = below
                key = v * width + size
                if key in marked:
                    break
                marked.add(key)
        keys = np.fromiter(marked, np.int64, len(marked))
        return keys // width, keys % width // 2


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least least_words and exponent (2 or more) periods, sorted."""
    n = len(words)
    if n < max(2, least_words):
        return []
    suffixes = Suffixes(words)
    tree = Tree(suffixes, *covering(suffixes, n // exponent))
    node, period = tree.vocabulary()
    if not len(node):
        return []
    start = np.array(tree.least)[node]
    divisors = [_primes(k) for k in period.tolist()]
    of = np.repeat(np.arange(len(period)), list(map(len, divisors)))
    part = period[of] // np.array([r for d in divisors for r in d], np.int64)
    repeats = suffixes.ahead(start[of], start[of] + part) >= 2 * period[of] - part
    plain = np.ones(len(period), bool)
    plain[of[repeats]] = False
    node, period = node[plain], period[plain]
    low, many = np.array(tree.low)[node], np.array(tree.high)[node] - np.array(tree.low)[node] + 1
    leaf = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    place = np.sort(np.repeat(period, many) * (n + 1) + suffixes.order[leaf])
    new = np.r_[True, np.diff(place) != 1]
    first, last = place[new], place[np.r_[new[1:], True]]
    period, start = first // (n + 1), first % (n + 1)
    length = last - first + 2 * period
    long = length >= np.maximum(least_words, exponent * period)
    return sorted(zip(start[long].tolist(), length[long].tolist(), period[long].tolist()))


def stretches(words: np.ndarray, distinct: int, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Where runs can be: (start, stop) of what is left when words are cut at those too rare to be in one.

    With four periods and six words or more, each three words in a row of a run stand in it three times at least
    (a period apart); else each word stands in it as often as there are whole periods.
    """
    triple = exponent >= 4 and least_words >= 6
    gram, times = (3, min(exponent - 1, max(least_words, exponent) - 2)) if triple else (1, exponent)
    if len(words) < max(least_words, gram):
        return []
    code = words.astype(np.int64)
    if triple and distinct < 1 << 21:
        code = (code[:-2] * distinct + code[1:-1]) * distinct + code[2:]
    elif triple:
        pair = np.unique(code[:-1] * distinct + code[1:], return_inverse=True)[1]
        code = pair[:-1] * distinct + code[2:]
    at, key = np.arange(len(code)), code
    begin = size = np.zeros(0, np.int64)
    for _ in range(CUTS):
        back, often = np.unique(key, return_inverse=True, return_counts=True)[1:]
        often = often[back] >= times
        before = len(at)
        at, key = at[often], back[often]
        first = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        size = np.diff(np.r_[begin, len(at)])
        long = np.repeat(size >= least_words - gram + 1, size)
        of = np.repeat(np.arange(len(size)), size)
        at, key = at[long], key[long] + of[long] * (len(back) + 1)  # from now on counted by stretch
        begin, size = at[np.flatnonzero(np.r_[True, np.diff(at) != 1])] if len(at) else at, size[size >= least_words - gram + 1]
        if len(at) == before:
            break
    return [(int(a), int(a + s + gram - 1)) for a, s in zip(begin, size)]


def _documents(texts: list[bytes | None], least_words: int, exponent: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and its collapsed text."""
    split = [(t or b"").split() for t in texts]
    parts, base, offsets, at = [], 0, [], 0
    for words in split:
        number = dict(zip(dict.fromkeys(words), count(base)))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([base + len(number)]))  # a word of its own after each text
        base += len(number) + 1
        offsets.append(at)
        at += len(words) + 1
    together = np.concatenate(parts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = np.array(offsets)
    for a, b in stretches(together, base, least_words, exponent):
        k = int(np.searchsorted(places, a, side="right")) - 1
        found[k] += [(a - offsets[k] + s, length, q) for s, length, q in runs_of(together[a:b], least_words, exponent)]
    for words, runs in zip(split, found):
        runs.sort()
        if runs:
            gone = np.zeros(len(words), bool)
            for s, length, q in runs:
                gone[s + q : s + length] = True
            words = [words[k] for k in np.flatnonzero(~gone)]
        yield runs, b" ".join(words)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _repeats(least_words: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 6 + 1)
            low = 0
            while low < batch.num_rows:
                done = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, done + TOGETHER, side="right")))
                part = batch.slice(low, high - low)
                found = list(_documents(part.column(1).to_pylist(), least_words, exponent))
                runs = [[dict(zip(("start", "length", "period"), r)) for r in f] for f, _ in found]
                columns = [part.column(0), pa.array(runs, RUNS), pa.array([t for _, t in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])
                low = high

    return run


def tandem_runs(documents: DataFrame, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period of each, sorted) and collapsed (the text less what repeats a run's first period)."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = docs.mapInArrow(_repeats(least_words, exponent), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
