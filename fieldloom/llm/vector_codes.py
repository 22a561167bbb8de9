"""Vectors compressed to codes: one integer codebook for each of the vectors' parts, by exact rounds.

A component x becomes floor(1024 x), so that every distance and sum is an integer and the codes do
not depend on how the rows are split. The codebooks (256 entries a part, whatever the input's size) are
broadcast. Arrow batches get all distances of a part at once as |x|^2 - 2 x.c + |c|^2, the middle
term an int64 matrix product, and the first least one. A task adds its parts up by entry, so a round
shuffles at most 1,024 rows a task, grouped by part and entry, and the driver gets 1,024 sums. Each
round reads the table again; only the final codes are written, for the sums over labels.

Rows whose vector is null, or holds a null, a NaN or an infinite component, are dropped. The books start
from the smallest vec_ids (null ids last; equal ids in the order of their vectors); fewer than 256
kept rows make shorter books; an empty table gives no rows. Repeated rows count each and
are all coded; other columns are left alone. Kept vectors must have one length, a multiple of the
number of parts, and components within LIMIT, beyond which 64 bits can't hold a distance: anything else
is an error, never a wrong code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import BROADCAST_ROWS, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are below this in size, so a squared distance over 4,096 of them is exact.
LIMIT = 1 << 24
#: Rows whose distances are held at once; ENTRIES int64 each.
BLOCK = 2048


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows to keep, and their vectors as rows of integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    there = vectors.take(pa.array(at))
    lengths = pc.list_value_length(there).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(there.flatten(), pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(at)), lengths)
    good = np.ones(len(at), bool)
    good[row[~np.isfinite(values)]] = False
    at, lengths, values = at[good], lengths[good], values[good[row]]
    if len(at) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths.tolist()))[:5]}")
    whole = np.floor(values * scale)
    if len(whole) and np.abs(whole).max() >= LIMIT:
        raise ValueError(f"a component of {np.abs(values).max()} is too large for exact 64-bit distances")
    return at, whole.astype(np.int64).reshape(len(at), -1 if len(whole) else 0)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a part the first nearest entry of its book, and the squared distance to it."""
    turned, norms = np.ascontiguousarray(book.T), (book * book).sum(1)
    code, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for low in range(0, len(part), BLOCK):
        x = part[low : low + BLOCK]
        apart = norms - 2 * (x @ turned)
        first = apart.argmin(1)
        code[low : low + BLOCK] = first
        error[low : low + BLOCK] = apart[np.arange(len(x)), first] + (x * x).sum(1)
    return code, error


def _split(rows: np.ndarray, books: np.ndarray) -> list[np.ndarray]:
    parts, _, width = books.shape
    if len(rows) and rows.shape[1] != parts * width:
        raise ValueError(f"a vector of {rows.shape[1]} components beside ones of {parts * width}")
    return [np.ascontiguousarray(rows[:, p * width : (p + 1) * width]) for p in range(parts if len(rows) else 0)]


def _seeds(scale: int, entries: int):
    """The kept rows of a task with the smallest ids, as integers."""
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            at, rows = integers(batch.column(1), scale)
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            if len(best) == entries and best[-1][0] is False:  # what is larger than the last can't be among them
                rows_in = [k for k, v in enumerate(ids) if v is not None and v <= best[-1][1]]
            else:
                rows_in = range(len(ids))
            best = sorted(best + [(ids[k] is None, ids[k] or 0, rows[k].tolist()) for k in rows_in])[:entries]
        columns = [pa.array([None if b[0] else b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sums(broadcast, scale: int):
    """A task's counts and sums for each part and entry that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = broadcast.value
        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, rows = integers(batch.column(0), scale)
            for p, x in enumerate(_split(rows, books)):
                code, _ = nearest(x, books[p])
                count[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                met, first = np.unique(code[order], return_index=True)
                total[p, met] += np.add.reduceat(x[order], first, axis=0)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    return run


def _codes(broadcast, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = broadcast.value
        for batch in batches:
            at, rows = integers(batch.column(2), scale)
            found = [nearest(x, books[p]) for p, x in enumerate(_split(rows, books))]
            digits = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex() if found else ""
            size = 2 * len(books)
            code = [digits[k : k + size] for k in range(0, len(digits), size)]
            kept = pa.array(at)
            columns = [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found) if found else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The integer books (part, entry, position) after all rounds; vectors has vec_id and embedding."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    least = vectors.select("vec_id", "embedding").mapInArrow(_seeds(scale, entries), "vec_id long, vector array<long>")
    rows = least.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = np.array([r.vector for r in rows], np.int64)
    if not len(seeds):
        return np.zeros((parts, 0, 0), np.int64)
    if not seeds.shape[1] or seeds.shape[1] % parts:
        raise ValueError(f"vectors of {seeds.shape[1]} components can't be cut into {parts} equal parts")
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    width = books.shape[2]
    names = [f"s{k}" for k in range(width)]
    ddl = ", ".join(f"{n} long" for n in ("part", "entry", "n", *names))
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        met = vectors.select("embedding").mapInArrow(_sums(sent, scale), ddl).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        books = books.copy()
        for row in met.collect():  # at most parts * entries rows
            books[row[0], row[1]] = [s // row[2] for s in row[3:]]
        sent.destroy()
    return books


def _with_group_sums(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over rows with an equal label, nulls together.

    Sums of at most BROADCAST_ROWS labels are broadcast. Of more labels, those with so many rows that they could
    fill a task are: there can't be more than BROADCAST_ROWS of them; the rest join by a shuffle, where no key is hot.
    """
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    total = sums.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if total[0] <= BROADCAST_ROWS:
        return codes.join(F.broadcast(sums), same).drop("_label", "_rows")
    often: Column = F.col("_rows") > total[1] // BROADCAST_ROWS
    sums = stored(sums, "label-sums")
    first = codes.join(F.broadcast(sums.where(often)), same, "left")
    done, rest = first.where("_rows is not null"), first.where("_rows is null").drop("_label", "_rows", "label_error")
    return done.unionByName(rest.join(sums.where(~often), same)).drop("_label", "_rows")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept row of vectors (vec_id, embedding, label)."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("embedding"))
    books = codebooks(plain, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sent = plain.sparkSession.sparkContext.broadcast(books)
    kind = plain.schema["label"].dataType.simpleString()
    codes = stored(plain.mapInArrow(_codes(sent, scale), f"vec_id long, label {kind}, code string, error long"), "codes")
    return _with_group_sums(codes).withColumn("codebooks_sha256", F.lit(digest))


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    return [v for p, e in enumerate(bytes.fromhex(code)) for v in books[p, e].tolist()]
