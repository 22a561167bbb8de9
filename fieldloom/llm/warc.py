"""WARC archives: a writer, and a reader that verifies record boundaries by their chain.

A scan task finds every place that could start a record (the magic, a header with a length, the
closing blank lines before and after) and emits it with the offset of its successor. A payload may hold such text
itself, so candidates prove nothing alone: pointer jumping from each file's start keeps only those
that the chain of successors reaches. A chain never leaves its file, so the pairs of numbers are dealt
by file once and all rounds of jumping run on one file's arrays; payloads are no part of that.

An archive is bounded in bytes by the writer (FILE_BYTES, or one record if that is larger), so what a
scan task and a chain hold is bounded too.

Null html is an empty payload; a null url leaves its header out; rows that share a payload and the
largest page_id are all responses; an empty table gives no archive and no record; a file whose chain
does not end at its last byte is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import scratch, small, stored

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are written again instead of being referred to.
REVISIT_BYTES = 1000
#: More than a header has besides its url.
HEADER_BYTES = 1024
#: Records and bytes in one archive file; a record longer than that has a file to itself.
FILE_RECORDS, FILE_BYTES = 1024, 1 << 28


def with_digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
    )


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """One record per page into text files under path whose row separator closes a WARC record."""
    rows = with_digests(pages)
    groups = (
        rows.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    groups = small(stored(groups, "payload-groups"))
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    rows = rows.join(groups, same, "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    # Spark's writer counts records, not bytes: long ones are written apart, fewer to a file
    size = F.col("payload_bytes") + F.coalesce(F.octet_length(url), F.lit(0)) + HEADER_BYTES
    plain = max(1, file_bytes // file_records)
    write = lambda df, at, n: df.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", n).text(f"{path}/{at}")
    write(rows.where(size <= plain), "plain", file_records)
    # by doubling sizes, so that how many go to a file follows from their own lengths and not from the longest of all
    size_class = F.floor(F.log2(size / plain)).cast("int")
    long = rows.where(size > plain)
    lengths = pages.select((F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long") + F.coalesce(F.octet_length(F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")), F.lit(0)) + HEADER_BYTES).alias("size"))
    found = lengths.where(F.col("size") > plain).groupBy(F.floor(F.log2(F.col("size") / plain)).cast("int").alias("c")).count().collect()  # a row for each doubling
    for row in sorted(found):
        write(long.where(size_class == row.c), f"long-{row.c}", max(1, file_bytes // (plain << (row.c + 1))))


def _record_at(data: bytes, start: int) -> tuple[int, int, int, dict[str, str]] | None:
    """Payload start and end, successor and header of what could be a record at start."""
    close = data.find(b"\r\n\r\n", start)
    if close < 0:
        return None
    head = {}
    for line in data[start + len(MAGIC) : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    begin = close + 4
    end = begin + int(length)
    return (begin, end, end + 4, head) if data[end : end + 4] == b"\r\n\r\n" else None


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


#: In place of an offset: the row that tells a file's size.
FILE_END = -1
CANDIDATE = pa.schema([
    ("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("intact", pa.bool_()), ("payload", pa.binary()),
])
CANDIDATE_DDL = (
    "path string, at long, next long, page_id long, url string, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, intact boolean, payload binary"
)


def _scan(with_payload: bool):
    def candidates(path: str, data: bytes) -> Iterator[dict]:
        at = data.find(MAGIC)
        while at >= 0:
            # a record follows a closing, so headers of candidates never overlap and need no bound
            if (not at or data[at - 4 : at] == b"\r\n\r\n") and (found := _record_at(data, at)):
                begin, end, after, head = found
                kind = head.get("warc-type", "")
                said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                payload = data[begin:end]
                digest = said if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                size = head.get("warc-payload-length", "") if kind == "revisit" else str(end - begin)
                yield {
                    "path": path, "at": at, "next": after, "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"),
                    "record_type": kind, "refers_to": _page(head.get("warc-refers-to")), "payload_bytes": int(size) if size.isdigit() else None,
                    "payload_digest": digest, "intact": digest == said, "payload": payload if with_payload else None,
                }
            at = data.find(MAGIC, at + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                rows, held = [{"path": path.as_py(), "at": FILE_END, "next": len(data)}], 0
                for row in candidates(path.as_py(), data):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) == 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, CANDIDATE)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, CANDIDATE)

    return scan


def chained(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate of a file, rising in at, whether the chain from offset 0 reaches it, by pointer jumping.

    After k rounds the pointers jump 2^k records and the first 2^k of the chain are known.
    """
    n = len(at)
    known = np.zeros(n + 1, bool)  # place n is the end of every chain
    if n and at[0] == 0:
        known[0] = True
        place = np.searchsorted(at, after)
        jump = np.r_[np.where(at[np.minimum(place, n - 1)] == after, place, n), n]
        while (jump[known] != n).any():
            known[jump[known]] = True
            jump = jump[jump]
    return known[:n]


def _reached(links: pa.Table) -> pa.Table:
    at, after = (links.column(c).to_numpy() for c in ("at", "next"))
    order = np.argsort(at, kind="stable")
    at, after = at[order], after[order]
    size = after[0] if len(at) and at[0] == FILE_END else -1
    at, after = at[at >= 0], after[at >= 0]
    kept = chained(at, after)
    end = after[kept].max() if kept.any() else 0
    torn = size >= 0 and end != size
    path = links.column("path")[0].as_py()
    found = np.r_[at[kept], [FILE_END] * int(torn)]
    return pa.table({"path": pa.array([path] * len(found), pa.string()), "at": found.astype(np.int64), "end": np.full(len(found), end, np.int64), "size": np.full(len(found), size, np.int64)})


def reachable(links: DataFrame) -> DataFrame:
    """links(path, at, next) -> (path, at, end, size) that the chain from offset 0 reaches.

    A link at FILE_END tells a file's size; a file whose chain ends elsewhere gets a row at FILE_END.
    """
    return links.select("path", "at", "next").groupBy("path").applyInArrow(_reached, "path string, at long, end long, size long")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under path that the boundary chain confirms; a file whose chain stops before its end is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    found = stored(files.select("path", "content").mapInArrow(_scan(with_payload), CANDIDATE_DDL), "record-candidates")
    kept = stored(reachable(found.select("path", "at", "next")), "record-offsets")
    torn = kept.where(F.col("at") == FILE_END).first()
    if torn:
        raise ValueError(f"{torn.path}: records end at byte {torn.end} of {torn.size}")
    return found.join(kept.select("path", "at").hint("merge"), ["path", "at"], "left_semi")  # offsets grow with the input: never broadcast


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder and read back, without the payloads."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path)
    records = read_archives(spark, path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")
