"""Exact line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches of rising doc_id. A batch's line keys, hashed to 128 bits, are grouped
and merge-joined against the runs of earlier batches: runs are bucketed and sorted by hash, so only
the batch moves. Keys that no run holds make a new run; when a level has FANOUT runs they are
compacted into one of the next level. A line goes if an earlier batch holds its key or if a smaller
doc_id of its own batch does, so each repeated key keeps its lines in the smallest doc_id alone.

Null and empty texts are one empty line; rows without a doc_id count as the smallest; rows that
repeat a doc_id are one document to the rule and keep their own lines each; extra columns pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import BLANKS, ascii_lower, lines_without, packed, release, scratch, stored, unpacked, without

#: Batches the table is taken in, and runs of a level that are compacted together.
BATCHES, FANOUT = 4, 2
#: Code points of the shortest key that counts.
KEY_CHARS = 10
NO_ID = -(2**63)
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
OUT = ("n_lines", "n_dropped")


def _keys(text: Column) -> Column:
    """For each line its key's two hashes, or null where the key is too short."""
    hashes = lambda k: F.when(F.length(k) >= KEY_CHARS, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2")))
    return F.transform(F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS))), hashes)


class Runs:
    """The runs of line hashes, by level."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.tag = uuid.uuid4().hex[:12]
        self.paths: dict[str, str] = {}

    def _write(self, hashes: DataFrame) -> str:
        name = f"line_run_{self.tag}_{len(self.paths)}"
        self.paths[name] = scratch(self.spark, name)
        dealt = hashes.repartition(self.buckets, "h1", "h2")
        before = self.spark.conf.get(ORDERED, None)
        self.spark.conf.set(ORDERED, "true")  # a bucket is one file here, so its order is the scan's and no join sorts a run again
        try:
            dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        finally:
            self.spark.conf.unset(ORDERED) if before is None else self.spark.conf.set(ORDERED, before)
        return name

    def drop(self) -> None:
        """Takes the runs out of the catalogue and the shared folder."""
        for name, path in self.paths.items():
            self.spark.sql(f"drop table if exists {name}")
            release(self.spark, path)

    def add(self, keys: DataFrame) -> DataFrame:
        """keys(h1, h2, first, last) of a batch -> the same with `seen`, now also in the runs."""
        seen = F.lit(False)
        for k, name in enumerate(x for level in self.levels for x in level):
            run = self.spark.table(name).where("not seen").select("h1", "h2", F.lit(True).alias(f"_in{k}"))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
            seen = seen | F.coalesce(F.col(f"_in{k}"), F.lit(False))
        name = self._write(keys.select("h1", "h2", "first", "last", seen.alias("seen")))
        self._push(0, name)
        return self.spark.table(name)

    def _push(self, level: int, name: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            runs = [self.spark.table(x).where("not seen") for x in self.levels[level]]
            merged = runs[0]
            for run in runs[1:]:
                merged = merged.unionByName(run)
            self.levels[level] = []
            self._push(level + 1, self._write(merged))


def dedup_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """documents with repeated lines taken out of text, and n_lines (before) and n_dropped."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    lines = documents.select(doc.alias("doc"), F.xxhash64(text).alias("hash"), F.posexplode(_keys(text)).alias("at", "key"))
    lines = lines.where("key is not null").select("doc", "hash", "at", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))

    cuts = documents.select(F.percentile_approx(doc, [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []))
    number = F.lit(0)
    for edge in edges:
        number = number + (F.col("doc") > F.lit(edge)).cast("int")
    held = scratch(spark, "line-hashes")
    lines.withColumn("batch", number).write.parquet(held)
    lines = spark.read.parquet(held)

    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    repeated = None
    for k in range(len(edges) + 1):
        found = runs.add(lines.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
        hit = found.where("seen or first <> last").select(F.lit(k).alias("batch"), "h1", "h2", F.when(~F.col("seen"), F.col("first")).alias("keeper"))
        repeated = hit if repeated is None else repeated.unionByName(hit)

    gone = (
        lines.join(repeated, ["batch", "h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "hash").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )
    gone = stored(gone, "repeated-lines")
    runs.drop()
    release(spark, held)
    own = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    joined = packed(without(documents, *OUT), doc.alias("doc"), F.xxhash64(text).alias("hash")).join(gone, ["doc", "hash"], "left")
    breaks = F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n")))
    kept = F.when(F.col("gone").isNull(), own).otherwise(lines_without(own, F.col("gone")))
    counts = [(breaks + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    out = joined.select("row", F.struct(kept.alias("text"), *counts).alias("new"))
    return out.select(*[F.col("new.text").alias(c) if c.lower() == "text" else column for c, column in zip(out.schema["row"].dataType.names, unpacked(out))], "new.n_lines", "new.n_dropped")
