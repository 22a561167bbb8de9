"""Pieces several training-data operators share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import cut, shared_root  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the contracts call white space: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
#: Rows a join side may have to be sent to every executor; above it the join shuffles.
BROADCAST_ROWS = 200_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/fieldloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
        parent.getFileSystem(conf).delete(parent, True)
    except Exception:  # the JVM may have gone first; the folder is then the cluster's to clean
        pass


def release(spark: SparkSession, path: str) -> None:
    """Removes a path of scratch() that nothing reads any more."""
    _remove(spark, path)


def packed(df: DataFrame, *named: Column) -> DataFrame:
    """df with all its columns in one, `row`, beside the named ones, so that no names clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *named)


def unpacked(df: DataFrame) -> list[Column]:
    """The columns of df's `row`."""
    return [F.col("row").getField(c).alias(c) for c in df.schema["row"].dataType.names]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count proves that it has at most that many rows; else df as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of those names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_words(text: Column) -> Column:
    """The words of text between runs of white space as the contracts define it."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))


def lines_without(text: Column, gone: Column) -> Column:
    """text less the lines at the positions in gone, a sorted array from 0."""

    def cut_out(lines: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        piece = lambda b: lambda k: F.slice(lines, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1)
        return let(bounds, lambda b: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), piece(b))), "\n"))

    return let(F.split(text, "\n", -1), cut_out)


def covered(spans: Column) -> Column:
    """How many positions the (start, length) structs of a sorted array cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("reach"))

    def step(acc: Column, span: Column) -> Column:
        end = (span["start"] + span["length"]).cast("long")
        begin = F.greatest(acc["reach"], span["start"].cast("long"))
        return F.struct((acc["n"] + F.greatest(end - begin, F.lit(0).cast("long"))).alias("n"), F.greatest(acc["reach"], end).alias("reach"))

    return F.aggregate(spans, start, step)["n"]
