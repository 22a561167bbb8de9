"""The batch operators over streams: the quality gate, daily screens, late data and repeated submissions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from fieldloom.operators.quality import gate

#: How long a device may stay unsynchronised.
SYNC = "72 hours"


def read_events(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """A stream of parquet files with its event time as a timestamp that a watermark takes."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def gated(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The gate keeps no state, so a stream passes it as a table does."""
    return gate(events, rules)


def daily_counts(events: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    return events.withWatermark(time, SYNC).groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), *keys, "n")


def without_repeats(events: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    return events.withWatermark(time, SYNC).dropDuplicatesWithinWatermark(keys)


#: Stand for no instant, a visit without an end or no visit yet, after which nothing begins soon; and for all time.
NEVER, NO_END = -(2**63), 2**63


def overlaps(visits: DataFrame, gap_minutes: float, late: str | None = None) -> DataFrame:
    """visits(who, start, end, id) of a stream: those that begin less than gap_minutes after the one before ended.

    With `late`, as SYNC, it is the answer of the batch form, in whatever order visits come in: a visit waits until the watermark (the latest start
    less `late`) has passed its start, and is then judged in order of start and id. What comes later than that is dropped
    by Spark and counted in its progress. An enumerator's state is the visits that wait and the end of the last one judged;
    it goes as soon as no visit that may still come could be too close. A visit without a start is never judged, one
    without an end is followed by none too closely, enumerators and ids may be null. A task holds what one
    enumerator sends in one batch or within `late`, so bound a batch by the source's maxFilesPerTrigger.

    Without `late` nothing waits and nothing is dropped: visits are judged as they come, those of a batch in order and a later
    one by what was known by then; an enumerator's state is one instant, kept as long as the stream runs.
    """
    apart = round(gap_minutes * 60_000_000)

    def step(key, batches, state):
        starts, ends, ids, last = state.get if state.exists else ((), (), (), NEVER)
        waiting = list(zip(starts, ids, ends))
        for rows in batches:
            waiting += zip(rows["start"].tolist(), rows["id"].tolist(), rows["end"].tolist())
        waiting.sort()
        mark, found, n = NO_END if late is None else state.getCurrentWatermarkMs(), [], 0
        while n < len(waiting) and waiting[n][0] // 1000 <= mark:
            start, number, end = waiting[n]
            if last != NEVER and start - last < apart:
                found.append((key[0], None if number == NEVER else number, (start - last) / 6e7))
            last, n = end, n + 1
        waiting = waiting[n:]
        # woken once the watermark has reached the next start, or when nothing can follow the last visit closely any more
        wake = waiting[0][0] // 1000 - 1 if waiting else -((-last - apart) // 1000)
        if late is None or waiting or wake > mark:
            state.update((*[[int(x[k]) for x in waiting] for k in (0, 2, 1)], int(last)))
            if late is not None:
                state.setTimeoutTimestamp(max(wake, mark, 1))
        elif state.exists:
            state.remove()
        out = pd.DataFrame(found, columns=["who", "id", "gap"])
        yield out.astype({"id": "Int64", "gap": "float64"})

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = visits.select(
        F.col("who").cast("string").alias("who"), micros("start").alias("start"), F.coalesce(micros("end"), F.lit(NEVER)).alias("end"), F.coalesce(F.col("id").cast("long"), F.lit(NEVER)).alias("id"),
        F.date_trunc("MILLISECOND", F.col("start").cast("timestamp")).alias("moment"),
    )
    marked = (timed if late is None else timed.withWatermark("moment", late)).where("start is not null")
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return marked.groupBy("who").applyInPandasWithState(step, "who string, id long, gap double", "starts array<long>, ends array<long>, ids array<long>, last long", "append", timeout)


def into_folder(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream to the end of its input into parquet files at path; a run after a failure goes on at its checkpoint.

    Each batch has a folder of its own, named by its number and replaced as a whole, so a batch that is run again after a
    failure leaves its rows once. In the complete mode the latest batch is the result, and takes the place of the one before.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def from_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """What into_folder has written so far."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
