"""Classes of one number: natural breaks by one-dimensional k-means over value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import cut


def natural_breaks(rows: DataFrame, column: str, k: int = 3, rounds: int = 100) -> DataFrame:
    """(class, break): the largest value of each cluster; centres start evenly spread and stop when they stand still.

    Each round is one aggregation to k rows, so the driver holds k centres and nothing else. Where a
    cluster stays empty the breaks are the values a k-th, two k-ths, ... into the sorted rows, and the
    largest; fewer than k rows have no breaks.
    """
    counts = cut(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    low, high, total = counts.agg(F.min("v"), F.max("v"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spark = rows.sparkSession
    if total < k:
        return spark.createDataFrame([], "class int, break double")
    centres, found = [low + (high - low) * c / (k - 1) for c in range(k)], None
    for _ in range(rounds):
        apart = F.array(*[F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)])
        found = counts.withColumn("c", F.array_min(apart)["c"]).groupBy("c").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"), F.max("v").alias("top")).collect()
        moved = {r.c: r.m for r in found}
        after = [moved.get(i, c) for i, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    tops = {r.c: r.top for r in found}
    if len(tops) < k:
        near = counts.agg(*[F.percentile("v", F.lit((total * c // k) / max(total - 1, 1)), F.col("n")).alias(f"_{c}") for c in range(1, k)]).first()
        exact = counts.agg(*[F.min_by("v", F.abs(F.col("v") - near[c - 1])).alias(f"_{c}") for c in range(1, k)]).first()
        return spark.createDataFrame([*[(c, exact[c - 1]) for c in range(1, k)], (k, high)], "class int, break double")
    return spark.createDataFrame([(i + 1, tops[i]) for i in range(k)], "class int, break double")
