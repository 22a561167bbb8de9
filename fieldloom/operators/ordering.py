"""Orders over whole tables without a window that holds one in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import cut

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast where a count shows few rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of the order, each row with its range (_part) and place in it (_at); cut, so both stay as they are."""
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return cut(dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 1, 2, ... in the given order: numbers within ranges, plus the rows of the ranges before.

    The order has to be total for the numbers to be defined; the table of ranges has a row per partition.
    """
    parts = _ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start")


def filled_forward(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """df with the last value so far in each column that is null: within ranges, then from the ranges before."""
    parts = _ranged(df, order)
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    near = parts.withColumns({c: F.last(c, True).over(own) for c in columns})
    tails = parts.groupBy("_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_part", *[F.last(f"_t_{c}", True).over(before).alias(f"_b_{c}") for c in columns])
    out = near.join(F.broadcast(carried), "_part").withColumns({c: F.coalesce(c, f"_b_{c}") for c in columns})
    return out.drop("_part", "_at", *[f"_b_{c}" for c in columns])


def group_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The exact quantile of each group, interpolated linearly, nulls left out: a group may span all ranges of the order.

    Equal values are counted first; ranges of (group, value) know how many rows stand before them, so
    only the one or two values at the quantile's place are picked, and no task sees a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = cut(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part", *by).agg(F.sum("_n").alias("_all"))
    over = Window.partitionBy(*by)
    before = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumns({"_start": F.coalesce(F.sum("_all").over(before), F.lit(0)), "_total": F.sum("_all").over(over)})
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], "_start", "_total")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    placed = dealt.join(F.broadcast(starts), same)  # a row per range and group in it
    near = F.sum("_n").over(Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_last", F.col("_start") + near - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    place = (F.col("_total") - 1) * q
    at = lambda k: F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_v")))
    found = placed.groupBy(*by).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.max(place - F.floor(place)).alias("_f"))
    return found.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: an aggregation that combines before it shuffles, not a window."""
    whole = F.struct(*df.columns)
    rank = F.struct(*order) if order else whole
    return df.groupBy(*keys).agg(F.min_by(whole, rank).alias("_r")).select("_r.*")
