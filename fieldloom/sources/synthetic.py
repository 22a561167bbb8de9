"""Made-up submissions with one planted fabricator, for trying screens out: every value a hash of the row's place and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def submissions(spark: SparkSession, enumerators: int = 96, days: int = 14, fabricator: int = 42, start: str = "2026-06-01", seed: int = 7) -> DataFrame:
    """(who, day, start, end, minutes, modules, cards, eligible, specimens, lat, lon, id).

    Honest enumerators do 3 to 6 interviews a day of 22 to 55 minutes, move and see cards; the fabricator
    does 8 of 3 to 6 minutes a minute apart, from one place, without cards or specimens.
    """

    def draw(name: str, low: int, high: int, *of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *of), F.lit(high - low + 1)).cast("int") + low

    def share(name: str, *of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *of), F.lit(1_000_000)) / 1e6

    visits = spark.range(enumerators * days).select((F.col("id") % enumerators + 1).cast("int").alias("e"), F.floor(F.col("id") / enumerators).cast("int").alias("d"))
    fake, key = F.col("e") == fabricator, ("e", "d", "k")
    each = visits.withColumn("n", F.when(fake, 8).otherwise(draw("n", 3, 6, "e", "d"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = each.withColumn("minutes", F.when(fake, draw("m", 3, 6, *key)).otherwise(draw("m", 22, 55, *key))).withColumn("eligible", F.when(fake, draw("g", 1, 2, *key)).otherwise(draw("g", 0, 3, *key)))
    seen = lambda name, rate: F.when(fake, 0).otherwise(F.floor(F.col("eligible") * rate + share(name, *key)).cast("int"))
    began = F.lit(start).cast("timestamp") + F.make_dt_interval(F.col("d"), F.lit(9), (F.col("k") - 1) * F.when(fake, 7).otherwise(75))
    rows = rows.withColumn("start", began)
    place = lambda name, base: base + share(name, "e", "d") * 0.8 + F.when(fake, 0.0).otherwise((share(name + "k", *key) - 0.5) * 0.1)
    return rows.select(
        F.format_string("ENU%03d", "e").alias("who"), F.to_date("start").alias("day"), "start", (F.col("start") + F.make_dt_interval(mins=F.col("minutes"))).alias("end"), "minutes",
        F.col("eligible").alias("modules"), seen("c", 0.62).alias("cards"), "eligible", seen("s", 0.7).alias("specimens"), F.round(place("lat", 10.6), 6).alias("lat"), F.round(place("lon", 7.2), 6).alias("lon"),
        (F.col("d") * 100_000 + F.col("e") * 100 + F.col("k")).cast("long").alias("id"),
    )
