"""Measures over tables: rates, ranks, classes, blocks, shares, dates and small reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numeric import t_cdf
from fieldloom.operators.ordering import _ranged, numbered, small
from fieldloom.session import cut


def visitation(units: DataFrame, key: str, sources: dict[str, DataFrame], none: str = "Non") -> DataFrame:
    """units with vis_status (V or NV) and vis_source: the first of the sources that holds the key."""
    out, held = units, []
    for k, (name, df) in enumerate(sources.items()):
        out = out.join(df.select(F.col(df.columns[0]).alias(key), F.lit(name).alias(f"_s{k}")).distinct(), key, "left")
        held.append(F.col(f"_s{k}"))
    source = F.coalesce(*held, F.lit(none))
    return out.withColumn("vis_status", F.when(F.coalesce(*held).isNull(), "NV").otherwise("V")).withColumn("vis_source", source).drop(*[f"_s{k}" for k in range(len(held))])


def percent_of(df: DataFrame, by: list[str], hit: Column, digits: int = 2) -> DataFrame:
    """total, visited and percent of each group."""
    n, of = F.count(F.lit(1)), F.count_if(F.coalesce(hit, F.lit(False)))
    return df.groupBy(*by).agg(n.alias("total"), of.alias("visited"), F.round(100.0 * of / n, digits).alias("percent"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of value, ties sharing their mean rank; sums run over distinct values in ranges, in no single task."""
    counts = _ranged(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [F.col(value)])
    from pyspark.sql import Window

    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    sizes = counts.groupBy("_part").agg(F.sum("_n").alias("_all"))
    starts = sizes.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranks = near.join(F.broadcast(starts), "_part").select(value, (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho and the two-sided p of Student's t on n - 2 degrees of freedom; rows without x or y are left out."""
    kept = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))  # once: ranks are joined by value, and a sum made again may differ in its last bit
    ranked = average_ranks(average_ranks(kept, x, "_rx"), y, "_ry")
    r = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho")).first()
    p = None
    if r.rho is not None and r.n > 2:
        t = abs(r.rho) * math.sqrt((r.n - 2) / max(1e-300, 1 - r.rho * r.rho))
        p = 2 * (1 - t_cdf(t, r.n - 2))
    return df.sparkSession.createDataFrame([(r.n, r.rho, p)], "n long, rho double, p double")


def screened_spearman(df: DataFrame, x: str, y: str, key: str, excluded: DataFrame) -> DataFrame:
    """spearman over all rows and, as `screen` 'screened', without those whose key is one of excluded(key); rows without a key stay."""
    kept = df.join(excluded.select(key).distinct(), key, "left_anti")
    return spearman(df, x, y).withColumn("screen", F.lit("unscreened")).unionByName(spearman(kept, x, y).withColumn("screen", F.lit("screened")))


def ols(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))


def equal_interval(df: DataFrame, value: str, labels: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """df with class: equal intervals of the value's range, the upper end included."""
    ends = df.agg(F.min(value).alias("_lo"), ((F.max(value) - F.min(value)) / len(labels)).alias("_s"))
    out = F.lit(labels[-1])
    for k in range(len(labels) - 1, 0, -1):
        out = F.when(F.col(value) <= F.col("_lo") + k * F.col("_s"), labels[k - 1]).otherwise(out)
    return df.crossJoin(F.broadcast(ends)).withColumn("class", out).drop("_lo", "_s")  # ends has one row


def pivot_counts(df: DataFrame, by: str, column: str, values: dict[str, str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(name) for v, name in values.items()])


def top(df: DataFrame, order: list, k: int, name: str = "priority_rank") -> DataFrame:
    """The first k rows of a total order, numbered: each task keeps k, so nothing is sorted whole."""
    return numbered(df.orderBy(*order).limit(k), order, name)


def ends(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k and the last k rows of an order, a row that is both once, with `side`."""
    first = df.orderBy(*[F.asc(c) for c in order]).limit(k).withColumn("side", F.lit("lowest"))
    last = df.orderBy(*[F.desc(c) for c in order]).limit(k).withColumn("side", F.lit("highest"))
    return first.unionByName(last.join(first.select(*order), order, "left_anti"))


def every_kth(df: DataFrame, order: list, k: int) -> DataFrame:
    """Rows 1, k + 1, 2k + 1, ... of an order: a sampling operator."""
    return numbered(df, order, "_place").where(F.col("_place") % k == (1 if k > 1 else 0)).drop("_place")


def first_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """Of rows with one text the least key, and how many there are; combined before the shuffle, by hash and text."""
    return df.groupBy(F.xxhash64(text).alias("_h"), text).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")).select(key, "n_copies")


def key_sides(left: DataFrame, right: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Keys of left(k) and right(k) with the side they are on: both or left alone."""
    a, b = left.distinct(), right.distinct().withColumn("_in", F.lit(True))
    return a.join(b, "k", "left").select("k", F.when(F.col("_in"), names[0]).otherwise(names[1]).alias("side"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return df.groupBy(*by).agg(F.coalesce(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total), F.lit(0)).alias("w_avg"))


def staffing(units: DataFrame, norms: dict[str, int], kind: str, have: str) -> DataFrame:
    """units with state and shortfall: a unit's norm is the one whose name its kind begins with."""
    need = F.lit(None).cast("int")
    cat = F.lit(None).cast("string")
    for name, n in norms.items():
        need, cat = F.when(F.startswith(F.col(kind), F.lit(name)), n).otherwise(need), F.when(F.startswith(F.col(kind), F.lit(name)), name).otherwise(cat)
    state = F.when(cat.isNull(), "unknown").when(F.col(have) >= need, "adequate").otherwise("inadequate")
    short = F.when(F.col(have) < need, F.concat(cat, F.lit(":"), F.col(have).cast("string"), F.lit("/"), need.cast("string"))).otherwise("")
    return units.withColumn("state", state).withColumn("shortfall", short)


def totals_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose totals left(k, n) and right(k, m) differ, an absent one being 0."""
    both = left.join(right, "k", "full_outer").na.fill(0, ["n", "m"])
    return both.where("n <> m")


def reallocation(spark, takes: list[int], budget: float, icc: float) -> DataFrame:
    """For each take per cluster: clusters within the budget, design effect and effective sample."""
    t = F.col("take")
    deff = 1 + (t - 1) * icc
    return spark.createDataFrame([(k,) for k in takes], "take int").select("take", F.floor(budget / t).cast("long").alias("clusters"), F.round(deff, 4).alias("deff"), F.round(budget / deff, 2).alias("n_eff"))


def cutoff_sweep(zones: DataFrame, cutoffs: list[float]) -> DataFrame:
    """zones(zone, deficit, closure): how many zones and how much deficit each cutoff lays to staffing."""
    table = zones.sparkSession.createDataFrame([(float(c),) for c in cutoffs], "cutoff double")
    hit = F.col("closure") >= F.col("cutoff")
    each = zones.crossJoin(F.broadcast(table)).groupBy("cutoff")  # a handful of cutoffs
    return each.agg(F.count_if(hit).alias("staffing"), F.count_if(~hit).alias("absent"), F.sum(F.when(hit, F.col("deficit")).otherwise(0)).alias("by_staffing"))


def crowded(zones: DataFrame, covered: Column, staff: str = "staff", share: float = 0.1) -> DataFrame:
    """Covered zones whose staff is at or below the share's quantile over all zones."""
    cut = zones.agg(F.percentile(staff, F.lit(share)).alias("_p"))
    return zones.crossJoin(F.broadcast(cut)).where(covered & (F.col(staff) <= F.col("_p"))).drop("_p")


def hybrid_minutes(direct: Column, walk: Column, network: Column) -> tuple[Column, Column]:
    """The faster of a direct walk and a walk to the network, and which it is."""
    return F.least(direct, walk + network), F.when(walk + network < direct, "network").otherwise("direct")


def mode_least(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, of ties the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def histogram(df: DataFrame, value: str, bins: int = 34) -> DataFrame:
    """bin (from 0), low and n of equal bins from the least to the greatest value, which is in the last bin; empty bins too."""
    ends_ = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends_)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    full = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends_))
    return full.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), F.coalesce("_n", F.lit(0).cast("long")).alias("n"))


def contiguity(blocks: DataFrame, by: str) -> DataFrame:
    """blocks(by, lo, hi) with `next_lo` and `contiguous`: whether the next block of the group begins right after."""
    from pyspark.sql import Window

    after = F.lead("lo").over(Window.partitionBy(by).orderBy("lo", "hi"))
    return blocks.withColumn("next_lo", after).withColumn("contiguous", F.col("next_lo") == F.col("hi") + 1)


def cluster_means(rows: DataFrame, household: str, cluster: str) -> DataFrame:
    """The mean household size of each cluster: members per household, then households per cluster."""
    size = rows.groupBy(cluster, household).agg(F.count(F.lit(1)).alias("_n"))
    return size.groupBy(cluster).agg(F.count(F.lit(1)).alias("households"), F.avg("_n").alias("mean_size"))


def caterpillar(rows: DataFrame, cluster: str, stratum: str, value: str, flagged: list) -> DataFrame:
    """cluster, stratum, mean, size, flagged and its place in the order of the means."""
    means = rows.groupBy(cluster, stratum).agg(F.avg(value).alias("mean"), F.count(value).alias("size"))
    return numbered(means.withColumn("flagged", F.col(cluster).isin(flagged)), ["mean", cluster, stratum], "place")


def aligned(key: str, **series: DataFrame) -> DataFrame:
    """Series (key, v) side by side on their keys, keys that one lacks dropped."""
    parts = [df.select(key, F.col(df.columns[1]).alias(name)) for name, df in series.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts).na.drop()


def mixed_values(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows that agree on the key and differ in value, with both values; null differs from a value."""
    joined = left.join(right.select(*key, F.col(value).alias(f"other_{value}")), key)
    return joined.where(~F.col(value).eqNullSafe(F.col(f"other_{value}")))


def conditional_shares(df: DataFrame, by: str, order: list[str], hits: dict[str, Column]) -> DataFrame:
    """The share of each hit in the categories of a fixed order, with `place`; categories without rows are left out."""
    lists = df.sparkSession.createDataFrame(list(enumerate(order)), f"place int, `{by}` string")
    shares = df.groupBy(by).agg(*[F.avg(h.cast("double")).alias(n) for n, h in hits.items()])
    return shares.join(F.broadcast(lists), by).na.drop("all", subset=list(hits))


def coded(df: DataFrame, name: str, codes: DataFrame, code: str = "code") -> DataFrame:
    """df with the code of its name; names without one are an error."""
    out = df.join(small(codes.select(F.col("name").alias(name), code)), name, "left")
    lost = [r[0] for r in out.where(F.col(code).isNull()).select(name).distinct().limit(5).collect()]
    if lost:
        raise ValueError(f"no {code} for {lost}")
    return out


def chained_lookup(rows: DataFrame, levels: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """rows with `broken_at`: the first level (column, parent column, list(code, parent)) whose choice is not in its parent's list."""
    out, bad = rows, F.lit(None).cast("string")
    for k, (column, parent, codes) in enumerate(levels):
        known = small(codes.select(F.col("code").alias(column), F.col("parent").alias(parent), F.lit(True).alias(f"_k{k}")).distinct())
        out = out.join(known, [column, parent], "left")
    for k, (column, _, _) in reversed(list(enumerate(levels))):
        bad = F.when(F.col(f"_k{k}").isNull(), column).otherwise(bad)
    return out.withColumn("broken_at", bad).drop(*[f"_k{k}" for k in range(len(levels))])


def flag_equal(c: Column, flag: str) -> Column:
    """1 if the cell, as text and trimmed, is the flag; else 0, null too."""
    return F.coalesce(F.trim(c.cast("string")) == flag, F.lit(False)).cast("int")


def mapped(c: Column, table: dict, otherwise=None) -> Column:
    """A constant for each value of a column."""
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def at_24_months(length: Column, lying: Column, months: Column) -> Column:
    """A child's size as the growth standard takes it: lying under 24 months, standing from there on, 0.7 cm apart."""
    young = months < 24
    return F.when(young & ~lying, length + 0.7).when(~young & lying, length - 0.7).otherwise(length)


def detectable(se: Column) -> Column:
    """The least difference between two rounds that a standard error lets be seen: 80 % power at 5 %."""
    return 2.8 * math.sqrt(2) * se


def minutes_since(start: Column, now: Column) -> Column:
    """Whole minutes, cut towards zero."""
    return F.try_divide(F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp")), F.lit(60_000_000)).cast("int")


def gps_far(x: Column, y: Column, cx: Column, cy: Column, degrees: float = 0.05) -> Column:
    """Whether a fix lies further than so many degrees from its settlement's centre on either axis."""
    return F.coalesce((F.abs(x - cx) > degrees) | (F.abs(y - cy) > degrees), F.lit(False))


def qa_flags(h: DataFrame) -> DataFrame:
    """h(minutes, cards, children, roster, listed, specimens, due, temperature): the visit's flags, for review and never for removal."""
    rules = {
        "short": F.col("minutes") < 15, "no_cards": (F.col("children") > 0) & (F.col("cards") == 0), "roster_corrected": F.col("roster") != F.col("listed"),
        "specimen_shortfall": F.col("specimens") < F.col("due"), "cold_chain": ~F.col("temperature").between(2, 8),
    }
    return h.withColumns({f"f_{k}": F.coalesce(v, F.lit(False)) for k, v in rules.items()}).withColumn("flags", F.concat_ws(";", *[F.when(F.coalesce(v, F.lit(False)), k) for k, v in rules.items()]))


#: Severities of the integrity ledger, from the least.
SEVERITIES = ("info", "minor", "material", "critical")


def integrity_ledger(findings: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(check, severity, rows) -> a row per check with how many rows it found; checks that find nothing are info."""
    for _, severity, _ in findings:
        if severity not in SEVERITIES:
            raise ValueError(f"no severity: {severity}")
    each = [df.agg(F.count(F.lit(1)).alias("n_affected")).select(F.lit(c).alias("check"), F.when(F.col("n_affected") > 0, s).otherwise("info").alias("severity"), "n_affected") for c, s, df in findings]
    return reduce(DataFrame.unionByName, each)


def assumptions(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """The register of assumptions: id (A01, A02, ...), area, text, basis and what it bears on."""
    return spark.createDataFrame([(f"A{k + 1:02d}", *r) for k, r in enumerate(rows)], "id string, area string, assumption string, basis string, bears_on string")
