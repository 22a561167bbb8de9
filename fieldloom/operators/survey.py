"""Design-based survey estimation: every analysis set and domain in one stacked plan."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.numeric import t_quantile
from fieldloom.operators.ordering import group_quantile, small
from fieldloom.session import cut


#: Clusters of a stratum that a bootstrap draws together, unless that makes more blocks than MOST_BLOCKS.
BLOCK_CLUSTERS, MOST_BLOCKS = 16_384, 1_024


def stack_domains(rows: DataFrame, domains: dict[str, Column]) -> DataFrame:
    """Each row once per domain it belongs to; a domain is a column whose null means outside."""
    each = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}=" if n else ""), c.cast("string"))) for n, c in domains.items()])
    return rows.withColumn("domain", F.explode(F.array_compact(each)))


def proportions(rows: DataFrame, fpc: DataFrame | None = None) -> DataFrame:
    """rows(domain, y, w, h, i): weighted proportions with linearised variance, all domains at once.

    Rows without y or w are left out; strata with one cluster add nothing to the variance but count
    for the degrees of freedom. fpc(h, f) gives first-stage fractions. The tables after the first
    aggregation have a row per cluster.
    """
    return _estimated(_cluster_totals(rows, ["domain"]), fpc)


def proportions_by(rows: DataFrame, domains: dict[str, Column], fpc: DataFrame | None = None) -> DataFrame:
    """proportions() of rows(y, w, h, i, ...) for every level of every domain, as stack_domains() names them.

    Rows are summed by cluster and levels before they are stacked, so each row is read and shuffled once.
    """
    named = rows.withColumns({f"_d{k}": c.cast("string") for k, c in enumerate(domains.values())})
    levels = [f"_d{k}" for k in range(len(domains))]
    stacked = stack_domains(_cluster_totals(named, levels), {n: F.col(c) for n, c in zip(domains, levels)})
    return _estimated(stacked.groupBy("domain", "h", "i").agg(*[F.sum(c).alias(c) for c in ("wy", "sw", "sww", "n")]), fpc)


def _cluster_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    kept = rows.where(F.col("y").isNotNull() & F.col("w").isNotNull())
    y, w = F.col("y").cast("double"), F.col("w").cast("double")
    return kept.groupBy(*by, "h", "i").agg(F.sum(w * y).alias("wy"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.count(F.lit(1)).alias("n"))


def _estimated(psu: DataFrame, fpc: DataFrame | None) -> DataFrame:
    total = psu.groupBy("domain").agg(*[F.sum(c).alias(f"t_{c}") for c in ("wy", "sw", "sww", "n")])
    z = psu.join(total, "domain").withColumn("z", (F.col("wy") - F.col("t_wy") / F.col("t_sw") * F.col("sw")) / F.col("t_sw"))
    strata = z.groupBy("domain", "h").agg(F.count(F.lit(1)).alias("nh"), F.var_samp("z").alias("vz"))
    f = F.lit(0.0)
    if fpc is not None:
        strata, f = strata.join(fpc, "h", "left"), F.coalesce("f", F.lit(0.0))
    part = F.when(F.col("nh") > 1, (1 - f) * F.col("nh") * F.col("vz"))
    variance = strata.groupBy("domain").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("v"), F.sum("nh").alias("psus"), F.count(F.lit(1)).alias("strata"))
    out = total.join(variance, "domain").withColumn("p", F.col("t_wy") / F.col("t_sw"))
    srs = F.col("p") * (1 - F.col("p")) / F.nullif(F.col("t_n") - 1, F.lit(0))
    out = out.withColumn("deff", F.try_divide("v", srs)).withColumn("kish", F.col("t_n") * F.col("t_sww") / (F.col("t_sw") * F.col("t_sw")))
    mean_size = F.col("t_n") / F.col("psus")
    return out.select(
        "domain", "p", F.sqrt("v").alias("se"), F.col("t_n").alias("n"), F.greatest(F.col("psus") - F.col("strata"), F.lit(1)).cast("long").alias("df"),
        "deff", F.try_divide("t_n", "deff").alias("n_eff"), "kish", F.try_divide(F.col("deff") - 1, mean_size - 1).alias("icc"), F.col("t_sw").alias("weight"),
    )


def with_intervals(estimates: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds low, high and ci_used: on the logit scale, or plainly where p is 0 or 1 or se is 0."""
    spark = estimates.sparkSession
    dfs = [r.df for r in estimates.select("df").distinct().collect()]  # a few integers: one per design
    table = spark.createDataFrame([(d, t_quantile((1 + level) / 2, d)) for d in dfs], "df long, t double")
    logit = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("se") > 0)
    middle, half = F.log(F.col("p") / (1 - F.col("p"))), F.col("t") * F.col("se") / (F.col("p") * (1 - F.col("p")))
    back = lambda x: 1 / (1 + F.exp(-x))
    plain = lambda s: F.least(F.greatest(F.col("p") + s * F.col("t") * F.col("se"), F.lit(0.0)), F.lit(1.0))
    joined = estimates.join(F.broadcast(table), "df")
    return joined.withColumn("low", F.when(logit, back(middle - half)).otherwise(plain(-1))).withColumn("high", F.when(logit, back(middle + half)).otherwise(plain(1))).withColumn("ci_used", F.when(logit, "logit").otherwise("wald")).drop("t")


def _split_draws(seed: int, reps: int):
    """For a stratum's blocks the draws that fall into each, in every replicate."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("b")
        n = int(blocks["nb"].sum())
        rng = np.random.default_rng([seed, int(blocks["hk"].iloc[0]) & (2**64 - 1), 2**32])
        drawn = rng.multinomial(n - 1, blocks["nb"].to_numpy() / n, size=reps)
        return pd.DataFrame({"hk": blocks["hk"], "b": blocks["b"], "draws": list(drawn.T.astype(np.int32))})

    return run


def _replicates(seed: int, reps: int, at_once: int):
    """A task's part of each replicate's totals, from whole blocks of clusters in order."""

    def run(batches):
        wy, sw = np.zeros(reps), np.zeros(reps)

        def add(block: pd.DataFrame) -> None:
            first, y, w = block.iloc[0], block["wy"].to_numpy(), block["sw"].to_numpy()
            n = int(first["n"])
            if n < 2:
                wy[:], sw[:] = wy + y.sum(), sw + w.sum()
                return
            draws = first["draws"]
            draws = np.full(reps, n - 1) if draws is None else np.asarray(draws, np.int64)
            rng = np.random.default_rng([seed, int(first["hk"]) & (2**64 - 1), int(first["b"])])
            step, even = max(1, min(at_once, (1 << 22) // len(y))), np.full(len(y), 1 / len(y))
            for low in range(0, reps, step):
                factor = rng.multinomial(draws[low : low + step], even) * (n / (n - 1))
                wy[low : low + step] += factor @ y
                sw[low : low + step] += factor @ w

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            last = (rows["hk"] == rows["hk"].iloc[-1]) & (rows["b"] == rows["b"].iloc[-1])
            for _, block in rows[~last].groupby(["hk", "b"], sort=False):
                add(block)
            rest = rows[last]
        if rest is not None:
            add(rest)
            yield pd.DataFrame({"rep": np.arange(reps), "wy": wy, "sw": sw})

    return run


def bootstrap(rows: DataFrame, reps: int = 2000, seed: int = 20260805, level: float = 0.95, block: int = 100) -> DataFrame:
    """rows(y, w, h, i): rescaled bootstrap over cluster totals, drawn where the clusters are.

    A stratum of n clusters gets n - 1 draws. Its clusters lie in blocks by a hash of their names, at most MOST_BLOCKS of
    them; how many draws fall into each block is drawn first, then each block's among its clusters. Draws
    depend on the seed, the stratum and the block alone, so any partitioning gives the same replicates, and no task
    or driver holds more than a block. `block` is how many replicates are drawn at once. An empty table has no row's worth: nulls.
    """
    kept = rows.where(F.col("y").isNotNull() & F.col("w").isNotNull())
    psu = kept.groupBy("h", "i").agg(F.sum(F.col("w") * F.col("y")).cast("double").alias("wy"), F.sum("w").cast("double").alias("sw"))
    psu = cut(psu.withColumn("hk", F.xxhash64("h")))
    sizes = psu.groupBy("hk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(BLOCK_CLUSTERS), F.ceil(F.col("n") / MOST_BLOCKS))))
    placed = psu.join(sizes, "hk").withColumn("b", F.pmod(F.xxhash64("h", "i"), F.col("blocks")))
    several = placed.where("blocks > 1").groupBy("hk", "b").agg(F.count(F.lit(1)).alias("nb"))
    draws = several.groupBy("hk").applyInPandas(_split_draws(seed, reps), "hk long, b long, draws array<int>")
    dealt = placed.select("hk", "b", "n", "i", "wy", "sw").repartition("hk", "b").sortWithinPartitions("hk", "b", "i")
    if sizes.where("blocks > 1").isEmpty():
        told = dealt.withColumn("draws", F.lit(None).cast("array<int>"))
    else:
        # a block's draws come with its first cluster alone
        head = placed.groupBy("hk", "b").agg(F.min("i").alias("i")).join(draws, ["hk", "b"])
        told = placed.select("hk", "b", "n", "i", "wy", "sw").join(head, ["hk", "b", "i"], "left").repartition("hk", "b").sortWithinPartitions("hk", "b", "i")
    parts = told.select("hk", "b", "n", "wy", "sw", "draws").mapInPandas(_replicates(seed, reps, block), "rep long, wy double, sw double")
    drawn = parts.groupBy("rep").agg((F.sum("wy") / F.sum("sw")).alias("p"))
    tail = (1 - level) / 2
    return drawn.agg(F.stddev_samp("p").alias("se"), F.percentile("p", F.lit(tail)).alias("low"), F.percentile("p", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("reps"))


def base_weights(frame: DataFrame, take: float = 20.0) -> DataFrame:
    """frame(cluster, p1, listed, census): 1 / (p1 * take / listed), and how far listing departs from the census."""
    w = 1 / (F.col("p1") * take / F.col("listed"))
    return frame.withColumn("w_base", w).withColumn("listing_ratio", F.try_divide("listed", "census"))


def response_weights(households: DataFrame, strict: bool = False) -> DataFrame:
    """households(cluster, w, eligible, responded): the weight of respondents raised by their cluster's response.

    A cluster of which nobody responded has no factor; strict makes that an error.
    """
    if strict:
        silent = households.groupBy("cluster").agg(F.count_if("eligible").alias("e"), F.count_if(F.col("eligible") & F.col("responded")).alias("r")).where("e > 0 and r = 0").limit(5).collect()
        if silent:
            raise ValueError(f"no respondents in clusters {[c.cluster for c in silent]}")
    by = Window.partitionBy("cluster")
    e, r = F.sum(F.col("eligible").cast("int")).over(by), F.sum((F.col("eligible") & F.col("responded")).cast("int")).over(by)
    factor = F.try_divide(e, r)
    return households.withColumn("nr_adjustment", factor).withColumn("w_final", F.when(F.col("eligible") & F.col("responded"), F.col("w") * factor))


def trimmed(rows: DataFrame, times: float = 4.0) -> DataFrame:
    """rows(h, w): weights cut at some times their stratum's median and scaled to keep its total.

    The median comes from ranges of the order and is joined, so no task holds a stratum.
    """
    medians = group_quantile(rows, ["h"], "w", 0.5, "_m").select("h", (F.col("_m") * times).alias("_cap"))
    medians = medians.join(rows.groupBy("h").agg(F.sum("w").alias("_sum")), "h")
    cut = rows.join(small(medians), "h").withColumn("_cut", F.least("w", "_cap"))
    sums = cut.groupBy("h").agg(F.sum("_cut").alias("_cut_sum"))
    return cut.join(small(sums), "h").withColumn("w_trimmed", F.col("_cut") * F.col("_sum") / F.col("_cut_sum")).drop("_cap", "_sum", "_cut", "_cut_sum")


def screen(interviewers: DataFrame) -> DataFrame:
    """interviewers(id, duration, coverage, card_rate, completion, median_duration, all_card_rate): four rules and a verdict."""
    rules = {
        "r_short": F.col("duration") < 0.5 * F.col("median_duration"), "r_perfect": F.col("coverage") >= 0.99,
        "r_cards": F.col("card_rate") < 0.3 * F.col("all_card_rate"), "r_complete": F.col("completion") >= 0.95,
    }
    out = interviewers
    for name, rule in rules.items():
        out = out.withColumn(name, F.coalesce(rule, F.lit(False)))
    n = sum((F.col(k).cast("int") for k in rules), F.lit(0))
    return out.withColumn("n_rules", n).withColumn("verdict", F.when(n >= 3, "EXCLUDE").when(n >= 1, "REVIEW").otherwise("OK"))


def reported_sweep(rates: list[float]) -> dict[str, tuple[Column, Column, Column]]:
    """Variants of rows(y, recalled, w, h, i) by rate of over-reporting: a recalled yes counts 1 - rate."""
    y = lambda r: F.when(F.col("recalled") & (F.col("y") == 1), F.lit(1 - float(r))).otherwise(F.col("y").cast("double"))
    return {f"{r:.2f}": (F.lit(True), y(r), F.col("w")) for r in rates}


def proportions_of_variants(rows: DataFrame, table: dict[str, tuple[Column, Column, Column]], fpc: DataFrame | None = None) -> DataFrame:
    """proportions() of each variant; table has (keep, y, w) by name over the columns of rows(h, i, ...).

    Rows are read once and never multiplied: a cluster sums each variant under its condition, and only the clusters' totals are
    stacked.
    """
    sums = []
    for k, (keep, y, w) in enumerate(table.values()):
        y, w = y.cast("double"), w.cast("double")
        here = keep & y.isNotNull() & w.isNotNull()
        each = {"wy": w * y, "sw": w, "sww": w * w, "n": F.lit(1).cast("long")}
        sums += [F.sum(F.when(here, v)).alias(f"{c}_{k}") for c, v in each.items()]
    totals = rows.groupBy("h", "i").agg(*sums)
    stack = [F.when(F.col(f"n_{k}").isNotNull(), F.struct(F.lit(name).alias("domain"), *[F.col(f"{c}_{k}").alias(c) for c in ("wy", "sw", "sww", "n")])) for k, name in enumerate(table)]
    psu = totals.select("h", "i", F.explode(F.array_compact(F.array(*stack))).alias("v"))
    return _estimated(psu.select("v.domain", "h", "i", "v.wy", "v.sw", "v.sww", "v.n"), fpc)


def sensitivity(rows: DataFrame, table: dict[str, tuple[Column, Column, Column]], headline: str, target: float, fpc: DataFrame | None = None) -> DataFrame:
    """The variants' estimates, how far each is from the headline in points, and whether its interval reaches the target."""
    each = with_intervals(proportions_of_variants(rows, table, fpc))
    first = each.where(F.col("domain") == headline).select(F.col("p").alias("_p"))
    out = each.crossJoin(F.broadcast(first))  # one row
    return out.withColumn("shift_pp", 100 * (F.col("p") - F.col("_p"))).withColumn("target", F.when(F.col("high") >= target, "reached").otherwise("below")).drop("_p")
