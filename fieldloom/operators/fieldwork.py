"""What a survey's fieldwork left behind: analysis sets, weights under other assumptions, sources of evidence, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ordering import small
from fieldloom.operators.quality import robust_zs


def analysis_sets(rows: DataFrame, excluded: DataFrame, planned: DataFrame | int, weights: list[str]) -> DataFrame:
    """rows(h, i, who, ...) twice, as `analysis_set` A (all) and B: without the clusters that excluded(who) worked in.

    B's weights are raised by planned clusters over those that still have a row, stratum by stratum;
    a cluster without any row counts as lost. planned is a number or a table (h, planned).
    """
    dropped = rows.join(small(excluded.select("who").distinct()), "who", "left_semi").select("i").distinct()
    kept = rows.join(small(dropped), "i", "left_anti")
    left = kept.select("h", "i").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("_left"))
    left = left.withColumn("planned", F.lit(planned)) if isinstance(planned, int) else left.join(planned, "h")
    raised = kept.join(small(left), "h").withColumns({w: F.col(w) * F.col("planned") / F.col("_left") for w in weights})
    return rows.withColumn("analysis_set", F.lit("A")).unionByName(raised.drop("_left", "planned").withColumn("analysis_set", F.lit("B")))


def alternative_weights(households: DataFrame) -> DataFrame:
    """households(h, cluster, settlement, w, completed, ineligible, no_contact) with four weights of the completed.

    w_cluster: response within the cluster. w_cell: within stratum and settlement type. w_vacant: vacant
    dwellings count as non-response. w_no_contact: dwellings without contact count as ineligible. A
    cluster or cell in which nobody answered has no weight to give and null stays.
    """
    number = lambda c: F.sum(F.col(c).cast("int"))
    n = F.count(F.lit(1))
    done = F.nullif(number("completed"), F.lit(0))
    cluster = households.groupBy("cluster").agg(
        ((n - number("ineligible")) / done).alias("_a"), (n / done).alias("_v"), ((n - number("ineligible") - number("no_contact")) / done).alias("_n")
    )
    cell = households.groupBy("h", "settlement").agg(((n - number("ineligible")) / done).alias("_c"))
    joined = households.join(small(cluster), "cluster", "left").join(small(cell), ["h", "settlement"], "left")
    given = {"w_cluster": "_a", "w_cell": "_c", "w_vacant": "_v", "w_no_contact": "_n"}
    return joined.withColumns({k: F.when(F.col("completed"), F.col("w") * F.col(f)) for k, f in given.items()}).drop(*given.values())


def inherited(children: DataFrame, households: DataFrame, weights: list[str], key: str = "household") -> DataFrame:
    """children with the weights of their household; a child without one stops the plan when it runs."""
    joined = children.join(households.select(key, *weights), key, "left")
    lost = reduce(lambda a, b: a | b, [F.col(w).isNull() for w in weights])
    say = F.concat(F.lit(f"child without a household weight: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return joined.withColumns({w: F.when(lost, F.raise_error(say).cast("double")).otherwise(F.col(w)) for w in weights})


def evidence(children: DataFrame) -> DataFrame:
    """children(y, card, w, h, i) stacked as (domain, y, w, h, i) for the estimator: five quantities, national and by stratum."""
    seen, yes = F.col("card"), F.col("y") == 1
    share = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    parts = {"card_seen": share(seen), "card_confirmed_of_cards": F.when(seen, F.col("y").cast("double")), "recalled_of_no_cards": F.when(~seen, F.col("y").cast("double")), "documented": share(seen & yes), "headline": F.col("y").cast("double")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), v.alias("v")) for k, v in parts.items()])).alias("_q")
    long = children.select("h", "i", "w", each).where("_q.v is not null")
    scopes = F.explode(F.array(F.lit("National"), F.concat(F.lit("stratum="), F.col("h").cast("string")))).alias("_s")
    return long.select("h", "i", "w", "_q", scopes).select(F.concat_ws("|", "_s", "_q.q").alias("domain"), F.col("_q.v").alias("y"), "w", "h", "i")


def interviewers(households: DataFrame, children: DataFrame, log: DataFrame) -> DataFrame:
    """A row per interviewer with children: volumes, rates, durations, days, and robust z of four of them.

    households(who, cluster, completed, minutes), children(who, y, card), log(who, day, attempted, clusters).
    """
    done = F.when(F.col("completed"), F.col("minutes"))
    h = households.groupBy("who").agg(
        F.count_distinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_households"), F.count_if("completed").alias("_done"), F.avg(F.col("completed").cast("double")).alias("completion"),
        F.percentile(done, F.lit(0.5)).alias("median_minutes"), F.avg(done).alias("mean_minutes"), F.stddev_samp(done).alias("sd_minutes"),
    )
    c = children.groupBy("who").agg(F.count(F.lit(1)).alias("n_children"), F.avg(F.coalesce("card", F.lit(False)).cast("double")).alias("card_rate"), F.avg("y").alias("coverage"))
    f = log.groupBy("who").agg(F.count_distinct("day").alias("days"), F.max("attempted").alias("most_households"), F.max("clusters").alias("most_clusters"))
    out = c.join(h, "who", "left").join(f, "who", "left").withColumn("per_household", F.col("n_children") / F.greatest("_done", F.lit(1))).drop("_done")
    return robust_zs(out, {f"z_{c}": c for c in ("coverage", "median_minutes", "card_rate", "completion")})


def patterns(households: DataFrame, children: DataFrame, log: DataFrame) -> DataFrame:
    """(pattern, n, of, share, found): seven patterns that honest fieldwork rarely leaves, each from one aggregation.

    households(who, household, completed, minutes, n_children, in_window), children(cluster, household, y),
    log(who, day, attempted, clusters). found lists who, which clusters or which days, sorted.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")

    def row(name: str, df: DataFrame, hit: Column, what: Column | None) -> DataFrame:
        hit = F.coalesce(hit, F.lit(False))
        return df.agg(F.count_if(hit).alias("n"), F.count(F.lit(1)).alias("of"), (listed(F.when(hit, what.cast("string"))) if what is not None else F.lit("-")).alias("found")).select(F.lit(name).alias("pattern"), "n", "of", (100 * F.try_divide("n", "of")).alias("share"), "found")

    done = households.where("completed")
    clusters = children.groupBy("cluster").agg(F.min("y").alias("least"))
    homes = children.groupBy("household").agg(F.min("y").alias("least"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    day = F.concat_ws(" ", F.col("who").cast("string"), F.col("day").cast("string"))
    found = [
        row("short_interview_with_children", done.where("n_children > 0"), F.col("minutes") < 5, F.col("who")),
        row("cluster_without_variation", clusters, F.col("least") == 1, F.col("cluster")),
        row("household_all_vaccinated", homes, F.col("least") == 1, None),
        row("over_20_households_a_day", log, F.col("attempted") > 20, day),
        row("several_clusters_a_day", log, F.col("clusters") > 1, day),
        row("outside_fieldwork_window", done, ~F.col("in_window"), F.col("who")),
        row("completed_without_children", done, F.col("n_children") == 0, None),
    ]
    return reduce(DataFrame.unionByName, found)


def selection_checks(frame: DataFrame, per_stratum: int, tolerance: float = 1e-6) -> DataFrame:
    """(check, n_affected, detail) of frame(cluster, h, selected, size, p1, stratum_size, taken): what the first stage promises."""
    chosen = frame.where("selected")
    counts = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("stratum_size", True).alias("stated"))
    sizes = frame.groupBy("h").agg(F.sum("size").alias("whole")).join(counts, "h")
    away = F.abs(F.col("taken") * F.col("size") / F.col("stratum_size") - F.col("p1"))
    rows = [
        counts.agg(F.count_if(F.col("n") != per_stratum).alias("n_affected"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") != per_stratum, F.concat_ws("=", F.col("h").cast("string"), F.col("n").cast("string"))))), ", ").alias("detail")).withColumn("check", F.lit("clusters_per_stratum")),
        chosen.agg(F.count_if(away > tolerance).alias("n_affected"), F.format_string("%.1e", F.max(away)).alias("detail")).withColumn("check", F.lit("selection_probability")),
        sizes.agg(F.count_if(F.abs(F.col("whole") - F.col("stated")) > 1e-5 * F.abs("stated") + 1e-8).alias("n_affected"), F.lit("").alias("detail")).withColumn("check", F.lit("stratum_totals")),
    ]
    return reduce(DataFrame.unionByName, rows).select("check", "n_affected", "detail")


def interview_checks(children: DataFrame, households: DataFrame) -> DataFrame:
    """(check, n_affected): skip patterns, roster arithmetic and orphans of children(household, card, on_card, recalled), households(household, completed, stated)."""
    card = F.coalesce("card", F.lit(False))
    has_card, has_recall = F.col("on_card").isNotNull(), F.col("recalled").isNotNull()
    skips = children.agg(F.count_if(has_card & has_recall).alias("both_sources"), F.count_if(~card & has_card).alias("card_answer_without_card"), F.count_if(card & has_recall).alias("recall_despite_card"), F.count_if(~has_card & ~has_recall).alias("status_missing"))
    per = children.groupBy("household").agg(F.count(F.lit(1)).alias("n"))
    both = households.join(per, "household", "left")
    differs = F.col("completed") & (F.coalesce("n", F.lit(0)) != F.coalesce("stated", F.lit(0)))
    roster = both.agg(F.count_if(differs).alias("roster_differs"))
    orphans = children.join(households.select("household"), "household", "left_anti").agg(F.count(F.lit(1)).alias("child_without_household"))
    one = skips.crossJoin(roster).crossJoin(orphans)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_affected")) for c in one.columns])).alias("_c")).select("_c.*")


def unmatched_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side) of key pairs that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


#: Age classes in completed months, closed on the right.
AGE_CLASSES = ((8, 11), (11, 23), (23, 35), (35, 47), (47, 59))


def age_class(months: Column) -> Column:
    """The label of the class, as 9-11; null outside all."""
    return reduce(lambda acc, b: acc.when((months > b[0]) & (months <= b[1]), f"{b[0] + 1}-{b[1]}"), AGE_CLASSES[1:], F.when((months > AGE_CLASSES[0][0]) & (months <= AGE_CLASSES[0][1]), f"{AGE_CLASSES[0][0] + 1}-{AGE_CLASSES[0][1]}"))


def flags(diagnostics: DataFrame, register: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Quality flags raised by one row of diagnostics: register(flag, severity, condition, evidence, fixable_by).

    condition is an SQL predicate, evidence a printf format followed by its columns after `|`.
    """
    rows = []
    for flag, severity, condition, evidence_, by in register:
        text, *columns = evidence_.split("|")
        rows.append(F.when(F.expr(condition), F.struct(F.lit(flag).alias("flag"), F.lit(severity).alias("severity"), F.format_string(text, *[F.col(c) for c in columns]).alias("evidence"), F.lit(by).alias("fixable_by"))))
    return diagnostics.select(F.explode(F.array_compact(F.array(*rows))).alias("_f")).select("_f.*")
