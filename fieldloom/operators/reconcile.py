"""Reconciliation of names with an authority, with a ledger of every decision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import clean_text, match_key
from fieldloom.operators.fuzzy import most_similar
from fieldloom.operators.ordering import numbered
from fieldloom.session import cut

ACCEPT, REVIEW = 0.88, 0.75


def key_collisions(authority: DataFrame, name: str = "name") -> DataFrame:
    """Keys that several names of the authority share; a cascade needs this empty."""
    keyed = authority.select(match_key(F.col(name), unicode_forms=True).alias("key"), name).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("names")).where("names > 1")


def cascade(values: DataFrame, authority: DataFrame, accept: float = ACCEPT, review: float = REVIEW) -> DataFrame:
    """values(raw) against authority(name): exact, by key, fuzzy, or not at all; a row per distinct raw value.

    Of names with one key, and of keys that are equally like a value, the first counts: by authority's
    `ord` where it has one, else by name. Only distinct keys that neither of the first tiers settles
    reach the fuzzy one, which finds the most similar key by an index (operators.fuzzy).
    """
    order = F.struct(*(["ord"] if "ord" in authority.columns else []), "name")
    names = authority.select(clean_text(F.col("name"), True).alias("name"), *(["ord"] if "ord" in authority.columns else []))
    names = names.groupBy("name").agg(F.min(order).alias("first")).withColumn("key", match_key(F.col("name"), unicode_forms=True))
    keys = names.groupBy("key").agg(F.min_by("name", "first").alias("by_key"), F.min("first").alias("first"))
    raw = values.select("raw").distinct().withColumn("clean", clean_text(F.col("raw"), True)).withColumn("key", match_key(F.col("raw"), unicode_forms=True))
    exact = raw.join(names.select(F.col("name").alias("clean"), F.col("name").alias("exact")), "clean", "left")
    keyed = exact.join(keys, "key", "left")
    open_ = keyed.where(F.col("exact").isNull() & F.col("by_key").isNull()).select(F.col("key").alias("k")).distinct()
    keys = cut(keys)
    alike = most_similar(open_, keys).select(F.col("k"), "score", "key").join(keys.select("key", "by_key"), "key")
    best = alike.select(F.col("k").alias("key"), F.struct("score", F.col("by_key").alias("name")).alias("best"))
    joined = keyed.join(best, "key", "left")
    score = F.col("best.score")
    tiers = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_key").isNotNull(), "normalised").when(score >= accept, "fuzzy_accepted").when(score >= review, "fuzzy_review").otherwise("unresolved")
    name = F.coalesce("exact", "by_key", F.when(score >= review, F.col("best.name")))
    return joined.select("raw", name.alias("resolved"), tiers.alias("method"), F.when(tiers.isin("exact", "normalised"), F.lit(1.0)).otherwise(F.coalesce(score, F.lit(0.0))).alias("confidence"))


def outcome(method: Column) -> Column:
    return F.when(method == "unresolved", "unresolved").when(method == "fuzzy_review", "resolved_review").otherwise("resolved")


def reconcile_rows(rows: DataFrame, fields: dict[str, DataFrame]) -> DataFrame:
    """rows with each field's authoritative name (name_<field>) and the row's outcome: the worst of its fields, the first of equals."""
    out, worst = rows, F.struct(F.lit(0).alias("rank"), F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"), F.lit("resolved").alias("outcome"))
    for k, (field, authority) in enumerate(fields.items()):
        found = cascade(rows.select(F.col(field).alias("raw")), authority)
        found = found.select(F.col("raw").alias(f"_raw{k}"), F.col("resolved").alias(f"name_{field}"), F.struct("method", "confidence").alias(f"_m{k}"))
        out = out.join(found, out[field].eqNullSafe(found[f"_raw{k}"]), "left").drop(f"_raw{k}")
        said = outcome(F.col(f"_m{k}.method"))
        rank = F.when(said == "unresolved", 2).when(said == "resolved_review", 1).otherwise(0)
        mine = F.struct(rank.alias("rank"), F.col(f"_m{k}.method").alias("method"), F.col(f"_m{k}.confidence").alias("confidence"), said.alias("outcome"))
        worst = F.when(rank > worst["rank"], mine).otherwise(worst)
    out = out.withColumn("_w", worst)
    return out.select(*rows.columns, *[f"name_{f}" for f in fields], F.col("_w.method").alias("match_method"), F.round("_w.confidence", 4).alias("match_confidence"), F.col("_w.outcome").alias("match_outcome"))


def facilities(values: DataFrame, authority: DataFrame, accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """The cascade without a review tier, and its decisions that a ledger takes: all but the exact ones."""
    found = cascade(values, authority, accept, accept)
    return found, found.where("method <> 'exact'")


def ledger(decisions: DataFrame, stage: str, field: str) -> DataFrame:
    """A ledger row for every decision, numbered in the order of the raw values."""
    said = decisions.withColumn("outcome", outcome(F.col("method")))
    return numbered(said, ["raw"], "ledger_id").select("ledger_id", F.lit(stage).alias("stage"), F.lit(field).alias("field"), F.col("raw").alias("raw_value"), F.col("resolved").alias("resolved_value"), "method", "confidence", "outcome")


def ledger_union(ledgers: list[DataFrame]) -> DataFrame:
    """Several stages' ledgers under one numbering, by stage, field and raw value."""
    from functools import reduce

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.drop("ledger_id") for x in ledgers])
    return numbered(whole, ["stage", "field", "raw_value"], "ledger_id")


def ledger_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("stage", "field", "method", "outcome").agg(F.count(F.lit(1)).alias("n"))


def adjudicate(rows: DataFrame) -> DataFrame:
    """rows(code, ord, district, remark, agrees) -> kept and outcome; per code in row order, tiny groups.

    Equal districts: the later row is a duplicate. Else a transfer remark on one side wins, else the
    row that agrees with the authority, else both go; a later row meets the row that stood last.
    """
    # Fixed value: the remarks that tell of a transfer; they must match.
    moved = r"(?i)transferr?ed|gazette|reassigned"
    marked = rows.withColumn("_moved", F.coalesce(F.col("remark").rlike(moved), F.lit(False))).withColumn("agrees", F.coalesce("agrees", F.lit(False)))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        kept, outcome, held = [True] * len(pdf), ["unique"] * len(pdf), 0
        for k in range(1, len(pdf)):
            a, b = pdf.loc[held], pdf.loc[k]
            if a.district == b.district:
                kept[k], outcome[k] = False, "duplicate"
                continue
            for why, x, y in (("transfer", a._moved, b._moved), ("authority", a.agrees, b.agrees)):
                if bool(x) != bool(y):
                    loser = k if x else held
                    kept[loser], outcome[loser] = False, f"conflict_{why}"
                    held = held if x else k
                    break
            else:
                kept[held], kept[k], outcome[held], outcome[k] = False, False, "conflict", "conflict"
        return pd.DataFrame({"code": pdf.code, "ord": pdf.ord, "kept": kept, "outcome": outcome})

    return marked.groupBy("code").applyInPandas(decide, "code string, ord long, kept boolean, outcome string")
