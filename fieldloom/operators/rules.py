"""A declarative rule catalogue over form records: constraints, skips, lookups and derived values.

Rules are SQL predicates over the record's columns. A rule bites only where its field is relevant
and answered; a value where it is not relevant is a violation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    field: str
    constraint: str = ""
    relevant: str = ""
    required: bool = False
    calculation: str = ""
    justified_by: str = ""

    @property
    def enforcement(self) -> str:
        if self.constraint and self.relevant:
            return "gate"
        return "constraint" if self.constraint else "skip" if self.relevant else "derived" if self.calculation else "required" if self.required else "none"


def violations(records: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key..., rule_id, field, violation) for each broken rule: one pass over the records, whatever the number of rules."""
    found = []
    for r in rules:
        relevant = F.coalesce(F.expr(r.relevant), F.lit(False)) if r.relevant else F.lit(True)
        given = F.col(r.field).isNotNull()
        say = lambda what, r=r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.field).alias("field"), F.lit(what).alias("violation"))
        if r.relevant:
            found.append(F.when(~relevant & given, say("answered_but_skipped")))
        if r.required:
            found.append(F.when(relevant & ~given, say("missing")))
        if r.constraint:
            found.append(F.when(relevant & given & ~F.coalesce(F.expr(r.constraint), F.lit(False)), say("constraint")))
    return records.select(*key, F.explode(F.array_compact(F.array(*found))).alias("_v")).select(*key, "_v.*")


def derived(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """records with the calculated fields, in catalogue order."""
    return reduce(lambda df, r: df.withColumn(r.field, F.expr(r.calculation)), [r for r in rules if r.calculation], records)


def register(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The catalogue as a table; a constraint without a reason stops the build."""
    bare = [r.rule_id for r in rules if r.constraint and not r.justified_by]
    if bare:
        raise ValueError(f"constraints without a reason: {', '.join(bare)}")
    rows = [(r.rule_id, r.field, r.enforcement, r.constraint, r.relevant, r.required, r.calculation, r.justified_by) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, field string, enforcement string, constraint string, relevant string, required boolean, calculation string, justified_by string")


def variant_diff(spark: SparkSession, a: list[Rule], b: list[Rule]) -> DataFrame:
    """Rules in which two catalogues differ, by field and attribute."""
    table = lambda rules: spark.createDataFrame([(r.rule_id, n, str(getattr(r, n))) for r in rules for n in ("field", "constraint", "relevant", "required", "calculation")], "rule_id string, attribute string, value string")
    left, right = table(a).withColumnRenamed("value", "a"), table(b).withColumnRenamed("value", "b")
    return left.join(right, ["rule_id", "attribute"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


#: Rules for a household and its specimens, over any records that have these columns.
HOUSEHOLD = [
    Rule("C-1.06", "structure", "structure between 1 and 999", required=True, justified_by="three digits on the plate"),
    Rule("C-1.11", "lat", "lat between 10.2 and 11.75", justified_by="survey area"),
    Rule("C-3.01", "hh_size", "hh_size between 1 and 40", relevant="result = 1", required=True, justified_by="largest listed household"),
    Rule("C-3.01g", "roster_gate", "n_roster = hh_size", relevant="result = 1", justified_by="roster agrees with the stated size"),
    Rule("C-5.03a", "serial", "serial rlike '^[0-9]{6}$' and cast(serial as int) between lo and hi", relevant="obtained = 1", required=True, justified_by="the team's labels"),
    Rule("C-5.05", "temp", "temp between -5.0 and 40.0 and temp = round(temp, 1)", relevant="obtained = 1", justified_by="what the thermometer shows"),
]


def roster_checks(households: DataFrame, roster: DataFrame) -> DataFrame:
    """households(hh, hh_size), roster(hh, relation, serial): counts that must agree, heads and repeated specimens."""
    per = roster.groupBy("hh").agg(F.count(F.lit(1)).alias("n_roster"), F.count_if(F.col("relation") == 1).alias("n_head"), F.count("serial").alias("n_serials"), F.count_distinct("serial").alias("n_distinct"))
    joined = households.join(per, "hh", "left").na.fill(0, ["n_roster", "n_head", "n_serials", "n_distinct"])
    return joined.select("hh", (F.col("n_roster") != F.col("hh_size")).alias("size_differs"), (F.col("n_head") != 1).alias("not_one_head"), (F.col("n_serials") != F.col("n_distinct")).alias("serial_repeats"))
