"""Variants summed under their conditions against each variant alone, and the plan."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import survey


def test_each_variant_equals_its_own_estimate(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, None]), rng.choice([1.0, 2.5, None]), rng.choice(["a", "b"]), rng.randrange(9), rng.randrange(20)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y double, w double, h string, i int, age int")
    table = {"all": (F.lit(True), F.col("y"), F.col("w")), "young": (F.col("age") < 8, F.col("y"), F.col("w")), "turned": (F.col("age") > 3, 1 - F.col("y"), F.lit(1)), "none": (F.lit(False), F.col("y"), F.col("w"))}
    got = {r.domain: r for r in survey.proportions_of_variants(df, table).collect()}
    assert set(got) == {"all", "young", "turned"}
    for name in got:
        keep, y, w = table[name]
        one = survey.proportions(df.where(keep).select("h", "i", y.alias("y"), w.alias("w"), F.lit(name).alias("domain"))).first()
        assert [got[name][c] for c in one.__fields__] == [pytest.approx(v) if isinstance(v, float) else v for v in one]


def test_rows_are_not_multiplied_before_they_are_summed(spark):
    df = spark.range(10).selectExpr("1.0 y", "1.0 w", "'a' h", "id i", "true recalled")
    said = io.StringIO()
    with redirect_stdout(said):
        survey.proportions_of_variants(df, survey.reported_sweep([0.0, 0.5])).explain("simple")
    plan = said.getvalue()
    assert "Generate" in plan and max(plan.rfind("Exchange hashpartitioning(h#"), plan.rfind("partial_sum")) > plan.rfind("Generate")
