"""The bootstrap drawn by executors: its law, its repeatability, and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import survey

DDL = "y double, w double, h string, i int"


def sample(spark, strata, seed=1):
    rng = random.Random(seed)
    rows = [(float(rng.random() < 0.3 + 0.4 * (i % 2)), rng.uniform(1, 3), f"h{s}", i) for s, n in enumerate(strata) for i in range(n) for _ in range(4)]
    return spark.createDataFrame(rows, DDL)


def numbers(df):
    return tuple(df.first())


def test_any_partitioning_and_any_step_give_the_same(spark):
    df = sample(spark, [7, 12, 1, 30])
    one = numbers(survey.bootstrap(df.coalesce(1), 60))
    assert one == pytest.approx(numbers(survey.bootstrap(df.repartition(9), 60, block=7)), rel=1e-12)
    assert one != numbers(survey.bootstrap(df, 60, seed=2))


def test_blocks_give_the_law_of_one_draw(spark, monkeypatch):
    """A stratum in many blocks: the same standard error as by linearisation, and the same for any partitioning."""
    df = sample(spark, [400, 90], seed=3)
    want = survey.proportions(df.withColumn("domain", F.lit("a"))).first().se
    whole = survey.bootstrap(df, 800).first().se
    monkeypatch.setattr(survey, "BLOCK_CLUSTERS", 16)
    several = survey.bootstrap(df, 800)
    assert several.first().se == pytest.approx(want, rel=0.12) and whole == pytest.approx(want, rel=0.12)
    assert numbers(several) == pytest.approx(numbers(survey.bootstrap(df.repartition(6), 800)), rel=1e-12)
    monkeypatch.setattr(survey, "MOST_BLOCKS", 4)
    assert survey.bootstrap(df, 800).first().se == pytest.approx(want, rel=0.12)


def test_draws_of_blocks_add_up():
    import pandas as pd

    out = survey._split_draws(5, 300)(pd.DataFrame({"hk": [9] * 4, "b": [2, 0, 1, 3], "nb": [10, 20, 30, 40]}))
    drawn = np.array(out["draws"].tolist())
    assert (drawn.sum(0) == 99).all() and out["b"].tolist() == [0, 1, 2, 3]
    assert drawn.mean(1) == pytest.approx(np.array([19.8, 29.7, 9.9, 39.6]), rel=0.1)


def test_two_clusters(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a", 1), (0.0, 3.0, "a", 1), (1.0, 2.0, "a", 2), (None, 5.0, "a", 2), (1.0, None, "a", 3)], DDL)
    b = survey.bootstrap(df, 200).first()
    assert (b.low, b.high, b.reps) == (0.25, 1.0, 200) and b.se == pytest.approx(0.375, rel=0.05)


def test_lone_clusters_and_nothing(spark):
    alone = spark.createDataFrame([(1.0, 1.0, "a", 1), (0.0, 1.0, "b", 1)], DDL)
    assert survey.bootstrap(alone, 20).first().se == 0
    none = survey.bootstrap(alone.limit(0), 20).first()
    assert none.se is None and none.reps == 0
