"""Non-response: profiles of what is missing, and a logistic model of who answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numeric import chi2_tail


def missing_profile(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., column, n, missing, share) for each column, from one aggregation."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns])
    parts = [counts.select(*by, F.lit(c).alias("column"), "n", F.col(f"_{c}").alias("missing"), F.try_divide(f"_{c}", "n").alias("share")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def response_model(rows: DataFrame, outcome: str, numbers: list[str], categories: list[str]) -> dict:
    """A binomial model of a 0/1 outcome: coefficients with p-values, McFadden's R2 and the likelihood ratio's p."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    indexed = [StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetAsc") for c in categories]
    coded = [OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories])] if categories else []
    features = VectorAssembler(inputCols=[*numbers, *[f"{c}_v" for c in categories]], outputCol="features")
    model = GeneralizedLinearRegression(family="binomial", featuresCol="features", labelCol=outcome)
    fitted = Pipeline(stages=[*indexed, *coded, features, model]).fit(rows.na.drop(subset=[outcome, *numbers, *categories])).stages[-1]
    s = fitted.summary
    gain = s.nullDeviance - s.deviance
    return {
        "coefficients": [float(c) for c in fitted.coefficients], "intercept": float(fitted.intercept), "p_values": [float(p) for p in s.pValues],
        "mcfadden": 1 - s.deviance / s.nullDeviance, "lr_p": chi2_tail(gain, len(fitted.coefficients)),
    }


def augmented(children: DataFrame, cells: DataFrame, penalty: float) -> DataFrame:
    """children(h, i, y, w) with a pseudo-record per cell(h, i, coverage, w, n_missing, kids): those who never answered, at coverage less penalty."""
    y = F.least(F.greatest(F.col("coverage") - penalty, F.lit(0.0)), F.lit(1.0))
    ghosts = cells.where("n_missing > 0").select("h", "i", y.alias("y"), (F.col("w") * F.col("n_missing") * F.col("kids")).alias("w"))
    return children.select("h", "i", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")).unionByName(ghosts)
