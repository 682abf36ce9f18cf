"""Calibration of scores: none, a logistic line, or a monotone step function, whichever errs least on held-back rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.models import platt

METHODS = ("none", "platt", "isotonic")


def isotonic(fit: DataFrame, df: DataFrame, score: str = "probability", target: str = "target", name: str = "isotonic") -> DataFrame:
    """Adds ``name``: the non-decreasing function of the score that is nearest to ``fit``'s targets, linear between its scores.

    Rows of ``fit`` are summed by score first, so what pools adjacent violators is one weighted row for each distinct score: range by
    range, then the blocks left over all ranges. Those have different means of whole numbers of rows, of which n rows have in the order of n^(2/3) at
    most; the model holds them. Scores outside those of ``fit`` take the value of the nearest end, a null score none.
    """
    by_score = fit.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_x")).agg(F.avg(F.col(target).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol=name).fit(by_score)
    out = model.transform(df.withColumn("_x", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))).drop("_x")
    return out.withColumn(name, F.when(F.col(score).isNotNull(), F.col(name)))


def isotonic_blocks(fit: DataFrame, score: str, target: str) -> DataFrame:
    """(score, n_rows, fitted): the fitted value at each distinct score of ``fit``."""
    values = fit.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n_rows"))
    return isotonic(fit, values, score, target, "fitted").select(score, "n_rows", "fitted")


def calibrated(fit: DataFrame, df: DataFrame, score: str = "probability", target: str = "target", least: int = 20) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each method, and the methods fitted: isotonic only where ``fit`` has ``least`` positives, both only with two classes."""
    n = fit.agg(F.count("*").alias("n"), F.sum(target).alias("p")).first()
    out, methods = df.withColumn("none", F.col(score).cast("double")), ["none"]
    if n.p and n.p < n.n:
        out = platt(fit.withColumn("target", F.col(target)), out, score).withColumnRenamed("calibrated", "platt").drop("calibration_slope", "calibration_intercept")
        methods.append("platt")
        if n.p >= least:
            out = isotonic(fit, out, score, target)
            methods.append("isotonic")
    return out, methods


def brier_scores(rows: DataFrame, methods: Sequence[str], target: str = "target", digits: int = 6) -> DataFrame:
    """(method, n_rows, brier, chosen): the mean squared error of each method, to so many digits; the least is chosen, of equal ones the first named."""
    error = lambda m: F.round(F.avg((F.col(m) - F.col(target)) * (F.col(m) - F.col(target))), digits)
    found = rows.agg(F.count("*").alias("n_rows"), F.array(*[F.struct(error(m).alias("brier"), F.lit(i).alias("place"), F.lit(m).alias("method")) for i, m in enumerate(methods)]).alias("r"))
    best: Column = F.array_min("r")["method"]
    return found.select("n_rows", best.alias("best"), F.inline("r")).select("method", "n_rows", "brier", (F.col("method") == F.col("best")).alias("chosen"))


def choose_calibrator(fit: DataFrame, held_back: DataFrame, score: str = "probability", target: str = "target", least: int = 20, digits: int = 6) -> DataFrame:
    """(method, n_rows, brier, chosen) of the calibrators fitted on ``fit`` and judged on ``held_back``."""
    return brier_scores(*calibrated(fit, held_back, score, target, least), target, digits)
