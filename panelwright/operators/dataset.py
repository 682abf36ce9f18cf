"""Model datasets: features with their labels and splits, outcomes of the locked window masked, names that leak refused."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.models import OUTSIDE, split_of
from panelwright.sources.files import forbidden_columns

#: Parts of names that no predictor may have: they tell of the outcome.
LEAKS = ("(?i)label", "(?i)outcome", "(?i)target", "(?i)^next_", "(?i)event", "(?i)status", "(?i)fail", "(?i)closing")
MASKED = "LOCKED_TEST_MASKED"


def model_dataset(features: DataFrame, labels: DataFrame, keys: Sequence[str], period: str, names: Sequence[str], windows: Sequence[tuple[str, str, str]], locked: str, leaks: Sequence[str] = LEAKS) -> DataFrame:
    """(keys, split, outcome, label_status, names): rows with a positive or negative label inside one of the windows.

    ``labels`` has keys, status and label, one row for each key. Rows of the window ``locked`` keep their features, but outcome
    and status are masked in the table itself, so whoever reads it can't look. A predictor whose name matches one of ``leaks`` raises.
    """
    bad = forbidden_columns(features.select(*names), leaks)
    if bad:
        raise ValueError(f"predictors that tell of the outcome: {bad}")
    x = features.select(*keys, *names).join(labels.select(*keys, F.col("label").alias("_label"), F.col("status").alias("_status")), list(keys))
    x = x.where(F.col("_status").isin("POSITIVE", "NEGATIVE")).withColumn("split", split_of(F.col(period), windows)).where(F.col("split") != OUTSIDE)
    hidden = F.col("split") == locked
    return x.select(*keys, "split", F.when(~hidden, F.col("_label")).alias("outcome"), F.when(hidden, MASKED).otherwise(F.col("_status")).alias("label_status"), *names)


def dataset_registry(datasets: Mapping[str, DataFrame], train: str, validation: str, locked: str) -> DataFrame:
    """(dataset, rows and positives by split, masked rows): one aggregate for each dataset."""
    out = None
    for name, df in datasets.items():
        in_split = lambda s: F.col("split") == s
        part = df.agg(F.count("*").alias("n_rows"), *[F.count_if(in_split(s)).alias(f"{c}_rows") for s, c in ((train, "train"), (validation, "validation"), (locked, "locked"))], F.count_if(in_split(train) & (F.col("outcome") == 1)).alias("train_positives"), F.count_if(in_split(validation) & (F.col("outcome") == 1)).alias("validation_positives"), F.count_if(in_split(locked) & F.col("outcome").isNull()).alias("locked_masked")).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def dataset_reconciliation(registry: DataFrame) -> DataFrame:
    """The registry with a status: splits make up all rows, and every locked row is masked."""
    whole = F.col("n_rows") == F.col("train_rows") + F.col("validation_rows") + F.col("locked_rows")
    return registry.withColumn("status", F.when(whole & (F.col("locked_rows") == F.col("locked_masked")), "PASS").otherwise("FAIL"))
