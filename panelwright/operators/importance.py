"""Permutation importance: how much of the average precision goes when one feature's values are dealt out anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.metrics import ranking_metrics
from panelwright.operators.ordering import by_digest, global_index

WHOLE = ""  # the name under which the unchanged rows go


def _dealt(df: DataFrame, keys: Sequence[str], features: Sequence[str], repeats: int) -> DataFrame:
    """Every row ``repeats`` times, with another row's features as ``_other``: a permutation for each repeat.

    The rows in the order of one digest of their keys meet the rows in the order of another, place by place; no task sees all rows.
    """
    named = F.concat_ws("|", F.col("repeat").cast("string"), *[F.col(k).cast("string") for k in keys])
    own = by_digest(df.withColumn("_d", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))), F.col("_d"))
    own = global_index(own, [F.col("_d"), *map(F.col, keys)], "_place").drop("_d", "n_rows")
    other = df.select(*keys, F.struct(*features).alias("_other"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    other = by_digest(other.withColumn("_d", F.md5(named)), F.col("_d"))
    other = global_index(other, [F.col("_d"), *map(F.col, keys)], "_place", ["repeat"])
    return own.join(other.select("repeat", "_place", "_other"), "_place").drop("_place")


def permutation_importance(df: DataFrame, keys: Sequence[str], features: Sequence[str], score: Callable[[DataFrame], DataFrame], target: str, repeats: int = 3) -> DataFrame:
    """(feature, base_ap, importance_mean, importance_std): the loss of average precision over ``repeats`` permutations of each feature.

    ``score`` adds the column ``score`` to rows that have ``keys``, ``features`` and the target; it is called once, on all copies of all rows,
    so a fitted model scores them in one job. Keys are unique. The deviation is that of the repeats alone (divisor ``repeats``).
    """
    rows = df.select(*keys, target, *features)
    dealt = _dealt(rows, keys, features, repeats).withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    changed = dealt.withColumns({c: F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in features}).drop("_other")
    every = changed.unionByName(rows.withColumns({"feature": F.lit(WHOLE), "repeat": F.lit(0)}))
    ap = ranking_metrics(score(every), "score", target, ("feature", "repeat"), ranged=True).select("feature", "repeat", "average_precision")  # a row for each copy
    base = ap.where(F.col("feature") == WHOLE).select(F.col("average_precision").alias("base_ap"))
    lost = ap.where(F.col("feature") != WHOLE).crossJoin(F.broadcast(base)).withColumn("loss", F.col("base_ap") - F.col("average_precision"))
    return lost.groupBy("feature", "base_ap").agg(F.round(F.avg("loss"), 6).alias("importance_mean"), F.round(F.stddev_pop("loss"), 6).alias("importance_std"))

