"""Benchmarks against same-period peer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peer_groups(df: DataFrame, period: str, band: str, kind: str, min_n: int = 20) -> DataFrame:
    """Adds the final group: period, band and class where that has ``min_n`` rows and the band is known, else period and band."""
    text = F.date_format(F.col(period), "yyyy-MM-dd")
    df = df.withColumns({"detailed_group": F.concat_ws("|", text, F.col(band), F.coalesce(F.col(kind), F.lit("UNKNOWN"))), "broad_group": F.concat_ws("|", text, F.col(band))})
    size = lambda c: F.count("*").over(Window.partitionBy(c))
    df = df.withColumns({"detailed_size": size("detailed_group"), "broad_size": size("broad_group")})
    detailed = (F.col("detailed_size") >= min_n) & (F.col(band) != "UNKNOWN")
    return df.withColumns({"peer_group": F.when(detailed, F.col("detailed_group")).otherwise(F.col("broad_group")), "peer_method": F.when(detailed, "DETAILED").otherwise("BROAD"), "peer_size": F.when(detailed, F.col("detailed_size")).otherwise(F.col("broad_size"))}).withColumn("too_small", F.col("peer_size") < min_n)


def small_groups(df: DataFrame, period: str, band: str, kind: str, counts: Column, min_n: int = 20) -> DataFrame:
    """Adds ``small_group``: whether the row's final group by :func:`peer_groups` has fewer than ``min_n`` of the rows where ``counts`` holds; false for the others.

    Rows are counted by period, band and class, and the counts, a row for each of these, are broadcast: no row of ``df`` is moved. ``df`` is read twice.
    """
    kinds = F.coalesce(kind, F.lit("UNKNOWN"))
    by = df.where(counts).groupBy(F.col(period).alias("_p"), F.col(band).alias("_b"), kinds.alias("_k")).agg(F.count("*").alias("_n"))
    by = by.withColumn("_all", F.sum("_n").over(Window.partitionBy("_p", "_b")))  # a row for each class
    x = df.join(F.broadcast(by), F.col(period).eqNullSafe(F.col("_p")) & F.col(band).eqNullSafe(F.col("_b")) & kinds.eqNullSafe(F.col("_k")), "left")
    detailed = (F.col("_n") >= min_n) & (F.col(band) != "UNKNOWN")
    return x.withColumn("small_group", F.coalesce(counts & ~detailed & (F.col("_all") < min_n), F.lit(False))).drop("_p", "_b", "_k", "_n", "_all")


def peer_benchmark(long: DataFrame, groups: Sequence[str] = ("peer_group", "feature"), value: str = "value", inverted: Sequence[str] = (), direct: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, quartiles, percentile, risk percentile, difference and robust z of every value in its group.

    One shuffle on the group: exact percentiles and the median absolute deviation are window aggregates over it.
    """
    w = Window.partitionBy(*groups)
    v = F.col(value)
    df = long.withColumns({"peer_count": F.count(v).over(w), "peer_mean": F.avg(v).over(w), "peer_median": F.median(v).over(w), "peer_p25": F.percentile(v, F.lit(0.25)).over(w), "peer_p75": F.percentile(v, F.lit(0.75)).over(w), "percentile": F.percent_rank().over(w.orderBy(v))})
    df = df.withColumn("peer_mad", F.median(F.abs(v - F.col("peer_median"))).over(w))
    risk = F.when(F.col("feature").isin(*inverted), 1 - F.col("percentile")).when(F.col("feature").isin(*direct), F.col("percentile"))
    return df.withColumns({"risk_percentile": risk, "median_difference": v - F.col("peer_median"), "robust_z": F.when(F.col("peer_mad") > 0, (v - F.col("peer_median")) / (1.4826 * F.col("peer_mad")))})


def peer_summary(bench: DataFrame, period: str, min_n: int = 20) -> DataFrame:
    return bench.groupBy(period, "feature").agg(F.count("*").alias("n_rows"), F.count_distinct("peer_group").alias("n_groups"), F.min("peer_count").alias("min_peer_count"), F.median("peer_count").alias("median_peer_count"), F.count_if(F.col("peer_count") < min_n).alias("small_rows"))
