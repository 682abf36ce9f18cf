"""Windows over entity-period panels: one shuffle on the entity, one sort by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.columns import shift_quarters
from panelwright.operators.ordering import places_within


def add_lags(df: DataFrame, entity: str, period: str, columns: Sequence[str], steps: Sequence[int] = (1, 4)) -> DataFrame:
    """Columns ``<c>_lag<n>`` and ``ok_lag<n>``: the value n rows earlier, and whether that row is n quarters earlier."""
    w = Window.partitionBy(entity).orderBy(period)
    new: dict[str, Column] = {"history_row": F.row_number().over(w)}
    for n in steps:
        new[f"ok_lag{n}"] = F.coalesce(F.lag(period, n).over(w) == shift_quarters(F.col(period), -n), F.lit(False))
        for c in columns:
            new[f"{c}_lag{n}"] = F.lag(c, n).over(w)
    return df.withColumns(new)


def trailing(column: str, entity: str, period: str, function: str, n: int = 8, x: str | None = None) -> Column:
    """slope, volatility or mean over the last ``n`` rows; null unless all ``n`` have a value."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(1 - n, 0)
    y = F.col(column)
    value = {"slope": lambda: F.regr_slope(y, F.col(x or "quarter_index")), "volatility": lambda: F.stddev_samp(y), "mean": lambda: F.avg(y)}[function]()
    return F.when(F.count(y).over(w) == n, value.over(w))


def streak(df: DataFrame, entity: str, period: str, condition: Column, name: str) -> DataFrame:
    """Length of the run of rows that meet ``condition`` up to here; a null condition ends the run and gives null."""
    own = Window.partitionBy(entity).orderBy(period)  # one order for both, so rows are sorted once
    df = df.withColumn("_at", F.row_number().over(own)).withColumn("_miss", run_start(condition, "_at", own))
    return df.withColumn(name, run_length(condition, "_at", "_miss")).drop("_at", "_miss")


def run_start(condition: Column, at: str, own: WindowSpec) -> Column:
    """The place of the last row up to here that ends a run; ``at`` holds the places from 1."""
    return F.max(F.when(~F.coalesce(condition, F.lit(False)), F.col(at))).over(own.rowsBetween(Window.unboundedPreceding, 0))


def run_length(condition: Column, at: str, start: str) -> Column:
    return F.when(condition.isNotNull(), F.col(at) - F.coalesce(start, F.lit(0)))


def period_gaps(df: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period, previous): rows whose previous row isn't the previous quarter's."""
    w = Window.partitionBy(entity).orderBy(period)
    return df.select(entity, period, F.lag(period).over(w).alias("previous")).where(F.col("previous").isNotNull() & (F.col("previous") != shift_quarters(F.col(period), -1)))


def percent_rank_in(groups: Sequence[str], order: str) -> Column:
    return F.percent_rank().over(Window.partitionBy(*groups).orderBy(order))


def budget_flags(df: DataFrame, period: str, score: str, key: str, percents: Sequence[int]) -> DataFrame:
    """Unique rank by falling score in each period, and flags for the first p percent, one row at least; no period is one task."""
    x = places_within(df, [period], score, key).drop("n_before", "n_below")
    x = x.withColumnsRenamed({"place": "budget_rank", "n_rows": "period_rows"}).withColumn("budget_rank", F.col("budget_rank").cast("int"))
    return x.withColumns({f"top_{p}pct": within_budget(F.col("budget_rank"), F.col("period_rows"), p) for p in percents})


def within_budget(place: Column, n: Column, percent: int) -> Column:
    return (place <= F.greatest(F.lit(1), F.ceil(n * percent / F.lit(100)))).cast("int")


def running_totals(df: DataFrame, order: str, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``run_<c>``, a column's sum from the greatest ``order`` down to here, and ``all_<c>``, its sum over all rows; by ``groups`` if given.

    Values of ``order`` are distinct (in their group); a null stands below all others. They are cut into ranges at approximate quantiles, one for each
    shuffle partition; each range is summed by itself, and what stands before it, one row per range and group, is broadcast. No task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(order).cast("double")
    cuts = sorted(set(df.select(x.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    rows = df.withColumn("_range", F.when(x.isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut > x))) if cuts else F.lit(0))
    every = Window.partitionBy(*groups)
    ahead = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    totals = rows.groupBy(*groups, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    base = totals.select(*groups, "_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in columns], *[F.sum(c).over(every).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*groups, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(F.broadcast(base), [*groups, "_range"]).withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"_ahead_{c}") for c in columns})
    return met.drop("_range", *[f"_ahead_{c}" for c in columns])


def best_by(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("_rn = 1").drop("_rn")


def shift_join(df: DataFrame, entity: str, period: str, columns: Sequence[str], n: int) -> DataFrame:
    """Each row with the values of the row ``n`` quarters earlier, by quarter ends, not by day arithmetic."""
    past = df.select(F.col(entity).alias("_e"), shift_quarters(F.col(period), n).alias("_p"), *[F.col(c).alias(f"{c}_back{n}") for c in columns])
    return df.join(past, (F.col(entity) == F.col("_e")) & (F.col(period) == F.col("_p")), "left").drop("_e", "_p")


def coverage(df: DataFrame, entity: str, period: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count("*").alias("n_rows"), F.count_distinct(period).alias("n_periods"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) without nulls."""
    return df.unpivot(list(keys), list(columns), "feature", "value").where("value is not null")
