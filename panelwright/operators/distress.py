"""Distress events from indicators, labels that look ahead, and the validation of dated events against a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import quarter_end


def distress_events(features: DataFrame, keys: Sequence[str], categories: Mapping[str, Column], severe: Column, least: int = 2) -> DataFrame:
    """Adds n_categories, drivers (their names in order) and distress: ``least`` categories of evidence, or a severe sign."""
    names = sorted(categories)
    hit = F.array_compact(F.array(*[F.when(categories[n], F.lit(n)) for n in names]))
    x = features.select(*keys, hit.alias("hit"), F.coalesce(severe, F.lit(False)).alias("severe"))
    return x.select(*keys, F.size("hit").alias("n_categories"), F.array_join("hit", ",").alias("drivers"), "severe", (F.col("severe") | (F.size("hit") >= least)).alias("distress"))


def look_ahead(rows: DataFrame, entity: str, period: str, value: Column, months: int) -> DataFrame:
    """Adds n_ahead and any_ahead: the rows of the entity within (period, period + months], and whether ``value`` holds in one.

    A window over the months of the rows, not a range join: a row meets those of its entity in the months of the horizon, however many there are,
    and the days decide in the first and the last of these months.
    """
    day = F.unix_date(F.col(period))
    end = F.unix_date(F.add_months(F.col(period), months))
    own = Window.partitionBy(entity).orderBy(F.year(period) * 12 + F.month(period)).rangeBetween(0, months)
    ahead = F.collect_list(F.struct(day.alias("day"), F.coalesce(value, F.lit(False)).alias("hit"))).over(own)
    inside = F.filter(ahead, lambda r: (r["day"] > day) & (r["day"] <= end))
    return rows.withColumns({"n_ahead": F.size(inside), "any_ahead": F.exists(inside, lambda r: r["hit"])})


def distress_labels(events: DataFrame, entity: str, period: str, months: int, last: str) -> DataFrame:
    """Status and label: already in distress, no follow-up, positive (distress ahead), right-censored, negative."""
    x = look_ahead(events, entity, period, F.col("distress"), months)
    censored = F.add_months(F.col(period), months) > F.lit(last).cast("date")
    status = F.when(F.col("distress"), "INELIGIBLE_IN_DISTRESS").when(F.col("any_ahead"), "POSITIVE").when(censored, "RIGHT_CENSORED").when(F.col("n_ahead") == 0, "INELIGIBLE_NO_FOLLOW_UP").otherwise("NEGATIVE")
    return x.withColumn("status", status).withColumn("label", F.when(F.col("status") == "POSITIVE", 1).when(F.col("status") == "NEGATIVE", 0))


def validate_events(events: DataFrame, panel: DataFrame, entity: str, period: str, date: str, start: str) -> DataFrame:
    """(events, first_period, last_period, last_before, n_before, coverage): each event against its entity's history.

    coverage: UNMATCHED (no history), BEFORE_START, NO_PRIOR_OBSERVATION, or COVERED.
    """
    bounds = panel.groupBy(entity).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    # one pass over an entity's periods and events by date: an event comes before the period of its own day
    seen = panel.select(entity, F.col(period).alias("_seen")).distinct().withColumns({"_at": F.col("_seen"), "_is": F.lit(1)})
    both = events.withColumns({"_at": F.col(date), "_is": F.lit(0)}).unionByName(seen, allowMissingColumns=True)
    past = Window.partitionBy(entity).orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, -1)
    x = both.withColumns({"last_before": F.last("_seen", ignorenulls=True).over(past), "n_before": F.count("_seen").over(past)}).where("_is = 0").drop("_at", "_is", "_seen").join(bounds, entity, "left")
    coverage = F.when(F.col("first_period").isNull(), "UNMATCHED").when(F.col(date) < F.lit(start).cast("date"), "BEFORE_START").when(F.col("n_before") == 0, "NO_PRIOR_OBSERVATION").otherwise("COVERED")
    return x.withColumn("coverage", coverage)


def rows_around_events(panel: DataFrame, events: DataFrame, entity: str, period: str, date: str) -> DataFrame:
    """(panel, date, place) of the rows of entities with an event: BEFORE its quarter, in the SAME_QUARTER, or AFTER; ``events`` has one row for each entity."""
    quarter = quarter_end(F.col(date))
    place = F.when(F.col(period) > quarter, "AFTER").when(F.col(period) == quarter, "SAME_QUARTER").otherwise("BEFORE")
    return panel.join(events.select(entity, date), entity).withColumn("place", place)


def first_exits(exits: DataFrame, entity: str, date: str, kind: str) -> DataFrame:
    """One exit for each entity and kind, the first by date; n_repeats tells how many others there were."""
    return exits.groupBy(entity, kind).agg(F.min(date).alias(date), (F.count("*") - 1).alias("n_repeats"))
