"""Dated events and outcome labels that know about censoring and competing exits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_event(panel: DataFrame, events: DataFrame, entity: str, period: str, date: str = "event_date", kind: str = "event_type") -> DataFrame:
    """Adds the first event after each row's period: a union of both tables and one window, not a range join.

    Events and rows of an entity are sorted by date, the last first; each row takes the latest event seen so far, which is one
    pass whatever the history's length. Of two events on one day the one with the lesser type name counts. An event
    on the period's own day is past. Rows without an entity or a period have no next event, and events without them are nobody's.
    """
    rows = panel.withColumns({"_at": F.col(period), "_e": F.lit(None).cast("struct<d:date,k:string>"), "_is": F.lit(1)})
    marks = events.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).groupBy(entity, date).agg(F.min(kind).alias("_k")).select(entity, F.col(date).alias("_at"), F.struct(F.col(date).alias("d"), F.col("_k").alias("k")).alias("_e"), F.lit(0).alias("_is"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    after = Window.partitionBy(entity).orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_n", F.when(F.col(period).isNotNull(), F.last("_e", ignorenulls=True).over(after))).where("_is = 1")
    return out.withColumns({"next_date": F.col("_n.d"), "next_type": F.col("_n.k")}).drop("_at", "_e", "_is", "_n")


def one_a_day(events: DataFrame, entity: str, date: str = "event_date", kind: str = "event_type") -> DataFrame:
    """(entity, date, kind): an entity's events of one day as one, the lesser type name, so that next and first events are of the same list."""
    return events.groupBy(entity, date).agg(F.min(kind).alias(kind))


def prior_event(panel: DataFrame, events: DataFrame, entity: str, period: str, date: str = "event_date") -> DataFrame:
    """Adds the first event of each entity: rows on or after it are past the event."""
    first = events.groupBy(entity).agg(F.min(date).alias("first_event"))
    return panel.join(first, entity, "left").withColumn("post_event", F.coalesce(F.col(period) >= F.col("first_event"), F.lit(False)))


def numbered(panel: DataFrame, entity: str, period: str) -> DataFrame:
    if "history" in panel.columns:
        return panel
    return panel.withColumn("history", F.row_number().over(Window.partitionBy(entity).orderBy(F.asc_nulls_last(period))))


def labels_of_horizons(panel: DataFrame, entity: str, period: str, horizons: Mapping[str, int], end: str, **rules) -> DataFrame:
    """:func:`outcome_labels` of several horizons (name: months), one below the other under ``horizon``; the panel is built once."""
    each = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(m).alias("_months")) for n, m in horizons.items()])
    x = numbered(panel, entity, period).select("*", F.inline(each))
    return outcome_labels(x, entity, period, F.col("_months"), end, **rules).drop("_months")


def outcome_labels(panel: DataFrame, entity: str, period: str, months: int | Column, end: str, failure: str = "FAILURE", min_history: int = 4) -> DataFrame:
    """Status and tri-state label of each row for one horizon.

    Order of the tests: past the event, blocked by quality, short history, positive, competing exit, right-censored,
    negative; the horizon's last day is inside. Only positives and negatives have a label. Needs
    ``post_event``, ``blocked``, ``next_date`` and ``next_type``; ``history``, the row's number in its entity, is made unless it is there.
    """
    horizon = F.add_months(F.col(period), months)
    df = numbered(panel, entity, period).withColumn("horizon_end", horizon)
    hit = F.col("next_date").isNotNull() & (F.col("next_date") <= F.col("horizon_end"))
    status = (
        F.when(F.col("post_event"), "INELIGIBLE_POST_EVENT").when(F.col("blocked"), "INELIGIBLE_QUALITY").when(F.col("history") < min_history, "INELIGIBLE_SHORT_HISTORY")
        .when(hit & (F.col("next_type") == failure), "POSITIVE").when(hit, "COMPETING_EXIT").when(F.col("horizon_end") > F.lit(end).cast("date"), "RIGHT_CENSORED").otherwise("NEGATIVE")
    )
    return df.withColumn("status", status).withColumn("label", F.when(F.col("status") == "POSITIVE", 1).when(F.col("status") == "NEGATIVE", 0)).withColumn("lead_days", F.when(F.col("label") == 1, F.datediff("next_date", period)))
