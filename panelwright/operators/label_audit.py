"""Audits of outcome labels: a second derivation of sampled rows, and rows whose event lies at the horizon's edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratified_rows(labels: DataFrame, strata: Sequence[str], keys: Sequence[str], each: int = 3) -> DataFrame:
    """At most ``each`` rows of every stratum: the row with the least digest of its keys in each of as many parts of the digests.

    An aggregate with partial results, so a stratum with most of the rows is no single task.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    part = F.pmod(F.conv(F.substring(digest, 25, 8), 16, 10).cast("long"), F.lit(each))
    first = labels.groupBy(*strata, part.alias("_part")).agg(F.min(F.struct(digest.alias("d"), *keys)).alias("_r"))
    return first.select(*strata, *[F.col(f"_r.{k}").alias(k) for k in keys])


def derived_status(rows: DataFrame, panel: DataFrame, events: DataFrame, entity: str, period: str, months: int, end: str, failure: str = "FAILURE", min_history: int = 4) -> DataFrame:
    """Adds ``expected``: the status of each row from counts over its entity's periods and events, one join for each and no window.

    ``rows`` are few; ``panel`` has (entity, period, blocked), ``events`` (entity, event_date, event_type). Of the events of the horizon
    those of the first day decide, and on that day the lesser name.
    """
    own = rows.select(F.col(entity).alias("_e"), F.col(period).alias("_p")).distinct()
    past = panel.join(F.broadcast(own), (F.col(entity) == F.col("_e")) & (F.col(period) <= F.col("_p")))
    history = past.groupBy("_e", "_p").agg(F.count("*").alias("n_past"), F.bool_or((F.col(period) == F.col("_p")) & F.col("blocked")).alias("is_blocked"))
    horizon = F.add_months(F.col("_p"), months)
    ahead = (F.col("event_date") > F.col("_p")) & (F.col("event_date") <= horizon)
    seen = events.join(F.broadcast(own), F.col(entity) == F.col("_e")).groupBy("_e", "_p").agg(
        F.count_if((F.col("event_type") == failure) & (F.col("event_date") <= F.col("_p"))).alias("failed_before"), F.min(F.when(ahead, F.struct("event_date", "event_type"))).alias("first_ahead")
    )
    both = own.join(history, ["_e", "_p"], "left").join(seen, ["_e", "_p"], "left")
    kind = F.col("first_ahead.event_type")
    status = (
        F.when(F.col("failed_before") > 0, "INELIGIBLE_POST_EVENT").when(F.col("is_blocked"), "INELIGIBLE_QUALITY").when(F.coalesce("n_past", F.lit(0)) < min_history, "INELIGIBLE_SHORT_HISTORY")
        .when(kind == failure, "POSITIVE").when(kind.isNotNull(), "COMPETING_EXIT").when(horizon > F.lit(end).cast("date"), "RIGHT_CENSORED").otherwise("NEGATIVE")
    )
    found = both.select(F.col("_e").alias(entity), F.col("_p").alias(period), status.alias("expected"))
    return rows.join(F.broadcast(found), [entity, period], "left")


def boundary_cases(labels: DataFrame, days: int = 31) -> DataFrame:
    """(days_past, status, n_rows, agrees): rows whose next event lies within ``days`` of the horizon's last day.

    ``days_past`` counts from that day: up to 0 the event is inside and the row positive or a competing exit, past it neither. Rows
    that are ineligible by other rules agree with either.
    """
    x = labels.withColumn("days_past", F.datediff("next_date", "horizon_end")).where(F.abs("days_past") <= days)
    inside = F.col("status").isin("POSITIVE", "COMPETING_EXIT")
    agrees = F.col("status").startswith("INELIGIBLE") | (inside == (F.col("days_past") <= 0))
    return x.groupBy("days_past", "status").agg(F.count("*").alias("n_rows")).withColumn("agrees", agrees)
