"""Captured events by alert budget, and one case for each role by fixed rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scratch import kept


@dataclass(frozen=True)
class Role:
    """Who plays a role: rows of ``among`` (events or rows) that meet ``where``, the first by ``order`` and then the entity; shown at ``at``."""

    name: str
    among: str
    where: str
    order: tuple[str, ...]
    at: str


#: The eight roles of the case table; conditions are over :func:`capture_by_budget` or the scored rows.
ROLES = (
    Role("short lead", "events", "alert_5 is not null", ("lead_5",), "alert_5"), Role("long lead", "events", "alert_5 is not null", ("-lead_5",), "alert_5"),
    Role("captured at 1%", "events", "alert_1 is not null", ("-max_score",), "alert_1"), Role("captured at 5%, not at 1%", "events", "alert_5 is not null and alert_1 is null", ("unix_date(event_date)",), "alert_5"),
    Role("missed", "events", "alert_10 is null", ("unix_date(event_date)",), "last_row"), Role("false alarm", "rows", "target = 0", ("-score", "unix_date(period)"), "period"),
    Role("small and captured", "events", "small and alert_5 is not null", ("unix_date(event_date)",), "alert_5"), Role("largest", "events", "true", ("-size", "unix_date(event_date)"), "coalesce(alert_5, largest_row)"),
)


def capture_by_budget(rows: DataFrame, percents: Sequence[int] = (1, 5, 10), small: int = 1) -> DataFrame:
    """An event a row, from its positive rows (entity, period, event_date, score, size, target = 1 and top_<p>pct): first alerts and lead days of each budget.

    Also max_score, last_row (its last period), size (the greatest), largest_row (the first period with it) and small (a row's size is ``small`` or less).
    One aggregate; a budget's first alert is null where it missed the event.
    """
    per = rows.where("target = 1 and event_date is not null").groupBy("entity", "event_date")
    alerts = [F.min(F.when(F.col(f"top_{p}pct") == 1, F.col("period"))).alias(f"alert_{p}") for p in percents]
    x = per.agg(*alerts, F.max("score").alias("max_score"), F.max("period").alias("last_row"), F.max(F.struct("size", (-F.unix_date("period")).alias("d"))).alias("_big"), (F.min("size") <= small).alias("small"))
    x = x.withColumns({"size": F.col("_big.size"), "largest_row": F.date_from_unix_date(-F.col("_big.d"))}).drop("_big")
    return x.withColumns({f"lead_{p}": F.datediff("event_date", f"alert_{p}") for p in percents})


def _first(role: Role) -> Column:
    order = [F.expr(o).cast("double").alias(f"o{i}") for i, o in enumerate(role.order)]
    day = F.col("event_date") if role.among == "events" else F.lit(None).cast("date")
    return F.min(F.when(F.expr(role.where), F.struct(*order, F.col("entity").alias("entity"), day.alias("event_date"), F.expr(role.at).alias("period")))).alias(role.name)


def case_studies(rows: DataFrame, roles: Sequence[Role] = ROLES, small: int = 1) -> DataFrame:
    """(role, state, entity, period, event_date, alert, lead_days, captured_1, captured_5, captured_10, target) and the other columns of the row shown.

    ``rows`` are scored rows: entity, period, event_date, score, size, target, top_1pct, top_5pct, top_10pct and any others. A role that nobody can play is
    UNAVAILABLE. Rows and events are written once; one aggregate over each finds all its roles, and ties go to the lesser entity. Entity and
    period name one row.
    """
    rows = kept(rows, "case-rows")
    events = kept(capture_by_budget(rows, small=small), "case-events")
    picked = None
    for among, table in (("events", events), ("rows", rows)):
        mine = [r for r in roles if r.among == among]
        if mine:
            one = table.agg(*[_first(r) for r in mine])
            cells = [F.struct(F.lit(roles.index(r) + 1).alias("place"), F.lit(r.name).alias("role"), F.col(f"`{r.name}`.entity").alias("entity"), F.col(f"`{r.name}`.event_date").alias("event_date"), F.col(f"`{r.name}`.period").alias("period")) for r in mine]
            part = one.select(F.inline(F.array(*cells)))
            picked = part if picked is None else picked.unionByName(part)
    # a row for each role
    shown = rows.drop("event_date").join(F.broadcast(picked), ["entity", "period"], "right")
    mark = events.select("entity", "event_date", F.col("alert_5").alias("alert"), F.col("lead_5").alias("lead_days"), *[F.col(f"alert_{p}").isNotNull().alias(f"captured_{p}") for p in (1, 5, 10)])
    wanted = mark.join(F.broadcast(picked.select("entity", "event_date").where("event_date is not null").distinct()), ["entity", "event_date"], "left_semi")
    out = shown.join(F.broadcast(wanted), ["entity", "event_date"], "left")  # at most a row for each role
    return out.withColumns({"state": F.when(F.col("entity").isNull(), "UNAVAILABLE").otherwise("SELECTED"), **{f"captured_{p}": F.coalesce(f"captured_{p}", F.lit(False)) for p in (1, 5, 10)}})
