"""Reference tables of events: classes, role ids, failures and other exits, and how they were resolved against a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNRESOLVED = "UNRESOLVED"


@dataclass(frozen=True)
class EventClass:
    """A class and what makes an event one: its code, a keyword in its text, or a condition. Classes are tried in order."""

    name: str
    codes: Sequence[str] = ()
    keywords: Sequence[str] = ()
    condition: str | None = None


def classify(code: Column, text: Column, classes: Sequence[EventClass], otherwise: str = "OTHER") -> Column:
    """The name of the first class that the event fits; null codes and texts fit none by themselves. Keywords ignore case."""
    out = F
    low = F.lower(text)
    for c in classes:
        fits = F.lit(False)
        if c.codes:
            fits = fits | F.coalesce(code.isin(*c.codes), F.lit(False))
        for k in c.keywords:
            fits = fits | F.coalesce(F.contains(low, F.lit(k.lower())), F.lit(False))
        if c.condition:
            fits = fits | F.coalesce(F.expr(c.condition), F.lit(False))
        out = out.when(fits, c.name)
    return out.otherwise(otherwise)


def first_role(roles: Mapping[str, Column], none: str = "none") -> tuple[Column, Column]:
    """(id, role): the first id that is there, in the order of ``roles``, and the role that it comes from."""
    return F.coalesce(*roles.values()), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in roles.items()], F.lit(none))


def failure_reference(failures: DataFrame, panel: DataFrame, entity: str, period: str, date: str, start: str) -> DataFrame:
    """(failures, first and last period, n_rows, resolution): each failure as given, resolved against the panel; none is dropped.

    resolution: UNRESOLVED (no such entity), BEFORE_START (older than the panel's ``start``), NO_HISTORY (the entity begins after the failure),
    LATER_PERIODS (it goes on after the failure's quarter), RESOLVED.
    """
    own = panel.groupBy(entity).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count("*").alias("n_rows"))
    x = failures.join(own, entity, "left")
    end = F.last_day(F.add_months(F.date_trunc("quarter", F.col(date)).cast("date"), 2))
    how = F.when(F.col(date) < F.lit(start).cast("date"), "BEFORE_START").when(F.col("first_period").isNull(), UNRESOLVED).when(F.col("first_period") >= F.col(date), "NO_HISTORY").when(F.col("last_period") > end, "LATER_PERIODS").otherwise("RESOLVED")
    return x.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "resolution": how})


def exit_reference(failures: DataFrame, history: DataFrame, entity: str, date: str, kind: str, exits: Sequence[str], failure: str = "FAILURE") -> DataFrame:
    """(entity, kind, date, source, n_records): every exit once, failures from their own table and the others from the history.

    History events count that are of one of the ``exits``; one of an entity that also failed on that day or later is no exit of its own but
    CONFIRMS_FAILURE. Of several records of one entity and kind the first date stays.
    """
    first = failures.groupBy(entity).agg(F.min(date).alias("_f"))
    other = history.where(F.col(kind).isin(*exits)).join(first, entity, "left")
    other = other.select(entity, F.when(F.col("_f") >= F.col(date), "CONFIRMS_FAILURE").otherwise(F.col(kind)).alias(kind), date, F.lit("history").alias("source"))
    both = failures.select(entity, F.lit(failure).alias(kind), date, F.lit("failures").alias("source")).unionByName(other)
    return both.groupBy(entity, kind, "source").agg(F.min(date).alias(date), F.count("*").alias("n_records"))


def label_exceptions(labels: DataFrame, references: DataFrame, keys: Sequence[str], entity: str, date: str) -> DataFrame:
    """(exception_id, kind, severity, entity, day, observed): what a reader of the labels should know, one row each.

    UNMATCHED_FAILURE for failures that aren't RESOLVED, RIGHT_CENSORED and COMPETING_EXIT for label rows of these statuses.
    """
    status = F.col("status")
    kind = F.when(status == "RIGHT_CENSORED", "RIGHT_CENSORED").when(status == "COMPETING_EXIT", "COMPETING_EXIT")
    a = labels.withColumn("kind", kind).where("kind is not null").select("kind", F.lit("Informational").alias("severity"), F.col(keys[0]).alias("entity"), F.col(keys[1]).alias("day"), status.alias("observed"))
    b = references.where("resolution <> 'RESOLVED'").select(F.lit("UNMATCHED_FAILURE").alias("kind"), F.when(F.col("resolution") == UNRESOLVED, "Warning").otherwise("Informational").alias("severity"), F.col(entity).alias("entity"), F.col(date).alias("day"), F.col("resolution").alias("observed"))
    return a.unionByName(b).withColumn("exception_id", F.md5(F.concat_ws("|", "kind", F.col("entity").cast("string"), F.col("day").cast("string"))))
