"""What decides whether a row can have a label: history, gaps, events before and after it, and follow-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import shift_quarters


def label_eligibility(panel: DataFrame, events: DataFrame, entity: str, period: str, date: str, kind: str, horizons: Mapping[str, int], end: str, failure: str = "FAILURE", competing: tuple[str, ...] = ("EXIT",), assistance: str = "ASSISTANCE", min_history: int = 4) -> DataFrame:
    """Every row of ``panel`` with all that its labels depend on.

    history: the row's number in its entity; prior_period; gap: there is a prior row and it isn't the previous quarter's;
    next_failure, exit_date, exit_type, next_assistance: the first such event after the period (of exits on one day the lesser name);
    first_failure: the entity's first failure if it lies on or before the period; short_history; and for each horizon (name: months)
    ``horizon_end_<name>`` and ``complete_<name>``, whether it ends by ``end``, the last day of surveillance.

    Rows and events are one table, sorted by entity and day both ways; each row looks at what stands before it, so a history costs
    one pass however long it is, and there is one shuffle. Events without an entity or a day are left out. A period that an entity has
    twice is two rows of its history.
    """
    days = events.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    of = lambda *kinds: F.min(F.when(F.col(kind).isin(*kinds), F.struct(F.col(date).alias("d"), F.col(kind).alias("k"))))
    marks = days.groupBy(entity, F.col(date).alias("_at")).agg(of(failure).alias("_failure"), of(*competing).alias("_exit"), of(assistance).alias("_help")).withColumn("_is", F.lit(0))
    rows = panel.withColumns({"_at": F.col(period), "_is": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    up = Window.partitionBy(entity).orderBy("_at", "_is")
    past, until = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(entity).orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda c: F.last(c, ignorenulls=True).over(after)
    x = both.withColumns({"history": F.sum("_is").over(until), "prior_period": F.max(F.when(F.col("_is") == 1, F.col("_at"))).over(past), "first_failure": F.min("_failure.d").over(until)})
    x = x.withColumns({"next_failure": nearest("_failure")["d"], "_next_exit": nearest("_exit"), "next_assistance": nearest("_help")["d"]}).where("_is = 1")
    x = x.withColumns({"exit_date": F.col("_next_exit.d"), "exit_type": F.col("_next_exit.k"), "gap": F.coalesce(F.col("prior_period") != shift_quarters(F.col(period), -1), F.lit(False)), "short_history": F.col("history") < min_history})
    for name, months in horizons.items():
        x = x.withColumn(f"horizon_end_{name}", F.add_months(F.col(period), months))
        x = x.withColumn(f"complete_{name}", F.col(f"horizon_end_{name}") <= F.lit(end).cast("date"))
    return x.drop("_at", "_is", "_failure", "_exit", "_help", "_next_exit")
