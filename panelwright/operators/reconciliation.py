"""Reconciliation of two sources field by field, of stages by rows, and whole profiles of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.columns import is_missing, safe_date

AGREED = ("EXACT", "WITHIN_TOLERANCE", "BOTH_NULL")


def reconcile_fields(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, float | None]) -> DataFrame:
    """(keys, field, agreement, difference): one full outer join, then a row for each key and field.

    ``fields`` has each field's tolerance, as a share of the greater value (of 1 at least); None for fields that have to be equal,
    such as texts and dates. ``keys`` are unique and not null on both sides. ``difference`` is right minus left of numbers.
    Agreement: KEY_ONLY_LEFT or KEY_ONLY_RIGHT, BOTH_NULL, NULL_LEFT, NULL_RIGHT, EXACT, WITHIN_TOLERANCE, DIFFERENT.
    """
    a = left.select(*keys, F.struct(*fields).alias("_l"))
    both = a.join(right.select(*keys, F.struct(*fields).alias("_r")), list(keys), "full_outer")

    def compared(name: str, tolerance: float | None) -> Column:
        x, y = F.col(f"_l.{name}"), F.col(f"_r.{name}")
        difference = F.lit(None).cast("double") if tolerance is None else (y - x).cast("double")
        out = F.when(F.col("_r").isNull(), "KEY_ONLY_LEFT").when(F.col("_l").isNull(), "KEY_ONLY_RIGHT").when(x.isNull() & y.isNull(), "BOTH_NULL").when(x.isNull(), "NULL_LEFT").when(y.isNull(), "NULL_RIGHT").when(x == y, "EXACT")
        if tolerance is not None:
            out = out.when(F.abs(difference) <= tolerance * F.greatest(F.abs(x).cast("double"), F.abs(y).cast("double"), F.lit(1.0)), "WITHIN_TOLERANCE")
        return F.struct(F.lit(name).alias("field"), out.otherwise("DIFFERENT").alias("agreement"), difference.alias("difference"))

    return both.select(*keys, F.inline(F.array(*[compared(n, t) for n, t in fields.items()])))


def agreement_summary(compared: DataFrame) -> DataFrame:
    """(field, n_keys, agreed, different, one_sided, agreed_pct, largest_difference) of :func:`reconcile_fields`."""
    kind = F.col("agreement")
    x = compared.groupBy("field").agg(F.count("*").alias("n_keys"), F.count_if(kind.isin(*AGREED)).alias("agreed"), F.count_if(kind == "DIFFERENT").alias("different"), F.count_if(kind.startswith("KEY_ONLY") | kind.isin("NULL_LEFT", "NULL_RIGHT")).alias("one_sided"), F.max(F.abs("difference")).alias("largest_difference"))
    return x.withColumn("agreed_pct", F.round(100.0 * F.col("agreed") / F.col("n_keys"), 6))


def stage_counts(stages: Mapping[str, tuple[DataFrame, DataFrame, Column]], documented: Sequence[str] = ()) -> DataFrame:
    """(source, rows_before, rows_after, difference, parse_failures, status) of each source's rows before and after a stage.

    The third entry tells which rows after the stage failed to parse. Equal row counts pass; failed parses too in sources named in
    ``documented``, and with that note.
    """
    out = None
    for name, (before, after, failed) in stages.items():
        b = before.agg(F.count("*").alias("rows_before"))
        part = after.agg(F.count("*").alias("rows_after"), F.count_if(failed).alias("parse_failures")).crossJoin(b).withColumn("source", F.lit(name))  # one row each
        out = part if out is None else out.unionByName(part)
    whole = F.col("rows_after") == F.col("rows_before")
    noted = F.col("source").isin(*documented) if documented else F.lit(False)
    status = F.when(whole & (F.col("parse_failures") == 0), "PASS").when(whole & noted, "PASS_WITH_DOCUMENTED_PARSE_EXCEPTIONS").otherwise("FAIL")
    return out.select("source", "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("difference"), "parse_failures", status.alias("status"))


def column_profile(df: DataFrame, keys: Sequence[str], formats: Sequence[str] = ("yyyy-MM-dd",)) -> DataFrame:
    """(column, n_rows, n_columns, missing, n_dates, first_date, last_date, duplicate_rows, duplicate_keys): a row for each column.

    All in one aggregate over the table. Cells that hold a missing token are missing; dates are the texts of the given formats;
    rows that repeat another whole row are told by a hash of all columns. An empty table has a row for each column too.
    """
    text = {c: F.col(c).cast("string") for c in df.columns}
    day = {c: safe_date(t, formats) for c, t in text.items()}
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(is_missing(text[c])).alias("missing"), F.count(day[c]).alias("n_dates"), F.min(day[c]).alias("first_date"), F.max(day[c]).alias("last_date")) for c in df.columns]
    whole = F.xxhash64(*[F.coalesce(t, F.lit("\0")) for t in text.values()])
    x = df.agg(F.array(*cells).alias("cells"), F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(whole)).alias("duplicate_rows"), (F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicate_keys"))
    return x.select(F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows", "duplicate_rows", "duplicate_keys", F.inline("cells"))
