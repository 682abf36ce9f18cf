"""Reports as CSV in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_report(df: DataFrame, path: str, order: Sequence[str] | None = None, rows_per_file: int = 1_000_000) -> int:
    """Writes ``df`` as CSV files with headers, whose names in order hold the rows in order; gives back the number of files.

    The order is that of ``order`` and then of all other columns, nulls last, so a rerun writes the same rows in the same places. A report of up to
    ``rows_per_file`` rows is one file; a larger one is cut by ranges of the order, never gathered in one task.
    """
    columns = [*(order or ()), *[c for c in df.columns if c not in (order or ())]]
    by = [F.col(c).asc_nulls_last() for c in columns]
    parts = max(1, -(-df.count() // rows_per_file))
    ordered = df.coalesce(1).sortWithinPartitions(*by) if parts == 1 else df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ordered.write.mode("overwrite").option("header", True).csv(path)
    return parts
