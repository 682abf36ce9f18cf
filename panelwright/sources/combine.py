"""Combining the files of single periods into one panel."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.files import text_schema


class CombineError(ValueError):
    """A file's columns aren't those asked for, or files share keys."""


def _reader(spark: SparkSession, kind: str):
    return spark.read.format(kind).option("header", True)


def file_schemas(spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, list[tuple[str, str]]]:
    """(column, type) of each file by its own footer or header, in the file's order; one small read for each file."""
    names = _reader(spark, kind).load(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        found = pool.map(lambda f: [(c.name, c.dataType.simpleString()) for c in _reader(spark, kind).load(f).schema], names)
        return dict(zip(names, found, strict=True))


def check_file_schemas(spark: SparkSession, path: str, columns: Sequence[str], kind: str = "parquet") -> None:
    """Raises where a file hasn't exactly these columns, all text, in this order; the message names each such file."""
    want = [(c, "string") for c in columns]
    wrong = []
    for name, have in sorted(file_schemas(spark, path, kind).items()):
        if have != want:
            lost, extra = [c for c in columns if c not in dict(have)], [c for c, _ in have if c not in columns]
            typed = [f"{c} {t}" for c, t in have if c in columns and t != "string"]
            wrong.append(f"{name}: missing {lost}, unexpected {extra}, not text {typed}" if lost or extra or typed else f"{name}: columns in another order")
    if wrong:
        raise CombineError("; ".join(wrong))


def key_clashes(spark: SparkSession, path: str, columns: Sequence[str], keys: Sequence[str], kind: str = "parquet") -> DataFrame:
    """(keys, n_rows, files): keys that more than one row has, and the files that hold them."""
    rows = _reader(spark, kind).schema(text_schema(columns)).load(path).select(*keys, F.col("_metadata.file_path").alias("file"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("file")).alias("files")).where("n_rows > 1")


def combine_periods(spark: SparkSession, path: str, columns: Sequence[str], keys: Sequence[str], out: str, kind: str = "parquet") -> DataFrame:
    """Writes all files below ``path`` as one panel sorted by ``keys`` and returns it; see the two checks above for what stops it."""
    check_file_schemas(spark, path, columns, kind)
    clashes = key_clashes(spark, path, columns, keys, kind).orderBy(*keys).limit(10).collect()  # examples for the message
    if clashes:
        raise CombineError("keys of more than one row: " + "; ".join(f"{[r[k] for k in keys]} in {r.files}" for r in clashes))
    rows = _reader(spark, kind).schema(text_schema(columns)).load(path)
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(out)
    return spark.read.schema(text_schema(columns)).parquet(out)
