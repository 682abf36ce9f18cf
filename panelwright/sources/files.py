"""Strict readers of all-text sources and sorted writers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def text_schema(fields: Sequence[str]) -> StructType:
    return StructType([StructField(f, StringType()) for f in fields])


def read_text_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return spark.read.schema(text_schema(fields)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_text_panel(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return check_schema(spark.read.parquet(path), fields).select(*[F.col(f).cast("string") for f in fields])


def check_schema(df: DataFrame, required: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """The table itself; raises where a required column is missing or one outside ``allowed`` is there."""
    lost = set(required) - set(df.columns)
    extra = set(df.columns) - set(allowed) if allowed is not None else set()
    if lost or extra:
        raise ValueError(f"schema drift: missing {sorted(lost)}, unexpected {sorted(extra)}")
    return df


def page_problems(pages: DataFrame) -> DataFrame:
    """(offset, problem) of landed pages (offset, row_count, total, sha256): gaps, overlaps, repeated content, changed totals, a short end.

    Pages are metadata, a row for each file of one source; the windows run over those rows.
    """
    order = Window.orderBy("offset")
    x = pages.withColumns({"before": F.lag(F.col("offset") + F.col("row_count")).over(order), "first_total": F.first("total").over(order), "twin": F.count("*").over(Window.partitionBy("sha256")), "next": F.lead("offset").over(order)})
    start = F.coalesce("before", F.lit(0))
    tests = [(F.col("offset") > start, "GAP"), (F.col("offset") < start, "OVERLAP"), (F.col("twin") > 1, "REPEATED_CONTENT"), (F.col("total") != F.col("first_total"), "CHANGED_TOTAL"), (F.col("next").isNull() & (F.col("offset") + F.col("row_count") != F.col("total")), "INCOMPLETE")]
    return x.select("offset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))).alias("problem"))


def query_table(spark: SparkSession, path: str, columns: Sequence[str], where: str = "true", **args: object) -> DataFrame:
    """Columns of a Parquet table under a condition with named parameters (``:name``); both reach the scan."""
    return spark.sql(f"SELECT {', '.join(f'`{c}`' for c in columns)} FROM {{t}} WHERE {where}", args=args, t=spark.read.parquet(path))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def latest_period(df: DataFrame, period: str) -> DataFrame:
    """The rows of the last period; the period itself is one row."""
    return df.join(F.broadcast(df.agg(F.max(period).alias(period))), period)


def table_manifest(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, n_rows, n_keys) of every table, with its rows of distinct keys."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys")) for name, (df, keys) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forbidden_columns(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """The columns whose names match a pattern that predictors may not have."""
    return [c for c in df.columns if any(re.search(p, c) for p in patterns)]


def flatten_pages(spark: SparkSession, path: str, required: Sequence[str], forbidden: Sequence[str] = (), index: bool = False) -> DataFrame:
    """Rows of paged JSON responses {meta: {total, index: {name, createTimestamp}}, data: [{data: {...}}]}, all fields text.

    With ``index``, also the name and the time of the index that served the page. A page that has a field of ``forbidden`` fails the read: the
    fields are read along, and the first row with a value raises an error where it stands, without a pass of its own.
    """
    fields = ",".join(f"`{f}`:string" for f in [*required, *forbidden])
    schema = StructType.fromDDL(f"meta struct<total:long,index:struct<name:string,createTimestamp:string>>, data array<struct<data:struct<{fields}>>>")
    x = spark.read.schema(schema).option("multiLine", True).json(path).select("meta", F.explode("data.data").alias("d"))
    marks = [F.col("meta.index.name").alias("index_name"), F.col("meta.index.createTimestamp").alias("index_created")] if index else []
    if forbidden:
        there = F.array_compact(F.array(*[F.when(F.col("d")[f].isNotNull(), F.lit(f)) for f in forbidden]))
        x = x.withColumn("d", F.when(F.size(there) == 0, F.col("d")).otherwise(F.raise_error(F.concat(F.lit("forbidden fields: "), F.array_join(there, ", ")))))
    return x.select(F.col("meta.total").alias("total"), *marks, *[F.col("d")[f].alias(f) for f in required])


def stamp_lineage(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def write_presentation(df: DataFrame, path: str, sort: Sequence[str]) -> None:
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str, sort: Sequence[str]) -> None:
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
