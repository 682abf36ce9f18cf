"""Shared scratch storage, bounded worker memory and joins on hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NO_KEY = -(1 << 63)  # stands for a null key where keys travel as packed longs


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken, which only a local master can share with its tasks; a cluster
    without the setting is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(rows: DataFrame, facts: DataFrame, on: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``on`` and in ``count`` how many rows carry it.

    Keys with a quarter of a partition's share of the rows or more are joined where the rows lie: there are at most 4
    of them to a shuffle partition, so their facts are broadcast. The others meet in a sort-merge join. Both tables are
    read twice and should be stored.
    """
    few = 4 * shuffle_partitions(rows.sparkSession)
    hot = facts.where((F.col(count) * few >= rows.count()) & (F.col(count) >= 64)).drop(count)
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return met.unionByName(rest.join(facts.drop(count).hint("merge"), on, how))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives its freed memory back to the system at its end: Python workers outlive their tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return held


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
