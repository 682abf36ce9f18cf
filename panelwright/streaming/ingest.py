"""Resumable ingest of landed files, one partition per period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_periods(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: StructType, period: Column, keys: list[str]) -> DataFrame:
    """Reads all files that the checkpoint hasn't seen and appends them to ``out`` by period; a rerun adds nothing.

    Rows already in the target, and repeats within a batch, are left out by key, so a period whose files arrive in
    several batches, or a batch that runs twice, stays whole and without repeats. Only the target's partitions of the batch's own
    periods are read for that: their number is what a batch brings, whatever the target's size.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("period", period).dropDuplicates(keys)
        # an empty target of the same columns and partitions is written first, so there is always one to read
        rows.limit(0).write.mode("append").partitionBy("period").parquet(out)
        held = batch.sparkSession.read.schema(rows.schema).parquet(out)
        touched = [r[0] for r in rows.select("period").distinct().collect()]
        held = held.where(F.col("period").isin(touched)).select(*keys)
        rows.join(held, keys, "left_anti").write.mode("append").partitionBy("period").parquet(out)

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
