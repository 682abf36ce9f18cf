"""Ingest that validates each period inside its micro-batch: whole periods go in once, the others into quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.functions.columns import is_missing

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class PeriodRules:
    """What all rows of a period have to meet; every column is text.

    ``entity`` is required and a whole number, ``date`` is required and the period's own, ``second`` may be missing (a warning),
    ``required`` fields have a value somewhere in the period, ``numeric`` ones are numbers or missing.
    """

    entity: str
    date: str
    second: str
    required: Sequence[str]
    numeric: Sequence[str]


def validate_periods(rows: DataFrame, period: str, rules: PeriodRules) -> DataFrame:
    """A row for each period: its counts, problems and status (FAIL, PASS_WITH_WARNINGS, PASS), in one grouping.

    ``period`` holds the date text that the rows of a period should have. A row counts as repeated for each other row with its
    entity and date.
    """
    e, t, s = F.col(rules.entity), F.col(rules.date), F.col(rules.second)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    whole = ~is_missing(e)
    bad_number = sum(((~is_missing(F.col(c)) & ~F.trim(F.col(c)).rlike(NUMBER)).cast("long") for c in rules.numeric), F.lit(0).cast("long"))
    both = whole & ~is_missing(t)
    x = rows.groupBy(period).agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.when(whole, e)).alias("n_entities"), F.count_distinct(F.when(~is_missing(s), s)).alias("n_second"),
        (n(both) - F.count_distinct(F.when(both, F.struct(e, t)))).alias("n_repeated"),
        n(is_missing(e)).alias("missing_entity"), n(whole & ~F.trim(e).rlike(r"^\d+$")).alias("bad_entity"), n(is_missing(s)).alias("missing_second"),
        n(is_missing(t)).alias("missing_date"), n(~is_missing(t) & (t != F.col(period))).alias("wrong_date"), F.coalesce(F.sum(bad_number), F.lit(0)).alias("bad_numbers"),
        F.array_compact(F.array(*[F.when(n(~is_missing(F.col(c))) == 0, F.lit(c)) for c in rules.required])).alias("all_null"),
    )
    tests = [(F.size("all_null") > 0, "ALL_NULL_FIELD"), (F.col("bad_entity") > 0, "BAD_ENTITY"), (F.col("wrong_date") > 0, "WRONG_DATE"), (F.col("bad_numbers") > 0, "BAD_NUMBER"), (F.col("n_repeated") > 0, "REPEATED_KEY"), (F.col("missing_entity") > 0, "MISSING_ENTITY"), (F.col("missing_date") > 0, "MISSING_DATE")]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in tests]))
    status = F.when(F.size("problems") > 0, "FAIL").when(F.col("missing_second") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return x.withColumn("problems", problems).withColumn("status", status).withColumns({"all_null": F.array_join("all_null", ","), "problems": F.array_join("problems", ",")})


_MARKS = "period string, configuration string, status string, problems string, n_rows long, batch long"


def completed_periods(spark: SparkSession, out: str) -> DataFrame:
    """(period, configuration, status, problems, n_rows, batch): a row for each period of each batch; those that pass are complete."""
    try:
        return spark.read.schema(_MARKS).parquet(f"{out}/marks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MARKS)


def ingest_validated(spark: SparkSession, landing: str, out: str, schema: StructType, period: Column, rules: PeriodRules, configuration: str) -> DataFrame:
    """Reads the files that no run has seen; the panel at ``out``/panel, with one partition for each completed period.

    Each period of a batch is validated as a whole in one grouping. One that passes is written once and marked as completed; one that fails
    goes to ``out``/quarantine with its problems. Rows of a period that an earlier batch completed under the same ``configuration`` are
    repeats where the panel has them and late ones (LATE_ROWS, quarantined) where it hasn't; under another configuration the period
    is written anew. Panel partitions and the batch's quarantine and marks are overwritten, marks last, so a batch that dies
    and runs again leaves what one run would. A batch is read once: it is kept while its parts are written.
    """

    def put(rows: DataFrame, path: str, by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.withColumn("period", F.coalesce(period, F.lit("unknown"))).persist()
        try:
            verdicts = validate_periods(rows, "period", rules).select("period", "status", "problems", "n_rows")
            verdicts = {r.period: r for r in verdicts.collect()}  # a row for each period of the batch
            done = completed_periods(own, out).where((F.col("configuration") == configuration) & F.col("status").startswith("PASS") & (F.col("batch") < number))
            done = {r[0] for r in done.where(F.col("period").isin(list(verdicts))).select("period").distinct().collect()}
            good = [p for p, v in verdicts.items() if v.status != "FAIL" and p not in done]
            if good:
                put(rows.where(F.col("period").isin(good)), f"{out}/panel", "period")
            kept = [(p, configuration, v.status, v.problems, v.n_rows, number) for p, v in verdicts.items() if p not in done]
            aside = rows.where(F.col("period").isin([p for p, v in verdicts.items() if v.status == "FAIL" and p not in done]))
            aside = aside.join(F.broadcast(own.createDataFrame([(p, v.problems) for p, v in verdicts.items()], "period string, problems string")), "period")
            if done:
                keys = [rules.entity, rules.date]
                held = own.read.parquet(f"{out}/panel").where(F.col("period").isin(list(done))).select("period", *keys)
                again = rows.where(F.col("period").isin(list(done)))
                late = again.join(held.withColumn("period", F.col("period").cast("string")), ["period", *keys], "left_anti").withColumn("problems", F.lit("LATE_ROWS"))
                aside = aside.unionByName(late)
                n_late = {r.period: r.n for r in late.groupBy("period").agg(F.count("*").alias("n")).collect()}
                kept += [(p, configuration, "FAIL" if n_late.get(p) else "REPEATED", "LATE_ROWS" if n_late.get(p) else "", verdicts[p].n_rows, number) for p in done]
            put(aside.withColumn("batch", F.lit(number)), f"{out}/quarantine", "batch")
            put(own.createDataFrame(kept, _MARKS), f"{out}/marks", "batch")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return completed_periods(spark, out)
