"""Publishing of built tables: written aside, checked by blocking controls, then made current in one step.

A target holds versions, each a folder of its own, and a manifest table with one row for each attempt. Readers take the version of
the manifest's last published row, so the step that makes a build current is the append of one row: a build that fails
its controls, or a job that dies before that append, leaves readers with the table they had.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED, REFUSED, UNCHANGED = "PUBLISHED", "REFUSED", "UNCHANGED"
_MANIFEST = "seq long, version string, status string, n_rows long, fingerprint long, failed array<string>, at timestamp"


@dataclass(frozen=True)
class Control:
    """An aggregate over a build, a column or SQL text, and the number it has to equal; a blocking one stops the build."""

    name: str
    observed: Column | str
    expected: Column | int = 0
    blocking: bool = True


class PublishRefused(Exception):
    """A blocking control failed; ``verdicts`` has (control, expected, observed, blocking, status) of all."""

    def __init__(self, verdicts: Sequence):
        super().__init__("; ".join(f"{v.control}: expected {v.expected}, observed {v.observed}" for v in verdicts if v.status == "FAIL" and v.blocking))
        self.verdicts = verdicts


def check_controls(build: DataFrame, controls: Sequence[Control]) -> DataFrame:
    """(control, expected, observed, blocking, status) of all controls, in one pass over the build."""
    found = build.agg(*[(F.expr(c.observed) if isinstance(c.observed, str) else c.observed).cast("long").alias(f"o{i}") for i, c in enumerate(controls)])
    each = F.array(*[F.struct(F.lit(c.name).alias("control"), (c.expected if isinstance(c.expected, Column) else F.lit(c.expected)).cast("long").alias("expected"), F.col(f"o{i}").alias("observed"), F.lit(c.blocking).alias("blocking")) for i, c in enumerate(controls)])
    return found.select(F.inline(each)).withColumn("status", F.when(F.col("observed").eqNullSafe(F.col("expected")), "PASS").otherwise("FAIL"))


def gate_verdict(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_controls, n_failed, gate): REFUSED where a blocking control fails, PUBLISHED with or without warnings otherwise."""
    fail = F.col("status") == "FAIL"
    x = verdicts.groupBy(*by).agg(F.count("*").alias("n_controls"), F.count_if(fail).alias("n_failed"), F.count_if(fail & F.col("blocking")).alias("n_blocking"))
    gate = F.when(F.col("n_blocking") > 0, REFUSED).when(F.col("n_failed") > 0, f"{PUBLISHED}_WITH_WARNINGS").otherwise(PUBLISHED)
    return x.select(*by, "n_controls", "n_failed", gate.alias("gate"))


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """Every attempt to publish, published or not; empty before the first."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _current(spark: SparkSession, target: str):
    return manifest(spark, target).where(F.col("status") == PUBLISHED).orderBy(F.desc("seq"), F.desc("at"), F.desc("version")).first()


def _record(spark: SparkSession, target: str, version: str, status: str, n_rows: int, fingerprint: int, failed: Sequence[str]) -> None:
    """Appends the attempt's row: one file, which its job's commit makes visible."""
    last = manifest(spark, target).agg(F.max("seq")).first()[0] or 0
    row = spark.createDataFrame([(last + 1, version, status, n_rows, fingerprint, list(failed))], _MANIFEST.rsplit(",", 1)[0])
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{target}/manifest")


def publish_validated(build: DataFrame, controls: Sequence[Control], target: str, partitions: Sequence[str] = ()) -> str:
    """Writes ``build`` aside, checks what was written, and makes it current; the version's name, or PublishRefused.

    A build with the content of the current version (rows and order-free fingerprint) isn't published again: the current
    version's name comes back. Refused and unfinished versions stay aside, out of readers' sight; ``stale_versions`` lists them.
    """
    spark = build.sparkSession
    version = uuid.uuid4().hex
    path = f"{target}/versions/{version}"
    build.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    written = spark.read.schema(build.schema).parquet(path)
    content = F.bit_xor(F.xxhash64(*sorted(build.columns)))
    found = check_controls(written, [*controls, Control("", F.count("*")), Control("", F.coalesce(content, F.lit(0)))]).collect()
    verdicts, n_rows, fingerprint = found[:-2], found[-2].observed, found[-1].observed
    failed = [v.control for v in verdicts if v.status == "FAIL"]
    if any(v.status == "FAIL" and v.blocking for v in verdicts):
        _record(spark, target, version, REFUSED, n_rows, fingerprint, failed)
        raise PublishRefused(verdicts)
    held = _current(spark, target)
    if held is not None and (held.n_rows, held.fingerprint) == (n_rows, fingerprint):
        _record(spark, target, version, UNCHANGED, n_rows, fingerprint, failed)
        return held.version
    _record(spark, target, version, PUBLISHED, n_rows, fingerprint, failed)
    return version


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """The current version."""
    held = _current(spark, target)
    if held is None:
        raise ValueError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/versions/{held.version}")


def stale_versions(spark: SparkSession, target: str) -> DataFrame:
    """(version): recorded versions that no reader takes any more."""
    held = _current(spark, target)
    other = F.lit(True) if held is None else F.col("version") != held.version
    return manifest(spark, target).where(other).select("version").distinct()


def by_name(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` in the order of ``like``'s columns; raises where a column is missing, too many or of another type."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in like.schema}
    lost, extra = sorted(set(want) - set(have)), sorted(set(have) - set(want))
    other = sorted(c for c in want.keys() & have.keys() if have[c] != want[c])
    if lost or extra or other:
        raise ValueError(f"columns differ: missing {lost}, unexpected {extra}, of another type {other}")
    return df.select(*like.columns)


def append_by_name(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Appends rows whose columns may stand in any order."""
    by_name(df, df.sparkSession.read.parquet(path)).write.mode("append").partitionBy(*partitions).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrites the partitions that ``df`` has rows of, and no others; a rerun gives the same table."""
    spark = df.sparkSession
    try:
        df = by_name(df, spark.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
