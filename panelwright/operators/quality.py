"""Declarative data-quality controls, key checks and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import exception_id


def rule_exceptions(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """(keys, control_id, severity, category, exception_id): a row per rule that a row of ``df`` breaks, in one scan."""
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("control_id"), F.lit(s).alias("severity"), F.lit(k).alias("category"))) for i, s, k, c in rules]))
    out = df.select(*keys, F.explode(broken).alias("r")).select(*keys, "r.*")
    return out.withColumn("exception_id", exception_id(F.col("control_id"), *[F.col(k) for k in keys]))


def control_results(inventory: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Every control with its exception count: FAIL if blocking ones exist, PASS_WITH_EXCEPTIONS, or PASS."""
    n = exceptions.groupBy("control_id").agg(F.count("*").alias("n"))
    out = inventory.join(n, "control_id", "left").withColumn("n_exceptions", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n_exceptions") == 0, "PASS").when(F.col("severity") == "BLOCKING", "FAIL").otherwise("PASS_WITH_EXCEPTIONS")
    return out.select("control_id", "severity", "n_exceptions", status.alias("status"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides, matched, unmatched and the matched share."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    both = x.join(y, key, "full_outer").agg(F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"))
    return both.withColumns({"unmatched_left": F.col("left_keys") - F.col("matched"), "matched_pct": F.when(F.col("left_keys") > 0, 100.0 * F.col("matched") / F.col("left_keys"))})


def reconcile(a: DataFrame, b: DataFrame, key: str, left: str, right: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, both values, agreement) of a full outer join: EXACT, WITHIN_TOLERANCE, DIFFERENT or one side missing."""
    j = a.select(key, left).join(b.select(key, right), key, "full_outer")
    x, y = F.col(left), F.col(right)
    close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    kind = F.when(x.isNull(), "MISSING_LEFT").when(y.isNull(), "MISSING_RIGHT").when(x == y, "EXACT").when(close, "WITHIN_TOLERANCE").otherwise("DIFFERENT")
    return j.withColumn("agreement", kind)


def overlapping_mappings(df: DataFrame, identity: str, alias: str, period: str) -> DataFrame:
    """Pairs of identities whose spans under one alias intersect: spans first, then a range join of those."""
    span = df.groupBy(alias, identity).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    a, b = span.alias("a"), span.alias("b")
    hit = (F.col(f"a.{alias}") == F.col(f"b.{alias}")) & (F.col(f"a.{identity}") < F.col(f"b.{identity}")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    return a.join(b, hit).select(F.col(f"a.{alias}").alias(alias), F.col(f"a.{identity}").alias("identity_a"), F.col(f"b.{identity}").alias("identity_b"))


def table_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, columns, missing cells and duplicate keys of a table, in one aggregate."""
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), (F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicate_keys")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A content fingerprint that doesn't depend on row order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"))


def text_digest(columns: Sequence[str]) -> Column:
    """A number below 2^32 from a row's columns as text; nulls differ from empty texts. Its sum over rows doesn't depend on their order."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 8), 16, 10).cast("long")


def panel_audit(panel: DataFrame, keys: Sequence[str], period: str, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, n_rows, n_repeated, digest, status): each period's rows, repeated keys and content, against the expected periods.

    status: MISSING (expected, no rows), UNEXPECTED, REPEATED_KEYS or PASS. Keys are counted before periods, so no task holds the rows of one.
    A row without a period is one more, unexpected period.
    """
    per_key = panel.groupBy(period, *[k for k in keys if k != period]).agg(F.count("*").alias("n"), F.sum(text_digest(columns)).alias("d"))
    per = per_key.groupBy(F.col(period).alias("_p")).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeated"), F.sum("d").alias("digest"))
    want = expected.select(F.col(period).alias("_w")).distinct()
    x = per.join(want, F.col("_p").eqNullSafe(F.col("_w")), "full")  # a row for each period
    status = F.when(F.col("n_rows").isNull(), "MISSING").when(F.col("_w").isNull(), "UNEXPECTED").when(F.col("n_repeated") > 0, "REPEATED_KEYS").otherwise("PASS")
    return x.select(F.coalesce("_p", "_w").alias(period), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_repeated", "digest")], status.alias("status"))


def mapping_counts(df: DataFrame, alias: str, identity: str, period: str) -> DataFrame:
    """(several, overlapping, sequential): second ids with several entities, those whose spans meet, and those whose spans don't.

    Spans are put in order; one meets an earlier one where it begins by the greatest end so far. No pair is made.
    """
    span = df.where(F.col(alias).isNotNull()).groupBy(alias, identity).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    past = Window.partitionBy(alias).orderBy("first", identity).rowsBetween(Window.unboundedPreceding, -1)
    x = span.withColumn("meets", F.coalesce(F.col("first") <= F.max("last").over(past), F.lit(False)))
    per = x.groupBy(alias).agg((F.count("*") > 1).alias("several"), F.bool_or("meets").alias("overlapping"))
    return per.agg(F.count_if("several").alias("several"), F.count_if("overlapping").alias("overlapping"), F.count_if(F.col("several") & ~F.col("overlapping")).alias("sequential"))


def sequential_identities(df: DataFrame, alias: str, identity: str, period: str) -> DataFrame:
    """(identity): the entities that have a second id whose entities' spans don't meet, or one of a single entity; rows without either name nobody.

    Lines are dealt by second id once, for the spans, their order and what is kept; no sequence is made.
    """
    span = df.where(F.col(alias).isNotNull() & F.col(identity).isNotNull()).repartition(alias).groupBy(alias, identity).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    own = Window.partitionBy(alias)
    x = span.withColumn("meets", F.coalesce(F.col("first") <= F.max("last").over(own.orderBy("first", identity).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return x.withColumn("any", F.bool_or("meets").over(own)).where(~F.col("any")).select(identity).distinct()


def mapping_exceptions(df: DataFrame, alias: str, identity: str, period: str) -> DataFrame:
    """(alias, kind, n_identities, sequence): second ids with several entities, CONCURRENT where spans meet and SEQUENTIAL where none do; their entities in order of appearance.

    The order is kept in one array for each second id: as long as its entities are many.
    """
    span = df.where(F.col(alias).isNotNull()).groupBy(alias, identity).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    past = Window.partitionBy(alias).orderBy("first", identity).rowsBetween(Window.unboundedPreceding, -1)
    x = span.withColumn("meets", F.coalesce(F.col("first") <= F.max("last").over(past), F.lit(False)))
    per = x.groupBy(alias).agg(F.bool_or("meets").alias("m"), F.count("*").alias("n_identities"), F.array_sort(F.collect_list(F.struct("first", F.col(identity).cast("string").alias("i")))).alias("a")).where("n_identities > 1")
    return per.select(alias, F.when(F.col("m"), "CONCURRENT").otherwise("SEQUENTIAL").alias("kind"), "n_identities", F.array_join(F.transform("a", lambda r: r["i"]), " > ").alias("sequence"))
