"""Queries on publishing, ingest validation, reconciliation and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import reconciliation
from panelwright.plans import registry as R
from panelwright.plans.registry import query, table
from panelwright.sources.publish import Control, check_controls, gate_verdict
from panelwright.streaming.validated import NUMBER, PeriodRules, validate_periods

_BUILDS = f"""p AS (SELECT l_suppkey AS entity, {R._PERIOD} AS period, {R.MEASURES['asset']} AS asset FROM lineitem GROUP BY 1, 2),
b AS (SELECT 'clean' AS build, * FROM p UNION ALL SELECT 'broken', * FROM p UNION ALL SELECT 'broken', entity, period, -asset FROM p WHERE entity % 10 = 0 UNION ALL SELECT 'broken', NULL, period, asset FROM p WHERE entity % 25 = 0 UNION ALL SELECT 'odd', entity, period, CASE WHEN entity % 50 = 1 THEN -asset ELSE asset END FROM p)"""
#: control: (observed over a build, expected over the source panel, blocking)
_CONTROLS = {
    "panel_rows": ("count(*)", "count(*)", True), "unique_keys": ("count(DISTINCT entity, period)", "count(*)", True), "entities": ("count(DISTINCT entity)", "count(DISTINCT entity)", True),
    "missing_entity": ("count_if(entity IS NULL)", "0", True), "missing_period": ("count_if(period IS NULL)", "0", True), "not_a_quarter_end": ("count_if(date_format(period, 'MMdd') NOT IN ('0331', '0630', '0930', '1231'))", "0", True),
    "negative_asset": ("count_if(asset < 0)", "0", False), "missing_asset": ("count_if(asset IS NULL)", "0", False),
}
_DUCK = {"count(DISTINCT entity, period)": "count(DISTINCT CASE WHEN entity IS NOT NULL AND period IS NOT NULL THEN (entity, period) END)"}


def _duck(e: str) -> str:
    return _DUCK.get(e, e).replace("date_format(period, 'MMdd')", "strftime(period, '%m%d')")


_VERDICTS_SQL = f"WITH {_BUILDS}, v AS (" + " UNION ALL ".join(f"SELECT build, '{n}' AS control, CAST((SELECT max(n) FROM (SELECT {_duck(e)} AS n FROM p)) AS BIGINT) AS expected, CAST({_duck(o)} AS BIGINT) AS observed, {str(k).upper()} AS blocking FROM b GROUP BY 1" for n, (o, e, k) in _CONTROLS.items()) + "), r AS (SELECT *, CASE WHEN expected = observed THEN 'PASS' ELSE 'FAIL' END AS status FROM v)"


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """A clean build of the panel, one with repeated and unnamed rows, and one with odd values only, each through the gate's controls."""
    p = R.filings(s, d).select("entity", "period", "asset")
    n = p.agg(*[F.expr(e).alias(c) for c, (_, e, _) in _CONTROLS.items()]).first()
    controls = [Control(c, o, int(n[c]), blocking) for c, (o, _, blocking) in _CONTROLS.items()]
    nobody = F.lit(None).cast("bigint").alias("entity")
    broken = p.unionByName(p.where("entity % 10 = 0").withColumn("asset", -F.col("asset"))).unionByName(p.where("entity % 25 = 0").select(nobody, "period", "asset"))
    odd = p.withColumn("asset", F.when(F.col("entity") % 50 == 1, -F.col("asset")).otherwise(F.col("asset")))
    out = None
    for name, build in (("clean", p), ("broken", broken), ("odd", odd)):
        part = check_controls(build, controls).withColumn("build", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_VERDICTS_SQL} SELECT * FROM r")
def publish_controls(s: SparkSession, d: str) -> DataFrame:
    return _verdicts(s, d)


@query(f"{_VERDICTS_SQL} SELECT build, count(*) AS n_controls, count(*) FILTER (WHERE status = 'FAIL') AS n_failed, CASE WHEN count(*) FILTER (WHERE status = 'FAIL' AND blocking) > 0 THEN 'REFUSED' WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'PUBLISHED_WITH_WARNINGS' ELSE 'PUBLISHED' END AS gate FROM r GROUP BY 1")
def publish_gate(s: SparkSession, d: str) -> DataFrame:
    return gate_verdict(_verdicts(s, d), ["build"])


#: The panel of parts as landed text, with flaws that follow from a row's own numbers.
_SPOT = "(entity * 31 + year(period) * 4 + quarter(period))"
_LANDED = {
    "period": "{day}",
    "entity": f"CASE WHEN {_SPOT} % 5003 = 5 THEN concat('x', CAST(entity AS STRING)) WHEN {_SPOT} % 6007 = 11 THEN ' ' ELSE CAST(entity AS STRING) END",
    "date": f"CASE WHEN {_SPOT} % 7001 = 3 THEN 'n/a' WHEN {_SPOT} % 8009 = 17 THEN '1999-01-01' ELSE {{day}} END",
    "second": f"CASE WHEN {_SPOT} % 401 = 0 THEN 'None' ELSE CAST(second AS STRING) END",
    "amount": f"CASE WHEN {_SPOT} % 4001 = 7 THEN '12x' WHEN {_SPOT} % 101 = 1 THEN 'NA' ELSE CAST(CAST(amount AS BIGINT) AS STRING) END",
    "note": "CASE WHEN year(period) = 1996 THEN '' ELSE 'filed' END",
}
_TIMES = f"CASE WHEN {_SPOT} % 9001 = 13 THEN 2 ELSE 1 END"
_LANDED_DUCK = {k: v.format(day="strftime(period, '%Y-%m-%d')").replace("STRING", "VARCHAR") for k, v in _LANDED.items()}
_GONE = "(coalesce(lower(trim({0})), '') IN ('', 'null', 'none', 'na', 'n/a'))"
_PERIOD_SQL = f"""WITH p AS (SELECT l_partkey AS entity, {R._PERIOD} AS period, min(l_suppkey) AS second, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, unnest(range({_TIMES})) AS time FROM p), t AS (SELECT {', '.join(f'{e} AS "{n}"' for n, e in _LANDED_DUCK.items())} FROM w),
c AS (SELECT period, count(*) AS n_rows, count(DISTINCT CASE WHEN NOT {_GONE.format('entity')} THEN entity END) AS n_entities, count(DISTINCT CASE WHEN NOT {_GONE.format('second')} THEN second END) AS n_second,
 count(*) FILTER (WHERE NOT {_GONE.format('entity')} AND NOT {_GONE.format('date')}) - count(DISTINCT CASE WHEN NOT {_GONE.format('entity')} AND NOT {_GONE.format('date')} THEN (entity, date) END) AS n_repeated,
 count(*) FILTER (WHERE {_GONE.format('entity')}) AS missing_entity, count(*) FILTER (WHERE NOT {_GONE.format('entity')} AND NOT regexp_full_match(trim(entity), '\\d+')) AS bad_entity, count(*) FILTER (WHERE {_GONE.format('second')}) AS missing_second,
 count(*) FILTER (WHERE {_GONE.format('date')}) AS missing_date, count(*) FILTER (WHERE NOT {_GONE.format('date')} AND date <> period) AS wrong_date, count(*) FILTER (WHERE NOT {_GONE.format('amount')} AND NOT regexp_matches(trim(amount), '{NUMBER}')) AS bad_numbers,
 concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (WHERE NOT {_GONE.format(f)}) = 0 THEN '{f}' END" for f in ('entity', 'amount', 'note'))}) AS all_null FROM t GROUP BY 1),
v AS (SELECT *, concat_ws(',', CASE WHEN all_null <> '' THEN 'ALL_NULL_FIELD' END, CASE WHEN bad_entity > 0 THEN 'BAD_ENTITY' END, CASE WHEN wrong_date > 0 THEN 'WRONG_DATE' END, CASE WHEN bad_numbers > 0 THEN 'BAD_NUMBER' END, CASE WHEN n_repeated > 0 THEN 'REPEATED_KEY' END, CASE WHEN missing_entity > 0 THEN 'MISSING_ENTITY' END, CASE WHEN missing_date > 0 THEN 'MISSING_DATE' END) AS problems FROM c)
SELECT *, CASE WHEN problems <> '' THEN 'FAIL' WHEN missing_second > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM v"""
PERIOD_RULES = PeriodRules("entity", "date", "second", ("entity", "amount", "note"), ("amount",))


@query(_PERIOD_SQL)
def period_validation(s: SparkSession, d: str) -> DataFrame:
    """Every check of the landed panel's periods, as ``ingest_validated`` makes them for a batch."""
    p = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), C.quarter_end(F.col("l_shipdate")).alias("period")).agg(F.min("l_suppkey").alias("second"), F.sum("l_quantity").alias("amount"))
    landed = p.withColumn("time", F.explode(F.expr(f"sequence(1, {_TIMES})"))).select(*[F.expr(e.format(day="date_format(period, 'yyyy-MM-dd')")).alias(n) for n, e in _LANDED.items()])
    return validate_periods(landed, "period", PERIOD_RULES)


#: field: (from the lines, from the orders, tolerance)
_FIELDS = {
    "total": (f"CAST(sum({R._P}) AS DOUBLE)", "round(o_totalprice, 0)", 0.25), "status": ("CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END", "o_orderstatus", None),
    "year": ("year(min(l_shipdate))", "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE year(o_orderdate) END", 0.0), "first_day": ("CAST(min(l_shipdate) AS DATE)", "CAST(o_orderdate AS DATE)", None),
}


def _compared_sql() -> str:
    both = f"l AS (SELECT l_orderkey AS k, {', '.join(f'{e} AS {n}' for n, (e, _, _) in _FIELDS.items())} FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, {', '.join(f'{e} AS {n}' for n, (_, e, _) in _FIELDS.items())} FROM orders WHERE o_orderkey % 40 <> 7)"
    parts = []
    for n, (_, _, t) in _FIELDS.items():
        close = "" if t is None else f"WHEN abs(o.{n} - l.{n}) <= {t} * greatest(abs(l.{n}), abs(o.{n}), 1.0) THEN 'WITHIN_TOLERANCE' "
        difference = "CAST(NULL AS DOUBLE)" if t is None else f"CAST(o.{n} - l.{n} AS DOUBLE)"
        parts.append(f"SELECT coalesce(l.k, o.k) AS k, '{n}' AS field, CASE WHEN o.k IS NULL THEN 'KEY_ONLY_LEFT' WHEN l.k IS NULL THEN 'KEY_ONLY_RIGHT' WHEN l.{n} IS NULL AND o.{n} IS NULL THEN 'BOTH_NULL' WHEN l.{n} IS NULL THEN 'NULL_LEFT' WHEN o.{n} IS NULL THEN 'NULL_RIGHT' WHEN l.{n} = o.{n} THEN 'EXACT' {close}ELSE 'DIFFERENT' END AS agreement, {difference} AS difference FROM l FULL JOIN o ON l.k = o.k")
    return f"WITH {both}, x AS ({' UNION ALL '.join(parts)})"


def _compared(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*[F.expr(e).alias(n) for n, (e, _, _) in _FIELDS.items()])
    orders = table(s, d, "orders").where("o_orderkey % 40 <> 7").select(F.col("o_orderkey").alias("k"), *[F.expr(e).alias(n) for n, (_, e, _) in _FIELDS.items()])
    return reconciliation.reconcile_fields(lines, orders, ["k"], {n: t for n, (_, _, t) in _FIELDS.items()})


@query(f"{_compared_sql()} SELECT * FROM x")
def reconcile_fields(s: SparkSession, d: str) -> DataFrame:
    """Orders against what their lines say, field by field; every 40th order is withheld, so keys miss on one side too."""
    return _compared(s, d)


@query(f"{_compared_sql()} SELECT field, count(*) AS n_keys, count(*) FILTER (WHERE agreement IN ('EXACT', 'WITHIN_TOLERANCE', 'BOTH_NULL')) AS agreed, count(*) FILTER (WHERE agreement = 'DIFFERENT') AS different, count(*) FILTER (WHERE agreement LIKE 'KEY_ONLY%' OR agreement IN ('NULL_LEFT', 'NULL_RIGHT')) AS one_sided, max(abs(difference)) AS largest_difference, round(100.0 * count(*) FILTER (WHERE agreement IN ('EXACT', 'WITHIN_TOLERANCE', 'BOTH_NULL')) / count(*), 6) AS agreed_pct FROM x GROUP BY 1")
def reconciliation_summary(s: SparkSession, d: str) -> DataFrame:
    return reconciliation.agreement_summary(_compared(s, d))


#: source: (table, texts of the staged columns, rule that a staged row fails by)
_STAGED = {
    "lines": ("lineitem", {"id": "CAST(l_partkey AS STRING)", "day": "substr(CAST(l_shipdate AS STRING), 1, 10)"}), "orders": ("orders", {"id": "CASE WHEN o_orderkey % 500 = 3 THEN ' ' ELSE CAST(o_custkey AS STRING) END", "day": "substr(CAST(o_orderdate AS STRING), 1, 10)"}),
    "events": ("events", {"id": "CAST(user_id AS STRING)", "day": "CASE WHEN event_id % 300 = 1 THEN '31/12/9999' ELSE substr(CAST(ts AS STRING), 1, 10) END"}),
}
_STAGED_SQL = "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t})".replace("STRING", "VARCHAR") for n, (t, cols) in _STAGED.items())
_FAILED_SQL = "try_cast(nullif(trim(id), '') AS BIGINT) IS NULL OR try_strptime(day, '%Y-%m-%d') IS NULL"


def _status_sql(before: str, after: str, failed: str, documented: bool) -> str:
    noted = f" WHEN {before} = {after} THEN 'PASS_WITH_DOCUMENTED_PARSE_EXCEPTIONS'" if documented else ""
    return f"CASE WHEN {before} = {after} AND {failed} = 0 THEN 'PASS'{noted} ELSE 'FAIL' END"


def _typed(s: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each source's raw text rows and its staged rows, typed, with the parse's status."""
    out = {}
    for name, (source, cols) in _STAGED.items():
        raw = table(s, d, source).select(*[F.expr(e).alias(c) for c, e in cols.items()])
        number, day = C.safe_long(F.col("id")), C.safe_date(F.col("day"), ["yyyy-MM-dd"])
        out[name] = raw, raw.select(number.alias("id"), day.alias("day"), C.first_rule([(number.isNull(), "MISSING_ID"), (day.isNull(), "BAD_DATE")]).alias("parse_status"))
    return out


@query(f"{_STAGED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS rows_before, count(*) AS rows_after, CAST(0 AS BIGINT) AS difference, count(*) FILTER (WHERE {_FAILED_SQL}) AS parse_failures, {_status_sql('count(*)', 'count(*)', f'count(*) FILTER (WHERE {_FAILED_SQL})', n == 'events')} AS status FROM {n}" for n in _STAGED))
def source_to_staging(s: SparkSession, d: str) -> DataFrame:
    """Rows and failed parses of each source's staged table; those of the events are documented."""
    return reconciliation.stage_counts({n: (raw, typed, F.col("parse_status") != "VALID") for n, (raw, typed) in _typed(s, d).items()}, ["events"])


_CORE = {"lines": "id IS NOT NULL", "orders": "id IS NOT NULL", "events": "TRUE"}


@query(f"{_STAGED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS rows_before, count(*) FILTER (WHERE {k}) AS rows_after, count(*) FILTER (WHERE {k}) - count(*) AS difference, count(*) FILTER (WHERE ({k}) AND d IS NULL) AS parse_failures, {_status_sql('count(*)', f'count(*) FILTER (WHERE {k})', f'count(*) FILTER (WHERE ({k}) AND d IS NULL)', n == 'events')} AS status FROM (SELECT try_cast(nullif(trim(id), '') AS BIGINT) AS id, try_strptime(day, '%Y-%m-%d') AS d FROM {n})" for n, k in _CORE.items()))
def staging_to_core(s: SparkSession, d: str) -> DataFrame:
    """Staged rows against core rows: rows without an id don't get there, undated ones do."""
    return reconciliation.stage_counts({n: (typed, typed.where(_CORE[n]), F.col("day").isNull()) for n, (_, typed) in _typed(s, d).items()}, ["events"])


_PROFILED = {"o_custkey": "CAST(o_custkey AS STRING)", "status": "CASE WHEN o_orderkey % 9 = 0 THEN ' N/A ' ELSE o_orderstatus END", "day": "substr(CAST(o_orderdate AS STRING), 1, 10)", "priority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END", "paid": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE substr(CAST(o_orderdate + INTERVAL 30 DAYS AS STRING), 1, 10) END"}
_CELL = "SELECT '{0}' AS column, count(*) FILTER (WHERE " + _GONE.format('"{0}"') + ") AS missing, count(try_strptime(\"{0}\", '%Y-%m-%d')) AS n_dates, CAST(min(try_strptime(\"{0}\", '%Y-%m-%d')) AS DATE) AS first_date, CAST(max(try_strptime(\"{0}\", '%Y-%m-%d')) AS DATE) AS last_date FROM t"


@query(f"WITH t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PROFILED.items())} FROM orders), ".replace("STRING", "VARCHAR").replace("30 DAYS", "30 DAY") + "c AS (" + " UNION ALL ".join(_CELL.format(n) for n in _PROFILED) + f"), n AS (SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, day FROM t)) AS duplicate_keys FROM t) SELECT c.*, n.*, CAST({len(_PROFILED)} AS BIGINT) AS n_columns FROM c, n")
def column_profile(s: SparkSession, d: str) -> DataFrame:
    return reconciliation.column_profile(table(s, d, "orders").select(*[F.expr(e).alias(n) for n, e in _PROFILED.items()]), ["o_custkey", "day"])
