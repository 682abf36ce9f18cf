"""Queries on event classes, references, label exceptions and the remaining controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import distress as D
from panelwright.operators import events, features, references
from panelwright.operators.references import EventClass
from panelwright.plans import controls, presentation, reports
from panelwright.plans import registry as R
from panelwright.plans.registry import query, table
from panelwright.sources.files import forbidden_columns

_KEYS = ["entity", "period"]
_CLASSES = (
    EventClass("FAILURE", ("1", "2", "3"), ("error",)), EventClass("ASSISTANCE", ("10", "11")), EventClass("MERGER", ("20", "21", "22", "23")), EventClass("SALE", (), ("purchase",), "value >= 60"), EventClass("CLOSING", ("90",)),
    EventClass("NEW", (), ("sign",)), EventClass("LARGE", (), (), "value >= 75"), EventClass("VISIT", (), ("view",)), EventClass("ACTIVITY", (), ("click", "purchase")),
)
_CODE_SQL = "json_extract_string(props, '$.k')"


def _class_sql() -> str:
    out = []
    for c in _CLASSES:
        tests = ([f"coalesce({_CODE_SQL} IN ({', '.join(map(repr, c.codes))}), FALSE)"] if c.codes else []) + [f"coalesce(contains(lower(event_type), '{k}'), FALSE)" for k in c.keywords] + ([f"coalesce({c.condition}, FALSE)"] if c.condition else [])
        out.append(f"WHEN {' OR '.join(tests)} THEN '{c.name}'")
    return f"CASE {' '.join(out)} ELSE 'OTHER' END"


_EV = f"cl AS (SELECT *, {_class_sql()} AS class FROM events)"


def _classified(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("class", references.classify(F.get_json_object("props", "$.k"), F.col("event_type"), _CLASSES))


@query(f"WITH {_EV} SELECT class, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_entities, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM cl GROUP BY 1, 2")
def event_classes(s: SparkSession, d: str) -> DataFrame:
    """Nine classes of events by code, keyword or condition, the first that fits."""
    day = F.col("ts").cast("date")
    return _classified(s, d).groupBy("class", "event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_entities"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(f"WITH {_EV}, u AS (SELECT cl.*, c_custkey IS NOT NULL AND user_id % 3 <> 0 AS known FROM cl LEFT JOIN customer ON c_custkey = user_id) SELECT class, count(*) AS n_events, count(*) FILTER (WHERE NOT known) AS n_unresolved, round(100.0 * count(*) FILTER (WHERE NOT known) / count(*), 6) AS unresolved_pct FROM u GROUP BY 1")
def unresolved_events_by_class(s: SparkSession, d: str) -> DataFrame:
    """Events of each class whose entity isn't in the dimension (every third customer is withheld)."""
    known = table(s, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.lit(True).alias("known"))
    x = _classified(s, d).join(known, F.col("user_id") == F.col("c_custkey"), "left").withColumn("known", F.coalesce("known", F.lit(False)))
    lost = F.count_if(~F.col("known"))
    return x.groupBy("class").agg(F.count("*").alias("n_events"), lost.alias("n_unresolved"), F.round(100.0 * lost / F.count("*"), 6).alias("unresolved_pct"))


_ROLES = {"payer": "CASE WHEN o_orderkey % 7 = 1 THEN o_custkey END", "agent": "CASE WHEN o_orderkey % 5 = 2 THEN o_custkey + 100000 END", "holder": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END", "parent": "CASE WHEN o_orderstatus = 'P' THEN o_custkey % 100 END", "guarantor": "CASE WHEN o_totalprice > 200000 THEN o_custkey END"}


@query(f"WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, {', '.join(f'{e} AS {n}' for n, e in _ROLES.items())} FROM orders) SELECT coalesce(CASE {' '.join(f'WHEN {n} IS NOT NULL THEN {chr(39)}{n}{chr(39)}' for n in _ROLES)} END, 'none') AS role, count(*) AS n_rows, count(DISTINCT coalesce({', '.join(_ROLES)})) AS n_ids, min(coalesce({', '.join(_ROLES)})) AS least_id FROM r GROUP BY 1")
def role_usage(s: SparkSession, d: str) -> DataFrame:
    """Which of five roles an order's id comes from."""
    found, role = references.first_role({n: F.expr(e) for n, e in _ROLES.items()})
    return table(s, d, "orders").select(found.alias("id"), role.alias("role")).groupBy("role").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("least_id"))


_START = "1995-06-30"
_REF_SQL = f"""fr AS (SELECT DISTINCT CASE WHEN l_orderkey % 11 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS entity, CAST(l_shipdate AS DATE) AS closed FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 48 AND l_returnflag = 'R'), pq AS (SELECT DISTINCT l_partkey AS entity, {R._PERIOD} AS period FROM lineitem),
ow AS (SELECT entity, min(period) AS first_period, max(period) AS last_period, count(*) AS n_rows FROM pq GROUP BY 1), re AS (SELECT fr.entity, closed, first_period, last_period, coalesce(n_rows, 0) AS n_rows, CASE WHEN closed < DATE '{_START}' THEN 'BEFORE_START' WHEN first_period IS NULL THEN 'UNRESOLVED' WHEN first_period >= closed THEN 'NO_HISTORY' WHEN last_period > last_day(date_trunc('quarter', closed) + INTERVAL 2 MONTH) THEN 'LATER_PERIODS' ELSE 'RESOLVED' END AS resolution FROM fr LEFT JOIN ow USING (entity))"""


def _failures(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").where("l_discount >= 0.09 and l_quantity >= 48 and l_returnflag = 'R'")
    return lines.select(F.when(F.col("l_orderkey") % 11 == 0, F.col("l_partkey") + 10000000).otherwise(F.col("l_partkey")).alias("entity"), F.col("l_shipdate").cast("date").alias("closed")).distinct()


def _panel(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("entity"), C.quarter_end(F.col("l_shipdate")).alias("period")).distinct()


def _references(s: SparkSession, d: str) -> DataFrame:
    return references.failure_reference(_failures(s, d), _panel(s, d), "entity", "period", "closed", _START)


@query(f"WITH {_REF_SQL} SELECT * FROM re")
def failure_reference(s: SparkSession, d: str) -> DataFrame:
    """Failures against the panel's history; some name entities that the panel hasn't."""
    return _references(s, d)


@query(f"WITH {_REF_SQL} SELECT resolution, CAST(year(closed) AS INTEGER) AS year, count(*) AS n_failures, count(DISTINCT entity) AS n_entities, min(n_rows) AS least_rows FROM re WHERE resolution <> 'RESOLVED' GROUP BY 1, 2")
def unmatched_failure_resolution(s: SparkSession, d: str) -> DataFrame:
    x = _references(s, d).where("resolution <> 'RESOLVED'").groupBy("resolution", F.year("closed").alias("year"))
    return x.agg(F.count("*").alias("n_failures"), F.count_distinct("entity").alias("n_entities"), F.min("n_rows").alias("least_rows"))


@query(f"WITH {_REF_SQL} SELECT re.entity, closed, period, datediff('day', closed, period) AS days_after, last_period FROM re JOIN pq USING (entity) WHERE resolution = 'LATER_PERIODS' AND period > last_day(date_trunc('quarter', closed) + INTERVAL 2 MONTH)")
def later_quarter_details(s: SparkSession, d: str) -> DataFrame:
    """The periods that an entity has after the quarter of its failure."""
    x = _references(s, d).where("resolution = 'LATER_PERIODS'").select("entity", "closed", "last_period").join(_panel(s, d), "entity")
    return x.where(F.col("period") > C.quarter_end(F.col("closed"))).select("entity", "closed", "period", F.datediff("period", "closed").cast("long").alias("days_after"), "last_period")


_HIST_SQL = f"{_REF_SQL}, hi AS (SELECT l_partkey AS entity, CAST(l_shipdate AS DATE) AS closed, CASE WHEN l_linestatus = 'O' THEN 'MERGER' WHEN l_tax >= 0.06 THEN 'LIQUIDATION' ELSE 'MOVE' END AS kind FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 46), ff AS (SELECT entity, min(closed) AS f FROM fr GROUP BY 1), ot AS (SELECT entity, CASE WHEN f >= closed THEN 'CONFIRMS_FAILURE' ELSE kind END AS kind, closed, 'history' AS source FROM hi LEFT JOIN ff USING (entity) WHERE kind IN ('MERGER', 'LIQUIDATION')), xr AS (SELECT entity, kind, source, min(closed) AS closed, count(*) AS n_records FROM (SELECT entity, 'FAILURE' AS kind, closed, 'failures' AS source FROM fr UNION ALL SELECT entity, kind, closed, source FROM ot) GROUP BY 1, 2, 3)"


def _history(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "O", "MERGER").when(F.col("l_tax") >= 0.06, "LIQUIDATION").otherwise("MOVE")
    return table(s, d, "lineitem").where("l_discount >= 0.09 and l_quantity >= 46").select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").cast("date").alias("closed"), kind.alias("kind"))


def _exits(s: SparkSession, d: str) -> DataFrame:
    return references.exit_reference(_failures(s, d), _history(s, d), "entity", "closed", "kind", ["MERGER", "LIQUIDATION"])


@query(f"WITH {_HIST_SQL} SELECT * FROM xr")
def exit_reference(s: SparkSession, d: str) -> DataFrame:
    return _exits(s, d)


@query(f"WITH {_HIST_SQL} SELECT kind, source, count(*) AS n_exits, CAST(sum(n_records) AS BIGINT) AS n_records, min(closed) AS first_day, max(closed) AS last_day FROM xr GROUP BY 1, 2")
def history_reconciliation(s: SparkSession, d: str) -> DataFrame:
    """Exits and records of each kind and source."""
    return _exits(s, d).groupBy("kind", "source").agg(F.count("*").alias("n_exits"), F.sum("n_records").alias("n_records"), F.min("closed").alias("first_day"), F.max("closed").alias("last_day"))


_LABELLED = f"{R._LABEL_SQL}, lz AS (SELECT *, {R._label_case(12)} AS status FROM y)"


@query(f"{_LABELLED}, {_REF_SQL}, le AS (SELECT status AS kind, 'Informational' AS severity, entity, period AS day, status AS observed FROM lz WHERE status IN ('RIGHT_CENSORED', 'COMPETING_EXIT') UNION ALL SELECT 'UNMATCHED_FAILURE', CASE WHEN resolution = 'UNRESOLVED' THEN 'Warning' ELSE 'Informational' END, entity, closed, resolution FROM re WHERE resolution <> 'RESOLVED') SELECT *, md5(kind || '|' || entity || '|' || day) AS exception_id FROM le")
def label_exceptions(s: SparkSession, d: str) -> DataFrame:
    return references.label_exceptions(R._labels(s, d, 12), _references(s, d), _KEYS, "entity", "closed")


@query(f"{_LABELLED} SELECT status, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(*) FILTER (WHERE next_date IS NOT NULL) AS with_next, min(period) AS first_period, max(period) AS last_period, round(avg(history), 6) AS mean_history FROM lz GROUP BY 1")
def label_quality_summary(s: SparkSession, d: str) -> DataFrame:
    return R._labels(s, d, 12).groupBy("status").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"), F.count("next_date").alias("with_next"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.round(F.avg("history"), 6).alias("mean_history"))


@query(f"{reports._BOTH_SQL}, {controls._PANEL_SQL}, bz AS (SELECT z.*, {R._BAND_SQL} AS band FROM z JOIN pa ON pa.entity = z.entity AND pa.period = z.period) SELECT horizon, band, count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')) AS eligible, count(*) FILTER (WHERE status = 'POSITIVE') AS positives, CASE WHEN count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')) > 0 THEN round(count(*) FILTER (WHERE status = 'POSITIVE')::DOUBLE / count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')), 9) END AS rate FROM bz GROUP BY 1, 2")
def label_prevalence_by_band(s: SparkSession, d: str) -> DataFrame:
    """Eligible and positive rows of each horizon and size band."""
    bands = R.filings(s, d, "l_partkey").select(*_KEYS, C.band(F.col("asset"), *R._PEER_BANDS).alias("band"))
    x = reports._both(s, d).join(bands, _KEYS).groupBy("horizon", "band").agg(F.count("label").alias("eligible"), F.count_if(F.col("label") == 1).alias("positives"))
    return x.withColumn("rate", F.round(F.try_divide(F.col("positives").cast("double"), F.col("eligible")), 9))


#: Parts of names that the predictors' table may not have.
_FORBIDDEN = ("(?i)failure", "(?i)closing", "(?i)acquiring", "(?i)fund_number", "(?i)distress", "(?i)label_status")


@query(f"{_LABELLED}, l8 AS (SELECT *, {R._label_case(24)} AS status8 FROM y), {controls._DISTRESS_SQL}, {controls._distress_labels_sql('ds', 'dl')}, c AS (SELECT 'LC002' AS control_id, (SELECT count(*) FROM fe) AS expected, (SELECT count(*) FROM dl) AS observed UNION ALL SELECT 'LC005', 0, count(*) FILTER (WHERE status8 = 'RIGHT_CENSORED' AND status8 IN ('POSITIVE', 'NEGATIVE')) FROM l8 UNION ALL SELECT 'LL001', 0, 0 UNION ALL SELECT 'LL002', 0, count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE') AND period >= first_event) FROM lz UNION ALL SELECT 'LC009', 0, CASE WHEN (SELECT count(*) FROM lz WHERE status IN ('POSITIVE', 'NEGATIVE') AND period >= first_event) > 0 THEN 1 ELSE 0 END) SELECT *, CASE WHEN expected = observed THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def leakage_controls(s: SparkSession, d: str) -> DataFrame:
    """Distress rows as expected, no label where eight quarters are censored, no outcome among the predictors, none after the event, and the leakage checks as one."""
    fe = features.risk_features(R.filings(s, d, "l_partkey"), "entity", "period")
    both = events.labels_of_horizons(R._label_panel(s, d), "entity", "period", {"4Q": 12, "8Q": 24}, R._END)
    labels = both.agg(F.count_if((F.col("horizon") == "8Q") & (F.col("status") == "RIGHT_CENSORED") & F.col("label").isNotNull()).alias("LC005"), F.count_if((F.col("horizon") == "4Q") & F.col("label").isNotNull() & F.col("post_event")).alias("LL002"))
    distress = D.distress_labels(controls._distress(s, d), "entity", "period", 12, controls._LAST).agg(F.count("*").alias("LC002"))
    one = labels.crossJoin(distress).crossJoin(fe.agg(F.count("*").alias("n"))).withColumn("LL001", F.lit(len(forbidden_columns(fe, _FORBIDDEN))))  # one row each
    one = one.withColumn("LC009", (F.col("LL001") > 0).cast("int") + (F.col("LL002") > 0).cast("int"))
    cell = lambda i, e: F.struct(F.lit(i).alias("control_id"), e.cast("long").alias("expected"), F.col(i).cast("long").alias("observed"))
    x = one.select(F.inline(F.array(cell("LC002", F.col("n")), *[cell(i, F.lit(0)) for i in ("LC005", "LL001", "LL002", "LC009")])))
    return x.withColumn("status", F.when(F.col("expected") == F.col("observed"), "PASS").otherwise("FAIL"))


@query(f"WITH {controls._PANEL_SQL}, ia AS (SELECT l_partkey AS entity, min(CAST(l_shipdate AS DATE)) AS inactive FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49 GROUP BY 1) SELECT 'EQUITY_THIN' AS control_id, 'Medium' AS severity, entity, period, md5('EQUITY_THIN|' || entity || '|' || period) AS exception_id FROM pa WHERE equity - net_income < 0.05 * asset UNION ALL SELECT 'ROW_AFTER_INACTIVE', 'Low', entity, period, md5('ROW_AFTER_INACTIVE|' || entity || '|' || period) FROM pa JOIN ia USING (entity) WHERE period > inactive")
def plausibility_exceptions(s: SparkSession, d: str) -> DataFrame:
    """Thin equity and rows after an entity's inactive date; they are named, never dropped."""
    p = R.filings(s, d, "l_partkey")
    gone = table(s, d, "lineitem").where("l_discount >= 0.1 and l_quantity >= 49").groupBy(F.col("l_partkey").alias("entity")).agg(F.min(F.col("l_shipdate").cast("date")).alias("inactive"))
    tests = F.array_compact(F.array(F.when(F.col("equity") - F.col("net_income") < 0.05 * F.col("asset"), F.struct(F.lit("EQUITY_THIN").alias("control_id"), F.lit("Medium").alias("severity"))), F.when(F.col("period") > F.col("inactive"), F.struct(F.lit("ROW_AFTER_INACTIVE").alias("control_id"), F.lit("Low").alias("severity")))))
    x = p.join(gone, "entity", "left").select(*_KEYS, F.inline(tests))
    return x.withColumn("exception_id", F.md5(F.concat_ws("|", "control_id", F.col("entity").cast("string"), F.col("period").cast("string"))))


@query(f"WITH {controls._FEATURES_SQL} SELECT entity, period, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in presentation.HISTORY)}, row_number() OVER (PARTITION BY entity ORDER BY period) AS history FROM fe")
def entity_feature_history(s: SparkSession, d: str) -> DataFrame:
    """Each entity's indicators over time, numbered."""
    fe = features.risk_features(R.filings(s, d, "l_partkey"), "entity", "period")
    return events.numbered(fe.select(*_KEYS, *[(F.round(c, 6) + 0.0).alias(c) for c in presentation.HISTORY]), "entity", "period")
