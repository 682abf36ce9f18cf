"""Queries on samples, curves, permutation importance, calibration, model datasets and label audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import calibration, dataset, features, importance, label_audit, metrics, models, ordering, ranking
from panelwright.plans import controls, reports
from panelwright.plans import registry as R
from panelwright.plans.registry import query, table
from panelwright.sources.scratch import kept

_KEYS = ["entity", "period"]


@query(f"WITH p AS ({R._PARTS}), x AS (SELECT entity, period, asset, row_number() OVER (ORDER BY period, entity) - 1 AS row_index, greatest(1, (SELECT count(*) FROM p) // 10000) AS k FROM p) SELECT entity, period, asset, row_index FROM x WHERE row_index % k = 0 AND row_index // k < 10000")
def systematic_sample(s: SparkSession, d: str) -> DataFrame:
    """Every k-th row of the parts' panel by period and entity, 10,000 at the most."""
    p = R.filings(s, d, "l_partkey").select(*_KEYS, "asset")
    by = F.unix_date("period") + F.col("entity") / F.lit(float(1 << 62))  # grows with the period; entities of a period share a range
    return ordering.systematic_sample(p, by, [F.col("period"), F.col("entity")])


@query(f"WITH {reports._CURVE_SQL}, o AS (SELECT threshold, tp, al, pos, m, row_number() OVER (ORDER BY threshold DESC) - 1 AS j, count(*) OVER () AS n FROM c), i AS (SELECT unnest(range((SELECT least(300, max(n)) FROM o))) AS point) SELECT point, threshold, tp::DOUBLE / al AS precision, tp::DOUBLE / pos AS recall, (al - tp)::DOUBLE / (m - pos) AS fpr FROM o JOIN i ON j = point * (n - 1) // greatest(1, least(300, n) - 1)")
def curve_points(s: SparkSession, d: str) -> DataFrame:
    """At most 300 evenly spaced points of the threshold curve."""
    curve = ranking.threshold_curve(reports._panel_scores(s, d), "score", "target").select("threshold", "precision", "recall", "fpr")
    return ordering.evenly_spaced(curve, -F.col("threshold"), [F.desc("threshold")])


_RULE = "coalesce(margin_before, 0.0) * 3.0 + coalesce(efficiency, 0.0) * 0.25 - coalesce(equity_ratio, 0.0) * 0.125 + coalesce(loan_ratio, 0.0) * 0.0625"
_RULE_FEATURES = ("margin_before", "efficiency", "equity_ratio", "loan_ratio")
_NOW = f"SELECT entity, period, CASE WHEN margin > 4.5 THEN 1 ELSE 0 END AS target, margin AS margin_before, efficiency, 100.0 * equity / nullif(asset, 0) AS equity_ratio, 100.0 * loans / nullif(deposits, 0) AS loan_ratio FROM ({R._SUPPLIERS})"
_AP = "round(sum(t / tt * ct / cn), 6)"


def _dealt_sql() -> str:
    others = ", ".join(f"{f} AS o_{f}" for f in _RULE_FEATURES)
    copies = " UNION ALL ".join(f"SELECT '{f}' AS feature, rep, target, {_swapped(f)} AS score FROM own JOIN other USING (place)" for f in _RULE_FEATURES)
    return f"""m AS ({_NOW}), own AS (SELECT *, row_number() OVER (ORDER BY md5(entity || '|' || period), entity, period) AS place FROM m),
other AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '|' || entity || '|' || period), entity, period) AS place, {others} FROM m, range(1, 4) r(rep)),
s AS (SELECT '' AS feature, 0 AS rep, target, {_RULE} AS score FROM m UNION ALL {copies}), b AS (SELECT feature, rep, score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS t FROM s GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER w AS cn, sum(t) OVER w AS ct, sum(n) OVER (PARTITION BY feature, rep) AS tn, sum(t) OVER (PARTITION BY feature, rep) AS tt FROM b WINDOW w AS (PARTITION BY feature, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT feature, rep, {_AP} AS ap FROM c WHERE tt > 0 AND tn > tt GROUP BY 1, 2), l AS (SELECT a.feature, b.ap AS base_ap, b.ap - a.ap AS loss FROM ap a, ap b WHERE a.feature <> '' AND b.feature = '')"""


def _swapped(feature: str) -> str:
    return _RULE.replace(f"({feature},", f"(o_{feature},")


@query(f"WITH {_dealt_sql()} SELECT feature, base_ap, round(avg(loss), 6) AS importance_mean, round(stddev_pop(loss), 6) AS importance_std FROM l GROUP BY 1, 2")
def permutation_importance(s: SparkSession, d: str) -> DataFrame:
    """Loss of average precision of a rule score over four features, three permutations of each."""
    c = F.col
    rows = R.filings(s, d).select(*_KEYS, F.when(c("margin") > 4.5, 1).otherwise(0).alias("target"), c("margin").alias("margin_before"), "efficiency", F.expr("100.0 * equity / nullif(asset, 0)").alias("equity_ratio"), F.expr("100.0 * loans / nullif(deposits, 0)").alias("loan_ratio"))
    return importance.permutation_importance(rows, _KEYS, _RULE_FEATURES, lambda x: x.withColumn("score", F.expr(_RULE)), "target")


@query()
def model_permutation_importance(s: SparkSession, d: str) -> DataFrame:
    """The same for a fitted candidate: all copies of the validation rows are scored in one job (no SQL: a fitted model)."""
    rows, model = reports._train(s, d)
    held = rows.where("period between date '1998-01-01' and date '1999-12-31'")
    return importance.permutation_importance(held, _KEYS, reports._FEATURES, lambda x: model.score(x, "score"), "target")


_PROBABILITY = f"pr AS (SELECT entity, period, floor(margin * 12.5) / 100 AS probability, CASE WHEN margin + efficiency / 4 > 5.2 THEN 1 ELSE 0 END AS target FROM ({R._SUPPLIERS})), ft AS (SELECT * FROM pr WHERE period <= DATE '1997-12-31'), hb AS (SELECT * FROM pr WHERE period BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')"
_PAV = """g AS (SELECT probability AS x, count(*) AS n, sum(target) AS t, row_number() OVER (ORDER BY probability) AS i FROM ft GROUP BY 1), cu AS (SELECT i, x, n, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(t) OVER w, 0) AS tb, n AS own_n, t AS own_t FROM g WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
me AS (SELECT a.i AS j, b.i AS k, (b.tb + b.own_t - a.tb)::DOUBLE / (b.nb + b.own_n - a.nb) AS mean FROM cu a JOIN cu b ON a.i <= b.i), lo AS (SELECT j, i, min(mean) AS least FROM me, (SELECT i FROM g) WHERE j <= i AND k >= i GROUP BY 1, 2), pav AS (SELECT i, x, n, max(least) AS fitted FROM lo JOIN g USING (i) GROUP BY 1, 2, 3)"""


def _probabilities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    rows = R.filings(s, d).select(*_KEYS, (F.floor(c("margin") * 12.5) / 100).alias("probability"), F.when(c("margin") + c("efficiency") / 4 > 5.2, 1).otherwise(0).alias("target"))
    return rows.where("period <= date '1997-12-31'"), rows.where("period between date '1998-01-01' and date '1999-12-31'")


@query(f"WITH {_PROBABILITY}, {_PAV} SELECT x AS probability, n AS n_rows, round(fitted, 9) AS fitted FROM pav")
def isotonic_fit(s: SparkSession, d: str) -> DataFrame:
    """The monotone function of the score that is nearest to the outcomes, at each distinct score."""
    return calibration.isotonic_blocks(_probabilities(s, d)[0], "probability", "target").select("probability", "n_rows", F.round("fitted", 9).alias("fitted"))


@query(f"""WITH RECURSIVE {_PROBABILITY}, {_PAV}, z AS (SELECT x, n, own_t AS t, ln(greatest(least(x, 1 - 1e-12), 1e-12) / (1 - greatest(least(x, 1 - 1e-12), 1e-12))) AS z FROM cu),
it AS (SELECT 0 AS step, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (SELECT step, a, b, sum((n * p - t) * z) AS ga, sum(n * p - t) AS gb, sum(n * p * (1 - p) * z * z) AS haa, sum(n * p * (1 - p) * z) AS hab, sum(n * p * (1 - p)) AS hbb FROM (SELECT step, a, b, z.z, n, t, 1 / (1 + exp(-(a * z.z + b))) AS p FROM it, z WHERE step < 12) GROUP BY 1, 2, 3)),
ab AS (SELECT a, b FROM it WHERE step = 12), u AS (SELECT probability AS x, target, (SELECT max(i) FROM pav WHERE pav.x <= probability) AS l, (SELECT min(i) FROM pav WHERE pav.x >= probability) AS h FROM hb),
v AS (SELECT u.x, target, 1 / (1 + exp(-(a * ln(greatest(least(u.x, 1 - 1e-12), 1e-12) / (1 - greatest(least(u.x, 1 - 1e-12), 1e-12))) + b))) AS platt, CASE WHEN l IS NULL THEN q.fitted WHEN h IS NULL OR l = h THEN p.fitted ELSE p.fitted + (q.fitted - p.fitted) * (u.x - p.x) / (q.x - p.x) END AS iso FROM u LEFT JOIN pav p ON p.i = l LEFT JOIN pav q ON q.i = h, ab),
e AS (SELECT 'none' AS method, 0 AS place, count(*) AS n_rows, round(avg((x - target) * (x - target)), 4) AS brier FROM v UNION ALL SELECT 'platt', 1, count(*), round(avg((platt - target) * (platt - target)), 4) FROM v UNION ALL SELECT 'isotonic', 2, count(*), round(avg((iso - target) * (iso - target)), 4) FROM v WHERE (SELECT sum(target) FROM ft) >= 20)
SELECT method, n_rows, brier, place = (SELECT arg_min(place, (brier, place)) FROM e) AS chosen FROM e""")
def calibration_choice(s: SparkSession, d: str) -> DataFrame:
    """Brier scores of the three calibrators on held-back rows, and the one chosen."""
    return calibration.choose_calibrator(*_probabilities(s, d), digits=4)


_CAPITAL = features.family_columns("capital") + features.family_columns("earnings")
_SETS_SQL = f"{R._LABEL_SQL}, {controls._FEATURES_SQL}, lb AS (SELECT entity, period, '4Q' AS horizon, {R._label_case(12)} AS status FROM y UNION ALL SELECT entity, period, '8Q', {R._label_case(24)} FROM y), ds AS (SELECT lb.horizon, fe.*, {reports._SPLIT_SQL} AS split, CASE WHEN period > DATE '1999-12-31' THEN NULL WHEN status = 'POSITIVE' THEN 1 ELSE 0 END AS outcome, CASE WHEN period > DATE '1999-12-31' THEN 'LOCKED_TEST_MASKED' ELSE status END AS label_status FROM fe JOIN lb USING (entity, period) WHERE status IN ('POSITIVE', 'NEGATIVE') AND {reports._SPLIT_SQL} <> '{models.OUTSIDE}')"


def _dataset(s: SparkSession, d: str, months: int) -> DataFrame:
    fe = features.risk_features(R.filings(s, d, "l_partkey"), "entity", "period")
    return dataset.model_dataset(fe, R._labels(s, d, months), _KEYS, "period", _CAPITAL, reports.SPLITS, "LOCKED_TEST")


@query(f"{_SETS_SQL} SELECT entity, period, split, outcome, label_status, {', '.join(f'{c} + 0.0 AS {c}' if c.endswith('_8q') else c for c in _CAPITAL)} FROM ds WHERE horizon = '4Q'")
def model_dataset(s: SparkSession, d: str) -> DataFrame:
    """Capital and earnings features with the masked outcomes of four quarters."""
    x = _dataset(s, d, 12)
    return x.withColumns({c: F.col(c) + F.lit(0.0) for c in _CAPITAL if c.endswith("_8q")})  # no signed zeros


_REGISTRY_SQL = "SELECT 'failure_' || lower(horizon) AS dataset, count(*) AS n_rows, count(*) FILTER (WHERE split = 'TRAIN') AS train_rows, count(*) FILTER (WHERE split = 'VALIDATION') AS validation_rows, count(*) FILTER (WHERE split = 'LOCKED_TEST') AS locked_rows, count(*) FILTER (WHERE split = 'TRAIN' AND outcome = 1) AS train_positives, count(*) FILTER (WHERE split = 'VALIDATION' AND outcome = 1) AS validation_positives, count(*) FILTER (WHERE split = 'LOCKED_TEST' AND outcome IS NULL) AS locked_masked FROM ds GROUP BY horizon"


def _registry(s: SparkSession, d: str) -> DataFrame:
    return dataset.dataset_registry({"failure_4q": _dataset(s, d, 12), "failure_8q": _dataset(s, d, 24)}, *[n for n, _, _ in reports.SPLITS])


@query(f"{_SETS_SQL} {_REGISTRY_SQL}")
def dataset_registry(s: SparkSession, d: str) -> DataFrame:
    return _registry(s, d)


@query(f"{_SETS_SQL}, g AS ({_REGISTRY_SQL}) SELECT *, CASE WHEN n_rows = train_rows + validation_rows + locked_rows AND locked_rows = locked_masked THEN 'PASS' ELSE 'FAIL' END AS status FROM g")
def model_dataset_reconciliation(s: SparkSession, d: str) -> DataFrame:
    return dataset.dataset_reconciliation(_registry(s, d))


@query(f"{_SETS_SQL} SELECT entity, period, split FROM ds WHERE horizon = '4Q'")
def split_assignments(s: SparkSession, d: str) -> DataFrame:
    return _dataset(s, d, 12).select(*_KEYS, "split")


@query(f"{R._LABEL_SQL}, q AS (SELECT entity, event_date AS period FROM ev WHERE event_type = 'FAILURE') SELECT {reports._SPLIT_SQL} AS split, count(*) AS n_events, min(period) AS first_event, max(period) AS last_event FROM q GROUP BY 1")
def failure_events_by_split(s: SparkSession, d: str) -> DataFrame:
    ev = _label_events(s, d).groupBy("entity", "event_date").agg(F.min("event_type").alias("event_type")).where("event_type = 'FAILURE'")
    return ev.groupBy(models.split_of(F.col("event_date"), reports.SPLITS).alias("split")).agg(F.count("*").alias("n_events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"))


def _label_events(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").where("l_discount >= 0.09 and l_quantity >= 48 and l_returnflag in ('R', 'A')")
    return lines.select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").cast("date").alias("event_date"), F.expr(R._KINDS).alias("event_type"))


_DIGEST = "md5(entity || '|' || period)"
_AUDIT_SQL = f"""{R._LABEL_SQL}, st AS (SELECT entity, period, {R._label_case(12)} AS status, year(period) AS yr FROM y), dg AS (SELECT *, {_DIGEST} AS dg, CAST('0x' || substr({_DIGEST}, 25, 8) AS BIGINT) % 3 AS part FROM st),
sm AS (SELECT * FROM dg QUALIFY row_number() OVER (PARTITION BY status, yr, part ORDER BY dg, entity, period) = 1),
ex AS (SELECT sm.entity, sm.period, sm.status, (SELECT count(*) FROM ev WHERE ev.entity = sm.entity AND event_type = 'FAILURE' AND event_date <= sm.period) AS failed, (SELECT count(*) FROM p WHERE p.entity = sm.entity AND p.period <= sm.period) AS n_past, (SELECT bool_or(blocked) FROM p WHERE p.entity = sm.entity AND p.period = sm.period) AS blocked,
 (SELECT arg_min(event_type, event_date) FROM ev WHERE ev.entity = sm.entity AND event_date > sm.period AND event_date <= CAST(sm.period + INTERVAL 12 MONTH AS DATE)) AS kind FROM sm),
au AS (SELECT entity, period, status, CASE WHEN failed > 0 THEN 'INELIGIBLE_POST_EVENT' WHEN blocked THEN 'INELIGIBLE_QUALITY' WHEN n_past < 4 THEN 'INELIGIBLE_SHORT_HISTORY' WHEN kind = 'FAILURE' THEN 'POSITIVE' WHEN kind IS NOT NULL THEN 'COMPETING_EXIT' WHEN CAST(period + INTERVAL 12 MONTH AS DATE) > DATE '{R._END}' THEN 'RIGHT_CENSORED' ELSE 'NEGATIVE' END AS expected FROM ex)"""


def _audited(s: SparkSession, d: str) -> DataFrame:
    labels = R._labels(s, d, 12).select(*_KEYS, "status", "blocked", F.year("period").alias("yr"))
    sampled = label_audit.stratified_rows(labels, ["status", "yr"], _KEYS)
    events = _label_events(s, d).groupBy("entity", "event_date").agg(F.min("event_type").alias("event_type"))
    return label_audit.derived_status(sampled, labels.select(*_KEYS, "blocked"), events, "entity", "period", 12, R._END)


@query(f"{_AUDIT_SQL} SELECT entity, period, status, expected, status = expected AS agrees FROM au")
def label_audit_rows(s: SparkSession, d: str) -> DataFrame:
    """At most three rows of each status and year, their status against a second derivation of it."""
    return _audited(s, d).select(*_KEYS, "status", "expected", (F.col("status") == F.col("expected")).alias("agrees"))


@query(f"{_AUDIT_SQL} SELECT status, expected, count(*) AS n_rows FROM au GROUP BY 1, 2")
def label_audit_summary(s: SparkSession, d: str) -> DataFrame:
    return _audited(s, d).groupBy("status", "expected").agg(F.count("*").alias("n_rows"))


@query(f"{reports._BOTH_SQL}, e AS (SELECT *, CAST(next_date - CAST(period + (CASE horizon WHEN '4Q' THEN INTERVAL 12 MONTH ELSE INTERVAL 24 MONTH END) AS DATE) AS INTEGER) AS days_past FROM z) SELECT horizon, days_past, status, count(*) AS n_rows, status LIKE 'INELIGIBLE%' OR (status IN ('POSITIVE', 'COMPETING_EXIT')) = (days_past <= 0) AS agrees FROM e WHERE abs(days_past) <= 31 GROUP BY 1, 2, 3")
def label_boundary_validation(s: SparkSession, d: str) -> DataFrame:
    """Rows whose next event is within a month of either horizon's last day, and whether their status says on which side."""
    parts = [label_audit.boundary_cases(R._labels(s, d, m)).withColumn("horizon", F.lit(h)) for m, h in ((12, "4Q"), (24, "8Q"))]
    return parts[0].unionByName(parts[1])


_CANDIDATES = {"margin": "least(margin / 8, 1.0)", "efficiency": "least(efficiency / 10, 1.0)", "mixed": "least((margin + efficiency / 4) / 12, 1.0)", "mixed_twin": "least((margin + efficiency / 4) / 12, 1.0)"}
_FAMILIES = {"margin": "single", "efficiency": "single", "mixed": "combined", "mixed_twin": "combined", "prevalence": "baseline"}
_CV_SQL = f"""pr AS (SELECT entity, period, margin, efficiency, CASE WHEN margin + efficiency / 4 > 5.2 THEN 1 ELSE 0 END AS target FROM ({R._SUPPLIERS})), fo AS (SELECT * FROM (VALUES {', '.join(f"({i}, DATE '{u}', DATE '{a}', DATE '{b}')" for i, (u, a, b) in enumerate(reports.FOLDS, 1))}) t(fold, until, first, last)),
ba AS (SELECT fold, avg(target) AS base FROM pr JOIN fo ON period <= until GROUP BY 1), lo AS (SELECT fold, target, 'prevalence' AS model, base AS score FROM pr JOIN fo ON period BETWEEN first AND last JOIN ba USING (fold) {' '.join(f"UNION ALL SELECT fold, target, '{n}', {e} FROM pr JOIN fo ON period BETWEEN first AND last" for n, e in _CANDIDATES.items())}),
g AS (SELECT model, fold, score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS t FROM lo GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER w AS cn, sum(t) OVER w AS ct, sum(n) OVER (PARTITION BY model, fold) AS tn, sum(t) OVER (PARTITION BY model, fold) AS tt FROM g WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT model, fold, round(sum(t / tt * ct / cn), 6) AS average_precision, round(sum(t * ((tn - tt) - (cn - ct) + (n - t) / 2) / (tt * (tn - tt))), 6) AS roc_auc FROM c WHERE tt > 0 AND tn > tt GROUP BY 1, 2), cv AS (SELECT model, fold, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS positives, round(avg((score - target) * (score - target)), 6) AS brier FROM lo GROUP BY 1, 2)"""


def _compared(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = R.filings(s, d).select(*_KEYS, "margin", "efficiency", F.when(c("margin") + c("efficiency") / 4 > 5.2, 1).otherwise(0).alias("target"))
    return models.compare_scores(rows, {n: F.expr(e) for n, e in _CANDIDATES.items()}, reports.FOLDS)


@query(f"WITH {_CV_SQL} SELECT model, fold, n_rows, positives, average_precision, roc_auc, brier FROM cv LEFT JOIN ap USING (model, fold)")
def candidate_metrics(s: SparkSession, d: str) -> DataFrame:
    """Four scores and the prevalence baseline in each expanding fold."""
    return _compared(s, d)


@query(f"WITH {_CV_SQL}, me AS (SELECT model, round(avg(average_precision), 6) AS mean_ap, round(avg(brier), 6) AS mean_brier, count(*) AS folds, CASE {' '.join(f"WHEN model = '{m}' THEN '{f}'" for m, f in _FAMILIES.items())} END AS family FROM cv LEFT JOIN ap USING (model, fold) GROUP BY 1), sc AS (SELECT 'ALL' AS scope, * FROM me UNION ALL SELECT family, * FROM me) SELECT scope, model, mean_ap, mean_brier, folds FROM sc QUALIFY row_number() OVER (PARTITION BY scope ORDER BY mean_ap DESC, mean_brier, model) = 1")
def candidate_winners(s: SparkSession, d: str) -> DataFrame:
    """The winner of each family and of all, by average precision, Brier score and name."""
    return models.winners(_compared(s, d), _FAMILIES)


@query()
def model_winners(s: SparkSession, d: str) -> DataFrame:
    """The same for the fitted candidates (no SQL: fitted models)."""
    cv = models.cross_validate(reports._model_rows(s, d), reports._FEATURES, reports.FOLDS)
    return models.winners(cv, {"logistic": "logistic", "logistic_l2": "regularised", "logistic_elastic_net": "regularised", "forest": "forest", "boosting": "boosting"})


@query()
def model_sign_stability(s: SparkSession, d: str) -> DataFrame:
    """How steady the signs of the regularised line's coefficients are over the folds (no SQL: fitted models)."""
    rows = kept(reports._model_rows(s, d), "model_rows")  # read several times by each fold
    line = models.candidates()["logistic_l2"]
    return models.sign_stability([models.fit(rows.where(F.col("period") <= F.lit(u).cast("date")), reports._FEATURES, line) for u, _, _ in reports.FOLDS], s)


_DRAW = "CAST(CAST('0x' || substr(md5(rep || '|' || entity || '|' || next_date), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(f"{reports._EVENT_SQL}, ca AS (SELECT entity, next_date, CASE WHEN min(CASE WHEN hit THEN period END) IS NOT NULL THEN 1 ELSE 0 END AS hit FROM b WHERE target = 1 GROUP BY 1, 2), dr AS (SELECT rep, hit, {' + '.join(f'CASE WHEN {_DRAW} >= {c} THEN 1 ELSE 0 END' for c in metrics.POISSON)} AS k FROM ca, range(1, 201) r(rep)) SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(k) AS BIGINT) AS n_events, CASE WHEN sum(k) > 0 THEN round(sum(k * hit)::DOUBLE / sum(k), 6) END AS capture_rate FROM dr GROUP BY 1")
def event_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Capture rates of 200 draws of events."""
    return metrics.event_bootstrap(reports.event_capture(s, d), ["entity", "next_date"], "captured", 200)
