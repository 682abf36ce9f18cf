"""Report, ranking and model queries over the panels of :mod:`registry`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import events, models, panel, quality, ranking
from panelwright.plans import registry as R
from panelwright.plans.registry import query, table

_BOTH_SQL = f"{R._LABEL_SQL}, z AS (SELECT entity, period, next_date, next_type, '4Q' AS horizon, {R._label_case(12)} AS status FROM y UNION ALL SELECT entity, period, next_date, next_type, '8Q', {R._label_case(24)} FROM y)"


def _both(s: SparkSession, d: str) -> DataFrame:
    """Labels of both horizons, one below the other."""
    return events.labels_of_horizons(R._label_panel(s, d), "entity", "period", {"4Q": 12, "8Q": 24}, R._END)


@query(f"{_BOTH_SQL} SELECT horizon, status, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM z GROUP BY 1, 2")
def label_status_summary(s: SparkSession, d: str) -> DataFrame:
    return _both(s, d).groupBy("horizon", "status").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))


@query(f"{_BOTH_SQL} SELECT horizon, count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')) AS eligible, count(*) FILTER (WHERE status = 'POSITIVE') AS positive, count(*) FILTER (WHERE status = 'NEGATIVE') AS negative, count(*) FILTER (WHERE status = 'RIGHT_CENSORED') AS censored FROM z GROUP BY 1")
def label_prevalence_by_horizon(s: SparkSession, d: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("status") == x)
    return _both(s, d).groupBy("horizon").agg(F.count("label").alias("eligible"), n("POSITIVE").alias("positive"), n("NEGATIVE").alias("negative"), n("RIGHT_CENSORED").alias("censored"))


@query(f"{_BOTH_SQL} SELECT horizon, CAST(year(period) AS INTEGER) AS year, count(*) FILTER (WHERE status = 'POSITIVE') AS positive, count(*) FILTER (WHERE status = 'NEGATIVE') AS negative FROM z GROUP BY 1, 2")
def label_counts_by_year(s: SparkSession, d: str) -> DataFrame:
    return _both(s, d).groupBy("horizon", F.year("period").alias("year")).agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


@query(f"{_BOTH_SQL} SELECT horizon, count(*) AS n_rows, min(next_date - period) AS min_days, median(next_date - period) AS median_days, max(next_date - period) AS max_days FROM z WHERE status = 'POSITIVE' GROUP BY 1")
def lead_time_summary(s: SparkSession, d: str) -> DataFrame:
    x = _both(s, d).where("label = 1").withColumn("days", F.datediff("next_date", "period").cast("long"))
    return x.groupBy("horizon").agg(F.count("*").alias("n_rows"), F.min("days").alias("min_days"), F.median("days").alias("median_days"), F.max("days").alias("max_days"))


@query(f"{_BOTH_SQL} SELECT horizon, next_type, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM z WHERE status = 'COMPETING_EXIT' GROUP BY 1, 2")
def competing_exits(s: SparkSession, d: str) -> DataFrame:
    return _both(s, d).where("status = 'COMPETING_EXIT'").groupBy("horizon", "next_type").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))


@query(f"{_BOTH_SQL} SELECT period, horizon, count(*) AS n_rows FROM z WHERE status = 'RIGHT_CENSORED' GROUP BY 1, 2")
def censoring_summary(s: SparkSession, d: str) -> DataFrame:
    return _both(s, d).where("status = 'RIGHT_CENSORED'").groupBy("period", "horizon").agg(F.count("*").alias("n_rows"))


@query(f"{_BOTH_SQL}, c AS (SELECT horizon, year(period) AS yr, count(*) AS n FROM z WHERE status = 'POSITIVE' GROUP BY 1, 2), t AS (SELECT horizon, string_agg(yr || ':' || n, ' ' ORDER BY yr) AS positives_by_year FROM c GROUP BY 1) SELECT horizon, count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')) AS eligible, count(*) FILTER (WHERE status = 'POSITIVE') AS positives, max(positives_by_year) AS positives_by_year FROM z LEFT JOIN t USING (horizon) GROUP BY 1")
def class_imbalance(s: SparkSession, d: str) -> DataFrame:
    by_year = _both(s, d).groupBy("horizon", F.year("period").alias("yr")).agg(F.count("label").alias("e"), F.count_if(F.col("label") == 1).alias("n"))
    parts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("yr", "n"))))
    x = by_year.groupBy("horizon").agg(F.sum("e").alias("eligible"), F.sum("n").alias("positives"), parts.alias("p"))
    return x.select("horizon", "eligible", "positives", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda r: F.concat(r["yr"].cast("string"), F.lit(":"), r["n"].cast("string"))), " ")).alias("positives_by_year"))


@query(f"{_BOTH_SQL}, r AS (SELECT horizon, status, entity, period, row_number() OVER (PARTITION BY horizon, status ORDER BY md5(entity || '|' || strftime(period, '%Y-%m-%d')), entity, period) AS n FROM z) SELECT horizon, status, entity, period FROM r WHERE n = 1")
def label_audit_sample(s: SparkSession, d: str) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.col("entity").cast("string"), F.date_format("period", "yyyy-MM-dd")))
    first = F.min_by(F.struct("entity", "period"), F.struct(order.alias("h"), "entity", "period"))
    return _both(s, d).groupBy("horizon", "status").agg(first.alias("r")).select("horizon", "status", "r.*")


@query(f"{_BOTH_SQL}, f AS (SELECT entity, min(event_date) AS event_date FROM ev WHERE event_type = 'FAILURE' GROUP BY 1), k AS (SELECT p.entity, period, event_date FROM p JOIN f USING (entity)) SELECT CASE WHEN event_date > period THEN 'BEFORE' WHEN CAST(last_day(date_trunc('quarter', event_date) + INTERVAL 2 MONTH) AS DATE) = period THEN 'SAME_QUARTER' ELSE 'LATER' END AS timing, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM k GROUP BY 1")
def post_event_timing(s: SparkSession, d: str) -> DataFrame:
    x = R._labels(s, d, 12).where("first_event is not null")
    timing = F.when(F.col("first_event") > F.col("period"), "BEFORE").when(C.quarter_end(F.col("first_event")) == F.col("period"), "SAME_QUARTER").otherwise("LATER")
    return x.groupBy(timing.alias("timing")).agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))


@query(f"SELECT {R._PERIOD} AS period, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_discount IS NULL) AS missing_discount, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys FROM lineitem GROUP BY 1")
def quarter_summary(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").groupBy(C.quarter_end(F.col("l_shipdate")).alias("period"))
    return x.agg(F.count("*").alias("n_rows"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_discount").isNull()).alias("missing_discount"), (F.count("*") - F.count_distinct(F.struct("l_orderkey", "l_linenumber"))).alias("duplicate_keys"))


@query("SELECT l_suppkey, count(*) AS n_rows, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day, count(DISTINCT l_partkey) AS n_parts, bool_or(s_suppkey IS NOT NULL) AS in_dimension FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def entity_coverage(s: SparkSession, d: str) -> DataFrame:
    per = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"), F.count_distinct("l_partkey").alias("n_parts"))
    known = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("k"))
    return per.join(known, "l_suppkey", "left").withColumn("in_dimension", F.coalesce("k", F.lit(False))).drop("k")


@query("WITH e AS (" + R._EXC_SQL + ") SELECT severity, category, count(*) AS n_exceptions, count(DISTINCT control_id) AS n_controls FROM e GROUP BY 1, 2")
def dq_summary(s: SparkSession, d: str) -> DataFrame:
    return R._exceptions(s, d).groupBy("severity", "category").agg(F.count("*").alias("n_exceptions"), F.count_distinct("control_id").alias("n_controls"))


_PAIRS = (("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("customer", "c_custkey", "events", "user_id"))


@query(" UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, count(x) AS left_keys, count(y) AS right_keys, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS matched FROM (SELECT DISTINCT {k} AS x FROM {a} WHERE {k} IS NOT NULL) FULL JOIN (SELECT DISTINCT {j} AS y FROM {b} WHERE {j} IS NOT NULL) ON x = y" for a, k, b, j in _PAIRS))
def source_matching(s: SparkSession, d: str) -> DataFrame:
    parts = [quality.key_overlap(table(s, d, a).select(F.col(k).alias("k")), table(s, d, b).select(F.col(j).alias("k")), "k").select(F.lit(f"{a}-{b}").alias("pair"), "left_keys", "right_keys", "matched") for a, k, b, j in _PAIRS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE user_id IN (SELECT c_custkey FROM customer)) AS matched, count(DISTINCT user_id) AS n_entities FROM events GROUP BY 1")
def event_type_matching(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("k")).distinct()
    return table(s, d, "events").select("event_type", "user_id").join(known, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count("k").alias("matched"), F.count_distinct("user_id").alias("n_entities"))


@query(f"WITH {R._GROUPS_SQL} SELECT period, band, peer_method, count(*) AS n_rows, count(DISTINCT peer_group) AS n_groups, min(peer_size) AS min_size, median(peer_size) AS median_size, max(peer_size) AS max_size FROM g GROUP BY 1, 2, 3")
def peer_group_sizes(s: SparkSession, d: str) -> DataFrame:
    return R._groups(s, d).groupBy("period", "band", "peer_method").agg(F.count("*").alias("n_rows"), F.count_distinct("peer_group").alias("n_groups"), F.min("peer_size").alias("min_size"), F.median("peer_size").alias("median_size"), F.max("peer_size").alias("max_size"))


_FIELDS = ("equity", "past_due_30", "nonaccrual", "construction", "cards")


@query(f"WITH p AS ({R._SUPPLIERS}) SELECT period, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE {f} = 0) AS {f}_empty" for f in _FIELDS) + " FROM p GROUP BY 1")
def field_emptiness(s: SparkSession, d: str) -> DataFrame:
    return R.filings(s, d).groupBy("period").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f) == 0).alias(f"{f}_empty") for f in _FIELDS])


#: Date windows of the splits and expanding folds (train until, validate from, to).
SPLITS = (("TRAIN", "1990-01-01", "1997-12-31"), ("VALIDATION", "1998-01-01", "1999-12-31"), ("LOCKED_TEST", "2000-01-01", "2000-12-31"))
FOLDS = (("1996-12-31", "1997-01-01", "1997-12-31"), ("1997-12-31", "1998-01-01", "1998-12-31"), ("1998-12-31", "1999-01-01", "1999-12-31"))
_SPLIT_SQL = "CASE " + " ".join(f"WHEN period BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in SPLITS) + f" ELSE '{models.OUTSIDE}' END"


@query(f"{_BOTH_SQL} SELECT horizon, {_SPLIT_SQL} AS split, count(*) AS n_rows, count(*) FILTER (WHERE status IN ('POSITIVE', 'NEGATIVE')) AS labelled, count(*) FILTER (WHERE status = 'POSITIVE') AS positives, count(DISTINCT entity) AS n_entities, min(period) AS first_period, max(period) AS last_period FROM z GROUP BY 1, 2")
def split_diagnostics(s: SparkSession, d: str) -> DataFrame:
    x = _both(s, d).groupBy("horizon", models.split_of(F.col("period"), SPLITS).alias("split"))
    return x.agg(F.count("*").alias("n_rows"), F.count("label").alias("labelled"), F.count_if(F.col("label") == 1).alias("positives"), F.count_distinct("entity").alias("n_entities"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query(f"WITH p AS (SELECT DISTINCT l_suppkey AS entity, {R._PERIOD} AS period FROM lineitem), e AS (SELECT DISTINCT entity, {_SPLIT_SQL} AS split FROM p) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM e a JOIN e b ON a.entity = b.entity AND a.split < b.split GROUP BY 1, 2")
def split_overlap(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").select(F.col("l_suppkey").alias("entity"), models.split_of(C.quarter_end(F.col("l_shipdate")), SPLITS).alias("split"))
    sets = p.groupBy("entity").agg(F.array_sort(F.collect_set("split")).alias("s"))  # at most one name per window
    pairs = sets.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query(f"{_BOTH_SQL}, f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, DATE '{u}', DATE '{a}', DATE '{b}')" for i, (u, a, b) in enumerate(FOLDS, 1)) + ") t(fold, until, first, last)), k AS (SELECT fold, CASE WHEN period <= until THEN 'TRAIN' ELSE 'VALIDATE' END AS side, status FROM z JOIN f ON period <= until OR period BETWEEN first AND last WHERE horizon = '4Q' AND status IN ('POSITIVE', 'NEGATIVE')) SELECT fold, side, count(*) AS n_rows, count(*) FILTER (WHERE status = 'POSITIVE') AS positives FROM k GROUP BY 1, 2")
def fold_diagnostics(s: SparkSession, d: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("date")
    sides = [F.when(F.col("period") <= day(u), F.struct(F.lit(i).alias("fold"), F.lit("TRAIN").alias("side"))).when(F.col("period").between(day(a), day(b)), F.struct(F.lit(i).alias("fold"), F.lit("VALIDATE").alias("side"))) for i, (u, a, b) in enumerate(FOLDS, 1)]
    x = R._labels(s, d, 12).where("label is not null").select("label", F.explode(F.array_compact(F.array(*sides))).alias("r")).select("label", "r.*")
    return x.groupBy("fold", "side").agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives"))


_SCORES_SQL = f"s AS (SELECT entity, period, round(efficiency, 6) AS score, CASE WHEN margin > 4.5 THEN 1 ELSE 0 END AS target FROM ({R._SUPPLIERS}))"
_RANKED_SQL = f"""{_SCORES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS budget_rank, count(*) OVER (PARTITION BY period) AS period_rows, rank() OVER (PARTITION BY period ORDER BY score DESC) AS score_rank, round(100 * percent_rank() OVER (PARTITION BY period ORDER BY score), 6) AS percentile FROM s),
f AS (SELECT *, {', '.join(f"CASE WHEN budget_rank <= greatest(1, ceil(period_rows * {p} / 100.0)) THEN 1 ELSE 0 END AS top_{p}pct" for p in (1, 5, 10))} FROM b),
r AS (SELECT *, CASE {' '.join(f"WHEN percentile >= {low} THEN '{name}'" for low, name in ranking.TIERS)} ELSE '{ranking.LOWEST_TIER}' END AS tier, CASE WHEN top_5pct = 1 THEN 'Top-5% review' WHEN percentile >= 90 THEN 'Elevated indicators' WHEN percentile >= 50 THEN 'Monitor' ELSE 'No alert' END AS alert FROM f)"""


def _panel_scores(s: SparkSession, d: str) -> DataFrame:
    return R.filings(s, d).select("entity", "period", F.round("efficiency", 6).alias("score"), F.when(F.col("margin") > 4.5, 1).otherwise(0).alias("target"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return ranking.rank_scores(_panel_scores(s, d), "entity", "period", "score")


@query(f"WITH {_RANKED_SQL} SELECT r.entity, r.period, r.score, r.score_rank, r.percentile, r.top_1pct, r.top_5pct, r.top_10pct, r.tier, r.alert, round(r.percentile - q.percentile, 6) AS change_1q, round(r.percentile - y.percentile, 6) AS change_4q FROM r LEFT JOIN r q ON q.entity = r.entity AND CAST(last_day(q.period + INTERVAL 3 MONTH) AS DATE) = r.period LEFT JOIN r y ON y.entity = r.entity AND CAST(last_day(y.period + INTERVAL 12 MONTH) AS DATE) = r.period")
def ranked_scores(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d).select("entity", "period", "score", "score_rank", "percentile", "top_1pct", "top_5pct", "top_10pct", "tier", "alert", "change_1q", "change_4q")


@query(f"WITH {_RANKED_SQL} SELECT period, tier, count(*) AS n_rows FROM r GROUP BY 1, 2")
def tier_distribution(s: SparkSession, d: str) -> DataFrame:
    return _ranked(s, d).groupBy("period", "tier").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_RANKED_SQL}, k AS (SELECT period, count(*) AS n_rows, CAST(sum(top_5pct) AS BIGINT) AS flagged, count(*) FILTER (WHERE tier = '{ranking.TIERS[0][1]}') AS highest FROM r GROUP BY 1) SELECT *, flagged - lag(flagged) OVER (ORDER BY period) AS flagged_change FROM k")
def period_kpis(s: SparkSession, d: str) -> DataFrame:
    return ranking.period_kpis(_ranked(s, d), "period")


@query(f"WITH {_RANKED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS recency FROM r) SELECT entity, period, recency, score, percentile, tier FROM n WHERE recency <= 8")
def entity_history(s: SparkSession, d: str) -> DataFrame:
    return ranking.last_periods(_ranked(s, d), "entity", "period", 8).select("entity", "period", "recency", "score", "percentile", "tier")


@query(f"WITH {_RANKED_SQL}, m AS (SELECT max(period) AS period FROM r) SELECT entity, period, score, percentile, tier, alert FROM r JOIN m USING (period) WHERE top_10pct = 1")
def watchlist(s: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(s, d)
    last = ranked.agg(F.max("period").alias("period"))
    return ranked.join(last, "period").where("top_10pct = 1").select("entity", "period", "score", "percentile", "tier", "alert")


@query(f"WITH {_RANKED_SQL} " + " UNION ALL ".join(f"SELECT {p} AS percent, CAST(sum(top_{p}pct) AS BIGINT) AS alerts, CAST(sum(top_{p}pct * target) AS BIGINT) AS captured, CAST(sum(top_{p}pct * (1 - target)) AS BIGINT) AS false_alerts, CAST(sum(top_{p}pct * target) AS DOUBLE) / sum(top_{p}pct) AS precision, CAST(sum(top_{p}pct * target) AS DOUBLE) / sum(target) AS recall FROM r" for p in (1, 5, 10)))
def budget_metrics(s: SparkSession, d: str) -> DataFrame:
    return ranking.budget_metrics(_panel_scores(s, d), "entity", "period", "score", "target")


_EVENT_SQL = f"{R._LABEL_SQL}, q AS (SELECT l_partkey AS entity, {R._PERIOD} AS period, round(CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE), 6) AS score FROM lineitem GROUP BY 1, 2), st AS (SELECT *, {R._label_case(12)} AS status FROM y), z AS (SELECT st.*, q.score, CASE WHEN status = 'POSITIVE' THEN 1 ELSE 0 END AS target FROM st JOIN q ON q.entity = st.entity AND q.period = st.period), b AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) <= greatest(1, ceil(count(*) OVER (PARTITION BY period) * 5 / 100.0)) AS hit FROM z)"


@query(f"{_EVENT_SQL} SELECT entity, next_date, min(CASE WHEN hit THEN period END) AS first_alert, count(*) FILTER (WHERE hit) AS alerted_periods, max(score) AS max_score, min(CASE WHEN hit THEN period END) IS NOT NULL AS captured, CAST(next_date - min(CASE WHEN hit THEN period END) AS INTEGER) AS lead_days FROM b WHERE target = 1 GROUP BY entity, next_date")
def event_capture(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), C.quarter_end(F.col("l_shipdate")).alias("period")).agg(F.round(F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double"), 6).alias("score"))
    x = R._labels(s, d, 12).join(lines, ["entity", "period"]).withColumn("target", F.when(F.col("status") == "POSITIVE", 1).otherwise(0))
    return ranking.event_capture(x, "entity", "period", "score", "next_date", "target", 5)


_CURVE_SQL = f"{_SCORES_SQL}, g AS (SELECT score AS threshold, count(*) AS n, sum(target) AS t FROM s GROUP BY 1), c AS (SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS al, (SELECT sum(target) FROM s) AS pos, (SELECT count(*) FROM s) AS m FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_CURVE_SQL} SELECT threshold, tp, al - tp AS fp, tp::DOUBLE / al AS precision, tp::DOUBLE / pos AS recall, (al - tp)::DOUBLE / (m - pos) AS fpr, (5 * tp)::DOUBLE / (4 * pos + al) AS f2 FROM c")
def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    return ranking.threshold_curve(_panel_scores(s, d), "score", "target")


@query(f"WITH {_CURVE_SQL}, q AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(repr(0.70 + (0.999 - 0.70) * i / 199) for i in range(200))}])) AS threshold FROM s), o AS (SELECT q.threshold, (5 * sum(target) FILTER (WHERE score >= threshold))::DOUBLE / (4 * sum(target) + count(*) FILTER (WHERE score >= threshold)) AS f2 FROM q, s GROUP BY 1) SELECT round(threshold, 9) AS threshold, round(f2, 9) AS f2 FROM o ORDER BY o.f2 DESC, o.threshold DESC LIMIT 1")
def best_f2_threshold(s: SparkSession, d: str) -> DataFrame:
    return ranking.best_f2_threshold(_panel_scores(s, d), "score", "target").select(F.round("threshold", 9).alias("threshold"), F.round("f2", 9).alias("f2"))


_FEATURES = ("equity_ratio", "noncurrent", "roa", "growth", "loan_ratio", "efficiency")
_SIGNS = dict(zip(_FEATURES, (-1, 1, -1, 1, 1, 1), strict=True))
_MODEL_SQL = f"""p0 AS ({R._SUPPLIERS}), p AS (SELECT *, lead(margin) OVER (PARTITION BY entity ORDER BY period) AS next_margin FROM p0), m AS (SELECT p.entity, p.period, CASE WHEN p.next_margin > 4.5 THEN 1 ELSE 0 END AS target, 100.0 * p.equity / nullif(p.asset, 0) AS equity_ratio, 100.0 * (p.past_due_90 + p.nonaccrual) / nullif(p.loans, 0) AS noncurrent, p.roa, CASE WHEN abs(q.asset) > 0 THEN 100.0 * (p.asset - q.asset) / abs(q.asset) END AS growth, 100.0 * p.loans / nullif(p.deposits, 0) AS loan_ratio, p.efficiency FROM p LEFT JOIN p q ON q.entity = p.entity AND q.period = CAST(last_day(p.period - INTERVAL 3 MONTH) AS DATE) WHERE p.next_margin IS NOT NULL)"""


def _model_rows(s: SparkSession, d: str) -> DataFrame:
    """Entity-quarters with six features, some missing, and the next quarter's outcome as target."""
    p = panel.add_lags(R.filings(s, d), "entity", "period", ["asset"], [1])
    p = p.withColumn("next_margin", F.lead("margin").over(Window.partitionBy("entity").orderBy("period"))).where("next_margin is not null")
    c = F.col
    return p.select("entity", "period", F.when(c("next_margin") > 4.5, 1).otherwise(0).alias("target"), C.ratio(c("equity"), c("asset")).alias("equity_ratio"), C.ratio(c("past_due_90") + c("nonaccrual"), c("loans")).alias("noncurrent"), "roa", C.pct_change(c("asset"), c("asset_lag1"), c("ok_lag1")).alias("growth"), C.ratio(c("loans"), c("deposits")).alias("loan_ratio"), "efficiency")


@query(f"WITH {_MODEL_SQL}, t AS (SELECT * FROM m WHERE period <= DATE '1997-12-31'), md AS (SELECT {', '.join(f'median({f}) AS d_{f}' for f in _FEATURES)} FROM t), st AS (SELECT {', '.join(f'avg(coalesce({f}, d_{f})) AS m_{f}, stddev_pop(coalesce({f}, d_{f})) AS s_{f}' for f in _FEATURES)} FROM t, md) SELECT entity, period, round(1 / (1 + exp(-(" + " + ".join(f"{g} * (coalesce({f}, d_{f}) - m_{f}) / s_{f}" for f, g in _SIGNS.items()) + ") / 6)), 6) AS rule_score FROM m, md, st")
def rule_scores(s: SparkSession, d: str) -> DataFrame:
    rows = _model_rows(s, d)
    return models.rule_score(rows.where("period <= date '1997-12-31'"), rows, _SIGNS).select("entity", "period", F.round("rule_score", 6).alias("rule_score"))


@query(f"WITH {_MODEL_SQL} SELECT {_SPLIT_SQL} AS split, count(*) AS n_rows, avg(target) AS prevalence, " + ", ".join(f"round(median({f}), 9) AS {f}" for f in _FEATURES) + " FROM m GROUP BY 1")
def preprocess_audit(s: SparkSession, d: str) -> DataFrame:
    x = _model_rows(s, d).groupBy(models.split_of(F.col("period"), SPLITS).alias("split"))
    return x.agg(F.count("*").alias("n_rows"), F.avg("target").alias("prevalence"), *[F.round(F.median(f), 9).alias(f) for f in _FEATURES])


@query()
def model_cross_validation(s: SparkSession, d: str) -> DataFrame:
    """Average precision and AUC of each candidate in each expanding fold (no SQL: fitted models)."""
    return models.cross_validate(_model_rows(s, d).cache(), _FEATURES, FOLDS)


def _train(s: SparkSession, d: str) -> tuple[DataFrame, models.Fitted]:
    rows = _model_rows(s, d).cache()
    return rows, models.fit(rows.where("period <= date '1997-12-31'"), _FEATURES, models.candidates()["logistic_l2"])


@query()
def model_scores(s: SparkSession, d: str) -> DataFrame:
    """Every row's probability, raw and calibrated on the validation window (no SQL: a fitted model)."""
    rows, model = _train(s, d)
    scored = model.score(rows)
    return models.platt(scored.where("period between date '1998-01-01' and date '1999-12-31'"), scored).select("entity", "period", "target", "probability", "calibrated", "calibration_slope", "calibration_intercept")


@query()
def model_coefficients(s: SparkSession, d: str) -> DataFrame:
    return models.coefficients(_train(s, d)[1], s)


@query()
def model_drivers(s: SparkSession, d: str) -> DataFrame:
    """The three features that move each row's score most (no SQL: a fitted model)."""
    rows, model = _train(s, d)
    return models.local_drivers(model, rows, ["entity", "period"], _FEATURES)
