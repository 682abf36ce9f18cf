"""Subgroups, intervals, profiles, identifiers and presentation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import metrics, panel
from panelwright.operators import feature_quality as Q
from panelwright.plans import controls
from panelwright.plans import registry as R
from panelwright.plans.registry import query, table

_PRE = f"pr AS (SELECT entity, score, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS t FROM ({R._SCORED}) GROUP BY 1, 2)"
_DRAWS = f"dr AS (SELECT entity, rep, CAST({' + '.join(f'(CASE WHEN {R._U} >= {c} THEN 1 ELSE 0 END)' for c in metrics.POISSON)} AS DOUBLE) AS w FROM (SELECT DISTINCT entity FROM pr), range(1, 201) r(rep))"
_BOOT200 = f"""{_PRE}, {_DRAWS}, b AS (SELECT rep, score, sum(w * n) AS n, sum(w * t) AS t FROM pr JOIN dr USING (entity) WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER d AS cn, sum(t) OVER d AS ct, sum(n) OVER (PARTITION BY rep) AS tn, sum(t) OVER (PARTITION BY rep) AS tt FROM b WINDOW d AS (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT rep, round(sum(t / tt * ct / cn), 6) AS average_precision FROM c WHERE tt > 0 AND tn > tt GROUP BY 1)"""


@query(f"WITH {_BOOT200} SELECT 'average_precision' AS metric, count(*) AS n_draws, round(avg(average_precision), 6) AS mean, round(quantile_cont(average_precision, 0.025), 6) AS low, round(quantile_cont(average_precision, 0.975), 6) AS high FROM m")
def bootstrap_interval(s: SparkSession, d: str) -> DataFrame:
    """The 95% interval of average precision over 200 draws of whole entities."""
    return metrics.bootstrap_interval(metrics.cluster_bootstrap(R._scored(s, d), "entity", "score", "target", 200), "average_precision")


@query(f"WITH s AS ({R._SCORED}), b AS (SELECT greatest(1, ceil(score * 20)) AS bin, count(*) AS n, abs(avg(score) - avg(target)) AS gap FROM s GROUP BY 1) SELECT count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(n * gap) / sum(n), 6) AS ece FROM b")
def calibration_error(s: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(R._scored(s, d), "score", "target", 20)


@query(f"WITH s AS ({R._SCORED}), c AS (SELECT grp, count(*) FILTER (WHERE score >= 0.05 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.05 AND target = 0) AS fp, count(*) FILTER (WHERE score < 0.05 AND target = 1) AS fn, count(*) FILTER (WHERE score < 0.05 AND target = 0) AS tn FROM s GROUP BY 1) SELECT *, CASE WHEN (tp + fp) * (tp + fn) > 0 AND (tn + fp) * (tn + fn) > 0 THEN round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) END AS mcc FROM c")
def matthews_by_group(s: SparkSession, d: str) -> DataFrame:
    return metrics.matthews(R._scored(s, d), "score", "target", 0.05, ["grp"])


_SUB = "SELECT l_linenumber || l_linestatus AS grp, l_discount AS score, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS target, 1.0::DOUBLE AS w FROM lineitem"


@query(f"WITH {R._ranking_sql(_SUB, 'grp').replace('SELECT grp, max(tn)', ', rk AS (SELECT grp, max(tn)', 1)}), nn AS (SELECT grp, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS positives FROM ({_SUB}) GROUP BY 1) SELECT nn.grp, nn.n_rows, nn.positives, rk.average_precision, rk.roc_auc, CASE WHEN nn.positives = 0 THEN 'INSUFFICIENT_EVENTS' WHEN nn.positives < 10 THEN 'REPORT_WITH_CAUTION' ELSE 'RELIABLE' END AS reliability, round(rk.average_precision / (nn.positives / nn.n_rows), 4) AS lift FROM nn LEFT JOIN rk USING (grp)")
def subgroup_metrics(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select(F.concat(F.col("l_linenumber").cast("string"), "l_linestatus").alias("grp"), F.col("l_discount").alias("score"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int").alias("target"))
    return metrics.subgroup_metrics(x, "score", "target", "grp")


_FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT {R._PERIOD} AS period, '{c}' AS field, count(*) AS n_rows, round(100.0 * count({c}) / count(*), 6) AS non_null_pct, round(100.0 * count(*) FILTER (WHERE {c} = 0) / count(*), 6) AS zero_pct, count(DISTINCT {c}) AS n_distinct, min({c}) AS least, round(median({c}), 6) AS median, max({c}) AS most FROM lineitem GROUP BY 1" for c in _FIELDS))
def field_stats(s: SparkSession, d: str) -> DataFrame:
    """Completeness, zeros, distinct values and range of each measure in each period."""
    x = table(s, d, "lineitem").select(C.quarter_end(F.col("l_shipdate")).alias("period"), *_FIELDS).unpivot(["period"], list(_FIELDS), "field", "v")
    pct = lambda c: F.round(100.0 * c / F.count("*"), 6)
    return x.groupBy("period", "field").agg(F.count("*").alias("n_rows"), pct(F.count("v")).alias("non_null_pct"), pct(F.count_if(F.col("v") == 0)).alias("zero_pct"), F.count_distinct("v").alias("n_distinct"), F.min("v").alias("least"), F.round(F.median("v"), 6).alias("median"), F.max("v").alias("most"))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS code, count(*) AS n_rows FROM orders GROUP BY 1, 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 1, 2")
def code_profile(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "orders").select("o_orderstatus", "o_orderpriority").unpivot([], ["o_orderstatus", "o_orderpriority"], "field", "code")
    return x.groupBy("field", "code").agg(F.count("*").alias("n_rows"))


@query(f"WITH p AS ({R._PARTS}), n AS (SELECT period, count(*) AS n_entities, count(*) FILTER (WHERE loans > 0) AS with_loans FROM p GROUP BY 1), g AS (SELECT *, lag(n_entities) OVER (ORDER BY period) AS before FROM n) SELECT *, coalesce(abs(n_entities - before) > 0.1 * before, FALSE) AS discontinuity, with_loans < 0.99 * n_entities AS incomplete FROM g")
def period_summary(s: SparkSession, d: str) -> DataFrame:
    """Population of each period against the one before, and completeness of a field. The window runs over one row a period."""
    n = R.filings(s, d, "l_partkey").groupBy("period").agg(F.count("*").alias("n_entities"), F.count_if(F.col("loans") > 0).alias("with_loans"))
    g = n.withColumn("before", F.lag("n_entities").over(Window.orderBy("period")))
    return g.withColumns({"discontinuity": F.coalesce(F.abs(F.col("n_entities") - F.col("before")) > 0.1 * F.col("before"), F.lit(False)), "incomplete": F.col("with_loans") < 0.99 * F.col("n_entities")})


@query(f"WITH {controls._FEATURES_SQL}, {controls._PANEL_SQL}, j AS (SELECT abs(f.equity_to_assets - 100.0 * p.equity / p.asset) AS gap FROM fe f JOIN pa p USING (entity, period) WHERE p.asset > 0) SELECT count(*) AS n_rows, count(*) FILTER (WHERE gap <= 1e-10) AS n_equal, CAST(count(*) FILTER (WHERE gap > 1e-10) AS BIGINT) AS n_different FROM j")
def identity_check(s: SparkSession, d: str) -> DataFrame:
    """A ratio against its definition within 1e-10, computed from the measures anew."""
    p = R.filings(s, d, "l_partkey").select("entity", "period", "asset", "equity").where("asset > 0")
    gap = F.abs(F.col("equity_to_assets") - 100.0 * F.col("equity") / F.col("asset"))
    x = controls._features(s, d).select("entity", "period", "equity_to_assets").join(p, ["entity", "period"]).withColumn("gap", gap)
    return x.agg(F.count("*").alias("n_rows"), F.count_if(F.col("gap") <= 1e-10).alias("n_equal"), F.count_if(F.col("gap") > 1e-10).alias("n_different"))


@query("WITH f AS (SELECT l_partkey AS entity, l_suppkey AS alias, CAST(min(l_shipdate) AS DATE) AS since FROM lineitem GROUP BY 1, 2) SELECT entity, count(*) AS n_aliases, string_agg(alias || '@' || strftime(since, '%Y-%m-%d'), ' > ' ORDER BY since, alias) AS sequence FROM f GROUP BY 1 HAVING count(*) > 1")
def sequential_mappings(s: SparkSession, d: str) -> DataFrame:
    """Entities whose second id changes, with the ids in the order in which they appear."""
    f = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("alias")).agg(F.min("l_shipdate").cast("date").alias("since"))
    x = f.groupBy("entity").agg(F.count("*").alias("n_aliases"), F.array_sort(F.collect_list(F.struct("since", "alias"))).alias("a")).where("n_aliases > 1")
    return x.select("entity", "n_aliases", F.array_join(F.transform("a", lambda r: F.concat(r["alias"].cast("string"), F.lit("@"), F.date_format(r["since"], "yyyy-MM-dd"))), " > ").alias("sequence"))


#: event class: codes, word and flag, the first that holds; what none takes is OTHER
_TAXONOMY_SQL = "CASE WHEN event_type IN ('error') THEN 'FAILURE' WHEN event_type LIKE '%sign%' THEN 'NEW_ENTITY' WHEN value >= 90 THEN 'LARGE_TRANSFER' WHEN event_type IN ('purchase', 'click') THEN 'ACTIVITY' ELSE 'OTHER' END"


@query(f"SELECT {_TAXONOMY_SQL} AS class, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_entities FROM events GROUP BY 1, 2")
def event_taxonomy(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error"), "FAILURE").when(F.col("event_type").contains("sign"), "NEW_ENTITY").when(F.col("value") >= 90, "LARGE_TRANSFER").when(F.col("event_type").isin("purchase", "click"), "ACTIVITY").otherwise("OTHER")
    return table(s, d, "events").withColumn("class", kind).groupBy("class", "event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_entities"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END, -1) AS role_id, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey IS NOT NULL THEN 'customer' WHEN o_orderkey % 3 <> 0 THEN 'order' ELSE 'none' END AS role_used, coalesce(nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END), ''), 'row-' || md5(o_orderkey || '|' || o_orderstatus)) AS record_ref FROM orders")
def role_ids(s: SparkSession, d: str) -> DataFrame:
    """The first id among several roles with the role's name, and a record reference made of the content where the given one is blank."""
    o = table(s, d, "orders")
    roles = (("customer", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))), ("order", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))))
    used = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in roles], F.lit("none"))
    given = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority"))
    ref = F.coalesce(C.blank_to_null(given), F.concat(F.lit("row-"), F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"))))
    return o.select("o_orderkey", F.coalesce(*[c for _, c in roles], F.lit(-1)).alias("role_id"), used.alias("role_used"), ref.alias("record_ref"))


@query("SELECT s.s_suppkey AS id, 'supplier' AS source, s_name AS name FROM supplier s UNION ALL SELECT c_custkey, 'customer', c_name FROM customer UNION ALL SELECT DISTINCT l_suppkey, 'lineitem', NULL FROM lineitem UNION ALL SELECT DISTINCT user_id, 'events', NULL FROM events WHERE user_id IS NOT NULL")
def identifier_crosswalk(s: SparkSession, d: str) -> DataFrame:
    """The ids of four sources, one below the other, with the source's name and its own name of the entity."""
    part = lambda t, k, n: table(s, d, t).select(F.col(k).alias("id"), F.lit(t).alias("source"), (F.col(n) if n else F.lit(None).cast("string")).alias("name"))
    facts = part("lineitem", "l_suppkey", None).unionByName(part("events", "user_id", None)).where("id is not null").distinct()
    return part("supplier", "s_suppkey", "s_name").unionByName(part("customer", "c_custkey", "c_name")).unionByName(facts)


@query(f"WITH p AS ({R._SUPPLIERS}) SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT period FROM p WHERE period BETWEEN DATE '1995-03-31' AND DATE '2000-12-31')) AS BIGINT) AS n_found, CAST((SELECT count(*) FROM (SELECT CAST(last_day(x) AS DATE) FROM range(TIMESTAMP '1995-03-31', TIMESTAMP '2001-01-15', INTERVAL 3 MONTH) r(x) EXCEPT SELECT period FROM p)) AS BIGINT) AS n_missing, CAST((SELECT count(*) FROM (SELECT DISTINCT period FROM p WHERE period < DATE '1995-03-31' OR period > DATE '2000-12-31')) AS BIGINT) AS n_unexpected")
def period_set_check(s: SparkSession, d: str) -> DataFrame:
    """The panel's periods against the expected set: found, missing, unexpected. Each side is a row per period."""
    found = R.filings(s, d).select("period").distinct().withColumn("f", F.lit(1))
    want = Q.period_range(s, "1995-03-31", "2000-12-31").withColumn("w", F.lit(1))
    x = found.join(want, "period", "full")
    return x.agg(F.count_if(F.col("f").isNotNull() & F.col("w").isNotNull()).alias("n_found"), F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_unexpected"))


@query("""WITH v AS (SELECT 'o_orderkey' AS field, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders)
SELECT field, CASE WHEN count(v) = 0 THEN 'null' WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean' WHEN bool_and(regexp_full_match(v, '[+-]?\\d+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')) THEN 'number' ELSE 'string' END AS inferred FROM v GROUP BY 1""")
def type_inference(s: SparkSession, d: str) -> DataFrame:
    """The narrowest type that all values of a text field fit: null, boolean, integer, number, string."""
    names = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    v = table(s, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "field", "v")
    fits = lambda c: F.bool_and(c)
    kind = F.when(F.count("v") == 0, "null").when(fits(F.lower("v").isin("true", "false")), "boolean").when(fits(F.col("v").rlike(r"^[+-]?\d+$")), "integer").when(fits(F.col("v").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), "number").otherwise("string")
    return v.groupBy("field").agg(kind.alias("inferred"))


_RANKED_SQL = f"{controls._FEATURES_SQL}, sc AS (SELECT entity, period, consecutive_loss_quarters + coalesce(efficiency_ratio, 0) / 100 AS score FROM fe), rk AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS position, count(*) OVER (PARTITION BY period) AS n FROM sc), fl AS (SELECT *, position <= greatest(1, ceil(n * 5 / 100.0)) AS flagged FROM rk)"


def _ranked(s: SparkSession, d: str) -> DataFrame:
    fe = controls._features(s, d)
    x = fe.select("entity", "period", "equity_to_assets", "loans_to_deposits", "return_on_assets", (F.col("consecutive_loss_quarters") + F.coalesce(F.col("efficiency_ratio"), F.lit(0)) / 100).alias("score"))
    return panel.budget_flags(x, "period", "score", "entity", [5])


@query(f"WITH {_RANKED_SQL} SELECT fl.entity, fl.period, round(score, 9) AS score, fe.equity_to_assets, fe.loans_to_deposits, fe.return_on_assets, CAST(flagged AS INTEGER) AS flagged FROM fl JOIN fe USING (entity, period)")
def score_history(s: SparkSession, d: str) -> DataFrame:
    """Each entity's scores over time beside the indicators they rest on."""
    return _ranked(s, d).select("entity", "period", F.round("score", 9).alias("score"), "equity_to_assets", "loans_to_deposits", "return_on_assets", F.col("top_5pct").alias("flagged"))


@query(f"WITH {_RANKED_SQL}, dv AS (SELECT entity, period, unnest(['equity', 'loans', 'return']) AS driver, unnest([-coalesce(equity_to_assets, 0), coalesce(loans_to_deposits, 0), -coalesce(return_on_assets, 0)]) AS weight FROM fe), dn AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY weight DESC, driver) AS k FROM dv) SELECT fl.entity, fl.period, max(driver) FILTER (WHERE k = 1) AS driver_1, max(driver) FILTER (WHERE k = 2) AS driver_2, max(driver) FILTER (WHERE k = 3) AS driver_3, round(max(weight) FILTER (WHERE k = 1), 6) AS weight_1 FROM fl JOIN dn USING (entity, period) WHERE flagged AND fl.period = (SELECT max(period) FROM fl) GROUP BY 1, 2")
def watchlist_drivers(s: SparkSession, d: str) -> DataFrame:
    """The latest period's flagged entities with their three drivers side by side."""
    x = _ranked(s, d)
    last = x.agg(F.max("period").alias("period"))
    x = x.where("top_5pct = 1").join(F.broadcast(last), "period")  # one row
    drivers = F.array(*[F.struct(w.alias("w"), F.lit(n).alias("n")) for n, w in (("equity", -F.coalesce("equity_to_assets", F.lit(0.0))), ("loans", F.coalesce("loans_to_deposits", F.lit(0.0))), ("return", -F.coalesce("return_on_assets", F.lit(0.0))))])
    down = F.array_sort(drivers, lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).when(a["n"] < b["n"], -1).otherwise(1))
    return x.withColumn("v", down).select("entity", "period", *[F.get("v", i)["n"].alias(f"driver_{i + 1}") for i in range(3)], F.round(F.get("v", 0)["w"], 6).alias("weight_1"))


@query(f"WITH {R._GROUPS_SQL}, sm AS (SELECT peer_group, count(*) AS n, CAST(sum(CAST(equity_ratio AS DECIMAL(18,6))) AS DOUBLE) / count(equity_ratio) AS peer_mean, median(equity_ratio) AS peer_median FROM g GROUP BY 1) SELECT entity, period, g.peer_group, equity_ratio, n AS peer_count, peer_mean, round(equity_ratio - peer_median, 6) AS difference FROM g JOIN sm USING (peer_group) WHERE period = (SELECT max(period) FROM g)")
def peer_table(s: SparkSession, d: str) -> DataFrame:
    """The latest period's rows beside their peer group's mean and median."""
    g = R._groups(s, d)
    g = g.join(F.broadcast(g.agg(F.max("period").alias("period"))), "period")  # one row
    own = Window.partitionBy("peer_group")
    x = g.withColumns({"peer_count": F.count("*").over(own), "peer_mean": F.sum(F.col("equity_ratio").cast("decimal(18,6)")).over(own).cast("double") / F.count("equity_ratio").over(own), "m": F.median("equity_ratio").over(own)})
    return x.select("entity", "period", "peer_group", "equity_ratio", "peer_count", "peer_mean", F.round(F.col("equity_ratio") - F.col("m"), 6).alias("difference"))


#: role: which flagged or unflagged row of the latest labelled period plays it, by an order
_ROLES = (("highest_score", "TRUE", "score DESC"), ("lowest_score", "TRUE", "score"), ("flagged_lowest", "flagged", "score"), ("unflagged_highest", "NOT flagged", "score DESC"), ("no_such_case", "score < -1", "score"))


@query(f"WITH {_RANKED_SQL}, lt AS (SELECT * FROM fl WHERE period = (SELECT max(period) FROM fl)) " + " UNION ALL ".join(f"SELECT '{n}' AS role, (SELECT entity FROM lt WHERE {w} ORDER BY {o}, entity LIMIT 1) AS entity, CASE WHEN EXISTS (SELECT 1 FROM lt WHERE {w}) THEN 'available' ELSE 'unavailable' END AS state" for n, w, o in _ROLES))
def case_selection(s: SparkSession, d: str) -> DataFrame:
    """One entity for each role by fixed rules, in one pass over the latest period; a role nobody fits is unavailable."""
    x = _ranked(s, d)
    x = x.join(F.broadcast(x.agg(F.max("period").alias("period"))), "period").withColumn("flagged", F.col("top_5pct") == 1)  # one row
    picks = [F.min(F.when(F.expr(w), F.struct((-F.col("score") if "DESC" in o else F.col("score")).alias("o"), "entity"))).alias(n) for n, w, o in _ROLES]
    one = x.agg(*picks).select(F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(n)["entity"].alias("entity")) for n, _, _ in _ROLES])).alias("r")).select("r.*")
    return one.withColumn("state", F.when(F.col("entity").isNull(), "unavailable").otherwise("available"))


_CLAIM = r"(?i)\b(guarantee[sd]?|license[sd]?|certif\w+|rights reserved)\b"
_GOVERNED = r"(?i)\b(under|terms|notice|without|not)\b"


@query(f"WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) SELECT doc_id, CAST(n AS INTEGER) AS line_number, lower(regexp_extract(line, '{_CLAIM}')) AS claim, CASE WHEN regexp_matches(line, '{_GOVERNED}') THEN 'GOVERNED' ELSE 'UNSUPPORTED' END AS status FROM l WHERE regexp_matches(line, '{_CLAIM}')")
def claim_audit(s: SparkSession, d: str) -> DataFrame:
    """Every line that makes a claim, and whether the same line holds what governs it."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line")).where(F.col("line").rlike(_CLAIM))
    status = F.when(F.col("line").rlike(_GOVERNED), "GOVERNED").otherwise("UNSUPPORTED")
    return lines.select("doc_id", (F.col("n") + 1).alias("line_number"), F.lower(F.regexp_extract("line", _CLAIM, 0)).alias("claim"), status.alias("status"))


@query("WITH m AS (SELECT l_returnflag AS flag, year(l_shipdate) AS yr, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2) SELECT yr AS year, max(q) FILTER (WHERE flag = 'A') AS a, max(q) FILTER (WHERE flag = 'N') AS n, max(q) FILTER (WHERE flag = 'R') AS r FROM m GROUP BY 1")
def metric_pivot(s: SparkSession, d: str) -> DataFrame:
    """Long metrics to wide ones: a column for each of the named flags."""
    x = table(s, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), "l_returnflag", F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    return x.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("q").cast("double")).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})
