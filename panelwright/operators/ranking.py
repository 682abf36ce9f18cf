"""Same-period rankings, alert budgets, captured events and the tables shown from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import quarter_index
from panelwright.operators.ordering import places_within
from panelwright.operators.panel import budget_flags, running_totals, within_budget

#: Lower ends of the percentile tiers, and their names.
TIERS = ((99.0, "Highest monitored tier"), (95.0, "High"), (90.0, "Elevated"), (50.0, "Moderate"))
LOWEST_TIER = "Low"


def risk_tier(percentile: Column) -> Column:
    out = F
    for low, name in TIERS:
        out = out.when(percentile >= low, name)
    return F.when(percentile.isNotNull(), out.otherwise(LOWEST_TIER))


def alert_status(percentile: Column, flagged: Column) -> Column:
    return F.when(flagged, "Top-5% review").when(percentile >= 90, "Elevated indicators").when(percentile >= 50, "Monitor").otherwise("No alert")


def rank_scores(df: DataFrame, entity: str, period: str, score: str, percents: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Adds rank with ties, percentile from 0 to 100, budget flags, tier, alert status, and changes to 1 and 4 quarters before.

    Places come from ranges of the score in each period, earlier quarters from one window over each entity's quarters, not from joins.
    """
    n, above, below = F.col("n_rows"), F.col("n_before"), F.col("n_below")
    x = places_within(df, [period], score, entity)
    x = x.withColumns({"budget_rank": F.col("place").cast("int"), "period_rows": n, **{f"top_{p}pct": within_budget(F.col("place"), n, p) for p in percents}, "score_rank": (above + 1).cast("int"), "percentile": F.round(100 * F.when(n > 1, below / (n - 1)).otherwise(0.0), 6)})
    x = x.withColumns({"tier": risk_tier(F.col("percentile")), "alert": alert_status(F.col("percentile"), F.col("top_5pct") == 1)})
    own = Window.partitionBy(entity).orderBy(quarter_index(F.col(period)))
    back = {k: F.max("percentile").over(own.rangeBetween(-k, -k)) for k in (1, 4)}
    x = x.withColumns({f"percentile_back{k}": c for k, c in back.items()})
    return x.withColumns({f"change_{k}q": F.round(F.col("percentile") - F.col(f"percentile_back{k}"), 6) for k in back}).drop("place", "n_rows", "n_before", "n_below")


def period_kpis(ranked: DataFrame, period: str) -> DataFrame:
    """Rows, flagged rows and highest tier of each period, and the change of the flagged to the period before."""
    per = ranked.groupBy(period).agg(F.count("*").alias("n_rows"), F.sum("top_5pct").alias("flagged"), F.count_if(F.col("tier") == TIERS[0][1]).alias("highest"))
    return per.withColumn("flagged_change", F.col("flagged") - F.lag("flagged").over(Window.orderBy(period)))  # a row per period


def last_periods(df: DataFrame, entity: str, period: str, n: int = 8) -> DataFrame:
    """The last ``n`` rows of each entity, the newest first."""
    w = Window.partitionBy(entity).orderBy(F.desc(period))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def budget_metrics(df: DataFrame, entity: str, period: str, score: str, target: str, percents: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(percent, alerts, captured, false_alerts, precision, recall) of alert budgets spent within each period."""
    flagged = budget_flags(df, period, score, entity, percents)
    total = flagged.agg(F.sum(target).alias("positives"), *[F.sum(f"top_{p}pct").alias(f"n{p}") for p in percents], *[F.sum(F.col(f"top_{p}pct") * F.col(target)).alias(f"t{p}") for p in percents])
    long = total.select("positives", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"n{p}").alias("alerts"), F.col(f"t{p}").alias("captured")) for p in percents])).alias("r")).select("positives", "r.*")
    return long.select("percent", "alerts", "captured", (F.col("alerts") - F.col("captured")).alias("false_alerts"), F.try_divide(F.col("captured").cast("double"), "alerts").alias("precision"), F.try_divide(F.col("captured").cast("double"), "positives").alias("recall"))


def event_capture(df: DataFrame, entity: str, period: str, score: str, event_date: str, target: str, percent: int = 5) -> DataFrame:
    """(entity, event_date, captured, first_alert, lead_days, alerted_periods, max_score) of every event ahead of positive rows."""
    flagged = budget_flags(df, period, score, entity, [percent]).where(F.col(target) == 1)
    hit = F.col(f"top_{percent}pct") == 1
    per = flagged.groupBy(entity, event_date).agg(F.min(F.when(hit, F.col(period))).alias("first_alert"), F.count_if(hit).alias("alerted_periods"), F.max(score).alias("max_score"))
    return per.withColumns({"captured": F.col("first_alert").isNotNull(), "lead_days": F.datediff(event_date, "first_alert")})


def _score_counts(df: DataFrame, score: str, target: str) -> DataFrame:
    """(threshold, n, t, run_n, run_t, all_n, all_t): rows and positives at each distinct score, at or above it, and in all."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(target).alias("t"))
    return running_totals(by, "threshold", ["n", "t"])


def _f2() -> Column:
    return F.try_divide((5 * F.col("run_t")).cast("double"), 4 * F.col("all_t") + F.col("run_n"))


def threshold_curve(df: DataFrame, score: str, target: str) -> DataFrame:
    """A row per distinct score as threshold: true and false positives, precision, recall, false positive rate and F2.

    Rows are summed by score first; the running sums over the distinct scores are made range by range.
    """
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, alerts, pos = F.col("run_t"), F.col("run_n"), F.col("all_t")
    fp = alerts - tp
    return _score_counts(df, score, target).select("threshold", tp.alias("tp"), fp.alias("fp"), d(tp, alerts).alias("precision"), d(tp, pos).alias("recall"), d(fp, F.col("all_n") - pos).alias("fpr"), _f2().alias("f2"))


def best_f2_threshold(df: DataFrame, score: str, target: str, low: float = 0.70, high: float = 0.999, steps: int = 200) -> DataFrame:
    """(threshold, f2): the best of ``steps`` interpolated quantiles of the score by F2, the greater of equal ones.

    Each distinct score knows which ranks it holds, so it names the quantiles that it is the lower or upper neighbour of. A quantile
    between two scores flags what the greater one flags and takes its F2.
    """
    at = F.array(*[F.lit(low + (high - low) * i / (steps - 1)) for i in range(steps)])
    below = F.col("all_n") - F.col("run_n")  # ranks from here to below + n - 1, the least score's first being 0
    place = lambda q: (F.col("all_n") - 1) * q
    held = lambda rank: (rank >= below) & (rank < below + F.col("n"))
    near = F.filter(at, lambda q: held(F.floor(place(q))) | held(F.ceil(place(q))))
    c = _score_counts(df, score, target).withColumn("f2", _f2()).withColumn("q", F.explode(near)).withColumn("place", place(F.col("q")))
    side = lambda rank, name: F.max(F.when(held(rank), F.struct("threshold", "f2"))).alias(name)
    marks = c.groupBy("q", "place").agg(side(F.floor("place"), "lo"), side(F.ceil("place"), "hi"))
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("lo.threshold") == F.col("hi.threshold"), F.col("lo.threshold")).otherwise((1 - share) * F.col("lo.threshold") + share * F.col("hi.threshold"))
    marks = marks.withColumn("threshold", value)
    return marks.select("threshold", F.when(F.col("threshold") == F.col("lo.threshold"), F.col("lo.f2")).otherwise(F.col("hi.f2")).alias("f2")).orderBy(F.desc("f2"), F.desc("threshold")).limit(1)
