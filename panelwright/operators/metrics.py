"""Exact, tie-aware metrics of scored binary outcomes, per group, without global sorts of single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.panel import running_totals

#: The distribution function of Poisson(1) at 0 to 4; a uniform number past the k-th of them makes k copies.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def ranking_metrics(df: DataFrame, score: str, target: str, groups: Sequence[str] = (), weight: str | None = None, ranged: bool = False) -> DataFrame:
    """Average precision (step form) and ROC AUC per group, ties counted as one step; weighted where asked.

    A group's distinct scores are summed up in one task; ``ranged`` cuts them into ranges, for groups with many (their names aren't null).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return _by_score_metrics(df.groupBy(*groups, score).agg(F.sum(w).alias("n"), F.sum(w * F.col(target)).alias("t")), score, groups, ranged)


def _by_score_metrics(by_score: DataFrame, score: str, groups: Sequence[str], ranged: bool = False) -> DataFrame:
    """The same from the rows n and positives t of each score."""
    if groups and not ranged:
        down = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
        all_rows = Window.partitionBy(*groups)
        x = by_score.withColumns({"cn": F.sum("n").over(down), "ct": F.sum("t").over(down), "tn": F.sum("n").over(all_rows), "tt": F.sum("t").over(all_rows)})
    else:
        x = running_totals(by_score, score, ["n", "t"], groups).withColumnsRenamed({"run_n": "cn", "run_t": "ct", "all_n": "tn", "all_t": "tt"})
    ap = F.sum(F.when(F.col("cn") > 0, F.col("t") / F.col("tt") * F.col("ct") / F.col("cn")))
    auc = F.sum(F.col("t") * ((F.col("tn") - F.col("tt")) - (F.col("cn") - F.col("ct")) + (F.col("n") - F.col("t")) / 2) / (F.col("tt") * (F.col("tn") - F.col("tt"))))
    x = x.where("tt > 0 and tn > tt")
    return x.groupBy(*groups).agg(F.max("tn").alias("n_rows"), F.max("tt").alias("positives"), F.round(ap, 6).alias("average_precision"), F.round(auc, 6).alias("roc_auc"))


def threshold_metrics(df: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(target) == 1
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    d = lambda n, m: F.when(m > 0, n.cast("double") / m)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "specificity": d(tn, tn + fp), "f1": d(2 * tp, 2 * tp + fp + fn), "f2": d(5 * tp, 5 * tp + 4 * fn + fp), "accuracy": d(tp + tn, tp + fp + fn + tn)})
    return c.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def reliability(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and observed rate per right-closed bin of the score."""
    b = F.greatest(F.lit(1), F.ceil(F.col(score) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n_rows"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(target), 6).alias("observed_rate"))


def probability_errors(df: DataFrame, score: str, target: str) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-12)), F.lit(1e-12))
    y = F.col(target)
    return df.agg(F.round(F.avg((F.col(score) - y) * (F.col(score) - y)), 6).alias("brier"), F.round(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))), 6).alias("log_loss"))


def cluster_bootstrap(df: DataFrame, entity: str, score: str, target: str, draws: int = 50) -> DataFrame:
    """Ranking metrics of each draw of whole entities; an entity's multiplicity comes from a hash of (draw, entity).

    Draw counts follow the Poisson bootstrap: the hash as a uniform number through the Poisson(1) distribution.
    The rows are summed by entity and score once and the draws made of distinct entities, so a draw costs no scan.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(entity).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum(((h >= c).cast("int") for c in POISSON), F.lit(0))
    rows = df.groupBy(entity, score).agg(F.count("*").cast("double").alias("n"), F.sum(target).cast("double").alias("t"))
    drawn = df.select(entity).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("times", times).where("times > 0")
    x = rows.join(drawn, entity).groupBy("rep", score).agg(F.sum(F.col("times") * F.col("n")).alias("n"), F.sum(F.col("times") * F.col("t")).alias("t"))
    return _by_score_metrics(x, score, ("rep",))


def event_bootstrap(events: DataFrame, keys: Sequence[str], captured: str, draws: int = 200) -> DataFrame:
    """(rep, n_events, capture_rate) of draws of whole events: an event's multiplicity comes from a hash of (draw, keys) through Poisson(1).

    A row for each event and draw, summed at once; a draw without events has a null rate.
    """
    named = F.concat_ws("|", F.col("rep").cast("string"), *[F.col(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum(((h >= c).cast("int") for c in POISSON), F.lit(0))
    drawn = events.select(*keys, F.col(captured).cast("int").alias("_hit"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep")).withColumn("_n", times)
    return drawn.groupBy("rep").agg(F.sum("_n").alias("n_events"), F.round(F.try_divide(F.sum(F.col("_n") * F.col("_hit")).cast("double"), F.sum("_n")), 6).alias("capture_rate"))


def bootstrap_interval(draws: DataFrame, metric: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Number of draws, mean and the interval of a metric over :func:`cluster_bootstrap`'s draws."""
    q = F.percentile(metric, F.array(F.lit(low), F.lit(high)))
    x = draws.agg(F.count(metric).alias("n_draws"), F.avg(metric).alias("mean"), q.alias("q"))
    return x.select(F.lit(metric).alias("metric"), "n_draws", F.round("mean", 6).alias("mean"), F.round(F.get("q", 0), 6).alias("low"), F.round(F.get("q", 1), 6).alias("high"))


def calibration_error(df: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: the mean gap of score and rate over right-closed bins, weighted by their rows."""
    b = F.greatest(F.lit(1), F.ceil(F.col(score) * bins)).cast("int")
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(score) - F.avg(target)).alias("gap"))
    return per.agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_rows"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def matthews(df: DataFrame, score: str, target: str, threshold: float, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and Matthews correlation at a threshold, per group; null where a margin is empty."""
    p, y = F.col(score) >= threshold, F.col(target) == 1
    c = df.groupBy(*groups).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return c.withColumn("mcc", F.when(margins > 0, F.round((tp * tn - fp * fn) / F.sqrt(margins), 6)))


def subgroup_metrics(df: DataFrame, score: str, target: str, group: str) -> DataFrame:
    """Rows, positives, average precision, its lift over no skill and ROC AUC of each group, with how far they can be relied on."""
    n = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(target).cast("long").alias("positives"))
    ranked = ranking_metrics(df, score, target, (group,)).select(group, "average_precision", "roc_auc")
    reliability_class = F.when(F.col("positives") == 0, "INSUFFICIENT_EVENTS").when(F.col("positives") < 10, "REPORT_WITH_CAUTION").otherwise("RELIABLE")
    lift = F.round(F.col("average_precision") / (F.col("positives") / F.col("n_rows")), 4)
    return n.join(ranked, group, "left").withColumns({"reliability": reliability_class, "lift": lift})
