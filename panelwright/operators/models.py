"""Outcome models on Spark ML: date splits, training-only preparation, candidates, calibration, scores and drivers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.columns import sanitised, sigmoid
from panelwright.operators.metrics import probability_errors, ranking_metrics
from panelwright.operators.panel import best_by
from panelwright.sources.scratch import kept

OUTSIDE = "OUTSIDE_PROTOCOL"


def check_windows(windows: Sequence[tuple[str, str, str]]) -> None:
    """Raises where two of the (name, first day, last day) windows share a day."""
    in_order = sorted((date.fromisoformat(a), date.fromisoformat(b), n) for n, a, b in windows)
    for (_, end, left), (start, _, right) in zip(in_order, in_order[1:], strict=False):
        if end >= start:
            raise ValueError(f"windows {left} and {right} overlap")


def split_of(period: Column, windows: Sequence[tuple[str, str, str]]) -> Column:
    check_windows(windows)
    out = F
    for name, first, last in windows:
        out = out.when(period.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name)
    return out.otherwise(OUTSIDE)


def train_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows, one number per feature; 0 where a feature has no value at all."""
    row = train.agg(*[F.median(sanitised(F.col(c))).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def prepared(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Features with the training medians in place of missing values, and ``<c>_missing`` indicators."""
    gone = {c: sanitised(F.col(c)) for c in medians}
    return df.withColumns({f"{c}_missing": gone[c].isNull().cast("double") for c in medians}).withColumns({c: F.coalesce(gone[c], F.lit(m)) for c, m in medians.items()})


def rule_score(train: DataFrame, df: DataFrame, signs: dict[str, int]) -> DataFrame:
    """Adds ``rule_score``: the logistic of the mean signed z of the features, all moments from the training rows."""
    medians = train_medians(train, list(signs))
    filled = lambda c: F.coalesce(sanitised(F.col(c)), F.lit(medians[c]))
    row = train.agg(*[F.avg(filled(c)).alias(f"m_{c}") for c in signs], *[F.stddev_pop(filled(c)).alias(f"s_{c}") for c in signs]).first()
    z = [s * (filled(c) - F.lit(row[f"m_{c}"] or 0.0)) / F.lit(row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) > 1e-12 else 1.0) for c, s in signs.items()]
    return df.withColumn("rule_score", sigmoid(sum(z[1:], z[0]) / len(z)))


def candidates(seed: int = 7) -> dict[str, object]:
    """The estimators of each family; all weigh the classes evenly by ``class_weight``."""
    common = dict(featuresCol="features", labelCol="target", weightCol="class_weight")
    return {
        "logistic": LogisticRegression(**common, maxIter=50),
        "logistic_l2": LogisticRegression(**common, maxIter=50, regParam=0.01),
        "logistic_elastic_net": LogisticRegression(**common, maxIter=50, regParam=0.01, elasticNetParam=0.5),
        "forest": RandomForestClassifier(**common, numTrees=20, maxDepth=6, minInstancesPerNode=20, featureSubsetStrategy="sqrt", seed=seed),
        "boosting": GBTClassifier(**common, maxIter=10, maxDepth=3, stepSize=0.1, seed=seed),
    }


class Fitted:
    """A fitted candidate with the training medians that its rows are completed with."""

    def __init__(self, model: PipelineModel, medians: dict[str, float]):
        self.model, self.medians = model, medians

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """``df`` with the probability of the positive class; its own columns stay as they are."""
        keep = df.columns
        row = df.withColumn("_row", F.struct(*keep))
        out = self.model.transform(prepared(row, self.medians))
        return out.select("_row.*", vector_to_array("_p").getItem(1).alias(name))


def _vectors(train: DataFrame, columns: Sequence[str]) -> tuple[PipelineModel, dict[str, float], DataFrame]:
    """(stages that make the scaled vector, training medians, the training rows with vector and class weights); all from ``train`` alone."""
    medians = train_medians(train, columns)
    n = train.agg(F.count("*").alias("n"), F.sum("target").alias("p")).first()
    if not n.p or n.p == n.n:
        raise ValueError("training rows need both classes")
    weighted = prepared(train, medians).withColumn("class_weight", F.when(F.col("target") == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p))))
    names = [*columns, *[f"{c}_missing" for c in columns]]
    stages = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(weighted)
    return stages, medians, stages.transform(weighted).drop("_raw")


def _fitted(stages: PipelineModel, medians: dict[str, float], rows: DataFrame, estimator) -> Fitted:
    model = estimator.copy({estimator.probabilityCol: "_p"}).fit(rows)
    return Fitted(PipelineModel([*stages.stages, model]), medians)


def fit(train: DataFrame, columns: Sequence[str], estimator) -> Fitted:
    """Fits one candidate; medians, scales and class weights come from ``train`` alone."""
    return _fitted(*_vectors(train, columns), estimator)


#: Fold metrics of a candidate.
_CV = "model string, fold int, n_rows long, positives long, average_precision double, roc_auc double, brier double"


def cross_validate(df: DataFrame, columns: Sequence[str], folds: Sequence[tuple[str, str, str]], period: str = "period", models: dict[str, object] | None = None, at_once: int = 4) -> DataFrame:
    """(model, fold, n_rows, positives, average_precision, roc_auc, brier) of expanding folds: train up to the first date, validate in the window after.

    A fold's rows are made into vectors once and kept while its candidates are fitted, ``at_once`` of them side by side. A fold
    without both classes in its training rows raises; one without both in its window has null metrics. ``df`` is made once and written, as every fold reads it several times.
    """
    df = kept(df.select(*dict.fromkeys([period, "target", *columns])), "model_rows")
    out = []
    for fold, (until, first, last) in enumerate(folds, 1):
        stages, medians, rows = _vectors(df.where(F.col(period) <= F.lit(until).cast("date")), columns)
        rows = rows.select("features", "target", "class_weight").persist()
        held = df.where(F.col(period).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).persist()

        def judged(item, fold=fold, stages=stages, medians=medians, rows=rows, held=held) -> tuple:
            scored = _fitted(stages, medians, rows, item[1]).score(held)
            m, e = ranking_metrics(scored, "probability", "target").first(), probability_errors(scored, "probability", "target").first()
            n = scored.count() if m is None else int(m.n_rows)
            return (item[0], fold, n, int(m.positives) if m else None, m.average_precision if m else None, m.roc_auc if m else None, e.brier)

        try:
            with ThreadPoolExecutor(at_once) as pool:
                out += pool.map(judged, (models or candidates()).items())
        finally:
            rows.unpersist()
            held.unpersist()
    return df.sparkSession.createDataFrame(out, _CV)


def compare_scores(df: DataFrame, scores: Mapping[str, Column], folds: Sequence[tuple[str, str, str]], period: str = "period", target: str = "target") -> DataFrame:
    """The same metrics for scores that need no fit, and for the training rows' prevalence as a constant score ("prevalence"), in one pass."""
    day = lambda x: F.lit(x).cast("date")
    sides = [(F.col(period) <= day(u), F.col(period).between(day(a), day(b))) for u, a, b in folds]
    base = df.agg(*[F.avg(F.when(t, F.col(target))).alias(f"_b{i}") for i, (t, _) in enumerate(sides)])  # one row
    rows = df.crossJoin(F.broadcast(base))
    inside = F.array(*[F.when(v, F.struct(F.lit(i).alias("fold"), F.col(f"_b{i - 1}").alias("base"))) for i, (_, v) in enumerate(sides, 1)])
    rows = rows.withColumn("_f", F.explode(F.array_compact(inside)))
    each = F.array(F.struct(F.lit("prevalence").alias("model"), F.col("_f.base").alias("score")), *[F.struct(F.lit(n).alias("model"), c.cast("double").alias("score")) for n, c in scores.items()])
    long = rows.select(F.col("_f.fold").alias("fold"), F.col(target).alias("_t"), F.inline(each))
    ranked = ranking_metrics(long, "score", "_t", ("model", "fold"), ranged=True).select("model", "fold", "average_precision", "roc_auc")
    per = long.groupBy("model", "fold").agg(F.count("*").alias("n_rows"), F.sum("_t").cast("long").alias("positives"), F.round(F.avg((F.col("score") - F.col("_t")) * (F.col("score") - F.col("_t"))), 6).alias("brier"))
    return per.join(ranked, ["model", "fold"], "left").select("model", "fold", "n_rows", "positives", "average_precision", "roc_auc", "brier")


def winners(cv: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """(scope, model, mean_ap, mean_brier, folds): the winner of each family and, as scope ALL, of all models.

    The best mean average precision wins, of equal ones the lesser mean Brier score, then the lesser name. A model
    without a family is its own.
    """
    family = F.coalesce(*[F.when(F.col("model") == m, f) for m, f in families.items()], F.col("model"))
    mean = cv.groupBy("model").agg(F.round(F.avg("average_precision"), 6).alias("mean_ap"), F.round(F.avg("brier"), 6).alias("mean_brier"), F.count("*").alias("folds"))
    scoped = mean.withColumn("scope", F.explode(F.array(F.lit("ALL"), family)))  # a row for each model and scope
    return best_by(scoped, ["scope"], [F.desc("mean_ap"), F.asc("mean_brier"), F.asc("model")]).select("scope", "model", "mean_ap", "mean_brier", "folds")


def select_winner(cv: DataFrame) -> DataFrame:
    """The one winner over all models."""
    return winners(cv, {}).where("scope = 'ALL'").drop("scope")


def platt(scored: DataFrame, df: DataFrame, column: str = "probability") -> DataFrame:
    """Adds ``calibrated``: a logistic line on the logit, fitted on ``scored``; its slope and intercept come along."""
    clipped = F.least(F.greatest(F.col(column), F.lit(1e-12)), F.lit(1 - 1e-12))
    logit = F.ln(clipped / (1 - clipped))
    rows = VectorAssembler(inputCols=["_z"], outputCol="_f").transform(scored.withColumn("_z", logit))
    line = LogisticRegression(featuresCol="_f", labelCol="target", probabilityCol="_pc", rawPredictionCol="_rc", predictionCol="_yc", maxIter=50).fit(rows)
    slope, intercept = float(line.coefficients[0]), float(line.intercept)
    return df.withColumns({"calibrated": sigmoid(slope * logit + intercept), "calibration_slope": F.lit(slope), "calibration_intercept": F.lit(intercept)})


def coefficients(fitted: Fitted, spark) -> DataFrame:
    """(feature, coefficient, odds_ratio) of a logistic candidate, on scaled features."""
    columns = list(fitted.medians)
    names = [*columns, *[f"{c}_missing" for c in columns]]
    line = fitted.model.stages[-1]
    return spark.createDataFrame(list(zip(names, map(float, line.coefficients), strict=True)), "feature string, coefficient double").withColumn("odds_ratio", F.exp("coefficient"))


def sign_stability(fitted: Sequence[Fitted], spark) -> DataFrame:
    """(feature, n_models, mean_coefficient, sign_share): how many of the fitted lines give a coefficient the sign of its mean."""
    each = None
    for f in fitted:
        part = coefficients(f, spark)
        each = part if each is None else each.unionByName(part)
    x = each.groupBy("feature").agg(F.count("*").alias("n_models"), F.avg("coefficient").alias("mean_coefficient"), F.collect_list("coefficient").alias("_c"))
    same = F.size(F.filter("_c", lambda c: F.signum(c) == F.signum(F.col("mean_coefficient"))))
    return x.select("feature", "n_models", "mean_coefficient", (same / F.col("n_models")).alias("sign_share"))


def local_drivers(fitted: Fitted, df: DataFrame, keys: Sequence[str], columns: Sequence[str], top: int = 3) -> DataFrame:
    """(keys, driver_rank, feature, score_delta, value, reference): what a row's score loses when one feature is set to its training median.

    Every row is scored once as it is and once per feature, in one job; of equal changes the feature listed first leads.
    """
    alone = F.array(F.lit(None).cast("string"), *[F.lit(c) for c in columns])
    wide = df.select(*keys, *fitted.medians).withColumn("_own", F.struct(*[F.col(c) for c in columns])).withColumn("_feature", F.explode(alone))
    changed = wide.withColumns({c: F.when(F.col("_feature") == c, F.lit(fitted.medians[c])).otherwise(F.col(c)) for c in columns})
    scored = fitted.score(changed, "_score").groupBy(*keys).agg(F.max(F.when(F.col("_feature").isNull(), F.col("_score"))).alias("base"), F.first("_own").alias("own"), F.collect_list(F.when(F.col("_feature").isNotNull(), F.struct("_feature", "_score"))).alias("alt"))
    place = {c: i for i, c in enumerate(columns)}
    order, value, reference = (F.create_map(*[x for c in columns for x in (F.lit(c), f(c))]) for f in (lambda c: F.lit(place[c]), lambda c: F.col(f"own.{c}"), lambda c: F.lit(fitted.medians[c])))
    ranked = F.transform("alt", lambda a: F.struct((-F.abs(F.col("base") - a["_score"])).alias("by"), order[a["_feature"]].alias("place"), a["_feature"].alias("feature"), (F.col("base") - a["_score"]).alias("score_delta"), value[a["_feature"]].alias("value"), reference[a["_feature"]].alias("reference")))
    out = scored.select(*keys, F.posexplode(F.slice(F.array_sort(ranked), 1, top)).alias("pos", "d"))
    return out.select(*keys, (F.col("pos") + 1).alias("driver_rank"), "d.feature", "d.score_delta", "d.value", "d.reference")
