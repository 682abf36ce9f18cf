import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import events, features, metrics, models, ranking, text_scan


def test_parsing(spark):
    row = spark.createDataFrame([(" 12 ", "12.5", "3/1/2024", "nan")], "a string, b string, d string, x string").select(C.safe_long(F.col("a")), C.safe_long(F.col("b")), C.safe_date(F.col("d"), ["M/d/yyyy"]), C.finite_number(F.col("x"))).first()
    assert tuple(row) == (12, None, dt.date(2024, 3, 1), None)


def test_sixty_five_features():
    assert len(features.feature_columns()) == 65 == len(set(features.feature_columns()))


def test_label_boundaries(spark):
    end = dt.date(2024, 3, 31)
    for day, status in ((dt.date(2024, 4, 1), "POSITIVE"), (dt.date(2025, 3, 31), "POSITIVE"), (dt.date(2025, 4, 1), "NEGATIVE"), (dt.date(2024, 3, 31), "INELIGIBLE_POST_EVENT")):
        p = spark.createDataFrame([(1, end, False)], "e int, p date, blocked boolean")
        ev = spark.createDataFrame([(1, day, "FAILURE")], "e int, event_date date, event_type string")
        out = events.outcome_labels(events.prior_event(events.next_event(p, ev, "e", "p"), ev, "e", "p"), "e", "p", 12, "2026-01-01", min_history=1)
        assert out.first()["status"] == status


def test_ranking_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    row = metrics.ranking_metrics(df, "s", "y").first()
    assert (row.average_precision, row.roc_auc) == (0.5, 0.75)


def test_rank_scores(spark):
    days = [dt.date(2024, 3, 31), dt.date(2024, 6, 30)]
    df = spark.createDataFrame([(e, p, float((e * (i + 1)) % 21)) for i, p in enumerate(days) for e in range(1, 21)], "e int, p date, s double")
    got = {(r.e, r.p): r for r in ranking.rank_scores(df, "e", "p", "s").collect()}
    assert sum(r.top_5pct for r in got.values()) == 2 and sum(r.top_10pct for r in got.values()) == 4
    top = got[(20, days[0])]
    assert (top.score_rank, top.percentile, top.tier, top.alert, top.change_1q) == (1, 100.0, "Highest monitored tier", "Top-5% review", None)
    assert got[(10, days[1])].tier == "Highest monitored tier" and got[(10, days[1])].change_1q > 0
    assert ranking.rank_scores(df.limit(0), "e", "p", "s").count() == 0


def test_best_threshold_takes_the_greater_of_equals(spark):
    df = spark.createDataFrame([(i / 100, int(i >= 90)) for i in range(100)], "s double, y int")
    row = ranking.best_f2_threshold(df, "s", "y").first()
    brute = max((5 * sum(i >= 90 for i in range(100) if i / 100 >= t) / (40 + sum(i / 100 >= t for i in range(100))), t) for t in (j / 100 for j in range(70, 100)))
    assert row.f2 == pytest.approx(brute[0]) and 0.89 < row.threshold <= 0.9


def test_events_are_captured_once(spark):
    day = dt.date(2025, 1, 15)
    rows = [(1, dt.date(2024, 3, 31), 0.9, 1), (1, dt.date(2024, 6, 30), 0.1, 1), (2, dt.date(2024, 3, 31), 0.5, 0), (2, dt.date(2024, 6, 30), 0.5, 0)]
    got = ranking.event_capture(spark.createDataFrame([(*r, day) for r in rows], "e int, p date, s double, y int, d date"), "e", "p", "s", "d", "y").collect()
    assert [(r.captured, r.first_alert, r.alerted_periods, r.lead_days) for r in got] == [(True, dt.date(2024, 3, 31), 1, 290)]


def test_windows_may_not_overlap():
    with pytest.raises(ValueError):
        models.check_windows([("a", "2020-01-01", "2020-12-31"), ("b", "2020-12-31", "2021-12-31")])


def test_fitted_model(spark):
    df = spark.createDataFrame([(i, float(i % 10) if i % 7 else None, float(i % 3), int(i % 10 > 6)) for i in range(200)], "k int, a double, b double, target int")
    fitted = models.fit(df, ["a", "b"], models.candidates()["logistic_l2"])
    scored = fitted.score(df)
    assert scored.columns == [*df.columns, "probability"] and scored.where("a >= 7 and probability < 0.5").count() == 0
    drivers = models.local_drivers(fitted, df, ["k"], ["a", "b"], 1).where("k = 9").first()
    assert drivers.feature == "a" and drivers.score_delta > 0 and drivers.reference == fitted.medians["a"]
    assert models.platt(scored, scored).where("calibrated is null").count() == 0


def test_each_line_of_a_phrase_is_judged(spark):
    docs = spark.createDataFrame([(1, "This is not a PASSWORD\nplain\r\npassword and license here"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in text_scan.scan_phrase_lines(docs, "doc_id", "text", ["license", "password"]).select("line_number", "phrase", "status").collect())
    assert got == [(1, "password", "ALLOWED"), (3, "license", "UNRESOLVED"), (3, "password", "UNRESOLVED")]


def test_all_folds_are_validated(monkeypatch):
    from panelwright.plans import reports

    folds = []
    monkeypatch.setattr(reports, "_model_rows", lambda s, d: type("Rows", (), {"cache": lambda self: self})())
    monkeypatch.setattr(reports.models, "cross_validate", lambda rows, columns, given: folds.extend(given))
    reports.model_cross_validation(None, "")
    assert tuple(folds) == reports.FOLDS


def test_threshold_curve_and_quantiles_against_brute_force(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(3000), 3) ** 2, rng.integers(0, 2, 3000)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    got = {r.threshold: (r.tp, r.fp) for r in ranking.threshold_curve(df, "s", "y").collect()}
    assert got == {t: (int(y[s >= t].sum()), int((1 - y[s >= t]).sum())) for t in set(s.tolist())}
    marks = np.quantile(s, np.linspace(0.70, 0.999, 200))
    f2 = [5 * y[s >= m - 1e-12].sum() / (4 * y.sum() + (s >= m - 1e-12).sum()) for m in marks]
    best = max(zip(np.round(f2, 9), marks, strict=True))
    row = ranking.best_f2_threshold(df, "s", "y").first()
    assert abs(row.threshold - best[1]) < 1e-9 and abs(row.f2 - best[0]) < 1e-8
    assert ranking.threshold_curve(df.limit(0), "s", "y").count() == 0
    assert ranking.best_f2_threshold(df.limit(0), "s", "y").count() == 0


def test_ungrouped_ranking_metrics_equal_grouped_ones(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "s": np.round(rng.random(2000), 3), "y": rng.integers(0, 2, 2000)}))
    df = df.unionByName(spark.createDataFrame([(1, None, 1), (1, None, 0)], "g long, s double, y long"))
    assert metrics.ranking_metrics(df, "s", "y").first() == metrics.ranking_metrics(df, "s", "y", ("g",)).drop("g").first()
    assert [tuple(r) for r in metrics.ranking_metrics(df.limit(0), "s", "y").collect()] == [(None,) * 4]  # one row, as of any global aggregate
