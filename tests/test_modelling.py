"""Row numbers, samples, curves, permutations, calibration, datasets and label audits against plain versions and their SQL."""

import datetime as dt
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import calibration, dataset, importance, label_audit, metrics, models, ordering
from panelwright.plans import modelling, registry

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.queries().items() if f.__module__ == modelling.__name__ and n in registry.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    df = registry.queries()[name](spark, SMALL)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns) and got and got == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double").repartition(5)


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 50, [None] * 9 + [1.0] * 40 + [5.0, None, 3.0] * 11, [float(i * 7919 % 997) for i in range(997)]])
def test_global_index(spark, values):
    got = ordering.global_index(ordering.by_range(numbers(spark, values), F.col("v")), [F.col("v"), F.col("k")]).collect()
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert [r.k for r in sorted(got, key=lambda r: r.row_index)] == want and {r.n_rows for r in got} <= {len(values)} and [r.row_index for r in sorted(got, key=lambda r: r.row_index)] == list(range(len(values)))


def test_global_index_by_groups(spark):
    df = spark.createDataFrame([(g, hashlib.md5(f"{g}{i}".encode()).hexdigest()) for g in (None, "a", "b") for i in range(200)], "g string, d string")
    got = ordering.global_index(ordering.by_digest(df, F.col("d"), 2), [F.col("d")], groups=["g"]).collect()
    for g in (None, "a", "b"):
        own = sorted((r.d, r.row_index) for r in got if r.g == g)
        assert [i for _, i in own] == list(range(200))


@pytest.mark.parametrize("n", [0, 1, 2, 299, 300, 301, 599, 1000])
def test_evenly_spaced(spark, n):
    got = ordering.evenly_spaced(numbers(spark, [float(n - i) for i in range(n)]), F.col("v"), [F.col("v")]).collect()
    m = min(300, n)
    assert sorted((r.point, int(r.v) - 1) for r in got) == [(i, i * (n - 1) // max(1, m - 1)) for i in range(m)]


@pytest.mark.parametrize(("n", "most"), [(0, 10), (7, 10), (10, 10), (25, 10), (99, 10)])
def test_systematic_sample(spark, n, most):
    got = ordering.systematic_sample(numbers(spark, [float(i) for i in range(n)]), F.col("v"), [F.col("v")], most)
    assert sorted(int(r.v) for r in got.collect()) == list(range(n))[:: max(1, n // most)][:most]


def test_ranged_ranking_metrics(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"g{g}", float(rng.integers(0, 60)) / 60, int(rng.random() < 0.3)) for g in range(3) for _ in range(400)], "g string, s double, t int")
    plain, ranged = (sorted(map(tuple, metrics.ranking_metrics(df, "s", "t", ("g",), ranged=r).collect())) for r in (False, True))
    assert plain == ranged and len(plain) == 3


def test_permutation_is_one_and_matters(spark):
    """Each repeat deals every row's values out once; a feature that the score ignores has no importance."""
    rows = [(i, int(i % 10 == 0), float(i % 10 == 0) * 5 + i % 3, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, target int, a double, b double")
    dealt = importance._dealt(df, ["k"], ["a", "b"], 2).collect()
    for repeat in (1, 2):
        own = [r for r in dealt if r.repeat == repeat]
        assert sorted(r.k for r in own) == list(range(500)) and sorted((r._other.a, r._other.b) for r in own) == sorted(r[2:] for r in rows)
        digest = lambda r, p="": hashlib.md5(f"{p}{r}".encode()).hexdigest()
        base, other = sorted(range(500), key=digest), sorted(range(500), key=lambda r, p=f"{repeat}|": digest(r, p))
        pair = dict(zip(base, other, strict=True))
        assert all((r._other.a, r._other.b) == rows[pair[r.k]][2:] for r in own)
    got = {r.feature: r for r in importance.permutation_importance(df, ["k"], ["a", "b"], lambda x: x.withColumn("score", F.col("a")), "target").collect()}
    assert got["a"].base_ap == 1.0 and got["a"].importance_mean > 0.5 and (got["b"].importance_mean, got["b"].importance_std) == (0.0, 0.0)


def pooled(points):
    """Pool-adjacent-violators by hand: (score, weight, mean) in order of the score."""
    blocks = []
    for x, w, y in points:
        blocks.append([[x], w, y])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], a[1] + b[1], (a[1] * a[2] + b[1] * b[2]) / (a[1] + b[1])])
    return {x: m for xs, _, m in blocks for x in xs}


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_against_pooling(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(float(s) / 20, int(rng.random() < s / 25)) for s in rng.integers(0, 21, 300)]
    df = spark.createDataFrame(rows, "s double, t int").repartition(4)
    by = {}
    for s, t in rows:
        by.setdefault(s, []).append(t)
    want = pooled([(s, len(t), sum(t) / len(t)) for s, t in sorted(by.items())])
    got = {r.s: r.fitted for r in calibration.isotonic_blocks(df, "s", "t").collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    ends = spark.createDataFrame([(-1.0,), (9.0,), (None,)], "s double")
    out = [r.isotonic for r in calibration.isotonic(df, ends, "s", "t").orderBy(F.col("s").asc_nulls_last()).collect()]
    assert abs(out[0] - min(want.values())) < 1e-9 and abs(out[1] - max(want.values())) < 1e-9 and out[2] is None


def test_calibrators_need_classes_and_positives(spark):
    df = spark.createDataFrame([(i / 100, int(i % 10 == 9)) for i in range(100)], "probability double, target int")
    methods = lambda fit, **k: [r.method for r in calibration.choose_calibrator(fit, df, **k).collect()]
    assert methods(df) == ["none", "platt"] and methods(df, least=10) == ["none", "platt", "isotonic"]
    assert methods(df.where("target = 0")) == ["none"] and methods(df.limit(0)) == ["none"]
    assert [r.chosen for r in calibration.choose_calibrator(df, df, least=10).collect()].count(True) == 1


WINDOWS = (("TRAIN", "2000-01-01", "2000-12-31"), ("LOCKED", "2001-01-01", "2001-12-31"))


def test_dataset_masks_and_refuses(spark):
    day = lambda y, m: dt.date(y, m, 30)
    keys = [(1, day(2000, 6)), (2, day(2000, 6)), (3, day(2000, 6)), (1, day(2001, 6)), (1, day(2002, 6))]
    fe = spark.createDataFrame([(*k, float(i), 1) for i, k in enumerate(keys)], "e int, p date, x double, next_date int")
    lb = spark.createDataFrame([(*k, s, v) for k, s, v in zip(keys, ("POSITIVE", "NEGATIVE", "RIGHT_CENSORED", "POSITIVE", "NEGATIVE"), (1, 0, None, 1, 0), strict=True)], "e int, p date, status string, label int")
    got = dataset.model_dataset(fe, lb, ["e", "p"], "p", ["x"], WINDOWS, "LOCKED")
    assert sorted((r.e, r.split, r.outcome, r.label_status) for r in got.collect()) == [(1, "LOCKED", None, dataset.MASKED), (1, "TRAIN", 1, "POSITIVE"), (2, "TRAIN", 0, "NEGATIVE")]
    with pytest.raises(ValueError, match="next_date"):
        dataset.model_dataset(fe, lb, ["e", "p"], "p", ["x", "next_date"], WINDOWS, "LOCKED")
    reg = dataset.dataset_reconciliation(dataset.dataset_registry({"a": got, "b": got.withColumn("outcome", F.lit(0))}, "TRAIN", "NONE", "LOCKED"))
    assert {r.dataset: r.status for r in reg.collect()} == {"a": "PASS", "b": "FAIL"}


def test_audit_tells_a_wrong_label(spark):
    day = dt.date(2020, 3, 31)
    panel = spark.createDataFrame([(e, dt.date(2019, m, 28), False) for e in (1, 2, 3) for m in (3, 6, 9)] + [(e, day, e == 3) for e in (1, 2, 3)] + [(4, day, False)], "e int, p date, blocked boolean")
    events = spark.createDataFrame([(1, dt.date(2021, 3, 31), "FAILURE"), (2, dt.date(2021, 4, 1), "FAILURE"), (4, dt.date(2020, 4, 1), "EXIT")], "e int, event_date date, event_type string")
    rows = spark.createDataFrame([(1, day, "NEGATIVE"), (2, day, "NEGATIVE"), (3, day, "INELIGIBLE_QUALITY"), (4, day, "INELIGIBLE_SHORT_HISTORY")], "e int, p date, status string")
    got = {r.e: (r.status, r.expected) for r in label_audit.derived_status(rows, panel, events, "e", "p", 12, "2022-01-01").collect()}
    assert got == {1: ("NEGATIVE", "POSITIVE"), 2: ("NEGATIVE", "NEGATIVE"), 3: ("INELIGIBLE_QUALITY",) * 2, 4: ("INELIGIBLE_SHORT_HISTORY",) * 2}


@pytest.mark.parametrize(("days", "status", "agrees"), [(-1, "POSITIVE", True), (0, "POSITIVE", True), (1, "POSITIVE", False), (1, "NEGATIVE", True), (0, "RIGHT_CENSORED", False), (2, "INELIGIBLE_QUALITY", True), (0, "COMPETING_EXIT", True)])
def test_boundary_truth_table(spark, days, status, agrees):
    end = dt.date(2021, 3, 31)
    df = spark.createDataFrame([(end, end + dt.timedelta(days), status), (end, end + dt.timedelta(99), status), (end, None, status)], "horizon_end date, next_date date, status string")
    assert [tuple(r) for r in label_audit.boundary_cases(df).collect()] == [(days, status, 1, agrees)]


def test_winners_break_ties(spark):
    rows = [("b", 1, 0.5, 0.2), ("b", 2, 0.7, 0.2), ("a", 1, 0.6, 0.3), ("a", 2, 0.6, 0.3), ("c", 1, 0.6, 0.2), ("c", 2, 0.6, 0.2), ("d", 1, 0.1, 0.1)]
    cv = spark.createDataFrame(rows, "model string, fold int, average_precision double, brier double")
    got = {r.scope: (r.model, r.mean_ap, r.folds) for r in models.winners(cv, {"a": "x", "b": "y", "c": "y"}).collect()}
    assert got == {"ALL": ("b", 0.6, 2), "x": ("a", 0.6, 2), "y": ("b", 0.6, 2), "d": ("d", 0.1, 1)}
    assert models.select_winner(cv).first().model == "b"


def test_cross_validation_side_by_side_as_one_by_one(spark):
    """Candidates that are fitted side by side on shared vectors give what single fits give, and beat chance on a target that the features tell."""
    rng = np.random.default_rng(6)
    rows = [(i, dt.date(2000 + i % 6, 6, 30), float(x), None if i % 9 == 0 else float(rng.normal()), int(x + rng.normal() * 0.5 > 0.5)) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "k int, period date, a double, b double, target int")
    chosen = {n: m for n, m in models.candidates().items() if n in ("logistic", "logistic_l2")}
    folds = [("2002-12-31", "2003-01-01", "2003-12-31"), ("2003-12-31", "2004-01-01", "2004-12-31")]
    got = {(r.model, r.fold): r for r in models.cross_validate(df, ["a", "b"], folds, models=chosen).collect()}
    for (name, fold), r in got.items():
        until, first, last = folds[fold - 1]
        scored = models.fit(df.where(F.col("period") <= F.lit(until).cast("date")), ["a", "b"], chosen[name]).score(df.where(F.col("period").between(F.lit(first).cast("date"), F.lit(last).cast("date"))))
        one = metrics.ranking_metrics(scored, "probability", "target").first()
        assert (r.n_rows, r.positives) == (one.n_rows, one.positives) and r.average_precision == pytest.approx(one.average_precision, abs=2e-6) and r.roc_auc > 0.8
    stable = {r.feature: r for r in models.sign_stability([models.fit(df, ["a", "b"], chosen["logistic"])] * 2, spark).collect()}
    assert stable["a"].sign_share == 1.0 and stable["a"].mean_coefficient > 0


def test_event_bootstrap_by_hand(spark):
    rows = [(e, dt.date(2020, 1, 1 + e % 5), e % 3 == 0) for e in range(40)]
    got = {r.rep: (r.n_events, r.capture_rate) for r in metrics.event_bootstrap(spark.createDataFrame(rows, "e int, d date, hit boolean"), ["e", "d"], "hit", 3).collect()}
    for rep in (1, 2, 3):
        k = [sum(int(hashlib.md5(f"{rep}|{e}|{d}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in metrics.POISSON) for e, d, _ in rows]
        assert got[rep] == (sum(k), round(sum(n for n, r in zip(k, rows, strict=True) if r[2]) / sum(k), 6))
