"""Peer statistics and drivers against plain versions, and the presentation queries against their SQL."""

import os
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import drivers, ordering, peer_stats
from panelwright.plans import presentation, registry

SMALL = "/root/testdata/sf0.001"
#: ``peer_benchmark_validation`` and ``driver_table`` rest on ``feature_benchmarks`` too and take as long; they are compared at a larger scale only.
NAMES = [n for n, f in registry.queries().items() if f.__module__ == presentation.__name__ and n not in ("peer_benchmark_validation", "driver_table")]


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


def test_feature_benchmarks_by_hand(spark):
    """A large detailed group, one that falls back to the broad group, ties, a single value, and all three directions."""
    rng = np.random.default_rng(2)
    rows = [(i, f, float(rng.integers(0, 15)), "p|a|x" if i < 60 else "p|a|y" if i < 70 else "p|b|z", "p|a" if i < 70 else "p|b") for i in range(71) for f in ("good", "bad", "other")]
    long = spark.createDataFrame(rows, "k int, feature string, value double, dg string, bg string").repartition(7)
    got = {(r.k, r.feature): r for r in peer_stats.feature_benchmarks(long, ["k"], "dg", "bg", good=["good"], bad=["bad"]).collect()}
    assert len(got) == len(rows)
    for f in ("good", "bad", "other"):
        own = {k: (g if sum(r[3] == g and r[1] == f for r in rows) >= 20 else b) for k, n, _, g, b in rows if n == f}
        value = {r[0]: r[2] for r in rows if r[1] == f}
        for k, group in own.items():
            v = sorted(value[j] for j in own if own[j] == group)
            r, med = got[k, f], statistics.median(v)
            pr = sum(x < value[k] for x in v) / (len(v) - 1) if len(v) > 1 else 0.0
            mad = statistics.median(abs(x - med) for x in v)
            assert (r.peer_group, r.peer_count, r.too_small) == (group, len(v), len(v) < 20)
            assert np.allclose((r.peer_median, r.peer_p25, r.peer_p75, r.peer_mean, r.percentile, r.peer_mad), (med, np.quantile(v, 0.25), np.quantile(v, 0.75), np.mean(v), pr, mad))
            assert r.risk_percentile == pytest.approx({"good": 1 - pr, "bad": pr}[f]) if f != "other" else r.risk_percentile is None
            assert r.robust_z == pytest.approx((value[k] - med) / (1.4826 * mad)) if mad else r.robust_z is None
    checked = {r.feature: r for r in peer_stats.benchmark_validation(spark.createDataFrame([("2020-03-31", "f", "DETAILED_FEATURE", g, 30, False, p, p, 0.0) for g, p in (("2020-03-31|a", 0.5), ("2020-06-30|a", 1.5))], "period string, feature string, peer_method string, peer_group string, peer_count int, too_small boolean, percentile double, risk_percentile double, robust_z double").withColumn("period", F.col("period").cast("date"))).collect()}
    assert (checked["f"].n_out_of_bounds, checked["f"].n_other_period) == (1, 1)


def test_nothing_to_benchmark(spark):
    empty = spark.createDataFrame([], "k int, feature string, value double, dg string, bg string")
    assert peer_stats.feature_benchmarks(empty, ["k"], "dg", "bg").collect() == []


def test_places_within(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(0, 30)) * (1000 if g == "b" else 1), i) for i, g in enumerate("aab" * 200)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    x = ordering.by_range_within(df, F.col("v"), ["g"])
    assert all(n > 1 for n in (r.n for r in x.groupBy("g").agg(F.count_distinct(ordering.RANGE).alias("n")).collect()))
    got = ordering.global_index(x, [F.col("v"), F.col("i")], groups=["g"], ties=[F.col("v")]).collect()
    for g in "ab":
        own = sorted((v, i) for h, v, i in rows if h == g)
        for r in (r for r in got if r.g == g):
            assert own[r.row_index] == (r.v, r.i) and r.n_before == sum(v < r.v for v, _ in own) and r.n_rows == len(own)


def test_substitution_drivers(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, None), (2, 0.0, 0.0, 5.0)], "k int, a double, b double, c double")
    score = lambda x: x.withColumn("score", F.coalesce("a", F.lit(0.0)) + 3 * F.col("b") + F.coalesce("c", F.lit(2.0)))
    got = [tuple(r) for r in drivers.substitution_drivers(df, ["k"], {"a": 1.0, "b": 0.0, "c": 2.0}, score, 2).orderBy("k", "driver_rank").collect()]
    assert got == [(1, 1, "a", 9.0, 10.0, 1.0), (1, 2, "b", 3.0, 1.0, 0.0), (2, 1, "c", 3.0, 5.0, 2.0), (2, 2, "a", -1.0, 0.0, 1.0)]
    bench = spark.createDataFrame([(1, "a", 30, "DETAILED_FEATURE", 1.0, 0.9, False), (1, "b", 5, "BROAD_FEATURE_FALLBACK", 1.0, 0.9, True), (2, "c", 30, "BROAD_FEATURE_FALLBACK", 1.0, 0.1, False)], "k int, feature string, peer_count int, peer_method string, peer_median double, risk_percentile double, too_small boolean")
    table = {(r.k, r.feature): (r.direction, r.warning) for r in drivers.driver_table(drivers.substitution_drivers(df, ["k"], {"a": 1.0, "b": 0.0, "c": 2.0}, score, 2), bench, ["k"]).collect()}
    assert table == {(1, "a"): ("RAISES", None), (1, "b"): ("RAISES", "SMALL_PEER_GROUP"), (2, "c"): ("RAISES", "BROAD_PEER_GROUP"), (2, "a"): ("LOWERS", "NO_PEER_VALUE")}
