"""Registered queries against their SQL on the smallest tables, the sources and the ingest."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.operators import distress, feature_quality, metrics
from panelwright.plans import controls, evaluation, registry
from panelwright.sources import files
from panelwright.streaming.ingest import ingest_periods

SMALL = "/root/testdata/sf0.001"
NEW = [n for n, f in registry.queries().items() if f.__module__ in (controls.__name__, evaluation.__name__)]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, tables, name):
    df = registry.queries()[name](spark, SMALL)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = tables.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and got == want


def test_look_ahead_bounds(spark):
    """The horizon's last day is inside, the row's own day is not, gaps don't reach further."""
    days = [dt.date(2020, 3, 31), dt.date(2020, 12, 31), dt.date(2021, 3, 31), dt.date(2021, 6, 30)]
    rows = spark.createDataFrame([(1, d, i == 2) for i, d in enumerate(days)], "e int, p date, hit boolean")
    got = {r.p: (r.n_ahead, r.any_ahead) for r in distress.look_ahead(rows, "e", "p", F.col("hit"), 12).collect()}
    assert got == {days[0]: (2, True), days[1]: (2, True), days[2]: (1, False), days[3]: (0, False)}


def test_quality_status_order(spark):
    fe = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0)], "k int, a double")
    ex = spark.createDataFrame([(1, "GAP", ""), (2, "GAP", ""), (2, "NEGATIVE", "")], "k int, kind string, detail string")
    got = {r.k: (r.status, r.n_missing) for r in feature_quality.feature_quality(fe, ex, ["k"], ["a"]).collect()}
    assert got == {1: ("WARNING", 0), 2: ("BLOCKING", 1), 3: ("PASS", 0)}


def test_bootstrap_draws_are_of_whole_entities(spark):
    """One draw against the same rows repeated by hand."""
    rows = [(e, ((e * 7 + i) % 10) / 10, (e + i) % 3 == 0) for e in range(30) for i in range(5)]
    df = spark.createDataFrame([(e, s, int(t)) for e, s, t in rows], "e int, s double, t int")
    got = {r.rep: r for r in metrics.cluster_bootstrap(df, "e", "s", "t", 3).collect()}
    import hashlib

    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)
    times = lambda e: sum(int(hashlib.md5(f"2|{e}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in cuts)
    again = spark.createDataFrame([(s, int(t)) for e, s, t in rows for _ in range(times(e))], "s double, t int")
    want = metrics.ranking_metrics(again, "s", "t").first()
    assert (got[2].n_rows, got[2].average_precision, got[2].roc_auc) == (want.n_rows, want.average_precision, want.roc_auc)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    df = files.read_text_csv(spark, str(tmp_path / "a.csv"), ["id", "name"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x"), ("2", None)]
    with pytest.raises(ValueError, match="missing"):
        files.check_schema(df, ["id", "other"])
    with pytest.raises(ValueError, match="unexpected"):
        files.check_schema(df, ["id"], ["id"])
    assert files.stamp_lineage(df, {"run": "r1"}).select("run").distinct().collect()[0].run == "r1"
    files.write_presentation(df, str(tmp_path / "p"), ["id"])
    assert [r.id for r in files.read_text_panel(spark, str(tmp_path / "p"), ["id"]).collect()] == ["1", "2"]
    files.write_jsonl(df, str(tmp_path / "j"), ["id"])
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ["1", "2"]
    files.write_csv_sorted(df, str(tmp_path / "c"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    (tmp_path / "page.json").write_text(json.dumps({"meta": {"total": 2}, "data": [{"data": {"id": 7}}, {"data": {"id": None}}]}))
    assert [tuple(r) for r in files.flatten_pages(spark, str(tmp_path / "page.json"), ["id"]).collect()] == [(2, "7"), (2, None)]
    assert [r.id for r in files.query_table(spark, str(tmp_path / "p"), ["id"], "id > :least", least="1").collect()] == ["2"]
    assert [r.name for r in files.distinct_values(df, "name").collect()] == ["x"] and files.latest_period(df, "id").first().id == "2"
    assert [tuple(r) for r in files.table_manifest({"a": (df, ["id"])}).collect()] == [("a", 2, 2)]
    assert files.forbidden_columns(df, ["^na"]) == ["name"]


def test_page_problems(spark):
    pages = [(0, 10, 40, "a"), (10, 10, 40, "b"), (25, 10, 41, "b"), (30, 5, 40, "d")]
    got = {tuple(r) for r in files.page_problems(spark.createDataFrame(pages, "offset long, row_count long, total long, sha256 string")).collect()}
    assert got == {(10, "REPEATED_CONTENT"), (25, "REPEATED_CONTENT"), (25, "GAP"), (25, "CHANGED_TOTAL"), (30, "OVERLAP"), (30, "INCOMPLETE")}


def test_ingest_twice(spark, tmp_path):
    """Files in several batches and a rerun: every key once, in its period."""
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, day date"
    put = lambda rows: spark.createDataFrame([(i, dt.date(2024, m, 1)) for i, m in rows], schema).coalesce(1).write.mode("append").parquet(landing)
    put([(1, 1), (2, 1), (2, 1)])
    kind = spark.createDataFrame([], schema).schema
    run = lambda: sorted((r.id, str(r.period)) for r in ingest_periods(spark, landing, out, check, kind, F.date_format("day", "yyyy-MM"), ["id"]).collect())
    assert run() == [(1, "2024-01"), (2, "2024-01")]
    put([(2, 1), (3, 2)])
    assert run() == [(1, "2024-01"), (2, "2024-01"), (3, "2024-02")]
    assert run() == [(1, "2024-01"), (2, "2024-01"), (3, "2024-02")]


def test_look_ahead_of_monthly_and_double_rows(spark):
    """More rows than one a quarter lose no follow-up, and the days decide in the last month."""
    days = [dt.date(2020, m, 15) for m in range(1, 13)] + [dt.date(2021, 1, 14), dt.date(2021, 1, 15), dt.date(2021, 1, 16), dt.date(2020, 1, 15)]
    rows = spark.createDataFrame([(1, d, d == dt.date(2021, 1, 15)) for d in days], "e int, p date, hit boolean")
    got = {r.p: (r.n_ahead, r.any_ahead) for r in distress.look_ahead(rows, "e", "p", F.col("hit"), 12).collect()}
    assert got[dt.date(2020, 1, 15)] == (13, True) and got[dt.date(2021, 1, 15)] == (1, False) and got[dt.date(2021, 1, 16)] == (0, False)


def test_validate_events_on_one_day_and_without_history(spark):
    panel = spark.createDataFrame([(1, dt.date(2020, m, 28)) for m in (3, 6, 6, 9)], "e int, p date")
    ev = spark.createDataFrame([(1, dt.date(2020, 6, 28), "a"), (1, dt.date(2020, 6, 29), "b"), (1, dt.date(2020, 6, 29), "c"), (1, dt.date(2020, 1, 1), "d"), (2, dt.date(2020, 1, 1), "e")], "e int, at date, kind string")
    got = {r.kind: (str(r.last_before), r.n_before, r.coverage) for r in distress.validate_events(ev, panel, "e", "p", "at", "2019-01-01").collect()}
    two = ("2020-06-28", 2, "COVERED")
    assert got == {"a": ("2020-03-28", 1, "COVERED"), "b": two, "c": two, "d": ("None", 0, "NO_PRIOR_OBSERVATION"), "e": ("None", 0, "UNMATCHED")}
