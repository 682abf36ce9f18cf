"""Event classes, references and exceptions by hand, and their queries against SQL."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.operators import events, references
from panelwright.operators.references import EventClass
from panelwright.plans import references as plans
from panelwright.plans import registry

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.queries().items() if f.__module__ == plans.__name__]
day = lambda m, y=2020: dt.date(y, m, 15)


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


def test_first_class_that_fits(spark):
    classes = (EventClass("A", ("1",)), EventClass("B", (), ("merge",)), EventClass("C", (), (), "flag = 1"))
    rows = [("1", "Merger", 1, "A"), (None, "MERGER of two", 1, "B"), ("9", None, 1, "C"), (None, None, None, "OTHER"), ("9", "x", 0, "OTHER")]
    df = spark.createDataFrame(rows, "code string, text string, flag int, want string")
    assert df.where(references.classify(F.col("code"), F.col("text"), classes) != F.col("want")).count() == 0


def test_first_role(spark):
    df = spark.createDataFrame([(None, 2), (1, 2), (None, None)], "a int, b int")
    got = [tuple(r) for r in df.select(*references.first_role({"x": F.col("a"), "y": F.col("b")})).collect()]
    assert got == [(2, "y"), (1, "x"), (None, "none")]


def test_resolutions_and_exits(spark):
    panel = spark.createDataFrame([(1, dt.date(2020, 3, 31)), (1, dt.date(2020, 6, 30)), (2, dt.date(2020, 6, 30)), (3, dt.date(2020, 3, 31)), (3, dt.date(2020, 9, 30))], "e int, p date")
    failures = spark.createDataFrame([(1, day(5)), (2, day(5)), (3, day(5)), (4, day(5)), (1, day(5, 2010))], "e int, d date")
    got = {(r.e, r.d.year): (r.resolution, r.n_rows) for r in references.failure_reference(failures, panel, "e", "p", "d", "2019-01-01").collect()}
    assert got == {(1, 2020): ("RESOLVED", 2), (2, 2020): ("NO_HISTORY", 1), (3, 2020): ("LATER_PERIODS", 2), (4, 2020): ("UNRESOLVED", 0), (1, 2010): ("BEFORE_START", 2)}
    history = spark.createDataFrame([(1, day(4), "SALE"), (3, day(6), "SALE"), (3, day(7), "SALE"), (5, day(1), "MOVE"), (5, day(2), "MERGER")], "e int, d date, k string")
    exits = {(r.e, r.k): (r.d.month, r.n_records, r.source) for r in references.exit_reference(failures.where("year(d) = 2020"), history, "e", "d", "k", ["SALE", "MERGER"]).collect()}
    assert exits == {(1, "FAILURE"): (5, 1, "failures"), (2, "FAILURE"): (5, 1, "failures"), (3, "FAILURE"): (5, 1, "failures"), (4, "FAILURE"): (5, 1, "failures"), (1, "CONFIRMS_FAILURE"): (4, 1, "history"), (3, "SALE"): (6, 2, "history"), (5, "MERGER"): (2, 1, "history")}


def test_horizons_as_one_by_one(spark):
    rows = [(e, dt.date(2015 + q // 4, 3 * (q % 4) + 3, 28), False, q > 9 and e == 1, day(1, 2018) if e < 3 else None, "FAILURE" if e == 1 else "EXIT" if e == 2 else None) for e in (1, 2, 3) for q in range(14)]
    df = spark.createDataFrame(rows, "e int, p date, blocked boolean, post_event boolean, next_date date, next_type string")
    both = sorted(map(tuple, events.labels_of_horizons(df, "e", "p", {"4Q": 12, "8Q": 24}, "2018-06-30").select("e", "p", "horizon", "status").collect()))
    one = [(*r, h, s) for h, m in (("4Q", 12), ("8Q", 24)) for *r, s in map(tuple, events.outcome_labels(df, "e", "p", m, "2018-06-30").select("e", "p", "status").collect())]
    assert both == sorted(one) and len({s for *_, s in both}) >= 5
