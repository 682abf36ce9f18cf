"""Typed rows, eligibility, cases, line audits, reports and the counts of the report views."""

import datetime as dt
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.operators import cases, conform, eligibility, ordering, quality, text_scan
from panelwright.operators.conform import Field
from panelwright.plans import inventory, registry
from panelwright.sources import files
from panelwright.sources.report import export_report

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.queries().items() if f.__module__ == inventory.__name__]
day = lambda y, m, d=28: dt.date(y, m, d)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    df = registry.queries()[name](spark, SMALL)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = tables.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns) and got == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)


def test_conform_keeps_every_row(spark):
    fields = {"n": Field("a", "long"), "x": Field("b", "decimal"), "d": Field("c", "date", ("yyyy-MM-dd", "MM/dd/yyyy"), ("9999",)), "f": Field("e", "flag"), "t": Field("a")}
    rows = [("1", "2.5", "2020-01-31", "1"), ("1.0", " x ", "02/29/2020", "0"), (None, "", "9999", "Y"), (" ", "1e400", "soon", None), ("x", "-3 ", " ", " 1 ")]
    df = conform.conform(spark.createDataFrame(rows, "a string, b string, c string, e string").withColumn("unused", F.lit(1)), fields)
    got = [(r.n, None if r.x is None else float(r.x), r.d, r.f, r.t, r.unread) for r in df.collect()]
    assert got == [(1, 2.5, day(2020, 1, 31), True, "1", ""), (None, None, day(2020, 2, 29), False, "1.0", "n,x"), (None, None, None, None, None, "f"), (None, None, None, None, None, "x,d"), (None, -3.0, None, True, "x", "n")]
    assert {r.field: (r.n_rows, r.n_null, r.n_unread) for r in conform.read_status(df, ["n", "d"]).collect()} == {"n": (5, 4, 2), "d": (5, 3, 1)}
    assert conform.read_status(df.limit(0), ["n"]).first().n_rows == 0


def test_attach_where(spark):
    """Rows that fail the condition match nothing, whatever their key; null keys and repeated rows stay."""
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (3, "a"), (1, "a"), (1, None)], "k int, kind string")
    source = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "id bigint, code string")
    got = sorted(map(str, map(tuple, conform.attach_where(df, F.col("kind") == "a", source, "k", "id", ["code"]).collect())))
    assert got == sorted(map(str, [(1, "a", "one"), (1, "b", None), (None, "a", None), (3, "a", None), (1, "a", "one"), (1, None, None)]))


def test_crosswalk_and_selection(spark):
    a = spark.createDataFrame([(1, "x"), (1, "w"), (2, None), (None, "n")], "i int, n string")
    b = spark.createDataFrame([("1",), ("1",), ("7",)], "j string")
    got = {tuple(r) for r in conform.crosswalk({"a": (a, "i", "n"), "b": (b, "j", None)}).collect()}
    assert got == {(1, "a", "w", 2), (1, "b", None, 2), (2, "a", None, 1), (7, "b", None, 1)}
    assert conform.filter_isin(a, {"i": [1], "n": []}).count() == 2 and conform.filter_isin(a, {}).count() == 4 and conform.filter_isin(a, {"i": [1], "n": ["x"]}).count() == 1


def test_eligibility_against_brute_force(spark):
    rnd = random.Random(5)
    ends = [day(y, m, d) for y in (2018, 2019, 2020) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    rows = [(e, p) for e in range(12) for p in ends if rnd.random() < 0.7]
    events = [(e, rnd.choice(ends) if rnd.random() < 0.4 else day(rnd.choice((2017, 2018, 2019, 2020)), rnd.randint(1, 12), rnd.randint(1, 28)), rnd.choice(("FAILURE", "EXIT", "MERGER", "ASSISTANCE", "OTHER"))) for e in range(14) for _ in range(rnd.randint(0, 4))]
    panel = spark.createDataFrame(rows, "e int, p date").withColumn("kept", F.col("e"))
    ev = spark.createDataFrame([*events, (None, ends[0], "FAILURE"), (1, None, "EXIT")], "e int, d date, k string").repartition(3)
    got = {(r.e, r.p): r for r in eligibility.label_eligibility(panel, ev, "e", "p", "d", "k", {"4q": 12}, "2020-12-31", competing=("EXIT", "MERGER")).collect()}
    assert len(got) == len(rows)
    for e, p in rows:
        r, own = got[e, p], sorted(q for f, q in rows if f == e)
        mine = [(d, k) for f, d, k in events if f == e]
        after = lambda *kinds: min(((d, k) for d, k in mine if k in kinds and d > p), default=(None, None))  # noqa: E731, B023
        prior = own[own.index(p) - 1] if own.index(p) else None
        before = ends[ends.index(p) - 1] if ends.index(p) else None
        want = (own.index(p) + 1, prior, prior is not None and prior != before, after("FAILURE")[0], min((d for d, k in mine if k == "FAILURE" and d <= p), default=None), *after("EXIT", "MERGER"), after("ASSISTANCE")[0], own.index(p) < 3, p <= day(2019, 12, 31), e)
        assert (r.history, r.prior_period, r.gap, r.next_failure, r.first_failure, r.exit_date, r.exit_type, r.next_assistance, r.short_history, r.complete_4q, r.kept) == want


def test_cases_by_roles(spark):
    """Entity 1 is captured at every budget, 2 at 5% only, 3 never; 4 is the best of the others; nobody is small."""
    rows = [(1, day(2020, 3), day(2021, 1), 0.9, 3, 1, 1, 1, 1), (1, day(2020, 6), day(2021, 1), 0.8, 3, 1, 0, 1, 1), (2, day(2020, 6), day(2020, 12), 0.7, 2, 1, 0, 1, 1), (3, day(2020, 3), day(2020, 7), 0.1, 4, 1, 0, 0, 0), (3, day(2020, 6), day(2020, 7), 0.2, 4, 1, 0, 0, 0), (4, day(2020, 3), None, 0.6, 1, 0, 0, 0, 1), (5, day(2020, 3), None, 0.6, 1, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "entity int, period date, event_date date, score double, size int, target int, top_1pct int, top_5pct int, top_10pct int")
    got = {r.role: (r.state, r.entity, r.period, r.lead_days, r.captured_1, r.captured_5) for r in cases.case_studies(df).collect()}
    assert got == {
        "short lead": ("SELECTED", 2, day(2020, 6), 183, False, True), "long lead": ("SELECTED", 1, day(2020, 3), 306, True, True), "captured at 1%": ("SELECTED", 1, day(2020, 3), 306, True, True),
        "captured at 5%, not at 1%": ("SELECTED", 2, day(2020, 6), 183, False, True), "missed": ("SELECTED", 3, day(2020, 6), None, False, False), "false alarm": ("SELECTED", 4, day(2020, 3), None, False, False),
        "small and captured": ("UNAVAILABLE", None, None, None, False, False), "largest": ("SELECTED", 3, day(2020, 3), None, False, False),
    }
    assert {r.state for r in cases.case_studies(df.limit(0)).collect()} == {"UNAVAILABLE"} and cases.case_studies(df.limit(0)).count() == 8


def test_audit_lines(spark):
    texts = [(1, "fine\r\n  see /home/ann/x and /tmp/y  \nAKIA" + "A" * 16), (2, "C:\\Users\\bob\\OneDrive\\z"), (3, None), (4, ""), (5, "api_key = 'abcdefgh'\u2028password: \"short\""), (6, "ghp_" + "a1" * 15 + " " + "x" * 300), (7, "-----BEGIN RSA PRIVATE KEY-----"), (8, "d:/tmp/a e:/my/Downloads/b")]
    got = {(r.doc_id, r.line_number, r.finding) for r in text_scan.audit_lines(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text").collect()}
    assert got == {(1, 2, "unix_home_path"), (1, 2, "temporary_path"), (1, 3, "aws_access_key"), (2, 1, "windows_user_path"), (2, 1, "onedrive_path"), (5, 1, "generic_secret_assignment"), (6, 1, "github_token"), (7, 1, "private_key"), (8, 1, "downloads_path"), (8, 1, "temporary_path")}
    evidence = {r.doc_id: r.evidence for r in text_scan.audit_lines(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text").where("doc_id in (1, 6) and finding <> 'aws_access_key'").collect()}
    assert evidence[1] == "see /home/ann/x and /tmp/y" and len(evidence[6]) == 240


@pytest.mark.parametrize("per_file", [1000, 7])
def test_report_in_total_order(spark, tmp_path, per_file):
    rows = [(i % 3 if i % 5 else None, f"n{i % 4}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(4)
    n = export_report(df, str(tmp_path / "r"), ["b"], per_file)
    files = sorted(f for f in os.listdir(tmp_path / "r") if f.endswith(".csv"))
    read = [tuple(line.split(",")) for f in files for line in (tmp_path / "r" / f).read_text().splitlines()[1:]]
    want = sorted(rows, key=lambda r: (r[1], r[0] is None, r[0] or 0, r[2]))
    assert (n == 1) == (per_file == 1000) and [(r[1], r[0] or None, int(r[2])) for r in read] == [(b, None if a is None else str(a), c) for a, b, c in want]


def test_panel_audit_and_mappings(spark):
    rows = [(1, "q1", 5), (2, "q1", None), (2, "q1", None), (1, "q3", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "e int, p string, v int")
    want = spark.createDataFrame([("q1",), ("q2",)], "p string")
    got = {r.p: (r.n_rows, r.n_repeated, r.status) for r in quality.panel_audit(df, ["e", "p"], "p", want, ["e", "p", "v"]).collect()}
    assert got == {"q1": (3, 1, "REPEATED_KEYS"), "q2": (0, 0, "MISSING"), "q3": (1, 0, "UNEXPECTED"), None: (1, 0, "UNEXPECTED")}
    digest = lambda x: {r.p: r.digest for r in quality.panel_audit(x, ["e", "p"], "p", want, ["e", "p", "v"]).collect()}
    assert digest(df) == digest(df.repartition(3)) != digest(df.na.fill(0))
    spans = [("a", 1, 1), ("a", 1, 9), ("a", 2, 3), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1), ("d", 1, 4), ("d", 2, 5), ("d", 3, 4), (None, 1, 1)]
    assert tuple(quality.mapping_counts(spark.createDataFrame(spans, "alias string, id int, p int"), "alias", "id", "p").first()) == (3, 2, 1)


def test_places_within_groups(spark):
    """Places, ties and nulls against a sorted list; an empty table has none."""
    rnd = random.Random(3)
    rows = [(g, k, None if rnd.random() < 0.1 else rnd.randint(0, 8) / 4) for g in ("a", "b", None) for k in range(60)] + [("one", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, s double").repartition(5)
    low = float("-inf")
    value = lambda s: low if s is None else s
    for r in ordering.places_within(df, ["g"], "s", "k").collect():
        own = [(value(s), k) for g, k, s in rows if g == r.g]
        mine = value(r.s)
        assert (r.place, r.n_before, r.n_below, r.n_rows) == (1 + sum(s > mine or (s == mine and k < r.k) for s, k in own), sum(s > mine for s, _ in own), sum(s < mine for s, _ in own), len(own))
    assert ordering.places_within(df.limit(0), ["g"], "s", "k").count() == 0


def test_pages_with_forbidden_fields(spark, tmp_path):
    page = lambda *rows: json.dumps({"meta": {"total": len(rows), "index": {"name": "i7", "createTimestamp": "2020"}}, "data": [{"data": r} for r in rows]})
    (tmp_path / "good.json").write_text(page({"ID": "1", "NAME": "x"}, {"ID": None, "secret": None}))
    (tmp_path / "bad.json").write_text(page({"ID": "1", "secret": "s"}))
    got = [tuple(r) for r in files.flatten_pages(spark, str(tmp_path / "good.json"), ["ID"], ["secret"], index=True).collect()]
    assert got == [(2, "i7", "2020", "1"), (2, "i7", "2020", None)]
    with pytest.raises(Exception, match="forbidden fields: secret"):
        files.flatten_pages(spark, str(tmp_path / "bad.json"), ["ID"], ["secret"]).collect()


def test_mapping_exceptions(spark):
    spans = [("a", 1, 1), ("a", 1, 9), ("a", 2, 3), ("b", 2, 1), ("b", 1, 2), ("c", 1, 1), (None, 1, 1), (None, 2, 1)]
    got = {tuple(r) for r in quality.mapping_exceptions(spark.createDataFrame(spans, "alias string, id int, p int"), "alias", "id", "p").collect()}
    assert got == {("a", "CONCURRENT", 2, "1 > 2"), ("b", "SEQUENTIAL", 2, "2 > 1")}
