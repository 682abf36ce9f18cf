"""Publishing, combining and validated ingest, and the governance queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.operators import reconciliation
from panelwright.plans import governance, registry
from panelwright.sources import combine, publish
from panelwright.streaming import validated

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.queries().items() if f.__module__ == governance.__name__]


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


CONTROLS = [publish.Control("rows", "count(*)", 3), publish.Control("no_null", "count_if(k IS NULL)"), publish.Control("small", "count_if(v > 100)", 0, blocking=False)]


def builds(spark):
    make = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    return make((1, 10), (2, 20), (3, 30)), make((1, 11), (2, 22), (3, 330)), make((1, 10), (None, 20), (3, 30))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_publish_keeps_the_old_table_on_failure(spark, tmp_path):
    first, second, broken = builds(spark)
    target = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_published(spark, target)
    with pytest.raises(publish.PublishRefused, match="no_null: expected 0, observed 1"):
        publish.publish_validated(broken, CONTROLS, target)
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_published(spark, target)
    one = publish.publish_validated(first, CONTROLS, target)
    with pytest.raises(publish.PublishRefused):
        publish.publish_validated(broken, CONTROLS, target)
    assert rows(publish.read_published(spark, target)) == rows(first)
    assert publish.publish_validated(first.repartition(3), CONTROLS, target) == one
    two = publish.publish_validated(second, CONTROLS, target)
    assert two != one and rows(publish.read_published(spark, target)) == rows(second)
    held = publish.manifest(spark, target).orderBy("seq").collect()
    assert [r.status for r in held] == ["REFUSED", "PUBLISHED", "REFUSED", "UNCHANGED", "PUBLISHED"] and held[-1].failed == ["small"]
    assert one in {r.version for r in publish.stale_versions(spark, target).collect()}


@pytest.mark.parametrize("step", ["between write and swap", "while writing", "while checking"])
def test_publish_that_dies(spark, tmp_path, monkeypatch, step):
    first, second, _ = builds(spark)
    target = str(tmp_path / "t")
    publish.publish_validated(first, CONTROLS, target)
    if step == "while writing":
        second = second.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("dies"))).otherwise(F.col("v")).cast("int"))
    else:
        def dies(*_):
            raise RuntimeError("dies")
        monkeypatch.setattr(publish, "_record" if step == "between write and swap" else "check_controls", dies)
    with pytest.raises(Exception, match="dies"):
        publish.publish_validated(second, CONTROLS, target)
    monkeypatch.undo()
    assert rows(publish.read_published(spark, target)) == rows(first)
    again = builds(spark)[1]
    publish.publish_validated(again, CONTROLS, target)
    assert rows(publish.read_published(spark, target)) == rows(again)


def test_replace_and_append_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "p string, k int, v int")
    publish.replace_partitions(df, path, ["p"])
    new = spark.createDataFrame([(25, "b", 3), (35, "c", 4)], "v int, p string, k int")
    for _ in range(2):  # a rerun changes nothing
        publish.replace_partitions(new, path, ["p"])
        assert rows(spark.read.parquet(path).select("p", "k", "v")) == [("a", 1, 10), ("b", 3, 25), ("c", 4, 35)]
    publish.append_by_name(new.where("p = 'c'"), path, ["p"])
    assert rows(spark.read.parquet(path).select("p", "k", "v"))[-2:] == [("c", 4, 35)] * 2
    for wrong, said in ((new.drop("v"), "missing"), (new.withColumn("x", F.lit(1)), "unexpected"), (new.withColumn("k", F.col("k").cast("long")), "another type")):
        with pytest.raises(ValueError, match=said):
            publish.append_by_name(wrong, path, ["p"])


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_combine(spark, tmp_path, kind):
    def put(name, data, ddl):
        spark.createDataFrame(data, ddl).coalesce(1).write.format(kind).option("header", True).mode("append").save(str(tmp_path / name))

    put("good", [("1", "2020", "x"), ("2", "2020", "y")], "id string, day string, v string")
    put("good", [("1", "2021", "z")], "id string, day string, v string")
    fields, keys = ["id", "day", "v"], ["id", "day"]
    out = combine.combine_periods(spark, str(tmp_path / "good"), fields, keys, str(tmp_path / "panel"), kind)
    assert rows(out) == [("1", "2020", "x"), ("1", "2021", "z"), ("2", "2020", "y")]
    put("good", [("2", "2020", "other")], "id string, day string, v string")
    with pytest.raises(combine.CombineError, match=r"\['2', '2020'\] in \['file:.*', 'file:.*'\]"):
        combine.combine_periods(spark, str(tmp_path / "good"), fields, keys, str(tmp_path / "p2"), kind)
    for ddl, said in (("id string, v string, day string", "another order"), ("id string, day string, w string", r"missing \['v'\], unexpected \['w'\]")):
        name = said[:7]
        put(name, [("1", "2020", "x")], "id string, day string, v string")
        put(name, [("3", "q", "r")], ddl)
        with pytest.raises(combine.CombineError, match=said):
            combine.combine_periods(spark, str(tmp_path / name), fields, keys, str(tmp_path / f"o{name}"), kind)
    assert not (tmp_path / "p2").exists()


FIELDS = "entity string, date string, second string, amount string"
RULES = validated.PeriodRules("entity", "date", "second", ("entity", "amount"), ("amount",))


def test_ingest_of_a_bad_a_late_and_a_repeated_period(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = StructType.fromDDL("period string, " + FIELDS)

    def run(*data, configuration="c1"):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(landing)
        return {r.period: (r.status, r.problems) for r in validated.ingest_validated(spark, landing, out, schema, F.col("period"), RULES, configuration).orderBy("batch").collect()}

    panel = lambda: sorted((str(r.period), r.entity, r.amount) for r in spark.read.parquet(f"{out}/panel").collect())
    aside = lambda: sorted((r.period, r.entity, r.problems) for r in spark.read.parquet(f"{out}/quarantine").collect())
    q1, q2 = "2020-03-31", "2020-06-30"
    assert run((q1, "1", q1, "7", "10"), (q1, "2", q1, None, "n/a"), (q2, "1", q2, "7", "x1"), (q2, "2", q1, "7", "5")) == {q1: ("PASS_WITH_WARNINGS", ""), q2: ("FAIL", "WRONG_DATE,BAD_NUMBER")}
    first = [(q1, "1", "10"), (q1, "2", "n/a")]
    assert panel() == first and [a[:2] for a in aside()] == [(q2, "1"), (q2, "2")]
    # the bad period comes again, mended; the complete one is sent once more
    assert run((q2, "1", q2, "7", "1"), (q2, "2", q2, "7", "5"), (q1, "1", q1, "7", "10")) == {q1: ("REPEATED", ""), q2: ("PASS", "")}
    both = first + [(q2, "1", "1"), (q2, "2", "5")]
    assert panel() == both
    # a row that the complete period hasn't is late
    assert run((q1, "9", q1, "7", "10"), (q1, "1", q1, "7", "10"))[q1] == ("FAIL", "LATE_ROWS")
    assert panel() == both and (q1, "9", "LATE_ROWS") in aside()
    # nothing new: nothing happens; under another configuration a period is written anew
    n = validated.completed_periods(spark, out).count()
    validated.ingest_validated(spark, landing, out, schema, F.col("period"), RULES, "c1")
    assert validated.completed_periods(spark, out).count() == n
    assert run((q1, "5", q1, "7", "50"), configuration="c2")[q1] == ("PASS", "")
    assert panel() == [(q1, "5", "50")] + both[2:]


def test_validate_nothing(spark):
    assert validated.validate_periods(spark.createDataFrame([], "period string, " + FIELDS), "period", RULES).collect() == []


def test_column_profile_of_repeats_and_of_nothing(spark):
    df = spark.createDataFrame([("1", None), ("1", None), ("1", " NA "), ("2", "2020-02-30"), ("2", "2020-02-28")], "k string, v string")
    got = {r.column: r for r in reconciliation.column_profile(df, ["k"]).collect()}
    assert (got["v"].missing, got["v"].n_dates, str(got["v"].first_date), got["v"].duplicate_rows, got["v"].duplicate_keys, got["k"].missing) == (3, 1, "2020-02-28", 1, 3, 0)
    assert {(r.n_rows, r.missing, r.duplicate_rows) for r in reconciliation.column_profile(df.limit(0), ["k"]).collect()} == {(0, 0, 0)}


def test_reconcile_fields_kinds(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, None), (3, 5.0, "y"), (4, 1.0, "z")], "k int, n double, t string")
    b = spark.createDataFrame([(1, 1.0000001, "x"), (2, None, "q"), (3, 6.0, None), (5, 1.0, "z")], "k int, n double, t string")
    got = {(r.k, r.field): r.agreement for r in reconciliation.reconcile_fields(a, b, ["k"], {"n": 1e-6, "t": None}).collect()}
    assert got == {(1, "n"): "WITHIN_TOLERANCE", (1, "t"): "EXACT", (2, "n"): "BOTH_NULL", (2, "t"): "NULL_LEFT", (3, "n"): "DIFFERENT", (3, "t"): "NULL_RIGHT", (4, "n"): "KEY_ONLY_LEFT", (4, "t"): "KEY_ONLY_LEFT", (5, "n"): "KEY_ONLY_RIGHT", (5, "t"): "KEY_ONLY_RIGHT"}
