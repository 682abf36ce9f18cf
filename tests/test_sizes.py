"""Cases that only larger tables have: events that meet on a day, large groups, and steps that must not grow faster than their input."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.operators import drivers, feature_quality, models, peer_stats
from panelwright.plans import inventory, modelling, presentation, references, registry, reports  # noqa: F401 - they add their queries to the registry

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines(spark, folder, rows):
    """A lineitem of (part, day, flag, discount, quantity) and the same as a view of another engine."""
    df = spark.createDataFrame([(i, 1, p, 1, float(q), 1000.0 + i, x, 0.02, f, "O", dt.datetime.combine(day, dt.time())) for i, (p, day, f, x, q) in enumerate(rows)], LINE)
    df.write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


def same(spark, con, folder, name):
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    df = registry.queries()[name](spark, folder)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and got == want and got


@pytest.fixture(scope="module")
def same_day(spark, tmp_path_factory):
    """A part whose failure falls on the day of an exit, and one that fails later too."""
    folder = str(tmp_path_factory.mktemp("same_day"))
    quarters = [dt.date(1996 + i // 4, 3 * (i % 4) + 2, 10) for i in range(12)]
    rows = [(p, day, "N", 0.01, 1) for p in (1, 2) for day in quarters]
    rows += [(p, dt.date(1997, 4, 1), f, 0.1, 49) for p in (1, 2) for f in ("R", "A")] + [(2, dt.date(1998, 6, 1), "R", 0.1, 49)]
    return folder, lines(spark, folder, rows)


@pytest.mark.parametrize("name", ["outcome_labels_4q", "outcome_labels_8q", "label_prevalence", "label_status_summary", "lead_time_summary", "split_diagnostics", "label_boundary_validation", "event_bootstrap", "failure_events_by_split"])
def test_events_of_one_day_are_one(spark, same_day, name):
    same(spark, same_day[1], same_day[0], name)


def test_wide_benchmarks_are_those_of_values(spark):
    """Groups of one task, groups too large for it, and features with few values in a group all have the benchmarks made value by value."""
    rows = [(i, f"g{i % 3}" if i < 260 else f"s{i % 9}", "b0" if i % 2 else "b1", None if i % 7 == 0 else float(i * 37 % 50), float(i) if i % 3 == 0 and i % 5 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, dg string, bg string, equity_to_assets double, efficiency_ratio double")
    names = ["equity_to_assets", "efficiency_ratio"]
    long = df.unpivot(["k", "dg", "bg"], names, "feature", "value").where("value is not null")
    columns = ["k", "feature", "value", "peer_group", "peer_method", "peer_count", "peer_mean", "peer_median", "peer_p25", "peer_p75", "peer_mad", "percentile", "risk_percentile", "robust_z", "too_small"]
    plain = lambda x: sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)) for r in x.select(*columns).collect())
    want = plain(peer_stats.feature_benchmarks(long, ["k"], "dg", "bg"))
    for most in (1000, 86, 1):
        assert plain(peer_stats.wide_benchmarks(df, ["k"], names, "dg", "bg", most=most)) == want


def shuffles(df):
    """Exchanges of rows by a key in the plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_quality_takes_one_exchange(spark):
    assert shuffles(registry.queries()["feature_quality"](spark, "/root/testdata/sf0.001")) == 1


def test_sums_of_odd_doubles_are_those_of_decimals(spark):
    """Whole hundredths of doubles that are no hundredths, of halves, signs and nulls."""
    df = spark.createDataFrame([(x,) for x in (0.0, -0.0, 0.005, 1.005, -2.675, 1234.565, 0.1 + 0.2, 99999.99, -0.01, 9999999999.99, None)], "l_tax double")
    assert df.where(f"NOT (({registry._hundredths('l_tax')}) <=> CAST(CAST(l_tax AS DECIMAL(12,2)) * 100 AS BIGINT))").count() == 0


@pytest.fixture(scope="module")
def same_day_of_many(spark, tmp_path_factory):
    """As same_day, and lines without a part or a day, some of them events."""
    folder = str(tmp_path_factory.mktemp("same_day_of_many"))
    quarters = [dt.datetime(1996 + i // 4, 3 * (i % 4) + 2, 10) for i in range(12)]
    rows = [(p, day, "N", 0.01, 1) for p in (1, 2, 3, None) for day in quarters]
    rows += [(p, dt.datetime(1997, 4, 1), f, 0.1, 49) for p in (1, 2) for f in ("R", "A")] + [(2, dt.datetime(1998, 6, 1), "R", 0.1, 49)]
    rows += [(3, None, "N", 0.01, 1), (None, dt.datetime(1997, 5, 1), "R", 0.1, 49), (3, dt.datetime(1997, 5, 1), "A", 0.1, 49), (3, dt.datetime(1998, 11, 1), "R", 0.1, 49)]
    df = spark.createDataFrame([(i, 1, p, 1, float(q), 1000.0 + i, x, 0.02, f, "O", day) for i, (p, day, f, x, q) in enumerate(rows)], LINE)
    df.write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["outcome_labels_8q", "label_counts_by_year", "label_prevalence", "label_prevalence_by_horizon", "label_quality_summary", "label_status_summary", "lead_time_summary", "fold_diagnostics", "split_diagnostics"])
def test_lines_without_a_part_or_a_day_are_of_no_event(spark, same_day_of_many, name):
    same(spark, same_day_of_many[1], same_day_of_many[0], name)


@pytest.mark.parametrize("name", ["feature_quality", "feature_exception_counts", "feature_availability"])
def test_no_generated_method_is_too_long_to_be_compiled(spark, name):
    """The JVM interprets methods of more than 8,000 bytes, which the projection of all features in one method had."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts.size() > 0 and max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000


def test_distribution_of_columns_is_the_exact_one(spark):
    """Ties, nulls, infinities, few values and none: the same as from all values of a feature together."""
    nan = float("inf")
    rows = [(i, float(i * 7919 % 5000), float(i % 3), None, nan if i % 50 == 0 else (None if i % 2 else -float(i)), 4.5 if i == 7 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double").repartition(5)
    names = ["a", "b", "c", "d", "e"]
    want = sorted(map(tuple, feature_quality.distribution(df.unpivot(["k"], names, "feature", "value")).collect()))
    for accuracy in (2000, 100, 5):
        assert sorted(map(tuple, feature_quality.distribution_of_columns(df, names, accuracy).select("feature", "n_values", "n_infinite", "p01", "p05", "median", "p95", "p99").collect())) == want
    assert feature_quality.distribution_of_columns(df.where("k < 0"), names).count() == 0


def test_no_task_gathers_the_values_of_a_feature(spark):
    """One exact percentile of a group holds all its values in one task."""
    plan = registry.queries()["feature_distribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan


def test_no_task_gathers_the_values_of_one_of_all_features(spark):
    """Nor does a map of all values of all 65 features stand in each task that reads rows."""
    plan = registry.queries()["feature_distributions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan


def test_the_projection_of_all_features_that_are_written_can_be_compiled(spark, monkeypatch):
    """Features without keys were one method of 19,000 bytes: what kept it apart was the period, which nobody asked for."""
    written = []
    monkeypatch.setattr(feature_quality, "kept", lambda df, name, **_: written.append(df) or df.limit(0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert registry.queries()["feature_distributions"](spark, "/root/testdata/sf0.001").collect() == []
        parts = written[0]._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts.size() > 0 and max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000


def test_values_are_written_without_dictionaries(spark, monkeypatch):
    """A task that writes 65 columns holds a dictionary of each otherwise, besides a row group of 128 MB."""
    written, real = [], feature_quality.kept
    monkeypatch.setattr(feature_quality, "kept", lambda df, name, **options: written.append(real(df, name, **options)) or written[-1])
    feature_quality.distribution_of_columns(spark.range(1000).select(F.lit(1.0).alias("a"), (F.col("id") % 3).alias("b")), ["a", "b"])
    files = [f.removeprefix("file://") for f in written[0].inputFiles()]
    assert duckdb.execute("SELECT count(*), count(dictionary_page_offset) FROM parquet_metadata(?)", [files]).fetchone() == (2 * len(files), 0)


def test_values_at_places_that_the_bounds_miss(spark):
    """Good bounds, bounds that no value has, bounds all too low or too high, and columns of ties or of one value: all places are found."""
    columns = {0: [float(i * 7919 % 1000) for i in range(1000)], 1: [float(i % 3) for i in range(1000)], 2: [-0.5], 3: [-float(i) for i in range(50)]}
    long = spark.createDataFrame([(k, v) for k, own in columns.items() for v in own], "at int, value double").repartition(4)
    wanted = {(k, p) for k, own in columns.items() for p in {0, len(own) // 100, len(own) // 2, len(own) - 1}}
    want = {(k, p): sorted(columns[k])[p] for k, p in wanted}
    bounds = {0: [(0.0, 20.0), (480.0, 520.0), (990.0, 999.0)], 1: [(0.0, 0.0), (1.0, 2.0)], 2: [(-0.5, -0.5)], 3: [(-49.0, 0.0)]}
    for pairs in (bounds, {k: [(0.5, 0.25)] for k in columns}, {k: [(-900.0, -800.0)] for k in columns}, {k: [(2000.0, 3000.0), (2500.0, 4000.0)] for k in columns}):
        assert feature_quality.values_at(long, wanted, pairs) == want


def test_watchlist_drivers_are_made_of_the_rows_listed(spark):
    """Scores are made and written once; the drivers of rows that aren't listed are not made, so the lines aren't read again."""
    plan = registry.queries()["driver_watchlist"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan


def test_benchmarked_drivers_are_those_of_the_join(spark):
    """Rows with and without peers, missing values, few values in a group: as drivers joined with all benchmarks; no join with them is left."""
    rows = [(i, None if i % 50 == 0 else f"g{i % 3}" if i < 260 else f"s{i % 9}", None if i % 50 == 0 else "b0" if i % 2 else "b1", None if i % 7 == 0 else float(i * 37 % 50), float(i) if i % 3 == 0 and i % 5 == 0 else None, float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, dg string, bg string, equity_to_assets double, efficiency_ratio double, loans_to_deposits double")
    refs = {"equity_to_assets": 5.0, "efficiency_ratio": 5.0, "loans_to_deposits": 1.0}
    score = lambda x: x.withColumn("score", sum((F.coalesce(F.col(c), F.lit(r)) for c, r in refs.items()), F.lit(0.0)))
    bench = peer_stats.wide_benchmarks(df.where("dg is not null"), ["k"], list(refs), "dg", "bg")
    columns = ["k", "driver_rank", "feature", "direction", "peer_count", "peer_method", "peer_median", "risk_percentile", "warning"]
    plain = lambda x: sorted(str(tuple(r)) for r in x.select(*columns).collect())
    want = plain(drivers.driver_table(drivers.substitution_drivers(df, ["k"], refs, score, 2), bench, ["k"]))
    for most in (1000, 1):
        assert plain(drivers.benchmarked_drivers(df, ["k"], refs, score, "dg", "bg", 2, most=most)) == want and len(want) == 600



def test_controls_make_scores_once(spark):
    """Places, drivers and the scores made again read the written scores; of the lines only the rows are counted once more."""
    plan = registry.queries()["presentation_controls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_folds_read_rows_that_are_written(spark, monkeypatch):
    """The lines are summed once, whatever the number of folds and candidates."""
    made = []
    monkeypatch.setattr(models, "kept", lambda df, name: made.append(name) or df.limit(0))
    with pytest.raises(ValueError):
        models.cross_validate(reports._model_rows(spark, "/root/testdata/sf0.001"), reports._FEATURES, reports.FOLDS)
    assert made == ["model_rows"]


@pytest.fixture(scope="module")
def hidden_failures(spark, tmp_path_factory):
    """Failures on the day of an exit, which makes them none, and then an exit, a failure or nothing."""
    folder = str(tmp_path_factory.mktemp("hidden_failures"))
    quarters = [dt.date(1995 + i // 4, 3 * (i % 4) + 2, 10) for i in range(20)]
    rows = [(p, day, "N", 0.01, 1) for p in (1, 2, 3, 4) for day in quarters]
    rows += [(p, dt.date(1996, 10, 1), f, 0.1, 49) for p in (1, 2, 3) for f in ("R", "A")]
    rows += [(2, dt.date(1998, 6, 1), "R", 0.1, 49), (3, dt.date(1998, 6, 1), "A", 0.1, 49), (4, dt.date(1999, 2, 1), "R", 0.1, 49)]
    return folder, lines(spark, folder, rows)


OF_HIDDEN_FAILURES = [
    "label_exceptions", "label_prevalence", "label_prevalence_by_band", "label_prevalence_by_horizon", "label_quality_summary", "label_status_summary", "lead_time_summary", "fold_diagnostics", "outcome_labels_8q", "split_assignments",
]


@pytest.mark.parametrize("name", OF_HIDDEN_FAILURES)
def test_a_failure_on_the_day_of_an_exit_is_none(spark, hidden_failures, name):
    same(spark, hidden_failures[1], hidden_failures[0], name)


def test_signals_read_the_lines_twice(spark, tmp_path, monkeypatch):
    """Panel, staged rows, lags and groups are of one pass; rows of odd lines, parts that aren't listed and second ids of one entity are as in SQL."""
    day = lambda i: dt.datetime(1996 + i // 4, 3 * (i % 4) + 2, 10)
    rows = [(p, p % 5, day(i), 50.0 if i % 3 else 5.0, 1000.0 * (1 + 40 * (i == 5)) + p, "RAN"[(p + i) % 3]) for p in range(1, 61) for i in range(8) if (p + i) % 7]
    rows += [(61, 6, day(i), 10.0, 900.0, "N") for i in range(3)] + [(62, 6, day(i), 10.0, 900.0, "N") for i in range(4, 6)]  # one second id, one entity after the other
    rows += [(None, 6, day(1), 10.0, 900.0, "N"), (3, None, day(2), 10.0, 900.0, "N"), (63, 7, day(2), None, None, "N")]
    spark.createDataFrame([(i, 1, p, s, q, x, 0.05, 0.02, f, "O", t) for i, (p, s, t, q, x, f) in enumerate(rows)], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"b{p % 2}") for p in range(1, 64) if p % 10], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    read = []
    for module in (registry, inventory):
        monkeypatch.setattr(module, "table", lambda s, d, n: read.append(n) or s.read.parquet(f"{d}/{n}.parquet"))
    same(spark, con, str(tmp_path), "feature_signals")
    assert read.count("lineitem") == 2
