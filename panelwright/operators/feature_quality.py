"""What is wrong with an indicator: denominators, continuity, extremes, and the quality status of each row."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import apart, quarter_end, shift_quarters
from panelwright.sources.scratch import kept

EXTREME = 1000.0
#: The percentiles of a distribution.
QUANTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
#: A writer of dozens of columns without a dictionary for each and with small row groups: it takes a fraction of the memory, for files of the same size.
_LEAN = {"parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}


def _broken(df: DataFrame, keys: Sequence[str], tests: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """(keys, kind, detail): a row for each test (condition, kind, detail) that holds, in one scan."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail"))) for c, k, d in tests]))
    return df.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*")


def denominator_exceptions(panel: DataFrame, keys: Sequence[str], families: Mapping[str, str], averaged: Mapping[str, str]) -> DataFrame:
    """(keys, kind, detail): MISSING, ZERO or NEGATIVE denominators by family, INSUFFICIENT_LAG where an average lacks its start.

    ``families`` maps a family to its denominator, ``averaged`` to the flag column that tells whether the lag is there.
    """
    tests = []
    for family, c in families.items():
        tests += [(F.col(c).isNull(), "MISSING", family), (F.col(c) == 0, "ZERO", family), (F.col(c) < 0, "NEGATIVE", family)]
    tests += [(~F.coalesce(F.col(ok), F.lit(False)), "INSUFFICIENT_LAG", family) for family, ok in averaged.items()]
    return _broken(panel, keys, tests)


def continuity_exceptions(keys_only: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period, kind, detail): rows without the quarter before, without the one of a year ago, or behind a gap."""
    own = Window.partitionBy(entity).orderBy(period)
    x = keys_only.select(entity, period, F.lag(period).over(own).alias("p1"), *[F.lag(period, n).over(own).alias(f"b{n}") for n in (2, 3, 4)])
    back = lambda n: shift_quarters(F.col(period), -n)
    year_ago = F.array_contains(F.array_compact(F.array("p1", "b2", "b3", "b4")), back(4))
    tests = [(~F.coalesce(F.col("p1") == back(1), F.lit(False)), "NO_PREVIOUS_QUARTER", "1Q"), (~F.coalesce(year_ago, F.lit(False)), "NO_YEAR_AGO", "4Q"), (F.col("p1").isNotNull() & (F.col("p1") != back(1)), "GAP", "GAP")]
    return _broken(x, [entity, period], tests)


def extreme_values(features: DataFrame, keys: Sequence[str], columns: Sequence[str], bound: float = EXTREME) -> DataFrame:
    """(keys, kind, detail): indicators beyond ``bound`` either way; they are named, never changed."""
    return _broken(features, keys, [(F.abs(F.col(c)) > bound, "EXTREME", c) for c in columns])


def feature_quality(features: DataFrame, exceptions: DataFrame, keys: Sequence[str], columns: Sequence[str], blocking: Sequence[str] = ("MISSING", "NEGATIVE"), warning: Sequence[str] = ("ZERO", "GAP", "EXTREME")) -> DataFrame:
    """One row per feature row: counts by kind of exception, missing indicators, flags and the status.

    BLOCKING before WARNING before PASS. Exceptions are counted per row first, so the join is one to one.
    """
    kind = lambda *ks: F.count_if(F.col("kind").isin(*ks))
    per = exceptions.groupBy(*keys).agg(kind("MISSING", "ZERO", "NEGATIVE").alias("n_denominator"), kind("INSUFFICIENT_LAG").alias("n_lag"), kind("NO_PREVIOUS_QUARTER", "NO_YEAR_AGO", "GAP").alias("n_continuity"), kind("EXTREME").alias("n_extreme"), kind(*blocking).alias("n_blocking"), kind(*warning).alias("n_warning"))
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    x = features.select(*keys, missing.alias("n_missing")).join(per, list(keys), "left")
    counts = ["n_denominator", "n_lag", "n_continuity", "n_extreme", "n_blocking", "n_warning"]
    x = x.select(*keys, "n_missing", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return x.withColumn("status", quality_status(F.col("n_blocking"), F.col("n_warning")))


def row_tests(families: Mapping[str, str], averaged: Sequence[str], columns: Sequence[str], bound: float = EXTREME) -> list[tuple[Column, str, str]]:
    """(condition, kind, detail) of all exceptions over rows that carry denominators, ``had1``, ``gap``, ``year_ago`` and the features."""
    tests = []
    for family, c in families.items():
        tests += [(F.col(c).isNull(), "MISSING", family), (F.col(c) == 0, "ZERO", family), (F.col(c) < 0, "NEGATIVE", family)]
    tests += [(~F.col("had1"), "INSUFFICIENT_LAG", family) for family in averaged]
    tests += [(~F.col("had1"), "NO_PREVIOUS_QUARTER", "1Q"), (~F.col("year_ago"), "NO_YEAR_AGO", "4Q"), (F.col("gap"), "GAP", "GAP")]
    return tests + [(F.abs(F.col(c)) > bound, "EXTREME", c) for c in columns]


def exceptions_of_rows(rows: DataFrame, keys: Sequence[str], tests: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """(keys, kind, detail) of all kinds in one scan."""
    return _broken(rows, keys, tests)


def quality_of_rows(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], tests: Sequence[tuple[Column, str, str]], blocking: Sequence[str] = ("MISSING", "NEGATIVE"), warning: Sequence[str] = ("ZERO", "GAP", "EXTREME"), carry: Sequence[str] = ()) -> DataFrame:
    """As :func:`feature_quality` of the exceptions of ``tests``, counted in each row as it passes: no row per exception, no join.

    Rows without a key have no exceptions, as they would meet none in a join. ``carry`` names columns to hand on.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    kinds = {"n_denominator": ("MISSING", "ZERO", "NEGATIVE"), "n_lag": ("INSUFFICIENT_LAG",), "n_continuity": ("NO_PREVIOUS_QUARTER", "NO_YEAR_AGO", "GAP"), "n_extreme": ("EXTREME",), "n_blocking": blocking, "n_warning": warning}
    hits = lambda ks: sum((F.coalesce(c.cast("int"), F.lit(0)) for c, k, _ in tests if k in ks), F.lit(0))
    by_kind = {f"_{k}": hits((k,)) for k in dict.fromkeys(k for _, k, _ in tests)}
    own = [*keys[:-1], apart(F.col(keys[-1])).alias(keys[-1])]
    x = rows.select(*own, sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).alias("n_missing"), *[c.alias(n) for n, c in by_kind.items()], *carry)
    counted = {n: F.when(known, sum((F.col(f"_{k}") for k in ks if f"_{k}" in by_kind), F.lit(0))).otherwise(0).cast("long") for n, ks in kinds.items()}
    x = x.select(*keys, "n_missing", *[c.alias(n) for n, c in counted.items()], *carry)
    return x.withColumn("status", quality_status(F.col("n_blocking"), F.col("n_warning")))


def quality_status(blocking: Column, warning: Column) -> Column:
    return F.when(blocking > 0, "BLOCKING").when(warning > 0, "WARNING").otherwise("PASS")


def availability_grid(long: DataFrame, periods: DataFrame, names: Sequence[str], period: str = "period") -> DataFrame:
    """(period, feature, n_values): every period with every name, zero where there is no value. One row per period in ``periods``."""
    grid = periods.select(period).distinct().withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    n = long.groupBy(period, "feature").agg(F.count("value").alias("n"))
    return grid.join(n, [period, "feature"], "left").select(period, "feature", F.coalesce("n", F.lit(0)).alias("n_values"))


def measured(wide: DataFrame, columns: Sequence[str], period: str = "period") -> DataFrame:
    """(period, feature, n_rows, n_values): one pass over wide rows, and only then a row for each feature."""
    per = wide.groupBy(period).agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    return per.unpivot([period, "_rows"], list(columns), "feature", "n_values").withColumnRenamed("_rows", "n_rows")


def distribution(long: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Exact percentiles of every feature: p01, p05, median, p95, p99, and what isn't finite."""
    finite = F.when(F.abs(F.col("value")) < float("inf"), F.col("value"))
    q = F.percentile(finite, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    x = long.groupBy(*by).agg(F.count("value").alias("n_values"), F.count_if(F.abs(F.col("value")) == float("inf")).alias("n_infinite"), q.alias("q"))
    return x.select(*by, "n_values", "n_infinite", *[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("p01", "p05", "median", "p95", "p99"))])


def distribution_of_columns(wide: DataFrame, columns: Sequence[str], accuracy: int = 2000, carry: Sequence[str] = ()) -> DataFrame:
    """As :func:`distribution` by feature, of the columns of ``wide``, without gathering a feature's values in one task.

    The values are written once. One pass over them finds a low and a high value about each place that a percentile looks at, a second one the values
    at those places (:func:`values_at`), some of each ``accuracy`` being looked at one by one. What the driver holds are a few numbers for each column.
    ``carry`` names columns to write as well: a projection that hands on a period made by :func:`apart` stays in small methods only while the period is asked for.
    """
    held = kept(wide.select(*carry, *[F.col(c).cast("double").alias(c) for c in columns]), "values", **_LEAN)
    long = held.select(F.posexplode(F.array(*columns)).alias("at", "value")).where("value IS NOT NULL")
    finite = F.when(F.abs(F.col("value")) < float("inf"), F.col("value"))
    near = [min(1.0, max(0.0, q + d)) for q in QUANTILES.values() for d in (-2 / accuracy, 2 / accuracy)]
    counts = [F.count("*").alias("n_values"), F.count_if(F.abs(F.col("value")) == float("inf")).alias("n_infinite"), F.count(finite).alias("n")]
    totals = long.groupBy("at").agg(*counts, F.percentile_approx(finite, near, accuracy).alias("near")).collect()  # a row for each column that has values
    pairs = {r["at"]: list(zip(r["near"][::2], r["near"][1::2], strict=True)) for r in totals if r["n"]}
    places = {r["at"]: [(r["n"] - 1) * q for q in QUANTILES.values()] for r in totals if r["n"]}
    found = values_at(long.where(finite.isNotNull()), {(k, p) for k, at in places.items() for x in at for p in (math.floor(x), math.ceil(x))}, pairs)
    rows = [] if held.isEmpty() else [(c, 0, 0, *[None] * len(QUANTILES)) for c in columns]
    for r in totals:
        q = [None] * len(QUANTILES)
        for i, x in enumerate(places.get(r["at"], [])):
            low, high = found[r["at"], math.floor(x)], found[r["at"], math.ceil(x)]
            q[i] = low + (high - low) * (x - math.floor(x))
        rows[r["at"]] = (columns[r["at"]], r["n_values"], r["n_infinite"], *q)
    x = held.sparkSession.createDataFrame(rows, f"feature string, n_values long, n_infinite long, {', '.join(f'{n} double' for n in QUANTILES)}")
    return x.withColumns({n: F.round(n, 6) for n in QUANTILES})


def values_at(long: DataFrame, wanted: Iterable[tuple[int, int]], pairs: Mapping[int, Sequence[tuple[float, float]]]) -> dict[tuple[int, int], float]:
    """The value at each wanted (column, place from 0) in the order of a column's values; ``long`` has (at, value), finite values only.

    ``pairs`` are two values of the column about each place: values between two are counted one by one, all others only with what stands between two of those numbers. A
    place that was missed is between two numbers then, and looked for again between these alone.
    """
    wanted, found, pairs = set(wanted), {}, dict(pairs)
    while wanted:
        most = max(map(len, pairs.values()))
        padded = [(k, *[x for pair in [*own, *[(math.inf, math.inf)] * (most - len(own))] for x in pair]) for k, own in pairs.items()]
        ends = [f"_{side}{i}" for i in range(most) for side in ("low", "high")]
        bounds = long.sparkSession.createDataFrame(padded, f"_k int, {', '.join(f'{c} double' for c in ends)}")
        v, lowest = F.col("value"), F.lit(-math.inf)
        inside = functools.reduce(operator.or_, [(v >= F.col(f"_low{i}")) & (v <= F.col(f"_high{i}")) for i in range(most)])
        below = F.greatest(lowest, *[F.when(F.col(c) < v, F.col(c)) for c in ends])
        met = long.join(F.broadcast(bounds), F.col("at") == F.col("_k")).select("at", inside.alias("one"), F.when(inside, v).otherwise(below).alias("value"))
        counted = met.groupBy("at", "value", "one").agg(F.count("*").alias("n"))  # the rest behind a number stands behind the number itself
        own = Window.partitionBy("at").orderBy("value", F.desc("one"))
        spread = counted.withColumns({"upto": F.sum("n").over(own), "next": F.lead("value").over(own)}).withColumn("from", F.col("upto") - F.col("n"))
        asked = long.sparkSession.createDataFrame(sorted(wanted), "_k int, place long")
        holds = (F.col("at") == F.col("_k")) & (F.col("from") <= F.col("place")) & (F.col("place") < F.col("upto"))
        again: dict[int, list[tuple[float, float]]] = {}
        for r in spread.join(F.broadcast(asked), holds).select("at", "place", "one", "value", "next").collect():  # a row for each wanted place
            if r["one"]:
                found[r["at"], r["place"]] = r["value"]
            else:
                again.setdefault(r["at"], []).append((r["value"], math.inf if r["next"] is None else r["next"]))
        wanted, pairs = {k for k in wanted if k not in found}, {k: sorted(set(own)) for k, own in again.items()}
    return found


def feature_peer_groups(long: DataFrame, detailed: str, broad: str, min_n: int = 20) -> DataFrame:
    """The peer group of each value: the detailed one where it has ``min_n`` values of this very feature, else the broad one."""
    size = lambda c: F.count("value").over(Window.partitionBy(c, "feature"))
    x = long.withColumns({"nd": size(detailed), "nb": size(broad)})
    fits = F.col("nd") >= min_n
    return x.withColumns({"peer_group": F.when(fits, F.col(detailed)).otherwise(F.col(broad)), "peer_method": F.when(fits, "DETAILED").otherwise("BROAD"), "peer_count": F.when(fits, F.col("nd")).otherwise(F.col("nb"))}).drop("nd", "nb")


def period_range(spark, first: str, last: str, name: str = "period") -> DataFrame:
    """All quarter ends from one to the other."""
    steps = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 3 months"))
    return spark.range(1).select(F.explode(steps).alias("d")).select(quarter_end(F.col("d")).alias(name))
