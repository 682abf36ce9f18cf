"""Benchmarks of many features against their peers, exact and without a window over a whole group."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ordering import by_range_within, global_index
from panelwright.sources.scratch import kept

#: The benchmarked features, of which a high value is a good sign, a bad sign, or neither.
GOOD = ("equity_to_assets", "equity_change_yoy_pct", "return_on_assets", "return_on_equity", "net_interest_margin", "roa_mean_8q", "liquid_assets_to_total_assets", "deposits_to_total_assets")
BAD = (
    "past_due_30_89_to_total_loans", "past_due_90_plus_to_total_loans", "nonaccrual_assets_to_total_loans", "noncurrent_assets_to_total_loans", "net_chargeoffs_to_average_loans", "efficiency_ratio", "roa_volatility_8q", "loans_to_deposits",
    "fhlb_advances_to_total_assets", "estimated_deposit_outflow_pct", "funding_cost_level", "construction_to_total_loans", "largest_reported_loan_category_share", "loan_concentration_hhi", "total_asset_growth_yoy_pct", "total_loan_growth_yoy_pct", "loan_growth_minus_deposit_growth",
)
NEITHER = ("deposit_growth_yoy_pct", "multifamily_to_total_loans")
FEATURES = (*GOOD, *BAD, *NEITHER)


def final_groups(long: DataFrame, detailed: str, broad: str, min_n: int = 20) -> DataFrame:
    """Adds peer_group, peer_method and peer_count: the detailed group where it has ``min_n`` values of the row's feature, else the broad one.

    Sizes are aggregates joined back, a row for each group and feature, so a large group isn't gathered in one task.
    """
    sizes = lambda c, n: long.groupBy(F.col(c).alias(f"_{n}"), F.col("feature").alias(f"_f{n}")).agg(F.count("*").alias(n))
    x = long.join(sizes(detailed, "nd"), (F.col(detailed) == F.col("_nd")) & (F.col("feature") == F.col("_fnd"))).join(sizes(broad, "nb"), (F.col(broad) == F.col("_nb")) & (F.col("feature") == F.col("_fnb")))
    fits = F.col("nd") >= min_n
    new = {"peer_group": F.when(fits, F.col(detailed)).otherwise(F.col(broad)), "peer_method": F.when(fits, "DETAILED_FEATURE").otherwise("BROAD_FEATURE_FALLBACK")}
    return x.withColumns(new).drop("nd", "nb", "_nd", "_nb", "_fnd", "_fnb")


def _quantile(q: float, value: str) -> Column:
    """The q-quantile, linear between its neighbours, from the rows' places in their group."""
    at = (F.col("n_rows") - 1) * F.lit(q)
    low, high = (F.max(F.when(F.col("row_index") == f(at), F.col(value))) for f in (F.floor, F.ceil))
    share = F.max(at - F.floor(at))
    return low + (high - low) * share


def _placed(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return global_index(by_range_within(df, F.col(value), ["feature"]), [F.col(value)], groups=groups, ties=[F.col(value)])


def feature_benchmarks(long: DataFrame, keys: Sequence[str], detailed: str, broad: str, min_n: int = 20, good: Sequence[str] = GOOD, bad: Sequence[str] = BAD) -> DataFrame:
    """(keys, feature, value, peer group and method, peer_count, mean, median, quartiles, percentile, risk_percentile, median_difference, peer_mad, robust_z, too_small).

    ``long`` has keys, feature, value (not null) and the two candidate groups. Places inside a group come from ranges of the value, cut for each feature; medians
    and quartiles are the values at their places, so nothing but a range is ever sorted in one task. The risk percentile
    turns the percentile of good features round, keeps that of bad ones and is null for the others. The values, and then the placed values, are
    written to the shared folder, as each is read several times.
    """
    own = ["peer_group", "feature"]
    grouped = kept(final_groups(kept(long, "values"), detailed, broad, min_n).drop(detailed, broad), "grouped")
    placed = kept(_placed(grouped, own, "value"), "placed")
    stats = placed.groupBy(*own).agg(F.max("n_rows").alias("peer_count"), F.avg("value").alias("peer_mean"), *[_quantile(q, "value").alias(n) for q, n in ((0.5, "peer_median"), (0.25, "peer_p25"), (0.75, "peer_p75"))])
    x = placed.withColumn("percentile", F.when(F.col("n_rows") > 1, F.col("n_before") / (F.col("n_rows") - 1)).otherwise(0.0)).drop("row_index", "n_before", "n_rows").join(stats, own)
    x = x.withColumns({"median_difference": F.col("value") - F.col("peer_median"), "_away": F.abs(F.col("value") - F.col("peer_median"))})
    mad = _placed(x.select(*own, "_away"), own, "_away").groupBy(*own).agg(_quantile(0.5, "_away").alias("peer_mad"))
    return _judged(x.drop("_away", "median_difference").join(mad, own), min_n, good, bad)


def _judged(x: DataFrame, min_n: int, good: Sequence[str], bad: Sequence[str]) -> DataFrame:
    risk = F.when(F.col("feature").isin(*good), 1 - F.col("percentile")).when(F.col("feature").isin(*bad), F.col("percentile"))
    x = x.withColumn("median_difference", F.col("value") - F.col("peer_median"))
    return x.withColumns({"risk_percentile": risk, "robust_z": F.when(F.col("peer_mad") > 0, F.col("median_difference") / (1.4826 * F.col("peer_mad"))), "too_small": F.col("peer_count") < min_n})


def _group_benchmarks(keys: Sequence[str], names: Sequence[str], carry: Sequence[str], min_n: int, shown: Mapping[str, str] | None = None):
    """A step over rows sorted by ``_group``: benchmarks of every feature with ``min_n`` values in a group, one group in memory, a batch for each feature."""

    def one(group: pa.Table, label: str) -> Iterator[pa.RecordBatch]:
        for name in names:
            has = group.column(name).is_valid()
            rows = group.filter(has)
            n = rows.num_rows
            if n < min_n:
                continue
            v = rows.column(name).to_numpy()
            ranked = np.sort(v)
            quantile = lambda a, q: (lambda at: a[int(at)] + (a[math.ceil(at)] - a[int(at)]) * (at - int(at)))((n - 1) * q)
            middle = quantile(ranked, 0.5)
            stats = [v.mean(), middle, quantile(ranked, 0.25), quantile(ranked, 0.75), quantile(np.sort(np.abs(v - middle)), 0.5)]
            below = np.searchsorted(ranked, v, "left") / max(n - 1, 1)
            put, also = rows, list(carry)
            if shown:
                told = rows.column(shown[name]).is_valid()
                at = told.to_numpy(zero_copy_only=False)
                put, v, below, also = rows.filter(told), v[at], below[at], [shown[name], *carry]
            same = lambda x, t=None: pa.repeat(pa.scalar(x, t), put.num_rows)  # noqa: E731, B023
            cells = [*[put.column(c) for c in keys], same(name), pa.array(v), *[put.column(c) for c in also], same(label), same(n, pa.int64()), *[same(float(x)) for x in stats], pa.array(below)]
            columns = [*keys, "feature", "value", *(["shown"] if shown else []), *carry, "peer_group", "peer_count", "peer_mean", "peer_median", "peer_p25", "peer_p75", "peer_mad", "percentile"]
            yield from pa.table(cells, columns).combine_chunks().to_batches(20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = [], None
        for batch in batches:
            at, groups = 0, batch.column("_group")
            while at < batch.num_rows:
                here = groups[at].as_py()
                if here != label and held:
                    yield from one(pa.Table.from_batches(held), label)
                    held = []
                label = here
                own = pc.equal(groups, here).to_numpy(zero_copy_only=False)[at:]
                n = len(own) if own.all() else int(np.argmin(own))
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield from one(pa.Table.from_batches(held), label)

    return run


def wide_benchmarks(rows: DataFrame, keys: Sequence[str], names: Sequence[str], detailed: str, broad: str, carry: Sequence[str] = (), min_n: int = 20, good: Sequence[str] = GOOD, bad: Sequence[str] = BAD, most: int = 250_000, shown: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of :func:`feature_benchmarks`, and ``carry``, from rows that have a column for each of ``names``.

    A row is dealt to its detailed group once, with all its features, where :func:`feature_benchmarks` moves each value by itself several times. A task holds
    one group of at most ``most`` rows; features with fewer than ``min_n`` values in a group, and groups with more rows, go to :func:`feature_benchmarks`,
    which is exact for any size. Sizes come first, from one aggregate with a row for each group. ``rows`` are read twice or three times.

    ``shown`` names a whole-number column for each feature: where it is null the row's value counts among the peers' but is not put out, else it is handed on as ``shown``.
    """
    sizes = kept(rows.groupBy(F.col(detailed).alias("_g")).agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(names)]), "sizes")
    few = lambda i: F.col(f"_n{i}").between(1, min_n - 1)
    some_few = few(0)
    for i in range(1, len(names)):
        some_few = some_few | few(i)
    large = F.col("_n") > most
    seen = sizes.agg(F.count_if(large).alias("large"), F.count_if(large | some_few).alias("rest")).first()
    inside = rows
    if seen["large"]:
        inside = rows.join(F.broadcast(sizes.where(large).select(F.col("_g").alias(detailed))), detailed, "left_anti")
    dealt = inside.select(*keys, *names, *(shown or {}).values(), *carry, F.col(detailed).alias("_group")).repartition("_group").sortWithinPartitions("_group")
    stats = ("peer_mean", "peer_median", "peer_p25", "peer_p75", "peer_mad", "percentile")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "feature string, value double", *(["shown int"] if shown else []), *[f"{c} {types[c]}" for c in carry], "peer_group string, peer_count long", *[f"{c} double" for c in stats]])
    out = _judged(dealt.mapInArrow(_group_benchmarks(keys, names, carry, min_n, shown), schema).withColumn("peer_method", F.lit("DETAILED_FEATURE")), min_n, good, bad)
    if seen["rest"]:
        value = lambda i, c: F.when(F.col(c).isNotNull() & (large | few(i)), F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), *([F.col(shown[c]).alias("shown")] if shown else [])))
        left = rows.join(F.broadcast(sizes.where(large | some_few)), F.col(detailed) == F.col("_g"))
        left = left.select(*keys, *carry, detailed, broad, F.explode(F.array_compact(F.array(*[value(i, c) for i, c in enumerate(names)]))).alias("r")).select(*keys, *carry, detailed, broad, "r.*")
        rest = feature_benchmarks(left, keys, detailed, broad, min_n, good, bad).select(*out.columns)
        out = out.unionByName(rest.where("shown is not null") if shown else rest)
    return out


def benchmark_validation(bench: DataFrame, period: str = "period") -> DataFrame:
    """(feature, peer_method, counts, bounds, n_out_of_bounds, n_other_period, n_no_risk) of every feature: what a reader of the table may rely on."""
    outside = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    other = ~F.col("peer_group").startswith(F.concat(F.date_format(period, "yyyy-MM-dd"), F.lit("|")))
    return bench.groupBy("feature", "peer_method").agg(
        F.count("*").alias("n_rows"), F.count_distinct("peer_group").alias("n_groups"), F.min("peer_count").alias("min_peer_count"), F.count_if("too_small").alias("small_rows"), F.min("percentile").alias("min_percentile"), F.max("percentile").alias("max_percentile"),
        F.count_if(outside("percentile") | outside("risk_percentile")).alias("n_out_of_bounds"), F.count_if(other).alias("n_other_period"), F.count_if(F.col("risk_percentile").isNull()).alias("n_no_risk"), F.count_if(F.col("robust_z").isNull()).alias("n_no_z"),
    )
