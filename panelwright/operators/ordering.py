"""Row numbers of a whole table, and what is picked by them, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.scratch import kept

RANGE = "_range"


def by_range(df: DataFrame, by: Column) -> DataFrame:
    """``df`` with the number of the range that ``by`` falls in, the ranges cut at approximate quantiles, one for each shuffle partition.

    ``by`` is a number that grows with the order wanted; ties share a range. Nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = by.cast("double")
    cuts = sorted(set(df.select(x.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    return df.withColumn(RANGE, F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x)) if cuts else 0))


def by_range_within(df: DataFrame, by: Column, within: Sequence[str]) -> DataFrame:
    """As :func:`by_range`, but cut for each value of ``within`` by itself: few values, such as the names of measures or the periods.

    The cuts come from one mergeable aggregate, written once, so that all who read the ranges see the same ones even where tasks run again,
    and are broadcast: an array for each value of ``within``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = by.cast("double")
    cuts = df.groupBy(*[F.col(c).alias(f"_w{c}") for c in within]).agg(F.array_distinct(F.percentile_approx(x, [i / n for i in range(1, n)] or [1.0], 20 * n)).alias("_cuts"))
    cuts = kept(cuts, "cuts")
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w{c}"))
    met = df.join(F.broadcast(cuts), same)
    return met.withColumn(RANGE, F.when(x.isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < x)))).drop("_cuts", *[f"_w{c}" for c in within])


def by_digest(df: DataFrame, digest: Column, digits: int = 3) -> DataFrame:
    """``df`` with the number that a hexadecimal digest's first digits make: even ranges of the digest's order, without a look at the data."""
    return df.withColumn(RANGE, F.conv(F.substring(digest, 1, digits), 16, 10).cast("int"))


def global_index(ranged: DataFrame, order: Sequence[Column], name: str = "row_index", groups: Sequence[str] = (), ties: Sequence[Column] = (), equal: str = "") -> DataFrame:
    """Adds ``name``, each row's place from 0 in the order of its range and then ``order``, and ``n_rows``; by ``groups`` if given.

    With ``ties``, the beginning of ``order`` by which rows count as equal, also ``n_before``: the rows that stand before a row and its equals.

    With ``equal``, also a column of that name: the rows that are equal by ``ties`` (which are then plain ascending columns), itself included.

    The ranges are those of :func:`by_range` or :func:`by_digest`. Each is numbered by itself; the rows of the ranges before it come
    from one row for each range and group, which are broadcast. The range's number is dropped.
    """
    keys = [*groups, RANGE]
    whole = Window.partitionBy(*groups)
    totals = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(*[F.col(c).alias(f"_b{c}") for c in keys], before.alias("_before"), F.sum("_n").over(whole).alias("n_rows"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    inside = Window.partitionBy(*keys)
    numbered = ranged.withColumn("_at", F.row_number().over(inside.orderBy(*order)))
    new = {name: F.col("_before") + F.col("_at") - 1}
    if ties:
        numbered = numbered.withColumn("_rank", F.rank().over(inside.orderBy(*ties)))
        new["n_before"] = F.col("_before") + F.col("_rank") - 1
    if equal:
        numbered = numbered.withColumn(equal, F.count("*").over(Window.partitionBy(*keys, *ties)))  # in the order that the rows have by now
    return numbered.join(F.broadcast(base), same).withColumns(new).drop("_before", "_at", "_rank", RANGE, *[f"_b{c}" for c in keys])


def places_within(df: DataFrame, groups: Sequence[str], score: str, key: str) -> DataFrame:
    """Adds each row's places by falling ``score`` among the rows of its group: ``place`` from 1, ties by ``key``; ``n_before`` and ``n_below``, rows of a greater and of a lesser score; ``n_rows``.

    Nulls are the least score. A group is cut into ranges of the score, so none is one task.
    """
    down = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    ranged = by_range_within(df, down, groups)
    equal = Window.partitionBy(*groups, RANGE, score)
    ranged = ranged.withColumn("_equal", F.count("*").over(equal))
    x = global_index(ranged, [F.desc(score), F.col(key)], "place", groups, [F.desc(score)])
    return x.withColumns({"place": F.col("place") + 1, "n_below": F.col("n_rows") - F.col("n_before") - F.col("_equal")}).drop("_equal")


def systematic_sample(df: DataFrame, by: Column, order: Sequence[Column], most: int = 10_000) -> DataFrame:
    """Every k-th row of the table in order, ``most`` rows at the most; k is the rows in all over ``most``, rounded down, 1 at least.

    ``by`` is a number that grows with ``order``. The row's place stays as ``row_index``.
    """
    x = global_index(by_range(df, by), order).withColumn("_k", F.greatest(F.lit(1).cast("long"), F.expr(f"n_rows div {most}")))
    return x.where(f"row_index % _k = 0 AND row_index div _k < {most}").drop("n_rows", "_k")


def evenly_spaced(df: DataFrame, by: Column, order: Sequence[Column], most: int = 300) -> DataFrame:
    """At most ``most`` rows at even distances, first and last among them: places floor(i (n - 1) / (m - 1)), m being ``most`` or n if less.

    Adds ``point``, the number i. ``by`` is a number that grows with ``order``.
    """
    x = global_index(by_range(df, by), order).withColumn("_m", F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.col("n_rows")) - 1))
    x = x.withColumn("_i", F.expr("row_index * _m div greatest(1, n_rows - 1)"))  # the number, or one less
    at = F.filter(F.array(F.col("_i"), F.col("_i") + 1), lambda i: (i <= F.col("_m")) & (F.floor(i * (F.col("n_rows") - 1) / F.col("_m")) == F.col("row_index")))
    return x.withColumn("point", F.get(at, 0)).where("point IS NOT NULL").drop("n_rows", "row_index", "_m", "_i")
