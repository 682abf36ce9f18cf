"""Column functions shared by the operators. All are native expressions; null in gives null out unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING_TOKENS = ("", "null", "none", "na", "n/a")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_TOKENS)


def safe_long(c: Column) -> Column:
    """Whole numbers only: a text with a decimal part is a parse failure, not a rounded id."""
    t = blank_to_null(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def safe_decimal(c: Column, precision: int = 38, scale: int = 6) -> Column:
    return blank_to_null(c).try_cast(f"decimal({precision},{scale})")


def safe_date(c: Column, formats: Sequence[str], sentinels: Sequence[str] = ()) -> Column:
    """The first format that parses; sentinel texts (open ends) give null."""
    t = blank_to_null(c)
    got = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date")
    return F.when(~t.isin(*sentinels), got) if sentinels else got


def finite_number(c: Column) -> Column:
    """The text as a double, null where it is no finite number."""
    d = blank_to_null(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def tri_bool(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "1", True).when(t == "0", False)


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str = "VALID") -> Column:
    """The name of the first rule that holds."""
    out = F
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(otherwise) if rules else F.lit(otherwise)


def ratio(n: Column, d: Column, scale: float = 100.0) -> Column:
    """``scale * n / d`` in doubles where d is positive."""
    return F.when(d > 0, F.lit(scale) * n.cast("double") / d.cast("double"))


def pct_change(now: Column, prior: Column, ok: Column) -> Column:
    """Change in percent of the prior value's size, where ``ok`` says that the prior row is the right period's."""
    return F.when(ok & (F.abs(prior) > 0), 100.0 * (now - prior).cast("double") / F.abs(prior).cast("double"))


def annualised(flow: Column, stock: Column, prior: Column, ok: Column) -> Column:
    """A quarter's flow over the mean of two stocks, in percent a year."""
    return F.when(ok & (stock + prior > 0), 400.0 * flow.cast("double") / ((stock + prior).cast("double") / 2.0))


def apart(c: Column) -> Column:
    """The column itself, by way of a lambda.

    For one column of a projection with dozens of others: Spark generates one method for all of such a projection, and beyond 8,000 bytes of bytecode the JVM
    only interprets it, which takes several times longer. Where there is a lambda, each expression is a method of its own.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def quarter_end(c: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", c).cast("date"), 2))


def shift_quarters(c: Column, n: int) -> Column:
    return F.last_day(F.add_months(c, 3 * n))


def is_quarter_end(c: Column) -> Column:
    return F.date_format(c, "MMdd").isin("0331", "0630", "0930", "1231")


def quarter_index(c: Column) -> Column:
    return (F.year(c) * 4 + F.quarter(c)).cast("int")


def band(c: Column, edges: Sequence[float], labels: Sequence[str], unknown: str = "UNKNOWN") -> Column:
    """The label of the half-open band that holds the value; negative or null values are unknown."""
    out = F.when(c.isNull() | (c < 0), unknown)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def exception_id(*parts: Column) -> Column:
    """A stable id from the parts; nulls are skipped."""
    return F.md5(F.concat_ws("", *[p.cast("string") for p in parts]))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sanitised(c: Column) -> Column:
    """Null in place of infinite and NaN values."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
