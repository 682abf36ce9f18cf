"""Sixty-five risk indicators of an entity-period panel, in one windowed pass.

Each family is a contract: feature name to SQL expression over the panel's measures, their exact-date lags
(``x1``: one quarter earlier, ``x4``: four, null unless that very quarter is there) and earlier features. Trailing
statistics over eight quarters are named by their base feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import apart, quarter_index, shift_quarters
from panelwright.operators.panel import run_length, run_start, trailing

MEASURES = ("asset", "equity", "loans", "deposits", "past_due_30", "past_due_90", "nonaccrual", "chargeoffs", "net_income", "interest_income", "expense", "roa", "margin", "efficiency", "funding_cost", "cash", "securities", "repos", "assessable", "advances", "construction", "multifamily", "residential", "commercial", "consumer_all", "cards")
LAGGED = ("asset", "equity", "loans", "deposits", "past_due_90", "nonaccrual", "roa", "funding_cost", "cash", "securities", "repos", "construction", "multifamily", "residential", "commercial", "consumer_all", "cards")


def _share(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN 100.0 * ({n}) / {d} END"


def _growth(x: str, n: int) -> str:
    return f"CASE WHEN abs({x}{n}) > 0 THEN 100.0 * ({x} - {x}{n}) / abs({x}{n}) END"


def _average(flow: str, stock: str) -> str:
    return f"CASE WHEN {stock} + {stock}1 > 0 THEN 400.0 * {flow} / (({stock} + {stock}1) / 2.0) END"


def _flag(*tests: str) -> str:
    """1 if a test holds, 0 if none does, null if all are unknown."""
    known = " AND ".join(f"({t}) IS NULL" for t in tests)
    return f"CASE WHEN {known} THEN NULL WHEN {' OR '.join(f'coalesce({t}, FALSE)' for t in tests)} THEN 1 ELSE 0 END"


_NONCURRENT = "past_due_90 + nonaccrual"
_CATEGORIES = ("construction", "multifamily", "residential", "commercial", "consumer", "cards")


def _covered(n: str) -> str:
    return " + ".join(f"({c})" for c in _category_values(n))


def _category_values(n: str) -> list[str]:
    consumer = f"greatest(consumer_all{n} - cards{n}, 0)"
    return [consumer if c == "consumer" else f"{c}{n}" for c in _CATEGORIES]


def _hhi(n: str) -> str:
    total = _covered(n)
    return f"CASE WHEN {total} > 0 THEN " + " + ".join(f"power(({c}) / ({total}), 2)" for c in _category_values(n)) + " END"


#: The names of the features, their formulas and their flags' thresholds.
FAMILIES: dict[str, dict[str, str]] = {
    "capital": {
        "equity_to_assets": _share("equity", "asset"),
        "equity_change_qoq_pct": _growth("equity", 1),
        "equity_change_yoy_pct": _growth("equity", 4),
        "equity_to_assets_change_qoq_pp": f"({_share('equity', 'asset')}) - ({_share('equity1', 'asset1')})",
        "equity_to_assets_change_yoy_pp": f"({_share('equity', 'asset')}) - ({_share('equity4', 'asset4')})",
        "capital_deterioration_flag": _flag("equity_to_assets_change_qoq_pp <= -1", "equity_to_assets_change_yoy_pp <= -2"),
    },
    "asset_quality": {
        "past_due_30_89_to_total_loans": _share("past_due_30", "loans"),
        "past_due_90_plus_to_total_loans": _share("past_due_90", "loans"),
        "nonaccrual_assets_to_total_loans": _share("nonaccrual", "loans"),
        "noncurrent_assets_to_total_loans": _share(_NONCURRENT, "loans"),
        "net_chargeoffs_to_average_loans": _average("chargeoffs", "loans"),
        "noncurrent_ratio_change_qoq_pp": f"({_share(_NONCURRENT, 'loans')}) - ({_share('past_due_901 + nonaccrual1', 'loans1')})",
        "noncurrent_ratio_change_yoy_pp": f"({_share(_NONCURRENT, 'loans')}) - ({_share('past_due_904 + nonaccrual4', 'loans4')})",
        "asset_quality_deterioration_flag": _flag("noncurrent_ratio_change_qoq_pp >= 0.5", "noncurrent_ratio_change_yoy_pp >= 1.0"),
    },
    "earnings": {
        "return_on_assets": "roa",
        "return_on_equity": _average("net_income", "equity"),
        "net_interest_margin": "margin",
        "efficiency_ratio": "efficiency",
        "net_income_to_average_assets": _average("net_income", "asset"),
        "net_interest_income_to_average_assets": _average("interest_income", "asset"),
        "noninterest_expense_to_average_assets": _average("expense", "asset"),
        "roa_change_qoq_pp": "roa - roa1",
        "roa_change_yoy_pp": "roa - roa4",
        "earnings_deterioration_flag": _flag("roa_change_qoq_pp <= -0.5", "roa_change_yoy_pp <= -1", "consecutive_loss_quarters >= 2"),
    },
    "funding": {
        "liquid_assets_to_total_assets": _share("cash + securities + repos", "asset"),
        "loans_to_deposits": _share("loans", "deposits"),
        "deposits_to_total_assets": _share("deposits", "asset"),
        "assessable_deposits_to_total_deposits": _share("assessable", "deposits"),
        "fhlb_advances_to_total_assets": _share("advances", "asset"),
        "deposit_growth_qoq_pct": _growth("deposits", 1),
        "deposit_growth_yoy_pct": _growth("deposits", 4),
        "estimated_deposit_outflow_pct": "CASE WHEN deposits1 > 0 THEN 100.0 * greatest(deposits1 - deposits, 0) / deposits1 END",
        "funding_cost_level": "funding_cost",
        "funding_cost_change_qoq_pp": "funding_cost - funding_cost1",
        "funding_cost_change_yoy_pp": "funding_cost - funding_cost4",
        "liquidity_deterioration_flag": _flag(f"({_share('cash + securities + repos', 'asset')}) - ({_share('cash1 + securities1 + repos1', 'asset1')}) <= -5", "loans_to_deposits >= 110"),
        "funding_pressure_flag": _flag("estimated_deposit_outflow_pct >= 10", "funding_cost_change_yoy_pp >= 1.5", "fhlb_advances_to_total_assets >= 15"),
    },
    "concentration": {
        "reported_real_estate_loans_to_total_loans": _share("construction + multifamily + residential", "loans"),
        **{f"{name}_to_total_loans": _share(value, "loans") for name, value in zip(("construction", "multifamily", "residential_mortgages", "commercial_industrial", "consumer", "credit_card"), _category_values(""), strict=True)},
        "largest_reported_loan_category_share": _share(f"greatest({', '.join(_category_values(''))})", "loans"),
        "loan_concentration_hhi": _hhi(""),
        "loan_category_coverage_ratio": _share(_covered(""), "loans"),
        "concentration_change_yoy": f"({_hhi('')}) - ({_hhi('4')})",
        "concentration_pressure_flag": _flag("loan_concentration_hhi >= 0.5 AND loan_category_coverage_ratio >= 60"),
    },
    "growth": {
        "total_asset_growth_qoq_pct": _growth("asset", 1),
        "total_asset_growth_yoy_pct": _growth("asset", 4),
        "total_loan_growth_qoq_pct": _growth("loans", 1),
        "total_loan_growth_yoy_pct": _growth("loans", 4),
        "equity_growth_yoy_pct": _growth("equity", 4),
        "loan_growth_minus_deposit_growth": f"({_growth('loans', 4)}) - ({_growth('deposits', 4)})",
        "rapid_asset_growth_flag": _flag("total_asset_growth_yoy_pct > 25"),
        "rapid_loan_growth_flag": _flag("total_loan_growth_yoy_pct > 25"),
        "funding_gap_flag": _flag("loan_growth_minus_deposit_growth > 15"),
    },
}
#: feature: (family, base feature, statistic)
TRAILING = {
    "equity_to_assets_slope_8q": ("capital", "equity_to_assets", "slope"),
    "equity_to_assets_volatility_8q": ("capital", "equity_to_assets", "volatility"),
    "noncurrent_ratio_slope_8q": ("asset_quality", "noncurrent_assets_to_total_loans", "slope"),
    "noncurrent_ratio_volatility_8q": ("asset_quality", "noncurrent_assets_to_total_loans", "volatility"),
    "roa_mean_8q": ("earnings", "roa", "mean"),
    "roa_volatility_8q": ("earnings", "roa", "volatility"),
}


def family_columns(family: str) -> list[str]:
    extra = ["consecutive_loss_quarters"] if family == "earnings" else []
    return [*FAMILIES[family], *extra, *(f for f, (g, _, _) in TRAILING.items() if g == family)]


def feature_columns() -> list[str]:
    return [c for family in FAMILIES for c in family_columns(family)]


def risk_features(panel: DataFrame, entity: str, period: str, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, period, 65 features, ``carry``): all families over one partitioning of the panel and one order in it, no joins between them.

    ``carry`` names columns of the panel to hand on, and may name ``had1``, whether the very quarter before is there, ``gap``, whether there is an
    earlier row but of another quarter, ``year_ago``, whether one of the four rows before is of that quarter, and ``history_row``, the row's number
    in its entity. Earlier rows are looked up whole, one look for each distance.
    """
    flags = {name: text for family in FAMILIES.values() for name, text in family.items() if name.endswith("_flag")}
    plain = {name: text for family in FAMILIES.values() for name, text in family.items() if name not in flags}
    own = Window.partitionBy(entity).orderBy(period)
    bases = {b: F.expr(plain[b]).cast("double") for _, b, _ in TRAILING.values() if b in plain}
    earlier = F.struct(F.col(period).alias("_p"), *LAGGED)
    df = panel.withColumns({"quarter_index": quarter_index(F.col(period)), **bases})
    df = df.withColumns({"history_row": F.row_number().over(own), **{f"_r{n}": F.lag(earlier, n).over(own) for n in (1, 4)}, **{f"_p{n}": F.lag(period, n).over(own) for n in (2, 3)}})
    loss = F.col("net_income") < 0
    df = df.withColumns({"_miss": run_start(loss, "history_row", own), **{name: F.round(trailing(base, entity, period, stat), 6) for name, (_, base, stat) in TRAILING.items()}})
    df = df.withColumns({f"had{n}": F.coalesce(F.col(f"_r{n}._p") == shift_quarters(F.col(period), -n), F.lit(False)) for n in (1, 4)})
    before, past = F.col("_r1._p"), F.array_compact(F.array("_r1._p", "_p2", "_p3", "_r4._p"))
    df = df.withColumns({"gap": before.isNotNull() & (before != shift_quarters(F.col(period), -1)), "year_ago": F.coalesce(F.array_contains(past, shift_quarters(F.col(period), -4)), F.lit(False))})
    df = df.withColumns({f"{c}{n}": F.when(F.col(f"had{n}"), F.col(f"_r{n}.{c}")) for c in LAGGED for n in (1, 4)} | {"consecutive_loss_quarters": run_length(loss, "history_row", "_miss")})
    df = df.withColumns({period: apart(F.col(period)), **{name: F.expr(text).cast("double") for name, text in plain.items() if name not in bases}})
    df = df.withColumns({period: apart(F.col(period)), **{name: F.expr(text) for name, text in flags.items()}})
    return df.select(entity, period, *feature_columns(), *carry)


def features_sql(panel: str, entity: str, period: str, columns: list[str], gaps: bool = False) -> str:
    """The same contract in SQL for another engine: lags by self-joins on quarter ends, statistics by windows.

    ``gaps``: lags by rows, which count only where they have the very quarter, as :func:`risk_features` has them; in a
    panel without gaps both are one.
    """
    lags = ", ".join(f"l{n}.{c} AS {c}{n}" for c in LAGGED for n in (1, 4))
    if gaps:
        on = lambda n: f"CAST(last_day(p.{period} - INTERVAL {3 * n} MONTH) AS DATE)"
        lags = ", ".join(f"CASE WHEN lag(p.{period}, {n}) OVER e = {on(n)} THEN lag(p.{c}, {n}) OVER e END AS {c}{n}" for c in LAGGED for n in (1, 4))
    joins = " ".join(f"LEFT JOIN panel l{n} ON l{n}.{entity} = p.{entity} AND l{n}.{period} = CAST(last_day(p.{period} - INTERVAL {3 * n} MONTH) AS DATE)" for n in (1, 4))
    plain = ", ".join(f"CAST({text} AS DOUBLE) AS {name}" for family in FAMILIES.values() for name, text in family.items() if not name.endswith("_flag"))
    flags = ", ".join(f"{text} AS {name}" for family in FAMILIES.values() for name, text in family.items() if name.endswith("_flag"))
    stat = {"slope": "regr_slope({0}, qi)", "volatility": "stddev_samp({0})", "mean": "avg({0})"}
    trail = ", ".join(f"round(CASE WHEN count({b}) OVER t8 = 8 THEN {stat[s].format(b)} OVER t8 END, 6) AS {f}" for f, (_, b, s) in TRAILING.items())
    return f"""WITH panel AS ({panel}),
lagged AS (SELECT p.*, {lags}, year(p.{period}) * 4 + quarter(p.{period}) AS qi, sum(CASE WHEN p.net_income < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY p.{entity} ORDER BY p.{period} ROWS UNBOUNDED PRECEDING) AS run FROM panel p {f'WINDOW e AS (PARTITION BY p.{entity} ORDER BY p.{period})' if gaps else joins}),
streaks AS (SELECT *, CASE WHEN net_income IS NOT NULL THEN CAST(sum(CASE WHEN net_income < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {entity}, run ORDER BY {period} ROWS UNBOUNDED PRECEDING) AS INTEGER) END AS consecutive_loss_quarters FROM lagged),
plain AS (SELECT *, {plain} FROM streaks),
flagged AS (SELECT *, {flags} FROM plain)
SELECT {entity}, {period}, {', '.join(columns)} FROM (SELECT *, {trail} FROM flagged WINDOW t8 AS (PARTITION BY {entity} ORDER BY {period} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""
