"""Which reported tags stand for which metric. Names, tags, units and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: metric: (kind, unit, tags in order of priority; taxonomy us-gaap unless given)
METRICS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "revenue": ("duration", "USD", ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "ifrs-full:Revenue")),
    "cost_of_revenue": ("duration", "USD", ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfSales", "CostOfGoodsSold")),
    "gross_profit": ("duration", "USD", ("GrossProfit",)),
    "research_and_development": ("duration", "USD", ("ResearchAndDevelopmentExpense",)),
    "operating_income": ("duration", "USD", ("OperatingIncomeLoss",)),
    "pretax_income": (
        "duration",
        "USD",
        (
            "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
            "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        ),
    ),
    "net_income": ("duration", "USD", ("NetIncomeLoss",)),
    "eps_basic": ("duration", "USD/shares", ("EarningsPerShareBasic",)),
    "eps_diluted": ("duration", "USD/shares", ("EarningsPerShareDiluted",)),
    "total_assets": ("instant", "USD", ("Assets",)),
    "total_liabilities": ("instant", "USD", ("Liabilities",)),
    "stockholders_equity": ("instant", "USD", ("StockholdersEquity",)),
    "cash_and_equivalents": ("instant", "USD", ("CashAndCashEquivalentsAtCarryingValue",)),
    "operating_cash_flow": ("duration", "USD", ("NetCashProvidedByUsedInOperatingActivities",)),
    "share_buybacks": ("duration", "USD", ("PaymentsForRepurchaseOfCommonStock",)),
    "shares_outstanding": ("instant", "shares", ("dei:EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding")),
    "current_assets": ("instant", "USD", ("AssetsCurrent",)),
    "current_liabilities": ("instant", "USD", ("LiabilitiesCurrent",)),
    "inventory": ("instant", "USD", ("InventoryNet", "InventoryFinishedGoodsNetOfReserves")),
    "accounts_payable": ("instant", "USD", ("AccountsPayableCurrent", "AccountsPayableTradeCurrent")),
    "accounts_receivable": ("instant", "USD", ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent")),
    "ppe_net": ("instant", "USD", ("PropertyPlantAndEquipmentNet",)),
    "long_term_debt": ("instant", "USD", ("LongTermDebtNoncurrent", "LongTermDebt")),
    "capex": ("duration", "USD", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    "depreciation_amortization": ("duration", "USD", ("DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "Depreciation")),
    "sga_expense": ("duration", "USD", ("SellingGeneralAndAdministrativeExpense",)),
    "interest_expense": ("duration", "USD", ("InterestExpense",)),
    "dividends_paid": ("duration", "USD", ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock")),
}

#: ratio: numerator, denominator
RATIOS: dict[str, tuple[str, str]] = {
    "gross_margin": ("gross_profit", "revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "rnd_intensity": ("research_and_development", "revenue"),
    "pretax_margin": ("pretax_income", "revenue"),
    "capex_intensity": ("capex", "revenue"),
    "da_margin": ("depreciation_amortization", "revenue"),
}

#: derived metric: components (``@prev``: a year before the first component's), formula over them, unit, note
DERIVED: dict[str, tuple[tuple[str, ...], str, str, str]] = {
    "working_capital": (("current_assets", "current_liabilities"), "{0} - {1}", "USD", "current assets − current liabilities"),
    "current_ratio": (("current_assets", "current_liabilities"), "try_divide({0}, {1})", "x", "current assets / current liabilities"),
    "quick_ratio": (("current_assets", "inventory", "current_liabilities"), "try_divide({0} - {1}, {2})", "x", "(current assets − inventory) / current liabilities"),
    "days_payable_outstanding": (
        ("accounts_payable", "accounts_payable@prev", "cost_of_revenue", "inventory", "inventory@prev"),
        "try_divide(365 * (({0} + {1}) / 2), {2} + {3} - {4})",
        "days",
        "365 × avg(accounts payable) / (COGS + Δinventory)",
    ),
}

#: the statement on which a metric is printed
STATEMENTS: dict[str, tuple[str, ...]] = {
    "income": ("revenue", "cost_of_revenue", "gross_profit", "research_and_development", "sga_expense", "operating_income", "interest_expense", "pretax_income", "net_income", "eps_basic", "eps_diluted"),
    "balance": ("total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents", "current_assets", "current_liabilities", "inventory", "accounts_payable", "accounts_receivable", "ppe_net", "long_term_debt"),
    "cashflow": ("operating_cash_flow", "share_buybacks", "capex", "depreciation_amortization", "dividends_paid"),
}

#: names on cards; others replace ``_`` by a blank
LABELS: dict[str, str] = {
    "rnd_intensity": "R&D intensity",
    "research_and_development": "R&D expense",
    "sga_expense": "SG&A expense",
    "da_margin": "D&A margin",
    "depreciation_amortization": "depreciation & amortization",
    "ppe_net": "PP&E, net",
    "eps_basic": "EPS (basic)",
    "eps_diluted": "EPS (diluted)",
    "capex": "capital expenditures",
    "capex_intensity": "capex intensity",
    "operating_cash_flow": "operating cash flow",
}

#: metrics that tell a company's fiscal period, in order
ANCHORS = ("revenue", "net_income", "operating_cash_flow")
ANNUAL_FORMS = ("10-K", "10-K/A")
REPORT_FORMS = (*ANNUAL_FORMS, "10-Q", "10-Q/A")
ANNUAL_DAYS, QUARTER_DAYS, INSTANT_DAYS = (330, 400), (60, 120), 14


def rows() -> list[tuple[str, str, str, str, str, int]]:
    """(metric, kind, unit, taxonomy, tag, priority), the table that facts are joined to."""
    out = []
    for metric, (kind, unit, tags) in METRICS.items():
        for priority, name in enumerate(tags):
            taxonomy, _, tag = name.rpartition(":")
            out.append((metric, kind, unit, taxonomy or "us-gaap", tag, priority))
    return out


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "metric string, kind string, unit string, taxonomy string, tag string, priority int")


def sql_values() -> str:
    """The same rows as a SQL VALUES list."""
    return ", ".join(f"('{m}', '{k}', '{u}', '{x}', '{t}', {p})" for m, k, u, x, t, p in rows())
