"""How figures are written on cards. Numbers go through ``format_number``, which rounds the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.registry import LABELS, STATEMENTS


def amount(value: Column, unit: Column) -> Column:
    """$1.23B, $4.5M, $6, 7.89x, 1.2 days, 3.45B shares; else four significant digits."""
    big, mid = F.abs(value) >= 1e9, F.abs(value) >= 1e6

    def scaled(by: float, places: int) -> Column:
        return F.format_number(value / by, places)

    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.abs(value)))).cast("int")
    plain = F.when(value == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 4), 4), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    rounded = F.when(digits >= 4, plain).otherwise(plain)
    return (
        F.when(unit == "USD", F.concat(F.lit("$"), F.when(big, F.concat(scaled(1e9, 2), F.lit("B"))).when(mid, F.concat(scaled(1e6, 1), F.lit("M"))).otherwise(F.format_number(value, 0))))
        .when(unit == "USD/shares", F.concat(F.lit("$"), F.format_number(value, 2)))
        .when(unit == "x", F.concat(F.format_number(value, 2), F.lit("x")))
        .when(unit == "days", F.concat(F.format_number(value, 1), F.lit(" days")))
        .when(unit == "shares", F.when(big, F.concat(scaled(1e9, 2), F.lit("B shares"))).otherwise(F.concat(scaled(1e6, 1), F.lit("M shares"))))
        .otherwise(rounded)
    )


def percent(fraction: Column, places: int = 1, signed: bool = False) -> Column:
    text = F.concat(F.format_number(F.abs(fraction) * 100, places), F.lit("%"))
    sign = F.when(fraction < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, text)


def points_change(pp: Column) -> Column:
    """+0.8pp"""
    return F.concat(F.when(pp < 0, "-").otherwise("+"), F.format_number(F.abs(pp), 1), F.lit("pp"))


def label(metric: Column, tag: Column | None = None) -> Column:
    """A metric's name on cards; a filer that reports ``Revenues`` prints total net revenues."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    plain = F.coalesce(F.element_at(names, metric), F.replace(metric, F.lit("_"), F.lit(" ")))
    if tag is None:
        return plain
    return F.when((metric == "revenue") & tag.endswith(":Revenues"), "total net revenues").otherwise(plain)


def filing_url(cik: Column, accn: Column, primary_doc: Column) -> Column:
    bare = F.replace(accn, F.lit("-"), F.lit(""))
    viewer = F.concat(F.lit("https://www.sec.gov/ix?doc=/Archives/edgar/data/"), cik, F.lit("/"), bare, F.lit("/"), primary_doc)
    index = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), bare, F.lit("/"), accn, F.lit("-index.htm"))
    return F.when(F.coalesce(primary_doc, F.lit("")) != "", viewer).otherwise(index)


def statement_of(metric: Column) -> Column:
    pairs = [F.lit(x) for s, metrics in STATEMENTS.items() for m in metrics for x in (m, s)]
    return F.element_at(F.create_map(*pairs), metric)


def statement_url(cik: Column, accn: Column, html_file: Column) -> Column:
    """Empty where the filing's page is not known."""
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accn, F.lit("-"), F.lit("")), F.lit("/"), html_file)
    return F.coalesce(url, F.lit(""))
