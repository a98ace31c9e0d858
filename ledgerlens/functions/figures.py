"""Checks of a claim's figures and words against its evidence, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words, patterns, stopwords and limits of the checks.
SCALES = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6, "thousand": 1e3, "万亿": 1e12, "十亿": 1e9, "亿": 1e8, "百万": 1e6, "万": 1e4}
VALUE = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|bn|million|mn|thousand|万亿|十亿|亿|百万|万)?"
LADDER = (1e-9, 1e-6, 1e-3, 1.0, 1e3, 1e6, 1e9)
TOLERANCE = 0.002
STOPWORDS = (
    "that", "this", "these", "those", "with", "from", "have", "been", "were", "will", "would", "could",
    "should", "their", "there", "which", "while", "during", "compared", "company", "companys", "fiscal", "year", "years",
    "including", "such", "other", "more", "than", "also", "into", "over", "under", "about", "between", "primarily",
    "certain", "may", "and", "the",
)
CHANGE = (
    r"(?is)from\s+\$?([\d,]+(?:\.\d+)?)\s*(billion|million|bn|mn)?.{0,40}?to\s+\$?([\d,]+(?:\.\d+)?)\s*(billion|million|bn|mn)?"
    r".{0,40}?(?:up|down|increase[d]? of|decrease[d]? of|[+\-])\s*([\d.]+)\s*%"
)
REALIZED = "(?i)" + "|".join(
    (
        r"ha(?:s|ve)(?: been)?(?: materially)? adversely affect(?:ed)?",
        r"ha(?:s|ve) (?:materially )?adversely impact(?:ed)?",
        r"ha(?:s|ve) experienced",
        r"ha(?:s|ve) resulted in",
        r"ha(?:s|ve) (?:in the past )?(?:suffered|incurred)",
        r"has and could",
        r"were adversely affected",
        r"ha(?:s|ve) lost",
        r"ha(?:s|ve) (?:so far )?failed",
        r"ha(?:s|ve) declined",
    )
)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def _scale(word: Column) -> Column:
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.coalesce(F.try_element_at(scales, F.lower(word)), F.lit(1.0))


def values(text: Column) -> Column:
    """Figures of three digits or more, scale words applied; bare years are none."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(VALUE), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(VALUE), F.lit(2)).alias("s"))

    def kept(x: Column) -> Column:
        bare = (x["s"] == "") & ~x["n"].contains(",") & ~x["n"].contains(".")
        return (F.length(F.regexp_replace(x["n"], r"\D", "")) >= 3) & ~(bare & _number(x["n"]).between(1900, 2100))

    return F.transform(F.filter(found, kept), lambda x: _number(x["n"]) * _scale(x["s"]))


def found_in(value: Column, evidence: Column) -> Column:
    """Within 0.2 % of an evidence value, at some step of a thousand."""
    return F.exists(evidence, lambda e: (e != 0) & F.exists(F.array(*map(F.lit, LADDER)), lambda k: F.abs(value * k - e) / F.abs(F.when(e != 0, e)) < TOLERANCE))


def number_match(claim: Column, evidence: Column) -> Column:
    """Share of the claim's figures that the evidence has; null without figures. Both are arrays of values."""
    return F.when(F.size(claim) > 0, F.size(F.filter(claim, lambda v: found_in(v, evidence))) / F.size(claim))


def all_found(claim: Column, facts: Column) -> Column:
    return (F.size(claim) > 0) & F.forall(claim, lambda v: F.coalesce(found_in(v, facts), F.lit(False)))


def words(text: Column) -> Column:
    """Distinct English words of four letters or more, without stopwords."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def word_overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's words in the evidence; null with fewer than three. Both are arrays of words."""
    return F.when(F.size(claim) >= 3, F.size(F.array_intersect(claim, evidence)) / F.size(claim))


def arithmetic_ok(text: Column) -> Column:
    """Whether "from X to Y, up Z %" is true within 1.5 points; null if there is none."""
    x, xs, y, ys, z = (F.regexp_extract(text, CHANGE, i) for i in range(1, 6))
    a, b = _number(F.nullif(x, F.lit(""))) * _scale(xs), _number(F.nullif(y, F.lit(""))) * _scale(ys)
    off = F.abs(F.try_divide(F.abs(b - a), a) * 100 - z.try_cast("double"))
    return F.when(text.rlike(CHANGE) & (a > 0), off <= 1.5)


def flagged(match: Column, arithmetic: Column) -> Column:
    return F.coalesce(match < 1.0, F.lit(False)) | F.coalesce(~arithmetic, F.lit(False))


def realized_risk(text: Column) -> Column:
    """The first phrase that says a risk has come true, or null."""
    return F.nullif(F.regexp_extract(text, REALIZED, 0), F.lit(""))
