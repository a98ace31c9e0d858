"""A company's digest: its figures, and four questions answered side by side, each failing on its own.

The sections of all companies are one table of tasks (company, section, attempt), run
through the answer flow at once. What a task comes to is data: a report, a failure of
the provider to give a usable answer, which earns one more attempt, or an error, which
is shown. Only failed tasks are planned again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import claims as cl
from ledgerlens.plans import answers
from ledgerlens.sources.staging import kept

#: The figures of a digest, and its sections in their order (key, title, question).
FIGURES = (("yoy", "revenue"), ("yoy", "net_income"), ("ratio", "net_margin"), ("yoy", "research_and_development"), ("yoy", "operating_cash_flow"))
SECTIONS = (
    ("business", "What the company does", "Which products, services and customers make up the company's business?"),
    ("performance", "How the last fiscal year went", "How did sales and profit move in the last fiscal year, and why?"),
    ("risks", "Key risks", "Which risk factors does the company report?"),
    ("management", "What management emphasizes", "Which plans, investments and prospects does management stress?"),
)
#: What a provider raises when it has answered, but not in a usable form.
UNUSABLE = "Unusable"
AGAIN = "The answer before this one could not be read."


class Unusable(ValueError):
    """A provider's answer that nothing can be made of."""


def figure_queries(companies: DataFrame) -> DataFrame:
    """Queries (query_id, cik, ticker, op, metric, fy, years, place) for the figures of every company (cik, ticker)."""
    spark = companies.sparkSession
    panel = spark.createDataFrame([(i, *q) for i, q in enumerate(FIGURES)], "place int, op string, metric string")
    none = F.lit(None).cast("int")
    return companies.crossJoin(F.broadcast(panel)).select(F.concat("cik", F.lit("-"), "place").alias("query_id"), "cik", "ticker", "op", "metric", none.alias("fy"), none.alias("years"), "place")  # five rows


def tasks(companies: DataFrame) -> DataFrame:
    """``query_id, ticker, place, key, title, question, attempt`` for the four sections of every company (ticker)."""
    plan = companies.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(SECTIONS)], "place int, key string, title string, question string")
    each = companies.select(F.upper(F.trim("ticker")).alias("ticker")).crossJoin(F.broadcast(plan))  # four rows
    return each.select(F.concat(F.lit("digest_"), F.lower("ticker"), F.lit("_"), "key").alias("query_id"), "ticker", "place", "key", "title", "question", F.lit(1).alias("attempt"))


def attempted(todo: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider: answers.Provider) -> DataFrame:
    """``todo`` with ``error`` (null if all went well), ``summary``, and the counts of its report.

    A task is looked up, written and judged like any question, and once more if a
    claim was contradicted. The summary is what is left of its claims, in their order.
    """
    asked = todo.select("query_id", "question", answers.asked_k(F.col("question")).alias("k"), *(["feedback"] if "feedback" in todo.columns else []))
    chunks = kept(answers.chosen(answers.refined(asked, retrieve, provider)), "chunks")
    made = kept(answers.generation(asked, chunks, provider), "made")
    errors = made.where("claim_id is null").select("query_id", "error")
    whole = asked.join(errors, "query_id", "left_anti")
    judged = kept(answers.judged(whole, chunks, provider, made.where("claim_id is not null").drop("error")), "judged")
    shown = judged.where("verdict <> 'CONTRADICTED'").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("claim_id"), "claim_id", "text"))), lambda c: c["text"]), " ").alias("summary"))
    report = cl.report(judged).select("query_id", "displayed", "blocked", "unsupported_rate")
    out = todo.join(errors, "query_id", "left").join(shown, "query_id", "left").join(report, "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("displayed", "blocked")}
    return out.select(*todo.columns, "error", F.coalesce("summary", F.when(F.col("error").isNull(), F.lit(answers.UNANSWERED))).alias("summary"), *zero.values(), F.coalesce("unsupported_rate", F.lit(0.0)).alias("unsupported_rate"))


def sections(companies: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider: answers.Provider) -> DataFrame:
    """``ticker, place, key, title, attempt, error, summary, displayed, blocked, unsupported_rate``: four rows for each company, whatever failed."""
    first = kept(attempted(tasks(companies), retrieve, provider), "sections")
    unusable = F.coalesce(F.col("error").startswith(UNUSABLE), F.lit(False))
    again = first.where(unusable).select(F.concat("query_id", F.lit("_r")).alias("query_id"), "ticker", "place", "key", "title", "question", F.lit(2).alias("attempt"), F.lit(AGAIN).alias("feedback"))
    second = kept(attempted(kept(again, "again"), _of_first(retrieve), provider), "sections")
    both = first.where(~unusable).drop("feedback").unionByName(second.drop("feedback"))
    return both.select("ticker", "place", "key", "title", "attempt", "error", "summary", "displayed", "blocked", "unsupported_rate")


def _of_first(retrieve: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The same search for second attempts, which it knows by their first one's id."""

    def run(asked: DataFrame) -> DataFrame:
        first = F.regexp_replace("query_id", "_r$", "")
        return retrieve(asked.withColumn("query_id", first)).withColumn("query_id", F.concat("query_id", F.lit("_r")))

    return run


def digest(companies: DataFrame, parts: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """One row for each company (ticker): ``figures``, ``sections`` in order, ``sections_ok``, ``sections_failed``, and a ``summary`` for what is asked next.

    ``figures``: ticker, place, text; none is no reason for a digest not to be.
    """
    names = ("place", "key", "title", "attempt", "error", "summary", "displayed", "blocked", "unsupported_rate")
    told = parts.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("sections"),
        F.count_if(F.col("error").isNull()).alias("sections_ok"),
        F.count_if(F.col("error").isNotNull()).alias("sections_failed"),
    )
    out = companies.select(F.upper(F.trim("ticker")).alias("ticker")).join(told, "ticker")
    if figures is None:
        out = out.withColumn("figures", F.array().cast("array<string>"))
    else:
        lines = figures.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda f: f["text"]).alias("figures"))
        out = out.join(lines, "ticker", "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<string>")))
    some = F.transform(F.filter("sections", lambda s: F.coalesce(s["summary"], F.lit("")) != ""), lambda s: F.concat(s["title"], F.lit(": "), F.substring(s["summary"], 1, 200)))
    summary = F.array_join(F.concat(F.slice("figures", 1, 3), some), " | ")
    return out.select("ticker", "figures", "sections", "sections_ok", "sections_failed", summary.alias("summary"))
