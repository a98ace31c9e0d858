"""From reported facts to one value for each (cik, metric, fiscal year).

A fact is ``cik, taxonomy, tag, unit, start_date, end_date, val, accn, fy, fp,
form, filed, frame``; a null start marks an instant. Points are computed once for
all companies, metrics and years; every numeric operation is a join or window on
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import registry

KEY = ("cik", "taxonomy", "tag", "unit", "start_date", "end_date")
POINT = ("cik", "metric", "fy", "value", "unit", "period_start", "period_end", "accn", "form", "tag", "priority")


def period_class(start: Column, end: Column) -> Column:
    """annual, quarterly, instant or other."""
    days = F.datediff(end, start)
    return (
        F.when(start.isNull(), "instant")
        .when(days.between(*registry.ANNUAL_DAYS), "annual")
        .when(days.between(*registry.QUARTER_DAYS), "quarterly")
        .otherwise("other")
    )


def latest_filed(facts: DataFrame, forms: Sequence[str] | None = registry.ANNUAL_FORMS) -> DataFrame:
    """One fact for each period: the last filed, then the larger accession. Forms are filtered first, as a proxy may be filed later and be wrong.

    An aggregation, so it combines before the shuffle; a null start groups with null starts.
    """
    if forms is not None:
        facts = facts.where(F.col("form").isin(*forms))
    rest = [c for c in facts.columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct("filed", "accn")).alias("last")
    return facts.groupBy(*KEY).agg(last).select(*KEY, "last.*")


def as_printed(facts: DataFrame, accn: str) -> DataFrame:
    """Facts of one filing, whatever its form; a period given twice keeps the larger value."""
    rest = [c for c in facts.columns if c not in KEY]
    only = facts.where(F.col("accn") == accn).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("val", "filed")).alias("one"))
    return only.select(*KEY, "one.*")


def first_of_each(facts: DataFrame, order: str) -> DataFrame:
    """Drops repeated natural keys, keeping the first by ``order``."""
    key = (*KEY, "accn", "frame")
    w = Window.partitionBy(*key).orderBy(order)
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def canonical(facts: DataFrame) -> DataFrame:
    return facts.where("frame is not null")


def tagged(facts: DataFrame) -> DataFrame:
    """Facts with the metric, kind and priority of their tag; others go."""
    tags = F.broadcast(registry.table(facts.sparkSession))  # one row for each tag in the program
    return facts.join(tags, ["taxonomy", "tag", "unit"])


def annual_candidates(deduped: DataFrame) -> DataFrame:
    """For each (cik, metric, tag, year of the period's end) its last annual fact, as a point."""
    w = Window.partitionBy("cik", "metric", "priority", "fy").orderBy(F.desc("end_date"), F.desc("start_date"))
    annual = tagged(deduped).where("kind = 'duration'").where(period_class(F.col("start_date"), F.col("end_date")) == "annual").withColumn("fy", F.year("end_date"))
    return _points(annual.withColumn("_n", F.row_number().over(w)).where("_n = 1"))


def fiscal_periods(annual: DataFrame) -> DataFrame:
    """``cik, fy, period_start, period_end``: of the first anchor metric, then tag, that has the year."""
    rank = F.element_at(F.create_map(*[x for i, m in enumerate(registry.ANCHORS) for x in (F.lit(m), F.lit(i))]), F.col("metric"))
    first = F.min_by(F.struct("period_start", "period_end"), F.struct(rank, "priority"))
    return annual.where(F.col("metric").isin(*registry.ANCHORS)).groupBy("cik", "fy").agg(first.alias("p")).select("cik", "fy", "p.*")


def instant_candidates(deduped: DataFrame, periods: DataFrame) -> DataFrame:
    """For each (cik, metric, tag, fiscal year) the instant nearest the year's end within 14 days, else the year's last."""
    instants = tagged(deduped).where("kind = 'instant' and start_date is null").drop("fy")
    around = instants.withColumn("fy", F.explode(F.array(*[F.year("end_date") + d for d in (-1, 0, 1)])))
    ends = periods.select("cik", "fy", F.col("period_end").alias("year_end"))
    off = F.abs(F.datediff("end_date", "year_end"))
    near = F.coalesce(off <= registry.INSTANT_DAYS, F.lit(False))
    w = Window.partitionBy("cik", "metric", "priority", "fy").orderBy(F.desc("_near"), F.when(F.col("_near"), F.col("_off")), F.desc("end_date"))
    met = around.join(ends, ["cik", "fy"], "left").withColumns({"_near": near, "_off": off}).where("_near or year(end_date) = fy")
    return _points(met.withColumn("_n", F.row_number().over(w)).where("_n = 1"))


def _points(facts: DataFrame) -> DataFrame:
    return facts.select(
        "cik",
        "metric",
        "fy",
        F.col("val").cast("double").alias("value"),
        "unit",
        F.col("start_date").alias("period_start"),
        F.col("end_date").alias("period_end"),
        "accn",
        "form",
        F.concat_ws(":", "taxonomy", "tag").alias("tag"),
        "priority",
    )


def by_year(candidates: DataFrame) -> DataFrame:
    """For a given year the first tag that has it wins."""
    rest = [c for c in POINT if c not in ("cik", "metric", "fy")]
    first = candidates.groupBy("cik", "metric", "fy").agg(F.min_by(F.struct(*rest), "priority").alias("p"))
    return first.select("cik", "metric", "fy", "p.*")


def latest(candidates: DataFrame) -> DataFrame:
    """The newest period over all tags; priority breaks ties only. ``fy`` is the year of the period's end."""
    rest = [c for c in POINT if c not in ("cik", "metric", "fy")]
    newest = candidates.groupBy("cik", "metric").agg(F.max_by(F.struct(*rest), F.struct("period_end", -F.col("priority"))).alias("p"))
    return newest.select("cik", "metric", F.year("p.period_end").alias("fy"), "p.*")


def latest_instants(deduped: DataFrame) -> DataFrame:
    return latest(_points(tagged(deduped).where("kind = 'instant' and start_date is null").withColumn("fy", F.year("end_date"))))


class Points:
    """All points of a fact table: ``years`` for a given fiscal year, ``newest`` without one."""

    def __init__(self, deduped: DataFrame):
        annual = annual_candidates(deduped)
        self.periods = fiscal_periods(annual)
        instant = instant_candidates(deduped, self.periods)
        self.years = by_year(annual).unionByName(by_year(instant))
        self.newest = latest(annual).unionByName(latest_instants(deduped))

    def mapped(self, change) -> Points:
        """The same points with ``change(name, table)`` for each table, as to store them."""
        out = Points.__new__(Points)
        for name in ("periods", "years", "newest"):
            setattr(out, name, change(name, getattr(self, name)))
        return out


def points(facts: DataFrame) -> Points:
    return Points(latest_filed(facts))
