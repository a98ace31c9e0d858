"""Numeric operations over points: growth, averages, ratios, derived formulas, fourth quarters, series, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import registry
from ledgerlens.operators import facts as fx
from ledgerlens.operators import numbering
from ledgerlens.operators.facts import Points


def _prior(years: DataFrame, back: Column | int) -> DataFrame:
    """Points keyed by the year that looks back on them."""
    return years.select("cik", "metric", (F.col("fy") + back).alias("fy"), F.col("value").alias("prior"), F.col("fy").alias("prior_fy"), F.col("accn").alias("prior_accn"))


def yoy(p: Points, fy: int | None = None) -> DataFrame:
    """Growth over the year before, over its absolute value; companies without a prior value, or one of 0, go."""
    current = p.newest if fy is None else p.years.where(F.col("fy") == fy)
    both = current.join(_prior(p.years, 1), ["cik", "metric", "fy"]).where("prior <> 0")
    return both.withColumn("growth", (F.col("value") - F.col("prior")) / F.abs("prior"))


def cagr(p: Points, years: int = 3) -> DataFrame:
    """Compound growth from ``years`` before the latest; both ends positive."""
    both = p.newest.join(_prior(p.years, years), ["cik", "metric", "fy"]).where("prior > 0 and value > 0")
    return both.withColumn("cagr", F.pow(F.col("value") / F.col("prior"), F.lit(1.0 / years)) - 1)


def series(p: Points, years: int = 5) -> DataFrame:
    """The latest point and those of the years before it that exist, ``years`` at most."""
    newest = p.newest.withColumn("base_fy", F.col("fy"))
    before = p.years.join(p.newest.select("cik", "metric", F.col("fy").alias("base_fy")), ["cik", "metric"]).where((F.col("fy") < F.col("base_fy")) & (F.col("fy") > F.col("base_fy") - years))
    return newest.unionByName(before)


def average(p: Points, years: int = 5) -> DataFrame:
    got = series(p, years)
    return got.groupBy("cik", "metric").agg(F.avg("value").alias("average"), F.count("*").alias("n"), F.min("fy").alias("from_fy"), F.max("fy").alias("to_fy"))


def ratios(p: Points) -> DataFrame:
    """All named ratios, of every year and (``newest``) of each company's latest: numerator at the denominator's year."""
    spark = p.years.sparkSession
    names = spark.createDataFrame([(n, a, b) for n, (a, b) in registry.RATIOS.items()], "ratio string, num string, den string")
    den = p.years.withColumn("newest", F.lit(False)).unionByName(p.newest.withColumn("newest", F.lit(True)))
    den = den.select("cik", F.col("metric").alias("den"), "fy", "newest", F.col("value").alias("den_value"), F.col("unit").alias("den_unit"), F.col("accn").alias("den_accn"), F.col("tag").alias("den_tag"), F.col("period_end").alias("den_end")).where("den_value <> 0")
    num = p.years.select("cik", F.col("metric").alias("num"), "fy", F.col("value").alias("num_value"), F.col("unit").alias("num_unit"), F.col("accn").alias("num_accn"), F.col("tag").alias("num_tag"), F.col("period_end").alias("num_end"))
    return den.join(F.broadcast(names), "den").join(num, ["cik", "num", "fy"]).withColumn("value", F.col("num_value") / F.col("den_value"))


def sane(ratio: Column) -> Column:
    """A single ratio that may be shown: not rounding to 0.0 %, not beyond 150 %."""
    return F.abs(ratio).between(0.0005, 1.5)


def ratio_series(p: Points, years: int = 5) -> DataFrame:
    """Ratios of the latest year and the years before, with the change in percentage points; all-zero series go."""
    all_ratios = ratios(p)
    base = all_ratios.where("newest").select("cik", "ratio", F.col("fy").alias("base_fy"))
    got = all_ratios.where("not newest").join(base, ["cik", "ratio"]).where((F.col("fy") <= F.col("base_fy")) & (F.col("fy") > F.col("base_fy") - years))
    w = Window.partitionBy("cik", "ratio")
    asc = w.orderBy("fy")
    return (
        got.withColumn("seen", F.max(F.abs("value")).over(w))
        .where("seen >= 0.0005")
        .select("cik", "ratio", "fy", "value", ((F.col("value") - F.lag("value").over(asc)) * 100).alias("change_pp"), ((F.last("value").over(asc.rowsBetween(0, Window.unboundedFollowing)) - F.first("value").over(asc)) * 100).alias("total_pp"))
    )


def average_ratio(p: Points, years: int = 5) -> DataFrame:
    """Mean of the yearly ratios that exist."""
    base = ratios(p).where("newest").select("cik", "ratio", F.col("fy").alias("base_fy"))
    got = ratios(p).where("not newest").join(base, ["cik", "ratio"]).where((F.col("fy") <= F.col("base_fy")) & (F.col("fy") > F.col("base_fy") - years))
    return got.groupBy("cik", "ratio").agg(F.avg("value").alias("average"), F.count("*").alias("n"))


def derived(p: Points, name: str, fy: int | None = None) -> DataFrame:
    """``cik, fy, value`` and the components; companies that lack one, or would divide by zero, go."""
    parts, formula, unit, _ = registry.DERIVED[name]
    first = p.newest if fy is None else p.years.where(F.col("fy") == fy)
    out = first.where(F.col("metric") == parts[0]).select("cik", "fy", F.col("value").alias("c0"))
    for i, part in enumerate(parts[1:], 1):
        metric, _, prev = part.partition("@")
        one = p.years.where(F.col("metric") == metric).select("cik", (F.col("fy") + (1 if prev else 0)).alias("fy"), F.col("value").alias(f"c{i}"))
        out = out.join(one, ["cik", "fy"])
    value = F.expr(formula.format(*(f"c{i}" for i in range(len(parts)))))
    return out.withColumns({"value": value, "unit": F.lit(unit)}).where("value is not null")


def fourth_quarter(facts: DataFrame, p: Points) -> DataFrame:
    """Year less its three reported quarters, of the first tag that reports exactly three; for every year."""
    reports = fx.tagged(fx.latest_filed(facts, registry.REPORT_FORMS)).where("kind = 'duration'")
    quarters = reports.where(fx.period_class(F.col("start_date"), F.col("end_date")) == "quarterly").select("cik", "metric", "priority", "start_date", "end_date", F.col("val").cast("double").alias("q"))
    own = ("cik", "metric", "fy", "value", "unit", "period_end", "accn", "tag")
    year = p.years.where("period_start is not null").select(*own, "period_start")
    inside = year.join(quarters, ["cik", "metric"]).where("start_date >= period_start and end_date <= period_end")
    by_tag = inside.groupBy(*own, "priority").agg(F.countDistinct("start_date", "end_date").alias("n"), F.sum("q").alias("total"), F.max("end_date").alias("last_end")).where("n = 3")
    first = by_tag.groupBy(*own).agg(F.min_by(F.struct("total", "last_end"), "priority").alias("t"))
    return first.select("cik", "metric", "fy", (F.col("value") - F.col("t.total")).alias("q4"), "unit", F.col("t.last_end").alias("period_start"), "period_end", "accn", "tag")


def components(p: Points) -> DataFrame:
    """``cik, fy`` with a point for every component of a derived formula, and last year's as ``..@prev``: one row for each company and year."""
    parts = list(dict.fromkeys(x for f in registry.DERIVED.values() for x in f[0]))
    names = list(dict.fromkeys(x.partition("@")[0] for x in parts))
    point = F.struct("metric", "value", "unit", "accn", "tag", "period_end")
    wide = p.years.where(F.col("metric").isin(*names)).groupBy("cik", "fy").agg(*[F.max(F.when(F.col("metric") == n, point)).alias(n) for n in names])
    before = wide.select("cik", (F.col("fy") + 1).alias("fy"), *[F.col(x.partition("@")[0]).alias(x) for x in parts if "@" in x])
    return wide.join(before, ["cik", "fy"], "left")


def series_steps(got: DataFrame) -> DataFrame:
    """Step to step over the years that exist: growth, or halted and resumed where it would mislead."""
    w = Window.partitionBy("cik", "metric").orderBy("fy")
    prev = F.lag("value").over(w)
    return got.withColumn("prev", prev).withColumns(
        {
            "step": F.when((F.col("prev") > 0) & (F.col("value") == 0), "halted").when((F.col("prev") == 0) & (F.col("value") > 0), "resumed"),
            "growth": F.when(((F.col("prev") > 0) & (F.col("value") == 0)) | (F.col("prev") == 0), None).otherwise((F.col("value") - F.col("prev")) / F.abs("prev")),
        }
    )


def series_shape(got: DataFrame) -> DataFrame:
    """For each series: missing years, compound growth over its points, acceleration, years of decline."""
    steps = series_steps(got)
    w = Window.partitionBy("cik", "metric").orderBy("fy")
    steps = steps.withColumn("before", F.lag("growth").over(w)).withColumn("last_fy", F.max("fy").over(Window.partitionBy("cik", "metric")))
    at_last = F.col("fy") == F.col("last_fy")
    out = steps.groupBy("cik", "metric").agg(
        F.min("fy").alias("first_fy"),
        F.max("fy").alias("last_fy"),
        (F.count("*") - 1).alias("steps"),
        F.min("value").alias("least"),
        F.min_by("value", "fy").alias("first"),
        F.max_by("value", "fy").alias("last"),
        F.array_sort(F.collect_list("fy")).alias("years"),
        F.max(F.when(at_last, F.col("growth"))).alias("growth"),
        F.max(F.when(at_last, F.col("before"))).alias("before"),
        F.array_sort(F.collect_list(F.when((F.col("growth") < 0) & (F.col("value") > 0), F.col("fy")))).alias("declined"),
    )
    return out.select(
        "cik",
        "metric",
        "first_fy",
        "last_fy",
        "steps",
        F.array_except(F.sequence("first_fy", "last_fy"), "years").alias("missing"),
        F.when((F.col("steps") >= 2) & (F.col("least") > 0), F.pow(F.try_divide("last", "first"), 1 / F.col("steps")) - 1).alias("window_cagr"),
        F.when(F.col("growth") > F.col("before") + 0.10, "accelerated").when(F.col("growth") < F.col("before") - 0.10, "slowed").alias("pace"),
        "declined",
    )


def compare(p: Points, metric: str, fy: int | None = None) -> DataFrame:
    """Companies by value, largest first; equal values by cik."""
    points = (p.newest if fy is None else p.years.where(F.col("fy") == fy)).where(F.col("metric") == metric)
    return numbering.numbered(points.select("cik", "fy", "value", "unit"), F.desc("value"), F.col("cik"))
