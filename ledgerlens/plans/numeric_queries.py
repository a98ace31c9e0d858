"""Queries of the numeric channel and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import registry, render
from ledgerlens.operators import evals, numeric
from ledgerlens.operators import facts as fx
from ledgerlens.plans.projection import FACTS, as_sql, project
from ledgerlens.sources.staging import ingested


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir, "facts", lambda: project(spark, sf_dir, FACTS))


def stored_points(spark: SparkSession, sf_dir: str) -> fx.Points:
    """Points are computed once for all companies, metrics and years; operations are joins on them."""
    made = fx.points(facts(spark, sf_dir))
    return made.mapped(lambda name, table: ingested(spark, sf_dir, f"points-{name}", lambda: table))


def r6(column: str):
    return F.round(column, 6).alias(column)


_POINT = ("cik", "metric", "fy", "value", "period_start", "period_end", "accn", "tag")


def facts_dedup_latest_filed(spark, sf_dir):
    return fx.latest_filed(facts(spark, sf_dir)).select("cik", "tag", "start_date", "end_date", F.col("val").cast("double").alias("val"), "accn", "filed")


def facts_canonical(spark, sf_dir):
    return fx.canonical(facts(spark, sf_dir)).select("cik", "tag", "end_date", "frame", F.col("val").cast("double").alias("val"))


def facts_oracle_document(spark, sf_dir):
    """Figures as one filing prints them."""
    p = fx.Points(fx.as_printed(facts(spark, sf_dir), "K-3-1998"))
    return p.years.select(*_POINT)


def facts_first_of_each(spark, sf_dir):
    return fx.first_of_each(facts(spark, sf_dir), "filed").groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("cik").alias("companies"))


def facts_per_company(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("cik").agg(F.count("*").alias("n"))


def period_class(spark, sf_dir):
    kind = fx.period_class(F.col("start_date"), F.col("end_date"))
    return facts(spark, sf_dir).groupBy(kind.alias("period"), "form").agg(F.count("*").alias("n"))


def metric_by_year(spark, sf_dir):
    return stored_points(spark, sf_dir).years.select(*_POINT)


def metric_latest(spark, sf_dir):
    return stored_points(spark, sf_dir).newest.select(*_POINT)


def instant_at_year_end(spark, sf_dir):
    p = stored_points(spark, sf_dir)
    return p.years.where("period_start is null").join(p.periods.select("cik", "fy", F.col("period_end").alias("year_end")), ["cik", "fy"], "left").select("cik", "metric", "fy", "value", "period_end", "year_end", F.abs(F.datediff("period_end", "year_end")).cast("bigint").alias("days_off"))


def yoy(spark, sf_dir):
    return numeric.yoy(stored_points(spark, sf_dir)).select("cik", "metric", "fy", "value", "prior", r6("growth"))


def yoy_of_year(spark, sf_dir):
    return numeric.yoy(stored_points(spark, sf_dir), 1999).select("cik", "metric", "fy", "value", "prior", r6("growth"))


def cagr(spark, sf_dir):
    return numeric.cagr(stored_points(spark, sf_dir), 3).select("cik", "metric", "fy", "prior_fy", r6("cagr"))


def average(spark, sf_dir):
    return numeric.average(stored_points(spark, sf_dir), 5).select("cik", "metric", F.round("average", 2).alias("average"), "n", "from_fy", "to_fy")


def average_ratio(spark, sf_dir):
    return numeric.average_ratio(stored_points(spark, sf_dir), 5).select("cik", "ratio", r6("average"), "n")


def ratio_all(spark, sf_dir):
    return numeric.ratios(stored_points(spark, sf_dir)).where("not newest").select("cik", "ratio", "fy", r6("value"), "num_accn", "den_accn")


def ratio_guarded(spark, sf_dir):
    got = numeric.ratios(stored_points(spark, sf_dir)).where("newest").where(numeric.sane(F.col("value")))
    return got.select("cik", "ratio", "fy", r6("value"), render.percent(F.col("value")).alias("text"))


def ratio_series_pp(spark, sf_dir):
    return numeric.ratio_series(stored_points(spark, sf_dir), 5).select("cik", "ratio", "fy", r6("value"), r6("change_pp"), r6("total_pp"))


def _derived(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = numeric.derived(stored_points(spark, sf_dir), name)
        return got.select("cik", "fy", F.round("value", 6).alias("value"), "unit")

    query.__name__ = {"days_payable_outstanding": "derived_dpo"}.get(name, f"derived_{name}")
    return query


def q4_implied(spark, sf_dir):
    f = facts(spark, sf_dir)
    return numeric.fourth_quarter(f, stored_points(spark, sf_dir)).select("cik", "metric", "fy", (F.round("q4", 2) + F.lit(0.0)).alias("q4"), "period_start", "period_end", "accn")


def series_growth(spark, sf_dir):
    steps = numeric.series_steps(numeric.series(stored_points(spark, sf_dir), 6))
    return steps.select("cik", "metric", "fy", "value", "step", r6("growth"))


def series_transitions(spark, sf_dir):
    return numeric.series_steps(numeric.series(stored_points(spark, sf_dir), 10)).where("step is not null").select("cik", "metric", "fy", "step")


def series_gaps(spark, sf_dir):
    shape = numeric.series_shape(numeric.series(stored_points(spark, sf_dir), 10)).where(F.size("missing") > 0)
    return shape.select("cik", "metric", F.array_join(F.array_sort("missing"), ",").alias("missing"))


def series_shape(spark, sf_dir):
    shape = numeric.series_shape(numeric.series(stored_points(spark, sf_dir), 5))
    return shape.select("cik", "metric", "first_fy", "last_fy", "steps", r6("window_cagr"), "pace", F.array_join("declined", ",").alias("declined"))


def compare_rank(spark, sf_dir):
    return numeric.compare(stored_points(spark, sf_dir), "revenue").select("cik", "fy", "value", F.col("place").cast("bigint").alias("place"))


def card_text(spark, sf_dir):
    """The card of a value and of its growth."""
    p = stored_points(spark, sf_dir)
    got = numeric.yoy(p)
    return got.select(
        "cik",
        "metric",
        F.concat(render.label(F.col("metric"), F.col("tag")), F.lit(" FY"), "fy", F.lit(": "), render.amount(F.col("value"), F.col("unit"))).alias("value_text"),
        F.concat(F.lit("FY"), "fy", F.lit(": "), render.amount(F.col("value"), F.col("unit")), F.lit(", "), render.percent(F.col("growth"), 1, True), F.lit(" YoY (FY"), "prior_fy", F.lit(": "), render.amount(F.col("prior"), F.col("unit")), F.lit(")")).alias("growth_text"),
    )


def provenance_links(spark, sf_dir):
    """Every latest point with its filing's link, and its statement's page where it is known."""
    p = stored_points(spark, sf_dir).newest
    docs = spark.createDataFrame([(c, f"K-{c}-2000", f"d{c}.htm") for c in range(0, 25, 2)], "cik long, accn string, primary_doc string")
    pages = spark.createDataFrame([(c, f"K-{c}-2000", s, f"R{i}.htm") for c in range(0, 25, 3) for i, s in ((2, "income"), (4, "balance"))], "cik long, accn string, stmt string, html_file string")
    got = p.withColumn("stmt", render.statement_of(F.col("metric"))).join(docs, ["cik", "accn"], "left").join(pages, ["cik", "accn", "stmt"], "left")
    return got.select("cik", "metric", "accn", render.filing_url(F.col("cik"), F.col("accn"), F.col("primary_doc")).alias("source_url"), render.statement_url(F.col("cik"), F.col("accn"), F.col("html_file")).alias("stmt_url"))


def numeric_probes(spark, sf_dir):
    """Margin plausibility and staleness of every company's latest figures, with what is wrong; the tables end in 2001."""
    p = stored_points(spark, sf_dir)
    companies = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cik")).union(spark.range(100, 102).select(F.col("id").alias("cik")))
    got = evals.numeric_probes(companies, p.newest, p.years, 2001)
    return got.select("cik", "fy", r6("margin"), F.array_join("notes", "; ").alias("notes"), "numeric_ok")


_REG = f"(VALUES {registry.sql_values()}) AS reg(metric, kind, unit, taxonomy, tag, priority)"

#: Points from facts, in SQL.
BASE = f"""facts AS ({as_sql(FACTS)}),
dedup AS (
  SELECT * FROM facts WHERE form IN ('10-K', '10-K/A')
  QUALIFY row_number() OVER (PARTITION BY cik, taxonomy, tag, unit, start_date, end_date ORDER BY filed DESC, accn DESC) = 1
)"""
POINTS = """tagged AS (
  SELECT d.*, reg.metric, reg.kind, reg.priority FROM dedup AS d JOIN """ + _REG + """ ON d.taxonomy = reg.taxonomy AND d.tag = reg.tag AND d.unit = reg.unit
), annual AS (
  SELECT cik, metric, CAST(year(end_date) AS INT) AS fy, CAST(val AS DOUBLE) AS value, start_date AS period_start, end_date AS period_end, accn, taxonomy || ':' || tag AS tag, priority
  FROM tagged WHERE kind = 'duration' AND date_diff('day', start_date, end_date) BETWEEN 330 AND 400
  QUALIFY row_number() OVER (PARTITION BY cik, metric, priority, year(end_date) ORDER BY end_date DESC, start_date DESC) = 1
), periods AS (
  SELECT cik, fy, period_start, period_end FROM annual WHERE metric IN ('revenue', 'net_income', 'operating_cash_flow')
  QUALIFY row_number() OVER (PARTITION BY cik, fy ORDER BY CASE metric WHEN 'revenue' THEN 0 WHEN 'net_income' THEN 1 ELSE 2 END, priority) = 1
), points_in_time AS (
  SELECT cik, metric, CAST(val AS DOUBLE) AS value, end_date, accn, taxonomy || ':' || tag AS tag, priority FROM tagged WHERE kind = 'instant' AND start_date IS NULL
), instant AS (
  SELECT i.cik, i.metric, CAST(y.fy AS INT) AS fy, i.value, CAST(NULL AS DATE) AS period_start, i.end_date AS period_end, i.accn, i.tag, i.priority
  FROM points_in_time AS i CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) AS s
  CROSS JOIN LATERAL (SELECT year(i.end_date) + s.d AS fy) AS y
  LEFT JOIN periods AS p ON p.cik = i.cik AND p.fy = y.fy
  WHERE coalesce(abs(date_diff('day', p.period_end, i.end_date)) <= 14, false) OR year(i.end_date) = y.fy
  QUALIFY row_number() OVER (PARTITION BY i.cik, i.metric, i.priority, y.fy ORDER BY
    CASE WHEN coalesce(abs(date_diff('day', p.period_end, i.end_date)) <= 14, false) THEN 0 ELSE 1 END,
    CASE WHEN abs(date_diff('day', p.period_end, i.end_date)) <= 14 THEN abs(date_diff('day', p.period_end, i.end_date)) END, i.end_date DESC) = 1
), years AS (
  SELECT * FROM (SELECT * FROM annual UNION ALL SELECT * FROM instant) QUALIFY row_number() OVER (PARTITION BY cik, metric, fy ORDER BY priority) = 1
), newest AS (
  SELECT * FROM (
    SELECT * FROM annual
    UNION ALL SELECT cik, metric, CAST(year(end_date) AS INT), value, CAST(NULL AS DATE), end_date, accn, tag, priority FROM points_in_time
  ) QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY period_end DESC, priority) = 1
)"""
_RATIOS = ", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in registry.RATIOS.items())
RATIOS = f"""names AS (SELECT * FROM (VALUES {_RATIOS}) AS t(ratio, num, den)),
dens AS (SELECT *, false AS newest FROM years UNION ALL SELECT *, true FROM newest),
ratios AS (
  SELECT d.cik, n.ratio, d.fy, d.newest, u.value / d.value AS value, u.accn AS num_accn, d.accn AS den_accn
  FROM dens AS d JOIN names AS n ON d.metric = n.den JOIN years AS u ON u.cik = d.cik AND u.metric = n.num AND u.fy = d.fy WHERE d.value <> 0
),
recent AS (
  SELECT r.* FROM ratios AS r JOIN ratios AS b ON b.newest AND NOT r.newest AND r.cik = b.cik AND r.ratio = b.ratio WHERE r.fy <= b.fy AND r.fy > b.fy - 5
)"""


def _series(n: int) -> str:
    return f"""series AS (
  SELECT cik, metric, fy, value FROM newest
  UNION ALL SELECT y.cik, y.metric, y.fy, y.value FROM years AS y JOIN newest AS b ON y.cik = b.cik AND y.metric = b.metric WHERE y.fy < b.fy AND y.fy > b.fy - {n}
), steps AS (
  SELECT *, lag(value) OVER w AS prev,
    CASE WHEN lag(value) OVER w > 0 AND value = 0 THEN 'halted' WHEN lag(value) OVER w = 0 AND value > 0 THEN 'resumed' END AS step,
    CASE WHEN (lag(value) OVER w > 0 AND value = 0) OR lag(value) OVER w = 0 THEN NULL ELSE (value - lag(value) OVER w) / abs(lag(value) OVER w) END AS growth
  FROM series WINDOW w AS (PARTITION BY cik, metric ORDER BY fy)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _money(v: str) -> str:
    return f"""'$' || CASE WHEN abs({v}) >= 1e9 THEN format('{{:,.2f}}', {v} / 1e9) || 'B' WHEN abs({v}) >= 1e6 THEN format('{{:,.1f}}', {v} / 1e6) || 'M' ELSE format('{{:,.0f}}', {v}) END"""


P = _with(BASE, POINTS)
R = _with(BASE, POINTS, RATIOS)
_COMPONENTS = {
    "derived_working_capital": "SELECT a.cik, a.fy, round(a.value - l.value, 6) AS value, 'USD' AS unit FROM newest AS a JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' WHERE a.metric = 'current_assets'",
    "derived_current_ratio": "SELECT a.cik, a.fy, round(a.value / l.value, 6) AS value, 'x' AS unit FROM newest AS a JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' WHERE a.metric = 'current_assets' AND l.value <> 0",
    "derived_quick_ratio": "SELECT a.cik, a.fy, round((a.value - i.value) / l.value, 6) AS value, 'x' AS unit FROM newest AS a JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' JOIN years AS i ON i.cik = a.cik AND i.fy = a.fy AND i.metric = 'inventory' WHERE a.metric = 'current_assets' AND l.value <> 0",
    "derived_dpo": """SELECT a.cik, a.fy, round(365 * ((a.value + b.value) / 2) / (c.value + i.value - j.value), 6) AS value, 'days' AS unit FROM newest AS a
JOIN years AS b ON b.cik = a.cik AND b.fy = a.fy - 1 AND b.metric = 'accounts_payable' JOIN years AS c ON c.cik = a.cik AND c.fy = a.fy AND c.metric = 'cost_of_revenue'
JOIN years AS i ON i.cik = a.cik AND i.fy = a.fy AND i.metric = 'inventory' JOIN years AS j ON j.cik = a.cik AND j.fy = a.fy - 1 AND j.metric = 'inventory'
WHERE a.metric = 'accounts_payable' AND c.value + i.value - j.value <> 0""",
}
_YOY = "SELECT c.cik, c.metric, c.fy, c.value, p.value AS prior, round((c.value - p.value) / abs(p.value), 6) AS growth FROM {0} AS c JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE p.value <> 0"
_ALL = "SELECT cik, metric, fy, value, period_start, period_end, accn, tag FROM "

SQL = {
    "facts_dedup_latest_filed": _with(BASE) + "SELECT cik, tag, start_date, end_date, CAST(val AS DOUBLE) AS val, accn, filed FROM dedup",
    "facts_canonical": _with(BASE) + "SELECT cik, tag, end_date, frame, CAST(val AS DOUBLE) AS val FROM facts WHERE frame IS NOT NULL",
    "facts_oracle_document": _with(BASE.replace("form IN ('10-K', '10-K/A')", "accn = 'K-3-1998'").replace("ORDER BY filed DESC, accn DESC", "ORDER BY val DESC, filed DESC"), POINTS) + _ALL + "years",
    "facts_first_of_each": _with(BASE) + "SELECT form, count(*) AS n, count(DISTINCT cik) AS companies FROM (SELECT DISTINCT ON (cik, taxonomy, tag, unit, start_date, end_date, accn, frame) * FROM facts) GROUP BY form",
    "facts_per_company": _with(BASE) + "SELECT cik, count(*) AS n FROM facts GROUP BY cik",
    "period_class": _with(BASE) + "SELECT CASE WHEN start_date IS NULL THEN 'instant' WHEN end_date - start_date BETWEEN 330 AND 400 THEN 'annual' WHEN end_date - start_date BETWEEN 60 AND 120 THEN 'quarterly' ELSE 'other' END AS period, form, count(*) AS n FROM facts GROUP BY ALL",
    "metric_by_year": P + _ALL + "years",
    "metric_latest": P + _ALL + "newest",
    "instant_at_year_end": P + "SELECT y.cik, y.metric, y.fy, y.value, y.period_end, p.period_end AS year_end, abs(date_diff('day', p.period_end, y.period_end)) AS days_off FROM years AS y LEFT JOIN periods AS p ON p.cik = y.cik AND p.fy = y.fy WHERE y.period_start IS NULL",
    "yoy": P + _YOY.format("newest"),
    "yoy_of_year": P + _YOY.format("(SELECT * FROM years WHERE fy = 1999)"),
    "cagr": P + "SELECT c.cik, c.metric, c.fy, p.fy AS prior_fy, round(pow(c.value / p.value, 1.0 / 3) - 1, 6) AS cagr FROM newest AS c JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 3 WHERE p.value > 0 AND c.value > 0",
    "average": _with(BASE, POINTS, _series(5)) + "SELECT cik, metric, round(avg(value), 2) AS average, count(*) AS n, min(fy) AS from_fy, max(fy) AS to_fy FROM series GROUP BY cik, metric",
    "average_ratio": R + "SELECT cik, ratio, round(avg(value), 6) AS average, count(*) AS n FROM recent GROUP BY cik, ratio",
    "ratio_all": R + "SELECT cik, ratio, fy, round(value, 6) AS value, num_accn, den_accn FROM ratios WHERE NOT newest",
    "ratio_guarded": R + "SELECT cik, ratio, fy, round(value, 6) AS value, CASE WHEN value < 0 THEN '-' ELSE '' END || format('{:,.1f}', abs(value) * 100) || '%' AS text FROM ratios WHERE newest AND abs(value) BETWEEN 0.0005 AND 1.5",
    "ratio_series_pp": R + "SELECT cik, ratio, fy, round(value, 6) AS value, round((value - lag(value) OVER (PARTITION BY cik, ratio ORDER BY fy)) * 100, 6) AS change_pp, round((last_value(value) OVER w - first_value(value) OVER w) * 100, 6) AS total_pp FROM recent WINDOW w AS (PARTITION BY cik, ratio ORDER BY fy ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY max(abs(value)) OVER (PARTITION BY cik, ratio) >= 0.0005",
    **{k: P + v for k, v in _COMPONENTS.items()},
    "q4_implied": P
    + """, reports AS (
  SELECT f.cik, reg.metric, reg.priority, f.start_date, f.end_date, CAST(f.val AS DOUBLE) AS q FROM (
    SELECT * FROM facts WHERE form IN ('10-K', '10-K/A', '10-Q', '10-Q/A') QUALIFY row_number() OVER (PARTITION BY cik, taxonomy, tag, unit, start_date, end_date ORDER BY filed DESC, accn DESC) = 1
  ) AS f JOIN """.replace(", reports", ",\nreports")
    + _REG
    + """ ON f.taxonomy = reg.taxonomy AND f.tag = reg.tag AND f.unit = reg.unit WHERE reg.kind = 'duration' AND f.end_date - f.start_date BETWEEN 60 AND 120
), sums AS (
  SELECT y.cik, y.metric, y.fy, y.value, y.period_end, y.accn, r.priority, sum(r.q) AS total, max(r.end_date) AS last_end
  FROM years AS y JOIN reports AS r ON r.cik = y.cik AND r.metric = y.metric AND r.start_date >= y.period_start AND r.end_date <= y.period_end
  GROUP BY ALL HAVING count(DISTINCT (r.start_date, r.end_date)) = 3
)
SELECT cik, metric, fy, round(value - total, 2) + 0.0 AS q4, last_end AS period_start, period_end, accn FROM sums QUALIFY row_number() OVER (PARTITION BY cik, metric, fy ORDER BY priority) = 1""",
    "series_growth": _with(BASE, POINTS, _series(6)) + "SELECT cik, metric, fy, value, step, round(growth, 6) AS growth FROM steps",
    "series_transitions": _with(BASE, POINTS, _series(10)) + "SELECT cik, metric, fy, step FROM steps WHERE step IS NOT NULL",
    "series_gaps": _with(BASE, POINTS, _series(10))
    + "SELECT s.cik, s.metric, string_agg(CAST(g.fy AS VARCHAR), ',' ORDER BY g.fy) AS missing FROM (SELECT cik, metric, min(fy) AS a, max(fy) AS b FROM series GROUP BY ALL) AS s CROSS JOIN LATERAL (SELECT unnest(range(s.a, s.b + 1)) AS fy) AS g LEFT JOIN series AS x ON x.cik = s.cik AND x.metric = s.metric AND x.fy = g.fy WHERE x.fy IS NULL GROUP BY s.cik, s.metric",
    "series_shape": _with(BASE, POINTS, _series(5))
    + """, shaped AS (
  SELECT cik, metric, min(fy) AS first_fy, max(fy) AS last_fy, count(*) - 1 AS steps, min(value) AS least, arg_min(value, fy) AS first, arg_max(value, fy) AS last,
    max(growth) FILTER (WHERE fy = last_year) AS g, max(before) FILTER (WHERE fy = last_year) AS b, coalesce(string_agg(CAST(fy AS VARCHAR), ',' ORDER BY fy) FILTER (WHERE growth < 0 AND value > 0), '') AS declined
  FROM (SELECT *, lag(growth) OVER (PARTITION BY cik, metric ORDER BY fy) AS before, max(fy) OVER (PARTITION BY cik, metric) AS last_year FROM steps) GROUP BY cik, metric
)
SELECT cik, metric, first_fy, last_fy, steps, CASE WHEN steps >= 2 AND least > 0 THEN round(pow(last / first, 1.0 / steps) - 1, 6) END AS window_cagr,
  CASE WHEN g > b + 0.10 THEN 'accelerated' WHEN g < b - 0.10 THEN 'slowed' END AS pace, declined FROM shaped""".replace(", shaped", ",\nshaped"),
    "compare_rank": P + "SELECT cik, fy, value, row_number() OVER (ORDER BY value DESC, cik) AS place FROM newest WHERE metric = 'revenue'",
    "card_text": P
    + "SELECT c.cik, c.metric, "
    + "CASE WHEN c.metric = 'revenue' AND c.tag LIKE '%:Revenues' THEN 'total net revenues' WHEN c.metric = 'research_and_development' THEN 'R&D expense' ELSE replace(c.metric, '_', ' ') END || ' FY' || c.fy || ': ' || "
    + _money("c.value")
    + " AS value_text, 'FY' || c.fy || ': ' || "
    + _money("c.value")
    + " || ', ' || CASE WHEN c.value < p.value THEN '-' ELSE '+' END || format('{:,.1f}', abs((c.value - p.value) / abs(p.value)) * 100) || '% YoY (FY' || p.fy || ': ' || "
    + _money("p.value")
    + " || ')' AS growth_text FROM newest AS c JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE p.value <> 0",
    "provenance_links": P
    + """SELECT cik, metric, accn,
  CASE WHEN cik % 2 = 0 AND accn = 'K-' || cik || '-2000' THEN 'https://www.sec.gov/ix?doc=/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/d' || cik || '.htm'
    ELSE 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm' END AS source_url,
  CASE WHEN cik % 3 = 0 AND accn = 'K-' || cik || '-2000' AND metric IN ('revenue', 'cost_of_revenue', 'gross_profit', 'research_and_development', 'operating_income', 'net_income') THEN 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/R2.htm'
    WHEN cik % 3 = 0 AND accn = 'K-' || cik || '-2000' AND metric IN ('total_assets', 'current_assets', 'current_liabilities', 'inventory', 'accounts_payable') THEN 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/R4.htm' ELSE '' END AS stmt_url
FROM newest""",
    "numeric_probes": P
    + """, companies AS (SELECT CAST(n_nationkey AS BIGINT) AS cik FROM nation UNION ALL SELECT 100 UNION ALL SELECT 101),
met AS (SELECT c.cik, r.fy, r.value AS rev, CASE WHEN r.cik IS NOT NULL THEN y.value ELSE i.value END AS ni FROM companies AS c LEFT JOIN newest AS r ON r.cik = c.cik AND r.metric = 'revenue'
  LEFT JOIN years AS y ON y.cik = c.cik AND y.fy = r.fy AND y.metric = 'net_income' LEFT JOIN newest AS i ON i.cik = c.cik AND i.metric = 'net_income'),
m AS (SELECT *, CASE WHEN rev > 0 THEN ni / rev END AS margin FROM met),
told AS (SELECT *, list_filter([CASE WHEN rev IS NULL THEN 'revenue not resolvable from official data' END, CASE WHEN ni IS NULL THEN 'net income not resolvable from official data' END,
  CASE WHEN abs(margin) > 1 OR (abs(margin) > 0 AND abs(margin) < 0.001) THEN 'net margin ' || CASE WHEN margin < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(margin) * 100) || '% implausible — scale pollution suspected' END,
  CASE WHEN fy < 1999 THEN 'latest annual revenue is FY' || fy || ' — stale tag?' END], lambda x: x IS NOT NULL) AS notes FROM m)
SELECT cik, fy, round(margin, 6) AS margin, array_to_string(notes, '; ') AS notes, len(notes) = 0 AS numeric_ok FROM told""".replace(", companies", ",\ncompanies"),
}

_FUNCTIONS = (
    facts_dedup_latest_filed, facts_canonical, facts_oracle_document, facts_first_of_each, facts_per_company, period_class, metric_by_year, metric_latest, instant_at_year_end,
    yoy, yoy_of_year, cagr, average, average_ratio, ratio_all, ratio_guarded, ratio_series_pp, *map(_derived, registry.DERIVED),
    q4_implied, series_growth, series_transitions, series_gaps, series_shape, compare_rank, card_text, provenance_links, numeric_probes,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
