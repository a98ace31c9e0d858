"""Queries of the planner, the router's guards, page text and the stream, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import registry
from ledgerlens.plans import answers, digest, planner
from ledgerlens.plans.numeric_queries import BASE, POINTS, RATIOS, _money, facts, stored_points
from ledgerlens.plans.projection import LOG, as_sql, project
from ledgerlens.sources import filings
from ledgerlens.sources.staging import folder
from ledgerlens.streaming import events

_OPS = [
    ("value", "revenue", None, None), ("yoy", "revenue", None, None), ("yoy", "net_income", 1999, None), ("cagr", "gross_profit", None, 3), ("average", "revenue", None, 4), ("average", "net_margin", None, 3),
    ("series", "revenue", None, 5), ("series", "gross_margin", None, 4), ("ratio", "operating_margin", None, None), ("ratio", "revenue", None, None), ("yoy", "net_margin", 1998, None), ("q4", "revenue", 1999, None),
    ("q4", "current_assets", None, None), ("compare", "revenue", None, None), ("value", "working_capital", None, None), ("yoy", "quick_ratio", None, None), ("guess", "net_income", 1997, None), ("value", "nonsense", None, None),
]


def _nations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cik"), F.col("n_name").alias("ticker"))


def _asked(spark, sf_dir):
    """The questions, for every company; a comparison ranks it with the two after it."""
    nations = _nations(spark, sf_dir)
    ops = spark.createDataFrame([(i, *o) for i, o in enumerate(_OPS)], "i int, op string, metric string, fy int, years int")
    peer = nations.select(F.explode(F.array(*[F.pmod(F.col("cik") - d, F.lit(25)) for d in (0, 1, 2)])).alias("of"), F.struct("cik", "ticker").alias("peer"))
    peers = peer.groupBy("of").agg(F.collect_list("peer").alias("peers"))
    asked = nations.join(peers, F.col("cik") == F.col("of")).drop("of").crossJoin(F.broadcast(ops))  # eighteen rows
    return asked.withColumn("query_id", F.concat("cik", F.lit("-"), "i"))


def numeric_cards(spark, sf_dir):
    """Eighteen questions to every company: the cards word for word."""
    cards = planner.execute(_asked(spark, sf_dir), stored_points(spark, sf_dir), facts(spark, sf_dir))
    return cards.select("query_id", "fy", F.round("value", 4).alias("value"), "text")


#: The questions of one answer, in order; the last is one too many.
_ANSWER = (0, 1, 2, 3, 8, 5, 6)


def answer_cards(spark, sf_dir):
    """Seven questions as one answer: six count, and of those the ones that are neither stale nor contained in another."""
    place = F.array_position(F.array(*map(F.lit, _ANSWER)), F.col("i"))
    asked = _asked(spark, sf_dir).where(F.col("i").isin(*_ANSWER)).withColumns({"pos": place, "answer_id": F.col("cik").cast("string")})
    cards = planner.answered(asked.drop("query_id"), stored_points(spark, sf_dir), facts(spark, sf_dir))
    return cards.select("answer_id", "fy", "text", F.array_join(F.array_sort("sources"), ";").alias("sources"))


def scoped_cards(spark, sf_dir):
    """The same questions to one filing of each company, as it prints its figures."""
    ops = spark.createDataFrame([(0, "value", "revenue"), (1, "yoy", "revenue"), (2, "value", "net_income"), (3, "value", "working_capital")], "pos int, op string, metric string")
    asked = _nations(spark, sf_dir).crossJoin(F.broadcast(ops)).select(
        F.col("cik").cast("string").alias("answer_id"), "pos", "cik", "ticker", "op", "metric", F.lit(None).cast("int").alias("fy"), F.lit(None).cast("int").alias("years"),
        F.col("cik").alias("scope_cik"), F.concat(F.lit("K-"), "cik", F.lit("-1998")).alias("scope_accn"),
    )
    return planner.answered(asked, stored_points(spark, sf_dir), facts(spark, sf_dir)).select("answer_id", "fy", F.round("value", 4).alias("value"), "text")


def query_refusals(spark, sf_dir):
    """Questions of eighteen kinds to every company that have no card, each with its reason."""
    asked = _asked(spark, sf_dir)
    return planner.refused(asked, planner.execute(asked, stored_points(spark, sf_dir), facts(spark, sf_dir)))


_NAMES = {"op": ("value", "yoy", "cagr", "average", "q4", "series", "compare", "ratio", "guess"), "metric": ("revenue", "net_margin", "quick_ratio", "current_assets", "nonsense")}


def query_precedence(spark, sf_dir):
    """Which way answers what each order stands for: an operation by its key, a metric by its customer's."""
    pick = lambda name, key: F.element_at(F.array(*map(F.lit, _NAMES[name])), (F.col(key) % len(_NAMES[name]) + 1).cast("int")).alias(name)
    q = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", pick("op", "o_orderkey"), pick("metric", "o_custkey"))
    return q.select("o_orderkey", "op", "metric", planner.route(F.col("op"), F.col("metric")).alias("path"))


#: A router's word on every turn of a conversation, worded for both engines.
_ROUTED = """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'narrative' WHEN 3 THEN 'out_of_scope' ELSE 'odd' END AS route, CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END AS n,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 'no advice' ELSE '' END AS refusal, turn % 4 >= 2 AS fully, concat(substring(coalesce(text, ''), 1, 60), CASE WHEN conv_id % 4 < 2 THEN ' What was revenue?' ELSE ' Write a poem' END) AS question FROM {conversations}"""


def route_contract(spark, sf_dir):
    """The router's word under its guards, for every turn of a conversation."""
    settled = answers.settled_route(F.col("route"), F.col("n"), F.col("refusal"), F.col("fully"), F.col("question"))
    return project(spark, sf_dir, _ROUTED).select("conv_id", "turn", "route", settled.alias("settled"))


def html_to_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", filings.page_text(F.col("html")).alias("text"))


def digest_panel(spark, sf_dir):
    """The figures of a company's digest, in their fixed order."""
    asked = digest.figure_queries(_nations(spark, sf_dir))
    cards = planner.execute(asked.drop("place"), stored_points(spark, sf_dir), facts(spark, sf_dir))
    return cards.join(asked.select("query_id", "place"), "query_id").select("cik", F.col("place").cast("bigint").alias("place"), "fy", F.round("value", 6).alias("value"), "text")


def events_daily_stream(spark, sf_dir):
    """Daily counts by Structured Streaming over the log, run until all is processed."""
    at = f"{folder(spark)}/ledgerlens/stream-{uuid.uuid4().hex}"
    log = project(spark, sf_dir, LOG).select(F.col("ts").cast("timestamp").alias("ts"), "event", "query_id")
    log.unionByName(spark.sql("SELECT timestamp '2100-01-01' AS ts, 'end' AS event, 'end' AS query_id")).write.json(f"{at}/log")
    query = events.to_table(events.daily_counts(events.tail(spark, f"{at}/log", "ts timestamp, event string, query_id string")), f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").where("event <> 'end'")


_FACT = "{0}.accn || '|' || {0}.tag || '|' || {0}.period_end"
_PCT = lambda v, places=1, plus="": f"CASE WHEN {v} < 0 THEN '-' ELSE '{plus}' END || format('{{:,.{places}f}}', abs({v}) * 100) || '%'"
_PP = lambda v: f"CASE WHEN {v} < 0 THEN '-' ELSE '+' END || format('{{:,.1f}}', abs({v})) || 'pp'"
_LABEL = lambda x: f"CASE WHEN {x}.metric = 'revenue' AND {x}.tag LIKE '%:Revenues' THEN 'total net revenues' WHEN {x}.metric = 'research_and_development' THEN 'R&D expense' ELSE replace({x}.metric, '_', ' ') END"
_GROWN = f"n.name || ' ' || replace(c.metric, '_', ' ') || ' FY' || c.fy || ': ' || {_money('c.value')} || ', ' || {_PCT('((c.value - p.value) / abs(p.value))', 1, '+')} || ' YoY (FY' || p.fy || ': ' || {_money('p.value')} || ')'"
_ONE = f"n.name || ' ' || replace(r.ratio, '_', ' ') || ' FY' || r.fy || ': ' || {_PCT('r.value')} || ' (= ' || {_money('r.nv')} || ' / ' || {_money('r.dv')} || ')'"
_TWO = f"[{_FACT.format('c')}, {_FACT.format('p')}]"
_PART = lambda x: f"replace({x}.metric, '_', ' ') || ' ' || {_money(x + '.value')}"
_CARDS = f"""WITH {BASE},
{POINTS},
n AS (SELECT CAST(n_nationkey AS BIGINT) AS cik, n_name AS name FROM nation),
names AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in registry.RATIOS.items())}) AS t(ratio, num, den)),
rat AS (
  SELECT d.cik, k.ratio, d.fy, d.newest, u.value / d.value AS value, u.value AS nv, d.value AS dv, {_FACT.format('u')} AS nf, {_FACT.format('d')} AS df
  FROM (SELECT *, false AS newest FROM years UNION ALL SELECT *, true FROM newest) AS d JOIN names AS k ON d.metric = k.den JOIN years AS u ON u.cik = d.cik AND u.metric = k.num AND u.fy = d.fy WHERE d.value <> 0),
ser AS (SELECT *, fy AS base FROM newest UNION ALL SELECT y.*, b.fy FROM years AS y JOIN newest AS b ON y.cik = b.cik AND y.metric = b.metric WHERE y.fy < b.fy),
rs AS (SELECT r.*, b.fy AS base, lag(r.value) OVER (PARTITION BY r.cik, r.ratio ORDER BY r.fy) AS prev FROM rat AS r JOIN rat AS b ON b.newest AND NOT r.newest AND r.cik = b.cik AND r.ratio = b.ratio WHERE r.fy <= b.fy),
s0 AS (SELECT *, lag(value) OVER (PARTITION BY cik ORDER BY fy) AS prev FROM ser WHERE metric = 'revenue' AND fy > base - 5),
s1 AS (SELECT *, CASE WHEN (prev > 0 AND value = 0) OR prev = 0 THEN NULL ELSE (value - prev) / abs(prev) END AS g FROM s0),
s2 AS (SELECT *, lag(g) OVER (PARTITION BY cik ORDER BY fy) AS gb FROM s1),
s3 AS (SELECT cik, max(fy) AS fy, min(fy) AS low, count(*) - 1 AS n, min(value) AS least, arg_min(value, fy) AS first, arg_max(value, fy) AS value, arg_max(tag, fy) AS tag, 'revenue' AS metric, list(fy) AS fys, list({_FACT.format('s2')} ORDER BY fy) AS sources,
  max(g) FILTER (fy = base) AS g, max(gb) FILTER (fy = base) AS gb, string_agg('FY' || fy, ', ' ORDER BY fy) FILTER (g < 0 AND value > 0) AS down,
  string_agg('FY' || fy || ' ' || {_money('value')} || CASE WHEN prev IS NULL THEN '' WHEN prev > 0 AND value = 0 THEN ' (halted)' WHEN prev = 0 AND value > 0 THEN ' (resumed)' WHEN prev = 0 THEN '' ELSE ' (' || {_PCT('g', 1, '+')} || ')' END, '; ' ORDER BY fy) AS line FROM s2 GROUP BY cik),
s4 AS (SELECT *, list_filter([
    CASE WHEN len(fys) < fy - low + 1 THEN array_to_string(list_transform(list_filter(range(low, fy + 1), lambda y: NOT list_contains(fys, y)), lambda y: 'FY' || y), ', ') || ' not in the official data' END,
    CASE WHEN n >= 2 AND least > 0 THEN n || '-yr CAGR ' || {_PCT('(pow(value / first, 1.0 / n) - 1)', 1, '+')} END,
    CASE WHEN n >= 2 AND g > gb + 0.10 THEN 'growth accelerated in FY' || fy WHEN n >= 2 AND g < gb - 0.10 THEN 'growth slowed in FY' || fy END,
    CASE WHEN down IS NOT NULL THEN 'declined in ' || down END], lambda x: x IS NOT NULL) AS extras FROM s3),
quarters AS (SELECT cik, sum(CAST(val AS DOUBLE)) AS q, count(*) AS k, year_fy FROM (
  SELECT f.cik, f.val, y.fy AS year_fy, f.tag FROM facts AS f JOIN years AS y ON y.cik = f.cik AND y.metric = 'revenue' AND y.fy = 1999 AND f.start_date >= y.period_start AND f.end_date <= y.period_end
  WHERE f.form = '10-Q' AND f.tag IN ('Revenues', 'SalesRevenueNet', 'RevenueFromContractWithCustomerExcludingAssessedTax') AND f.start_date IS NOT NULL) GROUP BY cik, year_fy, tag HAVING count(*) = 3),
cards AS (
  SELECT c.cik, 0 AS i, c.fy, c.value, n.name || ' ' || {_LABEL('c')} || ' FY' || c.fy || ': ' || {_money('c.value')} AS text, [{_FACT.format('c')}] AS sources FROM newest AS c JOIN n ON n.cik = c.cik WHERE c.metric = 'revenue'
  UNION ALL SELECT c.cik, 1, c.fy, (c.value - p.value) / abs(p.value), {_GROWN}, {_TWO} FROM newest AS c JOIN n ON n.cik = c.cik JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE c.metric = 'revenue' AND p.value <> 0
  UNION ALL SELECT c.cik, 2, c.fy, (c.value - p.value) / abs(p.value), {_GROWN}, {_TWO} FROM years AS c JOIN n ON n.cik = c.cik JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE c.metric = 'net_income' AND c.fy = 1999 AND p.value <> 0
  UNION ALL SELECT c.cik, 3, c.fy, pow(c.value / p.value, 1.0 / 3) - 1, n.name || ' gross profit 3-year CAGR: ' || {_PCT('(pow(c.value / p.value, 1.0 / 3) - 1)', 2, '+')} || ' (FY' || p.fy || ' ' || {_money('p.value')} || ' → FY' || c.fy || ' ' || {_money('c.value')} || ')', {_TWO}
    FROM newest AS c JOIN n ON n.cik = c.cik JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 3 WHERE c.metric = 'gross_profit' AND p.value > 0 AND c.value > 0
  UNION ALL SELECT s.cik, 4, max(s.fy), avg(s.value), any_value(n.name) || ' revenue ' || count(*) || '-year average (FY' || min(s.fy) || '–FY' || max(s.fy) || '): ' || {_money('avg(s.value)')}, list({_FACT.format('s')} ORDER BY s.fy) FROM ser AS s JOIN n ON n.cik = s.cik WHERE s.metric = 'revenue' AND s.fy > s.base - 4 GROUP BY s.cik
  UNION ALL SELECT r.cik, 5, max(r.fy), avg(r.value), any_value(n.name) || ' net margin ' || count(*) || '-year average (FY' || min(r.fy) || '–FY' || max(r.fy) || '): ' || {_PCT('avg(r.value)')} || ' (' || string_agg('FY' || r.fy || ' ' || {_PCT('r.value')}, '; ' ORDER BY r.fy) || ')', flatten(list([r.nf, r.df] ORDER BY r.fy))
    FROM rs AS r JOIN n ON n.cik = r.cik WHERE r.ratio = 'net_margin' AND r.fy > r.base - 3 GROUP BY r.cik
  UNION ALL SELECT s.cik, 6, s.fy, s.value, n.name || ' ' || {_LABEL('s')} || ': ' || s.line || CASE WHEN len(s.extras) > 0 THEN ' — ' || array_to_string(s.extras, '; ') ELSE '' END, s.sources FROM s4 AS s JOIN n ON n.cik = s.cik
  UNION ALL SELECT r.cik, 7, max(r.fy), (arg_max(r.value, r.fy) - arg_min(r.value, r.fy)) * 100, any_value(n.name) || ' gross margin trend: ' || string_agg('FY' || r.fy || ' ' || {_PCT('r.value')} || CASE WHEN r.fy = r.first_fy THEN '' ELSE ' (' || {_PP('((r.value - r.prev) * 100)')} || ')' END, '; ' ORDER BY r.fy)
    || ' — ' || {_PP('((arg_max(r.value, r.fy) - arg_min(r.value, r.fy)) * 100)')} || ' over ' || (count(*) - 1) || ' years', flatten(list([r.nf, r.df] ORDER BY r.fy))
    FROM (SELECT *, min(fy) OVER (PARTITION BY cik) AS first_fy FROM rs WHERE ratio = 'gross_margin' AND fy > base - 4) AS r JOIN n ON n.cik = r.cik GROUP BY r.cik HAVING max(abs(r.value)) >= 0.0005
  UNION ALL SELECT r.cik, 8, r.fy, r.value, {_ONE}, [r.nf, r.df] FROM rat AS r JOIN n ON n.cik = r.cik WHERE r.newest AND r.ratio = 'operating_margin' AND abs(r.value) BETWEEN 0.0005 AND 1.5
  UNION ALL SELECT r.cik, 10, r.fy, r.value, {_ONE}, [r.nf, r.df] FROM rat AS r JOIN n ON n.cik = r.cik WHERE NOT r.newest AND r.fy = 1998 AND r.ratio = 'net_margin' AND abs(r.value) BETWEEN 0.0005 AND 1.5
  UNION ALL SELECT y.cik, 11, y.fy, y.value - q.q, n.name || ' revenue FY' || y.fy || ' Q4 (derived): ' || {_money('(y.value - q.q)')} || ' — Q4 = FY − Q1 − Q2 − Q3 (computed; Q4 is not reported)', [{_FACT.format('y')}] FROM years AS y JOIN quarters AS q ON q.cik = y.cik JOIN n ON n.cik = y.cik WHERE y.metric = 'revenue' AND y.fy = 1999
  UNION ALL SELECT o.cik, 13, arg_max(c.fy, (c.value, -c.cik)), max(c.value), 'revenue comparison: ' || string_agg(m.name || ' FY' || c.fy || ' ' || {_money('c.value')}, '; ' ORDER BY c.value DESC, c.cik), list({_FACT.format('c')} ORDER BY c.value DESC, c.cik)
    FROM n AS o JOIN n AS m ON (m.cik - o.cik + 25) % 25 < 3 JOIN newest AS c ON c.cik = m.cik AND c.metric = 'revenue' GROUP BY o.cik
  UNION ALL SELECT a.cik, 14, a.fy, a.value - l.value, n.name || ' working capital FY' || a.fy || ': ' || {_money('(a.value - l.value)')} || ' (= {registry.DERIVED['working_capital'][3]}; ' || {_PART('a')} || ', ' || {_PART('l')} || ')', [{_FACT.format('a')}, {_FACT.format('l')}]
    FROM newest AS a JOIN n ON n.cik = a.cik JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' WHERE a.metric = 'current_assets'
  UNION ALL SELECT a.cik, 15, a.fy, (a.value - i.value) / l.value, n.name || ' quick ratio FY' || a.fy || ': ' || format('{{:,.2f}}', (a.value - i.value) / l.value) || 'x (= {registry.DERIVED['quick_ratio'][3]}; ' || {_PART('a')} || ', ' || {_PART('i')} || ', ' || {_PART('l')} || ')', [{_FACT.format('a')}, {_FACT.format('i')}, {_FACT.format('l')}]
    FROM newest AS a JOIN n ON n.cik = a.cik JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' JOIN years AS i ON i.cik = a.cik AND i.fy = a.fy AND i.metric = 'inventory' WHERE a.metric = 'current_assets' AND l.value <> 0
  UNION ALL SELECT y.cik, 16, y.fy, y.value, n.name || ' net income FY' || y.fy || ': ' || {_money('y.value')}, [{_FACT.format('y')}] FROM years AS y JOIN n ON n.cik = y.cik WHERE y.metric = 'net_income' AND y.fy = 1997)
"""
_SQL_CARDS = _CARDS + "SELECT cik || '-' || i AS query_id, fy, round(value, 4) AS value, text FROM cards"
_SQL_ANSWER = _CARDS.rstrip() + f""",
own AS (SELECT *, list_position([{', '.join(map(str, _ANSWER))}], i) AS pos FROM cards WHERE i IN ({', '.join(map(str, _ANSWER[:6]))})),
fresh AS (SELECT o.* FROM own AS o LEFT JOIN newest AS a ON a.cik = o.cik AND a.metric = 'revenue' WHERE o.i = 2 OR a.fy IS NULL OR list_max(list_transform(o.sources, lambda s: CAST(substr(s, length(s) - 9, 4) AS INT))) >= a.fy)
SELECT CAST(a.cik AS VARCHAR) AS answer_id, a.fy, a.text, array_to_string(list_sort(a.sources), ';') AS sources FROM fresh AS a WHERE NOT EXISTS (SELECT 1 FROM fresh AS b WHERE b.cik = a.cik AND b.i <> a.i AND len(list_filter(a.sources, lambda s: NOT list_contains(b.sources, s))) = 0
  AND (len(list_filter(b.sources, lambda s: NOT list_contains(a.sources, s))) > 0 OR length(a.text) < length(b.text) OR (length(a.text) = length(b.text) AND a.pos < b.pos)))"""
_PRINTED = BASE.replace("form IN ('10-K', '10-K/A')", "accn = 'K-' || cik || '-1998'").replace("ORDER BY filed DESC, accn DESC", "ORDER BY val DESC, filed DESC")
_SQL_SCOPED = f"""WITH {_PRINTED},
{POINTS},
n AS (SELECT CAST(n_nationkey AS BIGINT) AS cik, n_name AS name FROM nation),
cards AS (
  SELECT c.cik, 0 AS i, c.fy, c.value, n.name || ' ' || {_LABEL('c')} || ' FY' || c.fy || ': ' || {_money('c.value')} AS text, [{_FACT.format('c')}] AS sources FROM newest AS c JOIN n ON n.cik = c.cik WHERE c.metric = 'revenue'
  UNION ALL SELECT c.cik, 1, c.fy, (c.value - p.value) / abs(p.value), {_GROWN}, {_TWO} FROM newest AS c JOIN n ON n.cik = c.cik JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE c.metric = 'revenue' AND p.value <> 0
  UNION ALL SELECT c.cik, 2, c.fy, c.value, n.name || ' net income FY' || c.fy || ': ' || {_money('c.value')}, [{_FACT.format('c')}] FROM newest AS c JOIN n ON n.cik = c.cik WHERE c.metric = 'net_income'
  UNION ALL SELECT a.cik, 3, a.fy, a.value - l.value, n.name || ' working capital FY' || a.fy || ': ' || {_money('(a.value - l.value)')} || ' (= {registry.DERIVED['working_capital'][3]}; ' || {_PART('a')} || ', ' || {_PART('l')} || ')', [{_FACT.format('a')}, {_FACT.format('l')}]
    FROM newest AS a JOIN n ON n.cik = a.cik JOIN years AS l ON l.cik = a.cik AND l.fy = a.fy AND l.metric = 'current_liabilities' WHERE a.metric = 'current_assets')
SELECT CAST(a.cik AS VARCHAR) AS answer_id, a.fy, round(a.value, 4) AS value, a.text FROM cards AS a WHERE NOT EXISTS (SELECT 1 FROM cards AS b WHERE b.cik = a.cik AND b.i <> a.i AND len(list_filter(a.sources, lambda s: NOT list_contains(b.sources, s))) = 0 AND len(list_filter(b.sources, lambda s: NOT list_contains(a.sources, s))) > 0)"""
_PATHS = f"""WITH q AS (SELECT o_orderkey, {list(_NAMES['op'])}[o_orderkey % {len(_NAMES['op'])} + 1] AS op, {list(_NAMES['metric'])}[o_custkey % {len(_NAMES['metric'])} + 1] AS metric FROM orders)
SELECT o_orderkey, op, metric, CASE WHEN metric = 'quick_ratio' THEN 'derived' WHEN metric = 'net_margin' THEN CASE WHEN op IN ('average', 'series') THEN 'ratio_' || op ELSE 'ratio' END WHEN op = 'ratio' OR metric = 'nonsense' THEN NULL
  WHEN op = 'q4' THEN CASE WHEN metric = 'revenue' THEN 'q4' END WHEN op IN ('yoy', 'cagr', 'average', 'series', 'compare') THEN op ELSE 'value' END AS path FROM q"""
_ROUTE_SQL = f"""SELECT conv_id, turn, route, CASE WHEN route IN ('numeric', 'hybrid') AND n = 0 THEN 'narrative' WHEN route = 'numeric' AND NOT fully THEN 'hybrid' WHEN route = 'out_of_scope' AND (refusal = '' OR regexp_matches(question, '{answers.FINANCIAL}')) THEN 'narrative' WHEN route = 'odd' THEN 'narrative' ELSE route END AS settled
FROM ({as_sql(_ROUTED)})"""
_REFUSED_SQL = _CARDS + "SELECT n.cik || '-' || i AS query_id, CASE i WHEN 17 THEN 'unknown metric: nonsense' WHEN 9 THEN 'ratio does not apply to revenue' WHEN 12 THEN 'q4 does not apply to current_assets' ELSE 'no figures' END AS error FROM n, range(18) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM cards AS c WHERE c.cik = n.cik AND c.i = r.i)"
#: ``panel``: the five figures of every company.
PANEL_CARDS = _CARDS.rstrip() + f""",
panel AS (
  SELECT c.cik, CASE c.metric WHEN 'revenue' THEN 0 WHEN 'net_income' THEN 1 WHEN 'research_and_development' THEN 3 ELSE 4 END AS i, c.fy, (c.value - p.value) / abs(p.value) AS value, {_GROWN} AS text
    FROM newest AS c JOIN n ON n.cik = c.cik JOIN years AS p ON p.cik = c.cik AND p.metric = c.metric AND p.fy = c.fy - 1 WHERE p.value <> 0 AND c.metric IN ('revenue', 'net_income', 'research_and_development', 'operating_cash_flow')
  UNION ALL SELECT r.cik, 2, r.fy, r.value, {_ONE} FROM rat AS r JOIN n ON n.cik = r.cik WHERE r.newest AND r.ratio = 'net_margin' AND abs(r.value) BETWEEN 0.0005 AND 1.5)"""

_BLOCK_TAGS = "p|div|tr|table|br|li|h1|h2|h3|h4|h5|h6"
_PAGE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g')"
_PAGE = rf"regexp_replace(regexp_replace(regexp_replace({_PAGE}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:{_BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[!/a-zA-Z][^>]*>', '', 'g')"
# the references that the pages hold, with their old forms; an ampersand last, so that what it begins is not decoded again
for _name, _code in (("&nbsp;", 160), ("&#160;", 160), ("&amp;", 1), ("&amp", 1), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&quot", 34), ("&#39;", 39), ("&copy;", 169), ("&middot;", 183)):
    _PAGE = f"replace({_PAGE}, '{_name}', chr({_code}))"
_PAGE = f"replace({_PAGE}, chr(1), '&')"
_PAGE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_PAGE}, chr(160), ' '), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

SQL = {
    "html_to_text": f"SELECT page_id, {_PAGE} AS text FROM pages",
    "numeric_cards": _SQL_CARDS,
    "answer_cards": _SQL_ANSWER,
    "scoped_cards": _SQL_SCOPED,
    "query_precedence": _PATHS,
    "query_refusals": _REFUSED_SQL,
    "route_contract": _ROUTE_SQL,
    "digest_panel": PANEL_CARDS + "\nSELECT cik, i AS place, fy, round(value, 6) AS value, text FROM panel",
    "events_daily_stream": f"SELECT CAST(ts AS DATE) AS day, event, count(*) AS n FROM ({as_sql(LOG)}) GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (numeric_cards, answer_cards, scoped_cards, query_precedence, query_refusals, route_contract, html_to_text, digest_panel, events_daily_stream)}
