"""The driver tables seen as filings: plain SELECTs, worded so that Spark and DuckDB both run them.

``facts``: orders by nation and fiscal year as reported facts (restatements, a
mis-scaled proxy, comparatives, quarters, instants, a gap and a zero).
``chunks``: documents as filing texts. ``claims``: sentences about those facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FACTS = """
WITH o AS (
  SELECT c_nationkey AS cik, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS prio, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
), f AS (
  SELECT cik, prio, amount, CAST(CASE WHEN cik % 2 = 1 AND m >= 7 THEN y + 1 ELSE y END AS INT) AS fy,
    CASE WHEN cik % 2 = 1 THEN (m + 5) % 12 + 1 ELSE m END AS fm
  FROM o
), q AS (
  SELECT cik, fy, CAST(floor((fm + 2) / 3) AS INT) AS q, prio, CAST(sum(amount) AS DECIMAL(28,2)) AS amount
  FROM f GROUP BY cik, fy, CAST(floor((fm + 2) / 3) AS INT), prio
), flows AS (
  SELECT * FROM (VALUES ('GrossProfit','1-URGENT'), ('OperatingIncomeLoss','2-HIGH'), ('ResearchAndDevelopmentExpense','3-MEDIUM'), ('NetIncomeLoss','4-NOT SPECIFIED'),
    ('PaymentsForRepurchaseOfCommonStock','5-LOW'), ('CostOfRevenue','2-HIGH'), ('CostOfRevenue','3-MEDIUM')) AS t(tag, prio)
), stocks AS (
  SELECT * FROM (VALUES ('AssetsCurrent','1-URGENT'), ('AssetsCurrent','2-HIGH'), ('LiabilitiesCurrent','3-MEDIUM'), ('InventoryNet','4-NOT SPECIFIED'), ('AccountsPayableCurrent','5-LOW'),
    ('Assets','1-URGENT'), ('Assets','2-HIGH'), ('Assets','3-MEDIUM'), ('Assets','4-NOT SPECIFIED'), ('Assets','5-LOW')) AS t(tag, prio)
), byq AS (
  SELECT cik, fy, q, CASE WHEN fy <= 1997 THEN 'SalesRevenueNet' WHEN fy <= 1999 OR cik % 5 = 0 THEN 'Revenues' ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END AS tag, sum(amount) AS amount
  FROM q GROUP BY cik, fy, q
  UNION ALL
  SELECT cik, fy, q, tag, sum(amount) AS amount FROM q JOIN flows ON q.prio = flows.prio GROUP BY cik, fy, q, tag
), annual AS (
  SELECT cik, fy, tag, CAST(CASE WHEN tag = 'PaymentsForRepurchaseOfCommonStock' AND cik % 6 = 1 AND fy = 1999 THEN 0 ELSE sum(amount) END AS DECIMAL(28,2)) AS val,
    CASE WHEN cik % 2 = 1 THEN make_date(fy - 1, 7, 1) ELSE make_date(fy, 1, 1) END AS start_date,
    CASE WHEN cik % 2 = 1 THEN make_date(fy, 6, 30) ELSE make_date(fy, 12, 31) END AS end_date
  FROM byq WHERE NOT (cik = 7 AND fy = 1998) GROUP BY cik, fy, tag
), quarters AS (
  SELECT cik, fy, q, tag, CAST(amount AS DECIMAL(28,2)) AS val,
    CASE WHEN cik % 2 = 0 THEN make_date(fy, least(3 * q - 2, 7), 1) WHEN q = 1 THEN make_date(fy - 1, 7, 1) WHEN q = 2 THEN make_date(fy - 1, 10, 1) ELSE make_date(fy, 1, 1) END AS start_date,
    CASE WHEN cik % 2 = 0 THEN make_date(fy, least(3 * q + 1, 10), 1) WHEN q = 1 THEN make_date(fy - 1, 10, 1) WHEN q = 2 THEN make_date(fy, 1, 1) ELSE make_date(fy, 4, 1) END - 1 AS end_date
  FROM byq WHERE q <= 3
), bal AS (
  SELECT cik, fy, q, tag, sum(sum(amount)) OVER (PARTITION BY cik, tag ORDER BY fy, q) AS val
  FROM q JOIN stocks ON q.prio = stocks.prio GROUP BY cik, fy, q, tag
), instants AS (
  SELECT cik, fy, q, tag, CAST(val AS DECIMAL(28,2)) AS val,
    CASE WHEN q = 4 THEN CASE WHEN cik % 2 = 1 THEN make_date(fy, 6, 30) ELSE make_date(fy, 12, 31) END - CAST(cik % 5 AS INT) * 2
      ELSE CASE WHEN cik % 2 = 1 THEN make_date(fy, 4, 1) ELSE make_date(fy, 10, 1) END - 1 END AS end_date
  FROM bal WHERE q >= 3
), rows AS (
  SELECT cik, tag, start_date, end_date, val, concat('K-', cik, '-', fy) AS accn, fy, 'FY' AS fp, '10-K' AS form, end_date + 45 AS filed, concat('CY', fy) AS frame FROM annual
  UNION ALL
  SELECT cik, tag, start_date, end_date, CAST(val + 1000 AS DECIMAL(28,2)), concat('A-', cik, '-', fy), fy, 'FY', '10-K/A', end_date + 100, NULL FROM annual WHERE cik % 3 = 0
  UNION ALL
  SELECT cik, tag, start_date, end_date, CAST(floor(val / 1000) AS DECIMAL(28,2)), concat('P-', cik, '-', fy), fy, 'FY', 'DEF 14A', end_date + 150, NULL FROM annual WHERE cik % 4 = 0
  UNION ALL
  SELECT cik, tag, start_date, end_date, val, concat('K-', cik, '-', fy + 1), fy + 1, 'FY', '10-K', end_date + 410, NULL FROM annual WHERE cik % 3 <> 0
  UNION ALL
  SELECT cik, tag, start_date, end_date, val, concat('Q-', cik, '-', fy, '-', q), fy, concat('Q', q), '10-Q', end_date + 40, concat('CY', fy, 'Q', q) FROM quarters
  UNION ALL
  SELECT cik, tag, NULL, end_date, val, concat(CASE WHEN q = 4 THEN 'K-' ELSE 'I-' END, cik, '-', fy), fy, CASE WHEN q = 4 THEN 'FY' ELSE 'Q3' END,
    CASE WHEN q = 4 OR cik % 2 = 0 THEN '10-K' ELSE '10-Q' END, end_date + 45, concat('CY', fy, 'Q', q, 'I') FROM instants
)
SELECT CAST(cik AS BIGINT) AS cik, 'us-gaap' AS taxonomy, tag, 'USD' AS unit, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date, val, accn, CAST(fy AS INT) AS fy, fp, form, CAST(filed AS DATE) AS filed, frame
FROM rows
"""

#: Documents as filing texts: blank lines between paragraphs, headings by doc_id, a noise run in some.
FILINGS = """
SELECT doc_id, source AS ticker, CASE WHEN doc_id % 10 = 0 THEN 'benchmark' ELSE 'live' END AS corpus,
  concat(
    CASE WHEN doc_id % 7 = 0 THEN concat('Item 1A. Risk Factors', chr(10), chr(10)) WHEN doc_id % 7 = 1 THEN concat('ITEM 7 - Discussion', chr(10), chr(10)) WHEN doc_id % 7 = 2 THEN concat('Legal Proceedings', chr(10), chr(10)) ELSE '' END,
    replace(text, chr(10), concat(chr(10), chr(10))),
    CASE WHEN doc_id % 11 = 0 THEN concat(chr(10), chr(10), repeat('x', 90)) ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), chr(10), 'Item 8.', chr(10), chr(10), 'The company has experienced losses of ', CAST(n_chars * 1000 AS VARCHAR(20)), ' and demand has declined since then.') ELSE '' END
  ) AS text
FROM {documents}
"""

#: One claim for each labelled document, with what a judge said.
JUDGED = """
SELECT concat('Q', l.doc_id % 40) AS query_id, concat('Q', l.doc_id % 40, '_claim', l.doc_id) AS claim_id, l.doc_id,
  CASE WHEN l.toxic = 1 THEN 'CONTRADICTED' WHEN l.quality = 1 THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_INFO' END AS verdict,
  CASE WHEN l.doc_id % 3 = 0 THEN 'risk' ELSE 'insight' END AS kind, d.n_chars AS n_chars
FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id
"""

#: Sentences with figures, some wrong, and the evidence they cite.
FIGURES = """
WITH t AS (
  SELECT c_nationkey AS cik, year(o_orderdate) AS y, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 1000) AS BIGINT) AS k
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)
), p AS (
  SELECT b.cik AS cik, b.y AS y, a.k AS x, b.k AS k, CAST(floor(abs(b.k - a.k) * 100 / a.k) AS BIGINT) + (b.cik % 3) * 4 AS z
  FROM t AS a JOIN t AS b ON a.cik = b.cik AND b.y = a.y + 1
)
SELECT CAST(cik AS BIGINT) AS cik, CAST(y AS BIGINT) AS y,
  concat('Company revenue moved from $', x, ' million to $', k, ' million', CASE WHEN k >= x THEN ', up ' ELSE ', down ' END, z, '% in fiscal ', y, CASE WHEN cik % 4 = 1 THEN ' with 777,123 units' ELSE '' END) AS claim,
  concat('Total net revenue ', k * 1000, ' thousand against ', x, ',000 before; margins moved for the company') AS evidence
FROM p
"""

#: The event stream as a usage log.
LOG = """
SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'query_received' WHEN event_type = 'click' THEN 'llm_call' ELSE 'visitor_query' END AS event,
  concat(CASE WHEN event_id % 17 = 0 THEN 'eval_' WHEN event_id % 19 = 0 THEN 'fb_' WHEN event_id % 23 = 0 THEN 'smoke_' ELSE 'q' END, event_id) AS query_id,
  CASE WHEN user_id % 3 = 0 THEN 'route' WHEN user_id % 3 = 1 THEN 'generate' ELSE 'verify' END AS stage,
  CASE user_id % 9 WHEN 0 THEN 'openai:gpt-5-mini-2025' WHEN 1 THEN 'gpt-5' WHEN 2 THEN 'gpt-4o-mini' WHEN 3 THEN 'other' WHEN 4 THEN 'claude-haiku-4' WHEN 5 THEN 'anthropic:Claude-Opus-4' WHEN 6 THEN 'claude-sonnet' WHEN 7 THEN 'gpt-4o' END AS model,
  CAST(floor(value) AS BIGINT) * 100 AS input_tokens, user_id * 10 AS output_tokens, user_id AS visitor
FROM {events}
"""


TABLES = ("orders", "customer", "documents", "labels", "events", "conversations")


def _json(text: str) -> str:
    """A text as a JSON string."""
    back = "chr(92)"
    for plain, then in ((back, back), ("chr(34)", "chr(34)"), ("chr(10)", "'n'"), ("chr(13)", "'r'"), ("chr(9)", "'t'")):
        text = f"replace({text}, {plain}, concat({back}, {then}))"
    return f"concat(chr(34), {text}, chr(34))"


def _q(text: str) -> str:
    """As SQL text."""
    return f"'{text}'"


def _object(*parts: str) -> str:
    """A JSON object of literal and other parts. Braces are spelled out, since they mark tables here."""
    return "concat(chr(123), " + ", ".join(parts) + ", chr(125))"


_CLAIM = _object(_q('"text": '), "js", _q(', "cited_chunk_ids": ["c1", "c2"], "kind": "risk"'))
_WHOLE = _object(_q('"summary": "s", "claims": ['), "claim", "']'")
#: Turns of conversations as what a model may send for an answer, in sixteen shapes: ten that can be read, five that cannot, one with parts that go.
ANSWERS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, {_json("coalesce(text, '')")} AS js, CAST((conv_id * 7 + turn) % 16 AS INT) AS shape FROM {{conversations}}
), k AS (
  SELECT *, {_CLAIM} AS claim FROM c
), e AS (
  SELECT *, {_WHOLE} AS whole, {_json("concat('[', claim, ']')")} AS listed, {_json("claim")} AS quoted FROM k
)
SELECT conv_id, turn, text, shape, CASE shape
  WHEN 0 THEN whole
  WHEN 1 THEN {_object(_q('"parameter": '), "whole")}
  WHEN 2 THEN {_object(_q('"parameter name": ['), "claim", "']'")}
  WHEN 3 THEN {_object(_q('"input": '), "listed")}
  WHEN 4 THEN {_object(_q('"input": '), _json("whole"))}
  WHEN 5 THEN {_object(_q('"summary": "s", "claims": '), "listed")}
  WHEN 6 THEN {_object(_q('"claims": '), "js", _q(', "cited_chunk_ids": ["c1"], "kind": "risk"'))}
  WHEN 7 THEN {_object(_q('"summary": "s", "claims": '), "claim")}
  WHEN 8 THEN {_object(_q('"summary": null, "claims": ['), "js", _q(', "  "]'))}
  WHEN 9 THEN {_object(_q('"claims": ['), "quoted", "']'")}
  WHEN 10 THEN {_object(_q('"claims": ['), _object(_q('"text": '), "js", _q(', "cited_chunk_ids": "c9", "kind": "prophecy"')), "','", _object(_q('"text": "  "')), "']'")}
  WHEN 11 THEN {_object(_q('"summary": '), "js")}
  WHEN 12 THEN {_object(_q('"claims": 42'))}
  WHEN 13 THEN {_object(_q('"weird": "not json "'))}
  WHEN 14 THEN concat('no payload: ', text)
  ELSE {_object(_q('"claims": ['), _object(_q('"text": 5')), "']'")} END AS raw
FROM e
"""

#: And as a judge's, a router's, a reader's and an examiner's, in four shapes each.
KINDS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, {_json("coalesce(text, '')")} AS js, CAST(turn % 4 AS INT) AS shape FROM {{conversations}}
)
SELECT conv_id, turn, text, shape,
  CASE shape WHEN 0 THEN {_object(_q('"verdicts": ['), _object(_q('"claim_id": "a'), "conv_id", _q('", "verdict": "SUPPORTED", "reason": '), "js"), _q(', "junk", '), _object(_q('"verdict": "X"')), "','", _object(_q('"claim_id": " "')), "']'")}
    WHEN 1 THEN {_object(_q('"verdicts": 5'))} WHEN 2 THEN 'oops' ELSE {_object(_q('"verdicts": ['), _object(_q('"claim_id": 7')), "']'")} END AS verdicts,
  CASE shape WHEN 0 THEN {_object(_q('"decision": "REWRITE", "new_query": '), "js", _q(', "reason": null'))} WHEN 1 THEN {_object(_q('"decision": "EXPAND"'))} WHEN 2 THEN '[1]' ELSE {_object(_q('"decision": 5'))} END AS assessment,
  CASE shape WHEN 0 THEN {_object(_q('"route": "numeric", "queries": ['), _object(_q('"op": "cagr", "metric": "revenue", "years": 3')), "','", _object(_q('"op": "value"')), _q('], "companies": [" aapl ", "", 5], "fully_answers": true'))}
    WHEN 1 THEN {_object(_q('"route": "sql", "queries": "x"'))} WHEN 2 THEN {_object(_q('"route": "hybrid", "queries": ['), _object(_q('"metric": "m", "fy": "2024", "tickers": ["A", "B"]')), _q('], "refusal": 9, "fully_answers": 0'))}
    ELSE {_object(_q('"route": "hybrid", "queries": ['), _object(_q('"metric": "m", "fy": 2024.5')), "']'")} END AS route,
  CASE shape WHEN 0 THEN {_object(_q('"items": ['), _object(_q('"chunk_id": "k'), "conv_id", _q('", "question": '), "js"), "','", _object(_q('"chunk_id": "", "question": "Q"')), "','", _object(_q('"chunk_id": "x"')), _q(', "junk"]'))}
    WHEN 1 THEN {_object(_q('"items": null'))} WHEN 2 THEN 'text' ELSE {_object(_q('"items": ['), _object(_q('"chunk_id": 1, "question": "q"')), "']'")} END AS items
FROM c
"""


def project(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    names = [n for n in TABLES if "{" + n + "}" in select]
    return spark.sql(select, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def as_sql(select: str) -> str:
    for n in TABLES:
        select = select.replace("{" + n + "}", n)
    return select.strip()
