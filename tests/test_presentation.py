"""Tiles, readable rows, names of visitors, payload salvage, stored results, further providers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import payloads, presentation
from ledgerlens.operators import evals
from ledgerlens.plans import answers


def test_tiles_and_rows(spark):
    df = spark.createDataFrame([("AAPL net income FY2024: $99.80B, +2.1% YoY (FY2023: $97B)", "Americas$178,353 7 %$167,045\n2025Change2024"), ("other text", "plain")], "card string, row string")
    a, b = df.select(presentation.tile(F.col("card")).alias("t"), presentation.readable_rows(F.col("row")).alias("r")).collect()
    assert tuple(a.t) == ("net income", 2024, "$99.80B", "+2.1%") and b.t is None
    assert a.r == "Americas   $178,353 7 %   |   $167,045\n2025  |  Change  |  2024" and b.r == "plain"


def test_visitors_and_sentences(spark):
    df = spark.createDataFrame([("1.2.3.4, 5.6.7.8", "Services revenue grew strongly", "Margins fell. Services revenue grew again! End."), ("", "Nothing alike here whatsoever", "Margins fell. End.")], "ip string, claim string, text string")
    a, b = df.select(presentation.visitor_id(F.col("ip"), "s").alias("v"), presentation.best_sentence(F.col("claim"), F.col("text")).alias("s")).collect()
    assert a.v == hashlib.sha256(b"s:1.2.3.4").hexdigest()[:16] and b.v is None
    assert a.s == "Services revenue grew again!" and b.s is None


CLAIM = {"text": "t", "cited_chunk_ids": ["c1"], "kind": "risk"}
NEAT = ("t", ["c1"], "risk")
#: Payloads of answers, and what is saved: summary and claims, or nothing.
SHAPES = [
    ({"summary": "s", "claims": [CLAIM]}, ("s", [NEAT])),
    ({"parameter": {"summary": "s", "claims": [CLAIM]}}, ("s", [NEAT])),
    ({"parameter name": [CLAIM]}, ("", [NEAT])),
    ({"input": json.dumps([CLAIM])}, ("", [NEAT])),
    ({"input": json.dumps({"summary": "s", "claims": [CLAIM]})}, ("s", [NEAT])),
    ({"summary": "s", "claims": json.dumps([CLAIM])}, ("s", [NEAT])),
    ({"summary": "s", "claims": json.dumps(CLAIM)}, ("s", [NEAT])),
    ({"claims": "flat text", "cited_chunk_ids": ["2"], "kind": "risk"}, ("", [("flat text", ["2"], "risk")])),
    ({"claims": "flat text", "cited_chunk_ids": None}, ("", [("flat text", [], "insight")])),
    ({"summary": None, "claims": CLAIM}, ("", [NEAT])),
    ({"claims": ["bare", json.dumps(CLAIM), '{"text": " "}', "{broken", "  ", 7, {"no": 1}]}, ("", [("bare", [], "insight"), NEAT, ('{"text": " "}', [], "insight"), ("{broken", [], "insight")])),
    ({"claims": [{"text": "a", "kind": "odd", "cited_chunk_ids": "7"}, {"text": " \n"}]}, ("", [("a", ["7"], "insight")])),
    ({"claims": [], "summary": 0}, ("", [])),
    ({"claims": [], "summary": 5}, None),
    ({"claims": [{"text": 5}]}, None),
    ({"claims": [CLAIM, {"text": "a", "cited_chunk_ids": [1]}]}, None),
    ({"claims": [{"text": "a", "cited_chunk_ids": {"x": 1}}]}, None),
    ({"claims": "no citations"}, None),
    ({"claims": 42}, None),
    ({"summary": "s"}, None),
    ({"weird": "not json {"}, None),
    ({"weird": 3}, None),
    ([CLAIM], None),
    ("text", None),
    (None, None),
]


def test_salvage_of_answers(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(SHAPES)] + [(100, None), (101, ""), (102, "{"), (103, '{"claims": [], "claims": []}')]
    df = spark.createDataFrame(rows, "i int, raw string").select("i", payloads.answer(F.col("raw")).alias("a"))
    got = {r.i: r.a and (r.a.summary, [(c.text, c.cited_chunk_ids, c.kind) for c in r.a.claims]) for r in df.collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(SHAPES)}, 100: None, 101: None, 102: None, 103: None}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_salvage_of_other_kinds(spark):
    def read(kind, *values):
        rows = [(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)]
        return [r.p for r in spark.createDataFrame(rows, "i int, raw string").select("i", kind(F.col("raw")).alias("p")).orderBy("i").collect()]

    got = read(payloads.verdicts, {"verdicts": [{"claim_id": "a", "verdict": "SUPPORTED", "reason": "ok"}, "junk", {"verdict": "X"}, {"claim_id": " "}, {"claim_id": "b"}]}, None, "[", {"verdicts": 1}, {"verdicts": [{"claim_id": "a"}, {"claim_id": 7}]}, {"verdicts": [{"claim_id": "a", "reason": None}]})
    assert [[tuple(v) for v in g] for g in got] == [[("a", "SUPPORTED", "ok"), ("b", "", "")], [], [], [], [], []]
    got = read(payloads.assessment, {"decision": "REWRITE", "new_query": None, "reason": "r"}, None, [1], {"decision": 5, "reason": ["x"]})
    assert [tuple(g) for g in got] == [("REWRITE", "", "r"), ("", "", ""), ("", "", ""), ("5", "", '["x"]')]
    got = read(payloads.questions, {"items": [{"chunk_id": "c1", "question": "Q?"}, {"chunk_id": "", "question": "Q?"}, {"chunk_id": "c2"}, "junk"]}, None, {"items": {}}, {"items": [{"chunk_id": 1, "question": "q"}]})
    assert [[tuple(v) for v in g] for g in got] == [[("c1", "Q?")], [], [], []]
    nothing = ("narrative", [], [], "", False)
    full = {"route": "numeric", "queries": [{"op": "cagr", "metric": "revenue", "years": 3}, {"op": "value"}, 5, {"metric": "m", "fy": "2024", "tickers": ["A"]}], "companies": [" aapl ", "", 5], "refusal": 1, "fully_answers": "yes"}
    got = read(payloads.route, full, None, {"route": "sql"}, {"route": "hybrid", "queries": [{"metric": "m", "fy": 2024.5}]}, {"route": "hybrid", "queries": [{"metric": "m", "fy": "x"}]}, {"route": "hybrid", "queries": [{"metric": 4}]}, {"route": "out_of_scope", "refusal": "no", "fully_answers": []}, [])
    told = [(g.route, [(q.op, q.metric, q.fy, q.years, q.tickers) for q in g.queries], g.companies, g.refusal, g.fully_answers) for g in got]
    assert told == [("numeric", [("cagr", "revenue", None, 3, []), ("value", "m", 2024, None, ["A"])], ["AAPL"], "", True), nothing, nothing, nothing, nothing, nothing, ("out_of_scope", [], [], "no", False), nothing]


def test_golden_and_stored_results(spark):
    c = spark.createDataFrame([("a", ["rev $1B"], ["k"], ["$1B"], "k"), ("b", ["rev $1B"], ["k"], ["$2B"], None), ("c", [], [], [], None)], "case_id string, texts array<string>, accns array<string>, expected_substrings array<string>, expected_accn string")
    assert {r.case_id: r.ok for r in evals.golden_check(c).collect()} == {"a": True, "b": False, "c": False}
    s = spark.createDataFrame([(0, 0.0, None), (None, 0.0, True), (0, 0.5, True), (0, 0.0, False)], "n_crashed int, unsupported_rate double, numeric_ok boolean")
    assert [r.passed for r in evals.rejudged(s).collect()] == [True, False, False, False]


def test_further_providers(spark):
    p = answers.RuleProvider()
    chunks = spark.createDataFrame([("T", "c1", "Net sales rose"), ("T", "c2", "the average of things")], "ticker string, chunk_id string, text string")
    assert [r.chunk_id for r in answers.questions_from(chunks, p).collect()] == ["c1"]
    g = spark.createDataFrame([("q", "5", "it is 5"), ("q", "5", "6"), ("q", "5", None)], "question string, expected string, got string")
    assert [r.grade for r in answers.graded(g, p).collect()] == ["correct", "incorrect", "abstain"]
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "alone")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.question for r in answers.condensed(t, p).collect()} == {1: "c (after: b)", 2: "alone"}
