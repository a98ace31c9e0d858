"""Operators on small literal tables, with expected values."""

import datetime as dt
import json
import re
import tracemalloc
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import figures, render
from ledgerlens.operators import chunking, claims, evals, facts as fx, matching, numeric, retrieval
from ledgerlens.plans import answers, planner, schema
from ledgerlens.sources import filings, sinks, staging
from ledgerlens.streaming import events

FACTS = "cik long, taxonomy string, tag string, unit string, start_date date, end_date date, val decimal(28,2), accn string, fy int, fp string, form string, filed date, frame string"
NEW, OLD = "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"


def d(text):
    return dt.date.fromisoformat(text) if text else None


def fact(tag, start, end, val, accn, form="10-K", filed=None, cik=1):
    return (cik, "us-gaap", tag, "USD", d(start), d(end), val, accn, None, "FY", form, d(filed or end), None)


@pytest.fixture(scope="module")
def store(spark):
    from decimal import Decimal as D

    b = lambda x: D(str(x)) * D(10) ** 9
    rows = [
        fact(NEW, "2024-09-29", "2025-09-27", b(416.2), "a25"),
        fact(NEW, "2023-10-01", "2024-09-28", b(391.0), "a24"),
        fact(NEW, "2024-09-29", "2024-12-28", b(124.3), "q1", "10-Q"),
        fact(NEW, "2024-12-29", "2025-03-29", b(95.4), "q2", "10-Q"),
        fact(NEW, "2025-03-30", "2025-06-28", b(94.0), "q3", "10-Q"),
        fact(OLD, "2017-10-01", "2018-09-29", b(265.6), "a18"),
        fact("GrossProfit", "2024-09-29", "2025-09-27", b(195.2), "a25"),
        fact("Assets", None, "2025-09-27", b(344.1), "a25"),
        fact("Assets", None, "2025-06-28", b(331.5), "a25"),
        fact("AssetsCurrent", None, "2025-09-27", b(152.0), "a25"),
        fact("LiabilitiesCurrent", None, "2025-09-27", b(100.0), "a25"),
        fact("InventoryNet", None, "2025-09-27", b(7.0), "a25"),
        # a proxy, filed later and mis-scaled, has no vote; a later amendment has
        fact("NetIncomeLoss", "2024-09-29", "2025-09-27", D(8852000), "p", "DEF 14A", "2026-01-01"),
        fact("NetIncomeLoss", "2024-09-29", "2025-09-27", D(8852000000), "a25"),
        fact("NetIncomeLoss", "2024-09-29", "2025-09-27", D(8852000001), "b25", "10-K/A", "2025-12-01"),
    ]
    f = spark.createDataFrame(rows, FACTS)
    return f, fx.points(f)


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    got = df.collect()
    assert len(got) == 1, got
    return got[0]


def test_points(store):
    _, p = store
    assert one(p.newest, metric="revenue").value == 416.2e9
    assert one(p.years, metric="revenue", fy=2024).value == 391.0e9
    old = one(p.years, metric="revenue", fy=2018)
    assert (old.value, old.accn) == (265.6e9, "a18")
    assert one(p.years, metric="total_assets", fy=2025).value == 344.1e9
    assert one(p.newest, metric="net_income").value == 8852000001.0


def test_growth_ratio_quarter(store):
    f, p = store
    assert one(numeric.yoy(p), metric="revenue").growth == pytest.approx((416.2 - 391.0) / 391.0)
    assert one(numeric.ratios(p).where("newest"), ratio="gross_margin").value == pytest.approx(195.2 / 416.2)
    assert one(numeric.fourth_quarter(f, p), metric="revenue", fy=2025).q4 == pytest.approx(416.2e9 - (124.3 + 95.4 + 94.0) * 1e9)
    assert [r.fy for r in numeric.series(p, 8).where("metric = 'revenue'").orderBy("fy").collect()] == [2018, 2024, 2025]
    assert one(numeric.derived(p, "working_capital")).value == 52.0e9
    assert one(numeric.derived(p, "quick_ratio")).value == pytest.approx(1.45)


def test_tag_migration(spark):
    f = spark.createDataFrame(
        [
            fact(NEW, "2021-02-01", "2022-01-30", 26.9, "n22"),
            fact("Revenues", "2021-02-01", "2022-01-30", 27.0, "r22"),
            fact("Revenues", "2025-02-01", "2026-01-25", 215.9, "r26"),
        ],
        FACTS.replace("decimal(28,2)", "double"),
    )
    p = fx.points(f)
    assert one(p.newest).value == 215.9
    assert one(p.years, fy=2022).value == 26.9


def test_cards(spark, store):
    f, p = store
    q = spark.createDataFrame(
        [("a", 1, "AAPL", "value", "revenue", None, None), ("b", 1, "AAPL", "yoy", "revenue", None, None), ("c", 1, "AAPL", "yoy", "gross_margin", None, None), ("d", 1, "AAPL", "ratio", "revenue", None, None)],
        "query_id string, cik long, ticker string, op string, metric string, fy int, years int",
    )
    got = {r.query_id: r.text for r in planner.execute(q, p, f).collect()}
    assert got["a"] == "AAPL revenue FY2025: $416.20B"
    assert "+6.4% YoY" in got["b"] and "46.9%" in got["c"] and "d" not in got


def test_series_shape(spark):
    def shape(values):
        got = spark.createDataFrame([(1, "m", fy, v) for fy, v in values], "cik long, metric string, fy int, value double")
        return numeric.series_steps(got).orderBy("fy").collect(), one(numeric.series_shape(got))

    steps, s = shape([(2023, 18.84), (2024, 19.61), (2025, 23.92)])
    assert [round(x.growth, 3) if x.growth else None for x in steps] == [None, 0.041, 0.22]
    assert round(s.window_cagr, 3) == 0.127 and s.pace == "accelerated"
    steps, s = shape([(2022, 2.842), (2023, 0.0), (2024, 7.346)])
    assert [x.step for x in steps] == [None, "halted", "resumed"] and s.window_cagr is None
    _, s = shape([(2018, 1.0), (2021, 2.0)])
    assert s.missing == [2019, 2020]


@pytest.mark.parametrize(
    "claim, evidence, want",
    [
        ("Revenue was $416.2 billion", "net sales 416,161", 1.0),
        ("Revenue was $999.9 billion", "net sales 416,161", 0.0),
        ("Sales 416,161 and 123,456", "416,161", 0.5),
        ("No figures in fiscal 2025", "416,161", None),
    ],
)
def test_number_match(spark, claim, evidence, want):
    got = spark.createDataFrame([(claim, evidence)], "c string, e string").select(figures.number_match(figures.values(F.col("c")), figures.values(F.col("e")))).first()[0]
    assert got == want


@pytest.mark.parametrize("claim, want", [("grew from $4.9 billion to $5.9 billion, up 17%", False), ("grew from $5.067 billion to $5.942 billion, up 17.3%", True), ("grew nicely", None)])
def test_arithmetic(spark, claim, want):
    assert spark.createDataFrame([(claim,)], "c string").select(figures.arithmetic_ok(F.col("c"))).first()[0] is want


def test_amounts(spark):
    rows = [(1.5775e9, "USD", "$1.58B"), (2.5e6, "USD", "$2.5M"), (950.0, "USD", "$950"), (1.234, "USD/shares", "$1.23"), (1.5, "x", "1.50x"), (12.34, "days", "12.3 days"), (2e9, "shares", "2.00B shares")]
    df = spark.createDataFrame(rows, "v double, u string, want string").withColumn("got", render.amount(F.col("v"), F.col("u")))
    assert all(r.got == r.want for r in df.collect())


def test_chunking(spark):
    long = "word " * 60
    text = "\n\n".join(["Item 1A. Risk Factors", long, long, "x" * 90, "ITEM 7 — Discussion.", long * 10, "tiny"])
    df = spark.createDataFrame([(1, "T", "live", text)], "doc_id long, ticker string, corpus string, text string")
    got = chunking.chunk(df).orderBy("ordinal").collect()
    assert got[0].section == "Item 1A. Risk Factors" and got[0].chunk_id == "1_0000"
    assert {r.section for r in got} == {"Item 1A. Risk Factors", "Item 7. Discussion"}
    assert all("xxxx" not in r.text and len(r.text) >= 200 for r in got)
    bare = spark.createDataFrame([(2, "T", "live", "Risk Factors\n\n" + long)], df.schema)
    assert chunking.chunk(bare).first().section == "Item 1A. Risk Factors"


def test_mmr_skips_near_copies(spark):
    rows = [(0, 0, 1, 0.0, [1.0, 0.0]), (0, 1, 2, 0.001, [0.999, 0.04]), (0, 2, 3, 0.4, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, place int, distance double, embedding array<double>")
    assert [r.vec_id for r in retrieval.mmr(df, 2, 0.5).orderBy("pick").collect()] == [0, 2]
    assert retrieval.coverage_k(6) == 12 and retrieval.coverage_k(20) == 24


def test_report_and_rate(spark):
    c = spark.createDataFrame([("q", "a", "SUPPORTED", "risk"), ("q", "b", "NOT_ENOUGH_INFO", "risk"), ("q", "c", "CONTRADICTED", "insight")], "query_id string, claim_id string, verdict string, kind string")
    r = one(claims.report(c))
    assert (r.displayed, r.unverified, r.blocked, r.risk_flags) == (2, 1, 1, 1) and r.unsupported_rate == pytest.approx(2 / 3)


def test_subsume(spark):
    rows = [("q", 1, "short", ["a"]), ("q", 2, "longer", ["a", "b"]), ("q", 3, "same", ["c"]), ("q", 4, "same", ["c"])]
    df = spark.createDataFrame(rows, "query_id string, card_id int, text string, sources array<string>")
    assert sorted(r.card_id for r in claims.subsume(df).collect()) == [2, 4]


def test_evals(spark):
    g = spark.createDataFrame([("a", "correct"), ("a", "incorrect"), ("b", "abstain"), ("b", "abstain")], "question_type string, grade string")
    total = one(evals.benchmark_summary(g).where("question_type is null"))
    assert (total.accuracy, total.answered_accuracy, total.hallucination_rate) == (0.25, 0.5, 0.25)
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1), "llm_call", "s", "unknown", 20000, 2000)], "ts timestamp, event string, stage string, model string, input_tokens long, output_tokens long")
    assert one(evals.llm_cost(log)).est_cost_usd == 0.09


def test_company_facts(spark, tmp_path):
    point = {"end": "2024-12-31", "start": "2024-01-01", "val": 5, "accn": "x", "filed": "2025-02-01", "form": "10-K", "fy": 2024, "fp": "FY"}
    bad = {k: v for k, v in point.items() if k != "val"}
    body = {"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Revenues": {"label": "l", "units": {"USD": [point, {**point, "val": 6, "filed": "2026-02-01"}, bad]}}, "Other": {"label": "o", "units": {"USD": [point]}}, "Assets": {"label": "a", "units": {"USD": [{k: v for k, v in point.items() if k != "start"} | {"frame": "CY2024Q4I"}]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(body))
    got = filings.company_facts(spark, str(tmp_path / "f.json")).collect()
    assert len(got) == 3 and {r.tag for r in got} == {"Revenues", "Assets"}
    assert [r.start_date for r in got if r.tag == "Assets"] == [None]
    assert filings.company_facts(spark, str(tmp_path / "f.json"), False).count() == 4


def test_submissions(spark, tmp_path):
    block = {"form": ["10-K/A", "10-K", "10-K"], "accessionNumber": ["a", "b", "c"], "primaryDocument": ["a.htm", "", "c.htm"], "filingDate": ["2025-02-01", "2025-01-01", "2024-01-01"], "reportDate": ["2024-12-31", "2024-12-31", "2024-01-31"]}
    old = {k: ["10-K", "x", "x.htm", "2016-03-01", "2015-12-31"][i : i + 1] for i, k in enumerate(block)}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1", "filings": {"recent": block, "older": [old]}}))
    rows = filings.submissions(spark, str(tmp_path / "s.json"))
    assert one(filings.latest_filing(rows)).accn == "b"
    wanted = spark.createDataFrame([("1", 2024), ("1", 2015), ("1", 2023)], "cik string, fy int")
    assert {r.fy: r.accn for r in filings.filing_for_year(rows, wanted).collect()} == {2024: "b", 2015: "x", 2023: "c"}
    assert {r.accn for r in filings.filing_docs(rows, True).collect()} == {"a", "c", "x"}


def test_statement_pages(spark):
    xml = "<FilingSummary><MyReports>" + "".join(f"<Report><ShortName>{n}</ShortName><HtmlFileName>{h}</HtmlFileName></Report>" for n, h in [("Cover", "R1.htm"), ("CONSOLIDATED STATEMENTS OF COMPREHENSIVE INCOME", "R2.htm"), ("Statements of Operations", "R3.htm"), ("Balance Sheets (Parenthetical)", "R4.htm"), ("BALANCE SHEETS", "R5.htm"), ("Cash Flows", "R8.htm")]) + "</MyReports></FilingSummary>"
    df = spark.createDataFrame([(1, "a", xml), (2, "b", "<broken")], "cik long, accn string, xml string")
    assert {r.stmt: r.html_file for r in filings.statement_pages(df).collect()} == {"income": "R3.htm", "balance": "R5.htm", "cashflow": "R8.htm"}


def test_registry_texts_and_page(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple Inc."}}))
    listing = filings.ticker_registry(spark, str(tmp_path / "t.json"))
    wanted = spark.createDataFrame([("aapl",), ("ZZZ",), ("!!",)], "ticker string")
    got = {r.ticker: (r.cik, r.error) for r in filings.resolve_tickers(wanted, listing).collect()}
    assert got == {"AAPL": ("0000320193", None), "ZZZ": (None, "unknown"), "!!": (None, "malformed")}
    (tmp_path / "aapl_10K.txt").write_text("x" * 20000)
    (tmp_path / "b.txt").write_text("short")
    meta = spark.createDataFrame([("AAPL", "2024-11-01")], "ticker string, filing_date string")
    assert one(filings.filing_texts(spark, str(tmp_path / "*.txt"), meta)).doc_id == "AAPL_10K_2024"
    page = spark.createDataFrame([("<p>A&nbsp;b</p><script>x</script><div>c &amp; d</div>",)], "h string")
    assert page.select(filings.page_text(F.col("h"))).first()[0] == "A b\n\nc & d"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "facts")
    sinks.replace_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "cik int, v string"), path, "cik")
    sinks.replace_by_key(spark.createDataFrame([(2, "c"), (2, "d")], "cik int, v string"), path, "cik")
    assert sorted((r.cik, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d")]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "z"), (3, "y")]))
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "z"), (3, "y")]
    assert [tuple(r) for r in sinks.absent(old, new, ["k"]).collect()] == [(3, "y")]
    sinks.append_events(spark.createDataFrame([("e",)], "event string"), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{oops\n\n")
    assert [r.event for r in filings.json_lines(spark, str(tmp_path / "log"), "ts string, event string").where("event is not null").collect()] == ["e"]


def test_stream_stages_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [{"ts": "2024-01-01T00:00:00", "event": "e", "query_id": "q", "stage": s} for s in ("route", "route", "verify")]
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    run = events.to_table(events.stages_once(events.tail(spark, str(tmp_path / "log"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    assert sorted(r.stage for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["route", "verify"]


def test_answer_flow(spark):
    class Stubborn(answers.RuleProvider):
        def assess(self, question, previews):
            return {"decision": "EXPAND"}

        def verify(self, claims_):
            return [{"claim_id": c["claim_id"], "verdict": "CONTRADICTED", "reason": ""} for c in claims_]

    q = spark.createDataFrame([("1", "T", "What are the main risks?"), ("2", "T", "What is the average revenue?")], "query_id string, ticker string, question string")
    r = {x.query_id: x.route for x in answers.routed(q, answers.RuleProvider()).collect()}
    assert r == {"1": "narrative", "2": "numeric"}
    store = spark.createDataFrame([(f"c{i}", f"Chunk {i} states a risk. More") for i in range(30)], "chunk_id string, text string").withColumn("place", F.regexp_extract("chunk_id", r"\d+", 0).cast("int"))
    retrieve = lambda asked: asked.crossJoin(store).where("place < k").select("query_id", "chunk_id", "place", "text")
    asked = q.where("query_id = '1'")
    got = answers.narrative(asked, retrieve, answers.RuleProvider()).collect()
    assert len(got) == 3 and {x.verdict for x in got} == {"SUPPORTED"} and got[0].kind == "risk"
    rounds = answers.refined(asked.withColumn("k", F.lit(6)), retrieve, Stubborn()).groupBy("round").count().orderBy("round").collect()
    assert [x["count"] for x in rounds] == [6, 12, 24]
    assert {x.verdict for x in answers.narrative(asked, retrieve, Stubborn()).collect()} == {"CONTRADICTED"}


def test_names_and_probes(spark):
    titles = spark.createDataFrame([("3M Co", "1"), ("Best Buy Co Inc", "2"), ("Best Buyers", "3"), ("Twin A", "4"), ("Twin B", "5")], "title string, cik string")
    asked = spark.createDataFrame([("3M", None, None), ("Best Buy", None, None), ("Twin", None, None), ("Gone", "x/CIK-0000000009", None)], "name string, link string, manual string")
    assert {r.name: r.cik for r in matching.resolve_names(asked, titles).collect()} == {"3M": "1", "Best Buy": "2", "Twin": None, "Gone": "0000000009"}
    ev = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "red fox"), (3, "absent words")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "zero, one two three four five six seven eight nine"), (11, "a red fox here")], "doc_id long, text string")
    assert sorted(map(tuple, matching.containment(ev, docs).collect())) == [(1, 10), (2, 11)]


def test_containment_is_plain_text(spark):
    """A run's outer words may be parts of longer ones, those between are whole; also short runs."""
    ev = spark.createDataFrame([(1, "is a"), (2, "s a b"), (3, "one two three four five six seven eight"), (4, "two"), (5, "a b c d"), (6, "is not this a"), (7, None), (8, "")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "is not this a"), (11, "this a b"), (12, "xone two three four five six seven eightfold"), (13, "one twox three four five six seven eight"), (14, None), (15, "aa b c dd")], "doc_id long, text string")

    def plain(t):
        return " ".join(re.findall(matching.WORD, t or ""))

    want = sorted((i, d) for i, t in [tuple(r) for r in ev.collect()] for d, x in [tuple(r) for r in docs.collect()] if plain(t) and plain(t) in plain(x))
    assert sorted(map(tuple, matching.containment(ev, docs).collect())) == want and (1, 10) in want and (3, 12) in want and (3, 13) not in want
    assert matching.containment(ev.limit(0), docs).count() == 0


def test_embedded_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    seen = lambda texts: [[float(t.startswith("query: ")), float(len(t)) - 7] for t in texts]
    got = {r.id: r.embedding for r in retrieval.embedded(df, seen, "multilingual-e5-small", query=True).collect()}
    assert np.allclose(got[1], np.array([1, 2]) / 5**0.5) and np.allclose(got[2], [1, 0])


def test_topk_in_blocks(spark):
    """Every query against every row of its scope, by brute force; zero, null and shorter vectors are met by none; ties by id."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[7] = x[3]
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 0, [0.0] * 8), (902, 1, [1.0]), (903, 1, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, scope int, embedding array<double>")
    q = v.where("vec_id % 5 = 0 and vec_id < 400").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("scope"), F.col("embedding").alias("query"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (20_000, 9):
        got = {}
        for r in retrieval.topk(v, q, 4, block).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for i in range(0, 400, 5):
            assert got[i] == sorted(range(0, 400, 3), key=lambda j: (round(1 - float(u[i] @ u[j]), 12), j))[:4]


def test_prices_and_missing_models(spark):
    models = ["claude-haiku-4", "anthropic:Claude-Opus-4", "claude-sonnet", "gpt-5-mini-x", "gpt-5", "gpt-4o-mini", "gpt-4o", "other", None]
    got = {r.model: (r.price_in, r.price_out) for r in evals.priced(spark.createDataFrame([(m,) for m in models], "model string")).collect()}
    assert got == {"claude-haiku-4": (1, 5), "anthropic:Claude-Opus-4": (15, 75), "claude-sonnet": (3, 15), "gpt-5-mini-x": (0.25, 2), "gpt-5": (1.25, 10), "gpt-4o-mini": (0.15, 0.6), "gpt-4o": (2.5, 10), "other": (3, 15), None: (3, 15)}


def test_ingested_again_once_the_source_has_changed(spark, tmp_path):
    source, made = tmp_path / "src", []
    source.mkdir()

    def make():
        made.append(1)
        return spark.range(len(made))

    (source / "a").write_text("x")
    assert staging.ingested(spark, str(source), "t", make).count() == staging.ingested(spark, str(source), "t", make).count() == 1
    (source / "b").write_text("more")
    assert staging.ingested(spark, str(source), "t", make).count() == 2
    assert staging.ingested(spark, str(source), "t", make, expiry=-1).count() == 3


def test_answers_are_capped_fresh_and_not_contained(spark):
    """Seven queries, of which six count; a stale one goes unless it names its year; a value goes with its growth. Earnings a share keep their unit in the fourth quarter."""
    eps, day = "EarningsPerShareDiluted", dt.date
    rows = []
    for fy in (2023, 2024):
        rows += [(1, "us-gaap", "Revenues", "USD", day(fy, 1, 1), day(fy, 12, 31), 100.0 * fy, f"K{fy}", fy, "FY", "10-K", day(fy + 1, 2, 1), None)]
        rows += [(1, "us-gaap", "NetIncomeLoss", "USD", day(fy, 1, 1), day(fy, 12, 31), 10.0 * fy, f"K{fy}", fy, "FY", "10-K", day(fy + 1, 2, 1), None)]
        rows += [(1, "us-gaap", eps, "USD/shares", day(fy, 1, 1), day(fy, 12, 31), 4.5, f"K{fy}", fy, "FY", "10-K", day(fy + 1, 2, 1), None)]
        rows += [(1, "us-gaap", eps, "USD/shares", day(fy, m, 1), day(fy, m + 2, 28), 1.0, f"Q{fy}{m}", fy, "Q", "10-Q", day(fy, m + 3, 20), None) for m in (1, 4, 7)]
    rows += [(1, "us-gaap", "LongTermDebt", "USD", None, day(2021, 12, 31), 7e9, "K2021", 2021, "FY", "10-K", day(2022, 2, 1), None)]
    facts = spark.createDataFrame([(*r[:6], Decimal(str(r[6])), *r[7:]) for r in rows], FACTS)
    p = fx.points(facts)
    ask = [("value", "revenue", None), ("yoy", "revenue", None), ("value", "long_term_debt", None), ("value", "long_term_debt", 2021), ("q4", "eps_diluted", None), ("value", "net_income", None), ("yoy", "net_income", None)]
    q = spark.createDataFrame([("A", i, 1, "ACME", o, m, fy, None) for i, (o, m, fy) in enumerate(ask)], "answer_id string, pos int, cik long, ticker string, op string, metric string, fy int, years int")
    got = [r.text for r in planner.answered(q, p, facts).orderBy("query_id").collect()]
    assert len(got) == 4
    assert "YoY" in got[0] and got[1].startswith("ACME long term debt FY2021: $7.00B")
    assert got[2].startswith("ACME eps diluted FY2024 Q4 (derived): $1.50 — ")
    assert got[3].startswith("ACME net income FY2024: ")
    held = q.where("pos in (0, 5)").withColumns({"scope_cik": F.lit(1).cast("long"), "scope_accn": F.lit("K2023")})
    assert sorted(r.fy for r in planner.answered(held, p, facts).collect()) == [2023, 2023]


def test_series_text_has_its_extras(spark):
    def line(values):
        df = spark.createDataFrame([([{"fy": fy, "value": v, "unit": "USD"} for fy, v in values],)], "pts array<struct<fy:int,value:double,unit:string>>")
        return df.select(planner.series_text(F.col("pts"), F.lit("revenue"), F.lit("A"))).first()[0]

    assert line([(2020, 1e9)]) == "A revenue: FY2020 $1.00B"
    assert line([(2020, 1e9), (2022, 2e9), (2023, 1e9)]) == "A revenue: FY2020 $1.00B; FY2022 $2.00B (+100.0%); FY2023 $1.00B (-50.0%) — FY2021 not in the official data; 2-yr CAGR +0.0%; growth slowed in FY2023; declined in FY2023"
    assert line([(2020, 5e6), (2021, 0.0), (2022, 5e6)]) == "A revenue: FY2020 $5.0M; FY2021 $0 (halted); FY2022 $5.0M (resumed)"
    assert "growth accelerated in FY2022" in line([(2020, 1e9), (2021, 1e9), (2022, 2e9)])


def test_models_are_asked_once_and_told_what_was_wrong(spark, tmp_path):
    """A contradicted question is answered again with feedback; earlier rounds fill up the last; nothing is asked twice."""
    log = tmp_path / "calls"

    class Counting(answers.RuleProvider):
        def generate(self, question, chunks, feedback="", figures=""):
            with log.open("a") as f:
                f.write(f"{question}|{feedback}\n")
            return [{"text": "revised" if feedback else "wrong", "cited": [chunks[0][0]], "kind": "odd"}]

        def verify(self, claims_):
            return [{"claim_id": c["claim_id"], "verdict": "CONTRADICTED" if c["text"] == "wrong" else "SUPPORTED", "reason": "no such thing"} for c in claims_]

    q = spark.createDataFrame([("1", "T", "What are the main risks?")], "query_id string, ticker string, question string")
    store = spark.createDataFrame([(f"c{i}", i, f"text {i}") for i in range(30)], "chunk_id string, place int, text string")
    retrieve = lambda asked: asked.crossJoin(store).where("place < k").select("query_id", "chunk_id", "place", "text")
    got = answers.narrative(q, retrieve, Counting()).collect()
    assert [(r.claim_id, r.text, r.kind, r.verdict) for r in got] == [("1r_claim1", "revised", "insight", "SUPPORTED")]
    assert log.read_text().splitlines() == ["What are the main risks?|", "What are the main risks?|- wrong (no such thing)"]
    rounds = spark.createDataFrame([("q", 1, 4, i, f"a{i}") for i in range(4)] + [("q", 2, 4, i, f"b{i}") for i in range(2)] + [("q", 2, 4, 2, "a1")], "query_id string, round int, k int, place int, chunk_id string").withColumn("text", F.col("chunk_id"))
    assert [r.chunk_id for r in answers.chosen(rounds).orderBy("place").collect()] == ["b0", "b1", "a1", "a0"]


def test_held_to_a_document(spark, store):
    """A question held to a document is never refused and meets no other company; without a filing it has no figures."""

    class Refusing(answers.RuleProvider):
        def route(self, question):
            return {"route": "out_of_scope", "queries": [{"op": "value", "metric": "revenue"}], "companies": ["ELSE"], "refusal": "no", "fully_answers": True}

    f, p = store
    q = spark.createDataFrame([("1", "AAPL", "Tell me", "D1", None, None), ("2", "AAPL", "Tell me", None, None, None)], "query_id string, ticker string, question string, doc_id string, scope_cik long, scope_accn string")
    chunks = spark.createDataFrame([("c1", 0, "One text. More")], "chunk_id string, place int, text string")
    retrieve = lambda asked: asked.crossJoin(chunks).select("query_id", "chunk_id", "place", "text")
    listed = spark.createDataFrame([("ELSE",)], "ticker string")
    got = {r.query_id: r for r in answers.answer(q, Refusing(), retrieve, p, f, spark.createDataFrame([(1, "AAPL")], "cik long, ticker string"), listed.limit(0), listed).collect()}
    assert (got["1"].route, got["1"].displayed, got["1"].figures, got["1"].ticker) == ("narrative", 1, [], "AAPL")
    assert (got["2"].route, got["2"].needs_onboarding) == ("onboard", "ELSE")


def test_schema_can_be_made_again(spark):
    one_, two = schema.create(spark).collect(), schema.create(spark).collect()
    assert one_ == two and spark.table("claims").columns[0] == "claim_id"


@pytest.mark.parametrize("copies", [1, 4000])
def test_nearest_rows_take_bounded_memory(copies):
    """What a task of a search holds at its peak doesn't follow queries times rows, also where all rows are equally far; the result is that of brute force."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (8000 // copies, 8)).astype(np.float32) + np.float32(0.5)
    ids, rows = rng.permutation(8000), np.repeat(x, copies, axis=0)
    q = rng.integers(-3, 4, (1500, 8)) + 0.5
    queries = pd.DataFrame({"query_id": np.arange(1500), "scope": 0, "query": list(q)})
    batches = [pd.DataFrame({"vec_id": ids[i : i + 4000], "scope": 0, "embedding": list(rows[i : i + 4000])}) for i in (0, 4000)]
    run = retrieval._nearest(queries, 3)
    tracemalloc.start()
    got = pd.concat(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    far = np.round(1 - retrieval._unit(queries["query"]) @ retrieval._unit(pd.Series(list(rows))).T, 12)
    want = [(i, int(ids[j])) for i in range(1500) for j in np.lexsort((ids, far[i]))[:3]]
    assert list(zip(got["query_id"].tolist(), got["vec_id"].tolist())) == want
