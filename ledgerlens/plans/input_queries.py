"""Queries of readers, benchmark inputs and report parts, and their SQL. Payloads are written to the shared folder as they would be received, then read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import presentation
from ledgerlens.operators import benchmarks, claims, evals, retrieval
from ledgerlens.plans import answers, flow_queries, narrative_queries, schema
from ledgerlens.plans.numeric_queries import BASE, POINTS, facts, stored_points
from ledgerlens.plans.projection import FIGURES, FILINGS, JUDGED, LOG, as_sql, project
from ledgerlens.sources import filings, sinks
from ledgerlens.sources.staging import folder, put
from ledgerlens.streaming import events as stream


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def _nations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cik"), F.col("n_name").alias("ticker"))


# --- payloads

def company_payloads(spark, sf_dir):
    """Facts from companies' payloads; tags outside the registry, and points that lack what a fact needs, are left out."""
    f = facts(spark, sf_dir).drop("fp", "frame")
    bad = f.where("cik % 5 = 0 and tag = 'GrossProfit'")
    junk = bad.withColumn("tag", F.lit("Unheard")).unionByName(bad.withColumn("end_date", F.lit(None).cast("date"))).unionByName(bad.withColumn("accn", F.lit(""))).unionByName(bad.withColumn("val", F.lit(None).cast("decimal(28,2)")))
    day = lambda c: F.col(c).cast("string")
    point = F.struct(day("start_date").alias("start"), day("end_date").alias("end"), "val", "accn", "fy", "form", day("filed").alias("filed"))
    units = f.unionByName(junk).groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list(point).alias("points"))
    tags = units.groupBy("cik", "taxonomy", "tag").agg(F.struct(F.lit("a label").alias("label"), F.map_from_entries(F.collect_list(F.struct("unit", "points"))).alias("units")).alias("body"))
    taxonomies = tags.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "body"))).alias("tags"))
    body = taxonomies.groupBy("cik").agg(F.lit("a company").alias("entityName"), F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    path = _place(spark, "payloads")
    body.write.json(path)
    return filings.company_facts(spark, path).select("cik", "tag", "unit", "start_date", "end_date", F.col("val").cast("double").alias("val"), "accn", "fy", "form", "filed")


def _filers(spark, sf_dir):
    """Customers as companies that file."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("cik"), F.col("c_name").alias("ticker"))


def _listing(spark, sf_dir, *more):
    """The listing as it is received: one file, a map of entries."""
    entry = lambda cik, title: F.struct(cik.cast("string").alias("key"), F.struct(cik.alias("cik_str"), F.concat(F.lit("N"), cik).alias("ticker"), title.alias("title")).alias("value"))
    rows = _filers(spark, sf_dir).select(entry(F.col("cik"), F.concat("ticker", F.lit(" Inc."))).alias("e"))
    for cik in more:
        rows = rows.unionByName(spark.range(1).select(entry(F.lit(cik).cast("long"), F.lit("Without filings")).alias("e")))
    path = _place(spark, "listing")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(path)
    return filings.ticker_registry(spark, path)


def listed_tickers(spark, sf_dir):
    """Names against the listing: malformed and unknown ones say so."""
    wanted = _filers(spark, sf_dir).select(F.when(F.col("cik") % 4 == 0, F.concat(F.lit(" n"), "cik")).when(F.col("cik") % 4 == 1, F.concat(F.lit("9"), "cik")).otherwise(F.concat(F.lit("ZZ"), "cik")).alias("ticker"))
    got = filings.resolve_tickers(wanted, _listing(spark, sf_dir))
    return got.select("ticker", "cik", "title", "error")


def _submissions(spark, sf_dir):
    """Filing indexes as they are received, written by the tasks: recent filings, and one older file."""
    cik = F.col("cik")

    def block(first: int, *forms):
        each = lambda make: F.transform(F.sequence(F.lit(0), F.lit(len(forms) - 1)), make)
        return F.struct(
            F.array(*forms).alias("form"),
            each(lambda i: F.concat(cik, F.lit("-"), i + first)).alias("accessionNumber"),
            each(lambda i: F.when((cik + i) % 7 == 3, "").otherwise(F.concat(F.lit("d"), i + first, F.lit(".htm")))).alias("primaryDocument"),
            each(lambda i: F.concat(2003 - first - i, F.lit("-03-01"))).alias("filingDate"),
            each(lambda i: F.concat(2002 - first - i + cik % 2, F.when(cik % 2 == 0, "-12-31").otherwise("-01-31"))).alias("reportDate"),
        )

    third = F.when(cik % 3 > 0, "10-K").otherwise("8-K")
    recent, older = block(0, F.lit("10-Q"), F.lit("10-K/A"), third, F.lit("10-K")), block(4, F.lit("10-K"), F.lit("10-K"))
    one = F.to_json(F.struct(cik.cast("string").alias("cik"), F.struct(recent.alias("recent"), F.array(older).alias("older")).alias("filings")))
    path = _place(spark, "submissions")
    # a file holds one JSON value, here a list of companies
    _filers(spark, sf_dir).groupBy((cik % 16).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return filings.submissions(spark, path)


def latest_annual_filing(spark, sf_dir):
    """The first filing of exactly the form."""
    return filings.latest_filing(_submissions(spark, sf_dir)).select(F.col("cik").cast("bigint").alias("cik"), "accn", "filed")


def filing_of_year(spark, sf_dir):
    """The filing that reports a year: by its report date, or one of the quarter after."""
    rows = _submissions(spark, sf_dir)
    wanted = rows.select("cik").distinct().withColumn("fy", F.explode(F.array(*map(F.lit, (1997, 1998, 1999)))))
    return filings.filing_for_year(rows, wanted).select(F.col("cik").cast("bigint").alias("cik"), "fy", "accn")


def filing_documents(spark, sf_dir):
    """Primary documents, of the recent filings and of all."""
    rows = _submissions(spark, sf_dir)
    recent, deep = filings.filing_docs(rows), filings.filing_docs(rows, deep=True)
    return recent.withColumn("deep", F.lit(False)).union(deep.withColumn("deep", F.lit(True))).select(F.col("cik").cast("bigint").alias("cik"), "deep", "accn", "primary_doc")


def statement_pages(spark, sf_dir):
    """Statements from filing summaries: the first of each kind, without parenthetical and comprehensive ones; a broken summary has none."""
    def report(i: int, name: str) -> str:
        return f"<Report><ShortName>{name}</ShortName><HtmlFileName>R{i}.htm</HtmlFileName></Report>"

    names = ("Cover", "CONSOLIDATED BALANCE SHEETS (Parenthetical)", "Consolidated Balance Sheets", "STATEMENTS OF COMPREHENSIVE INCOME", "Consolidated Statements of Income", "Consolidated Statements of Operations", "Statements of Cash Flows", "Balance Sheets again")
    full = "<FilingSummary><MyReports>" + "".join(report(i, n) for i, n in enumerate(names, 1)) + "</MyReports></FilingSummary>"
    some = "<FilingSummary><MyReports>" + report(1, "Cover") + report(2, "Statements of Financial Position") + "</MyReports></FilingSummary>"
    xml = F.when(F.col("cik") % 3 == 0, full).when(F.col("cik") % 3 == 1, some).otherwise(full[:200])
    got = filings.statement_pages(_nations(spark, sf_dir).select("cik", F.concat(F.lit("K-"), "cik").alias("accn"), xml.alias("xml")))
    return got.select("cik", "stmt", "html_file")


def filing_texts(spark, sf_dir):
    """Whole filings, a row a file: ids by ticker and filing year; what is too short is left out."""
    path = _place(spark, "texts")
    for r in _nations(spark, sf_dir).collect():  # the 25 nations
        put(spark, f"{path}/n{r['cik']}_10K.txt", "word " * (r["cik"] + 1) * 200)
    meta = _nations(spark, sf_dir).where("cik % 2 = 0").select(F.concat(F.lit("N"), "cik").alias("ticker"), F.concat(F.lit("20"), F.lpad((F.col("cik") % 24).cast("string"), 2, "0"), F.lit("-02-01")).alias("filing_date"))
    return filings.filing_texts(spark, path, meta).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def event_lines(spark, sf_dir):
    """A log with blank and broken lines, read back."""
    path = _place(spark, "log")
    log = project(spark, sf_dir, LOG).select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "event", "query_id")).alias("line"))
    lines = F.when(F.col("event_id") % 50 == 7, F.array("line", F.lit(""), F.lit("{broken"))).otherwise(F.array("line"))
    log.select(F.explode(lines).alias("value")).write.text(path)
    got = filings.json_lines(spark, path, "ts string, event string, query_id string").where("event = 'llm_call'")
    return got.groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count("*").alias("n"), F.min("query_id").alias("first"))


def golden_cases(spark, sf_dir):
    """The cases of a golden set, which is one file by nature, made of the benchmark's items."""
    path = _place(spark, "golden")
    case = F.struct(F.concat(F.lit("c"), "item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, "narrative").otherwise("numeric").alias("kind"), F.col("text").alias("question"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").agg(F.to_json(F.struct(F.lit("a set").alias("about"), F.collect_list(case).alias("cases"))).alias("value")).write.text(path)
    return filings.cases(spark, path, "case_id:string,kind:string,question:string").select("case_id", "kind", F.md5("question").alias("question"))


def report_files(spark, sf_dir):
    """Reports stored as JSON and read back."""
    path = _place(spark, "reports")
    sinks.reports_json(claims.report(project(spark, sf_dir, JUDGED)), path)
    got = spark.read.schema("query_id string, displayed long, unverified long, blocked long, risk_flags long, unsupported_rate double, credibility double").json(path)
    return got.withColumns({c: F.round(c, 6) for c in ("unsupported_rate", "credibility")})


def rejudged_results(spark, sf_dir):
    """Stored results under the present rule; what old files lack counts against them, but for the probes."""
    j = project(spark, sf_dir, JUDGED).groupBy("query_id").agg(F.min("doc_id").alias("m"), claims.unsupported_rate(F.col("verdict")).alias("rate"))
    stored = j.select("query_id", F.when(F.col("m") % 5 > 0, F.when(F.col("m") % 7 == 0, 1).otherwise(0)).alias("n_crashed"), F.when(F.col("m") % 11 > 0, F.col("rate") / 20).alias("unsupported_rate"), F.when(F.col("m") % 3 > 0, F.col("m") % 4 > 0).alias("numeric_ok"))
    return evals.rejudged(stored).select("query_id", "passed")


def smoke_questions(spark, sf_dir):
    """Questions about three chunks of every source, numeric ones left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) >= 500").select(F.col("source").alias("ticker"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return answers.questions_from(docs, answers.RuleProvider(), n=3)


def condensed_questions(spark, sf_dir):
    """The last question of every conversation, told with what was said before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    return answers.condensed(turns, answers.RuleProvider()).select("conv_id", F.md5("question").alias("question"))


#: Rows of tables whose cells lost what stood between them.
_CELLS = """SELECT event_id, concat('Americas$', user_id, ' %$', event_id, CASE WHEN event_id % 3 = 0 THEN concat(chr(10), user_id, 'Change', event_id) ELSE ' (net)' END, event_id % 7, '%(', user_id, ')') AS text FROM {events}"""


def table_rows(spark, sf_dir):
    """Cells set apart again."""
    return project(spark, sf_dir, _CELLS).select("event_id", presentation.readable_rows(F.col("text")).alias("text"))


#: A company that is listed and has filed nothing.
_LATE = 900_000_001


def onboarding_status(spark, sf_dir):
    """What is to be taken in of the companies asked for, with no bound on the corpus and with a full one."""
    wanted = _filers(spark, sf_dir).select(F.concat(F.lit("n"), "cik").alias("ticker")).union(spark.createDataFrame([(f"N{_LATE}",), ("9X",), ("ZZZ",), (" n5 ",)], "ticker string"))
    corpus = _filers(spark, sf_dir).where("cik % 5 = 0").select(F.concat(F.lit("N"), "cik").alias("ticker"))
    listing, rows = _listing(spark, sf_dir, _LATE), _submissions(spark, sf_dir)
    got = [answers.onboarding(wanted, corpus, listing, rows, most).withColumn("most", F.lit(most)) for most in (0, 5)]
    return got[0].union(got[1]).select("most", "ticker", "status", "accn")


def answer_reports(spark, sf_dir):
    """A question for every company, answered end to end: figures, texts found by vectors, or a refusal. Each document is a chunk of one company."""
    nations = _nations(spark, sf_dir)
    question = F.element_at(F.array(*map(F.lit, ("What is the average revenue?", "Write a poem about the sea", "What are the main risks?", "What is the median age?"))), (F.col("cik") % 4 + 1).cast("int"))
    asked = nations.select(F.col("cik").cast("string").alias("query_id"), "ticker", question.alias("question"))
    retrieve = flow_queries.retriever(spark, sf_dir, asked)
    got = answers.answer(asked, answers.RuleProvider(), retrieve, stored_points(spark, sf_dir), facts(spark, sf_dir), nations, nations.select("ticker"), nations.select("ticker"))
    return got.select("query_id", "ticker", "route", "degraded", F.when(F.col("route") == "out_of_scope", F.col("summary")).alias("refusal"), F.size("figures").alias("n_figures"), "displayed", "blocked", F.round("unsupported_rate", 6).alias("unsupported_rate"))


# --- benchmark inputs

def _bench(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    questions = items.select(F.col("item_id").alias("case_id"), F.concat(F.lit("D"), F.col("item_id") % 20).alias("doc_name"), F.concat(F.lit("t"), F.col("item_id") % 3).alias("question_type"), "text")
    meta = spark.range(22).select(F.concat(F.lit("D"), "id").alias("doc_name"), F.concat(F.lit("Company "), F.col("id") % 7).alias("company"), F.when(F.col("id") % 4 == 3, "8k").otherwise("10k").alias("doc_type"), (F.lit(2000) + F.col("id") % 5).cast("string").alias("doc_period"))
    ciks = spark.range(6).select(F.concat(F.lit("Company "), "id").alias("name"), F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"))
    return questions, benchmarks.documents(questions, meta, ciks)


def benchmark_documents(spark, sf_dir):
    """Annual reports that are asked about, with their company and year, and the filing they are held to where it was fetched."""
    _, docs = _bench(spark, sf_dir)
    fetched = spark.range(0, 22, 2).select(F.concat(F.lit("D"), "id").alias("doc_name"), F.concat(F.lit("acc-"), "id").alias("accession"))
    return docs.join(benchmarks.scopes(docs, fetched), "doc_name").select("doc_name", "company", "fy", "cik", "scope_cik", "scope_accn")


def benchmark_cases(spark, sf_dir):
    """Questions of two types about annual reports, the first thirty by id, in order."""
    questions, docs = _bench(spark, sf_dir)
    return benchmarks.ordered(benchmarks.cases(questions, docs, ("t0", "t1"), 30).select("case_id", "doc_name", "question_type"), "case_id").select("case_id", "doc_name", "question_type", F.col("place").cast("bigint").alias("place"))


def suspect_documents(spark, sf_dir):
    """Benchmark documents in which no question's evidence is found; every third one holds its questions' texts."""
    questions, docs = _bench(spark, sf_dir)
    cases = benchmarks.cases(questions, docs)
    own = questions.where(F.substring("doc_name", 2, 9).cast("int") % 3 == 0).groupBy("doc_name").agg(F.concat_ws(" ... ", F.array_sort(F.collect_list("text"))).alias("text"))
    texts = docs.join(own, "doc_name", "left").select("doc_name", F.coalesce("text", F.lit("nothing of this kind")).alias("text"))
    return benchmarks.suspects(cases, questions.select("case_id", "text"), texts)


def exhibits_appended(spark, sf_dir):
    """Documents with their exhibits after them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_name"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    exhibits = d.where("doc_id % 3 = 0").select("doc_name", F.explode(F.array(F.lit(2), F.lit(1))).alias("pos")).select("doc_name", "pos", F.concat(F.lit("exhibit "), "pos").alias("text"))
    return benchmarks.with_exhibits(d.select("doc_name", "text"), exhibits).select("doc_name", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


# --- claims and scopes

def citation_whitelist(spark, sf_dir):
    """Citations of a claim that were retrieved, order and repeats kept."""
    j = project(spark, sf_dir, JUDGED)
    cited = F.transform(F.array(*[(F.col("doc_id") + d) % 7 for d in (0, 3, 5, 0, 1)]), lambda x: F.concat(F.lit("c"), x))
    return j.select("claim_id", F.array_join(claims.whitelisted(cited, F.array(*[F.lit(f"c{i}") for i in (0, 2, 3, 6)])), ",").alias("kept"))


def risk_signals(spark, sf_dir):
    """Claims whose figures are all in their evidence, and phrases that say a risk has come true."""
    c = project(spark, sf_dir, FIGURES).withColumn("evidence", F.concat("evidence", F.when(F.col("cik") % 3 == 0, " which has declined since").otherwise("")))
    return claims.risk_signals(c).select("cik", "y", "quantified", "realized")


def pinned_documents(spark, sf_dir):
    """Texts that a question may meet: the live ones, or the pinned one of either corpus."""
    f = project(spark, sf_dir, FILINGS).withColumn("doc_id", F.col("doc_id").cast("string"))
    some = [retrieval.searchable(f, pin).select(F.lit(pin or "none").alias("pinned"), "doc_id", "corpus") for pin in (None, "10", "11")]
    return some[0].union(some[1]).union(some[2])


def chunks_by_id(spark, sf_dir):
    """The texts of a claim's citations, by their ids."""
    f = project(spark, sf_dir, FILINGS).withColumn("chunk_id", F.col("doc_id").cast("string"))
    wanted = project(spark, sf_dir, JUDGED).where("kind = 'risk'").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return retrieval.by_id(f, wanted).select("chunk_id", "corpus", F.md5("text").alias("digest"))


def stages_once_stream(spark, sf_dir):
    """The first event of each stage of a query, by Structured Streaming over the log, run until all is processed."""
    at = _place(spark, "stages")
    log = project(spark, sf_dir, LOG).select(F.col("ts").cast("timestamp").alias("ts"), "event", "query_id", "stage")
    log.union(log).write.json(f"{at}/log")
    tail = stream.tail(spark, f"{at}/log", "ts timestamp, event string, query_id string, stage string")
    stream.to_table(stream.stages_once(tail, "3000 days"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("query_id", "stage", "event")


# --- report parts

def run_summary(spark, sf_dir):
    """Retrieval hits, number match, flagged and generic claims of a run, from its judged claims."""
    j = project(spark, sf_dir, JUDGED)
    cases = j.groupBy("query_id").agg(
        F.concat(F.lit("c"), F.min("doc_id") % 5).alias("expected_chunk_id"),
        F.collect_set(F.concat(F.lit("c"), F.col("doc_id") % 4)).alias("retrieved_chunk_ids"),
        F.collect_list(F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5) / 4)).alias("number_scores"),
        F.collect_list(F.when(F.col("doc_id") % 6 == 0, F.col("claim_id"))).alias("flagged"),
        F.collect_list(F.col("n_chars") < 900).alias("boilerplate"),
    )
    return evals.run_summary(cases).withColumns({"number_match": F.round("number_match", 6), "boilerplate_rate": F.round("boilerplate_rate", 6)})


def digest_scorecard(spark, sf_dir):
    return evals.scorecard(project(spark, sf_dir, JUDGED), "query_id")


def section_order(spark, sf_dir):
    """A digest's sections in their fixed places, whichever came first."""
    order = ("overview", "risks", "strategy", "outlook")
    got = _nations(spark, sf_dir).select("cik", F.explode(F.array(*map(F.lit, (*order[::-1], "extra")))).alias("section"))
    placed = got.withColumn("place", benchmarks.section_place(F.col("section"), order))
    return placed.groupBy("cik").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), ",").alias("sections"))


def source_links(spark, sf_dir):
    """The links under a card: one for each filing, in the order of its sources."""
    f = facts(spark, sf_dir).where("form in ('10-K', '10-K/A') and fy >= 1999")
    cards = f.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("tag", "end_date", "accn", "form"))).alias("s"))
    return cards.select("cik", F.array_join(presentation.links("s"), " · ").alias("links"))


def embedding_prefixes(spark, sf_dir):
    n = _nations(spark, sf_dir)
    cols = [retrieval.prefixed(F.col("ticker"), m, q).alias(f"{m[:3]}_{'query' if q else 'passage'}") for m in ("multilingual-e5-small", "bge-base-en", "minilm") for q in (True, False)]
    return n.select("cik", *[c for c in cols])


def judge_models(spark, sf_dir):
    n = _nations(spark, sf_dir).select("cik", F.when(F.col("cik") % 3 == 0, "own-judge").when(F.col("cik") % 3 == 1, " ").alias("configured"), F.when(F.col("cik") % 2 == 0, "one").otherwise("two").alias("provider"))
    return n.select("cik", evals.judge_model(F.col("configured"), F.col("provider"), {"one": "one-small", "two": "two-small"}).alias("model"))


def schema_tables(spark, sf_dir):
    """The tables of a fresh store: made twice, the second time nothing changes."""
    schema.create(spark)
    return schema.create(spark).orderBy("table", "position")


_ACCN = "cik || '-' || i"
_SUBS = """WITH n AS (SELECT CAST(c_custkey AS BIGINT) AS cik FROM customer),
f AS (SELECT cik, i, CASE WHEN i = 0 THEN '10-Q' WHEN i = 1 THEN '10-K/A' WHEN i = 2 AND cik % 3 = 0 THEN '8-K' ELSE '10-K' END AS form, CASE WHEN i < 4 THEN 0 ELSE 1 END AS block, 2002 - i + (cik % 2) AS report_year, cik % 2 AS early, (cik + CASE WHEN i < 4 THEN i ELSE i - 4 END) % 7 <> 3 AS has_doc FROM n, (SELECT unnest(range(0, 6)) AS i))
"""
_BENCH = """WITH q AS (SELECT item_id AS case_id, 'D' || (item_id % 20) AS doc_name, 't' || (item_id % 3) AS question_type, text FROM benchmark),
meta AS (SELECT 'D' || id AS doc_name, 'Company ' || (id % 7) AS company, CASE WHEN id % 4 = 3 THEN '8k' ELSE '10k' END AS doc_type, 2000 + id % 5 AS fy, id FROM (SELECT unnest(range(0, 22)) AS id)),
docs AS (SELECT doc_name, company, CAST(fy AS INT) AS fy, id, CASE WHEN id % 7 < 6 THEN lpad(CAST(id % 7 AS VARCHAR), 10, '0') END AS cik FROM meta WHERE doc_type = '10k' AND doc_name IN (SELECT doc_name FROM q))
"""
SQL = {
    "company_payloads": f"WITH {BASE}\nSELECT cik, tag, unit, start_date, end_date, CAST(val AS DOUBLE) AS val, accn, fy, form, filed FROM facts",
    "listed_tickers": """WITH n AS (SELECT c_custkey AS k, c_name AS name, 'N' || c_custkey AS t FROM customer)
SELECT CASE k % 4 WHEN 0 THEN t WHEN 1 THEN '9' || k ELSE 'ZZ' || k END AS ticker, CASE WHEN k % 4 = 0 THEN lpad(CAST(k AS VARCHAR), 10, '0') END AS cik, CASE WHEN k % 4 = 0 THEN name || ' Inc.' END AS title, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'malformed' ELSE 'unknown' END AS error FROM n""",
    "onboarding_status": _SUBS.rstrip() + f""",
w AS (SELECT 'N' || cik AS ticker, cik FROM n UNION ALL SELECT 'N{_LATE}', {_LATE} UNION ALL SELECT '9X', NULL UNION ALL SELECT 'ZZZ', NULL),
last AS (SELECT cik, cik || '-' || min(i) AS accn FROM f WHERE form = '10-K' AND block = 0 GROUP BY cik),
s AS (SELECT m.most, w.ticker, w.cik, CASE WHEN w.cik <> {_LATE} AND w.cik % 5 = 0 THEN 'exists' WHEN m.most = 5 THEN 'full' WHEN ticker = '9X' THEN 'malformed' WHEN ticker = 'ZZZ' THEN 'unknown' WHEN w.cik = {_LATE} THEN 'no filing' ELSE 'add' END AS status FROM w, (VALUES (0), (5)) AS m(most))
SELECT s.most, s.ticker, s.status, CASE WHEN s.status = 'add' THEN last.accn END AS accn FROM s LEFT JOIN last ON last.cik = s.cik""",
    "answer_reports": f"""WITH {BASE},
{POINTS},
q AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS scope, ['What is the average revenue?', 'Write a poem about the sea', 'What are the main risks?', 'What is the median age?'][n_nationkey % 4 + 1] AS t FROM nation),
{flow_queries.PICKS},
c AS (SELECT CAST(qid AS BIGINT) AS cik, count(*) AS n, count(*) FILTER (said = '') AS blank FROM picks GROUP BY qid),
r AS (SELECT CAST(n_nationkey AS BIGINT) AS cik, n_name AS ticker, n_nationkey % 4 AS k, n_nationkey % 4 = 0 AND EXISTS (SELECT 1 FROM newest WHERE newest.cik = n_nationkey AND metric = 'revenue') AS has FROM nation)
SELECT CAST(r.cik AS VARCHAR) AS query_id, ticker, CASE WHEN has THEN 'numeric' WHEN k = 1 THEN 'out_of_scope' ELSE 'narrative' END AS route, k = 0 AND NOT has AS degraded, CASE WHEN k = 1 THEN 'This is no question about a filing.' END AS refusal, CASE WHEN has THEN 1 ELSE 0 END AS n_figures,
  CASE WHEN has OR k = 1 THEN 0 ELSE coalesce(c.n, 0) END AS displayed, 0 AS blocked, CASE WHEN has OR k = 1 THEN 0.0 ELSE coalesce(round(c.blank / c.n, 6), 0.0) END AS unsupported_rate FROM r LEFT JOIN c ON c.cik = r.cik""",
    "latest_annual_filing": _SUBS + "SELECT cik, cik || '-' || min(i) AS accn, (2003 - min(i)) || '-03-01' AS filed FROM f WHERE form = '10-K' AND block = 0 GROUP BY cik",
    "filing_of_year": _SUBS + "SELECT cik, CAST(y.fy AS INT) AS fy, cik || '-' || i AS accn FROM f JOIN (VALUES (1997), (1998), (1999)) AS y(fy) ON f.report_year = y.fy OR (f.report_year = y.fy + 1 AND early = 1) WHERE form = '10-K' QUALIFY row_number() OVER (PARTITION BY cik, y.fy ORDER BY CASE WHEN report_year = y.fy THEN 1 ELSE 2 END, block, i) = 1",
    "filing_documents": _SUBS + "SELECT cik, deep, cik || '-' || i AS accn, 'd' || i || '.htm' AS primary_doc FROM f, (VALUES (false), (true)) AS d(deep) WHERE has_doc AND (deep OR block = 0)",
    "statement_pages": "SELECT CAST(n_nationkey AS BIGINT) AS cik, stmt, html_file FROM nation JOIN (VALUES (0, 'balance', 'R3.htm'), (0, 'income', 'R5.htm'), (0, 'cashflow', 'R7.htm'), (1, 'balance', 'R2.htm')) AS t(k, stmt, html_file) ON n_nationkey % 3 = t.k",
    "filing_texts": "SELECT 'N' || n_nationkey || '_10K' || CASE WHEN n_nationkey % 2 = 0 THEN '_20' || lpad(CAST(n_nationkey % 24 AS VARCHAR), 2, '0') ELSE '' END AS doc_id, CAST((n_nationkey + 1) * 1000 AS BIGINT) AS n_chars FROM nation WHERE (n_nationkey + 1) * 1000 >= 10000",
    "event_lines": f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(query_id) AS first FROM ({as_sql(LOG)}) WHERE event = 'llm_call' GROUP BY 1",
    "golden_cases": "SELECT 'c' || item_id AS case_id, CASE item_id % 2 WHEN 0 THEN 'narrative' ELSE 'numeric' END AS kind, md5(text) AS question FROM benchmark",
    "report_files": narrative_queries.SQL["credibility_report"],
    "rejudged_results": f"""SELECT query_id, CASE WHEN m % 5 > 0 AND m % 7 <> 0 AND m % 11 > 0 AND rate / 20 <= {evals.UNSUPPORTED_MOST} AND (m % 3 = 0 OR m % 4 > 0) THEN true ELSE false END AS passed
FROM (SELECT query_id, min(doc_id) AS m, avg(CASE WHEN verdict = 'SUPPORTED' THEN 0.0 ELSE 1.0 END) AS rate FROM ({as_sql(JUDGED)}) GROUP BY query_id)""",
    "smoke_questions": f"""SELECT ticker, chunk_id, question FROM (SELECT source AS ticker, CAST(doc_id AS VARCHAR) AS chunk_id, 'What is said of ' || array_to_string(list_filter(regexp_split_to_array(substr(text, 1, 2000), '\\s+'), lambda x: x <> '')[1:3], ' ') || '?' AS question
  FROM documents WHERE length(text) >= 500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('smoke' || doc_id), CAST(doc_id AS VARCHAR)) <= 3) WHERE NOT regexp_matches(question, '{answers.NUMERIC}')""",
    "condensed_questions": """WITH u AS (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT c.conv_id, max(c.turn) AS before FROM conversations AS c JOIN u ON u.conv_id = c.conv_id AND c.turn < u.asked GROUP BY c.conv_id)
SELECT u.conv_id, md5(coalesce(q.text, '') || CASE WHEN p.before IS NULL THEN '' ELSE ' (after: ' || coalesce(b.text, '') || ')' END) AS question
FROM u JOIN conversations AS q ON q.conv_id = u.conv_id AND q.turn = u.asked LEFT JOIN p ON p.conv_id = u.conv_id LEFT JOIN conversations AS b ON b.conv_id = p.conv_id AND b.turn = p.before""",
    "table_rows": f"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(text, '(\\d)Change(\\d)', '\\1  |  Change  |  \\2', 'g'), '([A-Za-z)])(\\$?\\d)', '\\1   \\2', 'g'), '(%)[^\\S\\n]*(\\(?\\$?\\d)', '\\1   |   \\2', 'g') AS text FROM ({as_sql(_CELLS)})""",
    "benchmark_documents": _BENCH + "SELECT doc_name, company, fy, cik, CASE WHEN id % 2 = 0 THEN cik END AS scope_cik, CASE WHEN id % 2 = 0 THEN 'acc-' || id END AS scope_accn FROM docs",
    "benchmark_cases": _BENCH + "SELECT case_id, doc_name, question_type, row_number() OVER (ORDER BY case_id) AS place FROM q WHERE question_type IN ('t0', 't1') AND doc_name IN (SELECT doc_name FROM docs) ORDER BY case_id LIMIT 30",
    "suspect_documents": _BENCH.rstrip() + """,
w AS (SELECT case_id, q.doc_name, regexp_extract_all(text, '[A-Za-z0-9.,$%()\\-]+') AS ws FROM q JOIN docs ON docs.doc_name = q.doc_name)
SELECT w.doc_name, count(*) AS n_cases, count(*) FILTER (any_value_id % 3 = 0 AND len(ws) > 0) AS n_found, count(*) FILTER (any_value_id % 3 = 0 AND len(ws) > 0) = 0 AS suspect FROM (SELECT w.*, d.id AS any_value_id FROM w JOIN docs AS d ON d.doc_name = w.doc_name) AS w GROUP BY w.doc_name""",
    "citation_whitelist": f"WITH j AS ({as_sql(JUDGED)}) SELECT claim_id, array_to_string(list_filter(list_transform([0, 3, 5, 0, 1], lambda d: 'c' || ((doc_id + d) % 7)), lambda c: list_contains(['c0', 'c2', 'c3', 'c6'], c)), ',') AS kept FROM j",
    "risk_signals": narrative_queries._FIG + f"SELECT cik, y, coalesce({narrative_queries._MATCH} = 1.0, false) AS quantified, CASE WHEN cik % 3 = 0 THEN 'has declined' END AS realized FROM c",
    "pinned_documents": f"WITH f AS ({as_sql(FILINGS)}) SELECT 'none' AS pinned, CAST(doc_id AS VARCHAR) AS doc_id, corpus FROM f WHERE corpus = 'live' UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), corpus FROM f WHERE doc_id IN (10, 11)",
    "chunks_by_id": f"WITH f AS ({as_sql(FILINGS)}), j AS ({as_sql(JUDGED)}) SELECT CAST(doc_id AS VARCHAR) AS chunk_id, corpus, md5(text) AS digest FROM f WHERE doc_id IN (SELECT doc_id FROM j WHERE kind = 'risk')",
    "stages_once_stream": f"SELECT DISTINCT query_id, stage, event FROM ({as_sql(LOG)})",
    "exhibits_appended": "SELECT CAST(doc_id AS VARCHAR) AS doc_name, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'exhibit 1' || chr(10) || chr(10) || 'exhibit 2' ELSE '' END AS t FROM documents)",
    "run_summary": f"""WITH j AS ({as_sql(JUDGED)}),
c AS (SELECT query_id, 'c' || (min(doc_id) % 5) AS e, list(DISTINCT 'c' || (doc_id % 4)) AS r, sum((doc_id % 5) / 4.0) FILTER (doc_id % 3 > 0) AS total, count(*) FILTER (doc_id % 3 > 0) AS k, count(*) FILTER (doc_id % 6 = 0) AS flagged, count(*) FILTER (n_chars < 900) AS generic, count(*) AS n FROM j GROUP BY query_id)
SELECT count(*) AS n_cases, count(*) FILTER (list_contains(r, e)) AS retrieval_hits, CAST(sum(flagged) AS BIGINT) AS n_flagged, round(sum(total) / sum(k), 6) AS number_match, round(sum(generic) / sum(n), 6) AS boilerplate_rate FROM c""",
    "digest_scorecard": f"WITH j AS ({as_sql(JUDGED)}) SELECT query_id, count(*) AS n_claims, count(*) FILTER (verdict = 'SUPPORTED') AS n_ok, CASE WHEN count(*) = count(*) FILTER (verdict = 'SUPPORTED') THEN 'every narrative claim verified' ELSE count(*) FILTER (verdict = 'SUPPORTED') || ' of ' || count(*) || ' claims verified' END AS line FROM j GROUP BY query_id",
    "section_order": "SELECT CAST(n_nationkey AS BIGINT) AS cik, 'overview,risks,strategy,outlook,extra' AS sections FROM nation",
    "source_links": f"""WITH {BASE},
s AS (SELECT cik, accn, form, row_number() OVER (PARTITION BY cik ORDER BY tag, end_date, accn, form) AS pos FROM facts WHERE form IN ('10-K', '10-K/A') AND fy >= 1999),
first AS (SELECT cik, accn, arg_min(form, pos) AS form, min(pos) AS pos FROM s GROUP BY cik, accn)
SELECT cik, string_agg(form || ' ' || accn, ' · ' ORDER BY pos) AS links FROM first GROUP BY cik""",
    "embedding_prefixes": "SELECT CAST(n_nationkey AS BIGINT) AS cik, 'query: ' || n_name AS mul_query, 'passage: ' || n_name AS mul_passage, 'Represent this sentence for searching relevant passages: ' || n_name AS bge_query, n_name AS bge_passage, n_name AS min_query, n_name AS min_passage FROM nation",
    "schema_tables": "SELECT t AS \"table\", CAST(p AS INT) AS position, c AS \"column\", y AS type FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c.split(' ')[0]}', '{c.split(' ')[1]}')" for t, cs in schema.TABLES.items() for i, c in enumerate(cs.split(", "))) + ") AS v(t, p, c, y)",
    "judge_models": "SELECT CAST(n_nationkey AS BIGINT) AS cik, CASE WHEN n_nationkey % 3 = 0 THEN 'own-judge' WHEN n_nationkey % 2 = 0 THEN 'one-small' ELSE 'two-small' END AS model FROM nation",
}

_FUNCTIONS = (
    company_payloads, listed_tickers, latest_annual_filing, filing_of_year, filing_documents, onboarding_status, answer_reports, statement_pages, filing_texts, event_lines, golden_cases, report_files, rejudged_results, smoke_questions, condensed_questions, table_rows, benchmark_documents, benchmark_cases, suspect_documents,
    citation_whitelist, risk_signals, pinned_documents, chunks_by_id, stages_once_stream, exhibits_appended, run_summary, digest_scorecard, section_order, source_links, embedding_prefixes, judge_models, schema_tables,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
