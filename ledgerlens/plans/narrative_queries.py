"""Queries over filing texts, claims, runs and logs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import figures, presentation
from ledgerlens.operators import chunking, claims, evals, matching, retrieval
from ledgerlens.plans.numeric_queries import BASE, POINTS, facts, stored_points
from ledgerlens.plans.projection import FIGURES, FILINGS, JUDGED, LOG, as_sql, project
from ledgerlens.sources import sinks, versions
from ledgerlens.sources.staging import folder, ingested


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


# --- chunks

def chunk_pack(spark, sf_dir):
    got = chunking.chunk(project(spark, sf_dir, FILINGS))
    return got.select("chunk_id", "section", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def chunk_sections(spark, sf_dir):
    got = chunking.chunk(project(spark, sf_dir, FILINGS))
    return got.groupBy("corpus", "section").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


def chunk_noise(spark, sf_dir):
    f = project(spark, sf_dir, FILINGS)
    return f.select("doc_id", F.size(chunking.paragraphs(F.col("text"))).cast("bigint").alias("paragraphs"))


def corpus_live(spark, sf_dir):
    """Live texts of 500 characters or more, by ticker."""
    f = project(spark, sf_dir, FILINGS).where((F.col("corpus") == "live") & (F.length("text") >= 500))
    return f.groupBy("ticker").agg(F.count("*").alias("docs"))


# --- retrieval

def _queries(spark, sf_dir, scoped):
    """Every vector whose id is divisible by 50 asks all vectors, or those of each scope."""
    v = _table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    if not scoped:
        return v.withColumn("scope", F.lit(0)), q.select(F.col("query_id") * 1000, F.lit(0).alias("scope"), "query").toDF("query_id", "scope", "query")
    scopes = v.select(F.col("label").alias("scope")).distinct()  # a handful of labels, and each query asks each
    return v.withColumn("scope", F.col("label")), q.join(scopes, F.lit(True)).select((F.col("query_id") * 1000 + F.col("scope")).alias("query_id"), "scope", "query")


def vector_topk(spark, sf_dir):
    v, q = _queries(spark, sf_dir, False)
    return retrieval.topk(v, q, 6).select("query_id", "vec_id", F.col("place").cast("bigint").alias("place"), _r(F.col("distance")).alias("distance"))


def vector_topk_scoped(spark, sf_dir):
    v, q = _queries(spark, sf_dir, True)
    return retrieval.topk(v, q, 6).select("query_id", "vec_id", F.col("place").cast("bigint").alias("place"), _r(F.col("distance")).alias("distance"))


def vector_mmr(spark, sf_dir):
    """Coverage questions: twice the results, chosen from three times as many."""
    v, q = _queries(spark, sf_dir, True)
    k = retrieval.coverage_k()
    return retrieval.mmr(retrieval.topk(v, q, retrieval.POOL * k).join(v.select("vec_id", "embedding"), "vec_id"), k)


def _rounds(spark, sf_dir):
    """A first round, and a second with the query rewritten (here: read backwards); both search all vectors."""
    v, q = _queries(spark, sf_dir, False)
    first = retrieval.topk(v, q, 6).select("query_id", F.lit(1).alias("round"), "place", "vec_id")
    second = retrieval.topk(v, q.withColumn("query", F.reverse("query")), 3).select("query_id", F.lit(2).alias("round"), "place", "vec_id")
    return first.union(second)


def refine_topup(spark, sf_dir):
    return retrieval.top_up(_rounds(spark, sf_dir), 6).select("query_id", "vec_id", F.col("place").cast("bigint").alias("place"))


# --- claims

def claim_figures(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES)
    return c.select("cik", "y", F.posexplode(figures.values(F.col("claim"))).alias("pos", "v")).select("cik", "y", F.col("pos").cast("bigint").alias("pos"), "v")


def claim_number_match(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES)
    return c.select("cik", "y", _r(figures.number_match(figures.values(F.col("claim")), figures.values(F.col("evidence")))).alias("number_match"))


def claim_arithmetic(spark, sf_dir):
    return project(spark, sf_dir, FIGURES).select("cik", "y", figures.arithmetic_ok(F.col("claim")).alias("arithmetic_ok"))


def claim_token_overlap(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES)
    return c.select("cik", "y", _r(figures.word_overlap(figures.words(F.col("claim")), figures.words(F.col("evidence")))).alias("token_overlap"))


def claim_check(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES)
    return c.select("cik", "y", figures.flagged(figures.number_match(figures.values(F.col("claim")), figures.values(F.col("evidence"))), figures.arithmetic_ok(F.col("claim"))).alias("flagged"))


def fact_rescue(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES).select("cik", F.concat("cik", F.lit("-"), "y").alias("claim_id"), figures.values(F.col("claim")).alias("values"))
    return claims.rescue(c, facts(spark, sf_dir).select("cik", "val"))


def _hits(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    words = ingested(spark, f"{sf_dir}/documents.parquet", "document-words", lambda: d.select(F.col("doc_id").alias("id"), figures.words(F.col("text")).alias("w")))
    asked = d.select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") + 20, F.col("doc_id") + 40, F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).otherwise(-1)).alias("retrieved"))
    return asked, matching.evidence_equivalent(asked, words, evals.EVIDENCE_LEAST)


def evidence_equivalent(spark, sf_dir):
    """Whether some of the documents retrieved (20 and 40 ids on, and every tenth itself) covers 60 % of a document's words."""
    _, met = _hits(spark, sf_dir)
    return met.select(F.col("id").alias("doc_id"), F.col("equivalent").alias("hit"))


def hit_types(spark, sf_dir):
    """How retrieval met each document: by its id, by its words, or not."""
    asked, met = _hits(spark, sf_dir)
    return asked.join(met, "id").groupBy(evals.hit_type(F.col("id"), F.col("retrieved"), F.col("equivalent")).alias("hit_type")).agg(F.count("*").alias("n"))


def risk_phrase(spark, sf_dir):
    f = project(spark, sf_dir, FILINGS).select("doc_id", figures.realized_risk(F.col("text")).alias("phrase"))
    return f.where("phrase is not null")


#: Sections by label: neighbours mostly share one, some are worded differently, some have none.
_SECTION = "CASE label % 6 WHEN 0 THEN 'Item 1A. Risk Factors' WHEN 1 THEN ' item 7 ' WHEN 2 THEN 'Item 7' WHEN 4 THEN 'Legal Proceedings' WHEN 5 THEN 'ITEM 1A. RISK FACTORS ' END"


def risk_echo_sections(spark, sf_dir):
    """Other sections near each claim (a vector whose id is divisible by 50): among its five nearest of all, and among its five nearest elsewhere."""
    chunks = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("scope"), "embedding", F.expr(_SECTION).alias("section"))
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("claim_id"), "scope", "embedding", F.array("section").alias("cited_sections"))
    got = [claims.echoes(asked, chunks, 5, apart=apart).withColumn("apart", F.lit(apart)) for apart in (False, True)]
    return got[0].unionByName(got[1]).select("claim_id", "apart", F.array_join("neighbours", ",").alias("neighbours"), F.array_join("echoes", "|").alias("echoes"))


def _judge(spark, sf_dir):
    j = project(spark, sf_dir, JUDGED)
    given = j.where("doc_id % 9 <> 0").select("claim_id", F.when(F.col("doc_id") % 10 == 1, "MAYBE").otherwise(F.col("verdict")).alias("verdict"), F.lit(" ok ").alias("reason"), F.lit(1).alias("seq"))
    again = j.where("doc_id % 8 = 3").select("claim_id", F.lit("SUPPORTED").alias("verdict"), F.lit("again").alias("reason"), F.lit(2).alias("seq"))
    return claims.apply_verdicts(j.drop("verdict"), given.union(again))


def claim_verdicts(spark, sf_dir):
    return _judge(spark, sf_dir).select("claim_id", "verdict", "judge_reason")


def claim_citations(spark, sf_dir):
    """The texts that claims cite, in their order, unknown ids left out."""
    ids = [F.concat(F.col("doc_id") + 1, F.lit("_0000")), F.concat("doc_id", F.lit("_0000")), F.concat("doc_id", F.lit("_none"))]  # the last is no chunk's, however many documents there are
    c = project(spark, sf_dir, JUDGED).select("claim_id", F.array(*ids).alias("cited_chunk_ids"))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_0000")).alias("chunk_id"), F.lit(None).cast("string").alias("section"), "text")
    got = claims.cited(c, docs).dropDuplicates(["claim_id"])  # a claim that is there twice has the texts of both
    sizes = F.filter(F.transform("citations", lambda x: F.length(x["chunk_text"])), lambda n: n.isNotNull())
    chars = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, n: s + n))
    return got.select("claim_id", F.size("citations").cast("bigint").alias("n"), F.array_join(F.transform("citations", lambda x: x["chunk_id"]), "|").alias("ids"), chars.alias("chars"))


def credibility_report(spark, sf_dir):
    return claims.report(project(spark, sf_dir, JUDGED)).withColumns({"unsupported_rate": _r(F.col("unsupported_rate")), "credibility": _r(F.col("credibility"))})


def verdict_distribution(spark, sf_dir):
    """Claims that are shown and those held back, as one bag."""
    j = project(spark, sf_dir, JUDGED)
    return evals.verdict_counts(j.where("verdict <> 'CONTRADICTED'"), j.where("verdict = 'CONTRADICTED'").drop("kind"))


def gate_decision(spark, sf_dir):
    j = project(spark, sf_dir, JUDGED).agg(claims.unsupported_rate(F.col("verdict")).alias("rate"), F.avg((F.col("n_chars") < 900).cast("double")).alias("boilerplate"))
    limits = spark.createDataFrame([(0.0, 1, 0), (-1.0, 0, 1), (-1.0, 0, 0), (-1.0, 2, 2)], "shift double, wrong int, crashes int")
    return j.crossJoin(limits).select("shift", "wrong", "crashes", evals.gate(F.col("rate") + F.col("shift"), F.col("wrong"), F.col("crashes"), F.col("boilerplate")).alias("decision"))


def boilerplate_rate(spark, sf_dir):
    return project(spark, sf_dir, JUDGED).groupBy("kind").agg(_r(F.avg((F.col("n_chars") < 900).cast("double"))).alias("rate"))


def smoke_score(spark, sf_dir):
    j = project(spark, sf_dir, JUDGED).select("query_id", (F.col("doc_id") % 13 == 0).alias("error"), (F.col("doc_id") % 11 == 0).alias("skipped"), (F.col("doc_id") % 2 == 0).alias("retrieval_hit"), (F.col("doc_id") % 5).alias("n_claims"), (F.col("verdict") != "SUPPORTED").cast("bigint").alias("n_unsupported"))
    return evals.smoke_score(j, "query_id").withColumns({"hit_rate": _r(F.col("hit_rate")), "unsupported_rate": _r(F.col("unsupported_rate"))})


def benchmark_summary(spark, sf_dir):
    j = project(spark, sf_dir, JUDGED).select(F.concat(F.lit("t"), F.col("doc_id") % 4).alias("question_type"), F.when(F.col("doc_id") % 17 == 0, "crash").when(F.col("verdict") == "SUPPORTED", "correct").when(F.col("verdict") == "CONTRADICTED", "incorrect").otherwise("abstain").alias("grade"))
    return evals.benchmark_summary(j)


def judge_agreement(spark, sf_dir):
    j = project(spark, sf_dir, JUDGED).select(F.col("verdict").alias("a"), F.when(F.col("doc_id") % 7 == 0, "SUPPORTED").otherwise(F.col("verdict")).alias("b"))
    return evals.agreement(j).withColumn("agreement", _r(F.col("agreement")))


def number_hit_rates(spark, sf_dir):
    """Mean number match and flagged claims by company."""
    c = project(spark, sf_dir, FIGURES)
    m = figures.number_match(figures.values(F.col("claim")), figures.values(F.col("evidence")))
    return c.groupBy("cik").agg(_r(F.avg(m)).alias("mean_match"), F.count_if(F.coalesce(m < 1, F.lit(False))).alias("flagged"))


def golden_checks(spark, sf_dir):
    """Cards against pinned substrings and filings."""
    c = project(spark, sf_dir, FIGURES).select(F.concat("cik", F.lit("-"), "y").alias("case_id"), F.when(F.col("cik") % 6 == 5, F.array().cast("array<string>")).otherwise(F.array("claim", "evidence")).alias("texts"), F.array(F.concat(F.lit("K-"), "y")).alias("accns"), F.array(F.lit("million to $"), F.when(F.col("cik") % 2 == 0, "revenue").otherwise("777,123")).alias("expected_substrings"), F.when(F.col("cik") % 3 == 0, "K-1998").alias("expected_accn"))
    return evals.golden_check(c)


def kpi_tiles(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES).select("cik", "y", presentation.tile(F.concat(F.lit("ACME net income FY"), "y", F.lit(": $"), "cik", F.when(F.col("y") % 2 == 0, F.concat(F.lit(".5B, +"), "cik", F.lit(".1% YoY (FY1: $2B)"))).otherwise("M"))).alias("t"))
    return c.select("cik", "y", "t.label", "t.fy", "t.value", "t.delta")


def best_sentence(spark, sf_dir):
    c = project(spark, sf_dir, FIGURES)
    return c.select("cik", "y", presentation.best_sentence(F.col("claim"), F.concat(F.lit("Nothing of note. "), "evidence", F.lit("! Company revenue moved again, by millions. Words without meaning?"))).alias("sentence"))


def visitor_ids(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select("user_id", presentation.visitor_id(F.concat(F.lit("10.0.0."), "user_id", F.lit(", 10.1.1.1")), "salt").alias("visitor"))


# --- logs

def llm_cost(spark, sf_dir):
    return evals.llm_cost(project(spark, sf_dir, LOG))


def longest_prefix_price(spark, sf_dir):
    return evals.priced(project(spark, sf_dir, LOG).select("model").distinct())


def queries_per_day(spark, sf_dir):
    return evals.queries_per_day(project(spark, sf_dir, LOG), 100)


def visitor_budget(spark, sf_dir):
    return evals.visitor_queries(project(spark, sf_dir, LOG)).withColumn("left", F.greatest(F.lit(0), 10 - F.col("queries")))


# --- matching and sets

def shingle_containment(spark, sf_dir):
    return matching.containment(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents").select("doc_id", "text"))


def shingle_suspects(spark, sf_dir):
    """Evidence found in no document."""
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id").join(shingle_containment(spark, sf_dir), "item_id", "left_anti")


def name_to_entity(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    titles = n.select(F.concat("n_name", F.lit(" Holdings-Inc.")).alias("title"), F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"))
    titles = titles.union(n.where("n_nationkey % 6 = 0").select(F.concat("n_name", F.lit(" Trust")), F.lpad((F.col("n_nationkey") + 100).cast("string"), 10, "0")))
    companies = n.select("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("https://x/CIK-"), F.lpad(F.col("n_nationkey").cast("string"), 10, "9"))).alias("link"), F.when(F.col("n_nationkey") % 7 == 0, "0000000042").alias("manual")).withColumnRenamed("n_name", "name")
    return matching.resolve_names(companies, titles)


def mentioned_company(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    nxt = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("ticker").alias("t1"))
    nx2 = n.select((F.col("n_nationkey") - 2).alias("n_nationkey"), F.col("ticker").alias("t2"))
    q = n.join(nxt, "n_nationkey").join(nx2, "n_nationkey").select(F.col("n_nationkey").alias("query_id"), "ticker", F.when(F.col("n_nationkey") % 4 == 0, F.array("ticker", "t1")).when(F.col("n_nationkey") % 4 == 1, F.array("t1", "t2")).when(F.col("n_nationkey") % 4 == 2, F.array(F.lit("NOWHERE"))).otherwise(F.array().cast("array<string>")).alias("mentions"))
    return matching.mentioned(q, n.where("n_nationkey % 3 = 0").select("ticker"), n.select("ticker"))


def history_last3(spark, sf_dir):
    return claims.last_turns(_table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def sample_deterministic(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where(F.length("text") >= 500).select("doc_id", "source")
    return evals.sample(d, "doc_id", "source", 3, "smoke")


def upsert_latest(spark, sf_dir):
    """A table written twice: in the second version some keys come twice in one write, and the later one stands."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    table = versions.Table(spark, f"{folder(spark)}/ledgerlens/upserted-{uuid.uuid4().hex}", ["doc_id"])
    table.upsert(d.withColumn("seq", F.lit(0)), "seq")
    some = d.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("old").alias("source"), F.lit(1).alias("seq")), F.struct(F.lit("new").alias("source"), F.lit(2).alias("seq")))).alias("x")).select("doc_id", "x.*")
    table.upsert(some, "seq")
    return table.read().select("doc_id", "source", F.col("seq").cast("bigint").alias("seq"))


def ingest_missing(spark, sf_dir):
    """What an interrupted run still has to take in: documents whose id is not there are added, the others stay as they are."""
    table = versions.Table(spark, f"{folder(spark)}/ledgerlens/taken-in-{uuid.uuid4().hex}", ["doc_id"])
    table.upsert(_table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source"), F.lit(0).alias("seq")), "seq")
    table.insert_absent(_table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("seq")), "seq")
    return table.read().select("doc_id", "source")


def replace_by_key(spark, sf_dir):
    """Facts are stored by company, then those of some companies are written again; their old rows are gone, others stay."""
    f = facts(spark, sf_dir).select("cik", "tag", "accn")
    path = f"{folder(spark)}/ledgerlens/replaced-{uuid.uuid4().hex}"
    sinks.replace_by_key(f, path, "cik")
    sinks.replace_by_key(f.where("cik % 5 = 0 and accn like 'K-%'"), path, "cik")
    return spark.read.parquet(path).select(F.col("cik").cast("bigint").alias("cik"), "tag", "accn")


def _cards(spark, sf_dir):
    p = stored_points(spark, sf_dir)
    cur = p.newest.where("metric in ('revenue', 'net_income')")
    prev = p.years.select("cik", "metric", (F.col("fy") + 1).alias("fy"), F.col("accn").alias("before"), "period_end")
    value = cur.select("cik", F.concat("metric", F.lit(":value")).alias("card_id"), F.lit("short").alias("text"), F.array(F.concat_ws("|", "accn", "tag", "fy")).alias("sources"), F.array("period_end").alias("source_ends"), F.lit(False).alias("fy_given"))
    grow = cur.join(prev.withColumnRenamed("period_end", "prior_end"), ["cik", "metric", "fy"]).select("cik", F.concat("metric", F.lit(":yoy")).alias("card_id"), F.lit("longer text").alias("text"), F.array(F.concat_ws("|", "accn", "tag", "fy"), F.concat_ws("|", "before", "tag", "fy")).alias("sources"), F.array("period_end", "prior_end").alias("source_ends"), F.lit(False).alias("fy_given"))
    old = p.years.where("metric = 'gross_profit' and fy = 1999").select("cik", F.lit("gross_profit:1999").alias("card_id"), F.lit("old").alias("text"), F.array(F.concat_ws("|", "accn", "tag", "fy")).alias("sources"), F.array("period_end").alias("source_ends"), (F.col("cik") % 2 == 0).alias("fy_given"))
    return p, value.union(grow).union(old)


def drop_stale_cards(spark, sf_dir):
    p, cards = _cards(spark, sf_dir)
    return claims.drop_stale(cards, p.newest.where("metric = 'revenue'")).select("cik", "card_id")


def subsume_cards(spark, sf_dir):
    _, cards = _cards(spark, sf_dir)
    return claims.subsume(cards.withColumn("query_id", F.col("cik"))).select("cik", "card_id")


_VALUE_RE = figures.VALUE.replace("'", "''")


def _values(text: str) -> str:
    scales = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in figures.SCALES.items())
    return f"""list_transform(list_filter(list_zip(regexp_extract_all({text}, '{_VALUE_RE}', 1), regexp_extract_all({text}, '{_VALUE_RE}', 2)),
    lambda x: length(regexp_replace(x[1], '\\D', '', 'g')) >= 3 AND NOT (coalesce(x[2], '') = '' AND NOT contains(x[1], ',') AND NOT contains(x[1], '.') AND CAST(replace(x[1], ',', '') AS DOUBLE) BETWEEN 1900 AND 2100)),
    lambda x: CAST(replace(x[1], ',', '') AS DOUBLE) * CASE lower(coalesce(x[2], '')) {scales} ELSE 1.0 END)"""


def _found(v: str, evidence: str) -> str:
    ladder = ", ".join(f"{k!r}::DOUBLE" for k in figures.LADDER)
    return f"len(list_filter({evidence}, lambda e: e <> 0 AND len(list_filter([{ladder}], lambda k: abs({v} * k - e) / abs(e) < 0.002)) > 0)) > 0"


def _words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in figures.STOPWORDS)
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-z]{{4,}}'), lambda w: lower(w))), lambda w: NOT list_contains([{stop}], w))"


_FIG = f"WITH fig AS ({as_sql(FIGURES)}), c AS (SELECT cik, y, claim, evidence, {_values('claim')} AS cv, {_values('evidence')} AS ev, {_words('claim')} AS cw, {_words('evidence')} AS ew FROM fig)\n"
_MATCH = f"CASE WHEN len(cv) > 0 THEN len(list_filter(cv, lambda v: {_found('v', 'ev')})) / len(cv) END"
_CH = figures.CHANGE.replace("'", "''")
_PART = lambda i: f"nullif(regexp_extract(claim, '{_CH}', {i}), '')"
_SC = lambda i: f"CASE lower(coalesce(regexp_extract(claim, '{_CH}', {i}), '')) WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'mn' THEN 1e6 ELSE 1 END"
_NUM = lambda i: f"CAST(replace({_PART(i)}, ',', '') AS DOUBLE) * {_SC(i + 1)}"
_ARITH = f"CASE WHEN {_NUM(1)} > 0 THEN abs(abs({_NUM(3)} - {_NUM(1)}) / ({_NUM(1)}) * 100 - CAST({_PART(5)} AS DOUBLE)) <= 1.5 END"
_J = f"WITH j AS ({as_sql(JUDGED)})\n"
_L = f"WITH log AS ({as_sql(LOG)})\n"
_BARE = " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + v.replace("'", "''") + "'" for k, v in chunking.BARE.items())
_ITEM = chunking.ITEM
_CHUNKS = f"""WITH RECURSIVE filings AS ({as_sql(FILINGS)}),
split AS (SELECT doc_id, ticker, corpus, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '' AND NOT regexp_matches(p, '\\S{{80,}}')) AS ps FROM filings),
paras AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS p FROM split),
lines AS (SELECT *, split_part(p, chr(10), 1) AS line FROM paras),
items AS (SELECT doc_id, k, p, line, CASE WHEN length(line) <= 150 AND regexp_matches(line, '{_ITEM}') THEN 'Item ' || upper(regexp_extract(line, '{_ITEM}', 1)) ||
  CASE WHEN regexp_replace(trim(regexp_extract(line, '{_ITEM}', 2)), '\\.+$', '') <> '' THEN '. ' || regexp_replace(trim(regexp_extract(line, '{_ITEM}', 2)), '\\.+$', '') ELSE '' END END AS label FROM lines),
labels AS (
  SELECT doc_id, 1 AS pass, k, p, label FROM items
  UNION ALL SELECT doc_id, 2, k, p, coalesce(label, CASE WHEN length(line) <= 150 THEN CASE replace(lower(regexp_replace(trim(line), '[.:]+$', '')), '’', '''') {_BARE} END END) FROM items),
cuts AS (SELECT doc_id, pass, k, j, substring(p, CAST(j * 2400 + 1 AS BIGINT), 2400) AS piece, CASE WHEN j = 0 THEN label END AS label FROM (SELECT *, unnest(range(0, (length(p) - 1) // 2400 + 1)) AS j FROM labels)),
pieces AS (SELECT doc_id, pass, row_number() OVER (PARTITION BY doc_id, pass ORDER BY k, j) AS i, piece, label FROM cuts),
st AS (
  SELECT doc_id, pass, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS buf, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS out_text, CAST(NULL AS VARCHAR) AS out_section FROM (SELECT DISTINCT doc_id, pass FROM pieces)
  UNION ALL
  SELECT s.doc_id, s.pass, p.i,
    CASE WHEN s.buf IS NULL OR p.label IS NOT NULL OR s.size + length(p.piece) > 1500 THEN p.piece ELSE s.buf || chr(10) || chr(10) || p.piece END,
    CASE WHEN s.buf IS NULL OR p.label IS NOT NULL OR s.size + length(p.piece) > 1500 THEN length(p.piece) ELSE s.size + length(p.piece) END,
    coalesce(p.label, s.section),
    CASE WHEN s.buf IS NOT NULL AND (p.label IS NOT NULL OR s.size + length(p.piece) > 1500) THEN s.buf END, s.section
  FROM st AS s JOIN pieces AS p ON p.doc_id = s.doc_id AND p.pass = s.pass AND p.i = s.i + 1),
outs AS (
  SELECT doc_id, pass, i, out_text AS text, out_section AS section FROM st WHERE out_text IS NOT NULL
  UNION ALL SELECT doc_id, pass, i + 1, buf, section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pass ORDER BY i DESC) AS back FROM st) WHERE back = 1 AND buf IS NOT NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pass ORDER BY i) - 1 AS ordinal FROM outs WHERE length(text) >= 200),
shares AS (SELECT doc_id, count(*) FILTER (pass = 1) AS n1, count(section) FILTER (pass = 1) AS l1, count(section) FILTER (pass = 2) AS l2 FROM kept GROUP BY doc_id),
chunks AS (
  SELECT k.doc_id, f.corpus, k.doc_id || '_' || lpad(CAST(k.ordinal AS VARCHAR), 4, '0') AS chunk_id, k.section, k.text FROM kept AS k JOIN shares AS s ON k.doc_id = s.doc_id JOIN filings AS f ON f.doc_id = k.doc_id
  WHERE k.pass = CASE WHEN s.n1 > 0 AND s.l1 < 0.3 * s.n1 AND s.l2 > s.l1 THEN 2 ELSE 1 END)
"""
_DIST = "round(list_cosine_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_TOPK = """SELECT CAST(q.vec_id * 1000{scope_id} AS BIGINT) AS query_id, v.vec_id, list_cosine_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings AS v, embeddings AS q WHERE q.vec_id % 50 = 0{extra}"""
_RANK = "SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place, distance FROM ({0}) QUALIFY place <= {1}"
_ALLQ = _TOPK.format(scope_id="", extra="")
_PRICED = """prices AS (SELECT * FROM (VALUES ('claude-sonnet', 3.0::DOUBLE, 15.0::DOUBLE), ('claude-haiku', 1.0, 5.0), ('claude-opus', 15.0, 75.0), ('gpt-5-mini', 0.25, 2.0), ('gpt-5', 1.25, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('gpt-4o', 2.5, 10.0)) AS t(prefix, price_in, price_out)), models AS (
  SELECT m.model, coalesce(p.price_in, 3.0) AS price_in, coalesce(p.price_out, 15.0) AS price_out FROM (SELECT DISTINCT model FROM log) AS m
  LEFT JOIN prices AS p ON starts_with(lower(regexp_replace(m.model, '^[^:]*:', '')), p.prefix) QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY length(p.prefix) DESC NULLS LAST) = 1)"""
_WORD = matching.WORD
_RUNS = f"""WITH ew AS (SELECT item_id, regexp_extract_all(text, '{_WORD}') AS w FROM benchmark),
er AS (SELECT item_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(0, len(w) - 7, CAST(greatest(1, (len(w) - 8) // 40) AS BIGINT)), lambda i: array_to_string(w[i + 1:i + 8], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM ew),
dw AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '{_WORD}'), ' ') AS all_words FROM documents),
met AS (SELECT DISTINCT item_id, doc_id FROM er JOIN dw ON contains(all_words, run))
"""
_REPORT = """SELECT query_id, count(*) FILTER (verdict <> 'CONTRADICTED') AS displayed, count(*) FILTER (verdict = 'NOT_ENOUGH_INFO') AS unverified, count(*) FILTER (verdict = 'CONTRADICTED') AS blocked,
  count(*) FILTER (kind = 'risk' AND verdict = 'SUPPORTED') AS risk_flags, round(avg(CASE WHEN verdict = 'SUPPORTED' THEN 0.0 ELSE 1.0 END), 6) AS unsupported_rate,
  round(avg(CASE verdict WHEN 'SUPPORTED' THEN 0.9::DOUBLE WHEN 'NOT_ENOUGH_INFO' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END), 6) AS credibility FROM j GROUP BY query_id"""
_CARDS = f"""WITH {BASE},
{POINTS},
cur AS (SELECT * FROM newest WHERE metric IN ('revenue', 'net_income')),
cards AS (
  SELECT cik, metric || ':value' AS card_id, 'short' AS text, [accn || '|' || tag || '|' || fy] AS sources, [period_end] AS source_ends, false AS fy_given FROM cur
  UNION ALL SELECT c.cik, c.metric || ':yoy', 'longer text', [c.accn || '|' || c.tag || '|' || c.fy, y.accn || '|' || c.tag || '|' || c.fy], [c.period_end, y.period_end], false FROM cur AS c JOIN years AS y ON y.cik = c.cik AND y.metric = c.metric AND y.fy = c.fy - 1
  UNION ALL SELECT cik, 'gross_profit:1999', 'old', [accn || '|' || tag || '|' || fy], [period_end], cik % 2 = 0 FROM years WHERE metric = 'gross_profit' AND fy = 1999)
"""

_EVIDENCE = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
met AS (SELECT a.doc_id, coalesce(bool_or(len(list_filter(a.w, lambda x: list_contains(b.w, x))) >= 0.6 * len(a.w) AND len(a.w) > 0), false) AS equivalent
  FROM d AS a LEFT JOIN d AS b ON b.doc_id = a.doc_id + 20 OR b.doc_id = a.doc_id + 40 OR (a.doc_id % 10 = 0 AND b.doc_id = a.doc_id) GROUP BY a.doc_id)
"""
_CARD = presentation.CARD
_TILE = "'ACME net income FY' || y || ': $' || cik || CASE WHEN y % 2 = 0 THEN '.5B, +' || cik || '.1% YoY (FY1: $2B)' ELSE 'M' END"
SQL = {
    "golden_checks": _FIG + """SELECT cik || '-' || y AS case_id, cik % 6 <> 5 AS answered, cik % 6 <> 5 AND contains(claim || ' ' || evidence, 'million to $') AND contains(claim || ' ' || evidence, CASE WHEN cik % 2 = 0 THEN 'revenue' ELSE '777,123' END) AS values_ok,
  cik % 3 <> 0 OR y = 1998 AS accn_ok, cik % 6 <> 5 AND contains(claim || ' ' || evidence, 'million to $') AND contains(claim || ' ' || evidence, CASE WHEN cik % 2 = 0 THEN 'revenue' ELSE '777,123' END) AND (cik % 3 <> 0 OR y = 1998) AS ok FROM c""",
    "kpi_tiles": _FIG + f"SELECT cik, y, regexp_extract({_TILE}, '{_CARD}', 1) AS label, CAST(regexp_extract({_TILE}, '{_CARD}', 2) AS INT) AS fy, trim(regexp_extract({_TILE}, '{_CARD}', 3)) AS value, nullif(regexp_extract({_TILE}, '{_CARD}', 4), '') AS delta FROM c",
    "best_sentence": _FIG.rstrip() + f""",
s AS (SELECT cik, y, cw, string_split(regexp_replace('Nothing of note. ' || evidence || '! Company revenue moved again, by millions. Words without meaning?', '([.!?。？！])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM c),
e AS (SELECT cik, y, cw, unnest(range(0, len(parts))) AS i, unnest(parts) AS p FROM s),
r AS (SELECT cik, y, i, p, CASE WHEN len(cw) >= 3 THEN len(list_filter(cw, lambda x: list_contains({_words('p')}, x))) / len(cw) ELSE 0 END AS score FROM e)
SELECT cik, y, CASE WHEN score >= 0.3 THEN p END AS sentence FROM r QUALIFY row_number() OVER (PARTITION BY cik, y ORDER BY score DESC, i) = 1""",
    "visitor_ids": "SELECT DISTINCT user_id, substring(sha256('salt:10.0.0.' || user_id), 1, 16) AS visitor FROM events",
    "chunk_pack": _CHUNKS + "SELECT chunk_id, section, length(text) AS n, md5(text) AS digest FROM chunks",
    "chunk_sections": _CHUNKS + "SELECT corpus, section, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY corpus, section",
    "chunk_noise": _CHUNKS + "SELECT doc_id, len(ps) AS paragraphs FROM split",
    "corpus_live": f"SELECT ticker, count(*) AS docs FROM ({as_sql(FILINGS)}) WHERE corpus = 'live' AND length(text) >= 500 GROUP BY ticker",
    "vector_topk": f"SELECT query_id, vec_id, place, round(distance, 6) AS distance FROM ({_RANK.format(_ALLQ, 6)})",
    "vector_topk_scoped": "SELECT query_id, vec_id, place, round(distance, 6) AS distance FROM (" + _RANK.format(_TOPK.format(scope_id=" + v.label", extra=""), 6) + ")",
    "refine_topup": f"""WITH r AS (SELECT query_id, 1 AS round, place, vec_id FROM ({_RANK.format(_ALLQ, 6)}) UNION ALL SELECT query_id, 2, place, vec_id FROM ({_RANK.format(_TOPK.format(scope_id='', extra='').replace('CAST(q.embedding AS DOUBLE[])', 'list_reverse(CAST(q.embedding AS DOUBLE[]))'), 3)})),
f AS (SELECT query_id, vec_id, min((CASE WHEN round = 2 THEN 0 ELSE round END) * 1000 + place) AS turn FROM r GROUP BY query_id, vec_id)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, vec_id) AS place FROM f QUALIFY place <= 6""",
    "claim_figures": _FIG + "SELECT cik, y, unnest(range(0, len(cv))) AS pos, unnest(cv) AS v FROM c",
    "claim_number_match": _FIG + f"SELECT cik, y, round({_MATCH}, 6) AS number_match FROM c",
    "claim_arithmetic": _FIG + f"SELECT cik, y, {_ARITH} AS arithmetic_ok FROM c",
    "claim_token_overlap": _FIG + "SELECT cik, y, CASE WHEN len(cw) >= 3 THEN round(len(list_filter(cw, lambda w: list_contains(ew, w))) / len(cw), 6) END AS token_overlap FROM c",
    "claim_check": _FIG + f"SELECT cik, y, coalesce({_MATCH} < 1.0, false) OR coalesce(NOT ({_ARITH}), false) AS flagged FROM c",
    "fact_rescue": _FIG.rstrip() + f",\n{BASE},\nvals AS (SELECT cik, list(DISTINCT CAST(val AS DOUBLE)) AS fv FROM facts GROUP BY cik)\nSELECT c.cik, c.cik || '-' || c.y AS claim_id FROM c JOIN vals ON vals.cik = c.cik WHERE len(cv) > 0 AND len(list_filter(cv, lambda v: {_found('v', 'fv')})) = len(cv)",
    "evidence_equivalent": _EVIDENCE + "SELECT doc_id, equivalent AS hit FROM met",
    "hit_types": _EVIDENCE + "SELECT CASE WHEN doc_id % 10 = 0 THEN 'exact' WHEN equivalent THEN 'equivalent' ELSE 'none' END AS hit_type, count(*) AS n FROM met GROUP BY 1",
    "risk_phrase": f"SELECT doc_id, phrase FROM (SELECT doc_id, regexp_extract(text, '{figures.REALIZED}', 0) AS phrase FROM ({as_sql(FILINGS)})) WHERE phrase <> ''",
    "risk_echo_sections": f"""WITH v AS (SELECT vec_id, {_SECTION} AS section, lower(trim(coalesce({_SECTION}, ''))) AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
met AS (SELECT q.vec_id AS claim_id, v.vec_id, v.section, v.key, q.key AS cited, list_cosine_distance(v.e, q.e) AS distance FROM v, v AS q WHERE q.vec_id % 50 = 0),
near AS (SELECT *, false AS apart, row_number() OVER (PARTITION BY claim_id ORDER BY distance, vec_id) AS place FROM met
  UNION ALL SELECT *, true, row_number() OVER (PARTITION BY claim_id ORDER BY distance, vec_id) FROM met WHERE key <> '' AND key <> cited)
SELECT claim_id, apart, string_agg(vec_id, ',' ORDER BY place) AS neighbours, array_to_string(coalesce(list_sort(list(DISTINCT trim(section)) FILTER (key <> '' AND key <> cited)), [])[1:3], '|') AS echoes FROM near WHERE place <= 5 GROUP BY claim_id, apart""",
    "claim_verdicts": _J
    + """SELECT claim_id, CASE WHEN doc_id % 8 = 3 THEN 'SUPPORTED' WHEN doc_id % 9 = 0 OR doc_id % 10 = 1 THEN 'NOT_ENOUGH_INFO' ELSE verdict END AS verdict,
  CASE WHEN doc_id % 8 = 3 THEN 'again' WHEN doc_id % 9 = 0 THEN 'no verdict' WHEN doc_id % 10 = 1 THEN 'invalid verdict' ELSE 'ok' END AS judge_reason FROM j""",
    "claim_citations": _J
    + """SELECT j.claim_id, count(d.doc_id) AS n, string_agg(d.doc_id || '_0000', '|' ORDER BY o.pos) AS ids, CAST(sum(length(d.text)) AS BIGINT) AS chars
FROM j CROSS JOIN (VALUES (0, 1), (1, 0)) AS o(pos, off) JOIN documents AS d ON d.doc_id = j.doc_id + o.off GROUP BY j.claim_id""",
    "credibility_report": _J + _REPORT,
    "verdict_distribution": _J + "SELECT verdict, count(*) AS n FROM j GROUP BY verdict",
    "gate_decision": _J
    + """SELECT s.shift, s.wrong, s.crashes, CASE WHEN rate + s.shift > 0.04 THEN 'unsupported' WHEN s.wrong > 0 THEN 'numeric' WHEN s.crashes > 0 THEN 'crash' WHEN boilerplate > 0.25 THEN 'boilerplate' ELSE 'pass' END AS decision
FROM (SELECT avg(CASE WHEN verdict = 'SUPPORTED' THEN 0.0 ELSE 1.0 END) AS rate, avg(CASE WHEN n_chars < 900 THEN 1.0 ELSE 0.0 END) AS boilerplate FROM j), (VALUES (0.0::DOUBLE, 1, 0), (-1.0::DOUBLE, 0, 1), (-1.0::DOUBLE, 0, 0), (-1.0::DOUBLE, 2, 2)) AS s(shift, wrong, crashes)""",
    "boilerplate_rate": _J + "SELECT kind, round(avg(CASE WHEN n_chars < 900 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM j GROUP BY kind",
    "smoke_score": _J
    + """SELECT query_id, count(*) AS n_questions, count(*) FILTER (doc_id % 13 = 0) AS n_crashed, count(*) FILTER (ok) AS n_scored, count(*) FILTER (ok AND doc_id % 2 = 0) AS retrieval_hits,
  CAST(coalesce(sum(doc_id % 5) FILTER (ok), 0) AS BIGINT) AS total_claims, count(*) FILTER (ok AND verdict <> 'SUPPORTED') AS unsupported_claims,
  round(coalesce(count(*) FILTER (ok AND doc_id % 2 = 0) / nullif(count(*) FILTER (ok), 0), 0), 6) AS hit_rate,
  round(coalesce(count(*) FILTER (ok AND verdict <> 'SUPPORTED') / nullif(sum(doc_id % 5) FILTER (ok), 0), 0), 6) AS unsupported_rate,
  count(*) FILTER (ok) > 0 AND count(*) FILTER (doc_id % 13 = 0) = 0 AND coalesce(count(*) FILTER (ok AND verdict <> 'SUPPORTED') / nullif(sum(doc_id % 5) FILTER (ok), 0), 0) <= 0.04 AS passed
FROM (SELECT *, doc_id % 13 <> 0 AND doc_id % 11 <> 0 AS ok FROM j) GROUP BY query_id""",
    "benchmark_summary": _J
    + """SELECT question_type, count(*) AS total, count(*) FILTER (grade = 'correct') AS correct, count(*) FILTER (grade = 'incorrect') AS incorrect, count(*) FILTER (grade = 'abstain') AS abstain, count(*) FILTER (grade = 'crash') AS crash,
  round(count(*) FILTER (grade = 'correct') / count(*), 3) AS accuracy, round(coalesce(count(*) FILTER (grade = 'correct') / nullif(count(*) FILTER (grade IN ('correct', 'incorrect')), 0), 0), 3) AS answered_accuracy, round(count(*) FILTER (grade = 'incorrect') / count(*), 3) AS hallucination_rate
FROM (SELECT 't' || (doc_id % 4) AS question_type, CASE WHEN doc_id % 17 = 0 THEN 'crash' WHEN verdict = 'SUPPORTED' THEN 'correct' WHEN verdict = 'CONTRADICTED' THEN 'incorrect' ELSE 'abstain' END AS grade FROM j) GROUP BY ROLLUP (question_type)""",
    "judge_agreement": _J + "SELECT count(*) AS n, round(avg(CASE WHEN doc_id % 7 <> 0 OR verdict = 'SUPPORTED' THEN 1.0 ELSE 0.0 END), 6) AS agreement, avg(CASE WHEN doc_id % 7 <> 0 OR verdict = 'SUPPORTED' THEN 1.0 ELSE 0.0 END) >= 0.85 AS passed FROM j",
    "number_hit_rates": _FIG + f"SELECT cik, round(avg({_MATCH}), 6) AS mean_match, count(*) FILTER ({_MATCH} < 1) AS flagged FROM c GROUP BY cik",
    "llm_cost": _L + f", {_PRICED}\nSELECT CAST(ts AS DATE) AS day, stage, log.model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(round(CAST((sum(input_tokens) * any_value(price_in) + sum(output_tokens) * any_value(price_out)) / 1e6 AS DECIMAL(28,8)), 4) AS DOUBLE) AS est_cost_usd FROM log JOIN models ON models.model IS NOT DISTINCT FROM log.model WHERE event = 'llm_call' GROUP BY 1, 2, 3",
    "longest_prefix_price": _L + f", {_PRICED}\nSELECT * FROM models",
    "queries_per_day": _L + "SELECT CAST(ts AS DATE) AS day, count(*) AS queries, greatest(0, 100 - count(*)) AS budget_left FROM log WHERE event = 'query_received' AND NOT regexp_matches(query_id, '^(eval|fb_|smoke_)') GROUP BY 1",
    "visitor_budget": _L + "SELECT CAST(ts AS DATE) AS day, visitor, count(*) AS queries, greatest(0, 10 - count(*)) AS \"left\" FROM log WHERE event = 'visitor_query' GROUP BY 1, 2",
    "shingle_containment": _RUNS + "SELECT * FROM met",
    "shingle_suspects": _RUNS + "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM met)",
    "name_to_entity": """WITH titles AS (SELECT n_name || ' Holdings-Inc.' AS title, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik FROM nation UNION ALL SELECT n_name || ' Trust', lpad(CAST(n_nationkey + 100 AS VARCHAR), 10, '0') FROM nation WHERE n_nationkey % 6 = 0),
norm AS (SELECT trim(regexp_replace(lower(replace(title, '-', ' ')), '[^a-z0-9 ]', '', 'g')) AS t, cik FROM titles)
SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 10, '9') WHEN n_nationkey % 7 = 0 THEN '0000000042' ELSE
  (SELECT CASE WHEN count(DISTINCT cik) = 1 THEN min(cik) END FROM norm WHERE t = trim(regexp_replace(lower(replace(n_name, '-', ' ')), '[^a-z0-9 ]', '', 'g')) OR starts_with(t, trim(regexp_replace(lower(replace(n_name, '-', ' ')), '[^a-z0-9 ]', '', 'g')) || ' ')) END AS cik FROM nation""",
    "mentioned_company": """SELECT CAST(a.n_nationkey AS INT) AS query_id, CASE WHEN a.n_nationkey % 4 <> 1 THEN a.n_name WHEN b.n_nationkey % 3 = 0 THEN b.n_name WHEN c.n_nationkey % 3 = 0 THEN c.n_name ELSE a.n_name END AS ticker,
  CASE WHEN a.n_nationkey % 4 = 1 AND b.n_nationkey % 3 <> 0 AND c.n_nationkey % 3 <> 0 THEN b.n_name END AS needs_onboarding
FROM nation AS a JOIN nation AS b ON b.n_nationkey = a.n_nationkey + 1 JOIN nation AS c ON c.n_nationkey = a.n_nationkey + 2""",
    "history_last3": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "sample_deterministic": "SELECT doc_id, source FROM documents WHERE length(text) >= 500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('smoke' || doc_id), doc_id) <= 3",
    "upsert_latest": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE max(source) END AS source, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS seq FROM documents GROUP BY doc_id",
    "ingest_missing": "SELECT DISTINCT doc_id, 'labelled' AS source FROM labels UNION ALL SELECT doc_id, min(source) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id",
    "replace_by_key": f"WITH {BASE}\nSELECT cik, tag, accn FROM facts WHERE cik % 5 <> 0 OR accn LIKE 'K-%'",
    "drop_stale_cards": _CARDS + "SELECT c.cik, c.card_id FROM cards AS c LEFT JOIN newest AS a ON a.cik = c.cik AND a.metric = 'revenue' WHERE fy_given OR a.fy IS NULL OR list_max(list_transform(source_ends, lambda d: year(d))) >= a.fy",
    "subsume_cards": _CARDS
    + """SELECT cik, card_id FROM cards AS a WHERE NOT EXISTS (SELECT 1 FROM cards AS b WHERE b.cik = a.cik AND b.card_id <> a.card_id AND len(list_filter(a.sources, lambda s: NOT list_contains(b.sources, s))) = 0
  AND (len(list_filter(b.sources, lambda s: NOT list_contains(a.sources, s))) > 0 OR length(a.text) < length(b.text) OR (length(a.text) = length(b.text) AND a.card_id < b.card_id)))""",
}

_FUNCTIONS = (
    chunk_pack, chunk_sections, chunk_noise, corpus_live, vector_topk, vector_topk_scoped, vector_mmr, refine_topup, claim_figures, claim_number_match, claim_arithmetic, claim_token_overlap,
    claim_check, fact_rescue, evidence_equivalent, hit_types, risk_phrase, risk_echo_sections, claim_verdicts, claim_citations, credibility_report, verdict_distribution, gate_decision, boilerplate_rate,
    smoke_score, benchmark_summary, judge_agreement, number_hit_rates, llm_cost, longest_prefix_price, queries_per_day, visitor_budget, shingle_containment, shingle_suspects, name_to_entity,
    mentioned_company, history_last3, sample_deterministic, upsert_latest, ingest_missing, replace_by_key, drop_stale_cards, subsume_cards, golden_checks, kpi_tiles, best_sentence, visitor_ids,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
