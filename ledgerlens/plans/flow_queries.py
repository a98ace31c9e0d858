"""Queries of the answer flow, from questions to chunks found by vectors, claims and digests, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import payloads, presentation
from ledgerlens.operators import evals, search
from ledgerlens.operators import claims as cl
from ledgerlens.plans import answers, digest, planner
from ledgerlens.plans.numeric_queries import facts, stored_points
from ledgerlens.plans.plan_queries import PANEL_CARDS
from ledgerlens.plans.projection import ANSWERS, JUDGED, KINDS, LOG, as_sql, project
from ledgerlens.sources.staging import folder, ingested, kept
from ledgerlens.streaming import events

EMBED = search.HashedWords()


class Stepped(answers.RuleProvider):
    """Goes by the number in the question: gives up, expands once or always, or rewrites; every third one is wrong at first, every sixth always."""

    OTHER = "the and of in der die la que"

    def _n(self, question: str) -> int:
        return int(re.search(r"\d+", question)[0])

    def assess(self, question, previews):
        step = self._n(question) % 4
        if step == 1:
            return {"decision": "expand" if len(previews) <= 6 else "ENOUGH"}
        return {"decision": ("GIVE_UP", None, "REWRITE", "EXPAND")[step], "new_query": self.OTHER if step == 2 else None}

    def generate(self, question, chunks, feedback="", figures=""):
        n = self._n(question)
        wrong = n % 3 == 0 and (not feedback or n % 6 == 0)
        return [{**c, "text": ("Not so: " if wrong else "") + c["text"]} for c in super().generate(question, chunks)]

    def verify(self, claims):
        return [{"claim_id": c["claim_id"], "verdict": "CONTRADICTED" if c["text"].startswith("Not so: ") else "SUPPORTED", "reason": "read"} for c in claims]


class Flaky(answers.RuleProvider):
    """Unreadable when asked for profit, for some companies twice; down for some when asked what management stresses."""

    def generate(self, question, chunks, feedback="", figures=""):
        first = int(chunks[0][0])
        if "profit" in question and (not feedback or first % 5 == 0):
            raise digest.Unusable("no claims")
        if "management" in question and first % 3 == 0:
            raise RuntimeError("API down")
        return super().generate(question, chunks)


def _companies(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cik"), F.col("n_name").alias("ticker"))


def _index(spark, sf_dir):
    """Every document is a chunk of one company, with its vector; made once in a session."""

    def make():
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(F.broadcast(_companies(spark, sf_dir)), F.col("doc_id") % 25 == F.col("cik"))  # 25 rows
        chunk = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "ticker", F.lit(None).cast("string").alias("section"), F.lit("live").alias("corpus"), F.coalesce("text", F.lit("")).alias("text"))
        return search.index(chunk, EMBED, EMBED.model)

    return ingested(spark, sf_dir, "text-index", make)


def retriever(spark, sf_dir, questions):
    """Search over the documents as chunks, for ``questions`` (query_id, ticker, question)."""
    return search.retriever(_index(spark, sf_dir), questions.select("query_id", "ticker", answers.is_coverage(F.col("question")).alias("coverage")), EMBED, EMBED.model)


def retrieved_texts(spark, sf_dir):
    """Six chunks of each company for a question of its own, found by vectors of words."""
    asked = _companies(spark, sf_dir).select(F.col("cik").cast("string").alias("query_id"), "ticker", F.concat(F.lit("What of the and in on "), F.col("cik"), F.lit(" der und la que?")).alias("question"))
    got = retriever(spark, sf_dir, asked)(asked.select("query_id", F.col("question").alias("query"), F.lit(6).alias("k")))
    return got.select("query_id", F.col("place").cast("bigint").alias("place"), "chunk_id", F.length("text").cast("bigint").alias("n_chars"))


def answer_rounds(spark, sf_dir):
    """How each question fared: its rounds and what was decided after each, the last query and k, the chunks, and its claims after one or two tries."""
    asked = _companies(spark, sf_dir).select(F.col("cik").cast("string").alias("query_id"), "ticker", F.concat(F.lit("Question "), F.col("cik"), F.lit(": what is said of the and der la?")).alias("question"))
    provider = Stepped()
    hits, rounds = answers.refinement(asked.withColumn("k", answers.asked_k(F.col("question"))), retriever(spark, sf_dir, asked), provider)
    chunks = kept(answers.chosen(hits), "chunks")
    judged = answers.judged(asked, chunks, provider)
    trace = rounds.groupBy("query_id").agg(
        F.max("round").cast("bigint").alias("rounds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("decision").isNotNull(), F.struct("round", "decision")))), lambda x: F.upper(x["decision"])), ",").alias("decisions"),
        F.max_by("k", "round").cast("bigint").alias("k"),
        F.max_by("query", "round").alias("query"),
    )
    found = chunks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("chunk_ids"))
    tries = judged.groupBy("query_id").agg(F.max(F.when(F.col("claim_id").contains("r_claim"), 2).otherwise(1)).cast("bigint").alias("tries"))
    report = cl.report(judged).select("query_id", "displayed", "blocked")
    return trace.join(found, "query_id").join(tries, "query_id").join(report, "query_id")


def digest_report(spark, sf_dir):
    """Every company's digest, by a provider that fails now and then: figures, the four sections in order with their attempts and errors, and the summary."""
    companies = _companies(spark, sf_dir)
    about = digest.tasks(companies).select("query_id", "ticker", "question")
    parts = kept(digest.sections(companies, retriever(spark, sf_dir, about), Flaky()), "parts")
    asked = digest.figure_queries(companies)
    cards = planner.execute(asked.drop("place"), stored_points(spark, sf_dir), facts(spark, sf_dir)).join(asked.select("query_id", "ticker", "place"), "query_id")
    got = digest.digest(companies, parts, cards.select("ticker", "place", "text"))
    line = F.transform("sections", lambda s: F.concat_ws(":", s["key"], s["attempt"], s["displayed"], F.coalesce(s["error"], F.lit("ok"))))
    return got.select("ticker", F.array_join("figures", "; ").alias("figures"), F.array_join(line, "; ").alias("sections"), "sections_ok", "sections_failed", "summary")


class Wavering(answers.RuleProvider):
    """A pipeline that is down for some questions, answers others only when asked again, some with nothing and some wrongly."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, question: str) -> str:
        n = len(question)
        if n % 7 == 0:
            raise RuntimeError("down")
        if n % 5 == 0 and question not in self.asked:
            self.asked.add(question)
            raise TimeoutError("slow")
        return "" if n % 3 == 0 else question if n % 2 else "nothing of the kind"


def graded_cases(spark, sf_dir):
    """Every benchmark question answered in at most two attempts and graded; a case that crashes twice is a row like others, with its error."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    provider = Wavering()
    got = answers.run_cases(items.select("item_id", F.col("text").alias("question"), F.substring_index("text", " ", 3).alias("expected")), provider, provider)
    return got.select("item_id", "outcome.grade", "outcome.error", F.col("outcome.attempts").cast("bigint").alias("attempts"), F.md5("outcome.model_answer").alias("answer"))


def graded_summary(spark, sf_dir):
    """The summary of those cases, crashes counted."""
    return evals.benchmark_summary(graded_cases(spark, sf_dir).select(F.concat(F.lit("t"), F.col("item_id") % 3).alias("question_type"), "grade"))


class Short(answers.RuleProvider):
    def boilerplate(self, texts):
        return [len(t) % 3 == 0 for t in texts]


def boilerplate_batches(spark, sf_dir):
    """The calls that turns of conversations are flagged in: sixty texts each, all but the last, whatever partitions they came in."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    claims = turns.select(F.format_string("%012d-%06d", "conv_id", "turn").alias("claim_id"), "conv_id", F.coalesce("text", F.lit("")).alias("text"))
    got = answers.boilerplate(claims, Short())
    return got.groupBy("batch").agg(F.count("*").alias("texts"), F.count_if("boilerplate").alias("flagged"), F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))


def prompt_texts(spark, sf_dir):
    """What a writer, a judge and a grader are given: a query's chunks, its claims with their evidence, and its report as one text. A document is a chunk."""
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Item "), F.col("doc_id") % 3)).alias("section"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    said = project(spark, sf_dir, JUDGED).select("query_id", "claim_id", "doc_id", "verdict", F.concat(F.lit("Claim on "), "doc_id").alias("text"), F.array((F.col("doc_id") + 2).cast("string"), F.col("doc_id").cast("string"), F.concat(F.lit("none "), "doc_id")).alias("cited_chunk_ids"))
    met = cl.cited(said.where("doc_id % 6 > 0"), chunks).unionByName(said.where("doc_id % 6 = 0"), allowMissingColumns=True)
    shown = F.col("verdict") != "CONTRADICTED"
    of = met.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("claim_id", "text", "citations"))).alias("claims"),
        F.array_sort(F.collect_list(F.when(shown, F.struct("claim_id", "text", (F.col("verdict") == "NOT_ENOUGH_INFO").alias("unverified"))))).alias("shown"),
    )
    own = said.select("query_id", F.col("doc_id").cast("string").alias("chunk_id")).join(chunks, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "chunk_id", "section", "text"))).alias("chunks"))
    return of.join(own, "query_id").select(
        "query_id",
        F.md5(presentation.chunk_prompt(F.col("chunks"))).alias("chunks"),
        F.md5(presentation.judge_prompt(F.col("claims"))).alias("judged"),
        presentation.composed(F.when(F.col("query_id") != "Q1", F.concat(F.lit("On "), "query_id")), F.col("shown"), F.array(F.concat(F.lit("card of "), "query_id"))).alias("composed"),
    )


# --- the event log as a stream, in two runs of one checkpoint

def _two_runs(log, more, at, make):
    """``make`` of a stream over ``log``: half of it is there in the first run, the rest and ``more`` come before the second."""
    half = F.to_date("ts") <= F.lit("2024-01-15").cast("date")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    for part in (log.where(half), log.where(~half).unionByName(more)):
        part.write.mode("append").json(f"{at}/log")
        stream = events.tail(log.sparkSession, f"{at}/log", schema, files_per_trigger=100_000)
        events.to_batches(make(stream), f"{at}/out", f"{at}/checkpoint").awaitTermination()


def progress_stream(spark, sf_dir):
    """What a reader is told of the evaluations' stages, each once, though the log was read in two runs."""
    at = f"{folder(spark)}/ledgerlens/progress-{uuid.uuid4().hex}"
    log = project(spark, sf_dir, LOG).select(F.col("ts").cast("timestamp").alias("ts"), "event", F.concat(F.regexp_extract("query_id", "^[a-z]+_?", 0), "visitor").alias("query_id"), "stage")
    _two_runs(log, log.where("stage = 'route'"), at, lambda tail: events.progress(tail, "eval_", "3000 days"))
    return spark.read.parquet(f"{at}/out").select("query_id", "stage", "label")


def session_stream(spark, sf_dir):
    """Visitors' sessions, by session windows over the log in two runs: one that is open when the first run ends goes on in the second."""
    at = f"{folder(spark)}/ledgerlens/sessions-{uuid.uuid4().hex}"
    log = project(spark, sf_dir, LOG).select(F.col("ts").cast("timestamp").alias("ts"), F.col("visitor").cast("string").alias("visitor"))
    end = spark.sql("SELECT timestamp '2100-01-01' AS ts, 'end' AS visitor")
    _two_runs(log, end, at, lambda tail: events.sessions(tail, gap="6 hours", late="12 hours"))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(f"{at}/out").select("visitor", moment("start").alias("start"), moment("last").alias("last"), "n")


def payload_answers(spark, sf_dir):
    """What is saved of an answer in each of the shapes that it comes in; null if it cannot be used."""
    got = project(spark, sf_dir, ANSWERS).select("conv_id", "turn", payloads.answer(F.col("raw")).alias("a"))
    line = F.transform("a.claims", lambda c: F.concat_ws("|", c["text"], F.array_join(c["cited_chunk_ids"], ","), c["kind"]))
    return got.select("conv_id", "turn", F.col("a").isNotNull().alias("usable"), F.col("a.summary").alias("summary"), F.md5(F.array_join(line, ";")).alias("claims"))


def payload_kinds(spark, sf_dir):
    """What is saved of verdicts, assessments, routes and questions."""
    got = project(spark, sf_dir, KINDS).select(
        "conv_id", "turn", payloads.verdicts(F.col("verdicts")).alias("v"), payloads.assessment(F.col("assessment")).alias("a"), payloads.route(F.col("route")).alias("r"), payloads.questions(F.col("items")).alias("i")
    )
    return got.select(
        "conv_id", "turn",
        F.array_join(F.transform("v", lambda x: F.concat_ws("|", x["claim_id"], x["verdict"], F.md5(x["reason"]))), ";").alias("verdicts"),
        F.concat_ws("|", "a.decision", F.md5("a.new_query"), "a.reason").alias("assessment"),
        F.col("r.route").alias("route"),
        F.array_join(F.transform("r.queries", lambda q: F.concat_ws("|", q["op"], q["metric"], F.coalesce(q["fy"].cast("string"), F.lit("-")), F.coalesce(q["years"].cast("string"), F.lit("-")), F.array_join(q["tickers"], ","))), ";").alias("queries"),
        F.array_join("r.companies", ",").alias("companies"), F.col("r.refusal").alias("refusal"), F.col("r.fully_answers").alias("fully_answers"),
        F.array_join(F.transform("i", lambda x: F.concat_ws("|", x["chunk_id"], F.md5(x["question"]))), ";").alias("questions"),
    )


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: From ``q`` (id, scope, t) and ``docs`` (id, scope, t) to ``ranked``: every document of the scope by its vector's distance from the question's.
VECTORS = f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_name AS scope, coalesce(text, '') AS t FROM documents JOIN nation ON n_nationkey = doc_id % 25),
texts AS (SELECT 'd' || id AS id, t FROM docs UNION ALL SELECT 'q' || id, t FROM q),
hashed AS (SELECT id, CAST('0x' || substr(m, 1, 4) AS INTEGER) % 64 AS d, CASE WHEN substr(m, 5, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM (SELECT id, md5(unnest(regexp_extract_all(translate(t, {_ABC}), '[a-z0-9]+'))) AS m FROM texts)),
sums AS (SELECT id, d, CAST(sum(s) AS DOUBLE) AS x FROM hashed GROUP BY id, d),
norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY id HAVING sum(x * x) > 0),
vecs AS (SELECT n.id, list(CAST(CAST(coalesce(s.x, 0) / n.norm AS FLOAT) AS DOUBLE) ORDER BY r.i) AS e FROM norms AS n CROSS JOIN range(64) AS r(i) LEFT JOIN sums AS s ON s.id = n.id AND s.d = r.i GROUP BY n.id),
near AS (SELECT q.id AS qid, q.t AS question, d.id AS doc, d.t, dv.e, round(list_cosine_distance(dv.e, qv.e), 12) AS distance FROM q JOIN vecs AS qv ON qv.id = 'q' || q.id JOIN docs AS d ON d.scope = q.scope JOIN vecs AS dv ON dv.id = 'd' || d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc) AS place, regexp_matches(question, '{answers.COVERAGE}') AS wide FROM near)"""
#: And to ``picks``, the first three chunks: the nearest ones, or for coverage questions with over twelve chunks by relevance and unlikeness.
PICKS = (
    VECTORS
    + """,
pool AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM ranked WHERE place <= CASE WHEN wide THEN 36 ELSE 6 END),
p1 AS (SELECT * FROM pool WHERE place = 1),
p2 AS (SELECT c.* FROM pool AS c JOIN p1 ON p1.qid = c.qid WHERE c.place <> 1
  QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY CASE WHEN c.wide AND c.n > 12 THEN 0.3 * list_cosine_similarity(c.e, p1.e) - 0.7 * (1 - c.distance) END, c.place) = 1),
p3 AS (SELECT c.* FROM pool AS c JOIN p1 ON p1.qid = c.qid JOIN p2 ON p2.qid = c.qid WHERE c.place NOT IN (1, p2.place)
  QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY CASE WHEN c.wide AND c.n > 12 THEN 0.3 * greatest(list_cosine_similarity(c.e, p1.e), list_cosine_similarity(c.e, p2.e)) - 0.7 * (1 - c.distance) END, c.place) = 1),
picks AS (SELECT qid, doc, i, substr(split_part(t, '. ', 1), 1, 200) AS said FROM (SELECT *, 1 AS i FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3))"""
)
_PLAN = ", ".join(f"({i}, '{k}', '{t}', '{q.replace(chr(39), chr(39) * 2)}')" for i, (k, t, q) in enumerate(digest.SECTIONS))

SQL = {
    "retrieved_texts": f"WITH q AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS scope, 'What of the and in on ' || n_nationkey || ' der und la que?' AS t FROM nation),\n{VECTORS}\nSELECT qid AS query_id, place, doc AS chunk_id, length(t) AS n_chars FROM ranked WHERE place <= 6",
    "answer_rounds": f"""WITH a AS (SELECT n_nationkey AS n, n_name AS scope, 'Question ' || n_nationkey || ': what is said of the and der la?' AS question, (SELECT count(*) FROM documents WHERE doc_id % 25 = n_nationkey) AS docs FROM nation),
q AS (SELECT CAST(n AS VARCHAR) AS id, scope, CASE WHEN n % 4 = 2 THEN '{Stepped.OTHER}' ELSE question END AS t FROM a),
{VECTORS},
went AS (SELECT *, CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 AND docs > 6 THEN 2 ELSE 3 END AS rounds, CASE WHEN n % 4 IN (0, 2) THEN 6 WHEN n % 4 = 1 AND docs > 6 THEN 12 ELSE 24 END AS k FROM a)
SELECT r.qid AS query_id, any_value(w.rounds) AS rounds, any_value(CASE w.n % 4 WHEN 0 THEN 'GIVE_UP' WHEN 1 THEN CASE WHEN w.docs > 6 THEN 'EXPAND,ENOUGH' ELSE 'EXPAND,EXPAND' END WHEN 2 THEN 'REWRITE,REWRITE' ELSE 'EXPAND,EXPAND' END) AS decisions, any_value(w.k) AS k, any_value(r.question) AS query,
  string_agg(r.doc, ',' ORDER BY r.place) AS chunk_ids, any_value(CASE WHEN w.n % 3 = 0 THEN 2 ELSE 1 END) AS tries, any_value(CASE WHEN w.n % 6 = 0 THEN 0 ELSE least(3, w.docs) END) AS displayed, any_value(CASE WHEN w.n % 6 = 0 THEN least(3, w.docs) ELSE 0 END) AS blocked
FROM ranked AS r JOIN went AS w ON CAST(w.n AS VARCHAR) = r.qid WHERE r.place <= w.k GROUP BY r.qid""",
    "digest_report": PANEL_CARDS
    + f""",
plan AS (SELECT * FROM (VALUES {_PLAN}) AS t(place, key, title, question)),
q AS (SELECT n_name || ' ' || place AS id, n_name AS scope, question AS t FROM nation, plan),
{PICKS},
told AS (SELECT qid, CAST(max(doc) FILTER (i = 1) AS BIGINT) AS first, count(*) AS n, array_to_string(list(said ORDER BY i), ' ') AS said FROM picks GROUP BY qid),
tasks AS (SELECT n_name AS ticker, p.place, p.key, p.title, CASE WHEN p.place = 1 AND t.n > 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN p.place = 1 AND t.first % 5 = 0 THEN 'Unusable: no claims' WHEN p.place = 3 AND t.first % 3 = 0 THEN 'RuntimeError: API down' END AS error, coalesce(t.n, 0) AS n, t.said
  FROM nation CROSS JOIN plan AS p LEFT JOIN told AS t ON t.qid = n_name || ' ' || p.place),
parts AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN n = 0 THEN '{answers.UNANSWERED}' ELSE said END AS summary FROM tasks),
company AS (SELECT ticker, string_agg(key || ':' || attempt || ':' || CASE WHEN error IS NULL THEN n ELSE 0 END || ':' || coalesce(error, 'ok'), '; ' ORDER BY place) AS sections, count(*) FILTER (error IS NULL) AS sections_ok, count(*) FILTER (error IS NOT NULL) AS sections_failed,
  list(title || ': ' || substr(summary, 1, 200) ORDER BY place) FILTER (coalesce(summary, '') <> '') AS said FROM parts GROUP BY ticker),
lines AS (SELECT n.name AS ticker, list(text ORDER BY i) AS figures FROM panel JOIN n ON n.cik = panel.cik GROUP BY n.name)
SELECT c.ticker, coalesce(array_to_string(l.figures, '; '), '') AS figures, c.sections, c.sections_ok, c.sections_failed, array_to_string(list_concat(coalesce(l.figures, [])[1:3], coalesce(c.said, [])), ' | ') AS summary FROM company AS c LEFT JOIN lines AS l ON l.ticker = c.ticker""",
    "graded_cases": "SELECT item_id, CASE WHEN n % 7 = 0 THEN 'crash' WHEN n % 3 = 0 THEN 'abstain' WHEN n % 2 = 1 OR contains('nothing of the kind', e) THEN 'correct' ELSE 'incorrect' END AS grade, CASE WHEN n % 7 = 0 THEN 'RuntimeError: down' END AS error, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 7 <> 0 THEN md5(CASE WHEN n % 3 = 0 THEN '' WHEN n % 2 = 1 THEN text ELSE 'nothing of the kind' END) END AS answer FROM (SELECT *, length(text) AS n, lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS e FROM benchmark)",
    "graded_summary": """WITH g AS (SELECT 't' || (item_id % 3) AS question_type, CASE WHEN n % 7 = 0 THEN 'crash' WHEN n % 3 = 0 THEN 'abstain' WHEN n % 2 = 1 OR contains('nothing of the kind', e) THEN 'correct' ELSE 'incorrect' END AS grade FROM (SELECT *, length(text) AS n, lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS e FROM benchmark))
SELECT question_type, count(*) AS total, count(*) FILTER (grade = 'correct') AS correct, count(*) FILTER (grade = 'incorrect') AS incorrect, count(*) FILTER (grade = 'abstain') AS abstain, count(*) FILTER (grade = 'crash') AS crash, round(count(*) FILTER (grade = 'correct') / count(*), 3) AS accuracy,
  round(coalesce(count(*) FILTER (grade = 'correct') / nullif(count(*) FILTER (grade IN ('correct', 'incorrect')), 0), 0), 3) AS answered_accuracy, round(count(*) FILTER (grade = 'incorrect') / count(*), 3) AS hallucination_rate FROM g GROUP BY ROLLUP (question_type)""",
    "boilerplate_batches": "SELECT batch, count(*) AS texts, count(*) FILTER (length(t) % 3 = 0) AS flagged, min(conv_id) AS first, max(conv_id) AS last FROM (SELECT *, coalesce(text, '') AS t, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 60 AS batch FROM conversations) GROUP BY batch",
    "prompt_texts": f"""WITH j AS ({as_sql(JUDGED)}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
said AS (SELECT j.*, 'Claim on ' || doc_id AS said, [doc_id + 2, doc_id] AS cites FROM j),
e AS (SELECT s.claim_id, string_agg('<evidence chunk_id="' || d.doc_id || '">' || chr(10) || d.text || chr(10) || '</evidence>', chr(10) ORDER BY list_position(s.cites, d.doc_id)) AS evidence FROM said AS s JOIN d ON list_contains(s.cites, d.doc_id) WHERE s.doc_id % 6 > 0 GROUP BY s.claim_id)
SELECT s.query_id, md5(string_agg('<chunk id="' || s.doc_id || '"' || CASE WHEN s.doc_id % 3 > 0 THEN ' | section: Item ' || s.doc_id % 3 ELSE '' END || '>' || chr(10) || d.text || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY s.doc_id)) AS chunks,
  md5(string_agg('<claim id="' || s.claim_id || '">' || chr(10) || 'Claim: ' || said || chr(10) || coalesce(e.evidence, '(no evidence cited)') || chr(10) || '</claim>', chr(10) || chr(10) ORDER BY s.claim_id)) AS judged,
  CASE WHEN s.query_id <> 'Q1' THEN 'On ' || s.query_id || chr(10) ELSE '' END || coalesce(string_agg('- ' || said || CASE WHEN verdict = 'NOT_ENOUGH_INFO' THEN ' [unverified]' ELSE '' END, chr(10) ORDER BY s.claim_id) FILTER (verdict <> 'CONTRADICTED') || chr(10), '') || '- card of ' || s.query_id AS composed
FROM said AS s JOIN d ON d.doc_id = s.doc_id LEFT JOIN e ON e.claim_id = s.claim_id GROUP BY s.query_id""",
    "progress_stream": f"SELECT DISTINCT 'eval_' || visitor AS query_id, stage, CASE stage WHEN 'route' THEN '{events.STAGES['route']}' WHEN 'generate' THEN '{events.STAGES['generate']}' ELSE '{events.STAGES['verify']}' END AS label FROM ({as_sql(LOG)}) WHERE query_id LIKE 'eval\\_%' ESCAPE '\\' AND event = 'llm_call'",
    "session_stream": f"""WITH l AS (SELECT visitor, ts, CASE WHEN lag(ts) OVER (PARTITION BY visitor ORDER BY ts) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ({as_sql(LOG)})),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT CAST(visitor AS VARCHAR) AS visitor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY visitor, run""",
    "payload_answers": f"""SELECT conv_id, turn, shape <= 10 AS usable, CASE WHEN shape IN (0, 1, 4, 5, 7) THEN 's' WHEN shape <= 10 THEN '' END AS summary, CASE WHEN shape <= 10 THEN md5(CASE WHEN trim(text) = '' THEN '' ELSE
  concat(text, '|', CASE shape WHEN 6 THEN 'c1|risk' WHEN 8 THEN '|insight' WHEN 10 THEN 'c9|insight' ELSE 'c1,c2|risk' END) END) END AS claims FROM ({as_sql(ANSWERS)})""",
    "payload_kinds": f"""SELECT conv_id, turn, CASE shape WHEN 0 THEN 'a' || conv_id || '|SUPPORTED|' || md5(text) ELSE '' END AS verdicts,
  CASE shape WHEN 0 THEN 'REWRITE|' || md5(text) || '|' WHEN 1 THEN 'EXPAND|' || md5('') || '|' WHEN 3 THEN '5|' || md5('') || '|' ELSE '|' || md5('') || '|' END AS assessment,
  CASE shape WHEN 0 THEN 'numeric' WHEN 2 THEN 'hybrid' ELSE 'narrative' END AS route, CASE shape WHEN 0 THEN 'cagr|revenue|-|3|' WHEN 2 THEN 'value|m|2024|-|A,B' ELSE '' END AS queries, CASE shape WHEN 0 THEN 'AAPL' ELSE '' END AS companies, '' AS refusal, shape = 0 AS fully_answers,
  CASE shape WHEN 0 THEN CASE WHEN trim(text) = '' THEN '' ELSE 'k' || conv_id || '|' || md5(text) END ELSE '' END AS questions FROM ({as_sql(KINDS)})""",
}
QUERIES = {f.__name__: f for f in (retrieved_texts, answer_rounds, digest_report, graded_cases, graded_summary, boilerplate_batches, prompt_texts, progress_stream, session_stream, payload_answers, payload_kinds)}
