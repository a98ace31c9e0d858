"""Questions to reports: routing, retrieval in rounds, claims, verdicts, one regeneration.

Models are opaque row or group operators behind ``Provider``; each has a defined
output and a fail-safe, so a plan never breaks on one. ``RuleProvider`` answers by
fixed rules, offline. Control flow is data: questions are split by route, loops
with a bound are unrolled over the questions that still need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import presentation, registry
from ledgerlens.operators import claims as cl
from ledgerlens.operators import evals, matching, numbering, retrieval
from ledgerlens.operators.facts import Points
from ledgerlens.plans import planner
from ledgerlens.sources import filings
from ledgerlens.sources.staging import kept

#: Question patterns and the bounds of loops and batches.
FINANCIAL = r"(?i)revenue|net sales|income|profit|margin|earnings|eps|cash flow|debt|dividend|buyback|capex|expense|assets|liabilit|equity|营收|收入|利润|毛利|现金流|负债|回购|股息"
NUMERIC_PATTERNS = (
    r"CAGR", r"复合增长率", r"年均增长",
    r"平均", r"\baverage\b", r"\bmean\b", r"\bmedian\b", r"中位数",
    r"环比", r"合计", r"总和", r"\bsum\b",
    r"计算", r"算一下", r"\bcalculate\b", r"\bcompute\b",
    r"增长率是多少", r"增长了百分之多少", r"growth rate", r"percent(?:age)? change",
    r"多少倍", r"比率是多少", r"\bratio\b", r"利润率是多少", r"毛利率是多少",
)
COVERAGE_PATTERNS = (
    r"risk factors?", r"\brisks\b", r"风险",
    r"competitors?|competition|competitive", r"竞争",
    r"segments?|business lines?|product lines?", r"板块|业务线",
    r"what are (?:the |its |their )?(?:biggest|largest|main|key|top|major|primary)",
    r"list (?:the|all|its)\b", r"最大的|主要的|哪些",
)
NUMERIC, COVERAGE = ("(?i)" + "|".join(p) for p in (NUMERIC_PATTERNS, COVERAGE_PATTERNS))
ROUNDS, BATCH = 3, 60
#: What is said where no claim came out of two tries.
UNANSWERED = "No answer could be made this time; please ask again."


class Provider(Protocol):
    """What a model is asked. Every call may fail; the caller falls back."""

    def route(self, question: str) -> dict: ...
    def assess(self, question: str, previews: list[str]) -> dict: ...
    def generate(self, question: str, chunks: list[tuple[str, str]], feedback: str = "", figures: str = "") -> list[dict]: ...
    def verify(self, claims: list[dict]) -> list[dict]: ...
    def boilerplate(self, texts: list[str]) -> list[bool]: ...
    def ask(self, chunks: list[tuple[str, str]]) -> list[dict]: ...
    def grade(self, question: str, expected: str, got: str) -> str: ...
    def condense(self, question: str, history: list[str]) -> str: ...


class RuleProvider:
    """Deterministic answers by fixed rules."""

    def route(self, question: str) -> dict:
        import re

        numeric = bool(re.search(NUMERIC, question))
        if not numeric and not re.search(FINANCIAL, question) and not re.search(COVERAGE, question):
            return {"route": "out_of_scope", "queries": [], "refusal": "This is no question about a filing.", "fully_answers": False}
        op = next((o for o, words in (("cagr", "CAGR"), ("average", "average|mean"), ("yoy", "growth|change"), ("ratio", "ratio|margin")) if re.search(words, question, re.I)), "value")
        asked = [{"op": op, "metric": m} for m in (*registry.METRICS, *registry.RATIOS, *registry.DERIVED) if re.search(rf"\b{m.replace('_', ' ')}\b", question, re.I)]
        return {"route": "numeric" if numeric else "narrative", "queries": asked if numeric else [], "refusal": "", "fully_answers": numeric}

    def assess(self, question: str, previews: list[str]) -> dict:
        return {"decision": "ENOUGH" if len(previews) >= 3 else "EXPAND"}

    def generate(self, question: str, chunks: list[tuple[str, str]], feedback: str = "", figures: str = "") -> list[dict]:
        return [{"text": text.split(". ")[0][:200], "cited": [cid], "kind": "risk" if "risk" in text.lower() else "insight"} for cid, text in chunks[:3]]

    def verify(self, claims: list[dict]) -> list[dict]:
        return [{"claim_id": c["claim_id"], "verdict": "SUPPORTED" if c["text"] and c["text"] in c["evidence"] else "NOT_ENOUGH_INFO", "reason": "text" if c["text"] else ""} for c in claims]

    def boilerplate(self, texts: list[str]) -> list[bool]:
        return [len(t) < 40 for t in texts]

    def ask(self, chunks: list[tuple[str, str]]) -> list[dict]:
        return [{"chunk_id": c, "question": f"What is said of {' '.join(t.split()[:3])}?"} for c, t in chunks]

    def grade(self, question: str, expected: str, got: str) -> str:
        return "abstain" if not got else "correct" if expected.lower() in got.lower() else "incorrect"

    def condense(self, question: str, history: list[str]) -> str:
        return f"{question} (after: {history[-1]})"


def is_numeric(question: Column) -> Column:
    return question.rlike(NUMERIC)


def is_coverage(question: Column) -> Column:
    return question.rlike(COVERAGE)


def settled_route(route: Column, n_queries: Column, refusal: Column, fully: Column, question: Column) -> Column:
    """The router's word under its guards: numeric needs queries, and to answer in full; a refusal needs words, and never meets a financial question."""
    first = F.when(route.isin("numeric", "hybrid") & (F.coalesce(n_queries, F.lit(0)) == 0), "narrative").otherwise(F.when(route.isin("numeric", "hybrid", "narrative", "out_of_scope"), route).otherwise("narrative"))
    second = F.when((first == "numeric") & ~F.coalesce(fully, F.lit(False)), "hybrid").otherwise(first)
    return F.when((second == "out_of_scope") & ((F.coalesce(refusal, F.lit("")) == "") | question.rlike(FINANCIAL)), "narrative").otherwise(second)


_QUERIES = "array<struct<op:string,metric:string,fy:int,years:int>>"


def routed(questions: DataFrame, provider: Provider) -> DataFrame:
    """``questions`` (query_id, ticker, question) with ``route``, numeric ``queries``, named ``companies`` and a ``refusal``; a failing router means narrative."""

    @F.pandas_udf(f"route string, queries {_QUERIES}, companies array<string>, refusal string, fully_answers boolean")
    def ask(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                try:
                    r = provider.route(t)
                    queries = [{"op": q.get("op"), "metric": q["metric"], "fy": q.get("fy"), "years": q.get("years")} for q in r.get("queries", [])]
                    rows.append((r["route"], queries, list(r.get("companies", [])), r.get("refusal", ""), bool(r.get("fully_answers", False))))
                except Exception:  # noqa: BLE001
                    rows.append(("narrative", [], [], "", False))
            yield pd.DataFrame(rows, columns=["route", "queries", "companies", "refusal", "fully_answers"])

    r = questions.withColumn("_r", ask("question"))
    settled = settled_route(F.col("_r.route"), F.size("_r.queries"), F.col("_r.refusal"), F.col("_r.fully_answers"), F.col("question"))
    return r.withColumns({"route": settled, "queries": F.col("_r.queries"), "companies": F.col("_r.companies"), "refusal": F.col("_r.refusal")}).drop("_r")


def next_step(decision: Column, new_query: Column, query: Column, k: Column, most: int = 24) -> tuple[Column, Column, Column]:
    """(stop, query, k) after an assessment: unknown words stop; a rewrite without a query expands."""
    word = F.upper(F.coalesce(decision, F.lit("")))
    stop = ~word.isin("REWRITE", "EXPAND")
    rewrite = (word == "REWRITE") & (F.trim(F.coalesce(new_query, F.lit(""))) != "")
    return stop, F.when(rewrite, F.trim(new_query)).otherwise(query), F.when(stop | rewrite, k).otherwise(F.least(k * 2, F.lit(most)))


def refined(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider: Provider) -> DataFrame:
    """The hits of ``refinement``."""
    return refinement(questions, retrieve, provider)[0]


def refinement(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider: Provider) -> tuple[DataFrame, DataFrame]:
    """Up to three rounds of retrieval, unrolled; each round runs for the questions that go on.

    ``retrieve``: (query_id, query, k) to (query_id, chunk_id, place, text). Gives the hits,
    ``query_id, round, k, place, chunk_id, text``, and what was asked in each round,
    ``query_id, round, query, k, decision`` (null in the last one, which nobody judges). A
    round's results and its assessment are staged, so each is asked for once.
    """

    @F.pandas_udf("decision string, new_query string")
    def assess(question: pd.Series, previews: pd.Series) -> pd.DataFrame:
        rows = []
        for q, p in zip(question, previews):
            try:
                a = provider.assess(q, list(p))
                rows.append((a.get("decision"), a.get("new_query")))
            except Exception:  # noqa: BLE001
                rows.append(("ENOUGH", None))
        return pd.DataFrame(rows, columns=["decision", "new_query"])

    going = questions.select("query_id", "question", F.col("question").alias("query"), F.least("k", F.lit(retrieval.MOST)).alias("k"))
    rounds, asked = [], []
    for n in range(1, ROUNDS + 1):
        hits = retrieve(going.select("query_id", "query", "k")).join(going.select("query_id", "k"), "query_id").withColumn("round", F.lit(n))
        hits = kept(hits.select("query_id", "round", "k", "place", "chunk_id", "text"), "round")
        rounds.append(hits)
        told = going.withColumn("round", F.lit(n))
        if n < ROUNDS:
            seen = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.substring(x["text"], 1, 300)).alias("previews"))
            told = kept(told.join(seen, "query_id", "left").withColumn("a", assess("question", F.coalesce("previews", F.array().cast("array<string>")))).drop("previews"), "judged")
            stop, query, k = next_step(F.col("a.decision"), F.col("a.new_query"), F.col("query"), F.col("k"), retrieval.MOST)
            going = kept(told.select("query_id", "question", query.alias("query"), k.alias("k"), stop.alias("stop")).where("not stop").drop("stop"), "going")
        asked.append(told.select("query_id", "round", "query", "k", F.col("a.decision").alias("decision") if n < ROUNDS else F.lit(None).cast("string").alias("decision")))
    return reduce(DataFrame.unionByName, rounds), reduce(DataFrame.unionByName, asked)


def chosen(rounds: DataFrame) -> DataFrame:
    """``query_id, place, chunk_id, text``: the last round's results, filled up to its k with those of earlier rounds, in their order."""
    last = Window.partitionBy("query_id")
    turn = F.when(F.col("round") == F.max("round").over(last), 0).otherwise(F.col("round"))
    first = rounds.withColumn("turn", turn).groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("turn", "place", "text"), F.struct("turn", "place")).alias("x"), F.max_by("k", "round").alias("_k"))
    ranked = first.withColumns({"place": F.row_number().over(last.orderBy("x.turn", "x.place", "chunk_id")), "k": F.max("_k").over(last)})
    return ranked.where("x.turn = 0 or place <= k").select("query_id", "place", "chunk_id", "x.text")


def generated(questions: DataFrame, chunks: DataFrame, provider: Provider, suffix: str = "") -> DataFrame:
    """Claims ``query_id, claim_id, text, kind, cited_chunk_ids`` for each question from its chunks; see ``generation``."""
    return generation(questions, chunks, provider, suffix).where("claim_id is not null").drop("error")


def generation(questions: DataFrame, chunks: DataFrame, provider: Provider, suffix: str = "") -> DataFrame:
    """Claims ``query_id, claim_id, text, kind, cited_chunk_ids, error`` for each question from its chunks; citations outside them go.

    The provider is asked twice at most. A question that it fails on both times has one
    row without a claim, whose ``error`` says why; one that has no answer has no row.
    ``questions`` may have ``feedback`` on an earlier try and ``figures`` that the answer
    shows; ``suffix`` tells tries apart.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        known = list(zip(group["chunk_id"], group["text"]))
        told = {k: v for k in ("feedback", "figures") if (v := group[k].iloc[0])}
        qid, ids = group["query_id"].iloc[0], set(group["chunk_id"])
        rows: list[tuple] = []
        for _ in range(2):
            try:
                got = provider.generate(group["question"].iloc[0], known, **told)
                rows = [(qid, f"{qid}{suffix}_claim{i}", c["text"], c.get("kind") if c.get("kind") in ("risk", "insight") else "insight", [x for x in c.get("cited", []) if x in ids], None) for i, c in enumerate(got, 1)]
                break
            except Exception as e:  # noqa: BLE001
                rows = [(qid, None, None, None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(rows, columns=["query_id", "claim_id", "text", "kind", "cited_chunk_ids", "error"])

    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in questions.columns else F.lit("").alias(c) for c in ("feedback", "figures")]
    met = questions.select("query_id", "question", *told).join(chunks.select("query_id", "place", "chunk_id", "text"), "query_id")
    return met.groupBy("query_id").applyInPandas(run, "query_id string, claim_id string, text string, kind string, cited_chunk_ids array<string>, error string")


def verified(claims: DataFrame, chunks: DataFrame, provider: Provider) -> DataFrame:
    """Claims with verdicts, one call for all of a question's claims."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            got = provider.verify([{"claim_id": c, "text": t, "evidence": e or ""} for c, t, e in zip(group["claim_id"], group["text"], group["evidence"])])
        except Exception:  # noqa: BLE001
            got = []
        return pd.DataFrame([(v.get("claim_id"), v.get("verdict"), v.get("reason"), i) for i, v in enumerate(got)], columns=["claim_id", "verdict", "reason", "seq"])

    cited = cl.cited(claims, chunks.select("chunk_id", F.lit(None).cast("string").alias("section"), "text").dropDuplicates(["chunk_id"]))
    evidence = cited.withColumn("evidence", F.array_join(F.transform("citations", lambda c: c["chunk_text"]), "\n"))
    verdicts = evidence.select("query_id", "claim_id", "text", "evidence").groupBy("query_id").applyInPandas(run, "claim_id string, verdict string, reason string, seq int")
    return cl.apply_verdicts(claims, verdicts)


def narrative(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider: Provider) -> DataFrame:
    """Judged claims of all questions, from what is found for them in up to three rounds. What a model has said is staged before it is read, so no branch asks it again."""
    rounds = refined(questions.withColumn("k", asked_k(F.col("question"))), retrieve, provider)
    return judged(questions, kept(chosen(rounds), "chunks"), provider)


def asked_k(question: Column) -> Column:
    """How many chunks a question is first answered from: twice as many if it wants breadth."""
    return F.when(is_coverage(question), retrieval.coverage_k()).otherwise(retrieval.K)


def judged(questions: DataFrame, chunks: DataFrame, provider: Provider, made: DataFrame | None = None) -> DataFrame:
    """Claims of all questions from their chunks (or those already ``made``), with verdicts; those of a question with a contradicted one are made once more, told what was wrong."""
    made = kept(generated(questions, chunks, provider), "claims") if made is None else made
    first = kept(verified(made, chunks, provider), "verdicts")
    bad = first.where("verdict = 'CONTRADICTED'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", F.col("judge_reason").alias("reason")))).alias("wrong"))
    told = bad.select("query_id", presentation.feedback(F.col("wrong")).alias("feedback"))
    again = questions.drop("feedback").join(told, "query_id")
    second = verified(kept(generated(again, chunks, provider, "r"), "claims"), chunks, provider)
    return first.join(bad.select("query_id"), "query_id", "left_anti").unionByName(second)


def answer(questions: DataFrame, provider: Provider, retrieve: Callable[[DataFrame], DataFrame], points: Points, facts: DataFrame, companies: DataFrame, corpus: DataFrame, listed: DataFrame) -> DataFrame:
    """Every question answered: one row ``query_id, ticker, route, degraded, needs_onboarding, summary, figures, displayed, blocked, unsupported_rate``.

    ``questions``: query_id, ticker, question, and with ``doc_id, scope_cik, scope_accn``
    those that are held to a document (no other company is looked for, nothing is
    refused, and figures come from its filing or not at all). ``companies``: cik,
    ticker; ``corpus`` and ``listed``: ticker. A question is routed; numeric ones get
    cards, and without any go on as narrative ones (``degraded``); hybrid ones get both,
    and their texts are written with the cards in view.
    """
    held = [c for c in ("doc_id", "scope_cik", "scope_accn") if c in questions.columns]
    asked = routed(questions, provider)
    if held:
        own = F.col("doc_id").isNotNull()
        free = own & F.col("scope_accn").isNull()
        asked = asked.withColumn("route", F.when(free | (own & (F.col("route") == "out_of_scope")), "narrative").otherwise(F.col("route")))
        asked = asked.withColumns({"queries": F.when(free, F.array().cast(_QUERIES)).otherwise(F.col("queries")), "companies": F.when(own, F.array().cast("array<string>")).otherwise(F.col("companies"))})
    asked = kept(asked, "routed")
    about = matching.mentioned(asked.select("query_id", "ticker", F.col("companies").alias("mentions")), corpus, listed)
    asked = kept(asked.drop("ticker").join(about, "query_id"), "about")
    here = asked.where("needs_onboarding is null and route <> 'out_of_scope'")
    numeric = here.where("route in ('numeric', 'hybrid')").select("query_id", "ticker", *held, F.posexplode("queries").alias("pos", "q")).join(companies.select("cik", "ticker"), "ticker")
    scopes = [c for c in held if c != "doc_id"]
    cards = planner.answered(numeric.select(F.col("query_id").alias("answer_id"), "pos", "cik", "ticker", "q.op", "q.metric", "q.fy", "q.years", *scopes), points, facts)
    figures = kept(cards.groupBy(F.col("answer_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("query_id").alias("at"), "text"))), lambda x: x["text"]).alias("cards")), "figures")
    told = kept(here.join(figures, "query_id", "left").withColumn("degraded", (F.col("route") == "numeric") & F.col("cards").isNull()), "told")
    texts = told.where("route <> 'numeric' or degraded").withColumn("figures", F.array_join("cards", "\n"))
    texts_judged = kept(narrative(texts.select("query_id", "ticker", "question", "figures"), retrieve, provider), "judged")
    out = asked.join(told.select("query_id", "cards", "degraded"), "query_id", "left").join(cl.report(texts_judged), "query_id", "left")
    degraded = F.coalesce("degraded", F.lit(False))
    summary = (
        F.when(F.col("needs_onboarding").isNotNull(), F.concat("needs_onboarding", F.lit(" is not in the corpus yet.")))
        .when(F.col("route") == "out_of_scope", F.col("refusal"))
        .when((F.col("route") == "numeric") & ~degraded, F.array_join("cards", "\n"))
        .when(F.col("displayed").isNull(), UNANSWERED)
    )
    route = F.when(F.col("needs_onboarding").isNotNull(), "onboard").when(degraded, "narrative").otherwise(F.col("route"))
    return out.select(
        "query_id", "ticker", route.alias("route"), degraded.alias("degraded"), "needs_onboarding", summary.alias("summary"), F.coalesce("cards", F.array().cast("array<string>")).alias("figures"),
        F.coalesce("displayed", F.lit(0)).alias("displayed"), F.coalesce("blocked", F.lit(0)).alias("blocked"), F.coalesce("unsupported_rate", F.lit(0.0)).alias("unsupported_rate"),
    )


def onboarding(wanted: DataFrame, corpus: DataFrame, listing: DataFrame, submissions: DataFrame, most: int = 0) -> DataFrame:
    """What is to be taken in: ``ticker, status, cik, title, accn, filed`` for each wanted ticker.

    ``exists`` if it is in the corpus; ``full`` if that holds ``most`` companies (0: no
    bound); ``malformed`` or ``unknown`` if it is no listed ticker; ``no filing`` without an
    annual report; else ``add``, with the filing to fetch.
    """
    known = corpus.select("ticker", F.lit(True).alias("known")).distinct()
    full = known.agg((F.lit(most > 0) & (F.count("*") >= most)).alias("full"))
    met = filings.resolve_tickers(wanted.select(F.upper(F.trim("ticker")).alias("ticker")).distinct(), listing).join(known, "ticker", "left").join(full, F.lit(True))  # one row
    last = filings.latest_filing(submissions).select(F.lpad("cik", 10, "0").alias("cik"), "accn", "filed")
    met = met.join(last, "cik", "left")
    status = F.when(F.col("known"), "exists").when(F.col("full"), "full").when(F.col("error").isNotNull(), F.col("error")).when(F.col("accn").isNull(), "no filing").otherwise("add")
    own = lambda c: F.when(F.col("status") == "add", F.col(c)).alias(c)
    return met.withColumn("status", status).select("ticker", "status", *map(own, ("cik", "title", "accn", "filed")))


def boilerplate(claims: DataFrame, provider: Provider, size: int = BATCH) -> DataFrame:
    """Claims (claim_id, text) with ``batch`` and ``boilerplate``: every call holds ``size`` texts, in the order of their ids, the last one what is left; a failing call, or one with another number of answers, means none of its texts is."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema.fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("claim_id")
        try:
            got = [bool(x) for x in provider.boilerplate(group["text"].tolist())]
        except Exception:  # noqa: BLE001
            got = []
        return group.assign(boilerplate=got if len(got) == len(group) else False)

    return numbering.batched(claims, size, "claim_id").groupBy("batch").applyInPandas(run, f"{schema}, batch long, boilerplate boolean")


def questions_from(chunks: DataFrame, provider: Provider, longest: int = 2000, n: int = 5, seed: str = "smoke") -> DataFrame:
    """``ticker, chunk_id, question``: one call for each ticker, about ``n`` of its chunks (ticker, chunk_id, text), the same on every run; unknown chunks and numeric questions go."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            got = provider.ask([(c, t[:longest]) for c, t in zip(group["chunk_id"], group["text"])])
        except Exception:  # noqa: BLE001
            got = []
        known = set(group["chunk_id"])
        rows = [(group["ticker"].iloc[0], g["chunk_id"], g["question"].strip()) for g in got if g.get("chunk_id") in known and str(g.get("question", "")).strip()]
        return pd.DataFrame(rows, columns=["ticker", "chunk_id", "question"])

    some = evals.sample(chunks.select("ticker", "chunk_id", "text"), "chunk_id", "ticker", n, seed)
    got = some.groupBy("ticker").applyInPandas(run, "ticker string, chunk_id string, question string")
    return got.where(~is_numeric(F.col("question")))


GRADES = ("correct", "incorrect", "abstain")


def _grade(provider: Provider, question: str, expected: str, got: str | None) -> str:
    word = provider.grade(question, expected, got or "")
    return word if word in GRADES else "incorrect"


def graded(answers_: DataFrame, provider: Provider) -> DataFrame:
    """``answers_`` (question, expected, got) with ``grade``; an unknown grade is incorrect, a failing call a crash."""

    @F.pandas_udf("string")
    def grade(question: pd.Series, expected: pd.Series, got: pd.Series) -> pd.Series:
        out = []
        for q, e, g in zip(question, expected, got):
            try:
                out.append(_grade(provider, q, e, g))
            except Exception:  # noqa: BLE001
                out.append("crash")
        return pd.Series(out, dtype=object)

    return answers_.withColumn("grade", grade("question", "expected", "got"))


def run_cases(cases: DataFrame, respond: Callable[[str], str | None], provider: Provider, tries: int = 2) -> DataFrame:
    """``cases`` (question, expected) with ``outcome``: model_answer, grade, error, attempts.

    A case is answered by ``respond`` in at most ``tries`` attempts. If none succeeds its
    grade is crash, with the last error; else the answer is graded, and an answer that cannot be graded is incorrect.
    """

    @F.pandas_udf("model_answer string, grade string, error string, attempts int")
    def run(question: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = []
        for q, e in zip(question, expected):
            error, got, attempt = None, None, 0
            for attempt in range(1, tries + 1):
                try:
                    got, error = respond(q) or "", None
                    break
                except Exception as x:  # noqa: BLE001
                    error = f"{type(x).__name__}: {x}"
            if error is not None:
                rows.append((None, "crash", error, attempt))
                continue
            try:
                rows.append((got, _grade(provider, q, e, got), None, attempt))
            except Exception as x:  # noqa: BLE001
                rows.append((got, "incorrect", f"{type(x).__name__}: {x}", attempt))
        return pd.DataFrame(rows, columns=["model_answer", "grade", "error", "attempts"])

    return cases.withColumn("outcome", run("question", "expected"))


def condensed(turns: DataFrame, provider: Provider, history: int = 3) -> DataFrame:
    """The last user turn of each conversation (conv_id, turn, role, text) as a question of its own, from up to three turns before; alone, or if the call fails, it stays as it is."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("asked"))
    before = cl.last_turns(turns.join(last.select("conv_id", "asked"), "conv_id").where("turn < asked").drop("asked"), history)
    told = before.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("history"))

    @F.pandas_udf("string")
    def condense(question: pd.Series, earlier: pd.Series) -> pd.Series:
        out = []
        for q, h in zip(question, earlier):
            try:
                out.append(provider.condense(q, list(h)) or q)
            except Exception:  # noqa: BLE001
                out.append(q)
        return pd.Series(out, dtype=object)

    met = last.join(told, "conv_id", "left")
    return met.select("conv_id", F.when(F.size("history") > 0, condense("question", F.coalesce("history", F.array().cast("array<string>")))).otherwise(F.col("question")).alias("question"))
