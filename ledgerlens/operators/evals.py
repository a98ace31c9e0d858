"""Scores of runs, gates, costs and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.render import percent

#: Thresholds of the gates, dollars for a million tokens in and out by model prefix.
UNSUPPORTED_MOST, BOILERPLATE_MOST, AGREEMENT_LEAST, EVIDENCE_LEAST = 0.04, 0.25, 0.85, 0.6
PRICES = {
    "claude-sonnet": (3.0, 15.0),
    "claude-haiku": (1.0, 5.0),
    "claude-opus": (15.0, 75.0),
    "gpt-5-mini": (0.25, 2.0),
    "gpt-5": (1.25, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4o": (2.5, 10.0),
}
UNKNOWN_PRICE = (3.0, 15.0)
OPERATOR_RUNS = r"^(eval|fb_|smoke_)"


def smoke_score(results: DataFrame, by: str) -> DataFrame:
    """``results``: error, skipped, retrieval_hit, n_claims, n_unsupported. Passed: something scored, nothing crashed, rate within the limit."""
    scored = ~F.col("error") & ~F.col("skipped")
    out = results.groupBy(by).agg(
        F.count("*").alias("n_questions"),
        F.count_if(F.col("error")).alias("n_crashed"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(scored & F.col("retrieval_hit")).alias("retrieval_hits"),
        F.coalesce(F.sum(F.when(scored, F.col("n_claims"))), F.lit(0)).alias("total_claims"),
        F.coalesce(F.sum(F.when(scored, F.col("n_unsupported"))), F.lit(0)).alias("unsupported_claims"),
    )
    rate = F.coalesce(F.try_divide("unsupported_claims", "total_claims"), F.lit(0.0))
    return out.withColumns({"hit_rate": F.coalesce(F.try_divide("retrieval_hits", "n_scored"), F.lit(0.0)), "unsupported_rate": rate, "passed": (F.col("n_scored") > 0) & (F.col("n_crashed") == 0) & (rate <= UNSUPPORTED_MOST)})


def benchmark_summary(graded: DataFrame) -> DataFrame:
    """``graded``: question_type, grade. A row for each type and one for all (type null), by one rollup."""
    n = {g: F.count_if(F.col("grade") == g) for g in ("correct", "incorrect", "abstain", "crash")}
    out = graded.rollup("question_type").agg(F.count("*").alias("total"), *[c.alias(g) for g, c in n.items()])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    return out.withColumns({"accuracy": ratio(F.col("correct"), F.col("total")), "answered_accuracy": ratio(F.col("correct"), F.col("correct") + F.col("incorrect")), "hallucination_rate": ratio(F.col("incorrect"), F.col("total"))})


def gate(rate: Column, numerics_wrong: Column, crashes: Column, boilerplate: Column) -> Column:
    """The first reason to refuse a release, or pass."""
    return (
        F.when(rate > UNSUPPORTED_MOST, "unsupported").when(numerics_wrong > 0, "numeric").when(crashes > 0, "crash").when(boilerplate > BOILERPLATE_MOST, "boilerplate").otherwise("pass")
    )


def priced(models: DataFrame) -> DataFrame:
    """Adds ``price_in, price_out`` by the longest prefix of the model's name after its provider; an unknown or missing name has the price of the middle."""
    prices = models.sparkSession.createDataFrame([(k, *v) for k, v in PRICES.items()], "prefix string, price_in double, price_out double")
    name = F.lower(F.regexp_replace("model", r"^[^:]*:", ""))
    distinct = models.select("model").distinct()
    met = distinct.join(F.broadcast(prices), name.startswith(F.col("prefix")), "left")
    best = met.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p"))
    best = best.select("model", F.coalesce("p.price_in", F.lit(UNKNOWN_PRICE[0])).alias("price_in"), F.coalesce("p.price_out", F.lit(UNKNOWN_PRICE[1])).alias("price_out"))
    return models.join(best.withColumnRenamed("model", "_model"), F.col("model").eqNullSafe(F.col("_model"))).drop("_model")


def llm_cost(log: DataFrame) -> DataFrame:
    """Calls, tokens and estimated dollars by day, stage and model."""
    calls = log.where("event = 'llm_call'").groupBy(F.to_date("ts").alias("day"), "stage", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    exact = ((F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6).cast("decimal(28,8)")
    dollars = F.round(exact, 4).cast("double")
    return priced(calls).withColumn("est_cost_usd", dollars).drop("price_in", "price_out")


def queries_per_day(log: DataFrame, budget: int) -> DataFrame:
    """Visitors' queries by day and what is left of the budget; operators' runs don't count."""
    own = log.where((F.col("event") == "query_received") & ~F.col("query_id").rlike(OPERATOR_RUNS))
    return own.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("queries")).withColumn("budget_left", F.greatest(F.lit(0), budget - F.col("queries")))


def visitor_queries(log: DataFrame) -> DataFrame:
    return log.where("event = 'visitor_query'").groupBy(F.to_date("ts").alias("day"), "visitor").agg(F.count("*").alias("queries"))


def agreement(judged: DataFrame) -> DataFrame:
    """``judged``: a, b. The share of equal verdicts and whether it is enough."""
    return judged.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement")).withColumn("passed", F.col("agreement") >= AGREEMENT_LEAST)


def sample(rows: DataFrame, key: str, by: str, n: int, seed: str) -> DataFrame:
    """n rows for each ``by``, the same on every run: the smallest md5 of seed and key."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def golden_check(cases: DataFrame) -> DataFrame:
    """``cases``: case_id, texts, accns (arrays), expected_substrings, expected_accn. Adds whether the figures answer as pinned."""
    joined, answered = F.array_join("texts", " "), F.size("texts") > 0
    values = answered & F.forall(F.coalesce("expected_substrings", F.array().cast("array<string>")), lambda s: F.contains(joined, s))
    accn = F.col("expected_accn").isNull() | F.array_contains("accns", F.col("expected_accn"))
    return cases.select("case_id", answered.alias("answered"), values.alias("values_ok"), F.coalesce(accn, F.lit(False)).alias("accn_ok"), (values & F.coalesce(accn, F.lit(False))).alias("ok"))


def numeric_probes(companies: DataFrame, newest: DataFrame, years: DataFrame, this_year: int) -> DataFrame:
    """``cik, fy, margin, notes, numeric_ok`` of every company (cik): latest revenue and the net income of its year, their margin, and how old they are.

    A company without revenue is judged by its latest net income, and fails.
    """
    rev = newest.where("metric = 'revenue'").select("cik", "fy", F.col("value").alias("rev"))
    of_year = years.where("metric = 'net_income'").select("cik", "fy", F.col("value").alias("of_year"))
    latest = newest.where("metric = 'net_income'").select("cik", F.col("value").alias("latest"))
    met = companies.select("cik").distinct().join(rev, "cik", "left").join(of_year, ["cik", "fy"], "left").join(latest, "cik", "left")
    ni = F.when(F.col("rev").isNotNull(), F.col("of_year")).otherwise(F.col("latest"))
    met = met.withColumn("ni", ni).withColumn("margin", F.when(F.col("rev") > 0, F.col("ni") / F.col("rev")))
    odd = (F.abs("margin") > 1) | ((F.abs("margin") > 0) & (F.abs("margin") < 0.001))
    notes = F.filter(
        F.array(
            F.when(F.col("rev").isNull(), "revenue not resolvable from official data"),
            F.when(F.col("ni").isNull(), "net income not resolvable from official data"),
            F.when(odd, F.concat(F.lit("net margin "), percent(F.col("margin"), 2), F.lit(" implausible — scale pollution suspected"))),
            F.when(F.col("fy") < this_year - 2, F.concat(F.lit("latest annual revenue is FY"), F.col("fy"), F.lit(" — stale tag?"))),
        ),
        lambda n: n.isNotNull(),
    )
    return met.select("cik", "fy", "margin", notes.alias("notes")).withColumn("numeric_ok", F.size("notes") == 0)


def hit_type(expected: Column, retrieved: Column, equivalent: Column) -> Column:
    """How retrieval met a question's source: ``exact`` by its id, ``equivalent`` by its words, or ``none``."""
    return F.when(F.coalesce(F.array_contains(retrieved, expected), F.lit(False)), "exact").when(F.coalesce(equivalent, F.lit(False)), "equivalent").otherwise("none")


def verdict_counts(displayed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Judged claims by verdict: those shown and those held back are one bag; a column that only one has is null in the other."""
    return displayed.unionByName(blocked, allowMissingColumns=True).groupBy("verdict").agg(F.count("*").alias("n"))


def run_summary(cases: DataFrame) -> DataFrame:
    """``cases``: expected_chunk_id, retrieved_chunk_ids, number_scores, flagged (arrays), boilerplate (array of booleans). One row for a run."""
    one = cases.agg(
        F.count("*").alias("n_cases"),
        F.count_if(F.coalesce(F.array_contains("retrieved_chunk_ids", F.col("expected_chunk_id")), F.lit(False))).alias("retrieval_hits"),
        F.sum(F.size("flagged")).alias("n_flagged"),
        F.sum(F.aggregate("number_scores", F.lit(0.0), lambda a, x: a + x)).alias("_total"),
        F.sum(F.size("number_scores")).alias("_scores"),
        F.sum(F.size(F.filter("boilerplate", lambda b: b))).alias("_generic"),
        F.sum(F.size("boilerplate")).alias("_claims"),
    )
    return one.select("n_cases", "retrieval_hits", "n_flagged", F.try_divide("_total", "_scores").alias("number_match"), F.coalesce(F.try_divide("_generic", "_claims"), F.lit(0.0)).alias("boilerplate_rate"))


def scorecard(claims: DataFrame, by: str) -> DataFrame:
    """How many of a digest's claims are verified, and the line that says so."""
    out = claims.groupBy(by).agg(F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == "SUPPORTED").alias("n_ok"))
    return out.withColumn("line", F.when((F.col("n_claims") > 0) & (F.col("n_ok") == F.col("n_claims")), "every narrative claim verified").otherwise(F.concat(F.col("n_ok"), F.lit(" of "), F.col("n_claims"), F.lit(" claims verified"))))


def judge_model(configured: Column, provider: Column, defaults: dict[str, str]) -> Column:
    """The configured judge, else its provider's default."""
    return F.coalesce(F.nullif(F.trim(configured), F.lit("")), F.element_at(F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]), provider))


def rejudged(results: DataFrame) -> DataFrame:
    """Stored results (n_crashed, unsupported_rate, numeric_ok) under the present rule; what old files lack counts against them, but for the probes."""
    rule = (F.coalesce("n_crashed", F.lit(1)) == 0) & (F.coalesce("unsupported_rate", F.lit(1.0)) <= UNSUPPORTED_MOST) & F.coalesce("numeric_ok", F.lit(True))
    return results.withColumn("passed", rule)
