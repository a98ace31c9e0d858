"""Matches by words and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word is, words of a shingle, probes of one evidence.
WORD, SHINGLE, PROBES = r"[A-Za-z0-9.,$%()\-]+", 8, 40


def name_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def probes(text: Column) -> Column:
    """Eight-word runs at about forty even places; a short text is one run of all its words."""
    w = name_words(text)
    n = F.size(w)
    step = F.greatest(F.lit(1), F.floor((n - SHINGLE) / PROBES)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)), step), lambda i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " "))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


#: Evidence rows that may be broadcast: each below 300 bytes.
FEW = 50_000


def containment(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, doc_id`` where some run of the evidence is in the document's words joined by blanks, as plain text.

    So a run's first word may end a longer word there, and its last word begin one;
    the words between are whole. Runs meet the documents' runs of as many words by the
    hash of those, an equi-join, and the outer two are compared. Runs of one or two
    words have none between: those few meet each document's text itself.
    """
    words_ = name_words(F.col("text"))
    ev = evidence.select("item_id", F.explode(probes(F.col("text"))).alias("run")).withColumn("w", F.split("run", " ")).withColumn("n", F.size("w"))
    inner = ev.where("n > 2").select("item_id", "n", F.xxhash64(F.slice("w", 2, F.col("n") - 2)).alias("key"), F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"))
    sizes = sorted(r["n"] for r in inner.select("n").distinct().collect())  # at most SHINGLE of them
    dw = docs.select("doc_id", words_.alias("w"))
    out = []
    if sizes:
        some = inner.limit(FEW + 1).count() <= FEW

        def runs(n: int) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", i + 2, n - 2)).alias("key"), F.get("w", i).alias("a"), F.get("w", i + n - 1).alias("z")))
            return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<struct<n:int,key:bigint,a:string,z:string>>"))

        own = dw.select("doc_id", F.inline(F.flatten(F.array(*map(runs, sizes)))))
        met = own.join(F.broadcast(inner) if some else inner, ["n", "key"])
        out.append(met.where(F.endswith("a", F.col("first")) & F.startswith("z", F.col("last"))).select("item_id", "doc_id"))
    short = ev.where("n <= 2").select("item_id", "run")
    if short.limit(1).count():
        out.append(dw.select("doc_id", F.array_join("w", " ").alias("all")).join(short, F.contains("all", "run")).select("item_id", "doc_id"))
    if not out:
        return evidence.select("item_id").crossJoin(docs.select("doc_id")).limit(0)
    return reduce(DataFrame.union, out).distinct()


def evidence_equivalent(asked: DataFrame, words_: DataFrame, least: float) -> DataFrame:
    """``id, equivalent``: whether some retrieved text holds at least this share of the source's words.

    ``asked``: id, retrieved (array of ids); ``words_``: id, w (distinct words).
    """
    pairs = asked.select("id", F.explode("retrieved").alias("other")).join(words_, "id").join(words_.select(F.col("id").alias("other"), F.col("w").alias("o")), "other")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("w", "o")), F.size("w")), F.lit(0.0))
    met = pairs.groupBy("id").agg((F.max(share) >= least).alias("equivalent"))
    return asked.select("id").join(met, "id", "left").select("id", F.coalesce("equivalent", F.lit(False)).alias("equivalent"))


def normalized_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("-"), F.lit(" "))), "[^a-z0-9 ]", ""))


def resolve_names(companies: DataFrame, titles: DataFrame) -> DataFrame:
    """``name, cik``: a link's number, else a manual one, else the one company whose title is the name or begins with it.

    ``companies``: name, link, manual; ``titles``: title, cik. A title is matched by each of its leading word runs, so it is an equi-join.
    """
    words_ = F.split(normalized_name(F.col("title")), " ")
    heads = titles.select("cik", F.explode(F.transform(F.sequence(F.lit(1), F.size(words_)), lambda n: F.array_join(F.slice(words_, F.lit(1), n), " "))).alias("want"))
    one = heads.groupBy("want").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("cik")).where("n = 1").select("want", F.col("cik").alias("by_name"))
    link = F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), r"CIK-(\d{10})", 1), F.lit(""))
    met = companies.withColumn("want", normalized_name(F.col("name"))).join(one, "want", "left")
    return met.select("name", F.coalesce(link, "manual", "by_name").alias("cik"))


def mentioned(questions: DataFrame, corpus: DataFrame, listed: DataFrame) -> DataFrame:
    """Which company a question (query_id, ticker, mentions: array) is about.

    The default if mentioned or nothing is; else the first mention in the corpus;
    else the first mention, to be onboarded if it is listed; else the default.
    """
    each = questions.select("query_id", "ticker", F.posexplode_outer("mentions").alias("pos", "m"))
    each = each.join(corpus.select(F.col("ticker").alias("m"), F.lit(True).alias("known")), "m", "left").join(listed.select(F.col("ticker").alias("m"), F.lit(True).alias("real")), "m", "left")
    got = each.groupBy("query_id", "ticker").agg(
        F.max(F.coalesce(F.col("m") == F.col("ticker"), F.lit(False))).alias("default_named"),
        F.min_by("m", F.when(F.col("known"), F.col("pos"))).alias("in_corpus"),
        F.min_by(F.struct("m", "real"), "pos").alias("first"),
    )
    resolved = F.when(F.col("default_named"), F.col("ticker")).otherwise(F.coalesce("in_corpus", "ticker"))
    needs = F.when(~F.col("default_named") & F.col("in_corpus").isNull() & F.coalesce("first.real", F.lit(False)), F.col("first.m"))
    return got.select("query_id", resolved.alias("ticker"), needs.alias("needs_onboarding"))
