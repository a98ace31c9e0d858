"""Claims, their evidence, their verdicts, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import figures
from ledgerlens.operators import retrieval

#: Verdicts with their status and credibility.
VERDICTS = {"SUPPORTED": ("OK", 0.9), "NOT_ENOUGH_INFO": ("WARNING", 0.4), "CONTRADICTED": ("ERROR", 0.0)}
UNJUDGED = "NOT_ENOUGH_INFO"


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each claim with the last verdict given for it (``seq``); none or an unknown one is NOT_ENOUGH_INFO."""
    last = verdicts.groupBy("claim_id").agg(F.max_by(F.struct("verdict", "reason"), "seq").alias("v"))
    known = F.col("v.verdict").isin(*VERDICTS)
    return claims.join(last, "claim_id", "left").select(
        *[c for c in claims.columns if c not in ("verdict", "judge_reason")],
        F.when(known, F.col("v.verdict")).otherwise(UNJUDGED).alias("verdict"),
        F.when(F.col("v").isNull(), "no verdict").when(known, F.trim(F.coalesce("v.reason", F.lit("")))).otherwise("invalid verdict").alias("judge_reason"),
    )


def status(verdict: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (s, _) in VERDICTS.items() for x in (k, s)]), F.coalesce(verdict, F.lit(UNJUDGED)))


def credibility(verdict: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (_, c) in VERDICTS.items() for x in (k, c)]), F.coalesce(verdict, F.lit(UNJUDGED)))


def unsupported_rate(verdict: Column) -> Column:
    """Aggregate: share of claims not supported; 0 without claims."""
    return F.coalesce(F.avg((verdict != "SUPPORTED").cast("double")), F.lit(0.0))


def cited(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of each claim's citations (``cited_chunk_ids``) in their order, unknown ids left out; a known chunk without a text is cited too."""
    each = claims.select("claim_id", F.posexplode("cited_chunk_ids").alias("pos", "chunk_id"))
    met = each.join(chunks.select("chunk_id", "section", F.col("text").alias("chunk_text")), "chunk_id")
    texts = met.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "section", "chunk_text"))).alias("citations"))
    return claims.join(texts, "claim_id", "left")


def whitelisted(cited_ids: Column, retrieved: Column) -> Column:
    """Citations that were retrieved, order and repeats kept."""
    return F.filter(cited_ids, lambda c: F.array_contains(retrieved, c))


def report(claims: DataFrame) -> DataFrame:
    """For each query its displayed, unverified and blocked claims, risk flags and rate."""
    c = claims.withColumn("status", status(F.col("verdict")))
    return c.groupBy("query_id").agg(
        F.count_if(F.col("status") != "ERROR").alias("displayed"),
        F.count_if(F.col("status") == "WARNING").alias("unverified"),
        F.count_if(F.col("status") == "ERROR").alias("blocked"),
        F.count_if((F.col("kind") == "risk") & (F.col("status") == "OK")).alias("risk_flags"),
        unsupported_rate(F.col("verdict")).alias("unsupported_rate"),
        F.avg(credibility(F.col("verdict"))).alias("credibility"),
    )


def rescue(flagged_claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims (cik, claim_id, values) whose every figure is one of the company's facts, on the scale ladder.

    Figures meet facts by logarithm: an equal magnitude modulo a thousand puts both
    into the same or neighbouring narrow buckets, so it is an equi-join, checked
    exactly; a company with many facts is no group of its own.
    """

    def bucket(v: Column) -> Column:
        return F.floor(F.pmod(F.log10(F.abs(v)), F.lit(3.0)) * 500).cast("int")

    known = facts.select("cik", F.col("val").cast("double").alias("fact")).where("fact <> 0").distinct().withColumn("b", bucket(F.col("fact")))
    figures_ = flagged_claims.select("cik", "claim_id", F.posexplode("values").alias("pos", "v"))
    probes = figures_.where("v <> 0").withColumn("b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(bucket(F.col("v")) + d, F.lit(1500)))))
    hit = probes.join(known, ["cik", "b"]).where(F.exists(F.array(*map(F.lit, figures.LADDER)), lambda k: F.abs(F.col("v") * k - F.col("fact")) / F.abs("fact") < figures.TOLERANCE))
    hits = hit.select("cik", "claim_id", "pos").distinct().groupBy("cik", "claim_id").agg(F.count("*").alias("hits"))
    return flagged_claims.where(F.size("values") > 0).join(hits, ["cik", "claim_id"]).where(F.col("hits") == F.size("values")).select("cik", "claim_id")


def subsume(cards: DataFrame) -> DataFrame:
    """Cards (query_id, card_id, text, sources: array) whose sources are not a strict part of another card's; of equal sets the longer text stays, then the later card.

    Cards meet over a shared source, not all against all.
    """
    one = cards.select("query_id", "card_id", F.length("text").alias("n"), F.array_sort(F.array_distinct("sources")).alias("s"))
    flat = one.select("query_id", "card_id", "n", "s", F.explode("s").alias("x"))
    other = flat.select("query_id", F.col("card_id").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"), "x")
    pairs = flat.join(other, ["query_id", "x"]).where("card_id <> other")
    inside = F.size(F.array_except("s", "t")) == 0
    equal = F.col("s") == F.col("t")
    worse = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("card_id") < F.col("other")))
    gone = pairs.where(inside & (~equal | worse)).select("query_id", "card_id").distinct()
    return cards.join(gone, ["query_id", "card_id"], "left_anti")


def drop_stale(cards: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cards (cik, fy_given, source_ends: array of dates) that reach the company's anchor year, or name their own year."""
    newest = F.coalesce(F.array_max(F.transform("source_ends", lambda d: F.year(d))), F.lit(0))
    met = cards.join(anchors.select("cik", F.col("fy").alias("anchor_fy")), "cik", "left")
    return met.where(F.col("fy_given") | F.col("anchor_fy").isNull() | (newest >= F.col("anchor_fy"))).drop("anchor_fy")


def risk_signals(claims: DataFrame) -> DataFrame:
    """``claims`` (claim, evidence) with ``quantified``, that all its figures are in the evidence, and the phrase there that says a risk has come true."""
    match = figures.number_match(figures.values(F.col("claim")), figures.values(F.col("evidence")))
    return claims.withColumns({"quantified": F.coalesce(match == 1.0, F.lit(False)), "realized": figures.realized_risk(F.col("evidence"))})


def echoes(claims: DataFrame, chunks: DataFrame, k: int = 5, most: int = 3, apart: bool = False) -> DataFrame:
    """``claim_id, neighbours, echoes``: up to ``most`` other sections, in name order, in which what a risk claim says comes up again.

    ``claims``: claim_id, scope, embedding, cited_sections (array); ``chunks``: chunk_id,
    scope, embedding, section. The k chunks of the scope nearest to each claim are
    looked for, of all sections (then those cited, and those of none, are no echo), or
    with ``apart`` among the other sections only, so all k are. ``neighbours`` are the
    chunks in order. A claim without a usable vector, or without neighbours, has no row.
    """
    asked = claims.select(F.col("claim_id").alias("query_id"), "scope", F.col("embedding").alias("query"), *([F.col("cited_sections").alias("sections")] if apart else []))
    rows = chunks.select(F.col("chunk_id").alias("vec_id"), "scope", "embedding", "section")
    hits = retrieval.topk(rows, asked, k).select(F.col("query_id").alias("claim_id"), F.col("vec_id").alias("chunk_id"), "place")
    met = hits.join(chunks.select("chunk_id", "section"), "chunk_id").join(claims.select("claim_id", "cited_sections"), "claim_id")
    own = F.transform(F.coalesce("cited_sections", F.array().cast("array<string>")), retrieval.section_key)
    other = (retrieval.section_key(F.col("section")) != "") & ~F.array_contains(own, retrieval.section_key(F.col("section")))
    return met.groupBy("claim_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("neighbours"),
        F.slice(F.array_sort(F.collect_set(F.when(other, F.trim("section")))), 1, most).alias("echoes"),
    )


def last_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
