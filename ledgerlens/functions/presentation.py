"""What a reader sees of cards, chunks and visitors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import figures

#: A card's wording, where sentences end, the least overlap that is shown.
CARD = r"^\w+ (.+?) FY(\d{4}): ([^,(]+?)(?: \(= .*\))?(?:, ([+\-][\d.]+%) YoY.*)?$"
SENTENCE_END, LEAST = r"(?<=[.!?。？！])\s+", 0.3
#: Where table cells lost what stood between them, and what goes there.
CELLS = (
    (r"(?<=\d)Change(?=\d)", "  |  Change  |  "),
    (r"(?<=[A-Za-z)])(?=\$?\d)", "   "),
    (r"(?<=%)[^\S\n]*(?=\(?\$?\d)", "   |   "),
)


def tile(text: Column) -> Column:
    """(label, fy, value, delta) of a card's text; null if it is worded otherwise."""
    part = lambda i: F.regexp_extract(text, CARD, i)
    return F.when(text.rlike(CARD), F.struct(part(1).alias("label"), part(2).cast("int").alias("fy"), F.trim(part(3)).alias("value"), F.nullif(part(4), F.lit("")).alias("delta")))


def readable_rows(text: Column) -> Column:
    """Separators between table cells that lost theirs."""
    for place, between in CELLS:
        text = F.regexp_replace(text, place, between)
    return text


def visitor_id(address: Column, salt: str) -> Column:
    """A stable name that does not hold the address; null without one."""
    first = F.trim(F.substring_index(address, ",", 1))
    return F.when(F.coalesce(first, F.lit("")) != "", F.substring(F.sha2(F.concat(F.lit(salt + ":"), first), 256), 1, 16))


def best_sentence(claim: Column, text: Column) -> Column:
    """The sentence that has most of the claim's words, if it has 30 %; the first of equals."""
    words = figures.words(claim)
    scored = F.transform(F.split(text, SENTENCE_END), lambda s, i: F.struct(F.coalesce(figures.word_overlap(words, figures.words(s)), F.lit(0.0)).alias("score"), (-i).alias("at"), s.alias("sentence")))
    best = F.array_max(scored)
    return F.when(best["score"] >= LEAST, best["sentence"])


def feedback(claims: Column) -> Column:
    """What a second try is told of the claims (text, reason) that were contradicted."""
    return F.array_join(F.transform(claims, lambda c: F.concat(F.lit("- "), c["text"], F.lit(" ("), F.coalesce(c["reason"], F.lit("")), F.lit(")"))), "\n")


def links(sources: str) -> Column:
    """``form accession`` for each filing among the sources (array of accn, form), in order, each once."""
    return F.array_distinct(F.transform(sources, lambda s: F.concat(s["form"], F.lit(" "), s["accn"])))


def _or(text: Column, other: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(other)).otherwise(text)


def chunk_prompt(chunks: Column) -> Column:
    """The chunks (array of chunk_id, section, text) that an answer is written from, in their order."""
    section = lambda c: F.when(F.coalesce(c["section"], F.lit("")) != "", F.concat(F.lit(" | section: "), c["section"])).otherwise("")
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit('<chunk id="'), c["chunk_id"], F.lit('"'), section(c), F.lit(">\n"), c["text"], F.lit("\n</chunk>"))), "\n\n")


def judge_prompt(claims: Column) -> Column:
    """The claims (array of claim_id, text, citations: array of chunk_id, chunk_text) that one call judges, each with its evidence."""
    one = lambda e: F.concat(F.lit('<evidence chunk_id="'), e["chunk_id"], F.lit('">\n'), e["chunk_text"], F.lit("\n</evidence>"))
    evidence = lambda c: _or(F.array_join(F.transform(c["citations"], one), "\n"), "(no evidence cited)")
    return F.array_join(F.transform(claims, lambda c: F.concat(F.lit('<claim id="'), c["claim_id"], F.lit('">\nClaim: '), c["text"], F.lit("\n"), evidence(c), F.lit("\n</claim>"))), "\n\n")


def composed(summary: Column, claims: Column, cards: Column) -> Column:
    """What a reader sees of a report, as one text: the summary, the claims (array of text, unverified), the cards (array of texts)."""
    told = F.transform(claims, lambda c: F.concat(F.lit("- "), c["text"], F.when(c["unverified"], " [unverified]").otherwise("")))
    lines = F.concat(F.array(F.coalesce(summary, F.lit(""))), F.coalesce(told, F.array().cast("array<string>")), F.transform(F.coalesce(cards, F.array().cast("array<string>")), lambda c: F.concat(F.lit("- "), c)))
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
