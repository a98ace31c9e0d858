"""A benchmark's inputs: questions with their documents, scopes, and documents whose evidence is nowhere found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import matching, numbering


def documents(questions: DataFrame, meta: DataFrame, ciks: DataFrame, doc_types: tuple[str, ...] = ("10k",)) -> DataFrame:
    """``doc_name, company, doc_type, fy, cik`` of the documents that are asked about, of these types.

    ``questions``: doc_name; ``meta``: doc_name, company, doc_type, doc_period; ``ciks``: name, cik. An unresolved company has a null cik.
    """
    asked = questions.select("doc_name").distinct()
    own = meta.where(F.col("doc_type").isin(*doc_types)).join(asked, "doc_name", "left_semi")
    return own.join(ciks.withColumnRenamed("name", "company"), "company", "left").select("doc_name", "company", "doc_type", F.col("doc_period").cast("int").alias("fy"), "cik")


def cases(questions: DataFrame, docs: DataFrame, question_types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Questions (case_id, doc_name, question_type, ...) about these documents; of these types, if any are given, and the first ``limit`` by id."""
    own = questions.join(docs.select("doc_name"), "doc_name", "left_semi")
    if question_types:
        own = own.where(F.col("question_type").isin(*question_types))
    return own if limit is None else own.orderBy("case_id").limit(limit)


def scopes(docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """``doc_name, scope_cik, scope_accn``: figures of a fetched document come from its filing alone; others have no scope."""
    return docs.join(fetched.select("doc_name", F.col("accession").alias("scope_accn")), "doc_name", "left").select("doc_name", F.when(F.col("scope_accn").isNotNull(), F.col("cik")).alias("scope_cik"), "scope_accn")


def suspects(cases_: DataFrame, evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_name, n_cases, n_found, suspect``: a document is suspect if no question's evidence is in it, or it was not fetched.

    ``cases_``: case_id, doc_name; ``evidence``: case_id, text; ``texts``: doc_name, text.
    """
    pieces = evidence.join(cases_.select("case_id", "doc_name"), "case_id").withColumn("item_id", F.xxhash64("case_id", "text"))
    met = matching.containment(pieces.select("item_id", "text"), texts.select(F.col("doc_name").alias("doc_id"), "text"))
    found = pieces.join(met.withColumnRenamed("doc_id", "doc_name"), ["item_id", "doc_name"], "left_semi").select("case_id").distinct().withColumn("hit", F.lit(True))
    out = cases_.join(found, "case_id", "left").groupBy("doc_name").agg(F.count("*").alias("n_cases"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_found"))
    return out.withColumn("suspect", F.col("n_found") == 0)


def with_exhibits(main: DataFrame, exhibits: DataFrame) -> DataFrame:
    """A document's text with its exhibits' after it, in their order, a blank line between. ``main``: doc_name, text; ``exhibits``: doc_name, pos, text."""
    more = exhibits.groupBy("doc_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("more"))
    return main.join(more, "doc_name", "left").select("doc_name", F.array_join(F.concat(F.array("text"), F.coalesce("more", F.array().cast("array<string>"))), "\n\n").alias("text"))


def ordered(results: DataFrame, key: str) -> DataFrame:
    """Results with their place by id, for a stable report."""
    return numbering.numbered(results, key)


def section_place(section: Column, order: tuple[str, ...]) -> Column:
    """A digest section's fixed place, whichever is ready first; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), section), F.lit(0)), F.lit(len(order) + 1))
