"""From raw documents to a weighted training mixture, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
with the columns of ``documents``; the last returns the mixture: for each document
how many words of it the mix takes. ``run`` writes every stage's result as Parquet
to the shared folder and reads it back for the next, so a lost executor repeats
one stage at most.

Defined cases, of every stage: nulls in any column are kept as they are, a null text
counts as empty; very long texts are read whole; extra columns, also of clashing
names, are ignored and not returned; repeated rows and ties give the same result on
every run; no rows give no rows. Without labels or a benchmark nothing is rejected
by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, mixing, quality, similar_texts, suffix_dedup
from ledgerlens.llm.queries import fold_of, table
from ledgerlens.llm.store import small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of probable quality 0 go. The classifier learns from ``labels`` outside its held-out fold.

    A null or empty text has the score of an empty chunk; with labels of one kind only all documents stay or go.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1)
    net = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs.select(*COLUMNS), net).where("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of exact similarity 0.8 or more over five-word shingles, one row stays: the smallest doc_id's.

    Texts without words are one group; rows without a doc_id come after those with one; of repeated rows one stays.
    """
    small_batches(spark)
    return similar_texts.keep_one_row(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that also occur elsewhere, in another document or the same, go from every text.

    Words are compared whatever white space is between them. A text that loses all its
    words goes; others stay, null and empty ones too, with ``n_chars`` of what is left.
    """
    small_batches(spark)
    return suffix_dedup.remove(docs.select(*COLUMNS), suffix_dedup.WORDS).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts stay."""
    small_batches(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture over what is left; a null source is one of its own, a text without words is taken with 0 words."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("mixture", mix_sources),
]

#: No SQL: fingerprints, suffix arrays, the network and the cube method are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
