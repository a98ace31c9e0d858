"""Questions to text chunks: embedding of chunks and questions, and search by them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval
from ledgerlens.sources.staging import kept

#: What the offline provider calls a word, in texts whose ASCII letters are lower-cased.
WORD = "[a-z0-9]+"


class HashedWords:
    """An offline embedding provider: a text's words, each thrown into one of ``dims`` places with a sign by its MD5.

    A stand-in for a model behind the same call, so that search runs, and can be checked, without one.
    """

    model = "hashed-words"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), self.dims)), {}
        for row, text in zip(out, texts):
            for word in re.findall(WORD.encode(), text.encode("utf-8", "replace").lower()):
                if word not in known:
                    digest = hashlib.md5(word).hexdigest()
                    known[word] = int(digest[:4], 16) % self.dims, 1 if int(digest[4], 16) < 8 else -1
                at, sign = known[word]
                row[at] += sign
        return out


def index(chunks: DataFrame, embed: Callable, model: str) -> DataFrame:
    """``chunks`` (chunk_id, doc_id, ticker, section, corpus, text) with ``embedding``: what is made once, on ingestion."""
    return retrieval.embedded(chunks.select("chunk_id", "doc_id", "ticker", "section", "corpus", "text"), embed, model)


def retriever(indexed: DataFrame, about: DataFrame, embed: Callable, model: str, relevance: float = retrieval.RELEVANCE) -> Callable[[DataFrame], DataFrame]:
    """A function from (query_id, query, k) to the k chunks that each query is answered from: ``query_id, chunk_id, place, section, text``.

    ``about``: query_id, ticker, and if given ``doc_id`` (the one document that a question
    is held to, of whichever corpus; else it meets its ticker's live chunks) and ``coverage``
    (a question that wants breadth: chosen from three times as many, by relevance and
    unlikeness). One search serves all queries of a round, at the largest k that one asks for.
    """
    held, wide = ("doc_id" in about.columns), ("coverage" in about.columns)
    live, pinned = F.concat(F.lit("live "), "ticker"), F.concat(F.lit("doc "), "doc_id")
    known = about.select(
        "query_id",
        (F.coalesce(F.concat(F.lit("doc "), F.col("doc_id")), live) if held else live).alias("scope"),
        (F.coalesce("coverage", F.lit(False)) if wide else F.lit(False)).alias("coverage"),
    )
    scopes = F.array_compact(F.array(F.when(F.col("corpus") == "live", live), pinned if held else F.lit(None).cast("string")))
    rows = indexed.select(F.col("chunk_id").alias("vec_id"), F.explode(scopes).alias("scope"), "embedding")

    def retrieve(asked: DataFrame) -> DataFrame:
        q = asked.select("query_id", "k", F.col("query").alias("text")).join(known, "query_id")
        q = kept(retrieval.embedded(q, embed, model, query=True).select("query_id", "k", "scope", "coverage", F.col("embedding").alias("query")), "asked")
        pool = F.col("k") * F.when(F.col("coverage"), retrieval.POOL).otherwise(1)
        most = q.agg(F.max(pool)).first()[0] or 1
        found = retrieval.topk(rows, q.select("query_id", "scope", "query"), most).join(q.select("query_id", "k", "coverage"), "query_id").where(F.col("place") <= pool)
        found = kept(found.select("query_id", "vec_id", "distance", "place", "k", "coverage"), "found")
        flat = found.where("not coverage").select("query_id", "vec_id", F.col("place").cast("long").alias("place"))
        broad = found.where("coverage").join(indexed.select(F.col("chunk_id").alias("vec_id"), "embedding"), "vec_id")
        chosen = flat.unionByName(retrieval.mmr(broad, relevance=relevance).withColumnRenamed("pick", "place"))
        texts = indexed.select(F.col("chunk_id").alias("vec_id"), "section", "text")
        return chosen.join(texts, "vec_id").select("query_id", F.col("vec_id").alias("chunk_id"), F.col("place").cast("int").alias("place"), "section", "text")

    return retrieve
