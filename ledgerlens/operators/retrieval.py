"""Exact vector search, diversification and top-up."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.staging import kept

#: Results, their doubling for coverage questions, the most, and the pool for diversification.
K, MOST, POOL, RELEVANCE = 6, 24, 3, 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Cosine distance; null for zero vectors."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def searchable(chunks: DataFrame, doc_id: str | None = None) -> DataFrame:
    """What a question may meet: the live corpus, or one pinned document, whichever corpus it is of."""
    return chunks.where(F.col("corpus") == "live") if doc_id is None else chunks.where(F.col("doc_id") == doc_id)


def by_id(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of these ids (chunk_id)."""
    return chunks.join(wanted.select("chunk_id"), "chunk_id", "left_semi")


def coverage_k(k: int = K, coverage: bool = True) -> int:
    return min(k * 2, MOST) if coverage else k


#: Queries that are sent to the tasks at once; queries and vectors that a task multiplies at once (2 MB of distances); pairs that wait to be merged.
QUERIES, AT_ONCE, ROWS, WAITING = 20_000, 256, 1024, 200_000


def section_key(section: Column) -> Column:
    """A section's name as sections are compared; null is the empty one."""
    return F.lower(F.trim(F.coalesce(section, F.lit(""))))


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Apart:
    """Which sections' rows a query must not meet: those that it names, and rows of none."""

    def __init__(self, sections: pd.Series):
        self.codes = {s: i for i, s in enumerate(sorted({s for own in sections for s in own}))}
        self.met = np.ones((len(sections), len(self.codes) + 1), bool)
        for at, own in enumerate(sections):
            self.met[at, [self.codes[s] for s in own]] = False

    def of(self, sections: pd.Series) -> np.ndarray:
        """For each row its column in ``met``; -2 for rows of no section."""
        return np.array([self.codes.get(s, len(self.codes)) if s else -2 for s in sections], np.int64)


class _Best:
    """The k nearest rows that each query of a scope has met so far. What it holds is bounded by the queries, however many rows are equally far."""

    def __init__(self, n: int, k: int):
        self.k, self.most = k, max(WAITING, n * k)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        #: How far the k-th is; a row beyond it is none of the nearest.
        self.limit = np.full(n, np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        if len(at):
            self.found.append((at, ids, far))
            self.waiting += len(at)
            if self.waiting > self.most:
                self.merge()

    def merge(self) -> None:
        if self.waiting:
            at, ids, far = map(np.concatenate, zip(*self.found))
            order = np.lexsort((ids, far, at))
            at, ids, far = at[order], ids[order], far[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            self.limit[at[place == self.k - 1]] = far[place == self.k - 1]
            self.found = [tuple(x[place < self.k] for x in (at, ids, far))]
            self.waiting = 0


def _nearest(queries: pd.DataFrame, k: int):
    """Of each task's rows (vec_id, scope, embedding, section) the k nearest to each query of their scope."""
    asked = {}
    for scope, own in queries.groupby("scope", dropna=False):
        asked[scope] = own["query_id"].to_numpy(), _unit(own["query"]), _Apart(own["sections"]) if "sections" in own else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for batch in batches:
            for scope, rows in batch.groupby("scope", dropna=False):
                if scope not in asked:
                    continue
                _, q, apart = asked[scope]
                v, ids = _unit(rows["embedding"]), rows["vec_id"].to_numpy()
                codes = apart.of(rows["section"]) if apart else None
                own = best.setdefault(scope, _Best(len(q), k))
                for j in range(0, len(v), ROWS):
                    for i in range(0, len(q), AT_ONCE):
                        far = q[i : i + AT_ONCE] @ v[j : j + ROWS].T
                        np.round(np.subtract(1, far, out=far), 12, out=far)  # equal vectors are equally far, however they were multiplied
                        if apart:
                            here = codes[j : j + ROWS]
                            far[~(apart.met[i : i + AT_ONCE, np.maximum(here, 0)] & (here >= 0))] = np.inf
                        last = own.limit[i : i + AT_ONCE]
                        if np.isinf(last).any():
                            least = min(k, far.shape[1]) - 1
                            last = np.minimum(last, np.partition(far, least, axis=1)[:, least])
                        at, row = np.nonzero((far <= last[:, None]) & np.isfinite(far))
                        own.add(at + i, ids[row + j], far[at, row])
                    if np.isinf(own.limit).any():
                        own.merge()
        for scope, own in best.items():
            own.merge()
            for at, got, far in own.found:
                for i in range(0, len(at), 100_000):
                    part = slice(i, i + 100_000)
                    yield pd.DataFrame({"query_id": asked[scope][0][at[part]], "vec_id": got[part], "distance": far[part]})

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERIES) -> DataFrame:
    """``query_id, vec_id, distance, place``: for each query its k nearest vectors within its scope, by cosine distance; ties by id.

    ``vectors``: vec_id, scope, embedding; ``queries``: query_id, scope, query, of any
    number. Every query meets every row of its scope (an exact search). Queries come in
    blocks of ``block``, so what is sent to the tasks is bounded; a task keeps k rows for
    each query, which are merged after one shuffle. Zero and null vectors, and vectors
    of another length than the queries', are met by none. If queries have ``sections``,
    names compared by ``section_key``, they meet rows of other sections only (``section``
    of the vectors; rows of none are met by no such query): left out before the k nearest
    are chosen, so none of the k is lost to them.
    """
    usable = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0)
    apart = "sections" in queries.columns
    asked = queries.where(usable("query")).select("query_id", "scope", "query", *([F.transform(F.coalesce("sections", F.array().cast("array<string>")), section_key).alias("sections")] if apart else []))
    sizes = asked.agg(F.count("*").alias("n"), F.min(F.size("query")).alias("a"), F.max(F.size("query")).alias("b")).first()
    if sizes["n"] and sizes["a"] != sizes["b"]:
        raise ValueError("queries of one search have one length")
    rows = vectors.where(usable("embedding") & (F.size("embedding") == (sizes["a"] or 0))).select("vec_id", "scope", "embedding", *([section_key(F.col("section")).alias("section")] if apart else []))
    blocks = max(1, math.ceil(sizes["n"] / block))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, distance double"
    found = []
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        found.append(rows.mapInPandas(_nearest(some, k), schema))
        if blocks > 1:
            found[-1] = kept(found[-1], "nearest")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return reduce(DataFrame.union, found).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mmr(candidates: DataFrame, k: int = K, relevance: float = RELEVANCE) -> DataFrame:
    """Greedy choice of relevant rows that resemble the chosen ones least; at most POOL * MOST rows for each query.

    ``candidates``: query_id, vec_id, place, distance, embedding, and ``k`` where queries differ in it. Sequential by nature, so each query's pool is one pandas group.
    """
    most = k

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        k = int(group["k"].iloc[0]) if "k" in group else most
        x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1.0)
        rel, redundant = 1 - group["distance"].to_numpy(), np.zeros(len(x))
        left, picked = list(range(len(x))), []
        if len(x) <= k:
            picked, left = left, []
        while left and len(picked) < k:
            best = max(left, key=lambda i: (relevance * rel[i] - (1 - relevance) * redundant[i], -i))
            left.remove(best)
            redundant = x @ x[best] if not picked else np.maximum(redundant, x @ x[best])
            picked.append(best)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "vec_id": group["vec_id"].to_numpy()[picked], "pick": np.arange(1, len(picked) + 1)})

    columns = ["query_id", "vec_id", "place", "distance", "embedding", *(["k"] if "k" in candidates.columns else [])]
    ids = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in ("query_id", "vec_id"))
    return candidates.select(*columns).groupBy("query_id").applyInPandas(choose, f"{ids}, pick long")


def top_up(rounds: DataFrame, k: int = K) -> DataFrame:
    """``rounds``: query_id, round, place, vec_id. The last round's results, filled up to k with earlier ones not among them."""
    last = Window.partitionBy("query_id")
    ranked = rounds.withColumn("_last", F.max("round").over(last)).withColumn("turn", F.when(F.col("round") == F.col("_last"), 0).otherwise(F.col("round")))
    first = ranked.groupBy("query_id", "vec_id").agg(F.min(F.struct("turn", "place")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "vec_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "vec_id", "place", F.col("at.turn").alias("turn"))


#: What stands before a text that is embedded, by model family, for queries and for passages.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}


def prefixed(text: Column, model: str, query: bool) -> Column:
    """The text as this model's family wants it."""
    mark = next((p for family, p in PREFIXES.items() if family in model.lower()), ("", ""))
    return F.concat(F.lit(mark[0] if query else mark[1]), text)


def embedded(texts: DataFrame, embed, model: str, query: bool = False, batch: int = 128) -> DataFrame:
    """``texts`` (text) with ``embedding`` of length 1: ``embed`` is called with at most ``batch`` prefixed texts at once, one call at a time in a task."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for at in range(0, len(s), batch):
                x = np.asarray(embed(s.iloc[at : at + batch].tolist()), np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                out += [row.astype(np.float32) for row in x / np.where(n > 0, n, 1)]
            yield pd.Series(out, dtype=object)

    return texts.withColumn("embedding", run(prefixed(F.coalesce("text", F.lit("")), model, query)))
