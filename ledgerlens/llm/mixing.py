"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target: its weight's share of all words, at most ``cap``
times its own size, the excess reshared by weight. A document of a source with
ratio ``e = target / size`` is taken ``floor(e)`` times, and once more with
probability ``e - floor(e)``. Which documents are taken once more is drawn by the
cube method: three fractional documents at a time move along the null space of
the two constraints (words and documents), until one is 0 or 1; so the words and
the number of documents taken stay at their expectation. A source is dealt into
buckets by a hash, each flies alone and leaves two fractional documents at most;
these fly again together, until one bucket is left, whose at most two documents
land on the outcome nearest to the totals (which may turn one other document). A hot source is many buckets, and
equal rows are numbered before they are dealt, so no task holds more than ``bucket`` documents or so.

Defined cases: null text has size 0; empty texts are taken as any other, with 0
words; a null source is a source of its own, the last; null or repeated doc_ids
are rows like others (equal rows are interchangeable); sources without words have
target 0; extra columns are ignored; no rows give no rows. The draw depends on
``seed`` and the rows alone, not on partitions.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.store import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Fractional values this near to 0 or 1 are taken as there.
NEAR = 1e-9


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows with ``source, size``.

    One row for each source; the ranking of sources runs in one task over these rows only.
    """
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    upto, rest, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    # sources below the water level `per` (words for a weight of 1) are at their cap
    return (
        sources.withColumn("weight", weight)
        .withColumn("fill", F.lit(cap) * F.col("source_size") / F.col("weight"))
        .withColumn("per", (total - F.coalesce(F.lit(cap) * F.sum("source_size").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("per", F.first(F.when(F.col("per") <= F.col("fill"), F.col("per")), ignorenulls=True).over(whole))
        .select("source", "n_docs", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.coalesce("per", F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def flight(p: list[float], sizes: list[float], rng: random.Random) -> list[int]:
    """Moves ``p`` in place until at most two values are fractional; their places. Keeps the sums of p and p * size."""
    todo = iter([i for i, x in enumerate(p) if NEAR < x < 1 - NEAR])
    here: list[int] = []
    while True:
        while len(here) < 3:
            if (i := next(todo, None)) is None:
                return here
            here.append(i)
        a, b, c = here
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        ahead = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(here, u) if d)
        back = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(here, u) if d)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for i, d in zip(here, u):
            p[i] = min(1.0, max(0.0, p[i] + step * d))
        done = [i for i in here if not NEAR < p[i] < 1 - NEAR]
        for i in done or [min(here, key=lambda i: min(p[i], 1 - p[i]))]:
            p[i] = float(round(p[i]))
            here.remove(i)


def land(p: list[float], sizes: list[float], left: list[int]) -> None:
    """Ends the fractional places ``left`` (two at most) on the outcome nearest in words, then in documents.

    A long document left over would miss by its length, so an outcome may also turn one document already decided.
    """
    words, docs = sum(p[i] * sizes[i] for i in left), sum(p[i] for i in left)
    best, size = None, np.array(sizes)
    settled = np.ones(len(p), bool)
    settled[left] = False
    turn = np.where(settled, np.where(np.array(p) > 0.5, -size, size), 0.0)
    for k in range(2 ** len(left)):
        o = [(k >> j) & 1 for j in range(len(left))]
        off = sum(x * sizes[i] for x, i in zip(o, left)) - words
        at = int(np.abs(off + turn).argmin())
        found = min((abs(off), abs(sum(o) - docs), o, -1), (abs(off + turn[at]), abs(sum(o) - docs) + 1, o, at))
        best = found if best is None else min(best, found)
    for x, i in zip(best[2], left):
        p[i] = float(x)
    if best[3] >= 0 and settled[best[3]]:
        p[best[3]] = 1.0 - p[best[3]]


def numbered(sized: DataFrame, few: int = 1024) -> DataFrame:
    """``sized`` (doc_id, source, size) with ``twin``: 0, 1, ... among equal rows, which may be any number, a third of the table too.

    Equal rows are counted, which combines before the shuffle, and unfolded again;
    many of them in blocks of ``few`` that are dealt out first, so no task holds or makes them all.
    """
    counted = staged(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-counted")
    columns, start = ("doc_id", "source", "size"), F.lit(0).cast("bigint")
    one = counted.where(F.col("n") <= few).select(*columns, F.explode(F.sequence(start, F.col("n") - 1)).alias("twin"))
    blocks = counted.where(F.col("n") > few).select(*columns, "n", F.explode(F.sequence(start, F.floor((F.col("n") - 1) / few))).alias("block"))
    spread = blocks.repartition(F.xxhash64(*columns, "block"))
    return one.unionByName(spread.select(*columns, F.explode(F.sequence(F.col("block") * few, F.least(F.col("n"), (F.col("block") + 1) * few) - 1)).alias("twin")))


def _fly(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "spread", "doc_id"], ascending=[False, True, True], kind="stable")
        p, sizes = group["p"].tolist(), group["size"].astype(float).tolist()
        left = flight(p, sizes, random.Random(seed + 7919 * int(group["bucket"].iloc[0]) + len(p)))
        if group["buckets"].iloc[0] <= 1:
            land(p, sizes, left)
        return group.assign(p=p)

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, bucket: int = 4096, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs`` (doc_id, source, text)."""
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, cap)
    targets = staged(targets, "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < NEAR, F.round(ratio)).otherwise(ratio)
    spread = F.when(F.col("twin") == 0, F.xxhash64(F.lit(seed), "doc_id", "size")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "size", "twin"))
    rows = (
        numbered(sized).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.floor(ratio))
        .withColumn("p", ratio - F.col("copies"))
        .withColumn("spread", spread)
        .withColumn("buckets", F.ceil(F.col("n_docs") / bucket))
        .withColumn("bucket", F.pmod("spread", F.col("buckets")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "p", "spread", "bucket", "buckets")
    )
    fly = _fly(seed)
    most = targets.agg(F.ceil(F.max("n_docs") / bucket)).first()[0] or 0
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest = [rows.where(~fractional)], rows.where(fractional)
    for level in range(64):
        if level and most <= 1:
            break
        if level:
            most = math.ceil(2 * most / bucket)
            rest = rest.withColumn("buckets", F.ceil(2 * F.col("buckets") / bucket)).withColumn("bucket", F.pmod(F.xxhash64("spread", F.lit(level)), F.col("buckets")))
        flown = staged(rest.groupBy("source", "bucket").applyInPandas(fly, rows.schema), "mix-flown")
        done.append(flown.where(~fractional))
        rest = flown.where(fractional)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("copies") + F.col("p").cast("bigint")) * F.col("size")).alias("taken"))
