"""Connected components of an edge table, in rounds of large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.store import forget, staged

#: Nodes that a task holds while it contracts its own edges.
HELD = 500_000


def spanning(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges (u, v), v < u, that join every node to its component's smallest, from these edges alone."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n > HELD:
            held = [spanning(*(pd.concat(held)[c].to_numpy() for c in ("u", "v")))]
            n = len(held[0])
            if n > HELD // 2:
                yield from held
                held, n = [], 0
    if held:
        yield spanning(*(pd.concat(held)[c].to_numpy() for c in ("u", "v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: every node of ``edges`` (u, v, both bigint) with the smallest node reachable.

    Loops and repeated edges are fine; no edges give no rows. A round costs two
    aggregations and two joins over at most the edges given; the number of rounds
    grows with the logarithm of a component's size. A node with very many
    neighbours is a skewed join key, never a window or a group's list.
    """
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(ends.mapInPandas(_contract, "u long, v long").distinct(), "components")
    seen = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(now).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, now = now, staged(small.distinct(), "components")
        forget(last)
        before, seen = seen, _mark(now)
        if before == seen:
            break
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
