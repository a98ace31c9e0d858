"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has its own
codebook (k-means on a bounded sample of rows), so a vector's cell is a pair of
codewords on a product grid. Codewords are as many as keep about ``OCCUPANCY`` vectors
in a cell, so the grid grows with the number of rows. Every distinct vector is
filed in its nearest cell and asks the cells that a multi-sequence traversal visits
first: pairs of codewords in order of summed squared distances. How many it visits
is set on the true partners that sampled vectors have among all rows: enough that of
at least ``recall`` of the groups every partner is met, then doubled, as a margin. A
group weighs 1 whatever its size, so hot groups of copies do not hide small ones.
With ``exact`` a vector asks every cell that can hold a partner by the distance of
its codewords' borders, so no link is missed, at the price of more visits. Every
match's cosine is verified in double precision, and a link that one side meets
counts for both.

Equal vectors collapse to one row with a count before anything is filed. A cell
of many vectors is dealt into blocks of ``block``, each a group of its own, and a
block is compared with its askers batch by batch, so no task holds a whole cell.
A block gives counts and a spanning forest of its links, not its pairs.

Defined cases: null, empty and zero vectors and those with null or non-finite
components link with nothing (0 links, their own component, kept); vectors of
different length never link, and are indexed by length; a cosine of exactly the
least links; repeated vec_ids are rows like others; a null vec_id is a row without
a name, and kept if its component has no other; extra columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components, spanning
from ledgerlens.llm.store import forget, staged

COSINE = 0.95
#: Vectors in a cell of the grid, codewords of a half, sampled rows for each codeword and at least.
OCCUPANCY, FEWEST, MOST, EACH, LEAST = 16, 32, 1024, 32, 4000
#: Sampled vectors whose partners are looked for among all rows.
QUERIES = 2000


def codewords(rows: int) -> int:
    """For each half."""
    return min(MOST, max(FEWEST, math.ceil(math.sqrt(rows / OCCUPANCY))))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        total = np.zeros_like(c)
        total[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def visits(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """Multi-sequence traversal for a batch: of each row the first ``cells`` cells by the sum of both distances.

    A traversal reaches the pair of the i-th and j-th nearest codewords only after the
    ``i * j`` pairs at or below both, so that staircase holds all it can visit.
    """
    k1, k2 = first.shape[1], second.shape[1]
    cells = min(cells, k1 * k2)
    a, b = np.argsort(first, axis=1, kind="stable")[:, :cells], np.argsort(second, axis=1, kind="stable")[:, :cells]
    i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
    stairs = (i + 1) * (j + 1) <= cells
    i, j = i[stairs], j[stairs]
    total = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
    if cells < total.shape[1]:
        some = np.argpartition(total, cells - 1, axis=1)[:, :cells]
        some.sort(axis=1)
    else:
        some = np.broadcast_to(np.arange(total.shape[1]), total.shape)
    some = np.take_along_axis(some, np.argsort(np.take_along_axis(total, some, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(a, i[some], 1) * k2 + np.take_along_axis(b, j[some], 1)


def borders(d: np.ndarray, book: np.ndarray) -> np.ndarray:
    """At least how far each row (``d``: squared distances to the codewords) is, squared, from each codeword's region."""
    own = d.argmin(1)
    gap = 2 * np.sqrt(distances(book, book))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(gap > 0, (d - d[np.arange(len(d)), own][:, None]) / gap, 0.0)
    return np.maximum(away, 0) ** 2


class Index:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, k: int = FEWEST, recall: float = 0.99, cosine: float = COSINE, seed: int = 0, exact: bool = False):
        half = sample.shape[1] // 2
        self.half, self.cosine, self.recall, self.exact = half, cosine, recall, exact
        self.books = [kmeans(sample[:, :half], k, seed), kmeans(sample[:, half:], k, seed + 1)]
        self.sizes = tuple(map(len, self.books))
        self.cells = self.sizes[0] * self.sizes[1]

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.sizes[1] + nearest(x[:, self.half :], self.books[1])

    def asked(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each row the cells, in order of visit."""
        d1, d2 = self.apart(x)
        if not self.exact:
            return list(visits(d1, d2, self.cells))
        far = borders(d1, self.books[0])[:, :, None] + borders(d2, self.books[1])[:, None, :]
        near = far.reshape(len(x), -1) <= 2 * (1 - self.cosine) + 1e-9  # the squared distance of vectors of length 1
        return [np.flatnonzero(row) for row in near]

    def calibrate(self, queries: np.ndarray, met: pd.DataFrame) -> None:
        """Sets ``cells``; ``met`` (query, cell, n): in which cells the true partners of ``queries`` are, without themselves."""
        if not len(met):  # none at all: as if each had one at exactly the least cosine
            noise = np.random.default_rng(0).normal(size=queries.shape)
            noise -= (noise * queries).sum(1)[:, None] * queries
            near = self.cosine * queries + math.sqrt(1 - self.cosine**2) * noise / np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
            met = pd.DataFrame({"query": np.arange(len(queries)), "cell": self.cell(near), "n": 1})
        worst, weight = [], []
        d1, d2 = self.apart(queries)
        for i, own in met.groupby("query"):
            total = (d1[i][:, None] + d2[i]).ravel()
            worst.append(int((total <= total[own["cell"]].max()).sum()))
            weight.append(1 / (1 + own["n"].sum()))
        order = np.argsort(worst, kind="stable")
        share = np.cumsum(np.array(weight)[order])
        needed = worst[order[np.searchsorted(share, self.recall * share[-1])]]
        self.cells = min(self.sizes[0] * self.sizes[1], max(4, 2 * needed))


def unit(vectors) -> np.ndarray | None:
    return vectors / np.sqrt((vectors * vectors).sum(-1, keepdims=True))


def _filed(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(16, min(2000, 4_000_000 // (index.sizes[0] * index.sizes[1] if index.exact else 2 * index.cells)))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"vec": part["vec"], "copies": part["copies"], "vector": part["vector"], "cell": index.cell(x), "asks": index.asked(x)})

    return run


def _compared(cosine: float, batch: int = 4096):
    """Rows sorted by group, members before askers; counts (kind 0: vec, links) and forest edges (kind 1: u, v).

    A link counts for the asker, and for the member too if that does not ask the asker's own cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, members = None, None
        for rows in batches:
            keys = rows[["cell", "part"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
                key = tuple(keys[lo])
                if key != group:
                    group, members = key, None
                part = rows.iloc[lo:hi]
                asks = part["asks"].to_numpy(bool)
                if not asks.all():
                    own = part[~asks]
                    x = unit(np.stack(own["vector"].to_numpy()).astype(np.float64))
                    wanted = np.empty(len(own), object)
                    wanted[:] = [np.asarray(w) for w in own["wanted"]]
                    new = (own["vec"].to_numpy(), own["copies"].to_numpy(), x, wanted)
                    members = new if members is None else tuple(np.concatenate(p) for p in zip(members, new))
                part = part[asks]
                if members is None or not len(part):
                    continue
                ids, copies, m, wanted = members
                counts, us, vs, back = [], [], [], np.zeros(len(ids), np.int64)
                for at in range(0, len(part), batch):
                    q = part.iloc[at : at + batch]
                    qid = q["vec"].to_numpy()
                    near = (unit(np.stack(q["vector"].to_numpy()).astype(np.float64)) @ m.T >= cosine) & (qid[:, None] != ids)
                    n = near @ copies
                    counts.append(pd.DataFrame({"a": qid, "b": n})[n > 0])
                    i, j = np.nonzero(near)
                    alone = _unasked(wanted, j, q["own"].to_numpy()[i])
                    np.add.at(back, j[alone], q["copies"].to_numpy()[i[alone]])
                    us.append(qid[i])
                    vs.append(ids[j])
                    if sum(map(len, us)) > 1_000_000:
                        e = spanning(np.concatenate(us), np.concatenate(vs))
                        us, vs = [e["u"].to_numpy()], [e["v"].to_numpy()]
                counts.append(pd.DataFrame({"a": ids, "b": back})[back > 0])
                yield pd.concat(counts).assign(kind=0)[["kind", "a", "b"]]
                if us and sum(map(len, us)):
                    e = spanning(np.concatenate(us), np.concatenate(vs))
                    yield pd.DataFrame({"kind": 1, "a": e["u"], "b": e["v"]})

    return run


def _unasked(wanted: np.ndarray, j: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each pair whether member ``j`` doesn't ask ``cell``."""
    out = np.ones(len(j), bool)
    order = np.argsort(j, kind="stable")
    cuts = np.flatnonzero(np.diff(j[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            out[some] = ~np.isin(cell[some], wanted[j[some[0]]])
    return out


def _partners(index: Index, ids: np.ndarray, queries: np.ndarray, block: int = 2000):
    """How many partners each query has in each cell, by brute force over the rows (vec, vector)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                x = unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
                q, row = np.nonzero((queries @ x.T >= index.cosine) & (ids[:, None] != part["vec"].to_numpy()))
                found = pd.DataFrame({"query": q, "cell": index.cell(x)[row]})
                yield found.groupby(["query", "cell"]).size().reset_index(name="n")

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Adds ``linkable``: the vector is there, finite and not zero."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    return vectors.withColumn("linkable", F.coalesce(~bad & nonzero, F.lit(False)))


def fit(distinct: DataFrame, dims: int, k: int | None = None, recall: float = 0.99, cosine: float = COSINE, seed: int = 42, exact: bool = False) -> Index:
    """Codebooks on at most ``max(LEAST, EACH * k)`` distinct vectors, drawn by a hash; they come to the driver.

    The partners of the first ``QUERIES`` of them are looked for among all rows, by brute force in blocks.
    """
    some = distinct.where(F.size("vector") == dims)
    k = k or codewords(some.count())
    got = some.orderBy(F.xxhash64("vec", F.lit(seed)), "vec").limit(max(LEAST, EACH * k)).select("vec", "vector").collect()
    sample = unit(np.array([r["vector"] for r in got], np.float64))
    index = Index(sample, k, recall, cosine, exact=exact)
    if not exact:
        queries = sample[:QUERIES]
        met = some.select("vec", "vector").mapInPandas(_partners(index, np.array([r["vec"] for r in got[:QUERIES]]), queries), "query int, cell int, n long")
        index.calibrate(queries, met.groupBy("query", "cell").agg(F.sum("n").alias("n")).toPandas())
    return index


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, k: int | None = None, recall: float = 0.99, block: int = 2048, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding).

    An index is built for each length of vectors, one after another; a table of embeddings has one, or a few.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    good = rows.where("linkable").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    distinct = staged(good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.count("vec_id").alias("named")).withColumn("vec", F.xxhash64("vector")), "vectors")
    links, edges = [], []
    for dims in sorted(r[0] for r in distinct.select(F.size("vector")).distinct().collect()):
        some = distinct.where(F.size("vector") == dims)
        index = fit(some, dims, k, recall, cosine, exact=exact)
        filed = staged(some.select("vec", "copies", "vector").mapInPandas(_filed(index), "vec long, copies long, vector array<double>, cell long, asks array<long>"), "filed")
        parts = filed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))  # a row for each cell of the grid at most
        member = filed.join(parts, "cell").select("cell", F.pmod("vec", "parts").alias("part"), F.lit(False).alias("asks"), "vec", "copies", "vector", F.lit(-1).cast("bigint").alias("own"), F.col("asks").alias("wanted"))
        asker = (
            filed.select(F.explode("asks").alias("cell"), "vec", "copies", "vector", F.col("cell").alias("own"))
            .join(parts, "cell")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cell", F.col("part").cast("bigint").alias("part"), F.lit(True).alias("asks"), "vec", "copies", "vector", "own", F.lit(None).cast("array<bigint>").alias("wanted"))
        )
        met = member.unionByName(asker).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInPandas(_compared(cosine), "kind int, a long, b long")
        met = staged(met, "met")
        forget(filed)
        links.append(met.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")))
        edges.append(met.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    if not links:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted, joined = links[0], edges[0]
    for c, e in zip(links[1:], edges[1:]):
        counted, joined = counted.union(c), joined.union(e)
    labels = components(joined)
    named = distinct.select("vec", "first_id", "copies").join(counted.withColumnRenamed("a", "vec"), "vec", "left").join(labels, F.col("vec") == F.col("node"), "left")
    named = named.select("vec", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "vec").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "label").select("vec", "n_links", "component_id")
    out = good.select("vec_id", F.xxhash64("vector").alias("vec")).join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("linkable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
