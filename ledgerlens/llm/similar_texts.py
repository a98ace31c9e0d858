"""Near-duplicates at a given shingle similarity: SimHash by multi-index hashing, verified by exact Jaccard similarity.

Two texts whose word shingles have Jaccard similarity s differ, in a SimHash, in
about ``acos(2s / (1 + s)) / pi`` of the bits: 15 % at 0.8, up to 1.27 times that for
a few shingles. The fingerprint has ``WORDS`` times 64 bits. Bits only make
candidates, within four standard deviations (``candidate_bits``); a link is a pair
whose exact similarity is ``similarity`` or more.

Multi-index hashing has two levels. Fingerprints meet in a task if they agree in a
short coarse segment: its bits follow the logarithm of their number, so a task
holds about ``HELD`` at any size, and their tables are as many as it takes for two
texts of exactly the least similarity to meet with probability ``recall``. A task
files what it holds under finer segments, looks up the Hamming ball of radius 1
around each, and compares complete fingerprints of what it finds; those tables,
which cost no shuffle, are set to the same probability. A task gives a spanning
forest of its candidates, never its pairs.

The components of the candidates hold every link. The distinct shingle sets of a
component meet in one task, once each, where every pair that may reach
``similarity`` is looked at until both are known to be joined. Coarse groups of over
``HELD`` fingerprints and components of over ``SHINGLES`` shingles are dealt out in
blocks that meet pairwise (``blocks``).

Defined cases: null text is empty; texts with fewer words than a shingle hash the
whole word sequence; texts without words have no shingles and link with each
other; texts of any length are read whole; ties go to the smallest doc_id, nulls
last; repeated rows share a component; null doc_ids are kept as rows and never
name a component; extra columns are ignored by ``near_duplicates`` and kept by
``keep_one_row``; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import dealt, groups
from ledgerlens.llm.components import components, spanning
from ledgerlens.llm.simhash import shingle_hashes
from ledgerlens.llm.store import forget, sieve, staged, unused

SHINGLE, SIMILARITY, WORDS, RECALL = 5, 0.8, 8, 0.999
#: Shingles mixed at once; rows that are added up in one byte.
BLOCK, _ADDED = 1 << 12, 255
#: Texts of at most so many shingles differ in up to ``SPREAD`` times the bits.
SHORT, SPREAD = 64, 1.27
#: Fingerprints, and shingles, that a task holds at once.
HELD, SHINGLES = 1 << 15, 1 << 21


def apart(similarity: float) -> float:
    """The share of bits in which texts of this Jaccard similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def candidate_bits(similarity: float = SIMILARITY, bits: int = 64 * WORDS, short: bool = False, deviations: float = 4) -> int:
    """How many of ``bits`` may differ in a candidate."""
    p = min(0.5, apart(similarity) * (SPREAD if short else 1))
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def meets(width: int, radius: int, similarity: float = SIMILARITY) -> float:
    """The probability that segments of so many bits differ in ``radius`` at most."""
    p = min(0.5, apart(similarity) * SPREAD)
    return sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(radius + 1))


def segments(width: int, radius: int, similarity: float, recall: float, seed: int, words: int = WORDS) -> list[np.ndarray]:
    """Bit places of each table's segment, cut from permutations of the bits: as many as ``recall`` takes."""
    number = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(1 - 1e-12, meets(width, radius, similarity)))))
    rng, out = np.random.default_rng(seed), []
    while len(out) < number:
        places = rng.permutation(64 * words)
        out += [places[i : i + width] for i in range(0, len(places) - width + 1, width)]
    return out[:number]


def coarse(rows: int, similarity: float = SIMILARITY, recall: float = RECALL, held: int = HELD) -> list[np.ndarray]:
    """The segments by which ``rows`` fingerprints are dealt out to tasks."""
    return segments(max(3, math.ceil(math.log2(max(1, rows) / held))), 0, similarity, recall, 42)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_fingerprint(text: str | None, shingle: int = SHINGLE, words: int = WORDS) -> bytes:
    """A bit is set if it is set in over half of the distinct shingles' hashes; zero without words."""
    return set_fingerprint(shingle_set(text, shingle), words)


def set_fingerprint(every: np.ndarray, words: int = WORDS) -> bytes:
    counts = np.zeros(64 * words, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(every), BLOCK):
        x = every[start : start + BLOCK, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for at in range(0, len(x), _ADDED):
            bits = np.unpackbits(x[at : at + _ADDED].view(np.uint8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(every)).tobytes()


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)


def _values(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def _fps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


class Near:
    """Fingerprints and set sizes; whether two are candidates."""

    def __init__(self, fps: np.ndarray, size: np.ndarray, similarity: float):
        self.fps, self.size, self.similarity = fps, size, similarity
        self.wide, self.near = candidate_bits(similarity, short=True), candidate_bits(similarity)
        self.first = candidate_bits(similarity, 128, short=True, deviations=6)
        self.least = SHORT / similarity

    def candidates(self, i: np.ndarray, j) -> np.ndarray:
        """For each pair; ``j`` is an array too, or one place."""
        a, b = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        ok = a >= self.similarity * b - 1e-9
        at = np.flatnonzero(ok)
        for cols, bound in ((slice(0, 2), self.first), (slice(0, None), None)):
            other = self.fps[j, cols] if np.isscalar(j) else self.fps[j[at], cols]
            apart_by = np.bitwise_count(self.fps[i[at], cols] ^ other).sum(1, dtype=np.int64)
            fine = apart_by <= (np.where(a[at] <= self.least, self.wide, self.near) if bound is None else bound)
            ok[at[~fine]] = False
            at = at[fine]
        return ok

    def forest(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that join whatever candidates are among the places ``left``; looks at each place once for each other it finds no pair for."""
        u, v, todo = [], [], []
        while len(left):
            if not todo:
                todo, left = [int(left[0])], left[1:]
                continue
            x = todo.pop()
            near = self.candidates(left, x)
            found, left = left[near], left[~near]
            todo += found.tolist()
            u.append(np.full(len(found), x))
            v.append(found)
        return (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))


#: Pairs compared at once; equal segments of more rows are joined as a forest.
PAIRS, RUN = 200_000, 512


def near(fps: np.ndarray, size: np.ndarray, similarity: float = SIMILARITY, recall: float = RECALL) -> pd.DataFrame:
    """Places u, v that join all candidates among these fingerprints: exact segments filed, Hamming balls of radius 1 looked up."""
    n, all_of = len(fps), Near(fps, size, similarity)
    if n <= 48:
        u, v = all_of.forest(np.arange(n))
        return spanning(u, v)
    width = min(20, max(4, math.ceil(math.log2(n)) - 1))
    bits, label, us, vs = _bits(fps), np.arange(n), [], []

    def joined() -> pd.DataFrame:
        """What is joined so far; ``label`` says it for each place."""
        e = spanning(np.concatenate([np.flatnonzero(label != np.arange(n)), *us]), np.concatenate([label[label != np.arange(n)], *vs]))
        us.clear()
        vs.clear()
        label[e["u"]] = e["v"]
        return e

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        us.append(i)
        vs.append(j)

    for own in segments(width, 1, similarity, recall, 7):
        value = _values(bits, own)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], value[order[1:]] != value[order[:-1]]]))
        count, there = np.diff(np.append(first, n)), value[order[first]]
        a, b = [np.flatnonzero(count > 1)], [np.flatnonzero(count > 1)]
        for bit in (1 << np.arange(width)).tolist():
            asks = np.flatnonzero(there & bit == 0)
            at = np.minimum(np.searchsorted(there, there[asks] | bit), len(there) - 1)
            hit = there[at] == there[asks] | bit
            a.append(asks[hit])
            b.append(at[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        large = np.maximum(count[a], count[b]) > RUN  # a run itself comes before it meets others
        for x, y in zip(a[large].tolist(), b[large].tolist()):
            rows = np.concatenate([order[first[r] : first[r] + count[r]] for r in {x, y}])
            if (label[rows] != label[rows[0]]).any():
                keep(*all_of.forest(rows))
                if x == y:
                    joined()
        a, b = a[~large], b[~large]
        pairs = count[a] * count[b]
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS)) + 1):
            if not len(some):
                continue
            k = pairs[some]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            step = np.repeat(count[b[some]], k)
            x, y = at // step, at % step
            once = (x < y) | np.repeat(a[some] != b[some], k)
            i, j = order[np.repeat(first[a[some]], k)[once] + x[once]], order[np.repeat(first[b[some]], k)[once] + y[once]]
            new = label[i] != label[j]
            i, j = i[new], j[new]
            ok = all_of.candidates(i, j)
            keep(i[ok], j[ok])
        joined()
    return joined()


def _filed(places: list[np.ndarray], counted: bool):
    """Fingerprints as rows of coarse groups, or how many each group gets."""
    width = len(places[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            bits = _bits(_fps(batch["fp"]))
            bucket = [_values(bits, own) + (i << width) for i, own in enumerate(places)]
            if counted:
                key, n = np.unique(np.concatenate(bucket), return_counts=True)
                yield pd.DataFrame({"bucket": key, "n": n})
            else:
                for b in bucket:
                    yield batch.assign(bucket=b)[["bucket", "id", "n", "fp"]]

    return run


def _searched(similarity: float, recall: float, held: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "bucket", held):
            ids = rows["id"].to_numpy()
            e = near(_fps(rows["fp"]), rows["n"].to_numpy(), similarity, recall)
            yield pd.DataFrame({"u": ids[e["u"]], "v": ids[e["v"]]})

    return run


def similar(sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> np.ndarray:
    """For each of these distinct sets the place of the first one it is joined to by links of ``similarity`` or more."""
    size = np.array([len(x) for x in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(flat.max(initial=-1) + 1, bool)
    all_of = Near(fps, size, similarity)
    label, left, todo, first = np.arange(len(sets)), np.arange(len(sets)), [], 0
    while len(left):
        if not todo:
            first = int(left[0])
            todo, left = [first], left[1:]
            continue
        x = todo.pop()
        own = flat[start[x] : start[x] + size[x]]
        mark[own] = True
        at = np.flatnonzero(all_of.candidates(left, x))
        found = np.zeros(len(left), bool)
        for some in np.array_split(at, max(1, int(size[left[at]].sum()) >> 20)):
            if len(some):
                n = size[left[some]]
                if not n.all():  # sets without shingles are equal
                    found[some] = n == size[x]
                    continue
                places = np.repeat(start[left[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.add.reduceat(mark[flat[places]], np.cumsum(n) - n, dtype=np.int64)
                found[some] = both >= similarity * (n + size[x] - both) - 1e-9
        mark[own] = False
        label[left[found]] = first
        todo += left[found].tolist()
        left = left[~found]
    return label


def _verified(similarity: float, held: int):
    """Blocks of components (label, id, fp, hashes) as ``node, label``: the nodes that links of ``similarity`` or more join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "label", held):
            ids = rows["id"].to_numpy()
            at = similar([np.frombuffer(x, np.uint64) for x in rows["hashes"]], _fps(rows["fp"]), similarity)
            yield pd.DataFrame({"node": ids, "label": ids[at], "split": rows["parts"].to_numpy() > 1})

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, **how) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs`` (doc_id, text)."""
    found, named = _labelled(docs.select("doc_id", "text", F.lit(0).alias("rest")), shingle, similarity, recall, **how)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return found.join(named.join(smallest, "label").select("id", "component_id"), "id").select("doc_id", "component_id")


def _labelled(docs: DataFrame, shingle: int, similarity: float, recall: float, held: int = HELD, shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` (doc_id, text, rest) with its shingle set's ``id``, and every id's ``label``."""

    @F.pandas_udf("id long, n long, fp binary")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(t, shingle) for t in batch]
            yield pd.DataFrame([(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64), len(x), set_fingerprint(x)) for x in sets], columns=["id", "n", "fp"])

    text = F.coalesce("text", F.lit(""))
    at = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(7), text), "dk": F.xxhash64("doc_id")}
    found = staged(docs.select("doc_id", "rest", *(v.alias(k) for k, v in at.items()), prints("text").alias("p")).select("doc_id", "rest", *at, "p.*"), "wide-prints")
    # a set's text: of those that have it the one of smallest hash
    first = found.groupBy("id").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(*at)).alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    first = staged(first.select("id", "first_id", "at.*", "n", "fp"), "wide-distinct")
    prints_only = first.select("id", "n", "fp")
    places = coarse(first.count(), similarity, recall, held)
    crowds = prints_only.mapInPandas(_filed(places, True), "bucket long, n long").groupBy("bucket").agg(F.ceil(F.sum("n") / (2 * held)).alias("parts")).where("parts > 1")
    met = dealt(prints_only.mapInPandas(_filed(places, False), "bucket long, id long, n long, fp binary"), "bucket", "id", staged(crowds, "wide-crowds"))
    maybe = components(met.mapInPandas(_searched(similarity, recall, held), "u long, v long"))
    maybe = staged(first.join(maybe, F.col("id") == F.col("node")).select("label", "id", *at, "n", "fp"), "wide-candidates")

    @F.pandas_udf("binary")
    def hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, shingle).tobytes() for t in batch], dtype=object)

    texts = sieve(docs.select(*(v.alias(k) for k, v in at.items()), "text"), [*at], maybe.select(*at)).groupBy(*at).agg(F.first("text").alias("text"))
    sets = maybe.join(texts, [*at]).select("label", "id", "fp", hashes("text").alias("hashes"))
    large = staged(maybe.groupBy("label").agg(F.ceil(F.sum("n") / shingles).alias("parts")).where("parts > 1"), "wide-large")
    labels = staged(dealt(sets, "label", "id", large).mapInPandas(_verified(similarity, 4096), "node long, label long, split boolean"), "wide-verified")
    joined = labels.where("split")
    whole = labels.where("not split").select("node", "label")
    if large.limit(1).count():
        whole = whole.union(components(joined.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    forget(maybe)
    return found, first.join(whole, F.col("id") == F.col("node"), "left").select("id", "first_id", F.coalesce("label", "id").alias("label"))


def keep_one_row(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, **how) -> DataFrame:
    """``docs`` with exactly one row of each component: the smallest doc_id's, nulls last, then by hashes of text and other columns.

    Rows are told apart by their content, never by doc_id alone; of rows equal in all columns one stays.
    """
    *key, stays = unused(docs.columns, "_h1", "_h2", "_rest", "_stays")
    text = F.coalesce("text", F.lit(""))
    rest = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in docs.columns if c != "text"], F.col("text").isNull())
    keyed = docs.withColumns(dict(zip(key, (F.xxhash64(text), F.xxhash64(F.lit(7), text), rest))))
    found, named = _labelled(keyed.select("doc_id", "text", F.col(key[2]).alias("rest")), shingle, similarity, recall, **how)
    rows = found.groupBy("id", "doc_id", "h1", "h2", "rest").agg(F.count("*").alias("n"))
    rows = rows.join(named.select("id", "label"), "id").withColumn("at", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2", "rest"))
    best = rows.groupBy("label").agg(F.min("at").alias("best"))
    chosen = rows.join(best, "label").select(*[F.col(c).alias(k) for c, k in zip(("h1", "h2", "rest"), key)], F.col("at").eqNullSafe(F.col("best")).alias(stays), "n")
    odd = staged(chosen.where(~F.col(stays) | (F.col("n") > 1)).select(*key, stays), "wide-odd")
    forget(found)
    touched = sieve(keyed, key, odd.select(*key)).join(odd, key, "left").where(F.coalesce(stays, F.lit(True))).dropDuplicates(key)
    return touched.select(docs.columns).unionByName(sieve(keyed, key, odd.select(*key), out=True).select(docs.columns))
