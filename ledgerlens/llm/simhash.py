"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set if it is set in over half of the 64-bit hashes
of its word shingles, repeats included. Equal fingerprints collapse to one. To
find all pairs within ``bits`` differing bits, the fingerprint is cut into
segments; of two such fingerprints at least one segment differs in few bits only
(pigeonhole), so each fingerprint looks up the Hamming balls around its segments
in tables of exact segments, and every match's complete distance is verified.
Matches are made in sorted partitions: a bucket gives a spanning forest of its
links, never its pairs, so a bucket of thousands of near copies stays linear in
what it emits. A bucket of over ``CROWD`` distinct fingerprints is dealt out in blocks
that meet pairwise (``blocks``), and those that ask a bucket come to it batch by
batch. Components are then joined up over all buckets.

Defined cases: null text is empty; texts with fewer words than a shingle hash the
whole word sequence; texts of any length are read whole, in blocks; texts without
words have fingerprint zero and link as any other; a bit set in exactly half of the
hashes is 0; repeated rows share a component; null doc_ids are kept as rows and never
name a component (a component of null ids only has a null id); extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import FEW, dealt, groups
from ledgerlens.llm.components import components
from ledgerlens.llm.store import staged

SEED = 42
#: Shingles hashed at once; bucket rows compared by shifts.
BLOCK, SHIFTED = 1 << 14, 48
#: Distinct fingerprints of a bucket, and rows that ask it, that a task holds at once.
CROWD, ASKERS = 8192, 65_536


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of every shingle, repeats included, in blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, view = xxhash.xxh64_intdigest, joined
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), BLOCK):
        yield np.array([digest(view[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """As signed bigint."""

    @F.pandas_udf("long")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).astype(np.int64))

    return udf(text)


def balls(bits: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of each segment that has to be looked up: its masks are the Hamming ball without 0."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    radius, more = divmod(bits, segments)
    out = []
    for i in range(segments):
        r = radius if i <= more else radius - 1
        if r >= 0:
            width = cuts[i + 1] - cuts[i]
            out.append((cuts[i], width, [sum(1 << b for b in c) for k in range(1, r + 1) for c in combinations(range(width), k)]))
    return out


def _linked(bits: int, askers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[np.ndarray] = []  # rows of the last bucket so far
        for batch in batches:
            now = np.c_[batch["bucket"].to_numpy(), batch["probe"].to_numpy(), batch["fp"].to_numpy()]
            if not len(now):
                continue
            if rest and now[-1, 0] == rest[0][0, 0]:
                rest.append(now)
                if sum(map(len, rest)) > askers:
                    whole = np.concatenate(rest)
                    yield links(whole, bits)
                    rest = [whole[whole[:, 1] == 0]]
                continue
            now = np.concatenate([*rest, now])
            cut = np.searchsorted(now[:, 0], now[-1, 0])
            yield links(now[:cut], bits)
            rest = [now[cut:]]
        if rest:
            yield links(np.concatenate(rest), bits)

    return run


def _linked_blocks(bits: int, askers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "bucket", askers):
            found = [(np.full(len(y), x, np.uint64), y) for x, y in _forest(np.unique(rows["fp"].to_numpy().view(np.uint64)), bits)]
            for u, v in found:
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links(rows: np.ndarray, bits: int) -> pd.DataFrame:
    """``rows``: bucket, probe (0 before 1), fingerprint, sorted. Links that join what each bucket links."""
    key, probe, fp = rows[:, 0], rows[:, 1], rows[:, 2].astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    useful = (size > 1) & (probe[first] == 0) if len(key) else np.empty(0, bool)
    few = np.repeat(useful & (size <= SHIFTED), size)
    k, p, f = key[few], probe[few], fp[few]
    a, b = [], []
    for d in range(1, min(SHIFTED, len(k))):
        same = (k[d:] == k[:-d]) & (p[:-d] == 0)
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= bits]
        a.append(f[i])
        b.append(f[i + d])
    for at, n in zip(first[useful & (size > SHIFTED)], size[useful & (size > SHIFTED)]):
        for x, y in _forest(np.unique(fp[at : at + n]), bits):
            a.append(np.full(len(y), x, np.uint64))
            b.append(y)
    both = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b))
    return pd.DataFrame(dict(zip("uv", (x.astype(np.int64) for x in both))))


def _forest(left: np.ndarray, bits: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """A spanning forest of one bucket's links; holds the bucket's fingerprints only."""
    todo: list[np.uint64] = []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        x = todo.pop()
        near = np.bitwise_count(left ^ x) <= bits
        if near.any():
            found, left = left[near], left[~near]
            todo += list(found)
            yield x, found


def link_fingerprints(prints: DataFrame, bits: int = 3, segments: int = 2, crowd: int = CROWD, askers: int = ASKERS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of ``prints`` (fp) at most ``bits`` apart; they connect all that is so linked."""
    fps = prints.select("fp").distinct()
    filed, asked = [], []
    for i, (shift, width, masks) in enumerate(balls(bits, segments)):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        own = fps.withColumn("segment", segment)
        tag = F.lit(i << width) if width < 60 else F.lit(0)
        filed.append(own.select((F.col("segment") + tag).alias("bucket"), F.lit(0).cast("bigint").alias("probe"), "fp"))
        if masks:
            # of two fingerprints whose segments differ by a mask, the smaller one asks
            asks = own.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))).withColumn("at", F.col("segment").bitwiseXOR(F.col("mask"))).where("at > segment")
            asked.append(asks.select((F.col("at") + tag).alias("bucket"), F.lit(1).cast("bigint").alias("probe"), "fp"))
    rows = reduce(DataFrame.union, [*filed, *asked])
    hot = staged(reduce(DataFrame.union, filed).groupBy("bucket").agg(F.ceil(F.count("*") / crowd).alias("parts")).where("parts > 1"), "simhash-hot")
    n = hot.limit(FEW + 1).count()
    edges = "u long, v long"
    few = F.broadcast(hot) if n <= FEW else hot
    cold = rows.join(few, "bucket", "left_anti") if n else rows
    out = cold.repartition("bucket").sortWithinPartitions("bucket", "probe").mapInPandas(_linked(bits, askers), edges)
    if n:
        out = out.union(dealt(rows.join(few, "bucket", "left_semi"), "bucket", "fp", hot).mapInPandas(_linked_blocks(bits, crowd), edges))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, segments: int = 2, **how) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (doc_id, text)."""
    prints = staged(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "simhash-prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    first = staged(first, "simhash-distinct")
    labels = components(link_fingerprints(first, bits, segments, **how))
    named = first.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(smallest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
