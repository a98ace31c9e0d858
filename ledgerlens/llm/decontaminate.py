"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-case runs of letters and digits. An overlap of ``SPAN`` tokens
with at most a fifth of them substituted, cut into five equal blocks, has two
blocks untouched; so the four masks *block, gap of 0 to 3 blocks, block* hash, at
every position, the selected tokens only, and one of them agrees for every such
overlap. Items of 10 to 14 tokens use blocks of two, items below 10 tokens must
occur exactly.

The benchmark is a table like any other: its seeds are rows (hash, item, place),
and so are a text's seeds (hash, text, place), which are joined on the hash. Of a
text's seeds only those come to the join that two bitmaps of fixed size let
through, one of the benchmark's tokens and one of its seeds; at any size of the
benchmark they change the join's input, never its result. Around each hit the item
is laid along the text and the best aligned stretch is taken (+1 for an equal
token, -4 for another), which is reported if it has ``SPAN`` tokens, or the whole of
a shorter item, and at most a fifth substituted. Equal texts are verified once.

Defined cases: null and empty texts and items match nothing; items of equal
tokens are each reported; of stretches with as many equal tokens the first is
taken; repeated documents are reported each, and repeated items; a null item_id is
reported as null, a null doc_id too; extra columns pass through ``clean``; an empty
benchmark matches nothing; no documents give no rows. Memory is linear in one text
and ``ITEMS`` items; places in a row that have one seed are one row, so tokens said over and over are not multiplied. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.store import among, bitmap, forget, sieve, staged, unused

SPAN, SHARE = 15, 0.8
TOKEN = re.compile(r"[^\W_]+")
#: Tokens whose hashes a task remembers; items that a text is verified against in one row.
CACHE, ITEMS = 1 << 20, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "array<struct<key:bigint,start:int,length:int,matched:int>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def masks(n: int) -> list[tuple[int, ...]]:
    """Selected places of the masks for an item of ``n`` tokens."""
    if n < 10:
        return [tuple(range(n))] if n else []
    b = 3 if n >= SPAN else 2
    return [tuple([*range(b), *range(b * gap, b * gap + b)]) for gap in range(1, 5)]


def seeds(ids: np.ndarray, mask: tuple[int, ...], known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places where all selected tokens are known (id not 0), and their hashes. ``known`` keeps what masks that begin alike share."""
    known = {} if known is None else known

    def upto(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``k`` selected tokens at each place, and whether all are known."""
        part = mask[:k]
        if part not in known:
            at = ids[part[-1] :]
            h, ok = (np.uint64(7), True) if k == 1 else (x[: len(at)] for x in upto(k - 1))
            h = (h ^ at) * _ODD
            h ^= h >> np.uint64(29)
            known[part] = h, ok & (at != 0)
        return known[part]

    with np.errstate(over="ignore"):
        h, ok = upto(len(mask))
        at = np.flatnonzero(ok)
        h = (h[at] ^ np.uint64(len(mask) * 1_000_003 + mask[-1])) * _ODD
        h ^= h >> np.uint64(29)
    return at, h


class Hasher:
    """Token hashes, 0 for tokens that a bitmap doesn't hold."""

    def __init__(self, known: np.ndarray | None = None):
        self.known, self.seen = known, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        got = list(map(self.seen.get, words))
        if None in got:
            if len(self.seen) > CACHE:
                self.seen.clear()
                got = [None] * len(words)
            new = list({w for w, i in zip(words, got) if i is None})
            h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in new], np.uint64)
            if self.known is not None:
                h[~among(self.known, h)] = 0
            self.seen.update(zip(new, h.tolist()))
            got = list(map(self.seen.get, words))
        return np.array(got, np.uint64)


def best(ids: np.ndarray, item: np.ndarray, shifts) -> tuple[int, int, int] | None:
    """(first token, tokens, equal tokens) of the item's best stretch over these shifts, if any is an overlap."""
    out = None
    for shift in sorted(shifts):
        found = stretch(ids, item, int(shift))
        if found and (out is None or found[2] > out[2]):
            out = found
    return out


def stretch(ids: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first token, tokens, equal tokens) of the best stretch of ``item`` laid at ``shift``, if it is an overlap."""
    lo, hi = max(0, -shift), min(len(item), len(ids) - shift)
    least = min(SPAN, len(item))
    if hi - lo < least:
        return None
    equal = ids[lo + shift : hi + shift] == item[lo:hi]
    if len(item) >= 10 and (n := int(equal.sum())) >= SHARE * (hi - lo):
        return lo + shift, hi - lo, n
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(total[: end + 1].argmin())
    matched = int(equal[start:end].sum())
    if end - start < least or matched < SHARE * (end - start) or len(item) < 10 and matched < len(item):
        # a stretch within the tolerance can be longer than the best one
        hit = _windows(equal, least)
        if hit is None or len(item) < 10:
            return None
        start, end = hit
        matched = int(equal[start:end].sum())
    return lo + shift + start, end - start, matched


def _windows(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The first window of ``least`` tokens within the tolerance and most tokens equal."""
    c = np.concatenate([[0], np.cumsum(equal)])
    n = c[least:] - c[:-least]
    k = int(n.argmax())
    return (k, k + least) if n[k] >= SHARE * least else None


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = Hasher()
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "ids": [hashed(t).view(np.int64) for t in batch["text"]]})


def runs(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with the first and last of consecutive places (``at``, ascending) that have them: a token said over and over is one row."""
    starts = np.ones(len(at), bool)
    starts[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    ends = np.append(starts[1:], True)[: len(at)]
    return h[starts].view(np.int64), at[starts].astype(np.int32), at[ends].astype(np.int32)


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, ids in zip(batch["key"], batch["ids"]):
            ids = np.asarray(ids, np.int64).view(np.uint64)
            for mask in masks(len(ids)):
                h, first, last = runs(*seeds(ids, mask))
                yield pd.DataFrame({"hash": h, "key": key, "first": first, "last": last})


def _hits(used: list[tuple[int, ...]], known: np.ndarray, marked: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hasher(known)
        for batch in batches:
            out = []
            for h1, h2, text in zip(batch["h1"], batch["h2"], batch["text"]):
                ids, shared = hashed(text), {}
                for mask in used:
                    at, h = seeds(ids, mask, shared)
                    hit = among(marked, h)
                    if hit.any():
                        found = runs(at[hit], h[hit])
                        out.append((np.full(len(found[0]), h1), np.full(len(found[0]), h2), *found))
            if out:
                yield pd.DataFrame(dict(zip(("h1", "h2", "hash", "lo", "hi"), map(np.concatenate, zip(*out)))))

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = Hasher()
    for batch in batches:
        out = []
        for h1, h2, text, items in zip(batch["h1"], batch["h2"], batch["text"], batch["items"]):
            ids, found = hashed(text), []
            for i in items:
                shifts = np.unique(np.concatenate([np.arange(s["a"], s["b"] + 1) for s in i["shifts"]]))
                if b := best(ids, np.asarray(i["ids"], np.int64).view(np.uint64), shifts):
                    found.append({"key": i["key"], "start": b[0], "length": b[1], "matched": b[2]})
            if found:
                out.append((h1, h2, sorted(found, key=lambda f: f["key"])))
        yield pd.DataFrame(out, columns=["h1", "h2", "found"])


def _named(docs: DataFrame, h1: str = "_h1", h2: str = "_h2") -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(7), text)})


def matched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (h1, h2) that overlap an item, with overlaps ``found`` (key, start, length, matched), in several rows for many; and the items' keys (key, item_id)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").withColumn("key", F.xxhash64("text"))
    words = staged(items.groupBy("key").agg(F.min("text").alias("text")).mapInPandas(_items, "key long, ids array<long>").where(F.size("ids") > 0), "items")
    table = staged(words.mapInPandas(_item_seeds, "hash long, key long, first int, last int"), "item-seeds")
    used = sorted({m for r in words.select(F.least(F.size("ids"), F.lit(SPAN)).alias("n")).distinct().collect() for m in masks(r["n"])})  # SPAN rows at most
    if not used:
        return spark.createDataFrame([], f"h1 long, h2 long, found {FOUND}"), items.select("key", "item_id")
    known, marked = bitmap(words.select(F.explode("ids"))), bitmap(table.select("hash"))
    texts = _named(docs.select("text")).select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), "text").where("text is not null")
    hits = texts.mapInPandas(_hits(used, known, marked), "h1 long, h2 long, hash long, lo int, hi int")
    # a run of a text's places and one of an item's meet in a range of shifts
    met = hits.join(table, "hash").groupBy("h1", "h2", "key").agg(F.collect_set(F.struct((F.col("lo") - F.col("last")).alias("a"), (F.col("hi") - F.col("first")).alias("b"))).alias("shifts"))
    met = staged(met, "seed-ranges")
    parts = met.groupBy("h1", "h2").agg(F.ceil(F.count("*") / ITEMS).alias("parts")).where("parts > 1")
    part = met.join(parts, ["h1", "h2"], "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
    near = staged(part.join(words, "key").groupBy("h1", "h2", "part").agg(F.collect_list(F.struct("key", "ids", "shifts")).alias("items")), "seed-hits")
    once = sieve(texts, ["h1", "h2"], near.select("h1", "h2")).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    found = staged(once.join(near, ["h1", "h2"]).mapInPandas(_verified, f"h1 long, h2 long, found {FOUND}"), "overlaps")
    forget(words, table, met, near)
    return found, items.select("key", "item_id")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, length, matched, similarity``: a row for each document and item that overlap."""
    found, items = matched(docs, benchmark)
    rows = _named(docs.select("doc_id", "text")).select("doc_id", F.col("_h1").alias("h1"), F.col("_h2").alias("h2"))
    each = rows.join(found, ["h1", "h2"]).select("doc_id", F.explode("found").alias("m")).join(items, F.col("m.key") == F.col("key"))
    return each.select("doc_id", "item_id", "m.start", "m.length", "m.matched", (F.col("m.matched") / F.col("m.length")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap any item."""
    found, _ = matched(docs, benchmark)
    names = unused(docs.columns, "_h1", "_h2")
    keys, rows = found.select("h1", "h2").distinct().toDF(*names), _named(docs, *names)
    maybe = sieve(rows, names, keys).join(keys, names, "left_anti")
    return maybe.select(docs.columns).unionByName(sieve(rows, names, keys, out=True).select(docs.columns))
