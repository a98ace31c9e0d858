"""Exact substring dedup: removes what is covered by a run of ``width`` units that also starts elsewhere.

Units are bytes (``BYTES``: 400 of them) or words (``WORDS``: 51 of them, so passages
of over 50 words). Words are runs without ASCII white space; their texts are
compared as the words with one blank before, between and after them.

1. Anchors. Of the ``gram``-unit strings in each window of ``width`` units the one
   of smallest hash is the window's anchor. Equal windows have equal anchors, so
   windows whose anchor occurs once in the corpus cannot repeat. Consecutive
   windows with one anchor are a region; a region is named by its anchor's hash
   and its bytes' hash. A text that has a region several times has one row for it,
   with all its places, so a line that fills a text is one row.
2. Anchors that occur once go. Equal regions collapse to one; they repeat as
   such. If an anchor's regions differ, their bytes are fetched from the texts
   (once for each distinct region) and dealt out by anchor, so windows that may be
   equal meet in one shard.
3. A shard is a suffix array, built by induced sorting (``suffix_array``), with
   its permuted common prefixes: a window repeats if it shares its whole length with
   a neighbour in that order.
4. Repeating windows go back to all texts with that region, are merged to runs,
   and the runs are removed.

An anchor with more than ``group`` distinct regions (a passage that very many
documents share amid different text) would be one large shard; its windows are
compared by hash, aggregated before the shuffle, so such a group is split too.
Which route a region takes changes no result. Rolling hashes choose anchors, where an
accident costs time only; equal bytes are told by 64 bits of BLAKE2b among the
regions of one anchor, by the letters themselves in a shard, and a text is named by 128 bits.

Anchors and texts are shuffled only where they may hold what is looked for
(``store.sieve``), and a staged table goes as soon as what follows from it is written.

Defined cases: null text is empty; texts shorter than ``width`` lose nothing;
equal texts of at least ``width`` units lose all; repeated rows are documents like
others; null doc_ids are kept; texts of any length are read in blocks; extra
columns are ignored by ``repeats`` and kept by ``remove``; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import suffix_array as sa
from ledgerlens.llm.store import forget, sieve, staged, unused


@dataclass(frozen=True)
class Unit:
    """What a window is measured in: ``width`` units, with anchors of ``gram`` units."""

    words: bool
    width: int
    gram: int

    def encode(self, text: str) -> bytes:
        b = text.encode("utf-8", "surrogatepass")
        return b" %s " % b" ".join(b.split()) if self.words else b

    def cuts(self, b: np.ndarray) -> np.ndarray | None:
        """Where units start, and the end; None: at every byte."""
        return np.flatnonzero(b == 32) if self.words else None

    def letters(self, texts: list[bytes]) -> list[np.ndarray]:
        """The units of encoded texts as numbers: bytes, or words as they first come."""
        if not self.words:
            return [np.frombuffer(b, np.uint8) for b in texts]
        known: dict[bytes, int] = {}
        return [np.array([known.setdefault(w, len(known)) for w in b.split()], np.int32) for b in texts]

    def places(self, text: str) -> np.ndarray | None:
        """Starts of the units in the text's own bytes, and its end; None: at every byte."""
        if not self.words:
            return None
        b = text.encode("utf-8", "surrogatepass")
        return np.array([*(m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)), len(b)], np.int64)


BYTES, WORDS = Unit(False, 400, 128), Unit(True, 51, 16)
GROUP, SHARD = 5000, 1 << 20
#: Windows of a text looked at together.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_TEXT = "h1 long, h2 long, dk long"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Roller:
    """Hashes of a text's substrings; powers are kept between texts."""

    def __init__(self, longest: int):
        self.letter = _mix(np.arange(1, 257, dtype=np.uint64))
        self._grow(longest)

    def _grow(self, longest: int) -> None:
        _, self.inverse = sa.prefix_sums(np.zeros(longest, np.uint8))
        with np.errstate(over="ignore"):
            self.power = np.full(longest, sa._ODD, np.uint64)
            self.power[0] = 1
            np.multiply.accumulate(self.power, out=self.power)

    def sums(self, b: np.ndarray) -> np.ndarray:
        if len(b) > len(self.power):  # blocks of words have no bound in bytes
            self._grow(2 * len(b))
        s = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.letter[b] * self.power[: len(b)], out=s[1:])
        return s

    def hashes(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((s[end] - s[start]) * self.inverse[start])

    def every(self, s: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((s[size:] - s[:-size]) * self.inverse[: len(s) - size])

    def runs(self, s: np.ndarray, cuts: np.ndarray | None, size: int) -> np.ndarray:
        """Of every run of ``size`` units."""
        return self.every(s, size) if cuts is None else self.hashes(s, cuts[:-size], cuts[size:] + 1)


def digests(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What names byte strings: 64 bits of BLAKE2b. Rolling hashes collide on strings that repeat themselves in turn, so they only choose anchors."""
    data = memoryview(np.ascontiguousarray(b)).cast("B")
    return np.frombuffer(b"".join([blake2b(data[i:j], digest_size=8).digest() for i, j in zip(start.tolist(), end.tolist())]), "<u8")


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x)
    y = np.concatenate([x, np.full(-m % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - w + 1], ahead[w - 1 : m])


def regions(b: np.ndarray, roller: Roller, unit: Unit = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: first and last window of its regions, anchor hashes, region hashes."""
    width, cuts = unit.width, unit.cuts(b)
    for at in range(0, (len(b) if cuts is None else len(cuts) - 1) - width + 1, BLOCK):
        if cuts is None:
            own, part = None, b[at : at + BLOCK + width - 1]
        else:
            own = cuts[at : at + BLOCK + width]
            part, own = b[own[0] : own[-1] + 1], own - own[0]
        s = roller.sums(part)
        h = roller.runs(s, own, unit.gram)
        place = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - unit.gram + 1) & _LOW
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(place) - 1]])
        start, end = (lo, hi + width) if own is None else (own[lo], own[hi + width] + 1)
        yield at + lo, at + hi, h[place[lo].astype(np.int64)], digests(part, start, end)


def _anchored(unit: Unit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = Roller(BLOCK + unit.width)
        for batch in batches:
            out: list[tuple] = []
            for h1, h2, dk, text in zip(batch["h1"].to_numpy(), batch["h2"].to_numpy(), batch["dk"].to_numpy(), batch["text"]):
                found = list(regions(np.frombuffer(unit.encode(text), np.uint8), roller, unit))
                if not found:
                    continue
                lo, hi, key, region = map(np.concatenate, zip(*found))
                order = np.argsort(region, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], region[order[1:]] != region[order[:-1]]]))
                n = np.diff(np.append(first, len(order)))
                more = np.full(len(first), None, object)
                for i in np.flatnonzero(n > 1).tolist():
                    more[i] = lo[order[first[i] + 1 : first[i] + n[i]]].astype("<i4").tobytes()
                at = order[first]
                out.append((np.full(len(at), h1), np.full(len(at), h2), np.full(len(at), dk), lo[at].astype(np.int32), hi[at].astype(np.int32), key[at].view(np.int64), region[at].view(np.int64), n, more))
            if out:
                yield pd.DataFrame(dict(zip(("h1", "h2", "dk", "lo", "hi", "key", "region", "n", "more"), map(np.concatenate, zip(*out)))))

    return run


def _fetched(unit: Unit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"]):
                b = unit.encode(text)
                cuts = unit.cuts(np.frombuffer(b, np.uint8))
                for w in wanted:
                    lo, hi = w["lo"], w["hi"] + unit.width
                    out.append((w["key"], w["region"], w["n"], b[lo:hi] if cuts is None else b[cuts[lo] : cuts[hi] + 1]))
            for i in range(0, len(out), 2000):
                yield pd.DataFrame(out[i : i + 2000], columns=["key", "region", "n", "bytes"])

    return run


def repeated_windows(texts: list[np.ndarray], unit: Unit) -> list[np.ndarray]:
    """For each text its windows (first units) that occur twice or more in all of them. A text's letters are its units."""
    t, starts = sa.join(texts)
    order = sa.of_names(t) if unit.words else sa.suffix_array(t, len(texts))
    phi, prefix = sa.common_prefixes(t, order, max(map(len, texts)), unit.width)
    found = np.zeros(len(t), bool)
    long = np.flatnonzero(prefix >= unit.width)
    found[long] = True
    found[phi[long]] = True
    return [np.flatnonzero(found[at : at + len(x)]) for at, x in zip(starts, texts)]


def _runs(places: np.ndarray, width: int) -> list[list[int]]:
    """Runs [start, end) that the windows at ascending ``places`` cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > width) + 1
    return [[int(a), int(b) + width] for a, b in zip(places[np.concatenate([[0], cut])], places[np.concatenate([cut - 1, [len(places) - 1]])])]


def _sharded(unit: Unit, shard: int):
    """Rows sorted by key; whole anchors are gathered to shards of about ``shard`` bytes."""

    def solved(rows: list[tuple]) -> pd.DataFrame:
        one = list({(r[0], r[1]): r for r in rows}.values())
        texts = unit.letters([r[3] for r in one])
        places = repeated_windows(texts, unit)
        spans = [[[0, len(t)]] if r[2] > 1 else _runs(p, unit.width) for r, t, p in zip(one, texts, places)]
        return pd.DataFrame([(r[0], r[1], s) for r, s in zip(one, spans) if s], columns=["key", "region", "spans"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if size >= shard and row[0] != held[-1][0]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solved(held)

    return run


def _hashed(unit: Unit):
    """Windows of regions whose anchor is in very many: (key, region, window, hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, region, n, b in batch.itertuples(index=False, name=None):
                b = np.frombuffer(b, np.uint8)
                cuts = unit.cuts(b)
                start = np.arange(len(b) - unit.width + 1) if cuts is None else cuts[: -unit.width]
                h = digests(b, start, start + unit.width if cuts is None else cuts[unit.width :] + 1)
                yield pd.DataFrame({"key": key, "region": region, "n": n, "at": np.arange(len(h), dtype=np.int32), "hash": h.view(np.int64)})

    return run


def named(text: Column) -> dict[str, Column]:
    """``h1, h2`` name a text; so no step depends on how rows were dealt out."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(7), text)}


def identified(docs: DataFrame) -> DataFrame:
    """``h1, h2`` name a text, ``dk`` a doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text, **named(text), "dk": F.xxhash64("doc_id")})


def repeated_runs(docs: DataFrame, unit: Unit = BYTES, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """``h1, h2, dk, runs``: for each text that loses something (dk: one of its documents) its runs, not yet merged.

    A run has a place ``lo``, further places in ``more`` and, from each of them, the ``spans`` [start, end) to remove, in units.
    """
    texts = identified(docs.select("doc_id", "text")).select("h1", "h2", "dk", "text").where(F.octet_length("text") >= unit.width)
    anchors = staged(texts.mapInPandas(_anchored(unit), _TEXT + ", lo int, hi int, key long, region long, n long, more binary"), "anchors")
    again = anchors.groupBy("key").agg(F.sum("n").alias("all"), F.min("region").alias("a"), F.max("region").alias("b")).where("all > 1").select("key", (F.col("a") != F.col("b")).alias("differ"))
    again = staged(again, "anchor-keys")  # read back, both sides of the join are plain exchanges, and a hot anchor's rows can be split
    common = staged(sieve(anchors, ["key"], again.select("key")).join(again, "key"), "anchors-again")
    forget(anchors, again)
    differ = common.where("differ").drop("differ")
    # one place for each distinct region
    distinct = differ.groupBy("key", "region").agg(F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "dk", "lo", "hi")).alias("at"))
    distinct = staged(distinct, "regions")
    crowded = distinct.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > group).select("key")
    wanted = distinct.groupBy("at.h1", "at.h2", "at.dk").agg(F.collect_list(F.struct("key", "region", "n", "at.lo", "at.hi")).alias("wanted"))
    fetched = sieve(texts, ["h1", "h2", "dk"], distinct.select("at.h1", "at.h2", "at.dk")).join(wanted, ["h1", "h2", "dk"])
    fetched = staged(fetched.select("text", "wanted").mapInPandas(_fetched(unit), "key long, region long, n long, bytes binary"), "region-bytes")
    shards = fetched.join(F.broadcast(crowded), "key", "left_anti") if _few(crowded) else fetched.join(crowded, "key", "left_anti")
    spans = shards.repartition("key").sortWithinPartitions("key", "region").mapInPandas(_sharded(unit, shard), "key long, region long, spans array<array<int>>")
    windows = fetched.join(crowded, "key").mapInPandas(_hashed(unit), "key long, region long, n long, at int, hash long")
    seen = windows.groupBy("key", "hash").agg(F.sum("n").alias("times")).where("times > 1").select("key", "hash")
    hashed = windows.join(seen, ["key", "hash"]).groupBy("key", "region").agg(F.collect_list(F.array(F.col("at"), F.col("at") + unit.width)).alias("spans"))
    spans = staged(spans.union(hashed), "spans")
    forget(distinct, fetched)
    # every occurrence: whole if its anchor has one region only, else what its region repeats
    whole = common.where("not differ").withColumn("spans", F.array(F.array(F.lit(0), F.col("hi") - F.col("lo") + unit.width)))
    each = [x.select("h1", "h2", "dk", F.struct("lo", "more", "spans").alias("run")) for x in (whole, differ.join(spans, ["key", "region"]))]
    # equal texts say the same; a text's own runs are as many as its regions at most
    runs = staged(each[0].union(each[1]).groupBy("h1", "h2").agg(F.min("dk").alias("dk"), F.collect_set("run").alias("runs")), "runs")
    forget(common, spans)
    return runs


def _few(keys: DataFrame, bound: int = 100_000) -> bool:
    """Whether at most ``bound`` rows (8 bytes each) are there, so that they may be broadcast."""
    return keys.limit(bound + 1).count() <= bound


def merged(runs) -> np.ndarray:
    """Ascending (start, end), those that overlap or touch as one."""
    starts, ends = [], []
    for r in runs:
        places = np.append(np.frombuffer(r["more"] or b"", "<i4"), r["lo"]).astype(np.int64)
        for a, b in r["spans"]:
            starts.append(places + a)
            ends.append(places + b)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    return np.c_[start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]]


def cut(text: str, runs: np.ndarray, unit: Unit) -> bytes:
    """The text's bytes without these runs of units; after a run of words its white space goes too."""
    b, places = text.encode("utf-8", "surrogatepass"), unit.places(text)
    if places is not None:
        runs = places[runs]
    ends = [0, *runs[:, 1].tolist()]
    return b"".join(b[at:start] for at, start in zip(ends, [*runs[:, 0].tolist(), len(b)]))


def _digested(unit: Unit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h1, h2, text, runs in zip(batch["h1"], batch["h2"], batch["text"], map(merged, batch["runs"])):
                out.append((h1, h2, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(cut(text, runs, unit)).hexdigest()))
            yield pd.DataFrame(out, columns=["h1", "h2", "n_removed", "n_spans", "kept_sha256"])

    return run


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(h1, h2, int((r[:, 1] - r[:, 0]).sum())) for h1, h2, r in zip(batch["h1"], batch["h2"], map(merged, batch["runs"]))], columns=["h1", "h2", "covered"])


def repeats(docs: DataFrame, unit: Unit = BYTES, passages: Unit | None = None, **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text); removed: in units.

    With ``passages`` also ``n_passage_words``: the words in repeated runs of that unit, which are told but not removed.
    """
    rows = identified(docs.select("doc_id", "text"))
    runs = repeated_runs(docs, unit, **how)
    lost = sieve(rows.select("h1", "h2", "dk", "text"), ["h1", "h2", "dk"], runs.select("h1", "h2", "dk")).join(runs, ["h1", "h2", "dk"])
    lost = staged(lost.mapInPandas(_digested(unit), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string"), "repeats")
    forget(runs)
    narrow = rows.select("doc_id", "h1", "h2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = narrow.join(lost.dropDuplicates(["h1", "h2"]), ["h1", "h2"], "left")
    if passages:
        out = out.join(covered(docs, passages, **how), ["h1", "h2"], "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *([F.coalesce("covered", F.lit(0)).cast("bigint").alias("n_passage_words")] if passages else []),
    )


def covered(docs: DataFrame, unit: Unit = WORDS, **how) -> DataFrame:
    """``h1, h2, covered``: how many units of a text (named as by ``named``) lie in repeated runs, if any do."""
    runs = repeated_runs(docs, unit, **how)
    out = staged(runs.mapInPandas(_covered, "h1 long, h2 long, covered long"), "covered")
    forget(runs)
    return out


def remove(docs: DataFrame, unit: Unit = BYTES, **how) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; a character cut in two goes whole. Documents that lose everything go."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else cut(t, merged(r), unit).decode("utf-8", "ignore") for t, r in zip(texts, runs)], dtype=object)

    h1, h2, gone = unused(docs.columns, "_h1", "_h2", "_runs")
    runs = repeated_runs(docs, unit, **how).select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("runs").alias(gone))
    marked = docs.withColumns(dict(zip((h1, h2), named(F.coalesce("text", F.lit(""))).values())))
    maybe = sieve(marked, [h1, h2], runs.select(h1, h2)).join(runs, [h1, h2], "left")
    # not deterministic as far as the planner goes, or the filter would cut a second time
    left = maybe.withColumn("text", kept.asNondeterministic()("text", gone)).where(F.col(gone).isNull() | F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")))
    return left.select(docs.columns).unionByName(sieve(marked, [h1, h2], runs.select(h1, h2), out=True).select(docs.columns))
