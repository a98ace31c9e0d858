"""Best-fit packing of tokenized documents: hierarchical residual packing.

Documents become token ids with an end id; what is longer than a sequence is cut
into full pieces and a rest. Full pieces are sequences of their own. All other
pieces are dealt evenly over buckets by a hash of their place, which no two rows
share, and each bucket packs its own best-fit, longest first. Bins that are nearly
full are emitted; the others are items of the next round, as long as what they
hold, dealt over fewer buckets and packed best-fit again, until one bucket is left
or a round saves nothing. Only the first round moves pieces (a few dozen bytes
each, never texts); the later ones move a few bins of each bucket.

A task holds one slice of texts, or one bucket of about ``BUCKET`` rows. The vocabulary
ends its tokens with words and drops white space, so a worker tokenizes each distinct
word once and looks it up from then on; tests hold that against whole texts.

Defined cases: a null or empty text is its end id alone; texts of any length are cut,
never shortened; strings that look like special tokens are ordinary text; null and
repeated doc_ids and equal rows are documents of their own; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import FEW
from ledgerlens.llm.fill_middle import slices
from ledgerlens.llm.store import forget, staged

CAPACITY, END = 4096, 1
#: Rows of a bucket, more or less; the part of a sequence that has to be taken for it to be emitted.
BUCKET, FULL = 16_384, 0.99
#: Distinct words whose ids a worker remembers; bytes of text that it splits at once; new words that are tokenized in one call.
REMEMBERED, SLICE, TOGETHER = 1_000_000, 8 << 20, 64


class Words:
    """Token ids of texts, a word at a time, each distinct word once.

    Texts are cut at ASCII white space, which the vocabulary drops, and between a
    letter and a full stop or comma, where no token reaches across; ASCII letters
    are lower-cased first, as the vocabulary does. So a text's ids are its words'
    ids one after the other.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.places = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Ids of words not yet known. Words of letters have one word end each, so many go in one call."""
        texts, ids, lengths = words.to_pylist(), [self.flat], []
        parts = [texts[at : at + TOGETHER] for at in range(0, len(texts), TOGETHER)]
        for part, joined in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            got = np.array(joined.ids, np.uint32)
            ends = np.flatnonzero(self.last[got])
            if len(ends) == len(part) and all(map(str.isalpha, part)):
                ids.append(got)
                lengths.append(np.diff(ends, prepend=-1))
            else:
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids.append(np.array([i for e in each for i in e], np.uint32))
                lengths.append(np.array([len(e) for e in each]))
        if texts:
            self.known, self.flat = pa.concat_arrays([self.known, words]), np.concatenate(ids)
            self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(np.concatenate(lengths))])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins and ends."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "([a-z])([.,])", r"\1 \2")
        split = pc.ascii_split_whitespace(cut)
        words = split.flatten().dictionary_encode()
        at = pc.index_in(words.dictionary, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        places[new] = len(self.known) + np.arange(new.sum())
        self.learn(words.dictionary.filter(pa.array(new)))
        table = pa.LargeListArray.from_arrays(pa.array(self.places), pa.array(self.flat))
        found = table.take(pa.array(places[words.indices.to_numpy()]))
        begins = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        ends = np.asarray(found.offsets, np.int64)
        return found.flatten().to_numpy(), (ends - ends[0])[begins]


@lru_cache(maxsize=1)
def _words(vocabulary: str) -> Words:
    return Words(vocabulary)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """``doc_id, slot, piece, start, length, ids_crc32`` of every piece of every text; with ``ids`` the ids too, as little-endian 32-bit numbers in ``ids``.

    ``tokenizer``: path of the vocabulary file, read on the driver. ``slot`` is the piece's place and unlike any other.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slot = _words(vocabulary.value), TaskContext.get().partitionId() << 33
        for batch in slices(batches, SLICE):
            rows: list[tuple] = []
            flat, cuts = words.ids(batch.column("text"))
            for at, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                for piece, start in enumerate(range(0, hi - lo + 1, capacity)):
                    part = flat[lo + start : min(hi, lo + start + capacity)].astype("<u4", copy=False).tobytes()
                    if hi - lo + 1 <= start + capacity:
                        part += last
                    rows.append((at, slot, piece, start, len(part) // 4, zlib.crc32(part), part if ids else None))
                    slot += 1
            at, *columns, parts = zip(*rows)
            arrays = [batch.column("doc_id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]]
            names = ["doc_id", "slot", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.binary())] if ids else [])], [*names, *(["ids"] if ids else [])])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, slot long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", F.make_valid_utf8(F.col("text")).alias("text")).mapInArrow(run, schema + (", ids binary" if ids else ""))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For items in this order: the first item of the bin of each, its offset there, and what the bin holds in the end.

    An item goes to the bin that it fills best, of equals the one last changed, else to a new one.
    """
    free = 0  # bit r: there is a bin with r left
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by what is left: their first items
    left, first, offset = {}, [], []
    for i, size in enumerate(sizes):
        fits = free >> size
        if fits:
            r = (fits & -fits).bit_length() - 1 + size
            b = bins[r].pop()
            if not bins[r]:
                free ^= 1 << r
        else:
            b, r = i, capacity
        first.append(b)
        offset.append(capacity - r)
        r -= size
        left[b] = r
        if r:
            if not bins[r]:
                free |= 1 << r
            bins[r].append(b)
    return first, offset, [capacity - left[b] for b in first]


def _pack(capacity: int, size: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([size, "slot"], ascending=[False, True], kind="stable")
        first, offset, held = best_fit(group[size].tolist(), capacity)
        return group.drop(columns="bucket").assign(bin=group["slot"].to_numpy()[first], offset=offset, held=held)

    return run


def _round(items: DataFrame, size: str, n: int, capacity: int, bucket: int, level: int) -> DataFrame:
    """``items`` (slot, size and others) with ``bin`` (its first item's slot), ``offset`` and ``held``, packed in buckets."""
    buckets = -(-n // bucket)
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "slot"), F.lit(max(1, buckets))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return staged(dealt.groupBy("bucket").applyInPandas(_pack(capacity, size), f"{schema}, bin long, offset long, held long"), "packing-round")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, bucket: int = BUCKET, full: float = FULL, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs`` (doc_id, text); with ``ids`` its ids too."""
    made = staged(pieces(docs, tokenizer, capacity, end, ids), "packing-pieces")
    names = ["doc_id", "slot", "piece", "start", "length", "ids_crc32"]
    whole = made.where(F.col("length") == capacity).select(*names, F.col("slot").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    some = made.where(F.col("length") < capacity).select(*names)
    rows = _round(some, "length", some.count(), capacity, bucket, 0)

    underfull = F.col("held") < full * capacity
    items = rows.where(underfull & (F.col("offset") == 0)).select(F.col("bin").alias("slot"), F.col("held").alias("size"))
    n, moves = items.count(), []
    level = 1
    while n > 1:
        now = _round(items, "size", n, capacity, bucket, level)
        moved = now.where("bin <> slot").select("slot", "bin", "offset")
        saved = moved.count()
        if not saved:
            forget(now)
            break
        moves.append(moved)
        items = now.where(underfull & (F.col("offset") == 0)).select(F.col("bin").alias("slot"), F.col("held").alias("size"))
        last, n = n, items.count()
        if last <= bucket:
            break
        level += 1

    # where every moved bin ends: the last round's first, since what moved later moved all that it held
    ends = None
    for moved in reversed(moves):
        if ends is not None:
            on = ends.select(F.col("slot").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
            here = moved.join(on, "bin", "left").select("slot", F.coalesce("_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"))
            moved = here.unionByName(ends)
        ends = moved
    done = rows.select(*names, F.col("bin").alias("sequence_id"), "offset")
    if ends is not None:
        ends = staged(ends, "packing-moves")
        small = ends.limit(FEW + 1).count() <= FEW
        to = ends.select(F.col("slot").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
        open_rows = rows.where(underfull).join(F.broadcast(to) if small else to, "bin", "left")
        open_rows = open_rows.select(*names, F.coalesce("_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"))
        done = rows.where(~underfull).select(*names, F.col("bin").alias("sequence_id"), "offset").unionByName(open_rows)
    out = done.unionByName(whole)
    if ids:
        out = out.join(made.select("slot", "ids"), "slot")
    return out.drop("slot")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, doc_ids, ids`` from rows of ``pack`` with ids: what a trainer reads, a row for each sequence, which holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
