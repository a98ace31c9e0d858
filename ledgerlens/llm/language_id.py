"""Language identification by rank-order profiles.

Texts become lower-case letter runs, each between two blanks. A language's
profile is its ``size`` most frequent n-grams (one to three letters, blanks at a
word's ends included) over all its learning rows, ranked by count. A document's
own most frequent n-grams are ranked alike, and its distance to a language is the
sum of how far each is out of place, ``size`` where the profile lacks it. The
nearest language wins; ties go to the smaller name.

Counting is done with sorted arrays of packed n-grams, in blocks of letters, so
memory is bounded for texts of any length, and counts are summed in Spark over
all rows.

Defined cases: null texts, empty texts and texts without a letter are ``und``
with score 0; rows with a null language or text teach nothing; if nothing was
learned every text is ``und``; repeated rows count and are predicted each; extra
columns pass through in ``predict`` (``lang_pred`` and ``score`` are replaced).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.store import unused

UNKNOWN = "und"
PROFILE = 400
#: Letters counted at once; n-grams whose counts a task holds before it hands them on.
BLOCK, HELD = 1 << 19, 1 << 20
BLANK = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0. Combining marks belong to words."""
    table = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch)[0] == "M":
            table[c] = c
    return table


def words(text: str) -> np.ndarray:
    """The text's letters, with one blank before, between and after the runs; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint64)
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    is_letter = a != 0
    if not is_letter.any():
        return np.empty(0, np.uint64)
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the place before a run
    a = np.where(is_letter, a, np.uint64(BLANK))[keep]
    lead = [] if a[0] == BLANK else [BLANK]
    return np.concatenate([np.array(lead, np.uint64), a, np.array([BLANK], np.uint64)])


def grams(letters: np.ndarray) -> np.ndarray:
    """All n-grams, packed 21 bits a letter."""
    if not len(letters):
        return letters
    one = letters[letters != BLANK]
    two = letters[:-1] << np.uint64(21) | letters[1:]
    three = (two[:-1] << np.uint64(21) | letters[2:])[letters[1:-1] != BLANK]
    return np.concatenate([one, two, three])


def count(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts."""
    letters = words(text)
    if len(letters) <= BLOCK:
        return np.unique(grams(letters), return_counts=True)
    return merged([np.unique(g, return_counts=True) for g in _blocks(letters)])


def _blocks(letters: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks end at a blank where there is one, else anywhere; n-grams across an end inside a word are added."""
    at = 0
    while at < len(letters) - 1:
        end = min(at + BLOCK, len(letters) - 1)
        yield _from(letters, at, end)
        at = end


def _from(letters: np.ndarray, at: int, end: int) -> np.ndarray:
    """The n-grams that start in [at, end)."""
    a, b, c = letters[at:end], letters[at + 1 : end + 1], letters[at + 2 : end + 2]
    two = a << np.uint64(21) | b
    three = (two[: len(c)] << np.uint64(21) | c)[b[: len(c)] != BLANK]
    return np.concatenate([a[a != BLANK], two, three])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of a partition, summed as far as memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            k, n = merged(parts)
            for i in range(0, len(k), 50_000):
                yield pd.DataFrame({"lang": lang, "gram": k[i : i + 50_000].astype(np.int64), "n": n[i : i + 50_000]})
        held.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            block: list[np.ndarray] = []
            for t in texts:
                w = words(t)
                if len(w) > BLOCK:
                    held.setdefault(lang, []).extend(np.unique(g, return_counts=True) for g in _blocks(w))
                elif len(w):
                    block.append(w)
                if sum(map(len, block)) > BLOCK:
                    held.setdefault(lang, []).append(_together(block))
                    block = []
            if block:
                held.setdefault(lang, []).append(_together(block))
        if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
            for lang, parts in held.items():
                held[lang] = [merged(parts)]
            if sum(len(p[0][0]) for p in held.values()) > HELD // 2:
                yield from out()
    yield from out()


def _together(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(grams(np.concatenate(block)), return_counts=True)
    real = keys != (BLANK << 21 | BLANK)  # between two texts
    return keys[real], n[real]


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """For each language of ``labelled`` (lang, text) its n-grams by falling count; ``size`` for each language come to the driver."""
    counts = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInPandas(_counted, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for r in counts.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.uint64)), j] = np.arange(len(profiles[name]))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """To each language, and the largest that could be; None without a letter."""
        keys, n = count(text)
        if not len(keys) or not self.names:
            return None
        top = keys[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = -1
        at[self.grams[at] != top] = -1
        ranks = self.ranks[at]
        off = np.abs(ranks - np.arange(len(top))[:, None])
        off[ranks < 0] = self.size
        return off.sum(0), self.size * len(top)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text else None
        if found is None or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        far, most = found
        return self.names[int(far.argmin())], float(min(1.0, max(0.0, 1 - far.min() / most)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from ``text`` alone."""

    @F.pandas_udf("lang_pred string, score double")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles, size)
        for batch in texts:
            yield pd.DataFrame([ranker.predict(t) for t in batch], columns=["lang_pred", "score"])

    (found,) = unused([*docs.columns, "lang_pred", "score"], "_found")
    return docs.withColumn(found, udf("text")).withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score")}).drop(found)
