"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not. Severity grades of the labelled rows: 0 not toxic; toxic
rows are 1 to 3 by thirds of their *rate* of marked words, which is how many in a
hundred of their words are marked. Marked are words at least ``LIFT`` times as
frequent among toxic learning rows as among the others (rows without any are grade
1). Features are hashed letter words, ``log1p`` of how many of ``PER`` words they are,
so that a word weighs less in a longer text, as it does in its grade. The model is
P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector for all ordered
thresholds, fitted by proximal gradient steps (L1, so most weights are exactly 0),
until the loss stands still. Output: the expected grade, P(grade >= 1) and the
probable grade.

Fitting uses at most ``rows`` labelled doc_ids, drawn by a hash; scoring reads every
whole text.

Defined cases: null, empty and wordless texts are scored by the thresholds alone;
very long texts are counted word by word; labels other than 0 and 1 teach nothing,
repeated ones are averaged, a tie counts as toxic; of rows that share a doc_id the
smallest text teaches; without labels of both kinds (also: no documents) every
document gets grade 0, or the one kind there is; of equally probable grades the
lowest is given; repeated rows are scored alike; no rows give no rows; extra
columns pass through (the output columns are replaced).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.store import unused

GRADES, BITS, LIFT, LEAST = 4, 18, 10.0, 3
#: Words over which a feature's uses are counted.
PER = 300
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> dict[int, int]:
    """Hashed words and their counts."""
    out: dict[int, int] = {}
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        k = zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        out[k] = out.get(k, 0) + n
    return out


def rates(counts: np.ndarray) -> np.ndarray:
    """The features' values, from the counts of all of a text's words."""
    return np.log1p(PER * counts / max(1, counts.sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds, float)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        w, x = self.weights, 0.0
        if w and (found := features(text)):
            used = [k for k in found if k in w]
            x = float(np.log1p(PER * np.array([found[k] for k in used], float) / sum(found.values())) @ np.array([w[k] for k in used])) if used else 0.0
        return 1 - _sigmoid(self.thresholds - x)


def grade(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades of the learning rows (ids, counts)."""
    size, out = 1 << BITS, toxic.astype(int)
    seen = {y: np.bincount(np.concatenate([r[0] for r, t in zip(rows, toxic) if t == y] or [np.empty(0, int)]), minlength=size) for y in (0, 1)}
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marked = (seen[1] >= LEAST) & ((seen[1] + 0.5) / n1 >= LIFT * (seen[0] + 0.5) / n0)
    uses = np.array([c[marked[i]].sum() / max(1, c.sum()) for i, c in rows])
    some = np.sort(uses[(toxic > 0) & (uses > 0)])
    if len(some):
        low, high = some[len(some) // 3], some[2 * len(some) // 3]
        out += ((toxic > 0) & (uses > low)).astype(int) + ((toxic > 0) & (uses > high)).astype(int)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, steps: int = 400, l1: float = 2e-4) -> Ordinal:
    """``rows``: ids and counts of each text."""
    if len(set(toxic.tolist())) < 2:
        always = 30.0 if len(toxic) and toxic[0] else -30.0
        return Ordinal({}, [-always, 30.0, 31.0])
    y = grade(rows, toxic)
    used, at = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    x = np.concatenate([rates(c) for _, c in rows])
    w, n = np.zeros(len(used)), len(rows)
    share = np.array([max(np.mean(y >= k), 0.5 / n) for k in range(1, GRADES)])
    theta = -np.log(share / (1 - share).clip(0.5 / n))
    theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-3)
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    m = [np.zeros(len(w) + GRADES - 1), np.zeros(len(w) + GRADES - 1)]
    losses: list[float] = []
    for t in range(1, steps + 1):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, w[at] * x, n)
        f = np.c_[np.zeros(n), _sigmoid(theta - z[:, None]), np.ones(n)]
        hi, lo = f[np.arange(n), y + 1], f[np.arange(n), y]
        like = np.maximum(hi - lo, 1e-12)
        losses.append(float(-np.log(like).mean()))
        if t > 100 and max(losses[-40:]) - min(losses[-40:]) < 1e-4 * max(losses[0], 1e-9):
            break
        slope = f * (1 - f)
        dz = (slope[np.arange(n), y + 1] - slope[np.arange(n), y]) / like / n  # of the mean loss by z
        dth = np.array([(-(slope[y == k, k + 1] / like[y == k]).sum() + (slope[y == k + 1, k + 1] / like[y == k + 1]).sum()) / n for k in range(GRADES - 1)])
        g = np.concatenate([np.bincount(at, dz[row] * x, len(w)), [dth.sum()], [np.exp(gaps[k]) * dth[k + 1 :].sum() for k in range(GRADES - 2)]])
        m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
        rate = 0.1 * (1 - 0.9 * t / steps)
        scale = np.sqrt(m[1] / (1 - 0.999**t)) + 1e-5
        move = rate * (m[0] / (1 - 0.9**t)) / scale
        w = w - move[: len(w)]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / scale[: len(w)], 0)
        first, gaps = first - move[len(w)], gaps - move[len(w) + 1 :]
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return Ordinal({int(k): float(v) for k, v in zip(used, w) if v}, theta.tolist())


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "ids": [list(f) for f in found], "counts": [list(f.values()) for f in found]})


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, seed: int = 42) -> Ordinal:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): at most ``rows`` labelled doc_ids come to the driver, as counts."""
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    got = texts.mapInPandas(_sparse, "doc_id long, toxic int, ids array<int>, counts array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["ids"], r["counts"]))
    return fit([(np.array(r["ids"], np.int64), np.array(r["counts"], np.int64)) for r in got], np.array([r["toxic"] for r in got], int))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``expected_severity`` (0 to 3), ``p_toxic`` and ``severity`` (the most probable grade)."""

    @F.pandas_udf("expected_severity double, p_toxic double, severity int")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                p = model.above(t)
                each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
                out.append((float(p.sum()), float(p[0]), int(each.argmax())))
            yield pd.DataFrame(out, columns=["expected_severity", "p_toxic", "severity"])

    columns = ("expected_severity", "p_toxic", "severity")
    (found,) = unused([*docs.columns, *columns], "_found")
    return docs.withColumn(found, udf("text")).withColumns({c: F.col(f"{found}.{c}") for c in columns}).drop(found)
