"""Quality classifier: a byte-level convolutional network in numpy.

The text's UTF-8 bytes pass ``FILTERS`` learned filters of ``WIDTH`` bytes. Over
overlapping chunks (``CHUNK`` bytes, half of it apart) that cover the whole text
each filter's largest response is taken, and a small hidden layer gives the
chunk's logit. The mean, smallest and largest chunk logit are combined into one
probability.

Fitting uses at most ``rows`` labelled doc_ids (drawn by a hash, so the bound holds
at every size), every chunk of each of their texts; a text's chunks weigh together
as much as another's. Scoring covers every byte of every text.

Defined cases: null and empty texts get the score of an empty chunk; very long texts
are read in blocks; labels that are null, or other than 0 and 1, teach nothing;
repeated labels of a doc_id are averaged, a tie counts as 1; of rows that share a
doc_id the smallest text teaches; with labels of one kind only, or none (also: no
documents), the score is that kind's (0.5 without any); repeated rows are scored
alike; no rows give no rows; extra columns pass through (``score`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FILTERS, HIDDEN, CHUNK = 5, 16, 16, 512
HALF = CHUNK // 2
#: Bytes whose responses are held at once: a multiple of half a chunk.
BLOCK = HALF * 32
#: 256 stands for no byte.
NONE = 256


def to_bytes(text: str | None) -> np.ndarray:
    """The bytes, filled up with NONE so that every half chunk has one window at least."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([b, np.full(WIDTH - 1 if len(b) >= 1 else WIDTH, NONE, np.int64)]).astype(np.int16)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": (rng.normal(size=(WIDTH, 257, FILTERS)) * 0.3).astype(np.float32),
            "hidden": (rng.normal(size=(FILTERS, HIDDEN)) * (1 / FILTERS) ** 0.5).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": (rng.normal(size=HIDDEN) * 0.3).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.combine = np.array([1.0, 0.0, 0.0, 0.0])
        self.fixed: float | None = None

    def responses(self, b: np.ndarray) -> np.ndarray:
        n = b.shape[-1] - WIDTH + 1
        out = np.take(self.p["filters"][0], b[..., :n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.p["filters"][k], b[..., k : k + n], axis=0)
        return out

    def pooled(self, b: np.ndarray) -> np.ndarray:
        """Largest responses in each chunk of a whole text."""
        n = len(b) - WIDTH + 1
        halves = []
        for at in range(0, n, BLOCK):
            r = self.responses(b[at : min(at + BLOCK, n) + WIDTH - 1])
            halves.append(np.maximum.reduceat(r, np.arange(0, len(r), HALF), axis=0))
        h = np.concatenate(halves)
        return np.maximum(h[:-1], h[1:]) if len(h) > 1 else h

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(np.tanh(pooled) @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return z @ self.p["out"] + self.p["out_bias"][0]

    def features(self, text: str | None) -> np.ndarray:
        z = self.logits(self.pooled(to_bytes(text)))
        return np.array([z.mean(), z.min(), z.max(), 1.0])

    def score(self, text: str | None) -> float:
        if self.fixed is not None:
            return self.fixed
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.combine, -30, 30))))

    def step(self, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of chunks ``b`` (rows of bytes)."""
        p, n = self.p, len(b)
        r = self.responses(b)
        at = r.argmax(1)
        top = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
        a = np.tanh(top)
        z = a @ p["hidden"] + p["hidden_bias"]
        h = np.maximum(z, 0)
        d = (1 / (1 + np.exp(-(h @ p["out"] + p["out_bias"][0]))) - y) * weight / weight.sum()
        dz = d[:, None] * p["out"] * (z > 0)
        da = dz @ p["hidden"].T * (1 - a * a)
        g = {"out": h.T @ d, "out_bias": d.sum(keepdims=True), "hidden": a.T @ dz, "hidden_bias": dz.sum(0), "filters": np.zeros_like(p["filters"])}
        rows, cols = np.arange(n)[:, None], np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            np.add.at(g["filters"][k], (b[rows, at + k], cols), da)
        return g


def fit(chunks: np.ndarray, y: np.ndarray, doc: np.ndarray, epochs: int = 8, steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 0) -> Network:
    """``chunks``: rows of CHUNK + WIDTH - 1 bytes; ``doc``: which text each is of. At least ``steps`` steps, so that few rows are learned too."""
    net = Network(seed)
    if len(set(y.tolist())) < 2:
        net.fixed = float(y[0]) if len(y) else 0.5
        return net
    _, at, times = np.unique(doc, return_inverse=True, return_counts=True)
    each = 1 / times[at]
    share = (each * y).sum() / each.sum()
    weight = each / each.mean() * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # halfway between the true and equal shares
    rng, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    t = 0
    epochs = max(epochs, -(-steps // -(-len(y) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            take, t = order[i : i + batch], t + 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in net.step(chunks[take], y[take], weight[take]).items():
                m[k][0] = 0.9 * m[k][0] + 0.1 * g
                m[k][1] = 0.99 * m[k][1] + 0.01 * g * g
                net.p[k] -= (now * (m[k][0] / (1 - 0.9**t)) / (np.sqrt(m[k][1] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    z = np.concatenate([net.logits(net.responses(chunks[i : i + 256]).max(1)) for i in range(0, len(y), 256)])
    groups = pd.DataFrame({"doc": doc, "z": z, "y": y}).groupby("doc").agg(mean=("z", "mean"), low=("z", "min"), high=("z", "max"), y=("y", "first"))
    x, target = np.c_[groups[["mean", "low", "high"]].to_numpy(float), np.ones(len(groups))], groups["y"].to_numpy(float)
    w = net.combine.copy()
    for _ in range(30):  # Newton steps of a ridge logistic regression around the mean logit
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = 1.0 * (w - [1.0, 0, 0, 0])
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(4), x.T @ (q - target) + pull)
    net.combine = w
    return net


def _cut_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"]):
            b = to_bytes(text)
            last = max(0, (len(b) - WIDTH) // HALF - 1)
            b = np.concatenate([b, np.full(last * HALF + CHUNK + WIDTH - 1 - len(b), NONE, np.int16)]) if len(b) < last * HALF + CHUNK + WIDTH - 1 else b
            yield pd.DataFrame([(doc_id, i, label, b[i * HALF : i * HALF + CHUNK + WIDTH - 1].astype("<i2").tobytes()) for i in range(last + 1)], columns=["doc_id", "i", "label", "chunk"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 2000, seed: int = 42) -> Network:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, label): at most ``rows`` labelled texts, whose chunks come to the driver."""
    chosen = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    got = sorted(tuple(r) for r in texts.mapInPandas(_cut_chunks, "doc_id long, i long, label double, chunk binary").collect())
    x = np.frombuffer(b"".join(r[3] for r in got), "<i2").reshape(-1, CHUNK + WIDTH - 1)
    return fit(x, np.array([r[2] for r in got], np.float64), np.array([r[0] for r in got], np.int64), seed=seed)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``score``, from ``text`` alone."""

    @F.pandas_udf("double")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([net.score(t) for t in batch], dtype=float)

    return docs.withColumn("score", udf("text"))
