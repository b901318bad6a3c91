"""Quality classifier: hashed word n-gram logistic regression fitted by follow-the-regularised-leader updates.

A text's tokens are runs of word characters and runs of other marks; one- and two-token grams are hashed into ``2**BITS``
weights, with counts of unit length, so a score is one sparse dot product. Nothing but the text enters a score.

Training reads at most ``MOST`` labelled rows, picked by a hash of the id (a bound of the model, not of the scored data).
Null and empty texts have no features: their score is the bias alone. Without any labelled row every score is 0.5.
Repeated rows score alike; an empty table gives an empty table; clashing extra columns are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.bpe import Cache
from groundsieve.llm.common import remainder, whole

BITS = 20
MOST = 4_000
EPOCHS = 4
_TOKENS = regex.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0xD6E8FEB86659FD93)  # one gram for any token that repeats its neighbour


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


class Features:
    """Texts to (weight indices, values); index 0 is kept for the bias."""

    def __init__(self):
        self.known = Cache(_hash, most=300_000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(self.known.__getitem__, _TOKENS.findall(text or "")), np.uint64)
        pairs = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7))
        grams = np.concatenate([h, np.where(h[:-1] == h[1:], _SAME, pairs)])
        index, n = np.unique((grams * _MIX) >> np.uint64(64 - BITS), return_counts=True)
        index = np.maximum(index.astype(np.int64), 1)
        return index, n / math.sqrt(float((n * n).sum()) or 1.0)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(x, -35.0), 35.0)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02,
             l2: float = 0.05, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of FTRL-proximal: per weight, z gathers gradients and n their squares; small z stays exactly zero."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, 0), np.append(value, 1.0)
            w = weights(i)
            g = (_sigmoid(float(w @ x)) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    blocks = range(0, 1 << BITS, 1 << 16)  # small temporary arrays
    return np.concatenate([weights(np.arange(b, b + (1 << 16))).astype(np.float32) for b in blocks])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, most: int = MOST) -> np.ndarray:
    """Fit on labelled rows whose crc32(doc_id) modulo ``folds`` is not 0; at most ``most`` of them, by id hash."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0)).select(
        "doc_id", F.col(label).cast("int").alias("label"))
    share = min(1.0, 0.95 * most / max(1, usable.count()))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(usable.where(spread < share).limit(most))  # the bound makes it fit a broadcast
    texts = docs.select("doc_id", whole().alias("text")).join(picked, "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features()
        for b in batches:
            made = [of(t) for t in b.text]
            yield pd.DataFrame({"place": [_hash(str(k)) - (1 << 63) for k in b.doc_id], "doc_id": b.doc_id, "label": b.label,
                                "index": [i.astype(np.int32) for i, _ in made], "value": [v.astype(np.float32) for _, v in made]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for b in batches for row in zip(b["index"], b["value"], b["label"].tolist())]
        yield pd.DataFrame({"weights": [zstandard.compress(fit_ftrl(rows).tobytes())]})

    # one task sees the at most ``most`` rows: features of that many texts are too much beside the driver's own memory
    rows = texts.mapInPandas(features, "place long, doc_id long, label int, index array<int>, value array<float>")
    found = rows.repartition(1).sortWithinPartitions("place", "doc_id", "label").mapInPandas(fit, "weights binary").first()
    return np.frombuffer(zstandard.decompress(found.weights), np.float32) if found else fit_ftrl([])


def with_score(df: DataFrame, weights: np.ndarray, text: Column, name: str = "score") -> DataFrame:
    """Add the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, w = Features(), shared.value
        bias = float(w[0])
        for texts in batches:
            out = []
            for t in texts:
                i, x = of(t)
                out.append(_sigmoid(bias + float(w[i] @ x)))
            yield pd.Series(out, dtype="float64")

    return df.withColumn(name, score(text))
