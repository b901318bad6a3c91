"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A letter run (lower-cased, UTF-8) is one sequence; longer ones are cut into windows of ``WINDOW`` bytes. Both directions
read it, every byte position gets a probability of each language, and a document's probabilities are the mean over all its
positions. Equal runs have equal labels, so each task runs the network once per distinct run and then only adds rows up.

Training takes at most ``DOCS`` documents a language and ``RUNS`` letter runs of each, picked by hash and even spacing: a
bound of the model. Scoring reads whole texts. Null text, or text without a letter: ``und`` with score 0. Nothing to learn
from: every text is ``und``. Repeated rows score alike; an empty table gives an empty table.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.common import remainder

HIDDEN, WINDOW, DOCS, RUNS = 16, 24, 300, 150
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


class Model(NamedTuple):
    """Per direction: input table (byte -> gates z, r and candidate) and recurrent weights; output weights and bias."""

    langs: list[str]
    parts: list[np.ndarray]  # table forward, recurrent forward, table backward, recurrent backward, output, bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _states(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction for inputs (time, batch, 3 hidden)."""
    n = u.shape[0]
    h, out = np.zeros((x.shape[1], n), x.dtype), np.empty((*x.shape[:2], n), x.dtype)
    for t in range(x.shape[0]):
        gates = _sigmoid(x[t, :, : 2 * n] + h @ u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + (r * h) @ u[:, 2 * n :])
        if keep is not None:
            keep.append((h, z, r, c))
        h = out[t] = h + z * (c - h)
    return out


def _back(grad: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights, through time."""
    n = u.shape[0]
    dx, du, dh = np.empty((*grad.shape[:2], 3 * n), grad.dtype), np.zeros_like(u), np.zeros(grad.shape[1:], grad.dtype)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, c = kept[t]
        dh = dh + grad[t]
        dc = dh * z * (1 - c * c)
        drh = dc @ u[:, 2 * n :].T
        dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
        dgates = np.concatenate([dz, dr], 1)
        du[:, : 2 * n] += h.T @ dgates
        du[:, 2 * n :] += (r * h).T @ dc
        dx[t] = np.concatenate([dgates, dc], 1)
        dh = dh * (1 - z) + drh * r + dgates @ u[:, : 2 * n].T
    return dx, du


def positions(model: Model, data: np.ndarray) -> np.ndarray:
    """Probabilities (time, batch, language) of equally long byte sequences given as (batch, time)."""
    tf, uf, tb, ub, w, b = model.parts
    seq = data.T
    both = np.concatenate([_states(tf[seq], uf), _states(tb[seq[::-1]], ub)[::-1]], 2)
    logits = both @ w + b
    e = np.exp(logits - logits.max(2, keepdims=True))
    return e / e.sum(2, keepdims=True)


def fit(runs: list[bytes], labels: np.ndarray, langs: list[str], steps: int = 400, batch: int = 256, rate: float = 0.01,
        seed: int = 7) -> Model:
    """Adam on the mean cross entropy of all positions; each batch has runs of one length."""
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, len(langs)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    parts = [draw(256, 3 * h, s=0.3), draw(h, 3 * h, s=0.25), draw(256, 3 * h, s=0.3), draw(h, 3 * h, s=0.25), draw(2 * h, k, s=0.3), np.zeros(k, np.float32)]
    model = Model(langs, parts)
    if not runs or k < 2:
        return model
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    sizes = np.array([len(r) for r in runs])
    by_size = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    lengths = np.array(list(by_size))
    share = np.array([len(v) for v in by_size.values()]) / len(runs)
    for step in range(1, steps + 1):
        pick = rng.choice(by_size[rng.choice(lengths, p=share)], batch)
        seq = np.stack([np.frombuffer(runs[i], np.uint8) for i in pick]).T
        tf, uf, tb, ub, w, b = parts
        kept_f, kept_b = [], []
        both = np.concatenate([_states(tf[seq], uf, kept_f), _states(tb[seq[::-1]], ub, kept_b)[::-1]], 2)
        logits = both @ w + b
        e = np.exp(logits - logits.max(2, keepdims=True))
        d = e / e.sum(2, keepdims=True)
        d[:, np.arange(batch), labels[pick]] -= 1
        d /= d.shape[0] * batch
        grads = [None] * 6
        grads[4], grads[5] = np.tensordot(both, d, ([0, 1], [0, 1])), d.sum((0, 1))
        dboth = d @ w.T
        for at, (dh, kept, order) in enumerate([(dboth[..., :h], kept_f, seq), (dboth[::-1, :, h:], kept_b, seq[::-1])]):
            dx, grads[2 * at + 1] = _back(dh, parts[2 * at + 1], kept)
            grads[2 * at] = np.zeros_like(parts[2 * at])
            np.add.at(grads[2 * at], order, dx)
        for p, g, m, v in zip(parts, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _windows(run: str) -> list[bytes]:
    data = run.encode()
    return [data[a : a + WINDOW] for a in range(0, len(data), WINDOW)]


def train(docs: DataFrame, folds: int = 5) -> Model:
    """Fit on rows with text and lang whose crc32(doc_id) modulo ``folds`` is not 0."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", folds) != 0)).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 0.9 * DOCS / sizes[lang]))])
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text in zip(b.lang, b.text):
                runs = _LETTERS.findall(text.lower())
                rows += [(lang, w) for r in runs[:: max(1, -(-len(runs) // RUNS))] for w in _windows(r)[:2]]
            yield pd.DataFrame(rows, columns=["lang", "run"])

    rows = picked.mapInPandas(sample, "lang string, run binary").toPandas().sort_values(["lang", "run"], kind="stable")
    return fit([bytes(r) for r in rows.run], np.array([langs.index(x) for x in rows.lang], np.int64), langs)


class Labels:
    """Sums of position probabilities by letter run, computed once per distinct run."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.at = model, most, {}
        self.sums, self.used = np.empty((1 << 12, len(model.langs) + 1), np.float32), 0

    def learn(self, runs: set[str]) -> None:
        new = [r for r in runs if r not in self.at]
        if len(self.at) + len(new) > self.most:
            self.at, self.used = {}, 0
            new = list(runs)
        need = self.used + len(new)
        if need > len(self.sums):
            more = np.empty((max(need, 2 * len(self.sums)), self.sums.shape[1]), np.float32)
            more[: self.used] = self.sums[: self.used]
            self.sums = more
        self.sums[self.used : need] = 0
        by_size: dict[int, tuple[list[int], list[bytes]]] = {}
        for k, run in enumerate(new, self.used):
            self.at[run] = k
            for w in _windows(run):
                slot = by_size.setdefault(len(w), ([], []))
                slot[0].append(k)
                slot[1].append(w)
        for size, (rows, data) in by_size.items():
            for a in range(0, len(rows), 4096):
                block = np.frombuffer(b"".join(data[a : a + 4096]), np.uint8).reshape(-1, size)
                np.add.at(self.sums, rows[a : a + 4096], np.concatenate([positions(self.model, block).sum(0), np.full((len(block), 1), size, np.float32)], 1))
        self.used = need


def with_language(df: DataFrame, model: Model, text: Column) -> DataFrame:
    """Add ``language`` = struct(lang_pred, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        labels = Labels(model)
        for texts in batches:
            out = []
            for a in range(0, len(texts), 256):
                runs = [_LETTERS.findall(t.lower()) if t else [] for t in texts.iloc[a : a + 256]]
                if not model.langs:
                    out += [(UNKNOWN, 0.0)] * len(runs)
                    continue
                labels.learn({r for found in runs for r in found})
                for found in runs:
                    if not found:
                        out.append((UNKNOWN, 0.0))
                        continue
                    sums = labels.sums[np.fromiter(map(labels.at.__getitem__, found), np.int64)].sum(0, dtype=np.float64)
                    p = sums[:-1] / sums[-1]
                    out.append((model.langs[int(p.argmax())], float(min(1.0, p.max()))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return df.withColumn("language", predict(text))
