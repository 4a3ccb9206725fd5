"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; unlabelled text is everything without a label.  Labelled negatives
aren't used.  With prior p of positives the risk of a scorer f is p R+(f) on positives plus, on negatives,
max(0, Ru-(f) - p Rp-(f)): unlabelled text taken as negative, less the share that its positives add.
When the second part turns negative, its gradient is followed backwards.  The prior comes from a first
scorer of positives against unlabelled text: the least ratio of the two tail frequencies over all thresholds, each
with its confidence margin (best bin).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, map_rows, row_struct, text_bytes, with_row

#: At most about so many rows of each kind are learnt from; which ones is decided by a hash of the id.
SAMPLE_POSITIVE = 15_000
SAMPLE_UNLABELLED = 30_000
FOLDS = 5

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FINE = np.full(256, 6, np.int64)  # lower, upper, digit, space, line end, control, beyond ASCII, then each sign
_FINE[:128] = 5
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3), (b"\n", 4)):
    _FINE[list(_chars)] = _class
_FINE[list(_SIGNS)] = 7 + np.arange(len(_SIGNS))
_COARSE = np.minimum(_FINE, 7)
_COARSE[list(b".,;:!?")] = 8
_COARSE[list(b"\"'()[]{}<>`")] = 9
_COARSE[list(b"-_/")] = 10
N_FINE, N_COARSE = 7 + len(_SIGNS), 11
WIDTH = N_FINE + N_COARSE**2 + 14


def features(text: bytes) -> np.ndarray:
    """Character classes, pairs of them, and figures on words and lines, of the whole text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        out[-1] = 1
        return out
    codes = np.frombuffer(text, np.uint8)
    n = len(codes)
    out[:N_FINE] = np.sqrt(np.bincount(_FINE[codes], minlength=N_FINE) / n)
    coarse = _COARSE[codes]
    out[N_FINE : N_FINE + N_COARSE**2] = np.sqrt(np.bincount(coarse[:-1] * N_COARSE + coarse[1:], minlength=N_COARSE**2) / n)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    count = max(1, len(words))
    distinct = len(set(words))
    out[-14:-1] = (
        np.log1p(len(words)), distinct / count, np.log1p(distinct), lengths.mean() if words else 0, lengths.std() if words else 0,
        (lengths <= 1).mean() if words else 0, (lengths <= 3).mean() if words else 0, (lengths > 12).mean() if words else 0, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(w.isupper() for w in words) / count,
        sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,;:!?") for w in words) / count,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _adam(gradient, size: int, steps: int = 400, rate: float = 0.03) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in unlabelled text from scores of both: the best bin's ratio of tail frequencies."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.95, 96)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(4 / confidence) / (2 * len(positive))) + np.sqrt(np.log(4 / confidence) / (2 * len(unlabelled)))
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


class PUModel:
    """A linear scorer of standardised features, fitted by the non-negative risk with logistic loss."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-3):
        self.mean = unlabelled.mean(0)
        self.scale = np.maximum(unlabelled.std(0), 1e-3)
        p, u = self._prepare(positive), self._prepare(unlabelled)

        def contrast(w):  # positives against unlabelled, both with weight one half
            return -(p.T @ _sigmoid(-p @ w)) / len(p) / 2 + u.T @ _sigmoid(u @ w) / len(u) / 2 + l2 * w

        first = _adam(contrast, p.shape[1], steps=200)
        self.prior = estimate_prior(p @ first, u @ first)

        def risk(w):
            sp, su = p @ w, u @ w
            negative = np.logaddexp(0, su).mean() - self.prior * np.logaddexp(0, sp).mean()
            down = u.T @ _sigmoid(su) / len(u) - self.prior * (p.T @ _sigmoid(sp)) / len(p)
            if negative < 0:
                return -down + l2 * w
            return -self.prior * (p.T @ _sigmoid(-sp)) / len(p) + down + l2 * w

        self.weights = _adam(risk, p.shape[1])

    def _prepare(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._prepare(x) @ self.weights)


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """About `most` of the ids, by their hash; all of them if there are no more."""
    ids = ids.distinct()
    n = ids.count()
    return ids if n <= most else ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (most / n)))


def _features_of(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the sampled ids' texts; ids is bounded by the sample's size, so it may be broadcast.

    An id counts once, with the least of its texts by hash: repeated ids don't add rows to what the driver gets.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["x"])

    own = docs.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = map_rows(own.select("t.text"), run, "x binary").toArrow()
    return np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, WIDTH).astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> PUModel | None:
    """Learn from rows outside fold 0.  An id with contradicting labels is neither positive nor unlabelled;
    null ids and labels are no labels.  None if there is no positive or no unlabelled row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("low"))
    learn = rows.select("id").where(F.col("id").isNotNull() & (fold("id", FOLDS) != 0))
    trusted = _sampled(told.where((F.col("low") == 1) & (fold("id", FOLDS) != 0)).select("id"), positives)
    x = _features_of(rows, trusted)
    u = _features_of(rows, _sampled(learn.join(told, "id", "left_anti"), unlabelled))
    return PUModel(x, u) if len(x) and len(u) else None


def score_quality(docs: DataFrame, model: PUModel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score), with `carry` also the whole input row as a struct `row`: how likely each whole text is good.

    One half for all without a model.  Null texts count as empty; other columns, whatever their names, lie inside `row`.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        score = model.score(np.array([features(t) for t in texts], np.float64)) if model and texts else np.full(len(texts), 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], ["id", "score", "row"][: batch.num_columns])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), *([row_struct(docs)] if carry else []))
    return map_rows(rows, run, with_row("id long, score double", rows))
