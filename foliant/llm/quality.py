"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, then a linear hinge loss.

N-grams are taken over words, over the shapes of words (letter case, digits, marks) and over whether a word repeats
the one before, so that layout and repetition are seen as well as vocabulary. The hinge loss is minimised by dual
coordinate descent; a logistic curve fitted on documents the descent has not seen turns margins into scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, Words, map_batches, mix, pieces, run_hashes, texts_of
from foliant.llm.training import fit_in_one_task, id_share, labelled_sample

#: Hashed n-gram indicators.
FEATURES = 1 << 18
#: Labelled documents the model is fitted on, smallest hashes of their ids first.
FIT_DOCUMENTS = 6000
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:160] = ord("U")  # in two-byte letters of western scripts, mostly capitals
_SHAPE[160:192] = ord("u")
_SHAPE[192:] = ord("l")


def _grams(tokens: np.ndarray, width: int, kind: int) -> np.ndarray:
    """Hashes of runs of ``width`` tokens, each at the place of its first token (shorter at the end of the array)."""
    h = np.full(len(tokens), kind, np.uint64)
    for k in range(min(width, len(tokens))):
        h[: len(tokens) - k] = h[: len(tokens) - k] * np.uint64(0x9E3779B97F4A7C15) + tokens[k:]
    return mix(h)


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text; none for a text without words."""
    w = Words(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    shape = _SHAPE[raw]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[w.starts] = True
    at = np.concatenate(([0], np.cumsum(kept)))
    shapes = run_hashes(shape[kept], at[w.starts], at[w.ends])
    same = np.zeros(len(w.hashes), np.uint64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    grams = [(w.hashes, 1, 1), (w.hashes, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5), (same, 4, 6)]
    found = [((_grams(t, n, kind) >> np.uint64(46)).astype(np.int64), n) for t, n, kind in grams]
    return [
        np.unique(np.concatenate([f[a : max(a, b - n + 1)] for f, n in found])) for a, b in zip(w.first[:-1], w.first[1:])
    ]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of how often each indicator is set among documents of label 1 and of label 0, smoothed by one."""
    total = []
    for label in (1, 0):
        own = [r for r, k in zip(rows, y) if k == label]
        count = 1.0 + np.bincount(np.concatenate(own), minlength=FEATURES)
        total.append(count / (len(own) + 2.0))
    return np.log(total[0] / total[1])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the bias) that minimise the hinge loss with an L2 penalty, one dual variable at a time."""
    weights, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights


def _scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    """Ratios of the set indicators, divided by the root of their number."""
    return [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels, with the usual smoothing of the targets."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (p - target) + 1e-6 * theta
        curvature = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return float(theta[0]), float(theta[1])


def fit(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """``FEATURES`` weights with ratios and curve folded in, then the bias. Without both labels, only a bias."""
    model = np.zeros(FEATURES + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if min(y.sum(), len(y) - y.sum()) < 4:
        model[-1] = np.log(share / (1 - share))
        return model
    rows = [r for k in range(0, len(texts), 256) for r in indicators(texts[k : k + 256])]
    aside = np.zeros(len(y), bool)  # every fourth document of each label fits the curve
    for label in (0, 1):
        aside[np.flatnonzero(y == label)[::4]] = True
    learn = np.flatnonzero(~aside)
    ratio = log_count_ratios([rows[i] for i in learn], y[learn])
    values = _scaled(rows, ratio)
    weights = dual_descent([rows[i] for i in learn], [values[i] for i in learn], np.where(y[learn] == 1, 1.0, -1.0))
    margin = np.array([weights[r] @ v + weights[-1] for r, v in zip(rows, values)])
    slope, offset = _curve(margin[aside], y[aside])
    model[:-1] = slope * weights[:-1] * ratio
    model[-1] = slope * weights[-1] + offset
    return model


def train(docs: DataFrame, labels: DataFrame, usable=None, limit: int = FIT_DOCUMENTS) -> np.ndarray:
    """Model from labelled documents; ``usable`` says of an id whether its label may be learnt (default: all)."""
    sample = labelled_sample(docs, labels, "quality", usable or (lambda i: F.lit(True)), limit)
    return fit_in_one_task(sample, fit, limit)


def score(docs: DataFrame, model: np.ndarray, cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from ``cut`` on) of each row; NULL and empty texts get the score of the bias."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            scores: list[float] = []
            for start, stop in pieces(b, "text", 1 << 20):
                rows = indicators(texts_of(b, "text", start, stop))
                z = [model[r].sum(dtype=np.float64) / np.sqrt(max(1, len(r))) + float(model[-1]) for r in rows]
                scores += (1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))).tolist()
            values = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(values, pa.float64()), pa.array((values >= cut).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def learnable(doc_id: Column) -> Column:
    """Ids whose labels may be learnt; the others are held out."""
    return id_share(doc_id, 5) != 0
