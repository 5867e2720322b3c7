"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic when at least one of its sentences is: its score is one minus the product of the sentences'
chances of being clean. Only documents have labels; the gradient of the noisy-or says which sentence to blame. The
same sentence scores then point at the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches, pieces, run_hashes, texts_of
from foliant.llm.training import fit_in_one_task, id_share, labelled_sample

#: Hashed weights: whole words and their first bytes.
WEIGHTS = 1 << 18
#: Labelled documents the model is fitted on, smallest hashes of their ids first.
FIT_DOCUMENTS = 6000
#: Fewest documents of the sample that a feature must occur in to get a weight.
LEAST_DOCUMENTS = 3
#: Documents by which the first log odds of a feature are drawn to the overall odds.
PRIOR = 3.0
_PREFIXES = (3, 4, 5, 6)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True  # line ends and ! . ?
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Sentences:
    """Sentences of several texts with their hashed features. A text without words has one sentence without features."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"".join(t + b"\n" for t in texts)
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = _WORD[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        owner = np.searchsorted(text_ends, starts, side="right")
        stop = np.cumsum(_STOP[data])[starts] if len(starts) else np.zeros(0, np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = stop[1:] != stop[:-1]  # a text ends with a line end, so sentences never span texts
        sentence = np.cumsum(fresh) - 1
        lone = np.setdiff1d(np.arange(len(texts)), owner)
        count = int(sentence[-1]) + 1 if len(sentence) else 0
        #: Text of each sentence, and the byte range of its words in the joined texts.
        self.owner = np.concatenate([owner[fresh], lone]).astype(np.int64)
        self.start = np.concatenate([starts[fresh], np.zeros(len(lone), np.int64)])
        last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]]) if count else np.zeros(0, np.int64)
        self.end = np.concatenate([ends[last], np.zeros(len(lone), np.int64)])
        self.joined, self.count = joined, count + len(lone)
        hashes = [run_hashes(data, starts, ends)]
        rows = [sentence]
        for size in _PREFIXES:
            long = np.flatnonzero(ends - starts > size)
            hashes.append(run_hashes(data, starts[long], starts[long] + size) + np.uint64(size))
            rows.append(sentence[long])
        self.feature = (np.concatenate(hashes) >> np.uint64(46)).astype(np.int64)
        self.row = np.concatenate(rows)

    def keep(self, known: np.ndarray) -> None:
        """Drop the features that are not known."""
        used = known[self.feature]
        self.feature, self.row = self.feature[used], self.row[used]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Chance of each sentence to be toxic; the last weight is the bias."""
        z = np.bincount(self.row, weights[self.feature], minlength=self.count) + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(chances: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """One minus the product of the chances of being clean, by text."""
    clean = np.bincount(owner, np.log1p(-np.minimum(chances, 1 - 1e-12)), minlength=texts)
    return -np.expm1(clean)


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 12, batch: int = 64) -> np.ndarray:
    """Weights by adaptive gradient steps on the log loss of the noisy-or. Without both labels, only a bias."""
    weights = np.zeros(WEIGHTS + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        weights[-1] = np.log(share / (1 - share))
        return weights
    weights[-1] = -5.0
    parts = [(Sentences(texts[k : k + batch]), y[k : k + batch]) for k in range(0, len(texts), batch)]
    held = np.zeros((2, WEIGHTS))  # documents of each label that hold a feature
    for s, labels in parts:
        pairs = np.unique(s.owner[s.row] * WEIGHTS + s.feature)
        for label in (0, 1):
            held[label] += np.bincount(pairs[labels[pairs // WEIGHTS] == label] % WEIGHTS, minlength=WEIGHTS)
    for s, _ in parts:  # a feature of one or two documents can only be learnt by heart
        s.keep(held.sum(axis=0) >= LEAST_DOCUMENTS)
    # The start: log odds of the label among the documents with the feature, drawn to the overall odds.
    start = np.log((held[1] + PRIOR * share) / (held[0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
    weights[:-1] = np.where(held.sum(axis=0) >= LEAST_DOCUMENTS, start, 0.0)
    squares = np.ones(WEIGHTS + 1)
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        for k in order.permutation(len(parts)):
            s, labels = parts[k]
            p = s.scores(weights)
            whole = np.clip(noisy_or(p, s.owner, len(labels)), 1e-9, 1 - 1e-9)
            blame = np.where(labels == 1, -(1 - whole) / whole, 1.0)[s.owner] * p
            used, at = np.unique(s.feature, return_inverse=True)
            step = np.bincount(at, blame[s.row], minlength=len(used)) + 1e-4 * weights[used]
            squares[used] += step * step
            weights[used] -= 0.3 * step / np.sqrt(squares[used])
            bias = blame.sum()
            squares[-1] += bias * bias
            weights[-1] -= 0.1 * bias / np.sqrt(squares[-1])
    return weights


def train(docs: DataFrame, labels: DataFrame, usable=None, limit: int = FIT_DOCUMENTS) -> np.ndarray:
    """Weights from labelled documents; ``usable`` says of an id whether its label may be learnt (default: all)."""
    sample = labelled_sample(docs, labels, "toxic", usable or (lambda i: F.lit(True)), limit)
    return fit_in_one_task(sample, fit, limit)


def score(docs: DataFrame, weights: np.ndarray, cut: float = 0.7, sentence_cut: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 from ``cut`` on) and the offending sentences (from ``sentence_cut`` on) of each row.

    NULL and empty texts get the score of a sentence without words. Every row is scored, repeated ones alike.
    """

    def run(batches: Batches) -> Batches:
        for b in batches:
            scores: list[float] = []
            found: list[list[str]] = []
            for start, stop in pieces(b, "text", 1 << 20):
                s = Sentences(texts_of(b, "text", start, stop))
                p = s.scores(weights)
                scores += noisy_or(p, s.owner, stop - start).tolist()
                own: list[list[str]] = [[] for _ in range(stop - start)]
                for k in np.flatnonzero(p >= sentence_cut):
                    own[s.owner[k]].append(s.joined[s.start[k] : s.end[k]].decode("utf-8", "replace"))
                found += own
            values = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(values, pa.float64()), pa.array((values >= cut).astype(np.int32)), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "score", "predicted", "offending"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int, offending array<string>")


def clean_documents(docs: DataFrame, weights: np.ndarray, cut: float = 0.7) -> DataFrame:
    """The rows whose score is below ``cut``, with all their columns."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for start, stop in pieces(b, "text", 1 << 20):
                s = Sentences(texts_of(b, "text", start, stop))
                keep = noisy_or(s.scores(weights), s.owner, stop - start) < cut
                yield b.slice(start, stop - start).filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)


def learnable(doc_id: Column) -> Column:
    """Ids whose labels may be learnt; the others are held out."""
    return id_share(doc_id, 3) != 1
