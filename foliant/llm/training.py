"""Labelled samples of bounded size, and models fitted on them in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches


def id_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column], limit: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``limit`` labelled documents, those with the smallest hashes.

    Labels that are neither 0 nor 1 are left out; of several labels of a document the largest holds. The chosen ids
    (at most ``limit`` of 16 bytes) are sent to all tasks, so texts are read where they lie.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = known.where(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray], most: int) -> np.ndarray:
    """Weights that ``fit`` makes of the sample, in the order of ids. ``most`` bounds rows that repeat an id."""

    def run(batches: Batches) -> Batches:
        texts: list[bytes] = []
        y: list[int] = []
        for b in batches:
            texts += [t.encode() for t in b["text"].to_pylist()]
            y += b["y"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(y, np.int64)).astype("<f4").tobytes()], pa.binary())], ["weights"])

    ordered = sample.orderBy("doc_id", "text").limit(most).coalesce(1).select("text", "y")
    rows = map_batches(ordered, run, "weights binary").collect()
    return np.frombuffer(bytes(rows[0]["weights"]), "<f4") if rows else fit([], np.zeros(0, np.int64))


def held_out_quality(scored: pd.DataFrame) -> dict[str, float]:
    """Accuracy, precision, recall and area under the curve of columns y, score and predicted."""
    y, p = scored["y"].to_numpy(), scored["predicted"].to_numpy()
    rank = scored["score"].rank().to_numpy()
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    area = (rank[y == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * zeros)
    hit = int(((p == 1) & (y == 1)).sum())
    return {
        "accuracy": float((p == y).mean()),
        "precision": hit / max(1, int((p == 1).sum())),
        "recall": hit / max(1, ones),
        "area": float(area),
    }
