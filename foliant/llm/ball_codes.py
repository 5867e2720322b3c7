"""Vector compression: product codes whose codebooks are trained by ball k-means in exact integer arithmetic.

Every part of a vector lies in the ball of the entry it was assigned to. Once the entries have moved, only entries
whose distance to the ball's centre is at most twice the ball's radius are its neighbours. A part nearer to its centre
than half the way to the nearest neighbour is in the stable core and needs no comparison. Outside, the half distances
to the neighbours cut the ball into rings, and a part of ring k is compared with the first k neighbours only. Squared
distances are whole numbers, so no rounding decides a tie.

A round is one scan: tasks assign their parts and add up, for every entry, what they have assigned. One row per part,
entry and task is summed by Spark, so the driver sees no more than the codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, drop_table, map_batches, stored

#: Largest magnitude of an integer component; squared distances of parts then stay below 2^63.
_LARGEST = 1 << 27
#: Rows of a ball, by distance from its centre, that are compared with the neighbours of their outermost ring.
_RING_ROWS = 128


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: one integer array (entries, part width) a part."""

    parts: tuple[np.ndarray, ...]

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()


def whole_components(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one width, as rows of integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() > _LARGEST:
        raise ValueError(f"a component times {scale} is beyond {_LARGEST}")
    return whole.astype(np.int64).reshape(len(vectors), width)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, exact: by matrix product while doubles hold every sum."""
    largest = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    if 4 * int(largest) ** 2 * max(1, x.shape[1]) < 1 << 53:
        product = (x.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * product + (centres * centres).sum(1)[None, :]
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row, the lower of equals, and the squared distance."""
    d = _squares(x, centres)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def reassigned(x: np.ndarray, centres: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`nearest` for rows that lie in the balls ``home``."""
    own = ((x - centres[home]) ** 2).sum(1)
    between = _squares(centres, centres)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    # No other entry is as near as the own one unless it is within twice the part's distance from the centre.
    moving = np.flatnonzero(4 * own >= between.min(1, initial=np.iinfo(np.int64).max)[home])
    best, least = home.copy(), own.copy()
    order = moving[np.argsort(home[moving], kind="stable")]
    balls, starts = np.unique(home[order], return_index=True)
    for ball, start, stop in zip(balls, starts, [*starts[1:], len(order)]):
        inside = order[start:stop]
        inside = inside[np.argsort(own[inside], kind="stable")]
        radius = 4 * own[inside[-1]]
        near = np.flatnonzero(between[ball] <= radius)
        near = near[np.argsort(between[ball][near], kind="stable")]
        rings = np.searchsorted(between[ball][near], 4 * own[inside], side="right")
        for at in range(0, len(inside), _RING_ROWS):  # from the inner rings outwards
            rows, ring = inside[at : at + _RING_ROWS], rings[at : at + _RING_ROWS]
            some = near[: ring[-1]]
            d = _squares(x[rows], centres[some])
            d[np.arange(len(some))[None, :] >= ring[:, None]] = np.iinfo(np.int64).max
            low = d.min(1)
            entry = np.where(d == low[:, None], some[None, :], len(centres)).min(1)  # the lowest of equals
            take = (low < own[rows]) | ((low == own[rows]) & (entry < ball))
            best[rows[take]], least[rows[take]] = entry[take], low[take]
    return best, least


_CODED = "vec_id bigint, label string, whole binary, codes binary, error bigint, part int, entry int, n bigint, sums array<bigint>"


def _blocks(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["whole"].to_pylist()), "<i4").reshape(b.num_rows, width).astype(np.int64)


def _assigned(table: DataFrame, books: Codebooks, width: int, first: bool):
    """One round: the rows with new codes, and sums of what each entry has got in this task."""
    parts, wide = len(books.parts), width // len(books.parts)

    def assign(batches: Batches) -> Batches:
        sums = [np.zeros((len(c), wide), np.int64) for c in books.parts]
        counts = [np.zeros(len(c), np.int64) for c in books.parts]
        for b in batches:
            if not b.num_rows:
                continue
            x = _blocks(b, width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            old = None if first else np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(len(x), parts)
            for k, centres in enumerate(books.parts):
                piece = x[:, k * wide : (k + 1) * wide]
                best, least = nearest(piece, centres) if first else reassigned(piece, centres, old[:, k].astype(np.int64))
                codes[:, k] = best
                error += least
                np.add.at(sums[k], best, piece)
                counts[k] += np.bincount(best, minlength=len(centres))
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["label"], b["whole"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), none, none,
                 pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))],
                _NAMES,
            )
        used = [(k, e) for k in range(parts) for e in np.flatnonzero(counts[k])]
        if used:
            void = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(void, pa.int64()), pa.nulls(void, pa.string()), pa.nulls(void, pa.binary()), pa.nulls(void, pa.binary()), pa.nulls(void, pa.int64()),
                 pa.array([k for k, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()),
                 pa.array([int(counts[k][e]) for k, e in used], pa.int64()), pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64()))],
                _NAMES,
            )

    return map_batches(table.select("vec_id", "label", "whole", *([] if first else ["codes"])), assign, _CODED)


_NAMES = ["vec_id", "label", "whole", "codes", "error", "part", "entry", "n", "sums"]


def _moved(books: Codebooks, coded: DataFrame, wide: int) -> Codebooks:
    """Entries replaced by the floored mean of their parts; those without any stay."""
    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(wide)]
    rows = coded.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()  # one row an entry at most
    new = [p.copy() for p in books.parts]
    for r in rows:
        for k in range(wide):
            new[r["part"]][r["entry"], k] = r[f"s{k}"] // r["n"]
    return Codebooks(tuple(new))


def compress(
    rows: DataFrame, vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector is complete.

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts. Each part's codebook starts as that
    part of the ``entries`` (at most 256) smallest vec_ids, which then follows the means for ``rounds`` rounds of exact
    k-means (ties to the lower index, floored means, unused entries stay). Equal squared distances, repeated vectors and
    unused entries therefore always give the same codes.

    Rows with a NULL vector or NULL, NaN or infinite components are left out. NULL ids come after all others, and rows
    that repeat an id are ordered by their vectors. NULL labels are one label. Other columns are not read. A table
    without complete vectors gives an empty result. Vectors of different widths, widths that do not divide by ``parts``
    and components beyond 2^27 / scale are errors.
    """
    spark = rows.sparkSession
    complete = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(complete).select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col(vector).cast("array<double>").alias("vector"))
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(start[0]["vector"]) if start else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components do not have {parts} equal parts")
    wide = width // parts

    def measure(batches: Batches) -> Batches:
        for b in batches:
            sizes = b["vector"].value_lengths().to_numpy(zero_copy_only=False)
            if (sizes != width).any():
                raise ValueError("vectors of different widths")
            whole = whole_components(b["vector"], width, scale).astype("<i4")
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([w.tobytes() for w in whole], pa.binary())], ["vec_id", "label", "whole"])

    first = np.floor(np.array([r["vector"] for r in start], np.float64).reshape(len(start), width) * scale)
    if len(first) and np.abs(first).max(initial=0) > _LARGEST:
        raise ValueError(f"a component times {scale} is beyond {_LARGEST}")
    first = first.astype(np.int64)
    books = Codebooks(tuple(np.ascontiguousarray(first[:, k * wide : (k + 1) * wide]) for k in range(parts)))
    table, before = map_batches(kept, measure, "vec_id bigint, label string, whole binary"), None
    for turn in range(rounds + 1):
        coded, path = stored(_assigned(table, books, width, turn == 0), "vector-codes")
        if before:
            drop_table(spark, before)  # the new table holds all that later rounds read
        before = path
        table = coded.where("part IS NULL")
        if turn < rounds:
            books = _moved(books, coded, wide)

    digits = F.lower(F.hex("codes"))
    by_label = stored(table.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")[0]
    return table.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
