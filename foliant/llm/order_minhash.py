"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples.

For each of ``SKETCHES`` hash functions the two smallest k-mers (with their occurrence numbers, so that repeats count)
are taken, put back into text order and hashed together. Two texts agree in a position when they share both k-mers in
the same order, which follows edit distance more closely than sets of k-mers do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches, mix

K = 8
SKETCHES = 64
#: k-mers multiplied at once, small enough for a core's cache.
_CHUNK = 4096
_DOUBLING = [(1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xD1B54A32D192ED03)), (4, np.uint64(0xABC98388FB8FAC03))]
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTOR = (_RNG.integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _RNG.integers(0, 2**32, SKETCHES, dtype=np.uint32)[:, None]
_NUMBER = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def numbered_kmers(text: str) -> np.ndarray:
    """64-bit hashes of (k-mer of code points, occurrence number), in text order. Shorter texts are one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if 0 < len(points) < K:
        points = np.concatenate([points, np.zeros(K - len(points), np.uint64)])
    if not len(points):
        return points
    h = points
    for width, base in _DOUBLING:  # hashes of 2, 4 and 8 code points, each from two halves
        h = h[:-width] * base + h[width:]
        h = h ^ (h >> np.uint64(29))
    h = mix(h)
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    at, key = (packed & low).astype(np.int64), packed & ~low
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    order = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = (order - np.maximum.accumulate(np.where(fresh, order, 0))).astype(np.uint64)
    return mix(h ^ (occurrence * np.uint64(0xD6E8FEB86659FD93)))


def fingerprint(text: str) -> np.ndarray:
    """``SKETCHES`` 32-bit numbers; zeros for the empty text, which is like no other text."""
    full = numbered_kmers(text)
    n = len(full)
    if not n:
        return np.zeros(SKETCHES, np.uint32)
    short = (full >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(SKETCHES)
    values, places = [], []
    for at in range(0, n, _CHUNK):
        v = short[None, at : at + _CHUNK] * _FACTOR
        v += _SHIFT
        for again in range(min(2, v.shape[1])):
            i = v.argmin(axis=1)
            values.append(v[rows, i])
            places.append(i + at)
            if not again:
                v[rows, i] = np.uint32(0xFFFFFFFF)
    if len(values) == 1:
        first = second = places[0]
    else:
        key = np.stack(values).astype(np.uint64) << np.uint64(32) | np.stack(places).astype(np.uint64)
        two = np.sort(key, axis=0)[:2] & np.uint64(0xFFFFFFFF)
        first, second = np.sort(two, axis=0).astype(np.int64)
    tuples = mix(full[first] * np.uint64(3) + mix(full[second]) + _NUMBER) >> np.uint64(32)
    return np.maximum(tuples.astype(np.uint32), np.uint32(1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal positions; two empty texts are alike."""
    return float(np.count_nonzero(a == b)) / SKETCHES


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Batches) -> Batches:
    waiting = None  # (bucket, id, text, fingerprint) of the row whose successor has not been seen yet
    for b in batches:
        out: list[tuple] = []
        for bucket, marker, i, text in zip(*(b[c].to_pylist() for c in ("bucket", "marker", "doc_id", "text"))):
            if waiting is None or waiting[0] != bucket:
                if marker:
                    continue  # further candidates for a first row that is already known
            mark = fingerprint(text)
            if waiting is not None and waiting[0] == bucket:
                _, own_id, own, own_mark = waiting
                other = edited(own, text)
                other_mark = own_mark if other == own else fingerprint(other)
                out.append(
                    (
                        own_id,
                        len(own),
                        hashlib.sha256(other.encode()).hexdigest(),
                        own_mark.astype(">u4").tobytes().hex(),
                        other_mark.astype(">u4").tobytes().hex(),
                        likeness(own_mark, other_mark),
                        likeness(own_mark, mark),
                    )
                )
            waiting = None if marker else (bucket, i, text, mark)
        columns = [list(c) for c in zip(*out)] if out else [[]] * 7
        types = [b.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _bucket(cuts: list, doc_id: Column) -> Column:
    """Number of cuts at or above the id; NULL ids come last. A cut is the first row of its bucket."""
    if not cuts:
        return F.lit(0)
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(cuts))).otherwise(above)


def order_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest. Repeated ids
    follow one another by text; NULL ids come last; NULL text is empty. A single row is its own successor. An empty
    table gives an empty result.

    Rows are dealt into ranges of ids between quantiles. The first row of each range is also sent to the end of the
    range before it, so each text is shuffled once and every task sees the successor of its last row.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts + 1)])
    edge = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("cuts"), F.max("doc_id").alias("top")).first()
    cuts = sorted({c for c in edge["cuts"] or [] if c < edge["top"]}, reverse=True)
    bucket, last = _bucket(cuts, F.col("doc_id")), len(cuts)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(bucket.alias("bucket"), F.lit(False).alias("marker"), "doc_id", text)
    if edge["top"] is None:
        heads = docs.select(F.lit(0).alias("bucket"), F.lit(True).alias("marker"), "doc_id", text)
    else:
        first = docs.where(F.col("doc_id").isin(cuts) | (F.col("doc_id") == edge["top"]))
        before = F.when(F.col("doc_id") == edge["top"], F.lit(last)).otherwise(bucket - 1)
        heads = first.select(before.alias("bucket"), F.lit(True).alias("marker"), "doc_id", text)
    ordered = rows.unionByName(heads).repartition(max(parts, last + 1), "bucket").sortWithinPartitions(
        "bucket", "marker", F.col("doc_id").desc_nulls_last(), "text"
    )
    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(ordered, _compare, f"doc_id {kind}, {_OUT}")
