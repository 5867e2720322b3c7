"""Arrow batches in tasks: shipping the package and hashing words of whole batches with numpy."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.session import scratch_path, ship_package

Batches = Iterator[pa.RecordBatch]
#: Texts of one Arrow batch; keeps a task's memory independent of the length of its documents.
BATCH_BYTES = 8 << 20
#: Largest table of ids that is broadcast, in bytes of its plain columns.
BROADCAST_BYTES = 16 << 20


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the executors and batches bounded in bytes as well as in rows."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def by_ids(rows: DataFrame, ids: DataFrame, on: list[str], row_bytes: int) -> DataFrame:
    """Rows joined to a table of few, narrow rows. The ids are counted: up to ``BROADCAST_BYTES`` they are sent to all
    tasks and the rows stay where they lie; beyond it both sides are shuffled."""
    small = ids.count() * row_bytes <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), on)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path, so that a later round can drop it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no result reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: its cleaner acts when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together hold about ``limit`` bytes; a longer text is a range of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _places(n: int) -> np.ndarray:
    """Odd multipliers for byte places; the first 64 are random, later ones follow from them."""
    if n <= len(_PLACE):
        return _PLACE
    k = np.arange(n, dtype=np.uint64)
    return np.where(k < 64, _PLACE[np.minimum(k, 63).astype(int)], mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order, not empty and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    at = place + np.repeat(starts, sizes)
    values = _BYTE[data[at]] * _places(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words (runs without ASCII blanks, A-Z lower-cased) of several texts: hashes, byte ranges and text numbers."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.data = _LOWER[np.frombuffer(joined, np.uint8)]
        word = ~_BLANK[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = run_hashes(self.data, self.starts, self.ends)
        self.text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        #: ``first[i]`` is the number of the first word of text i; the last entry is the number of words.
        self.first = np.concatenate(([0], np.searchsorted(self.starts, self.text_ends)))


def texts_of(batch: pa.RecordBatch, column: str, start: int, stop: int) -> list[bytes]:
    """UTF-8 of the texts in a row range, NULL as empty."""
    return [t or b"" for t in batch[column].slice(start, stop - start).cast(pa.large_binary()).to_pylist()]
