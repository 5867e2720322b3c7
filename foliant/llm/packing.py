"""Best-fit packing by minimum bin slack over the counts of piece lengths.

How many pieces there are of each length is a table of at most ``capacity`` rows, whatever the size of the corpus. Bins
are planned on these counts: the longest piece left opens a bin, a bitset of reachable sums over the lengths left
finds the fullest completion, and the combination is used as often as its lengths last. Pieces then find their place
by their rank among the pieces of their length, which is numbered in shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches
from foliant.llm.tokens import encoder
from foliant.session import written

#: Pieces of one length are numbered in this many shards, so a length that a third of all pieces have is no hot group.
SHARDS = 512


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's ids (NULL text: only the end id)."""

    def cut(batches: Batches) -> Batches:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [list(c) for c in zip(*rows)] if rows else [[]] * 5
            types = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, largest first, whose sum is the largest that fits ``room``; ``lengths`` is descending."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, earlier in reversed(steps):
        if not earlier >> left & 1:
            chosen.append(length)
            left -= length
    return sorted(chosen, reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths) of the bins in order. Every step uses some length up to less than it needs again."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    bins: list[tuple[int, list[int]]] = []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        pattern = [top, *fullest(counts, lengths, capacity - top)]
        counts[top] += 1
        uses: dict[int, int] = {}
        for n in pattern:
            uses[n] = uses.get(n, 0) + 1
        times = min(counts[n] // k for n, k in uses.items())
        for n, k in uses.items():
            counts[n] -= times * k
        lengths = [n for n in lengths if counts[n]]
        bins.append((times, pattern))
    return bins


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length: rows of (first rank, first sequence, uses per sequence, offset of the first use)."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, pattern in bins:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            k = pattern.count(n)
            rows.setdefault(n, []).append((taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + times * k
            offset += k * n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def _placer(places: dict[int, np.ndarray]) -> Callable[[Batches], Batches]:
    def place(batches: Batches) -> Batches:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[group[0]])
                table = places[n]
                row = table[np.searchsorted(table[:, 0], rank[group], side="right") - 1]
                within = rank[group] - row[:, 0]
                sequence[group] = row[:, 1] + within // row[:, 2]
                offset[group] = row[:, 3] + within % row[:, 2] * n
            kept = [b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Documents longer than ``capacity`` ids are cut into full pieces and a last one. NULL or empty text is the end id
    alone. Repeated rows are packed as documents of their own; NULL ids are kept. An empty table gives no pieces.
    The driver holds one count per length (at most ``capacity`` numbers) and the plan made from them.
    """
    cut = written(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = _places(plan_bins(counts, capacity))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARDS)).cast("int")
    sharded = cut.withColumn("shard", shard)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = sharded.groupBy("length", "shard").count().select(
        "length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    inside = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = sharded.withColumn("inside", inside).join(shift, ["length", "shard"])
    numbered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("inside") - 1).alias("rank"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_batches(numbered, _placer(places), schema)
