"""Near-duplicate vectors: tiles compared along PCA axes, stopped when the cosine can no longer reach the threshold.

Unit vectors are rotated onto the axes of their second moments, largest first. A rotation keeps inner products, so
leading dimensions can be multiplied first; what the rest can add is at most the product of the suffix norms. Unit
vectors within the threshold are also close in every single axis, so the first two axes cut the space into cells and
only neighbouring cells meet. Tiles return counts and spanning links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, map_batches
from foliant.llm.components import components
from foliant.operators.numbering import ranked
from foliant.session import ship_package, written

#: The rotation is fitted on at most this many vectors of a width, smallest hashes first. It only sets the order of
#: the arithmetic; every vector is compared.
FIT_VECTORS = 8192
#: Rows of a block; a tile compares two blocks.
BLOCK_ROWS = 4096
#: Products this near to the threshold are computed again on the vectors as given.
_EDGE = 1e-12
_UNIT = "vec_id bigint, label string, width int, unit binary"


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Unit vectors in double precision of the rows that can link: id and label known, all components finite, not zero."""

    def scale(batches: Batches) -> Batches:
        for b in batches:
            ids, labels, widths, units = [], [], [], []
            for i, label, v in zip(b["vec_id"].to_pylist(), b["label"].to_pylist(), b["vector"].to_pylist()):
                x = np.array([math.nan if c is None else c for c in v], np.float64)
                largest = np.abs(x).max(initial=0.0)
                if not np.isfinite(largest) or not np.isfinite(x).all() or largest == 0:
                    continue
                x = x / largest + 0.0  # no overflow of squares; -0.0 becomes 0.0
                ids.append(i), labels.append(label), widths.append(len(x))
                units.append((x / math.sqrt(float(x @ x))).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(widths, pa.int32()), pa.array(units, pa.binary())],
                ["vec_id", "label", "width", "unit"],
            )

    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull())
    return map_batches(known.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col(vector).alias("vector")), scale, _UNIT)


def _axes(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack([np.frombuffer(u) for u in pdf["unit"]])
    _, vectors = np.linalg.eigh(x.T @ x)
    return pd.DataFrame({"width": [len(vectors)], "axes": [np.ascontiguousarray(vectors[:, ::-1]).tobytes()]})


def _join_small(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, smallest id) of the rows that the links (row numbers) connect."""
    rows, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    root = ids[rows].copy()
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == root).all():
            break
        root = new
    moved = ids[rows] != root
    return ids[rows][moved], root[moved]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with an inner product of at least ``threshold``; columns are in PCA order."""
    return _close(x, y, threshold, step)[:2]


def _close(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs and their products."""
    width = x.shape[1]
    stops = sorted({min(width, s) for s in (8, 16, 32, width)})
    rest_x = np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_y = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], 0))
    lefts, rights, products = [], [], []
    for at in range(0, len(x), step):
        a = x[at : at + step]
        done, part, rows = 0, np.zeros((len(a), len(y))), None
        for stop in stops:
            if rows is None:
                part += a[:, done:stop] @ y[:, done:stop].T
                bound = part if stop == width else part + np.outer(rest_x[at : at + step, stop], rest_y[:, stop])
                keep = bound >= threshold - (0 if stop == width else 1e-9)
                if stop == width or np.count_nonzero(keep) < keep.size / 16:
                    rows = np.nonzero(keep)
                    sums = part[rows]
            else:
                i, j = rows
                sums = sums + np.einsum("ij,ij->i", a[i, done:stop], y[j, done:stop])
                bound = sums if stop == width else sums + rest_x[at + i, stop] * rest_y[j, stop]
                keep = bound >= threshold - (0 if stop == width else 1e-9)
                rows, sums = (i[keep], j[keep]), sums[keep]
            done = stop
        lefts.append(rows[0] + at)
        rights.append(rows[1])
        products.append(sums)
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(products)


def _tile(threshold: float, axes: dict[int, np.ndarray]):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf["right"].to_numpy(bool)
        ids, copies = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        units = np.stack([np.frombuffer(v) for v in pdf["unit"]])
        z = units @ axes[units.shape[1]]
        own = bool(pdf["single"].iloc[0])
        first, second = np.flatnonzero(~right), np.arange(len(z)) if own else np.flatnonzero(right)
        if not len(first) or not len(second):
            return pd.DataFrame({"a": [], "b": [], "n": [], "is_count": []}).astype({"a": "int64", "b": "int64", "n": "int64", "is_count": bool})
        # The rotation moves a product by its last bits; what is that near to the threshold is decided by the vectors as given.
        i, j, product = _close(z[first], z[second], threshold - _EDGE)
        i, j = first[i], second[j]
        edge = np.flatnonzero(product < threshold + _EDGE)
        below = edge[np.einsum("ij,ij->i", units[i[edge]], units[j[edge]]) < threshold]
        i, j = np.delete(i, below), np.delete(j, below)
        if own:
            i, j = i[i < j], j[i < j]
        n = np.zeros(len(z), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        counted = np.flatnonzero(n)
        a, b = _join_small(ids, i, j)
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[counted], a]),
                "b": np.concatenate([np.full(len(counted), -1), b]),
                "n": np.concatenate([n[counted], np.zeros(len(a), np.int64)]),
                "is_count": np.concatenate([np.ones(len(counted), bool), np.zeros(len(a), bool)]),
            }
        )

    return compare


def near_duplicates(rows: DataFrame, threshold: float = 0.98, vector: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept.

    Vectors are compared when their labels are equal and not NULL and they have the same width. Rows with a NULL id,
    label or vector, a NULL or non-finite component or only zeros link with nothing and stay in components of their
    own (a NULL id has a NULL component and is kept). Equal vectors of one label are compared once, as one node, and
    count one another as links; of rows that repeat an id with other vectors each has the links of its own. A pair at the
    threshold links when the product of the unit vectors reaches it in double precision. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    units = written(unit_vectors(rows, vector).withColumn("digest", F.sha2("unit", 256)), "units")
    # Nodes are numbered by their smallest id: vectors that share an id stay apart, and the smallest number of a component is that
    # of its smallest id.
    same = units.groupBy("label", "width", "digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = written(ranked(same, [], [F.col(c) for c in ("vec_id", "label", "width", "digest")], "node"), "vector-nodes")
    # One unit vector per node: a row that carries the node's id and digest.
    bodies = units.join(nodes, ["label", "width", "digest", "vec_id"]).dropDuplicates(["node"])

    sample = None
    for width in [r["width"] for r in nodes.select("width").distinct().collect()]:
        some = units.where(F.col("width") == width).orderBy("digest").limit(FIT_VECTORS).select("width", "unit")
        sample = some if sample is None else sample.unionByName(some)
    if sample is None:
        alone = F.col("vec_id").cast("bigint")
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    axes = {
        r["width"]: np.frombuffer(bytes(r["axes"])).reshape(r["width"], r["width"])
        for r in sample.groupBy("width").applyInPandas(_axes, "width int, axes binary").collect()
    }
    reach = math.sqrt(2 * (1 - threshold)) + 1e-9

    def turn(batches: Batches) -> Batches:
        for b in batches:
            turned = [np.frombuffer(u) @ axes[w] for u, w in zip(b["unit"].to_pylist(), b["width"].to_pylist())]
            cells = [[math.floor((z[k] if k < len(z) else 0.0) / reach) for z in turned] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [b["node"], b["label"], b["width"], b["copies"], *[pa.array(c, pa.int32()) for c in cells], b["unit"]],
                ["node", "label", "width", "copies", "cx", "cy", "unit"],
            )

    placed = written(
        map_batches(
            bodies.select("node", "label", "width", "copies", "unit"),
            turn,
            "node bigint, label string, width int, copies bigint, cx int, cy int, unit binary",
        ),
        "placed-vectors",
    )
    cell = ["label", "width", "cx", "cy"]
    sizes = placed.groupBy(*cell).count().withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")).drop("count")
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    near = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = blocks.withColumn("d", F.explode(near)).select(
        "label", "width", (F.col("cx") + F.col("d.x")).alias("cx"), (F.col("cy") + F.col("d.y")).alias("cy"), F.struct("cx", "cy", "block").alias("low")
    )
    tiles = around.join(blocks.select(*cell, F.struct("cx", "cy", "block").alias("high")), cell).where("low <= high").select(
        "label", "width", "low", "high", (F.col("low") == F.col("high")).alias("single"), F.to_json(F.struct("label", "width", "low", "high")).alias("tile")
    )
    sides = tiles.select("*", F.explode(F.expr("if(single, array(false), array(false, true))")).alias("right")).withColumn(
        "own", F.when(F.col("right"), F.col("high")).otherwise(F.col("low"))
    )
    at = placed.join(sizes, cell).withColumn("own", F.struct("cx", "cy", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    compared = written(
        at.join(sides, ["label", "width", "own"])
        .select("tile", "single", "right", "node", "copies", "unit")
        .groupBy("tile")
        .applyInPandas(_tile(threshold, axes), "a bigint, b bigint, n bigint, is_count boolean"),
        "tiles",
    )
    linked = compared.where("is_count").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = components(compared.where("NOT is_count"))
    lowest = nodes.select(F.col("node").alias("component"), F.col("vec_id").alias("lowest"))
    of_node = nodes.join(linked, "node", "left").join(joined.join(lowest, "component"), "node", "left").select(
        F.col("label").alias("__label"),
        F.col("width").alias("__width"),
        F.col("digest").alias("__digest"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("lowest", "vec_id").alias("component_id"),
    )
    same_vector = [F.col(c) == F.col(f"__{c}") for c in ("label", "width", "digest")]
    members = units.join(of_node, same_vector)
    found = members.select("vec_id", "n_links", "component_id")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()
    # Rows that cannot link: those left out above, and of the others as many as the unit step left out.
    fit = rows.where(usable).select("vec_id", F.col(vector).alias("v"))
    bad = F.coalesce(F.expr("exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity')) OR NOT exists(v, c -> c <> 0)"), F.lit(True))
    alone = rows.where(~usable).select("vec_id").unionByName(fit.where(bad).select("vec_id"))
    return found.unionByName(
        alone.select(F.col("vec_id").cast("bigint"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    ).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
