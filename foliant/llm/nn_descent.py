"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

A neighbour of a neighbour is likely a neighbour. Every round joins the graph with itself at each node: what points to a node
or is pointed at by it is compared, and pairs nearer than a list's last entry enter that list. Only pairs with an
entry of the last round are new. Edges into a node that very many lists hold are sampled by its in-degree, so the work of
a node is bounded.

The first lists come from random projection trees. Their leaves also are the blocks in which the rounds run: nodes of one leaf
have common neighbours, so a block fetches each vector once. Building compares unit vectors in whole numbers (steps of
1/``SCALE``) by their squared distance, which orders them as the cosine does, but tells vectors apart whose cosines are all
near 1; sums of whole numbers do not depend on the order of addition. What is returned is measured on the original vectors.

Equal vectors are one node; its smallest ids are brought back at the end, so copies neither fill the lists nor are lost.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, drop_table, map_batches, mix, release_shuffles, stored
from foliant.session import ship_package, written

#: Unit vectors are multiplied by this and rounded, as fine as float32 components; their inner products are exact in float64.
SCALE = 1 << 25
#: Nodes of a leaf, on average.
LEAF = 512
#: Trees are fitted on at most so many nodes, those with the smallest digests, and hold at most so many numbers a tree.
FIT_NODES, FIT_NUMBERS = 32768, 1 << 19
#: Sample of a fitted leaf.
_LEAST = 16
_FOUND = "array<struct<score:bigint,other:bigint,home:bigint>>"
_LISTS = "block bigint, node bigint, small binary, near array<struct<score:bigint,other:bigint,home:bigint,fresh:boolean>>"


@dataclass(frozen=True)
class Graph:
    """Stored tables of an index: ``vectors`` (vec_id, digest, node, raw) holds the smallest ids of each node, ``points``
    (node, width, small) one row a node, ``lists`` (node, near) the neighbours, and ``ways`` (node, adjacent) where a search may go."""

    vectors: DataFrame
    points: DataFrame
    lists: DataFrame
    ways: DataFrame


def _usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, width, raw (doubles) and small (scaled unit vector) of complete, non-zero vectors."""

    def measure(batches: Batches) -> Batches:
        for b in batches:
            ids, widths, digests, raws, smalls = [], [], [], [], []
            for i, v in zip(b["id"].to_pylist(), b["vector"].to_pylist()):
                x = np.array([math.nan if c is None else c for c in v], np.float64) + 0.0  # -0.0 becomes 0.0
                largest = np.abs(x).max(initial=0.0)
                if not np.isfinite(x).all() or largest == 0:
                    continue
                unit = x / largest
                unit = unit / math.sqrt(float(unit @ unit))
                ids.append(i), widths.append(len(x)), raws.append(x.tobytes())
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                smalls.append(np.rint(unit * SCALE).astype(np.int32).tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), *[pa.array(c, pa.binary()) for c in (digests, raws, smalls)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "width", "digest", "raw", "small"])

    known = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull())
    return map_batches(known.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector")), measure, "id bigint, width int, digest binary, raw binary, small binary")


def _first(rows: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """The first n rows of each key; tasks keep no more than n of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, place).where(F.col(name) <= n)


def _matrix(rows: list[bytes]) -> np.ndarray:
    parts = list(rows)
    return np.frombuffer(b"".join(parts), np.int32).reshape(len(parts), -1).astype(np.float64)


def _closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus the squared distance of every row of x to every row of y."""
    return 2 * (x @ y.T) - np.einsum("ij,ij->i", x, x)[:, None] - np.einsum("ij,ij->i", y, y)[None, :]


# --- First lists: projection trees ----------------------------------------------------------------------------------


def _tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of a complete binary tree over the sample."""
    ways, cuts = np.zeros(((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
    members = {0: np.arange(len(sample))}
    for k in range(len(ways)):
        rows = members.pop(k, np.zeros(0, int))
        if len(rows) > 1:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            ways[k] = (a - b) / SCALE
            values = sample[rows] @ ways[k]
            cuts[k] = np.median(values)
            right = values > cuts[k]
        else:
            right = np.zeros(len(rows), bool)
        members[2 * k + 1], members[2 * k + 2] = rows[~right], rows[right]
    return ways, cuts


def _leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    ways, cuts = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, ways[at]) > cuts[at])
    return at - len(ways)


def _in_leaves(points: DataFrame, trees: int, seed: int) -> DataFrame:
    """node, small and block (width, tree, leaf and, where a leaf is crowded, a share of it) once for every tree."""
    forest = {}
    for r in points.groupBy("width").count().collect():  # widths of one table
        width, n = r["width"], r["count"]
        depth = min(math.ceil(math.log2(max(1, n / LEAF))), int(math.log2(FIT_NODES / _LEAST)), int(math.log2(max(2, FIT_NUMBERS / width))))
        some = points.where(F.col("width") == width).orderBy("digest").limit(FIT_NODES).select("small").collect() if depth else []
        sample = _matrix([bytes(s["small"]) for s in some]) if some else np.zeros((0, width))
        rng = np.random.default_rng(seed)
        forest[width] = depth, [_tree(sample, depth, rng) for _ in range(trees)] if depth else []

    def place(batches: Batches) -> Batches:
        for b in batches:
            widths, smalls = np.array(b["width"].to_pylist()), b["small"].to_pylist()
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                depth, grown = forest[int(width)]
                x = _matrix([smalls[i] for i in rows])
                own = b.take(pa.array(rows))
                for t in range(trees if depth else 1):
                    leaf = _leaves(x, grown[t], depth) if depth else np.zeros(len(rows), np.int64)
                    columns = [own["node"], own["width"], own["small"], pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "width", "small", "tree", "leaf"])

    leaf = ["width", "tree", "leaf"]
    placed = written(map_batches(points.select("node", "width", "small"), place, "node bigint, width int, small binary, tree int, leaf bigint"), "leaves")
    shares = placed.groupBy(*leaf).agg(F.ceil(F.count("*") / (1.5 * LEAF)).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("shares"))
    # Trees and leaves are bounded by FIT_NODES, so this table is small for every number of rows of a width.
    return placed.join(F.broadcast(shares), leaf).select("node", "small", "tree", F.xxhash64(*leaf, share).alias("block"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """Lengths of the lists of a column and their items."""
    lists = column.combine_chunks()
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _ragged(sizes: np.ndarray, **items: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in items.values()], list(items)))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Place of every row among those of its key; equal keys lie together."""
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return np.arange(len(keys)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(keys)]))))


def _nearest_first(node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best different entries of every node, in order; of equal ones that which is not fresh."""
    order = np.lexsort((fresh, other, -score, node))
    n, o = node[order], other[order]
    one = np.concatenate(([True], (n[1:] != n[:-1]) | (o[1:] != o[:-1]))) if len(n) else np.zeros(0, bool)
    order = order[one]
    return order[_ranks(node[order]) < k]


def _leaf_lists(k: int):
    """Of every node of a leaf: its k nearest there."""

    def compare(rows: pa.Table) -> pa.Table:
        nodes, homes, x = rows["node"].to_numpy(), rows["home"].to_numpy(), _matrix(rows["small"].to_pylist())
        most = min(k, len(x) - 1)
        picked, scored = [], []
        for at in range(0, len(x), 1024):  # a share may be larger than the average
            scores = _closeness(x[at : at + 1024], x)
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most else np.zeros((len(scores), 0), int)
            picked.append(best.ravel()), scored.append(np.take_along_axis(scores, best, 1).ravel())
        j, score = np.concatenate(picked), np.concatenate(scored).astype(np.int64)
        found = _ragged(np.full(len(x), most), score=score, other=nodes[j], home=homes[j])
        return pa.table({"home": rows["home"], "node": rows["node"], "found": found})

    return compare


def _merged(k: int):
    """The lists of a block's nodes with what was found for them."""

    def merge(lists: pa.Table, found: pa.Table) -> pa.Table:
        node = lists["node"].to_numpy()
        sizes, old = _flat(lists["near"])
        more, new = _flat(found["found"])
        node_of = np.concatenate([np.repeat(node, sizes), np.repeat(found["node"].to_numpy(), more)])
        score, other, home = (
            np.concatenate([old.field(c).to_numpy(zero_copy_only=False), new.field(c).to_numpy(zero_copy_only=False)]) for c in ("score", "other", "home")
        )
        fresh = np.arange(len(node_of)) >= len(old)
        best = _nearest_first(node_of, other, score, fresh, k)
        order = np.argsort(node, kind="stable")
        held = np.searchsorted(node_of[best], node[order], side="right") - np.searchsorted(node_of[best], node[order])
        near = _ragged(held, score=score[best], other=other[best], home=home[best], fresh=fresh[best])
        return pa.table({"block": lists["block"].take(order), "node": node[order], "small": lists["small"].take(order), "near": near})

    return merge


# --- Rounds of NN-descent -------------------------------------------------------------------------------------------


def _chosen(node: np.ndarray, other: np.ndarray, degree: np.ndarray, most: int, salt: int) -> np.ndarray:
    """Whether an edge is in this round's sample: all edges into ``other``, or about ``most`` where ``degree`` is more."""
    u = mix(mix(node.astype(np.uint64) + np.uint64(salt)) ^ other.astype(np.uint64)) >> np.uint64(11)
    return u.astype(np.float64) * degree < float(most) * (1 << 53)


def _gathered(k: int, most: int, salt: int):
    """Of every node of a block the members of its join: its neighbours (``ahead``) and some of those it is a neighbour
    of; and one row without a node that names each member of the block once."""

    def gather(lists: pa.Table, back: pa.Table) -> pa.Table:
        node = lists["node"].to_numpy()
        sizes, near = _flat(lists["near"])
        item = {c: near.field(c).to_numpy(zero_copy_only=False) for c in ("score", "other", "home", "fresh")}
        last = np.full(len(node), -(1 << 60), np.int64)
        full = np.flatnonzero(sizes >= k)
        last[full] = item["score"][np.cumsum(sizes)[full] - 1]
        to, source = back["node"].to_numpy(), back["member"].to_numpy()
        order = np.argsort(node, kind="stable")
        at = order[np.searchsorted(node[order], to)]
        degree = np.bincount(at, minlength=len(node))
        some = _chosen(source, to, degree[at], most, salt)
        row = np.concatenate([np.repeat(np.arange(len(node)), sizes), at[some]])
        member = np.concatenate([item["other"], source[some]])
        home = np.concatenate([item["home"], back["member_home"].to_numpy()[some]])
        fresh = np.concatenate([item["fresh"], back["fresh"].to_numpy(zero_copy_only=False)[some]]).astype(bool)
        ahead = np.arange(len(row)) < len(item["other"])
        moving = np.bincount(row[fresh], minlength=len(node)) > 0  # nothing is new at the others
        open_rows = np.flatnonzero(moving[row])
        open_rows = open_rows[np.argsort(row[open_rows], kind="stable")]
        _, one = np.unique(member[open_rows], return_index=True)
        each = open_rows[one]
        joined = np.concatenate([open_rows, each])
        held = np.concatenate([np.bincount(row[open_rows], minlength=len(node)), [len(each)]])
        members = _ragged(held, member=member[joined], home=home[joined], fresh=fresh[joined], ahead=ahead[joined])
        none = [None]
        return pa.table(
            {
                "block": pa.array([*lists["block"].to_pylist(), lists["block"][0].as_py()], pa.int64()),
                "node": pa.array([*node.tolist(), None], pa.int64()),
                "small": pa.array(lists["small"].to_pylist() + none, pa.binary()),
                "last": pa.array([*last.tolist(), None], pa.int64()),
                "degree": pa.array([*degree.tolist(), None], pa.int64()),
                "members": members,
            }
        )

    return gather


def _local_join(k: int, most: int, salt: int):
    """At every node of a block: pairs of its members, one of them fresh, that are nearer than a member's last neighbour."""

    def join(members: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        nothing = pa.table({"home": empty, "node": empty, "found": _ragged(empty, score=empty, other=empty, home=empty)})
        if not len(vectors):
            return nothing
        ids, homes, last, degree = (vectors[c].to_numpy() for c in ("id", "home", "last", "degree"))
        by_id = np.argsort(ids)
        ids, homes, last, degree = ids[by_id], homes[by_id], last[by_id].astype(np.float64), degree[by_id]
        smalls = vectors["small"].to_pylist()
        x = np.concatenate([_matrix([smalls[i] for i in by_id]), np.zeros((1, len(smalls[0]) // 4))])
        node = members["node"].to_numpy(zero_copy_only=False)
        sizes, items = _flat(members["members"])
        row, member = np.repeat(np.arange(len(node)), sizes), items.field("member").to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, member)
        ahead, fresh = (items.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("ahead", "fresh"))
        keep = ~ahead | _chosen(node[row].astype(np.int64), member, degree[at], most, salt)
        order = np.flatnonzero(keep)
        order = order[np.lexsort((~fresh[order], at[order], row[order]))]
        row, at, fresh = row[order], at[order], fresh[order]
        one = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1]))) if len(row) else np.zeros(0, bool)
        row, at, fresh = row[one], at[one], fresh[one]
        _, starts, sizes = np.unique(row, return_index=True, return_counts=True)
        froms, tos, scores = [empty], [empty], [empty.astype(np.float64)]
        bars = np.concatenate([last, [np.inf]])
        order = np.argsort(sizes, kind="stable")
        for part in (order[p : p + 32] for p in range(0, len(order), 32)):  # nodes with about as many members
            wide = sizes[part].max()
            place = starts[part][:, None] + np.arange(wide)[None, :]
            there = np.arange(wide)[None, :] < sizes[part][:, None]
            place = np.where(there, place, 0)
            who = np.where(there, at[place], len(ids))
            new = there & fresh[place]
            g = x[who]
            own = np.einsum("pij,pij->pi", g, g)
            s = 2 * (g @ g.transpose(0, 2, 1)) - own[:, :, None] - own[:, None, :]
            ok = (s > bars[who][:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, None, :]
            ok[:, np.arange(wide), np.arange(wide)] = False
            p, i, j = np.nonzero(ok)
            froms.append(who[p, i]), tos.append(who[p, j]), scores.append(s[p, i, j])
        a, b, s = np.concatenate(froms), np.concatenate(tos), np.concatenate(scores)
        best = _nearest_first(a, b, s, np.zeros(len(a), bool), k)
        a, b, s = a[best], b[best], s[best].astype(np.int64)
        who, held = np.unique(a, return_counts=True)
        return pa.table({"home": homes[who], "node": ids[who], "found": _ragged(held, score=s, other=ids[b], home=homes[b])})

    return join


def _descend(lists: DataFrame, k: int, most: int, salt: int) -> tuple[DataFrame, str]:
    """One round: the lists after joining neighbours of neighbours, and their path. ``fresh`` marks what was found."""
    spark = lists.sparkSession
    back = lists.select("block", "node", F.explode("near").alias("e")).select(
        F.col("e.home").alias("home"), F.col("e.other").alias("node"), F.col("node").alias("member"), F.col("block").alias("member_home"), "e.fresh"
    )
    kind = "block bigint, node bigint, small binary, last bigint, degree bigint, members array<struct<member:bigint,home:bigint,fresh:boolean,ahead:boolean>>"
    gathered = lists.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_gathered(k, most, salt), kind)
    members, members_path = stored(gathered, "members")
    known = members.where("node IS NOT NULL").select(F.col("node").alias("id"), "small", "last", "degree")
    wanted = members.where("node IS NULL").select(F.col("block").alias("asking"), F.explode("members").alias("m")).select("asking", F.col("m.member").alias("id"), "m.home")
    vectors = wanted.join(known, "id").select("asking", "id", "home", "small", "last", "degree")
    own = members.where("node IS NOT NULL AND size(members) > 0").select("block", "node", "members")
    found = own.groupBy("block").cogroup(vectors.groupBy("asking")).applyInArrow(_local_join(k, most, salt), f"home bigint, node bigint, found {_FOUND}")
    new = stored(lists.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_merged(k), _LISTS), "lists")
    drop_table(spark, members_path)
    return new


def build_graph(
    rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", k: int = 40, copies: int = 6, trees: int = 4, rounds: int = 8,
    settled: float = 0.02, seed: int = 11,
) -> Graph:
    """The neighbour graph of all complete vectors: each node's ``k`` nearest found, after at most ``rounds`` rounds or when a
    round changes less than ``settled`` of all list entries.

    Rows with a NULL id or vector, NULL, NaN or infinite components or only zeros take no part. Rows that repeat an id are
    one, that with the smallest digest. ``copies`` ids of equal vectors are kept for answers (one more than a search
    returns). Vectors of different widths are never near. An empty table gives an empty graph.
    """
    spark = rows.sparkSession
    ship_package(spark)
    each = _first(_usable(rows, id_column, vector).withColumnRenamed("id", "vec_id"), ["vec_id"], ["digest"], 1, "row").drop("row")
    kept = written(_first(each, ["digest"], ["vec_id"], copies, "place"), "vectors")
    ones = kept.where("place = 1").select(F.col("vec_id").alias("node"), "digest", "width", "small")
    vectors = written(kept.select("vec_id", "digest", "raw").join(ones.select("node", "digest"), "digest"), "node-vectors")
    leaves = written(_in_leaves(ones, trees, seed), "leaf-blocks")
    homes = leaves.where("tree = 0").select("node", F.col("block").alias("home"))
    points = written(ones.select("node", "width", "small"), "points")
    first = leaves.join(homes, "node").groupBy("block").applyInArrow(_leaf_lists(k), f"home bigint, node bigint, found {_FOUND}")
    bare = points.join(homes, "node").select(F.col("home").alias("block"), "node", "small", F.array().cast(_LISTS.split("near ")[1]).alias("near"))
    lists, path = stored(bare.groupBy("block").cogroup(first.groupBy("home")).applyInArrow(_merged(k), _LISTS), "lists")
    size = points.count() * k
    for turn in range(rounds):
        new, new_path = _descend(lists, k, (3 * k) // 4, seed + turn)
        drop_table(spark, path)
        lists, path = new, new_path
        release_shuffles(spark)
        if lists.agg(F.coalesce(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))), F.lit(0))).first()[0] < settled * size:
            break
    # A search may also go back along an edge; where very many edges lead into a node, along a sample of them.
    edges = lists.select("node", F.explode("near.other").alias("other"))
    into = edges.groupBy("other").agg(F.count("*").alias("degree"))
    some = F.pmod(F.xxhash64("node", "other"), F.lit(1 << 20)) * F.col("degree") < k << 20
    back = edges.join(into, "other").where(some).select(F.col("other").alias("node"), F.array("node").alias("adjacent"))
    ahead = lists.select("node", F.transform("near", lambda e: e["other"]).alias("adjacent"))
    ways = ahead.unionByName(back).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"))
    return Graph(vectors, points, lists, written(ways, "ways"))


# --- Search ---------------------------------------------------------------------------------------------------------


def _scores(pairs: DataFrame) -> DataFrame:
    """query, other and score of rows with the scaled unit vectors of both."""

    def multiply(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                x, y = b["small"].to_pylist(), b["asked"].to_pylist()
                widths = np.array([len(p) for p in x])
                score = np.zeros(len(x), np.int64)
                for width in np.unique(widths):
                    rows = np.flatnonzero(widths == width)
                    apart = _matrix([x[i] for i in rows]) - _matrix([y[i] for i in rows])
                    score[rows] = -np.einsum("ij,ij->i", apart, apart).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["query"], b["other"], pa.array(score)], ["query", "other", "score"])

    return map_batches(pairs.select("query", "other", "small", "asked"), multiply, "query bigint, other bigint, score bigint")


def _entries(graph: Graph, n: int) -> list[int]:
    return [r["node"] for r in graph.points.select("node").orderBy(F.xxhash64("node"), "node").limit(n).collect()]


def greedy_search(
    graph: Graph, queries: DataFrame, vector: str = "embedding", id_column: str = "vec_id", top: int = 5, beam: int = 224, step: int = 56, entries: int = 32
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest found of each query; its own id is no answer.

    A query keeps its ``beam`` best nodes and goes on from the best ``step`` of them that it has not left yet, until it has left
    all. It starts at its own node if the index has its vector, else at ``entries`` fixed nodes. Scores are cosines of
    the original vectors in double precision; equal scores are ordered by vec_id. Incomplete or zero queries get no answer,
    queries that repeat an id are one (the smallest digest). ``top`` must be less than the ``copies`` of the graph.
    """
    spark = queries.sparkSession
    asked = _first(_usable(queries, id_column, vector).withColumnRenamed("id", "query"), ["query"], ["digest"], 1, "row").drop("row")
    own = graph.vectors.where("vec_id = node").select("digest", "node")
    asked = written(asked.join(own, "digest", "left"), "queries")
    fixed = F.array(*[F.lit(e).cast("bigint") for e in _entries(graph, entries)]).cast("array<bigint>")
    starts = asked.select("query", F.explode(F.when(F.col("node").isNotNull(), F.array("node")).otherwise(fixed)).alias("other"))
    small = graph.points.select(F.col("node").alias("other"), "width", "small")

    def measured(pairs: DataFrame) -> DataFrame:
        vector_of = asked.select("query", F.col("small").alias("asked"), F.col("width").alias("asked_width"))
        return _scores(pairs.join(small, "other").join(vector_of, "query").where("width = asked_width"))

    def merged(rows: DataFrame) -> DataFrame:
        """The best of each query; an entry that was left stays so."""
        item = F.struct("score", (-F.col("other")).alias("order"), "other", "left")
        one = rows.groupBy("query", "other").agg(F.max("score").alias("score"), F.max("left").alias("left"))
        return one.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(item), asc=False), 1, beam).alias("items"))

    now, path = stored(merged(measured(starts).withColumn("left", F.lit(False))), "beams")
    while True:
        ahead = F.slice(F.filter("items", lambda e: ~e["left"]), 1, step)
        going = now.select("query", F.explode(ahead).alias("e")).select("query", F.col("e.other").alias("node"))
        if not going.limit(1).count():
            break
        met = going.join(graph.ways, "node").select("query", F.explode("adjacent").alias("other")).distinct()
        left = F.transform("items", lambda e: F.struct(e["score"].alias("score"), e["other"].alias("other"), (e["left"] | F.array_contains(F.transform(ahead, lambda a: a["other"]), e["other"])).alias("left")))
        before = now.select("query", F.explode(left).alias("e")).select("query", "e.other", "e.score", "e.left")
        new, new_path = stored(merged(measured(met).withColumn("left", F.lit(False)).unionByName(before.select("query", "other", "score", "left"))), "beams")
        drop_table(spark, path)
        now, path = new, new_path

    found = now.select("query", F.explode("items").alias("e")).select("query", F.col("e.other").alias("node"))
    pairs = found.join(graph.vectors, "node").where("vec_id <> query").select("query", "vec_id", "raw")
    exact = _cosines(pairs.join(asked.select("query", F.col("raw").alias("asked")), "query"))
    ranked = _first(exact.withColumn("down", -F.col("score")), ["query"], ["down", "vec_id"], top, "rank")
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _cosines(pairs: DataFrame) -> DataFrame:
    def measure(batches: Batches) -> Batches:
        for b in batches:
            scores = []
            for x, y in zip(b["raw"].to_pylist(), b["asked"].to_pylist()):
                u, v = np.frombuffer(x), np.frombuffer(y)
                if max(np.abs(u).max(), np.abs(v).max()) > 1e150 or min(np.abs(u).max(), np.abs(v).max()) < 1e-150:
                    u, v = u / np.abs(u).max(), v / np.abs(v).max()  # squares would leave the range of doubles
                scores.append(float(u @ v) / (math.sqrt(float(u @ u)) * math.sqrt(float(v @ v))))
            yield pa.RecordBatch.from_arrays([b["query"], b["vec_id"], pa.array(scores, pa.float64())], ["query", "vec_id", "score"])

    return map_batches(pairs.select("query", "vec_id", "raw", "asked"), measure, "query bigint, vec_id bigint, score double")
