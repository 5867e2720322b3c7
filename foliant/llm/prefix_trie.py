"""Prefix trie of conversations, summed over subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns. Sequences are named by prefix sums: a turn at a place has a 128-bit number,
and the sums over the first turns name the sequence, so a conversation of any length is summed in chunks.

Every node has an arc that enters it and one that leaves it; the arc that follows is the first child's, the next sibling's
or the parent's. The tour is ranked in two steps. Nodes are numbered by smallest member and depth, which keeps subtrees
close together, so blocks of numbers first join their own arcs into fragments. The fragments, a small part of the arcs, are
then ranked by pointer jumping: one join a round, every round doubles the reach. Prefix sums of leaves and savings at the
arcs' places give the sums of each subtree as a difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.batches import Batches, drop_table, map_batches, stored
from foliant.operators.numbering import ranked
from foliant.session import ship_package, written

#: Conversations of one group share the first turns of its first conversation.
GROUP = 100
#: At most one less of them are shared.
SHARED = 6
#: Rows of one group of a running sum.
CHUNK = 4096
#: Nodes of a block whose arcs are joined in one task.
NODE_BLOCK = 2048
_LANES = ("l0", "l1", "l2", "l3")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.crc32(conv_id.cast("string")) % SHARED


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth, digest of role and text, code points, length) and the rebuilt
    conversations (conv_id, length), turnless ones included."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    narrow = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    own = written(ranked(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "k").drop("turn"), "own-turns")
    convs = own.groupBy("conv_id").agg(F.max("k").alias("own"))
    base = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": shared_turns(F.col("conv_id"))})
    first = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    plan = base.join(first, "base", "left").withColumn("lead", lead).withColumn("length", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = written(plan.select("conv_id", "base", "h", "lead", "length"), "conversations")
    # At most two groups' conversations have one base, and fewer than SHARED of its turns are taken.
    heads = own.where((F.col("k") < SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    head = plan.join(heads, "base").where("k <= lead").select("conv_id", F.col("k").alias("depth"), "digest", "chars", "length")
    tail = own.join(plan, "conv_id").where("k > h").select("conv_id", (F.col("lead") + F.col("k") - F.col("h")).alias("depth"), "digest", "chars", "length")
    return written(head.unionByName(tail), "rebuilt"), plan.select("conv_id", "length")


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes]))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key (of the first ``depth`` turns), parent_key, chars and whether the conversation ends there."""
    hashes = [F.xxhash64("depth", "digest", F.lit(k)) for k in (1, 2)]
    half = [x.bitwiseAND(0xFFFFFFFF) if low else F.shiftrightunsigned(x, 32) for x in hashes for low in (True, False)]
    placed = rebuilt.withColumns({"chunk": F.floor((F.col("depth") - 1) / CHUNK), **{f"own_{c}": h for c, h in zip(_LANES, half)}})
    # Only conversations longer than a chunk need what lies before a chunk.
    long = placed.where(F.col("length") > CHUNK).groupBy("conv_id", "chunk").agg(*[F.sum(f"own_{c}").alias(c) for c in _LANES])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = long.select("conv_id", "chunk", *[F.sum(c).over(earlier).alias(f"before_{c}") for c in _LANES])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(before, ["conv_id", "chunk"], "left").withColumns(
        {c: F.sum(f"own_{c}").over(upto) + F.coalesce(f"before_{c}", F.lit(0)) for c in _LANES}
    )
    return summed.select(
        "conv_id", "depth", _key(F.col("depth"), [F.col(c) for c in _LANES]).alias("key"),
        _key(F.col("depth") - 1, [F.col(c) - F.col(f"own_{c}") for c in _LANES]).alias("parent_key"),
        "chars", (F.col("depth") == F.col("length")).alias("last"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of the conversations that end at each node, in ascending order.

    Ids are joined to strings in pieces of a few thousand before they move. SHA-256 reads its input in order, so the pieces of
    one node stream through one task, which holds one piece at a time.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(piece.alias("piece"))

    def digest(batches: Batches) -> Batches:
        now, state = None, None
        for b in batches:
            keys, digests = [], []
            for key, text in zip(b["key"].to_pylist(), b["piece"].to_pylist()):
                if key == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    keys.append(now), digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    ordered = pieces.repartition("key").sortWithinPartitions("key", "chunk").select("key", "piece")
    return map_batches(ordered, digest, "key string, ends_sha256 string")


def _fragments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Arcs of a block of nodes joined as far as they follow one another inside it: arc, head of its fragment, its place
    there, and at heads the fragment's length and the arc that follows it."""
    v = pdf["v"].to_numpy(np.int64)
    order = np.argsort(v)
    arcs = np.stack([2 * v[order], 2 * v[order] + 1], axis=1).ravel()
    following = np.stack([pdf[c].to_numpy(np.int64)[order] for c in ("after_enter", "after_exit")], axis=1).ravel()
    weight = {c: np.stack([pdf[c].to_numpy(np.int64)[order], np.zeros(len(v), np.int64)], axis=1).ravel() for c in ("leaf", "saved")}
    at = np.minimum(np.searchsorted(arcs, following), len(arcs) - 1)
    inside = arcs[at] == following
    head, place = np.arange(len(arcs)), np.zeros(len(arcs), np.int64)
    head[at[inside]], place[at[inside]] = np.flatnonzero(inside), 1
    while True:
        farther = head[head]
        if (farther == head).all():
            break
        place, head = place + place[head], farther
    tails = np.flatnonzero(~inside)
    length, out = np.full(len(arcs), -1), np.full(len(arcs), -1)
    length[head[tails]], out[head[tails]] = place[tails] + 1, following[tails]
    return pd.DataFrame({"arc": arcs, "head": arcs[head], "place": place, "length": length, "out": out, **weight})


def list_ranks(fragments: DataFrame) -> DataFrame:
    """head and rest (elements from the head to the end of the list) by pointer jumping over (head, out, length).

    ``out`` is the head that follows, NULL at the end of the list. Every head is followed from one place at most, so no join key
    repeats; fragments that have reached the end take no further part as the asking side.
    """
    spark = fragments.sparkSession
    now, path = stored(fragments.select("head", "out", F.col("length").alias("rest")), "list-ranks")
    while now.where("out IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("head").alias("out"), F.col("out").alias("beyond"), F.col("rest").alias("more"))
        jumped = now.where("out IS NOT NULL").join(ahead, "out").select("head", F.col("beyond").alias("out"), (F.col("rest") + F.col("more")).alias("rest"))
        new, new_path = stored(now.where("out IS NULL").unionByName(jumped), "list-ranks")
        drop_table(spark, path)
        now, path = new, new_path
    return now.select("head", "rest")


def _subtree_sums(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """v, n_children, n_leaves and saved_tokens. ``nodes`` has v, n_convs and chars; ``tree`` v and p (parent) of all but the root."""
    ship_package(nodes.sparkSession)
    sides = written(ranked(tree.select("v", "p"), [], [F.col("p"), F.col("v")], "s"), "siblings")
    right = sides.select((F.col("s") - 1).alias("s"), F.col("p").alias("q"), F.col("v").alias("beside"))
    linked = sides.join(right, "s", "left").select("v", "p", F.when(F.col("p") == F.col("q"), F.col("beside")).alias("beside"))
    children = tree.groupBy(F.col("p").alias("v")).agg(F.min("v").alias("child"), F.count("*").alias("n_children"))
    placed = nodes.join(linked, "v", "left").join(children, "v", "left")
    arcs = placed.select(
        "v",
        F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("after_enter"),
        F.coalesce(2 * F.col("beside"), 2 * F.col("p") + 1, F.lit(-1)).alias("after_exit"),  # -1: the end of the tour
        F.col("child").isNull().cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    kind = "arc bigint, head bigint, place bigint, length bigint, out bigint, leaf bigint, saved bigint"
    joined = written(arcs.groupBy(F.floor(F.col("v") / NODE_BLOCK).alias("block")).applyInPandas(lambda pdf: _fragments(pdf), kind), "fragments")
    heads = joined.where("arc = head").select("head", F.when(F.col("out") >= 0, F.col("out")).alias("out"), "length")
    total = 2 * nodes.count()
    at = total - F.col("rest") + F.col("place")
    toured = written(joined.join(list_ranks(heads), "head").select("arc", at.alias("at"), F.floor(at / CHUNK).alias("chunk"), "leaf", "saved"), "tour")
    sums = toured.groupBy("chunk").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    before = sums.select("chunk", F.sum("leaf").over(earlier).alias("leaf_before"), F.sum("saved").over(earlier).alias("saved_before"))
    upto = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = toured.join(before, "chunk").withColumns({f"{c}_sum": F.sum(c).over(upto) + F.coalesce(f"{c}_before", F.lit(0)) for c in ("leaf", "saved")})
    # A subtree is what is added from its entering arc, itself included, to its leaving arc.
    part = {c: F.sum(F.when(F.col("arc") % 2 == 1, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum"))) for c in ("leaf", "saved")}
    of_node = running.groupBy(F.floor(F.col("arc") / 2).alias("v")).agg(part["leaf"].alias("n_leaves"), part["saved"].alias("saved_tokens"))
    return of_node.join(children.select("v", "n_children"), "v", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, NULL first, and where turns are equal by the digest of role and text; turns repeated in
    full count each. NULL role or text is empty; empty texts are turns like others. A conversation c takes its first
    ``shared_turns`` turns from conversation c - c % 100, as far as that has any, and keeps its own behind them. Rows
    without a conv_id belong to no conversation. Texts of any length are digested where they lie; other columns are not read.
    An empty table has no conversations and gives an empty result. Sequences are told apart by 128-bit numbers.
    """
    rebuilt, convs = rebuilt_turns(turns)
    rows = written(prefixes(rebuilt), "prefixes")
    root_key = _key(F.lit(0), [F.lit(0)] * len(_LANES))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root_key.alias("key"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("chars"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("parent_key")
    )
    deeper = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.max("depth").cast("bigint").alias("depth"), F.max("parent_key").alias("parent_key"),
    )
    order = [F.col("conv_id"), F.col("depth")]
    nodes = written(ranked(deeper.unionByName(root), [], order, "v").withColumn("v", F.col("v") - 1), "trie-nodes")
    above = nodes.select(F.col("key").alias("parent_key"), F.col("v").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    tree = written(nodes.where("parent_key IS NOT NULL").select("v", "parent_key").join(above, "parent_key").select("v", "p", "parent_conv_id"), "trie-edges")
    sums = _subtree_sums(nodes.select("v", "n_convs", "chars"), tree)
    ends = rows.where("last").select("key", "conv_id").unionByName(convs.where("length = 0").select(root_key.alias("key"), "conv_id"))
    found = nodes.join(tree.select("v", "parent_conv_id"), "v", "left").join(sums, "v").join(_end_digests(ends), "key", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
