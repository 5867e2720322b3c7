"""N-gram Jaccard join: documents grouped by prefix and size, groups paired by prefix tokens, pairs verified.

Shingles are put into one global order: coarse frequency class first, then hash. The frequency classes come from a
sketch of fixed size over all documents; any order gives the same result, but passages that many documents share then
fall behind everyone's prefix. A document that can reach the threshold with another shares a shingle of its prefix
with it, so only prefixes are paired.

Of a prefix token's groups, first each is paired with one leader. Once these pairs are verified and joined into
components, only pairs that still lie in different components are left to check. Links inside a component would not
change the result, so a family of thousands of near copies is never paired with itself in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.batches import BROADCAST_BYTES, Batches, Words, by_ids, map_batches, mix, pieces, texts_of
from foliant.llm.components import components
from foliant.operators.numbering import ranked
from foliant.session import written

#: Counters of the frequency sketch (four bytes each), the same at every size of the corpus.
SKETCH = 1 << 20
#: A sketch is summed in slices of this many counters.
_SLICE = 1 << 15
#: Bits by which a shingle hash is shifted to give its counter.
_SHIFT = np.uint64(64 - 20)
_BITS = ("b0", "b1", "b2", "b3")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text (unsorted). Fewer words than a shingle make one shingle; none, none."""
    w = Words(texts)
    h = w.hashes
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + h[k : k + len(rolled)]
    rolled = mix(rolled)
    for first, last in zip(w.first[:-1], w.first[1:]):
        n = last - first
        if n >= words:
            yield np.unique(rolled[first : last - words + 1])
        elif n:
            short = np.array([n], np.uint64)
            for x in h[first:last]:
                short = short * _STEP + x
            yield mix(short)
        else:
            yield np.zeros(0, np.uint64)


def _frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """Class of each counter: 0 within four deviations of the median, then one more with every doubling of the excess."""

    def count(batches: Batches) -> Batches:
        sketch = np.zeros(SKETCH, np.int64)
        for b in batches:
            for start, stop in pieces(b, "text"):
                sets = list(shingle_sets(texts_of(b, "text", start, stop), words))
                if sets:
                    sketch += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=SKETCH)
        used = [k for k in range(0, SKETCH, _SLICE) if sketch[k : k + _SLICE].any()]
        parts = [sketch[k : k + _SLICE].astype("<i4").tobytes() for k in used]  # one task stays below 2^31
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(c, "<i4" if len(c) == 4 * _SLICE else "<i8").astype("<i8") for c in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [sums.tobytes()]})

    # Summed in two rounds, so that no group holds the slices of all tasks.
    partial = map_batches(docs.select("text"), count, "slice int, counts binary")
    salted = partial.groupBy("slice", F.pmod(F.xxhash64("counts"), F.lit(1024)).alias("salt")).applyInPandas(add, "slice int, counts binary")
    total = salted.groupBy("slice").applyInPandas(add, "slice int, counts binary")
    sketch = np.zeros(SKETCH, np.int64)
    for r in total.collect():  # at most SKETCH numbers
        sketch[r["slice"] : r["slice"] + _SLICE] = np.frombuffer(bytes(r["counts"]), "<i8")
    usual = float(np.median(sketch))
    slack = 4 * max(1.0, usual) ** 0.5  # counters of single shingles spread like random counts
    excess = np.maximum(sketch - usual, 0.5 * slack) / slack
    return np.maximum(0, np.ceil(np.log2(excess)) + 1).astype(np.uint8) * (excess > 1)


def _ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles in the global order."""
    return shingles[np.lexsort((shingles, classes[(shingles >> _SHIFT).astype(np.int64)]))]


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits of a set as four numbers. A shingle in one of two sets only flips one bit, so the number of bits
    in which two sets differ is at most the number of shingles they do not share."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def prefix_length(n: int, percent: int) -> int:
    """Shingles to look at so that a partner with at least ``percent`` Jaccard similarity shares one of them."""
    return n - -(-n * percent // 100) + 1


def shingle_table(docs: DataFrame, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Per document: n_shingles, digest of the set, digest of the prefix and the prefix itself."""

    def scan(batches: Batches) -> Batches:
        for b in batches:
            sizes, digests, groups, prefixes, bits = [], [], [], [], []
            for start, stop in pieces(b, "text"):
                for s in shingle_sets(texts_of(b, "text", start, stop), words):
                    ordered = _ordered(s, classes)
                    prefix = ordered[: prefix_length(len(s), percent)] if len(s) else ordered
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(ordered.tobytes(), digest_size=16).digest())
                    groups.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
                    prefixes.append(prefix.astype("<u8").tobytes())
                    bits.append(parity_bits(s))
            words_of_bits = np.array(bits, np.int64).reshape(len(bits), 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    b["text_hash"],
                    pa.array(sizes, pa.int64()),
                    *[pa.array(c, pa.binary()) for c in (digests, groups, prefixes)],
                    *[pa.array(np.ascontiguousarray(w)) for w in words_of_bits],
                ],
                ["doc_id", "text_hash", "n_shingles", "content", "prefix_digest", "prefix", *_BITS],
            )

    return map_batches(
        docs.select("doc_id", "text_hash", "text"),
        scan,
        "doc_id bigint, text_hash bigint, n_shingles bigint, content binary, prefix_digest binary, prefix binary, b0 bigint, b1 bigint, b2 bigint, b3 bigint",
    )


def _tokens(groups: DataFrame, classes: np.ndarray) -> DataFrame:
    """One row per group and prefix token: token, whether it is common, place in the prefix, group and size."""

    def spread(batches: Batches) -> Batches:
        for b in batches:
            parts = [np.frombuffer(p, "<i8") for p in b["prefix"].to_pylist()]
            lengths = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts) if parts else np.zeros(0, "<i8")
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens, pa.int64()),
                    pa.array(classes[(tokens.view(np.uint64) >> _SHIFT).astype(np.int64)] > 0),
                    pa.array(place.astype(np.int32)),
                    pa.array(np.repeat(b["grp"].to_numpy(), lengths)),
                    pa.array(np.repeat(b["n_shingles"].to_numpy(), lengths).astype(np.int32)),
                ],
                ["token", "common", "place", "grp", "n"],
            )

    return map_batches(groups.select("grp", "n_shingles", "prefix"), spread, "token bigint, common boolean, place int, grp bigint, n int")


def _shared_tokens(tokens: DataFrame) -> DataFrame:
    """The token rows whose token occurs in several groups, with the smallest of them as the token's leader.

    A token that the sketch does not call common has at most its counter's number of rows, little more than one of
    ``SKETCH`` equal shares of all shingles, so one shuffle and a window find its groups. Common tokens are few and may have very many rows: they are counted
    before the shuffle and joined back.
    """
    plain, common = tokens.where("NOT common").drop("common"), tokens.where("common").drop("common")
    of_token = Window.partitionBy("token")
    met = plain.withColumns({"groups": F.count("*").over(of_token), "leader": F.min("grp").over(of_token)}).where("groups > 1").drop("groups")
    often = common.groupBy("token").agg(F.count("*").alias("groups"), F.min("grp").alias("leader")).where("groups > 1").drop("groups")
    return met.unionByName(common.join(often, "token"))


def _may_reach(percent: int) -> str:
    """Sizes are close enough, and the shingles before and from the shared token on can hold the needed overlap."""
    most = "(least(l.place, r.place) + least(l.n - l.place, r.n - r.place))"
    return f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) AND {100 + percent} * {most} >= {percent} * (l.n + r.n)"


def _bits_allow(percent: int) -> str:
    """The sets differ in few enough parity bits for the needed overlap."""
    apart = " + ".join(f"bit_count(l.{b} ^ r.{b})" for b in _BITS)
    return f"{100 + percent} * (l.n + r.n - ({apart})) >= {2 * percent} * (l.n + r.n)"


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. Texts meet in two joins on single nodes."""

    def check(batches: Batches) -> Batches:
        for batch in batches:
            ok: list[bool] = []
            for start, stop in pieces(batch, "x", 2 << 20):
                left = shingle_sets(texts_of(batch, "x", start, stop), words)
                right = shingle_sets(texts_of(batch, "y", start, stop), words)
                for u, v in zip(left, right):
                    common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                    ok.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return map_batches(both.select("a", "b", "x", "y"), check, "a bigint, b bigint")


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether ``shared`` common prefix tokens, and all that lies behind a prefix, can make the needed overlap.

    Common tokens up to the earlier of the two prefix ends lie in both prefixes; behind it one set has only its rest.
    """
    rest = F.ceil(F.greatest(n, m) * percent / 100) - 1
    return (100 + percent) * (shared + rest) >= percent * (n + m)


def _star_pairs(shared: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): every group with the leader of most of its tokens, every member with the first content of its group."""
    lead = shared.where("grp = leader").select("token", F.struct("n", "place").alias("r"))
    met = shared.where("grp <> leader").select("token", "grp", "leader", F.struct("n", "place").alias("l")).join(lead, "token")
    ties = met.where(_may_reach(percent)).groupBy("grp", "leader").count()
    best = written(ties.groupBy("grp").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader")), "best-leaders")
    own = shared.select("grp", "token", "n").join(best, "grp")
    other = shared.select(F.col("grp").alias("leader"), "token", F.col("n").alias("m")).join(best.select("leader").distinct(), "leader", "left_semi")
    counted = own.join(other, ["leader", "token"]).groupBy("grp", "leader").agg(F.count("*").alias("s"), F.max("n").alias("n"), F.max("m").alias("m"))
    near = counted.where(_enough(F.col("s"), F.col("n"), F.col("m"), percent))
    stars = near.select(F.least("grp", "leader").alias("a"), F.greatest("grp", "leader").alias("b"))
    return stars.unionByName(members.where("grp <> node").select(F.col("grp").alias("a"), F.col("node").alias("b"))).distinct()


def _pairs_apart(shared: DataFrame, members: DataFrame, now: DataFrame, percent: int) -> DataFrame:
    """(a, b) in different components that share enough prefix tokens, or a group, to reach the threshold."""
    placed = members.join(now, "node", "left").select("grp", "node", "n_shingles", *_BITS, F.coalesce("component", "node").alias("comp"))
    by_token = shared.select("token", "grp", "n", "place").join(placed, "grp").select(
        F.lit(0).alias("kind"), F.col("token").alias("key"), "node", "comp", "n", "place", *_BITS
    )
    by_group = placed.select(
        F.lit(1).alias("kind"), F.col("grp").alias("key"), "node", "comp", F.col("n_shingles").cast("int").alias("n"), F.lit(0).alias("place"), *_BITS
    )
    rows = by_token.unionByName(by_group)
    split = rows.groupBy("kind", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("kind", "key")
    open_rows = written(rows.join(split, ["kind", "key"]), "open-tokens")
    # Components of a key are paired first, so rows of one component never meet one another; the rows of the smaller
    # component come in first, and of the pairs with the larger one only those that sizes, places and bits allow come out.
    comps = open_rows.groupBy("kind", "key", "comp").agg(F.count("*").alias("c"))
    ones = comps.select("kind", "key", F.col("comp").alias("one"), F.col("c").alias("c1"))
    twos = comps.select("kind", "key", F.col("comp").alias("two"), F.col("c").alias("c2"))
    meet = ones.join(twos, ["kind", "key"]).where("c1 < c2 OR c1 = c2 AND one < two").drop("c1", "c2")
    facts = F.struct("n", "place", *_BITS)
    left = open_rows.select("kind", "key", F.col("comp").alias("one"), F.col("node").alias("x"), facts.alias("l"))
    right = open_rows.select("kind", "key", F.col("comp").alias("two"), F.col("node").alias("y"), facts.alias("r"))
    met = meet.join(left, ["kind", "key", "one"]).join(right, ["kind", "key", "two"]).where(f"{_may_reach(percent)} AND {_bits_allow(percent)}")
    # Contents of one group have the whole prefix in common.
    tokens = F.sum(F.when(F.col("kind") == 1, F.col("l.n")).otherwise(1))
    counted = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        tokens.alias("s"), F.max("l.n").alias("n"), F.max("r.n").alias("m")
    )
    return counted.where(_enough(F.col("s"), F.col("n"), F.col("m"), percent)).select("a", "b")


def _texts_of_pairs(source: DataFrame, pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """node and text of the contents in some pairs, read from their first documents where these lie when they are few."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = written(nodes.join(contents.select("node", "doc_id", "text_hash"), "node"), "pair-nodes")
    found = by_ids(source, named, ["doc_id", "text_hash"], 24).select("node", "text")
    return written(found.dropDuplicates(["node"]), "texts")  # rows may repeat in full


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, text_hash, n_shingles and content; and of every content that has shingles its first document (doc_id,
    text_hash) and that of its component (first_id, first_hash).

    Contents are numbered in the order of their smallest doc_id, so texts that share an id are nodes of their own and
    the smallest number of a component belongs to its smallest doc_id.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    classes = _frequency_classes(source, words)
    table = written(shingle_table(source, words, percent, classes), "shingles")
    usable = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    found = usable.groupBy("content", "n_shingles", "prefix_digest", *_BITS).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    found = found.select("content", "n_shingles", "prefix_digest", *_BITS, "first.*")
    contents = written(ranked(found, [], [F.col("doc_id"), F.col("content")], "node"), "contents")
    groups = contents.groupBy("prefix_digest", "n_shingles").agg(F.min("node").alias("grp"))
    members = written(contents.join(groups, ["prefix_digest", "n_shingles"]).drop("prefix_digest"), "members")

    first = members.where("grp = node").select("doc_id", "grp", "content")
    prefixes = by_ids(usable.select("doc_id", "content", "n_shingles", "prefix"), first, ["doc_id", "content"], 32)
    shared = written(_shared_tokens(_tokens(prefixes, classes)), "shared-tokens")

    stars = written(_star_pairs(shared, members, percent), "star-pairs")
    linked = written(_verify(stars, _texts_of_pairs(source, stars, contents), words, percent), "star-links")
    apart = _pairs_apart(shared, members, components(linked), percent).join(stars, ["a", "b"], "left_anti")
    rest = written(apart, "rest-pairs")
    more = written(_verify(rest, _texts_of_pairs(source, rest, contents), words, percent), "rest-links")
    final = components(linked.unionByName(more))

    own = contents.select("content", "node", "doc_id", "text_hash").join(final, "node", "left")
    lowest = contents.select(F.col("node").alias("component"), F.col("doc_id").alias("lowest_id"), F.col("text_hash").alias("lowest_hash"))
    joined = own.join(lowest, "component", "left")
    of_content = joined.select(
        "content", "doc_id", "text_hash", F.coalesce("lowest_id", "doc_id").alias("first_id"), F.when(F.col("lowest_id").isNull(), F.col("text_hash")).otherwise(F.col("lowest_hash")).alias("first_hash")
    )
    return table.select("doc_id", "text_hash", "n_shingles", "content"), written(of_content, "content-components")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row.

    Two documents link when ``100 * common >= percent * union`` over their distinct shingles of ``words`` words.
    NULL, empty or blank text has no shingles and links with nothing; texts of any length are read whole. Equal sets are one
    content, whose copies link with one another. Rows with a NULL doc_id take part in no link and have a NULL component; of
    rows that repeat a doc_id each has the component of its own text. Other columns are not read. An empty table gives an
    empty result. Shingles are compared by 64-bit hashes.
    """
    rows, contents = _components(docs, words, percent)
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    joined = linked.join(contents.select("content", F.col("first_id").alias("component_id")), "content")
    alone = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The documents without those that link, directly or through others, to an earlier one: of a group the document with the
    smallest doc_id stays, once.

    A document is a doc_id with a text: of two texts under one id, each stays or goes with its own group. Rows that
    repeat such a document in full stay once. Rows with a NULL doc_id, and those with NULL, empty or blank text, belong to no
    group and all stay. All columns are kept as they are; an empty table gives an empty result.
    """
    rows, contents = _components(docs, words, percent)
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    placed = linked.join(contents.select("content", "first_id", "first_hash"), "content")
    counted = placed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("first_id").alias("first_id"), F.first("first_hash").alias("first_hash"))
    stays = (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    marked = written(counted.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), stays.alias("__stays")), "near-copies")
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("bigint"), "__text": F.xxhash64(F.coalesce("text", F.lit("")))})
    small = marked.count() * 24 <= BROADCAST_BYTES
    side = F.broadcast(marked) if small else marked.hint("shuffle_hash")
    met = keyed.join(side, (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left").where("__stays IS NULL OR __stays")
    once = met.where("__stays").dropDuplicates(["__doc", "__text"])  # rows of documents that are repeated in full
    return met.where("__stays IS NULL").unionByName(once).select(*[F.col(c) for c in docs.columns])
