import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import phrases
from foliant.operators import categorise as op


def plain_mmr(words, phrases, n, diversity):
    """The published rule, written out with dictionaries."""

    def vector(tokens):
        return {w: tokens.count(w) for w in tokens}

    def cos(a, b):
        dot = sum(v * b.get(k, 0) for k, v in a.items())
        return dot / (sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5)

    text, vs = vector(words), [vector(p.split()) for p in phrases]
    picked = []
    while len(picked) < min(n, len(phrases)):
        best, top = None, None
        for i in range(len(phrases)):
            if i in picked:
                continue
            value = cos(text, vs[i])
            if picked:
                value = (1 - diversity) * value - diversity * max(cos(vs[i], vs[j]) for j in picked)
            if top is None or round(value, 12) > top:
                best, top = i, round(value, 12)
        picked.append(best)
    return [phrases[i] for i in picked]


def test_mmr_against_plain_loop(spark):
    rng = random.Random(5)
    text = "Graph graph search finds paths; search engines rank paths and the graph engines rank results results"
    drawn = [" ".join(rng.choices("red green blue green yellow the pink 77".split(), k=n)) for n in (1, 2, 3, 9, 40, 200)]
    rows = spark.createDataFrame(list(enumerate([text, "", None, "of the", "same same same", *drawn])), "id BIGINT, abstract STRING")
    found = {r.id: (r.words or [], r.phrases or []) for r in op.candidate_phrases(rows).collect()}
    words, phrases = found[0]
    assert "the" not in words and "paths graph" in phrases  # stop words go before pairs are made
    for n, diversity in ((5, 0.5), (1, 0.5), (7, 0.0), (6, 0.9)):
        tags = {r.id: r.tags for r in op.mmr_tags(rows, n, diversity).collect()}
        assert tags == {i: plain_mmr(w, p, n, diversity) for i, (w, p) in found.items()}


def vectors(spark, n, name, seed):
    rng = np.random.default_rng(seed)
    raw = rng.normal(size=(n, 8))
    unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype("float32")
    rows = [(i, f"c{i}", [float(x) for x in v]) for i, v in enumerate(unit)]
    return spark.createDataFrame(rows, f"{name} BIGINT, name STRING, embedding ARRAY<FLOAT>"), unit


def test_similarity_in_blocks(spark, monkeypatch):
    docs, a = vectors(spark, 40, "id", 1)
    cats, b = vectors(spark, 23, "category_id", 2)
    sims = a.astype("float64") @ b.astype("float64").T
    want = {(i, j) for i in range(40) for j in range(23) if sims[i, j] >= 0.35}
    docs = docs.select("id", "embedding").union(spark.createDataFrame([(99, None)], "id BIGINT, embedding ARRAY<FLOAT>"))
    for block in (4096, 23, 10):
        monkeypatch.setattr(op, "BLOCK", block)
        got = {(r.id, r.category_id) for r in op.similarity_join(docs, cats).collect()}
        assert got == want
    monkeypatch.setattr(op, "ROWS", 7)
    monkeypatch.setattr(op, "CATEGORY_BYTES", 8 * 8 * 5)  # several parts of the table
    got = {(r.id, r.category_id) for r in op.similarity_join(docs, cats).collect()}
    assert got == want
    monkeypatch.undo()
    assert op.similarity_join(docs, cats.limit(0)).count() == 0
    wide = docs.union(spark.createDataFrame([(98, [1.0] * 9)], "id BIGINT, embedding ARRAY<FLOAT>"))
    with pytest.raises(Exception, match="vector width"):
        op.similarity_join(wide, cats).collect()
    with pytest.raises(ValueError, match="components"):
        op.similarity_join(docs, cats.union(spark.createDataFrame([(99, "w", [1.0])], cats.schema)))


def test_collections_of_categories(spark):
    tree = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (7, "z", None)], "id BIGINT, name STRING, parent_id BIGINT")
    cats = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "category_id BIGINT, name STRING")
    full = op.ensure_collections(tree, cats)
    new = {r.name: r.id for r in full.where("id > 7").collect()}
    assert new == {"b": 8, "c": 9}  # a root "a" is there; "b" is there only below another
    matches = spark.createDataFrame([(5, 0), (5, 2), (6, 1)], "id BIGINT, category_id BIGINT")
    assert {r.id: r.collection_ids for r in op.assign_collections(matches, cats, full).collect()} == {5: [1, 9], 6: [8]}
    assert {r.id: r.name for r in op.primary_category(matches, cats).collect()} == {5: "a", 6: "b"}


def test_apply_keeps_user_values(spark):
    papers = spark.createDataFrame(
        [(1, ["t", "x"], [4], "old"), (2, [], [], "old"), (3, ["k"], [9, 1], "old")],
        "id BIGINT, tags ARRAY<STRING>, collection_ids ARRAY<BIGINT>, date_modified STRING",
    )
    given = spark.createDataFrame([(1, [4, 2]), (3, [9])], "id BIGINT, collection_ids ARRAY<BIGINT>")
    tags = spark.createDataFrame([(2, ["n"]), (3, ["k"])], "id BIGINT, tags ARRAY<STRING>")
    got = {r.id: (r.tags, r.collection_ids, r.date_modified) for r in op.apply_categories(papers, given, tags, "now").collect()}
    assert got == {1: (["t", "x"], [2, 4], "now"), 2: (["n"], [], "now"), 3: (["k"], [9, 1], "old")}
    again = op.united(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a")))
    assert spark.range(1).select(again).first()[0] == ["a", "b"]


def test_embeddings_are_unit_vectors(spark):
    docs = spark.createDataFrame([(1, "graph search"), (2, "graph search"), (3, "cooking pasta")], "id BIGINT, text STRING")
    v = {r.id: np.array(r.embedding) for r in op.embed_text(docs, 64).collect()}
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-5 and np.dot(v[1], v[2]) > 0.999 > np.dot(v[1], v[3])


def test_tags_are_picked_from_few_texts_at_a_time(spark):
    words = [[f"w{i % 7}", "graph", f"v{i % 5}"] for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(words), pa.array(words)], names=["id", "words", "phrases"])
    parts = list(phrases.picked_phrases(5, 0.5)(iter([batch])))
    assert max(p.num_rows for p in parts) <= phrases.TEXTS
    assert [t for p in parts for t in p.column("tags").to_pylist()] == [phrases.pick_phrases(w, w, 5, 0.5) for w in words]
    rows = spark.createDataFrame([(1, "graph of words")], "id BIGINT, abstract STRING")
    tags = op.mmr_tags(rows)
    assert tags.first().tags[0] == "graph words"
    assert "MapInArrow" in tags._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= op.TEXT_BYTES


def test_texts_are_split_into_words_once(spark):
    docs = spark.createDataFrame([(1, "graph of words"), (2, "words")], "id BIGINT, text STRING")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    assert op.embed_text(docs.select("id", counted("text").alias("text")), 16).select("embedding").count() == 2
    op.embed_text(docs.select("id", counted("text").alias("text")), 16).select("embedding").collect()
    assert seen.value == 4  # one pass over two rows, twice
