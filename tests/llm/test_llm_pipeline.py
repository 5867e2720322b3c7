"""Each stage of the pipeline, over its whole input, against brute force."""

from collections import Counter

import corpus_pipeline
from test_llm_joins import jaccard_truth, lines_truth
from test_llm_texts import library_ids

from foliant.llm import mixing, toxicity
from foliant.session import written

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    columns = docs.columns

    def step(name, before):
        out = written(stages[name](spark, before, SF), name)
        assert name == "packing" or out.columns == columns
        return out, out.toPandas()

    weights = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.learnable)
    scores = toxicity.score(docs, weights).toPandas()
    clean, rows = step("toxicity", docs)
    assert set(rows.doc_id) == set(scores[scores.score < 0.7].doc_id) and len(rows) < docs.count()

    want = lines_truth(list(zip(rows.doc_id, rows.text)))
    thin, rows = step("line_dedup", clean)
    assert dict(zip(rows.doc_id, rows.text)) == want and (rows.n_chars == rows.text.str.len()).all()

    truth = jaccard_truth(list(zip(rows.doc_id, rows.text)))
    single, rows = step("ngram_join", thin)
    assert set(rows.doc_id) == {i for i, (_, c) in truth.items() if c == i}

    taken = mixing.mix_sources(single).toPandas()
    mixed, rows = step("mixing", single)
    assert rows.text.str.split().str.len().sum() == taken.taken.sum()
    assert Counter(rows.doc_id).most_common(1)[0][1] <= 3

    _, pieces = step("packing", mixed)
    ids = sum(len(library_ids(t)) + 1 for t in rows.text)
    assert pieces.length.sum() == ids and pieces.length.max() <= corpus_pipeline.CAPACITY
    placed = pieces.sort_values(["sequence_id", "offset"])
    starts = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (starts == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= corpus_pipeline.CAPACITY
    assert placed.sequence_id.nunique() <= -(-ids // corpus_pipeline.CAPACITY) + 1


def test_odd_documents_go_through(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", None), (2, "", None, "a", None), (None, "x y z", "en", "a", 5), (3, "one line\none line", "en", "b", 17)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, SF), name)
        assert frame.columns[:2] == ["doc_id", "piece"]
