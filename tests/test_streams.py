"""Streams over many small files give what the batch job gives, also when they are stopped and started again."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import imports, index as ix, search
from foliant.plans import streams
from foliant.plans.inputs import papers
from foliant.plans.views import table, view
from foliant.session import scratch_path
from foliant.streaming import jobs
from foliant.streaming.keys import KeyTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queue(spark):
    events = table(spark, SF, "events").where(~F.col("event_type").isin("view", "error"))
    number = F.col("event_id") % 97 + F.floor(F.col("event_id") / 250) * 40  # each quarter brings old and new items
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("10.1234/abc."), number.cast("string")).alias("item"))


def feed(spark, rows, folder, step):
    """One file per step, in order of arrival."""
    quarter = rows.withColumn("_n", F.ntile(4).over(Window.orderBy("seq"))).where(F.col("_n") == step).drop("_n")
    quarter.coalesce(1).write.mode("append").parquet(folder)


def test_import_with_restart(spark, queue):
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("feed", "out", "progress"))
    lib, art, oa = papers(spark, SF), view(spark, SF, "article_records_v"), view(spark, SF, "oa_records_v")
    for step in (1, 2, 3, 4):
        feed(spark, queue, folder, step)
        stream = jobs.read_files(spark, folder, queue.schema, per_batch=1)
        jobs.import_stream(stream, lib, art, oa, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    want = imports.import_dois(queue, lib, art, oa)
    key = lambda df: sorted((r.item, r.outcome, r.reason, r.title) for r in df.collect())
    assert key(got) == key(want)


def test_dedupe_in_batches(spark, queue):
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "out")
    for step in (1, 2, 3, 4):
        feed(spark, queue.withColumnRenamed("item", "doi"), folder, step)
    stream = jobs.read_files(spark, folder, "seq BIGINT, doi STRING", per_batch=1)
    jobs.dedupe_stream(stream, papers(spark, SF), out, scratch_path(spark, "progress")).awaitTermination()
    got = sorted(r.doi for r in spark.read.parquet(out).collect())
    assert len(got) == len(set(got)) > 0
    known = {r.doi for r in papers(spark, SF).select("doi").collect()}
    assert set(got) == {r.item for r in queue.collect()} - known


def test_keys_of_many_batches_lie_in_few_folders(spark):
    path, seen, opened = scratch_path(spark, "keys"), {}, []
    table_of_keys = KeyTable(spark, path, buckets=4, merge=4)
    for batch in range(14):
        own = [f"k{k}" for k in (batch, batch + 1, 3 * batch)] + [None]
        rows = spark.createDataFrame([(k,) for k in own], "key STRING")
        found = table_of_keys.earlier(rows, batch)
        assert {r.key: r.batch for r in found.collect()} == {k: seen[k] for k in own if k in seen}
        opened.append(len(table_of_keys.folders(batch)))
        table_of_keys.add(rows, batch)
        table_of_keys.add(rows, batch)  # a batch that is repeated
        seen.update({k: batch for k in own if k})
    assert max(opened) <= 4 and opened[13] == 2
    one = table_of_keys.earlier(spark.createDataFrame([("k1",)], "key STRING"), 13)
    assert len(one.inputFiles()) <= 8  # two folders of four buckets, after fourteen batches


def test_index_in_batches(spark):
    docs = [(i, f"title {i}", "common words here", "", "", f"body w{i % 3}", 2000 + i, "t") for i in range(12)]
    rows = spark.createDataFrame(docs, "id BIGINT, title STRING, abstract STRING, authors STRING, keywords STRING, fulltext STRING, year INT, date_modified STRING")
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("feed", "out", "progress"))
    query = search.any_of("w1 common")
    for step in range(3):
        rows.where(F.col("id") % 3 == step).coalesce(1).write.mode("append").parquet(folder)
        jobs.index_stream(jobs.read_files(spark, folder, rows.schema), out, checkpoint, 4).awaitTermination()
        found = search.search(jobs.open_stream_index(spark, out, 4), query)
        assert found.count() == 4 * (step + 1)
    batch = ix.write_index(rows, scratch_path(spark, "index"), 4)
    assert sorted(found.collect()) == sorted(search.search(batch, query).collect())


def test_a_document_that_comes_again_replaces_its_text(spark):
    schema = "id BIGINT, title STRING, abstract STRING, authors STRING, keywords STRING, fulltext STRING, year INT, date_modified STRING"
    row = lambda i, text, when: (i, f"title {i}", "", "", "", text, 2000, when)
    batches = [
        [row(1, "old words", "1"), row(2, "old other", "1"), row(3, "stay here", "1")],
        [row(1, "fresh words", "2"), row(4, "early", "1"), row(4, "late", "2")],
        [row(1, "third text", "3"), row(2, "fresh", "3")],
    ]
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("feed", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.index_stream(jobs.read_files(spark, folder, spark.createDataFrame(rows, schema).schema), out, checkpoint, 4).awaitTermination()
    now = spark.createDataFrame([row(1, "third text", "3"), row(2, "fresh", "3"), row(3, "stay here", "1"), row(4, "late", "2")], schema)
    want = ix.write_index(now, scratch_path(spark, "index"), 4)
    merged = jobs.merge_stream_index(spark, out, scratch_path(spark, "merged"), 4)
    for index in (jobs.open_stream_index(spark, out, 4), merged):
        for words in ("old words", "fresh early late", "third text stay"):
            assert sorted(search.search(index, search.any_of(words)).collect()) == sorted(search.search(want, search.any_of(words)).collect())
        assert sorted(search.result_rows(index, search.search(index, search.any_of("title"))).select("id").collect()) == [(1,), (2,), (3,), (4,)]
        assert sorted(index.stats.collect()) == sorted(want.stats.collect())


def test_progress_counts(spark):
    counts = {r.outcome: r.n for r in streams.stream_progress(spark, SF).collect()}
    assert sum(counts.values()) == streams.stream_import(spark, SF).count()
