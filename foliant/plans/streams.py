"""Queries over the streaming jobs (inventory O); each runs its stream to the end of the present data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import search as search_op
from foliant.plans.categorise import SIM, THRESHOLD, rounded
from foliant.plans.imports import _DOIS, flat_outcomes
from foliant.plans.inputs import papers
from foliant.plans.registry import query
from foliant.plans.search import BUCKETS, shown
from foliant.plans.views import table, view
from foliant.session import scratch_path
from foliant.streaming import jobs


def _stream(spark, sf_dir, name):
    # A table is one file or a folder of files; a pattern (here of this one name) may match either.
    return jobs.read_files(spark, f"{sf_dir}/{name}.[p]arquet", table(spark, sf_dir, name).schema)


def _queue(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    item = F.concat(F.lit("10.1234/abc."), F.col("user_id").cast("string"))
    return events.where(~F.col("event_type").isin("view", "error")).select(F.col("event_id").alias("seq"), item.alias("item"))


def _imported(spark, sf_dir) -> str:
    out = scratch_path(spark, "stream-import")
    jobs.import_stream(
        _queue(spark, sf_dir),
        papers(spark, sf_dir),
        view(spark, sf_dir, "article_records_v"),
        view(spark, sf_dir, "oa_records_v"),
        out,
        scratch_path(spark, "progress"),
    ).awaitTermination()
    return out


@query("stream_import", _DOIS + "SELECT * FROM outcomes")
def stream_import(spark, sf_dir):
    return flat_outcomes(spark.read.parquet(_imported(spark, sf_dir)).drop("batch"))


@query("stream_dedupe", """
SELECT min(seq) AS seq, item AS doi FROM import_queue_v WHERE mode = 'dois' AND item NOT IN (SELECT doi FROM papers_v WHERE doi IS NOT NULL) GROUP BY item
""")
def stream_dedupe(spark, sf_dir):
    out = scratch_path(spark, "stream-dedupe")
    items = _queue(spark, sf_dir).withColumnRenamed("item", "doi")
    jobs.dedupe_stream(items, papers(spark, sf_dir), out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("stream_progress", _DOIS + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def stream_progress(spark, sf_dir):
    out = _imported(spark, sf_dir)
    outcomes = jobs.read_files(spark, out, spark.read.parquet(out).schema)
    name = f"progress_{uuid.uuid4().hex}"
    jobs.progress_stream(outcomes, name, scratch_path(spark, "progress")).awaitTermination()
    return spark.table(name)


_WORDS = r"""
WITH field_text AS (SELECT doc_id AS id, 'abstract' AS field, text FROM @documents UNION ALL
  SELECT doc_id, 'keywords', concat(source, ' ', lang) FROM @documents UNION ALL SELECT doc_id, 'fulltext', text FROM @documents),
tok AS (SELECT id, field, term FROM (SELECT id, field, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM field_text) WHERE strlen(term) < 40),
post AS MATERIALIZED (SELECT term, field, id, count(*) AS tf FROM tok GROUP BY term, field, id),
len AS MATERIALIZED (SELECT id, field, sum(tf) AS dl FROM post GROUP BY id, field),
stat AS (SELECT field, CAST((SELECT count(*) FROM @documents) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / (SELECT count(*) FROM @documents) AS avgdl FROM len GROUP BY field),
freq AS (SELECT term, field, count(*) AS df FROM post WHERE term IN ('license', 'ering') GROUP BY term, field)
SELECT id, round(CAST(sum(s) AS DOUBLE), 4) + 0e0 AS score FROM (SELECT id, CAST(
  ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * CAST(dl AS DOUBLE) / avgdl))) AS DECIMAL(18,8)) AS s
  FROM post JOIN freq USING (term, field) JOIN len USING (id, field) JOIN stat USING (field)) t GROUP BY id
"""


@query("stream_index", _WORDS)
def stream_index(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    empty = F.lit("")
    shaped = docs.select(
        F.col("doc_id").alias("id"),
        empty.alias("title"),
        F.col("text").alias("abstract"),
        empty.alias("authors"),
        F.concat("source", F.lit(" "), "lang").alias("keywords"),
        F.col("text").alias("fulltext"),
        F.lit(None).cast("int").alias("year"),
        F.lit("2025").alias("date_modified"),
    )
    out = scratch_path(spark, "stream-index")
    jobs.index_stream(shaped, out, scratch_path(spark, "progress"), BUCKETS).awaitTermination()
    index = jobs.open_stream_index(spark, out, BUCKETS)
    return shown(search_op.search(index, search_op.any_of("license ering")))


@query("stream_categorise", f"WITH {SIM} SELECT id, category_id, round(s, 4) + 0e0 AS similarity FROM sims")
def stream_categorise(spark, sf_dir):
    docs = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = scratch_path(spark, "stream-categories")
    jobs.categorise_stream(
        docs, view(spark, sf_dir, "categories_v"), out, scratch_path(spark, "progress"), THRESHOLD
    ).awaitTermination()
    return rounded(spark.read.parquet(out))
