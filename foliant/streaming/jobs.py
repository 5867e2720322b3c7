"""Long-running imports, indexing and categorising as streams.

State lives in tables: a micro-batch writes its own ``batch=<id>`` folder and overwrites it when it is replayed, so
a restart from the checkpoint repeats nothing and loses nothing. What earlier batches have seen is kept as keys by hash
(``KeyTable``): a batch reads the buckets of its own keys, in a number of folders that does not grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliant.functions.text import strip_ws
from foliant.operators.categorise import THRESHOLD, similarity_join
from foliant.operators.dedupe import dedupe_batch, without
from foliant.operators.imports import OUTCOME, import_dois
from foliant.operators.index import (
    DOCS,
    POSTINGS,
    TERMS,
    Index,
    document_frequencies,
    field_counts,
    index_of_parts,
    read_index,
    write_document_postings,
    write_grams,
    write_postings,
)
from foliant.session import written as stored_once
from foliant.streaming.keys import KeyTable

_OUTCOME = ", ".join(f"{c} {kind}" for c, kind in OUTCOME.items())
_STALE = "id BIGINT, old BIGINT"
_COUNTS = "field STRING, n_docs BIGINT, total BIGINT"


def read_files(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*", per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive in a folder; a pattern may name single files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch).option("latestFirst", "false")
    return reader.parquet(folder)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``handle``. ``once`` stops when all present data is done."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def import_stream(
    queue: DataFrame, papers: DataFrame, articles: DataFrame, oa_records: DataFrame, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Import DOIs as (seq, item) arrive. Items of earlier batches are done; DOIs stored by them are duplicates."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items, dois = KeyTable(spark, f"{checkpoint}-keys/items"), KeyTable(spark, f"{checkpoint}-keys/dois")
        done = items.earlier(batch.select(F.col("item").alias("key")), batch_id)
        stored = dois.earlier(batch.select(strip_ws(F.col("item")).alias("key")), batch_id)
        library = papers.select("doi").unionByName(stored.select(F.col("key").alias("doi")))
        fresh = import_dois(batch, library, articles, oa_records, processed=done.select(F.col("key").alias("item")))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.schema(_OUTCOME).parquet(f"{out}/batch={batch_id}")
        items.add(written.select(F.col("item").alias("key")), batch_id)
        dois.add(written.where(F.col("outcome").isin("succeeded", "needs_review")).select(F.col("doi").alias("key")), batch_id)

    return run(queue, handle, checkpoint, once)


def dedupe_stream(items: DataFrame, papers: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the first of each DOI that neither the library nor an earlier batch has: (seq, doi)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = KeyTable(spark, f"{checkpoint}-keys/dois")
        earlier = seen.earlier(batch.select(F.col("doi").alias("key")), batch_id).select(F.col("key").alias("doi"))
        rows = dedupe_batch(batch.select("seq", "doi"))
        new = without(without(rows, papers, "doi", "seq"), earlier, "doi", "seq")
        new.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.schema("seq BIGINT, doi STRING").parquet(f"{out}/batch={batch_id}")
        seen.add(written.select(F.col("doi").alias("key")), batch_id)

    return run(items, handle, checkpoint, once)


def progress_stream(outcomes: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running counts by outcome. There are only a few outcomes, so the result is kept in memory."""
    writer = outcomes.groupBy("outcome").agg(F.count("*").alias("n")).writeStream.outputMode("complete")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.format("memory").queryName(name).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table of batch folders, with its ``batch``; only the batches before a given one on request."""
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def _less(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: -F.col(c) for c in columns})


def index_stream(docs: DataFrame, out: str, checkpoint: str, buckets: int = 64, analyser: str = "simple", once: bool = True) -> StreamingQuery:
    """Add arriving documents (shaped as by ``index_documents``) to an index that can be searched after each batch.

    A batch writes its postings, its documents, its word frequencies and its field counts. A document that arrives
    again replaces its earlier text: the earlier batch's rows of it are noted as stale, and its words are taken off the
    frequencies and counts. Of an id that a batch holds twice the row with the latest ``date_modified`` counts.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*[c for c in batch.columns if c != "id"])
        newest = batch.groupBy("id").agg(F.max_by(row, F.struct(F.coalesce("date_modified", F.lit("")), row)).alias("r")).select("id", "r.*")
        newest = stored_once(newest, "stream-batch")  # read three times
        write_document_postings(newest, f"{out}/postings/batch={batch_id}", buckets, analyser, "overwrite")
        newest.select("id", "title", "year", "date_modified").write.mode("overwrite").parquet(f"{out}/docs/batch={batch_id}")
        postings = spark.read.schema(POSTINGS).parquet(f"{out}/postings/batch={batch_id}")
        stored = spark.read.schema(DOCS).parquet(f"{out}/docs/batch={batch_id}")
        terms, counts = document_frequencies(postings), field_counts(postings, stored)
        seen = KeyTable(spark, f"{out}-keys", "bigint")
        stale = seen.earlier(stored.select(F.col("id").alias("key")), batch_id)  # by its last batch; earlier ones are noted already
        stale.select(F.col("key").alias("id"), F.col("batch").alias("old")).write.mode("overwrite").parquet(f"{out}/stale/batch={batch_id}")
        stale = spark.read.schema(_STALE).parquet(f"{out}/stale/batch={batch_id}")
        batches = [r["old"] for r in stale.select("old").distinct().collect()]  # one number a batch at most
        if batches:
            before = _folder(spark, f"{out}/postings", POSTINGS, batch_id).where(F.col("batch").isin(batches))
            gone = before.withColumnRenamed("batch", "old").join(stale, ["id", "old"], "left_semi")
            terms = terms.unionByName(_less(document_frequencies(gone), "df"))
            counts = counts.unionByName(_less(field_counts(gone, stale), "n_docs", "total"))
        by_bucket = terms.repartition("bucket").sortWithinPartitions("bucket", "term", "field")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/terms/batch={batch_id}")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        seen.add(stored.select(F.col("id").alias("key")), batch_id)

    return run(docs, handle, checkpoint, once)


def open_stream_index(spark: SparkSession, out: str, buckets: int = 64, analyser: str = "simple") -> Index:
    """The index as of the batches written so far, each document by its newest text.

    Frequencies and counts are sums over the small tables of the batches, so a search reads postings of its own words
    only. Stale rows are left out by a join with the noted (id, batch) pairs.
    """
    stale = _folder(spark, f"{out}/stale", _STALE).select("id", F.col("old").alias("batch"))
    postings = _folder(spark, f"{out}/postings", POSTINGS)
    docs = _folder(spark, f"{out}/docs", DOCS)
    if not stale.isEmpty():
        postings, docs = (rows.join(stale, ["id", "batch"], "left_anti") for rows in (postings, docs))
    terms = _folder(spark, f"{out}/terms", TERMS)
    counts = _folder(spark, f"{out}/counts", _COUNTS)
    return index_of_parts(postings.drop("batch"), docs.drop("batch"), terms, counts, buckets, analyser)


def merge_stream_index(spark: SparkSession, out: str, target: str, buckets: int = 64, analyser: str = "simple") -> Index:
    """Rewrite the index of a stream as one plain index in ``target``: few files per bucket, no stale rows."""
    index = open_stream_index(spark, out, buckets, analyser)
    write_postings(index.postings, f"{target}/postings")
    index.docs.write.parquet(f"{target}/docs")
    index.terms.repartition("bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{target}/terms")
    write_grams(spark.read.schema(TERMS).parquet(f"{target}/terms"), f"{target}/grams", buckets)
    index.stats.coalesce(1).write.parquet(f"{target}/stats")
    return read_index(spark, target, buckets, analyser)


def categorise_stream(
    documents: DataFrame, categories: DataFrame, out: str, checkpoint: str, threshold: float = THRESHOLD, once: bool = True
) -> StreamingQuery:
    """Match arriving (id, embedding) rows with the categories; stateless, so plain append."""
    matches = similarity_join(documents, categories, threshold)
    writer = matches.writeStream.option("checkpointLocation", checkpoint).option("path", out).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start()
