"""Imports as batch plans: documents, DOI lists and address lists, each giving one outcome row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.text import filled, or_empty, strip_ws
from foliant.operators import pages as web
from foliant.operators import resolve
from foliant.operators.dedupe import known, lookup, mark_repeats, skip_processed
from foliant.functions.naming import base_name
from foliant.operators.categorise import THRESHOLD, apply_categories, assign_collections, ensure_collections, mmr_tags, similarity_join
from foliant.operators.index import index_documents
from foliant.operators.paths import collision_suffix, plan_destinations
from foliant.operators.updates import insert_papers, new_papers
from foliant.operators.titles import fuzzy_title_match
from foliant.session import written
from foliant.sources.snapshots import Library, Snapshot

OUTCOME = {
    "seq": "bigint", "item": "string", "outcome": "string", "reason": "string", **resolve.META_TYPES, "open_access": "boolean",
}


def first_of_each(queue: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Each item once, at its first place in the queue, without those handled in an earlier run."""
    rows = queue.groupBy("item").agg(F.min("seq").alias("seq"))
    return rows if processed is None else skip_processed(rows, processed)


def _finish(rows: DataFrame) -> DataFrame:
    """Outcome of rows with ``ok``, ``reason``, ``duplicate``, ``meta`` and ``open_access``.

    Of several new items with one DOI the first is imported, the others count as duplicates.
    """
    rows = written(rows.select("seq", "item", "ok", "reason", "duplicate", "meta", "open_access"), "resolved")
    fresh = F.col("ok") & ~F.col("duplicate")
    rows = rows.withColumn("_doi", F.when(fresh, filled(F.col("meta.doi"))))
    rows = mark_repeats(rows, "_doi", "seq", "_again")
    outcome = (
        F.when(F.col("duplicate") | F.col("_again"), "duplicate")
        .when(~F.col("ok"), "failed")
        .when(F.col("meta.needs_review"), "needs_review")
        .otherwise("succeeded")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("reason", F.when(F.col("outcome") == "failed", F.col("reason")))
    stored = F.col("outcome").isin("succeeded", "needs_review")
    return rows.select(
        "seq",
        "item",
        "outcome",
        "reason",
        *[F.when(stored, F.col(f"meta.{c}")).alias(c) for c in resolve.META_TYPES],
        F.when(stored, F.col("open_access")).alias("open_access"),
    )


def text_findings(fulltext: DataFrame, match_titles: bool) -> DataFrame:
    """What an import needs of each text, so that joins move identifiers and not whole texts."""
    found = {
        "doi": ids.tiered_doi(F.col("page_texts"), F.col("xmp_subject"), F.col("xmp_keywords")),
        "isbn": ids.tiered_isbn(F.col("page_texts")),
        "title": ids.candidate_title(ids.first_page(F.col("page_texts"))) if match_titles else F.lit(None).cast("string"),
    }
    kept = [c for c in fulltext.columns if c not in ("page_texts", "xmp_subject", "xmp_keywords")]
    return fulltext.withColumns(found).select(*kept, *found)


def _documents_meta(
    rows: DataFrame, papers: DataFrame, articles: DataFrame, books_a: DataFrame, books_b: DataFrame, match_titles: bool
) -> DataFrame:
    """``doi``, ``duplicate`` and ``meta`` of rows with the findings of their texts and ``seq``."""
    rows = written(rows, "found")  # read by several joins below
    library = known(papers, "doi", "_known")
    matches = title_matches(rows, articles) if match_titles else None
    rows = lookup(rows, library, "doi", "seq")
    rows = resolve.resolve_metadata(rows, articles, books_a, books_b, "seq", matches)
    # A title match may name a DOI the text did not hold; that one is tested as well.
    rows = rows.withColumn("_meta_doi", filled(F.col("meta.doi")))
    rows = lookup(rows, library.withColumnsRenamed({"doi": "_meta_doi", "_known": "_known2"}), "_meta_doi", "seq")
    dup = F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(F.col("_known2"), F.lit(False))
    return rows.withColumn("duplicate", dup).drop("_known", "_known2", "_meta_doi")


def title_matches(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """(seq, record_doi, record) for documents whose candidate title is found among the article records."""
    titled = rows.select("seq", "title")
    record_title = F.get_json_object("record", "$.message.title[0]")
    found = fuzzy_title_match(titled, articles.select("doi", record_title.alias("title")))
    hits = titled.join(found.select("title", F.col("doi").alias("record_doi")), "title")
    records = articles.select(F.col("doi").alias("record_doi"), "record")
    return hits.join(records, "record_doi").select("seq", "record_doi", "record")


def import_documents(
    queue: DataFrame,
    fulltext: DataFrame,
    papers: DataFrame,
    articles: DataFrame,
    books_a: DataFrame,
    books_b: DataFrame,
    processed: DataFrame | None = None,
    match_titles: bool = True,
) -> DataFrame:
    """Text documents named by path. ``fulltext`` holds the extracted text under ``item``; an item without text
    is still imported, under its file name."""
    rows = first_of_each(queue, processed)
    paths = known(papers, "file_path", "_here").withColumnRenamed("file_path", "item")
    rows = rows.join(paths, "item", "left").join(text_findings(fulltext, match_titles), "item", "left")
    name = F.coalesce(F.col("file_name"), F.substring_index("item", "/", -1))
    rows = rows.withColumn("file_name", name)
    rows = _documents_meta(rows, papers, articles, books_a, books_b, match_titles)
    dup = F.col("duplicate") | F.coalesce(F.col("_here"), F.lit(False))
    return _finish(rows.withColumns({"duplicate": dup, "ok": F.lit(True), "reason": F.lit(None).cast("string"), "open_access": F.lit(False)}))


def import_dois(
    queue: DataFrame, papers: DataFrame, articles: DataFrame, oa_records: DataFrame, processed: DataFrame | None = None
) -> DataFrame:
    """DOIs: known ones are duplicates, those without an open document fail, the rest take their record."""
    rows = first_of_each(queue, processed).withColumn("doi", filled(strip_ws(F.col("item"))))
    rows = lookup(rows, known(papers, "doi", "_known"), "doi", "seq")
    rows = resolve.with_oa_location(rows, oa_records)
    rows = resolve.resolve_by_doi(rows, articles)
    no_text = F.lit(None).cast("string")
    file_name = F.concat(F.regexp_replace(or_empty(F.col("doi")), r'[/\\:*?"<>|]', "_"), F.lit(".pdf"))
    ok = F.col("oa_url").isNotNull()
    return _finish(
        rows.withColumns(
            {
                "duplicate": F.coalesce(F.col("_known"), F.lit(False)),
                "ok": ok,
                "reason": F.when(~ok, F.lit("no_oa_pdf")),
                "meta": F.coalesce(F.col("article"), resolve.guess_meta(file_name, no_text, no_text)),
                "open_access": F.lit(True),
            }
        )
    )


def import_urls(
    queue: DataFrame,
    pages: DataFrame,
    crawl_log: DataFrame,
    fulltext: DataFrame,
    papers: DataFrame,
    articles: DataFrame,
    books_a: DataFrame,
    books_b: DataFrame,
    oa_records: DataFrame,
    processed: DataFrame | None = None,
    match_titles: bool = True,
) -> DataFrame:
    """Addresses: direct documents go the document way, landing pages go by their page metadata."""
    rows = first_of_each(queue, processed)
    answers = web.one_answer(crawl_log)
    here = answers.select(F.col("url").alias("item"), F.col("status").alias("_status"), "content_type")
    rows = rows.join(here, "item", "left")
    kind = web.url_kind(F.col("item"), F.col("content_type"))

    direct = rows.where(kind == "pdf").join(text_findings(fulltext, match_titles), "item", "left")
    direct = direct.withColumn("file_name", F.coalesce(F.col("file_name"), F.substring_index("item", "/", -1)))
    direct = _documents_meta(direct, papers, articles, books_a, books_b, match_titles)
    reason = _download_reason(F.col("_status"), F.col("content_type"))
    direct = direct.withColumns({"ok": reason.isNull(), "reason": reason, "open_access": F.lit(False)})
    direct = direct.withColumn("duplicate", F.col("duplicate") & F.col("ok"))

    landing = rows.where(kind == "landing_page")
    asked = web.pages_at(pages, landing.select(F.col("item").alias("url")))
    found = web.verify_pdf_urls(web.one_page_per_url(web.page_metadata(asked)), answers, "url")
    landing = landing.join(found.drop("page_id").withColumnRenamed("url", "item"), "item", "left")
    landing = resolve.page_import_outcomes(landing, papers, articles, oa_records)
    columns = ["seq", "item", "ok", "reason", "duplicate", "meta", "open_access"]
    return _finish(direct.select(*columns).unionByName(landing.select(*columns)))


def _download_reason(status: Column, content_type: Column) -> Column:
    """Why a recorded download failed, NULL when it gave a document."""
    is_pdf = or_empty(content_type).startswith("application/pdf")
    return F.when(~F.coalesce(status, F.lit(0)).isin(200, 206), F.lit("http_error")).when(
        ~is_pdf, F.lit("not_pdf")
    )


def _placed(outcomes: DataFrame, papers: DataFrame, root: str, now: str) -> DataFrame:
    """Rows of imported items under free paths below ``root``, ready to be inserted; ``item`` is where they came from."""
    rows = accepted(outcomes).withColumn("file_name", base_name(F.col("item")))
    planned = written(plan_destinations(rows, root), "planned")
    taken = papers.select(F.col("file_path").alias("path"))
    paths = collision_suffix(planned.select("seq", "dest"), taken).select("seq", F.col("path").alias("file_path"))
    return planned.drop("dest", "file_name", "file_path").join(paths, "seq").withColumn("date_added", F.lit(now))


def stored(outcomes: DataFrame, papers: DataFrame, root: str, now: str) -> DataFrame:
    """The next paper snapshot: imported items under free paths below ``root``, with new ids in queue order."""
    return insert_papers(papers, _placed(outcomes, papers, root, now), now)


def import_into(
    library: Library,
    queue: DataFrame,
    fulltext: DataFrame,
    articles: DataFrame,
    books_a: DataFrame,
    books_b: DataFrame,
    embeddings: DataFrame,
    categories: DataFrame,
    root: str,
    now: str,
    match_titles: bool = True,
    threshold: float = THRESHOLD,
    with_tags: bool = True,
) -> tuple[Snapshot, DataFrame]:
    """A whole import of text documents: metadata, paths, categories and search index, published as one snapshot.

    ``fulltext`` and ``embeddings`` (item, embedding) are keyed by ``item``. Items whose path a paper came from or is stored
    under are duplicates. Returns the new snapshot and the outcome of every item. Nothing is visible before the snapshot is
    published; a run that fails leaves only unused folders. Only new papers are categorised and indexed.
    """
    base = library.snapshot()
    papers = base.table("papers")
    paths = papers.select("file_path")
    came_from = papers.select(F.lit(None).cast("string").alias("doi"), F.col("source_path").alias("file_path")).distinct()
    known_rows = papers.select("doi", "file_path").unionByName(came_from.join(paths, "file_path", "left_anti"))
    outcomes = written(import_documents(queue, fulltext, known_rows, articles, books_a, books_b, None, match_titles), "outcomes")
    fresh = written(new_papers(papers, _placed(outcomes, papers, root, now).withColumn("source_path", F.col("item")), now, ["source_path"]), "new-papers")

    own = fresh.select("id", F.col("source_path").alias("item"))
    matches = written(similarity_join(own.join(embeddings, "item").select("id", "embedding"), categories, threshold), "matches")
    used = categories.join(matches.select("category_id").distinct(), "category_id", "left_semi")
    tree = written(ensure_collections(base.table("collections"), used), "collections")
    tags = mmr_tags(fresh) if with_tags else None
    filed = written(apply_categories(fresh, assign_collections(matches, categories, tree), tags, now), "filed-papers")

    texts = fulltext.select("item", F.array_join("page_texts", "\n").alias("fulltext"))
    # Texts and papers meet once; their words are written and counted from the stored rows.
    docs = written(index_documents(filed, own.join(texts, "item").select("id", "fulltext")), "new-documents")
    return library.publish(base, {"papers": filed}, {"collections": tree}, documents=docs), outcomes


def accepted(outcomes: DataFrame) -> DataFrame:
    """Paper rows of the items that were imported, without id and path."""
    rows = outcomes.where(F.col("outcome").isin("succeeded", "needs_review"))
    no_ids = F.array().cast("array<bigint>")
    return rows.withColumns({"tags": F.array().cast("array<string>"), "collection_ids": no_ids}).drop("outcome", "reason")
