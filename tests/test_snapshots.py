"""A library whose tables change together."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import imports, search
from foliant.operators import index as ix
from foliant.plans import imports as plans
from foliant.plans.inputs import books
from foliant.plans.views import table, view
from foliant.session import scratch_path
from foliant.sources import snapshots
from foliant.sources.snapshots import TABLES, Library

SF = "/root/testdata/sf0.001"
NOW = "2025-01-01"


def run(spark, library, inbox):
    embeddings = inbox.select("item", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    categories = spark.createDataFrame([(1, "first", [1.0, 0.0]), (2, "second", [0.0, 1.0])], "category_id bigint, name string, embedding array<double>")
    return imports.import_into(
        library, inbox.select("seq", "item"), inbox.drop("seq"), view(spark, SF, "article_records_v"), *books(spark, SF), embeddings, categories,
        "/library", NOW, match_titles=False,
    )


def test_imports_one_after_another(spark, monkeypatch):
    library = Library(spark, scratch_path(spark, "library"), 4)
    assert library.versions() == [] and all(library.snapshot().table(n).count() == 0 for n in TABLES)
    inbox = view(spark, SF, "inbox_v")
    first, second = inbox.where("seq < 60"), inbox.where("seq < 120")
    one, outcomes = run(spark, library, first)
    stored = outcomes.where("outcome IN ('succeeded', 'needs_review')").count()
    assert one.version == 1 and one.table("papers").count() == stored > 0
    assert {r.name for r in one.table("collections").collect()} == {"first"}

    # A run that stops between two tables changes nothing that is published.
    plain = Library._write

    def broken(self, name, rows, path):
        if name == "terms":
            raise OSError("disk full")
        plain(self, name, rows, path)

    monkeypatch.setattr(Library, "_write", broken)
    with pytest.raises(OSError):
        run(spark, library, second)
    monkeypatch.setattr(Library, "_write", plain)
    assert library.versions() == [1] and library.snapshot().table("papers").count() == stored

    two, outcomes = run(spark, library, second)
    again = {r.item: r.outcome for r in outcomes.collect()}
    old = {r.source_path for r in one.table("papers").collect()}
    assert old and all(again[item] == "duplicate" for item in old)  # known by where they came from
    papers = two.table("papers")
    assert papers.count() > stored and papers.select("id").distinct().count() == papers.count() == papers.select("file_path").distinct().count()
    assert papers.where("size(collection_ids) <> 1 OR source_path IS NULL").count() == 0
    index = two.index()
    assert {r.id for r in index.docs.collect()} == {r.id for r in papers.collect()}
    assert {r.n_docs for r in index.stats.collect()} == {papers.count()}
    assert search.search(index, search.any_of("that")).count() > search.search(one.index(), search.any_of("that")).count() > 0
    with pytest.raises(RuntimeError):  # a run that started from the first snapshot comes too late
        library.publish(one, {"docs": one.table("docs")})


def test_laid_postings_are_copied_without_a_shuffle(spark, monkeypatch):
    docs = ix.index_columns(view(spark, SF, "indexed_v").where("id < 40"))
    index = ix.write_index(docs, scratch_path(spark, "index"), 4)
    monkeypatch.setattr(snapshots, "write_postings", None)  # the way that deals rows out by bucket
    library = Library(spark, scratch_path(spark, "library"), 4)
    got = library.publish(library.snapshot(), {"postings": index.postings}, laid=("postings",)).table("postings")
    names = [c for c in index.postings.columns if c != "positions"]
    assert got.count() == index.postings.count() > 0
    assert got.select(*names).exceptAll(index.postings.select(*names)).isEmpty()
    assert got.where(F.col("bucket") == 2).count() == index.postings.where(F.col("bucket") == 2).count() > 0


def test_a_written_index_is_taken_in_as_it_lies(spark, monkeypatch):
    docs = ix.index_columns(view(spark, SF, "indexed_v").where("id < 40"))
    index = ix.write_index(docs, scratch_path(spark, "index"), 4)
    monkeypatch.setattr(Library, "_copy", None)  # nothing is copied
    library = Library(spark, scratch_path(spark, "library"), 4)
    library.publish(library.snapshot(), {}, index=index)
    # More documents are indexed beside it, and their words are not shuffled by bucket.
    monkeypatch.setattr(snapshots, "write_postings", None)
    more = ix.index_columns(view(spark, SF, "indexed_v").where("id >= 40 AND id < 60"))
    got = library.publish(library.snapshot(), {}, documents=more).index()
    want = ix.write_index(ix.index_columns(view(spark, SF, "indexed_v").where("id < 60")), scratch_path(spark, "index"), 4)
    for name in ("postings", "terms", "docs", "stats"):
        columns = [c for c in getattr(want, name).columns if c != "positions"]
        one, two = (sorted(map(repr, getattr(i, name).select(*columns).collect())) for i in (got, want))
        assert one == two and one, name
    with pytest.raises(ValueError):
        library.publish(library.snapshot(), {}, index=ix.delete_documents(index, index.docs.limit(1)))


@pytest.mark.parametrize("ids", [[3, 4, 5, 5], [3, 5], []])
def test_postings_of_ids_with_and_without_gaps(spark, ids):
    postings = spark.range(10)
    got = plans._postings_of_ids(postings, spark.createDataFrame([(i,) for i in ids], "id bigint"))
    assert sorted(r.id for r in got.collect()) == sorted(set(ids))
