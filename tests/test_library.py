"""Numbering, tree, names, updates, deduplication and records on small tables."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import dedupe, imports, paths, resolve, tree, updates
from foliant.operators.listing import Filters, apply_filters, by_journal, get_by_ids
from foliant.operators.numbering import ranked
from foliant.sources.schema import PAPERS

TREE = [(1, "R", None), (2, "A", 1), (3, "B", 2), (4, "loop", 5), (5, "pool", 4), (6, "lost", 77), (7, "R", None)]


@pytest.fixture(scope="module")
def collections(spark):
    return spark.createDataFrame(TREE, "id BIGINT, name STRING, parent_id BIGINT")


def paper(i, **kw):
    row = dict(
        id=i, doi=f"10.1234/{i}", title=f"T{i}", authors=["A, B"], journal="J", year=2000, volume="", issue="", pages="",
        abstract="", keywords=[], tags=[], collection_ids=[], file_path=f"/l/{i}.pdf", date_added="d", date_modified="d",
        metadata_source="crossref", needs_review=True, open_access=False, isbn=None, document_type="article",
    )
    return {**row, **kw}


def table(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], PAPERS)


def test_ranked_spans_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("hot"), F.col("id").alias("v")).withColumn("k", F.when(F.col("hot"), 0).otherwise(F.col("v") % 5))
    got = ranked(df.repartition(7), ["k"], [F.desc("v")], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.n, -r.v))
    for pairs in by.values():
        assert [n for n, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
        assert [v for _, v in sorted(pairs)] == sorted(v for _, v in pairs)
    assert sorted(r.n for r in ranked(df, [], [F.col("v")], "n").collect()) == list(range(1, 1001))


def test_tree_with_cycle_and_orphan(collections):
    seen = {r.id: (r.depth, r.path) for r in tree.collection_tree(collections).collect()}
    assert seen == {1: (0, "R"), 2: (1, "R/A"), 3: (2, "R/A/B"), 7: (0, "R")}
    pairs = {(r.ancestor, r.descendant) for r in tree.collection_closure(collections).collect()}
    assert {(i, i) for i in range(1, 8)} <= pairs
    assert {(1, 2), (1, 3), (2, 3), (4, 5), (5, 4)} == {p for p in pairs if p[0] != p[1]}
    closure = tree.collection_closure(collections)
    assert sorted(r.id for r in tree.subtree(closure, 4).collect()) == [4, 5]
    assert [r.id for r in tree.subtree(closure, 3).collect()] == [3]


def test_filters(spark, collections):
    closure = tree.collection_closure(collections)
    papers = table(
        spark, paper(1, collection_ids=[3, 9], journal="Über_x"), paper(2, collection_ids=[7]), paper(3, year=None, tags=["t"]), paper(4, collection_ids=[2, 3])
    )
    run = lambda **kw: sorted(r.id for r in apply_filters(papers, Filters(**kw), closure).collect())
    assert run(collection_id=1) == [1, 4]
    assert run(year_from=1990) == [1, 2, 4] and run(year_from=0) == [1, 2, 3, 4]
    assert run(tags=("t", "u")) == [3]
    assert [r.id for r in by_journal(papers, "R_X").collect()] == [1]
    wanted = spark.createDataFrame([(0, 4), (1, 99), (2, 1)], "pos INT, id BIGINT")
    assert [r.id for r in get_by_ids(papers, wanted, slim=True).collect()] == [4, 1]


def test_collisions_across_names(spark):
    items = [(1, "/d/a.pdf"), (2, "/d/a.pdf"), (3, "/d/a_2.pdf"), (4, "/d/b"), (5, "/d/b"), (6, "/d.x/c"), (7, "/d/a.pdf")]
    df = spark.createDataFrame(items, "seq BIGINT, dest STRING")
    taken = spark.createDataFrame([("/d/b_2",), ("/d/a_3.pdf",), ("/d.x/c",)], "path STRING")
    got = {r.seq: r.path for r in paths.collision_suffix(df, taken).collect()}
    assert len(set(got.values())) == len(items) and not set(got.values()) & {"/d/b_2", "/d/a_3.pdf", "/d.x/c"}
    assert got == {1: "/d/a.pdf", 2: "/d/a_2.pdf", 3: "/d/a_2_2.pdf", 4: "/d/b", 5: "/d/b_3", 6: "/d.x/c_2", 7: "/d/a_4.pdf"}


def test_keys_that_are_missing(spark):
    items = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, None), (5, "B")], "seq BIGINT, doi STRING")
    papers = spark.createDataFrame([("b",), (None,)], "doi STRING")
    assert sorted(r.seq for r in dedupe.new_by_doi(items, papers).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.seq for r in dedupe.new_by_doi(items, papers, fold_case=True).collect()) == [1, 2, 3, 4]
    assert sorted(r.seq for r in dedupe.dedupe_batch(items).collect()) == [1, 2, 4, 5]


def test_edits(spark):
    papers = table(spark, paper(1), paper(2), paper(3))
    log = [(1, "title", "x", 1), (1, "title", None, 2), (1, "year", "1999", 3), (2, "tags", '["a","b"]', 4), (2, "needs_review", "false", 5), (9, "title", "no", 6)]
    edits = spark.createDataFrame(log, "id BIGINT, field STRING, value STRING, seq BIGINT")
    got = {r.id: r for r in updates.apply_field_edits(papers, edits, "now").collect()}
    assert (got[1].title, got[1].year, got[1].date_modified) == (None, 1999, "now")
    assert (got[2].tags, got[2].needs_review) == (["a", "b"], False) and got[3].date_modified == "d"
    bad = spark.createDataFrame([(1, "date_added", "x", 1)], "id BIGINT, field STRING, value STRING, seq BIGINT")
    with pytest.raises(Exception, match="unknown field"):
        updates.apply_field_edits(papers, bad, "now").collect()


def test_collection_updates(spark, collections):
    rows = spark.createDataFrame([(1, " ", None), (2, "R", None), (3, "A", 1), (4, "N", 1), (5, "N", 1)], "seq BIGINT, name STRING, parent_id BIGINT")
    out = updates.insert_collections(collections, rows)
    assert sorted((r.id, r.name, r.parent_id) for r in out.where("id > 7").collect()) == [(8, "R", None), (9, "N", 1)]
    papers = table(spark, paper(1, collection_ids=[2, 22, 1]), paper(2, collection_ids=[22]))
    kept, left = updates.delete_collection(papers, collections, 2)
    assert {r.id: r.collection_ids for r in kept.collect()} == {1: [22, 1], 2: [22]}
    assert {r.id: r.parent_id for r in left.where("id IN (2, 3)").collect()} == {3: None}
    pairs = spark.createDataFrame([(1, 2), (2, 5), (2, 4), (8, 1)], "id BIGINT, collection_id BIGINT")
    got = {r.id: (r.collection_ids, r.date_modified) for r in updates.add_to_collection(papers, pairs, "now").collect()}
    assert got == {1: ([2, 22, 1], "d"), 2: ([22, 4, 5], "now")}


def test_article_records(spark):
    record = (
        '{"message":{"title":["T","U"],"author":[{"family":"F"},{"family":"G","given":"H"},{"given":"I"},{"name":"x"}],'
        '"publisher":"P","published-print":{"date-parts":[[2001,2]]},"published-online":{"date-parts":[[2002]]},'
        '"abstract":" <p>a</p> ","ISBN":["0-1"],"type":"Book-Section","volume":"7"}}'
    )
    df = spark.createDataFrame([("10.1/a", record), ("10.1/b", '{"message":{}}')], "doi STRING, record STRING")
    got = {r.doi: r for r in resolve.parse_article_records(df).collect()}
    a, b = got["10.1/a"], got["10.1/b"]
    assert (a.title, a.authors, a.journal, a.year) == ("T", ["F", "G, H", "I"], "P", 2001)
    assert (a.abstract, a.isbn, a.document_type, a.volume, a.needs_review) == ("a", "01", "book-chapter", "7", False)
    assert (b.title, b.authors, b.year, b.needs_review, b.document_type) == ("", [], None, True, "article")


def test_merge_lookup(spark):
    papers = table(spark, paper(1, document_type="book", abstract="keep"), paper(2))
    meta = resolve.meta(title=F.lit("new"), authors=F.array(F.lit("X")), year=F.lit(0), metadata_source=F.lit("crossref"), needs_review=F.lit(True))
    fetched = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), meta.alias("m")).select("id", "m.*")
    got = {r.id: r for r in resolve.merge_lookup(papers, fetched, "now").collect()}
    r = got[1]
    assert (r.title, r.authors, r.year, r.abstract, r.document_type, r.doi) == ("new", ["X"], 2000, "keep", "book", "10.1234/1")
    assert r.needs_review is False and got[2].needs_review is True  # a lookup always clears the flag


def test_repeated_rows_of_a_lookup(spark):
    papers = table(spark, paper(1), paper(2))
    rows = [resolve.meta(title=F.lit(t), authors=F.array(F.lit("X")), metadata_source=F.lit("crossref")).alias("m") for t in ("first", "second")]
    one = spark.range(1).select(F.lit(1).cast("bigint").alias("id"))
    fetched = one.select("id", rows[0], F.lit(2).alias("seq")).unionByName(one.select("id", rows[1], F.lit(5).alias("seq"))).select("id", "m.*", "seq")
    got = resolve.merge_lookup(papers, fetched, "now").collect()
    assert sorted((r.id, r.title) for r in got)[0] == (1, "second") and len(got) == 2


def test_records_that_repeat_and_differ_in_case(spark):
    oa = spark.createDataFrame([("10.1/a", '{"best_oa_location":{"url":"b"}}'), ("10.1/A", '{"best_oa_location":{"url":"a"}}'), (None, "{}"), ("10.1/c", "{}")], "doi STRING, record STRING")
    assert sorted((r.doi, r.oa_url, r.reason) for r in resolve.best_oa_location(oa).collect()) == [("10.1/A", "a", None), ("10.1/c", None, "no_oa_pdf")]
    items = spark.createDataFrame([(1, "10.1/A", "97X"), (2, "10.1/a", "97x"), (3, None, None), (4, "10.1/c", "1")], "seq BIGINT, doi STRING, isbn STRING")
    assert sorted((r.seq, r.oa_url) for r in resolve.with_oa_location(items, oa).collect()) == [(1, "a"), (2, "a"), (3, None), (4, None)]
    books = spark.createDataFrame([("97X", '{"title":"B"}'), ("97x", '{"title":"A"}'), ("97X", '{"title":"C"}')], "isbn STRING, record STRING")
    found = resolve.resolve_by_isbn(items, books, books.limit(0)).collect()
    assert sorted((r.seq, r.book and r.book.title) for r in found) == [(1, "A"), (2, "A"), (3, None), (4, None)]
    empty = spark.createDataFrame([], "doi STRING, file_path STRING")
    queue = spark.createDataFrame([(1, "10.1/A")], "seq BIGINT, item STRING")
    outcomes = imports.import_dois(queue, empty, spark.createDataFrame([], "doi STRING, record STRING"), oa).collect()
    assert [(r.item, r.outcome) for r in outcomes] == [("10.1/A", "needs_review")]


def test_depth_needs_few_rounds(spark, monkeypatch):
    chain = [(k, f"n{k}", k - 1 if k else None) for k in range(100)] + [(500, "x", 501), (501, "y", 500), (502, "z", 501), (600, "o", 999)]
    rounds = []
    plain = tree.written
    monkeypatch.setattr(tree, "written", lambda df, label: rounds.append(label) or plain(df, label))
    got = {r.id: (r.depth, r.path) for r in tree.collection_tree(spark.createDataFrame(chain, "id BIGINT, name STRING, parent_id BIGINT"), "/").collect()}
    assert got == {k: (k, "/".join(f"n{i}" for i in range(k + 1))) for k in range(100)} and len(rounds) <= 9


def test_violations(spark):
    papers = table(spark, paper(1, doi="d"), paper(2, doi="d"), paper(3, doi=None, file_path="/l/1.pdf"), paper(4, doi=None))
    assert {(r.id, r.field) for r in dedupe.unique_violations(papers).collect()} == {(2, "doi"), (3, "file_path")}
