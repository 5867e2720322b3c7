import math

import pytest
from pyspark.sql import functions as F

from foliant.functions import bm25
from foliant.functions.stem import stems_of
from foliant.operators import index as ix
from foliant.operators import search as op
from foliant.session import scratch_path

DOCS = [
    (1, "Deep learning", "neural scaling laws of deep nets", "Doe, Jane", "ai", "the laws the laws", 2020),
    (2, "Learning to learn", "", "Roe, Bob", "", "scaling neural laws", 2021),
    (3, "Cats", "cats and dogs", "Doe, Ann", "pets", "dogs dogs dogs " + "x" * 40 + " end", None),
    (4, "", "", "", "", "", 1999),
]
SCHEMA = "id BIGINT, title STRING, abstract STRING, authors STRING, keywords STRING, fulltext STRING, year INT"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "'t' AS date_modified")


@pytest.fixture(scope="module")
def index(spark, docs):
    return ix.write_index(docs, scratch_path(spark, "t"), 4)


@pytest.fixture(scope="module")
def stemmed(spark, docs):
    return ix.write_index(docs, scratch_path(spark, "t"), 4, "en_stem")


def ids(index, *clauses):
    return sorted(r.id for r in op.search(index, list(clauses)).collect())


def test_words_phrases_fields(index):
    assert ids(index, *op.any_of("LEARNING cats")) == [1, 2, 3]
    assert ids(index, op.word("doe", field="authors"), op.word("doe", field="title")) == [1, 3]
    assert ids(index, op.phrase("neural scaling laws")) == [1]
    assert ids(index, op.phrase("the laws the laws")) == [1]
    assert ids(index, op.phrase("laws the the")) == []
    assert ids(index, op.word("scaling-laws")) == [1]  # two words in one token are a phrase
    assert ids(index, op.word("nowhere")) == [] == ids(index)


def test_boolean(index):
    assert ids(index, op.word("learning", "must"), op.word("neural")) == [1, 2]
    assert ids(index, op.word("learning", "must"), op.word("deep", "must_not")) == [2]
    assert ids(index, op.word("deep", "must_not")) == []
    assert ids(index, op.word("learning", "must"), op.word("zzz", "must")) == []
    assert ids(index, op.word("learning"), op.years(2021, 2030)) == [2]
    assert ids(index, op.years(1990, 2030)) == [1, 2, 4]  # no year, no match
    must = set(ids(index, op.word("neural", "must"), op.word("deep")))
    assert must <= set(ids(index, op.word("neural"), op.word("deep")))


def test_glob(index, stemmed):
    assert ids(index, op.glob("LEARN*")) == [1, 2]
    assert ids(index, op.glob("*ing", field="title")) == [1, 2]
    assert ids(index, op.glob("*")) == []
    assert ids(index, op.glob("d*s")) == [3]
    assert ids(stemmed, op.glob("learning*")) == []  # globs run over the stems
    hits = {r.id: r.score for r in op.search(index, [op.glob("learn*"), op.glob("cat*")]).collect()}
    assert hits[3] == 2.0 and hits[1] == 1.0


def test_long_words_and_positions(index):
    rows = {(r.term, r.field): r for r in index.postings.where("id = 3").collect()}
    assert ("x" * 40, "fulltext") not in rows
    assert rows[("end", "fulltext")].positions == [4] and rows[("end", "fulltext")].dl == 4
    assert rows[("dogs", "fulltext")].tf == 3


def test_score_formula(index):
    got = {r.id: r.score for r in op.search(index, [op.word("cats")]).collect()}
    want = 0.0
    for column, field in ((1, "title"), (2, "abstract")):
        lengths = [len(d[column].split()) for d in DOCS]
        df = sum("cats" in d[column].lower().split() for d in DOCS)
        avg, dl = sum(lengths) / len(DOCS), len(DOCS[2][column].split())
        want += math.log(1 + (len(DOCS) - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[3] == pytest.approx(want, abs=1e-6)


def test_stems(stemmed):
    assert ids(stemmed, *op.any_of("learns cat dog")) == [1, 2, 3]
    assert ids(stemmed, op.phrase("neurals scale law")) == [1]


def test_partitions_do_not_matter(spark, docs, index):
    other = ix.write_index(docs.repartition(3), scratch_path(spark, "t"), 32)
    q = op.any_of("laws neural dogs")
    assert sorted(op.search(index, q).collect()) == sorted(op.search(other, q).collect())


def test_ranking_and_share(index):
    hits = op.search(index, op.any_of("laws learning"))
    ranks = [(r.rank, r.score) for r in op.rank_hits(hits).orderBy("rank").collect()]
    assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1))
    assert [s for _, s in ranks] == sorted((s for _, s in ranks), reverse=True)
    assert max(r.score_pct for r in op.normalised(hits).collect()) == 100.0


def test_deletion_and_drift(spark, docs, index):
    gone = spark.createDataFrame([(3,)], "id BIGINT")
    left = ix.delete_documents(index, gone)
    assert ids(left, op.word("cats")) == [] and left.docs.count() == 3
    rebuilt = ix.write_index(docs.where("id <> 3"), scratch_path(spark, "t"), 4)
    q = op.any_of("learning laws")
    assert sorted(op.search(left, q).collect()) == sorted(op.search(rebuilt, q).collect())
    now = docs.where("id <> 4").selectExpr("id + IF(id = 2, 100, 0) AS id", "IF(id = 1, 'new', 't') AS date_modified")
    states = {r.id: r.state for r in ix.index_drift(index, now).collect()}
    assert states == {1: "changed", 2: "deleted", 4: "deleted", 102: "not_indexed"}


def test_search_after_a_delete_reads_only_its_buckets(spark, docs, index):
    left = ix.delete_documents(index, spark.createDataFrame([(2,)], "id BIGINT"))
    text = op.search(left, op.any_of("laws"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [part for part in text.split("\n\n") if "Scan parquet" in part and "/postings" in part]
    assert len(scans) == 2 and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters: ")[1].split("\n")[0] for s in scans)
    assert ids(left, *op.any_of("laws")) == [1]
    none_left = ix.delete_documents(index, docs.select("id"))
    assert ids(none_left, *op.any_of("laws cats")) == [] and none_left.terms.count() == 0


@pytest.mark.parametrize("which", ["index", "stemmed"])
def test_replaced_documents_are_like_a_new_index(spark, docs, which, request):
    old = request.getfixturevalue(which)
    newer = docs.where("id IN (1, 4)").selectExpr(
        "IF(id = 4, 9, id) AS id", "'Dogs learning tricks' AS title", "abstract", "authors", "keywords", "'laws of tricks' AS fulltext", "2024 AS year", "'new' AS date_modified"
    )
    got = ix.replace_documents(old, newer, scratch_path(spark, "t"))
    rebuilt = ix.write_index(docs.where("id <> 1").unionByName(newer), scratch_path(spark, "t"), 4, old.analyser)
    for clauses in (op.any_of("learning laws dogs"), [op.phrase("scaling laws")], [op.glob("*ick*")], [op.glob("la*")], [op.word("dogs", "must"), op.years(2024, 2024)]):
        assert sorted(op.search(got, clauses).collect()) == sorted(op.search(rebuilt, clauses).collect())
    assert sorted(got.terms.drop("bucket").collect()) == sorted(rebuilt.terms.drop("bucket").collect())
    again = ix.replace_documents(got, newer.where("id = 9").withColumn("title", ix.F.lit("Cats")), scratch_path(spark, "t"))
    assert ids(again, op.word("cats", field="title")) == [3, 9] and again.docs.count() == 5
    nothing = ix.replace_documents(got, newer.limit(0), scratch_path(spark, "t"))
    assert sorted(nothing.stats.collect()) == sorted(got.stats.collect())


def test_many_queries_are_like_one(spark, index, stemmed):
    texts = {1: "laws", 2: "the neural dogs", 3: "nothing known", 4: None, 5: "Learning, learning CATS"}
    asked = spark.createDataFrame([*texts.items(), (None, "laws")], "query_id BIGINT, text STRING")
    for ix_ in (index, stemmed):
        for k in (1, 10):
            got = {}
            for r in sorted(op.search_many(ix_, asked, k).collect()):
                got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
            want = {q: [(r.id, round(r.score, 6)) for r in op.top_hits(op.search(ix_, [op.word(w) for w in set(t.replace(",", "").lower().split())]), k).collect()] for q, t in texts.items() if t}
            assert got == {q: hits for q, hits in want.items() if hits}


def test_postings_of_many_queries_are_dealt_out_once(spark, index):
    """Rows that move are postings scored once, not one row for every query that asks for the word."""
    asked = spark.createDataFrame([(q, "the neural laws") for q in range(40)], "query_id BIGINT, text STRING")
    found = op.search_many(index, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(query_id" in x and ", id#" in x]
    assert [x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x]
    want = [(r.id, round(r.score, 6)) for r in op.top_hits(op.search(index, op.any_of("the neural laws")), 3).collect()]
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert got == dict.fromkeys(range(40), want)


def test_counted_scores_are_the_exact_ones(spark):
    rows = spark.range(20_000).select((F.rand(5) * 40).alias("s"))
    apart = rows.where((bm25.counted(F.col("s")) / bm25.PARTS) != bm25.exact(F.col("s")).cast("double"))
    assert apart.isEmpty()


def test_globs_by_grams(index):
    assert op.glob_grams("The*ion") == ["^th", "ion", "on$", "the"] and op.glob_grams("a*b") == []
    scan = ix.replace(index, grams=None)
    for pattern in ("*earn*", "dog*", "*s", "*aw*", "l*s", "*ear*ing", "*aling", "cats", "*", "d*", "*zzz*"):
        terms = [sorted(r.term for r in op.glob_terms(i, pattern).collect()) for i in (index, scan)]
        assert terms[0] == terms[1], pattern
        assert ids(index, op.glob(pattern)) == ids(scan, op.glob(pattern))


def test_the_rarest_word_prunes_a_phrase(index):
    plan = op.phrase_matches(index, ["the", "laws"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


# Pairs from the published vocabulary of the stemming rules.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consolation consol consolations consol consolatory consolatori
console consol consolidate consolid conspicuous conspicu conspiracy conspiraci conspirators conspir knack knack knackeries
knackeri knavish knavish kneaded knead kneel kneel knightly knight knitting knit knives knive knocker knocker knots knot
generate generat generically generic communism communism skies sky dying die tied tie ties tie cries cri by by say say
luxuriating luxuri hopping hop hoping hope gas gas gaps gap kiwis kiwi national nation rational ration possibly possibl
happily happili relational relat arguments argument proceed proceed succeeding succeed""".split()


def test_published_stems(spark):
    words, want = PUBLISHED[::2], PUBLISHED[1::2]
    assert dict(zip(words, stems_of(spark, words))) == dict(zip(words, want))
