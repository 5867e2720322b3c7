"""Search over the index tables with structured clauses: words, phrases, globs, year ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import bm25
from foliant.functions.stem import with_stem
from foliant.functions.text import spread_out
from foliant.operators.index import FIELDS, LONG_WORD, Index, analyse_queries, term_bucket, words
from foliant.operators.listing import Filters, apply_filters, newest_first
from foliant.operators.numbering import ranked
from foliant.session import written

SNIPPET_CHARS = 300
#: Largest table of (field, id) that is sent to all tasks, in bytes of its plain columns.
BROADCAST_BYTES = 16 << 20
_HIT = ["clause", "id", "score"]


@dataclass(frozen=True)
class Clause:
    """One part of a query. ``occur`` is ``should``, ``must`` or ``must_not``."""

    kind: str
    value: tuple
    occur: str = "should"
    fields: tuple[str, ...] = FIELDS


def word(text: str, occur: str = "should", field: str | None = None) -> Clause:
    return Clause("text", (text,), occur, (field,) if field else FIELDS)


def any_of(text: str, field: str | None = None) -> list[Clause]:
    """Bare words: each may match."""
    return [word(w, field=field) for w in text.split()]


def phrase(text: str, occur: str = "should", field: str | None = None) -> Clause:
    return Clause("text", (text,), occur, (field,) if field else FIELDS)


def glob(pattern: str, occur: str = "should", field: str | None = None) -> Clause:
    return Clause("glob", (pattern,), occur, (field,) if field else FIELDS)


def years(first: int, last: int, occur: str = "must") -> Clause:
    return Clause("years", (first, last), occur)


def glob_like(pattern: str) -> str:
    """A ``*`` pattern as a LIKE pattern over whole terms."""
    plain = pattern.lower()
    for special in ("\\", "%", "_"):
        plain = plain.replace(special, "\\" + special)
    return plain.replace("*", "%")


def _of_terms(index: Index, table: DataFrame, terms: list[str], column: str = "term") -> DataFrame:
    """Rows of literal terms: the bucket prunes folders, the term prunes row groups."""
    buckets = [term_bucket(F.lit(t), index.buckets) for t in sorted(set(terms))]
    in_bucket = reduce(lambda a, b: a | b, [F.col("bucket") == b for b in buckets])
    return table.where(in_bucket & F.col(column).isin(sorted(set(terms))))


def _postings_for(index: Index, terms: list[str], fields: tuple[str, ...], columns: list[str]) -> DataFrame:
    rows = _of_terms(index, index.postings, terms)
    if set(fields) != set(FIELDS):
        rows = rows.where(F.col("field").isin(list(fields)))
    return rows.select(*columns)


def _with_weights(index: Index, rows: DataFrame, terms: list[str]) -> DataFrame:
    """Add idf and average length. Both sides are bounded: query terms times five fields, and five fields."""
    df = _of_terms(index, index.terms, terms).select("term", "field", "df")
    weights = df.join(F.broadcast(index.stats), "field").select(
        "term", "field", bm25.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"
    )
    return rows.join(F.broadcast(weights), ["term", "field"])


def _score() -> Column:
    return bm25.exact(F.col("idf") * bm25.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl")))


def term_scores(index: Index, terms: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Score of each (term, field, id) of the query."""
    rows = _postings_for(index, terms, fields, ["term", "field", "id", "tf", "dl"])
    return _with_weights(index, rows, terms).select("term", "field", "id", "tf", "dl", _score().alias("score"))


def _term_hits(index: Index, wanted: list[tuple[int, str, tuple[str, ...]]]) -> DataFrame:
    """Hits of all single-word clauses from one scan; a word may belong to several clauses."""
    terms = sorted({t for _, t, _ in wanted})
    fields = tuple(f for f in FIELDS if any(f in fs for _, _, fs in wanted))
    uses = F.array(
        *[
            F.struct(F.lit(no).alias("clause"), F.lit(t).alias("term"), F.lit(list(fs)).alias("fields"))
            for no, t, fs in wanted
        ]
    )
    mine = F.filter(uses, lambda u: (u["term"] == F.col("term")) & F.array_contains(u["fields"], F.col("field")))
    scored = term_scores(index, terms, fields)
    return scored.select(F.explode(mine).alias("u"), "id", "score").select("u.clause", "id", "score")


def phrase_matches(index: Index, terms: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """How often the terms stand next to each other, per (field, id).

    The frequency table names the rarest word. Its rows are few, so they go to the scans of the other words, which keep
    the rows of the same documents and fields before anything is shuffled; only where even the rarest word has too many
    rows to be sent are all rows shuffled. Then the postings of a document's field meet, one row per word of the phrase:
    each position list is moved back by the place of its word, and the phrase stands where the moved lists meet.
    """
    different = sorted(set(terms))
    rows = _postings_for(index, different, fields, ["term", "field", "id", "dl", "positions"])
    known = _of_terms(index, index.terms, different).where(F.col("field").isin(list(fields)))
    counts = {r["term"]: r["df"] for r in known.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row a word
    rarest = min(different, key=lambda t: (counts.get(t, 0), t))
    if len(different) > 1 and counts.get(rarest, 0) * 24 <= BROADCAST_BYTES:
        here = _postings_for(index, [rarest], fields, ["field", "id"])
        rows = rows.join(F.broadcast(here), ["field", "id"], "left_semi")
    by_word = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{k}") for k, t in enumerate(different)]
    met = rows.groupBy("field", "id", "dl").agg(*by_word)
    for k in range(len(different)):
        met = met.where(F.col(f"_p{k}").isNotNull())

    def moved_back(places: int):
        return lambda position: position - places

    moved = [F.transform(F.col(f"_p{different.index(t)}"), moved_back(i)) for i, t in enumerate(terms)]
    return met.select("field", "id", "dl", F.size(reduce(F.array_intersect, moved)).cast("bigint").alias("tf")).where("tf > 0")


def _phrase_hits(index: Index, clause: int, terms: list[str], fields: tuple[str, ...]) -> DataFrame:
    """A phrase scores like one word whose weight is the sum of its words' weights."""
    df = _of_terms(index, index.terms, terms)
    times = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.lit(terms.count(t)))])
    weights = (
        df.join(F.broadcast(index.stats), "field")
        .withColumn("w", bm25.idf(F.col("n_docs"), F.col("df")) * F.element_at(times, F.col("term")))
        .groupBy("field", "avgdl")
        .agg(F.sum(F.col("w")).alias("idf"))
    )
    found = phrase_matches(index, terms, fields).join(F.broadcast(weights), "field")
    return found.select(F.lit(clause).alias("clause"), "id", _score().alias("score"))


def glob_grams(pattern: str) -> list[str]:
    """3-grams that every term of a glob's shape has; the ends of the glob are marked like those of terms."""
    pieces = f"^{pattern.lower()}$".split("*")
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def glob_terms(index: Index, pattern: str) -> DataFrame:
    """(bucket, term) of the terms of a shape. With three literal characters in a row, ends included, this is an
    equi-join on the gram table that reads the buckets of those grams; a shorter glob runs over the distinct terms."""
    like = F.col("term").like(glob_like(pattern))
    grams = glob_grams(pattern)
    if index.grams is None or not grams:
        return index.terms.where(like).select("bucket", "term").distinct()
    rows = _of_terms(index, index.grams, grams, "gram").where(like)
    found = rows.groupBy("term").agg(F.count_distinct("gram").alias("n"))  # parts of an index may both know a term
    found = found.where(F.col("n") == len(grams))
    return found.select(term_bucket(F.col("term"), index.buckets).alias("bucket"), "term")


def glob_matches(index: Index, pattern: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, id) of documents with a term of that shape. The pattern never runs over the text."""
    rows = index.postings.where(F.col("field").isin(list(fields))).select("bucket", "term", "field", "id")
    return rows.join(glob_terms(index, pattern), ["bucket", "term"], "left_semi").select("field", "id").distinct()


def _glob_hits(index: Index, clause: int, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    hits = glob_matches(index, pattern, fields)
    return hits.select(F.lit(clause).alias("clause"), "id", bm25.exact(F.lit(1.0)).alias("score"))


def _year_hits(index: Index, clause: int, first: int, last: int) -> DataFrame:
    rows = index.docs.where(F.col("year").between(first, last))
    return rows.select(F.lit(clause).alias("clause"), "id", bm25.exact(F.lit(1.0)).alias("score"))


def _analysed(index: Index, clauses: list[Clause]) -> dict[int, list[str]]:
    """Index terms of every text clause, stemmed together."""
    texts = {no: c.value[0] for no, c in enumerate(clauses) if c.kind == "text"}
    return dict(zip(texts, analyse_queries(list(texts.values()), index)))


def clause_hits(index: Index, clauses: list[Clause], terms: dict[int, list[str]] | None = None) -> DataFrame | None:
    """Every (clause, id, score) that matches; a document may have several rows per clause."""
    terms = _analysed(index, clauses) if terms is None else terms
    parts: list[DataFrame] = []
    single: list[tuple[int, str, tuple[str, ...]]] = []
    for no, c in enumerate(clauses):
        if c.kind == "years":
            parts.append(_year_hits(index, no, *c.value))
        elif c.kind == "glob":
            if c.value[0].replace("*", ""):
                parts.append(_glob_hits(index, no, c.value[0], c.fields))
        elif len(terms[no]) == 1:
            single.append((no, terms[no][0], c.fields))
        elif terms[no]:
            parts.append(_phrase_hits(index, no, terms[no], c.fields))
    if single:
        parts.append(_term_hits(index, single))
    return reduce(DataFrame.unionByName, parts) if parts else None


def search(index: Index, clauses: list[Clause]) -> DataFrame:
    """(id, score) of all matching documents, without a cap. One shuffle, by document."""
    terms = _analysed(index, clauses)
    hits = clause_hits(index, clauses, terms)
    if hits is None:
        return index.docs.select("id", F.lit(0.0).alias("score")).limit(0)
    # A clause without any usable word can not match; it is left out, as a reader of the query would.
    marked = [(i, c.occur) for i, c in enumerate(clauses) if c.occur != "should"]
    flags = [F.coalesce(F.bool_or(F.col("clause") == i), F.lit(False)).alias(f"_m{i}") for i, _ in marked]
    banned = [i for i, occur in marked if occur == "must_not"]
    wanted = ~F.col("clause").isin(banned) if banned else F.lit(True)
    total = F.sum(F.when(wanted, F.col("score"))).cast("double").alias("score")
    found = hits.groupBy("id").agg(total, *flags).where(F.col("score").isNotNull())
    for i, occur in marked:
        c = clauses[i]
        if c.kind == "years" or (c.value[0].replace("*", "") if c.kind == "glob" else terms[i]):
            found = found.where(F.col(f"_m{i}") if occur == "must" else ~F.col(f"_m{i}"))
    return found.select("id", "score")


def _sent(small: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, sent to all tasks as long as its counted rows fit."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def search_many(index: Index, queries: DataFrame, k: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(query_id, rank, id, score): the best ``k`` documents of every row of ``queries`` (query_id, text) in one plan.

    A text is its different words, each of which may match. A posting is scored once, however many queries ask for its word, and
    is dealt out by document as numbers. There the queries of its word are joined, so the rows of a query and document lie in
    one task and are summed without a further shuffle; tasks keep the best ``k`` of a query before the last one. Equal scores
    are ordered by id. Queries without a known word, or with a NULL text or id, find nothing; rows that repeat an id are one
    query with the words of all.
    """
    asked = spread_out(queries.where("query_id IS NOT NULL"), words(F.col("text")), "term").where(F.octet_length("term") < LONG_WORD)
    if index.analyser == "en_stem":
        asked = with_stem(asked, "term").drop("term").withColumnRenamed("stem", "term")
    wanted = written(asked.select("query_id", "term").distinct(), "query-words")
    numbered = wanted.select("term").distinct().withColumn("word", F.monotonically_increasing_id())
    numbered = written(numbered.withColumn("bucket", term_bucket(F.col("term"), index.buckets)), "query-word-numbers")
    uses = written(wanted.join(numbered, "term").select("word", "query_id"), "query-uses")
    df = index.terms.where(F.col("field").isin(list(fields))).join(_sent(numbered, 48), ["bucket", "term"]).join(F.broadcast(index.stats), "field")
    weights = written(df.select("word", "bucket", "term", "field", bm25.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"), "query-weights")
    rows = index.postings.select("bucket", "term", "field", "id", "tf", "dl").join(_sent(weights, 80), ["bucket", "term", "field"])
    score = bm25.counted(F.col("idf") * bm25.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl")))
    dealt = rows.select("id", "word", score.alias("score")).repartition("id")
    total = dealt.join(_sent(uses, 16), "word").groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = total.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", (F.col("score").cast("double") / bm25.PARTS).alias("score"))


def best_first(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id")


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    return best_first(hits).limit(k)


def rank_hits(hits: DataFrame) -> DataFrame:
    """Position of each hit in score order."""
    return ranked(hits, [], [F.desc("score"), F.col("id")], "rank")


def normalised(hits: DataFrame) -> DataFrame:
    """Add the score as a share of the best score, 0 to 100."""
    top = hits.agg(F.max("score")).scalar()
    share = F.when(top > 0, F.col("score") / top * 100).otherwise(F.lit(0.0))
    return hits.withColumn("score_pct", share)


def result_rows(index: Index, hits: DataFrame) -> DataFrame:
    """Hits with their stored fields; the snippet is the start of the title."""
    stored = index.docs.select("id", "title", "year", F.substring("title", 1, SNIPPET_CHARS).alias("snippet"))
    return hits.join(stored, "id")


def hydrated(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with authors and journal of the paper row."""
    return hits.join(papers.select("id", "authors", "journal"), "id")


def search_and_filter(
    index: Index,
    clauses: list[Clause] | None,
    papers: DataFrame,
    filters: Filters = Filters(),
    closure: DataFrame | None = None,
) -> DataFrame:
    """Search results that pass every filter, best first. ``closure`` serves a collection filter. Without a query: all papers that pass, newest first."""
    kept = apply_filters(papers, filters, closure)
    if clauses is None:
        return newest_first(kept.select("id", "title", "authors", "journal", "year", "date_added"))
    hits = normalised(search(index, clauses))
    return best_first(hits.join(kept.select("id", "title", "authors", "journal", "year"), "id"))
