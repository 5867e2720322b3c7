"""Batch updates: a snapshot and a table of changes give the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import filled, or_empty, strip_ws
from foliant.operators.dedupe import mark_repeats, new_by_doi, new_by_path, without
from foliant.operators.index import Index, delete_documents
from foliant.operators.numbering import with_new_ids
from foliant.session import written
from foliant.sources.schema import EDITABLE, PAPER_COLUMNS

_TYPED = {
    "year": "int",
    "needs_review": "boolean",
    "open_access": "boolean",
    "authors": "array<string>",
    "keywords": "array<string>",
    "tags": "array<string>",
    "collection_ids": "array<bigint>",
}


def accepted_in_order(rows: DataFrame) -> DataFrame:
    """The rows that one-by-one insertion in ``seq`` order would take: no earlier taken row has the DOI or the path.

    A round takes the rows that are first for both of their keys and refuses the rest of those keys. A row behind a
    refused one waits for the next round; rounds end when no row waits, mostly after one or two.
    """
    waiting, taken = written(rows, "waiting"), []
    while True:
        keys = ("doi", "file_path")
        marked = waiting
        for key in keys:
            marked = mark_repeats(marked, key, "seq", f"_later_{key}")
        first = written(marked.where("NOT _later_doi AND NOT _later_file_path").drop("_later_doi", "_later_file_path"), "taken")
        taken.append(first)
        rest = waiting.join(first.select("seq"), "seq", "left_anti")
        for key in keys:
            rest = without(rest, first.where(F.col(key).isNotNull()), key, "seq")
        waiting = written(rest, "waiting")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def last_of_each(changes: DataFrame) -> DataFrame:
    """One row per id: the last by ``seq`` when there is one, else the largest."""
    rest = F.struct(*[c for c in changes.columns if c != "id"])
    order = F.struct("seq", rest) if "seq" in changes.columns else rest
    return changes.groupBy("id").agg(F.max_by(rest, order).alias("_r")).select("id", "_r.*")


def new_papers(papers: DataFrame, rows: DataFrame, now: str, more: list[str] | None = None) -> DataFrame:
    """The rows (with ``seq``, without ``id``) that break no unique rule, with the next free ids; ``more`` columns stay."""
    fresh = accepted_in_order(new_by_path(new_by_doi(rows, papers), papers))
    stamped = fresh.withColumns(
        {"date_added": F.coalesce(filled(F.col("date_added")), F.lit(now)), "date_modified": F.lit(now)}
    )
    return with_new_ids(stamped, papers, [F.col("seq")]).select(*PAPER_COLUMNS, *(more or []))


def insert_papers(papers: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """Append rows (with ``seq``, without ``id``) that break no unique rule, with the next free ids."""
    return papers.select(*PAPER_COLUMNS).unionByName(new_papers(papers, rows, now))


def update_papers(papers: DataFrame, changed: DataFrame, now: str) -> DataFrame:
    """Replace whole rows by id. ``id`` and ``date_added`` stay; unknown ids are ignored, the last change of an id holds."""
    fields = [c for c in PAPER_COLUMNS if c not in ("id", "date_added", "date_modified")]
    side = last_of_each(changed).select("id", F.struct(*fields).alias("_new"))
    rows = papers.join(side, "id", "left")
    hit = F.col("_new").isNotNull()
    new = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields}
    new["date_modified"] = F.when(hit, F.lit(now)).otherwise(F.col("date_modified"))
    return rows.withColumns(new).select(*PAPER_COLUMNS)


def _typed(value: Column, field: str) -> Column:
    kind = _TYPED.get(field)
    if kind is None:
        return value
    return F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)


def apply_field_edits(papers: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Apply a log of (id, field, value, seq); the last edit of a field wins, an unknown field is an error.

    The log is reduced to one row per paper before it meets the papers.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown field: "), F.coalesce("field", F.lit("NULL"))))
    checked = edits.withColumn("field", F.when(F.col("field").isin(EDITABLE), F.col("field")).otherwise(unknown))
    # A struct around the value tells an edit to NULL from no edit.
    last = [
        F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}")
        for f in EDITABLE
    ]
    rows = papers.join(checked.groupBy("id").agg(F.count("*").alias("_edits"), *last), "id", "left")
    new = {
        f: F.when(F.col(f"_{f}").isNotNull(), _typed(F.col(f"_{f}.value"), f)).otherwise(F.col(f)) for f in EDITABLE
    }
    new["date_modified"] = F.when(F.col("_edits").isNotNull(), F.lit(now)).otherwise(F.col("date_modified"))
    return rows.withColumns(new).select(*papers.columns)


def delete_papers(papers: DataFrame, ids: DataFrame, index: Index | None = None) -> tuple[DataFrame, Index | None]:
    """Papers without some ids, and the index without them."""
    kept = papers.join(ids.select("id"), "id", "left_anti")
    return kept, None if index is None else delete_documents(index, ids)


def insert_collections(collections: DataFrame, rows: DataFrame) -> DataFrame:
    """Append (seq, name, parent_id). Blank names are refused, and so is a name its parent already has."""
    named = rows.withColumn("name", strip_ws(F.col("name"))).where("name <> ''")
    with_parent = named.where(F.col("parent_id").isNotNull())
    first = with_parent.groupBy("name", "parent_id").agg(F.min("seq").alias("seq"))
    below = first.join(collections.select("name", "parent_id"), ["name", "parent_id"], "left_anti")
    roots = named.where(F.col("parent_id").isNull()).select("seq", "name", "parent_id")
    new = with_new_ids(roots.unionByName(below.select("seq", "name", "parent_id")), collections, [F.col("seq")])
    return collections.select("id", "name", "parent_id").unionByName(new.select("id", "name", "parent_id"))


def rename_collections(collections: DataFrame, changes: DataFrame) -> DataFrame:
    """Set name and parent by id; a change to a blank name is refused, the last other change of an id holds."""
    name = strip_ws(F.col("name"))
    side = last_of_each(changes.where(name != "")).select("id", F.struct(name.alias("name"), "parent_id").alias("_new"))
    hit = F.col("_new").isNotNull()
    rows = collections.join(side, "id", "left")
    return rows.select(
        "id",
        F.when(hit, F.col("_new.name")).otherwise(F.col("name")).alias("name"),
        F.when(hit, F.col("_new.parent_id")).otherwise(F.col("parent_id")).alias("parent_id"),
    )


def delete_collection(papers: DataFrame, collections: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    """Remove a collection. Papers stay, without its id; its children become roots."""
    kept = papers.withColumn("collection_ids", F.array_remove("collection_ids", F.lit(collection_id).cast("bigint")))
    left = collections.where(F.col("id") != collection_id)
    parent = F.when(F.col("parent_id") != collection_id, F.col("parent_id"))
    return kept, left.withColumn("parent_id", parent)


def _merged(papers: DataFrame, column: str, side: DataFrame, merge, now: str) -> DataFrame:
    """Change a list column of the papers named in ``side`` (id, _items); only real changes get a new time."""
    rows = papers.join(side, "id", "left").withColumn("_new", merge(F.col(column), F.col("_items")))
    changed = F.col("_items").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    return rows.withColumns(
        {
            column: F.when(changed, F.col("_new")).otherwise(F.col(column)),
            "date_modified": F.when(changed, F.lit(now)).otherwise(F.col("date_modified")),
        }
    ).select(*papers.columns)


def _appended(old: Column, items: Column) -> Column:
    return F.concat(old, F.array_except(items, old))


def add_to_collection(papers: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """Append collection ids from (id, collection_id) pairs where they are absent."""
    side = pairs.groupBy("id").agg(F.array_sort(F.collect_set("collection_id")).alias("_items"))
    return _merged(papers, "collection_ids", side, _appended, now)


def _tag_lists(pairs: DataFrame) -> DataFrame:
    tag = strip_ws(or_empty(F.col("tag")))
    return pairs.where(tag != "").groupBy("id").agg(F.array_sort(F.collect_set(tag)).alias("_items"))


def add_tags(papers: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    return _merged(papers, "tags", _tag_lists(pairs), _appended, now)


def remove_tags(papers: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    return _merged(papers, "tags", _tag_lists(pairs), lambda old, gone: F.filter(old, lambda t: ~F.array_contains(gone, t)), now)


def mark_reviewed(papers: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    side = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = papers.join(side, "id", "left")
    return rows.withColumns(
        {
            "needs_review": F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("needs_review")),
            "date_modified": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("date_modified")),
        }
    ).select(*papers.columns)
