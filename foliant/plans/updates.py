"""Queries over batch updates (inventory A7, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import updates as op
from foliant.plans.inputs import FLAT_PAPER, collections, flat, papers
from foliant.plans.registry import query
from foliant.plans.search import library_index
from foliant.plans.views import spark_sql, table, view
from foliant.session import scratch_path
from foliant.sources import tables
from foliant.sources.schema import PAPER_COLUMNS

NOW = "2025-01-01T00:00:00+00:00"
_FLAT = f"WITH p AS (SELECT {FLAT_PAPER} FROM papers_v)"


def _replaced(**new: str) -> str:
    return ", ".join(f"{new[c]} AS {c}" if c in new else f"p.{c}" for c in PAPER_COLUMNS)


@query("write_papers", _FLAT + " SELECT " + _replaced(date_added=f"CASE WHEN id % 2 = 0 THEN p.date_added ELSE '{NOW}' END", date_modified=f"'{NOW}'") + " FROM p")
def write_papers(spark, sf_dir):
    rows = papers(spark, sf_dir).withColumn("date_added", F.when(F.col("id") % 2 == 0, F.col("date_added")).otherwise(""))
    return flat(tables.write_papers(rows, scratch_path(spark, "papers"), NOW))


# New rows: each event brings a paper; many repeat a DOI or a path.
_NEW = """
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('10.1234/abc.', CAST(1000000 * (event_id % 2) + user_id AS STRING)) END AS doi,
  concat('/new/', event_type, '/', CAST(user_id AS STRING), '.pdf') AS file_path, concat('Title ', CAST(event_id AS STRING)) AS title
FROM @events
"""


def _new_rows(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, _NEW)
    fixed = {
        "authors": F.array(F.lit("A, B")), "keywords": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"),
        "collection_ids": F.array().cast("array<bigint>"), "year": F.lit(2020), "needs_review": F.lit(False), "open_access": F.lit(True),
        "document_type": F.lit("article"), "metadata_source": F.lit("manual"), "isbn": F.lit(None).cast("string"),
    }
    empty = {c: F.lit("") for c in ("journal", "volume", "issue", "pages", "abstract", "date_added")}
    return rows.withColumns({**fixed, **empty})


def _one_by_one(rounds: int) -> str:
    """Insertion in seq order: rows that are first for both keys go in, rows behind them on a key are refused."""
    steps = []
    for k in range(rounds):
        steps.append(f"""
w{k}f AS (SELECT *, doi IS NOT NULL AND seq > min(seq) OVER (PARTITION BY doi) AS late_doi, seq > min(seq) OVER (PARTITION BY file_path) AS late_path FROM w{k}),
t{k} AS MATERIALIZED (SELECT seq, doi, file_path, title FROM w{k}f WHERE NOT late_doi AND NOT late_path),
w{k + 1} AS MATERIALIZED (SELECT seq, doi, file_path, title FROM w{k} WHERE seq NOT IN (SELECT seq FROM t{k}) AND file_path NOT IN (SELECT file_path FROM t{k})
  AND (doi IS NULL OR doi NOT IN (SELECT doi FROM t{k} WHERE doi IS NOT NULL)))""")
    union = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(rounds))
    return ",".join(steps) + f", taken AS ({union} UNION ALL SELECT seq, error('rows are left') , file_path, title FROM w{rounds})"


@query("insert_papers", f"""
WITH w0 AS MATERIALIZED (SELECT seq, doi, file_path, title FROM ({_NEW}) n WHERE (doi IS NULL OR doi NOT IN (SELECT doi FROM papers_v WHERE doi IS NOT NULL)) AND file_path NOT IN (SELECT file_path FROM papers_v)),
{_one_by_one(8)}
SELECT id, doi, title, file_path, date_added, date_modified FROM papers_v UNION ALL
SELECT (SELECT max(doc_id) FROM @documents) + row_number() OVER (ORDER BY seq), doi, title, file_path, '{NOW}', '{NOW}' FROM taken
""")
def insert_papers(spark, sf_dir):
    out = op.insert_papers(papers(spark, sf_dir), _new_rows(spark, sf_dir), NOW)
    return out.select("id", "doi", "title", "file_path", "date_added", "date_modified")


@query("update_papers", _FLAT + f""", l AS (SELECT doc_id FROM @labels)
SELECT {_replaced(title="CASE WHEN l.doc_id IS NULL THEN p.title ELSE concat('New ', p.title) END", year="CASE WHEN l.doc_id IS NULL THEN p.year ELSE 1999 END",
                  date_modified=f"CASE WHEN l.doc_id IS NULL THEN p.date_modified ELSE '{NOW}' END")} FROM p LEFT JOIN l ON p.id = l.doc_id
""")
def update_papers(spark, sf_dir):
    rows = papers(spark, sf_dir)
    chosen = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    changed = chosen.withColumns({"title": F.concat(F.lit("New "), "title"), "year": F.lit(1999), "date_added": F.lit("ignored")})
    return flat(op.update_papers(rows, changed, NOW))




@query("apply_field_edits", _FLAT + ", last AS (SELECT id, "
       + ", ".join(f"max_by(value, seq) FILTER (WHERE field = '{f}') AS {f}" for f in ("title", "journal", "volume", "issue", "abstract"))
       + " FROM edits_v GROUP BY id) SELECT "
       + _replaced(**{f: f"coalesce(last.{f}, p.{f})" for f in ("title", "journal", "volume", "issue", "abstract")},
                   date_modified=f"CASE WHEN last.id IS NULL THEN p.date_modified ELSE '{NOW}' END")
       + " FROM p LEFT JOIN last ON p.id = last.id")
def apply_field_edits(spark, sf_dir):
    return flat(op.apply_field_edits(papers(spark, sf_dir), view(spark, sf_dir, "edits_v"), NOW))


def _toxic(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


@query("delete_papers", _FLAT + " SELECT * FROM p WHERE id NOT IN (SELECT doc_id FROM @labels WHERE toxic = 1)")
def delete_papers(spark, sf_dir):
    return flat(op.delete_papers(papers(spark, sf_dir), _toxic(spark, sf_dir))[0])


@query("delete_papers_and_index", "SELECT count(*) AS indexed FROM @documents WHERE doc_id NOT IN (SELECT doc_id FROM @labels WHERE toxic = 1)")
def delete_papers_and_index(spark, sf_dir):
    index = op.delete_papers(papers(spark, sf_dir), _toxic(spark, sf_dir), library_index(spark, sf_dir))[1]
    return index.docs.agg(F.count("*").alias("indexed"))


# New collections: one per customer name and nation, some blank, some there already.
_NEW_COLLECTIONS = """
SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 = 0 THEN '  ' WHEN c_custkey % 9 = 1 THEN 'ALGERIA' WHEN c_custkey % 9 = 2 THEN 'Shared'
    ELSE concat(' ', c_name, ' ') END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN CAST(1 AS BIGINT) ELSE CAST(100 + c_nationkey AS BIGINT) END AS parent_id
FROM @customer
"""


@query("insert_collections", f"""
WITH named AS (SELECT seq, trim(name) AS name, parent_id FROM ({_NEW_COLLECTIONS}) n WHERE trim(name) <> ''),
kept AS (SELECT seq, name, parent_id FROM named WHERE parent_id IS NULL UNION ALL
  SELECT min(seq), n.name, n.parent_id FROM named n WHERE parent_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM collections_v c WHERE c.name = n.name AND c.parent_id = n.parent_id) GROUP BY n.name, n.parent_id)
SELECT id, name, parent_id FROM collections_v UNION ALL
SELECT (SELECT max(id) FROM collections_v) + row_number() OVER (ORDER BY seq), name, parent_id FROM kept
""")
def insert_collections(spark, sf_dir):
    return op.insert_collections(collections(spark, sf_dir), spark_sql(spark, sf_dir, _NEW_COLLECTIONS))


_RENAMES = """SELECT CAST(1000 + s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE concat(' New ', s_name) END AS name, CAST(1 + s_nationkey % 5 AS BIGINT) AS parent_id FROM @supplier"""


@query("rename_collections", f"""
SELECT c.id, coalesce(trim(r.name), c.name) AS name, CASE WHEN r.id IS NULL THEN c.parent_id ELSE r.parent_id END AS parent_id
FROM collections_v c LEFT JOIN (SELECT * FROM ({_RENAMES}) q WHERE trim(name) <> '') r ON c.id = r.id
""")
def rename_collections(spark, sf_dir):
    return op.rename_collections(collections(spark, sf_dir), spark_sql(spark, sf_dir, _RENAMES))


@query("delete_collection", """
SELECT 'paper' AS kind, id, CASE WHEN collection_id = 3 THEN '' ELSE CAST(collection_id AS STRING) END AS value FROM papers_v
UNION ALL SELECT 'collection', id, coalesce(CAST(CASE WHEN parent_id = 3 THEN NULL ELSE parent_id END AS STRING), '') FROM collections_v WHERE id <> 3
""")
def delete_collection(spark, sf_dir):
    kept, left = op.delete_collection(papers(spark, sf_dir), collections(spark, sf_dir), 3)
    a = kept.select(F.lit("paper").alias("kind"), "id", F.array_join(F.col("collection_ids").cast("array<string>"), ";").alias("value"))
    b = left.select(F.lit("collection").alias("kind"), "id", F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("value"))
    return a.unionByName(b)


_PAIRS = """SELECT user_id AS id, CAST(CASE event_type WHEN 'view' THEN 1 + user_id % 5 WHEN 'click' THEN 7 ELSE 8 END AS BIGINT) AS collection_id FROM @events"""


@query("add_to_collection", f"""
WITH side AS (SELECT id, list_sort(list(DISTINCT collection_id)) AS items FROM ({_PAIRS}) q GROUP BY id),
p AS (SELECT papers_v.id, collection_id, date_modified, list_filter(items, lambda x: x <> collection_id) AS extra FROM papers_v LEFT JOIN side ON papers_v.id = side.id)
SELECT id, array_to_string(list_concat([collection_id], extra), ';') AS collection_ids, CASE WHEN len(extra) > 0 THEN '{NOW}' ELSE date_modified END AS date_modified FROM p
""")
def add_to_collection(spark, sf_dir):
    out = op.add_to_collection(papers(spark, sf_dir), spark_sql(spark, sf_dir, _PAIRS), NOW)
    return flat(out).select("id", "collection_ids", "date_modified")


_TAG_PAIRS = """SELECT user_id AS id, CASE event_type WHEN 'view' THEN ' en ' WHEN 'click' THEN concat('u', CAST(user_id % 7 AS STRING)) WHEN 'error' THEN ' ' ELSE 'tag3' END AS tag FROM @events"""
_TAG_SIDE = f"WITH side AS (SELECT id, list_sort(list(DISTINCT trim(tag))) AS items FROM ({_TAG_PAIRS}) q WHERE trim(tag) <> '' GROUP BY id),"


@query("add_tags", _TAG_SIDE + f"""
p AS (SELECT papers_v.id, tags, date_modified, list_filter(items, lambda x: NOT list_contains(tags, x)) AS extra FROM papers_v LEFT JOIN side ON papers_v.id = side.id)
SELECT id, array_to_string(list_concat(tags, extra), ';') AS tags, CASE WHEN len(extra) > 0 THEN '{NOW}' ELSE date_modified END AS date_modified FROM p
""")
def add_tags(spark, sf_dir):
    out = op.add_tags(papers(spark, sf_dir), spark_sql(spark, sf_dir, _TAG_PAIRS), NOW)
    return flat(out).select("id", "tags", "date_modified")


@query("remove_tags", _TAG_SIDE + f"""
p AS (SELECT papers_v.id, tags, date_modified, list_filter(tags, lambda x: items IS NULL OR NOT list_contains(items, x)) AS kept FROM papers_v LEFT JOIN side ON papers_v.id = side.id)
SELECT id, array_to_string(kept, ';') AS tags, CASE WHEN len(kept) < len(tags) THEN '{NOW}' ELSE date_modified END AS date_modified FROM p
""")
def remove_tags(spark, sf_dir):
    out = op.remove_tags(papers(spark, sf_dir), spark_sql(spark, sf_dir, _TAG_PAIRS), NOW)
    return flat(out).select("id", "tags", "date_modified")


@query("mark_reviewed", f"""
SELECT id, CASE WHEN u.user_id IS NULL THEN needs_review ELSE FALSE END AS needs_review, CASE WHEN u.user_id IS NULL THEN date_modified ELSE '{NOW}' END AS date_modified
FROM papers_v LEFT JOIN (SELECT DISTINCT user_id FROM @events) u ON id = u.user_id
""")
def mark_reviewed(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return op.mark_reviewed(papers(spark, sf_dir), ids, NOW).select("id", "needs_review", "date_modified")


