"""Queries over planned file names (inventory N, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import naming
from foliant.operators import paths as op
from foliant.plans.inputs import papers
from foliant.plans.identifiers import _SPACE
from foliant.plans.registry import query
from foliant.plans.views import spark_sql

_SAFE = r"""regexp_replace(substr(regexp_replace({}, '[/:*?"<>|\\]', '_', 'g'), 1, 80), '^[@]+|[@]+$', '', 'g')""".replace("@", _SPACE)
_AUTHOR = r"""CASE WHEN len(authors) = 0 THEN 'Unknown' ELSE concat(CASE WHEN contains(authors[1], ',') THEN trim(string_split(authors[1], ',')[1])
  ELSE string_split(trim(authors[1]), ' ')[1] END, CASE WHEN len(authors) > 2 THEN ' et al' ELSE '' END) END"""
_JOURNAL = f"CASE WHEN trim(journal) = '' THEN 'Unsorted' ELSE {_SAFE.format('journal')} END"
_YEAR = "CASE WHEN coalesce(year, 0) = 0 THEN 'Unknown' ELSE CAST(year AS STRING) END"
DEST = f"""CASE WHEN metadata_source IN ('xmp', 'filename') THEN concat('/library/Unsorted/', regexp_extract(file_path, '[^/]*$'))
  ELSE concat('/library/', {_JOURNAL}, '/', {_YEAR}, '/', {_SAFE.format(_AUTHOR)}, ' (', {_YEAR}, ') ', {_SAFE.format('title')}, '.pdf') END"""


@query("destination_path", f"SELECT id, {DEST} AS dest FROM papers_v")
def destination_path(spark, sf_dir):
    return op.plan_destinations(papers(spark, sf_dir), "/library").select("id", "dest")


_MESSY = """SELECT doc_id, concat(' a/b:c*d?e"f<g>h|i', chr(92), CAST(doc_id AS STRING), ' ', text) AS raw FROM @documents"""


@query("fs_safe", f"SELECT doc_id, {_SAFE.format('raw')} AS safe FROM ({_MESSY}) t")
def fs_safe(spark, sf_dir):
    return spark_sql(spark, sf_dir, _MESSY).select("doc_id", naming.fs_safe(F.col("raw")).alias("safe"))


@query("author_short", f"SELECT id, {_AUTHOR} AS author FROM papers_v")
def author_short(spark, sf_dir):
    return papers(spark, sf_dir).select("id", naming.author_short(F.col("authors")).alias("author"))


@query("journal_safe", f"SELECT id, {_JOURNAL} AS journal FROM papers_v")
def journal_safe(spark, sf_dir):
    return papers(spark, sf_dir).select("id", naming.journal_safe(F.col("journal")).alias("journal"))


@query("mirror_path", f"""
SELECT id, concat('/backup/', substr(dest, 19)) AS mirror
FROM (SELECT id, {DEST} AS dest FROM papers_v) t WHERE starts_with(dest, '/library/Unsorted/')
""")
def mirror_path(spark, sf_dir):
    planned = op.plan_destinations(papers(spark, sf_dir), "/library")
    return op.mirrored(planned, "/library/Unsorted", "/backup").select("id", "mirror")


# Every document asks for one of a few names, a third of them for the same one; some names exist already.
_WANTED = """
SELECT event_id AS seq, concat('/library/J/', CASE WHEN user_id % 3 = 0 THEN 'Same (2020) Title' ELSE concat(event_type, CAST(user_id AS STRING)) END, '.pdf') AS dest FROM @events
"""
_TAKEN = """
SELECT '/library/J/Same (2020) Title.pdf' AS path, 1 AS k, '/library/J/Same (2020) Title.pdf' AS dest FROM @region WHERE r_regionkey = 0
UNION ALL SELECT concat('/library/J/Same (2020) Title_', CAST(7 + doc_id % 50 AS STRING), '.pdf'), CAST(7 + doc_id % 50 AS INT), '/library/J/Same (2020) Title.pdf' FROM @documents
"""


@query("collision_suffix", f"""
WITH wanted AS ({_WANTED}), used AS (SELECT DISTINCT dest, k FROM ({_TAKEN}) t),
gaps AS (SELECT dest, k - row_number() OVER (PARTITION BY dest ORDER BY k) AS value FROM used),
places AS (SELECT seq, dest, row_number() OVER (PARTITION BY dest ORDER BY seq) AS value FROM wanted),
numbered AS (SELECT p.seq, p.dest, p.value + (SELECT count(*) FROM gaps g WHERE g.dest = p.dest AND g.value < p.value) AS n FROM places p)
SELECT seq, dest, CASE WHEN n = 1 THEN dest ELSE concat(substr(dest, 1, length(dest) - 4), '_', CAST(n AS STRING), '.pdf') END AS path FROM numbered
""")
def collision_suffix(spark, sf_dir):
    return op.collision_suffix(spark_sql(spark, sf_dir, _WANTED), spark_sql(spark, sf_dir, _TAKEN))
