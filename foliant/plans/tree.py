"""Queries over the collection tree (inventory H)."""

from __future__ import annotations

from foliant.operators import tree as op
from foliant.plans.inputs import collections, papers
from foliant.plans.registry import query

_CLOSURE = """
WITH RECURSIVE closure AS (SELECT id AS ancestor, id AS descendant FROM collections_v UNION
  SELECT k.ancestor, c.id FROM closure k JOIN collections_v c ON c.parent_id = k.descendant)
"""


@query("collection_tree", """
WITH RECURSIVE tree AS (SELECT id, name, parent_id, 0 AS depth, name AS path FROM collections_v WHERE parent_id IS NULL UNION ALL
  SELECT c.id, c.name, c.parent_id, t.depth + 1, concat(t.path, '/', c.name) FROM tree t JOIN collections_v c ON c.parent_id = t.id)
SELECT id, name, parent_id, depth, path FROM tree
""")
def collection_tree(spark, sf_dir):
    return op.collection_tree(collections(spark, sf_dir))


@query("collection_closure", _CLOSURE + "SELECT ancestor, descendant FROM closure")
def collection_closure(spark, sf_dir):
    return op.collection_closure(collections(spark, sf_dir))


@query("collection_counts", _CLOSURE + """
SELECT ancestor AS collection_id, count(*) FILTER (WHERE ancestor = descendant) AS direct, count(DISTINCT id) AS with_descendants
FROM papers_v JOIN closure ON collection_id = descendant GROUP BY ancestor
""")
def collection_counts(spark, sf_dir):
    return op.collection_counts(papers(spark, sf_dir), collections(spark, sf_dir))
