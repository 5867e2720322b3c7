"""Counts over the library (inventory I1-I4)."""

from __future__ import annotations

from foliant.operators import stats as op
from foliant.plans.inputs import papers
from foliant.plans.registry import query


@query("paper_count", "SELECT count(*) AS papers FROM papers_v")
def paper_count(spark, sf_dir):
    return op.paper_count(papers(spark, sf_dir))


@query("needs_review_count", "SELECT count(*) FILTER (WHERE needs_review) AS needs_review FROM papers_v")
def needs_review_count(spark, sf_dir):
    return op.needs_review_count(papers(spark, sf_dir))


@query("all_tags", "SELECT DISTINCT unnest(tags) AS tag FROM papers_v ORDER BY tag")
def all_tags(spark, sf_dir):
    return op.all_tags(papers(spark, sf_dir))


@query("all_ids", "SELECT id FROM papers_v ORDER BY id")
def all_ids(spark, sf_dir):
    return op.all_ids(papers(spark, sf_dir))


@query("all_paths", "SELECT file_path FROM papers_v")
def all_paths(spark, sf_dir):
    return op.all_paths(papers(spark, sf_dir))
