"""Plans that have to hold for large and uneven data."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import dedupe, index as ix, pages, search
from foliant.session import scratch_path, written


@pytest.fixture
def settings(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_with_hot_key(spark):
    """A third of the rows share one key and a third have none."""
    n = spark.range(60_000).withColumnRenamed("id", "seq")
    key = F.when(F.col("seq") % 3 == 0, "hot").when(F.col("seq") % 3 == 1, F.concat(F.lit("k"), F.col("seq").cast("string")))
    return written(n.select("seq", key.alias("doi"), F.sha2(F.col("seq").cast("string"), 256).alias("text")).repartition(8), "hot")


def test_lookup_splits_a_hot_key(spark, settings):
    rows = rows_with_hot_key(spark)
    table = written(rows.where("doi LIKE 'k%'").select("doi").union(spark.createDataFrame([("hot",)], "doi STRING")).withColumn("v", F.lit(1)), "keys")
    found = dedupe.lookup(rows, table, "doi", "seq")
    assert found.where("v = 1").count() == 40_000
    found.collect()
    assert "skew=true" in plan(found)  # more than one task works on the hot key


def test_repeats_of_a_hot_key(spark, settings):
    kept = dedupe.dedupe_batch(rows_with_hot_key(spark))
    assert kept.count() == 40_001


def test_search_prunes_and_shuffles_once(spark):
    docs = spark.range(200).select(
        "id", F.lit("t").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("authors"), F.lit("").alias("keywords"),
        F.concat(F.lit("common w"), (F.col("id") % 7).cast("string")).alias("fulltext"), F.lit(2000).alias("year"), F.lit("t").alias("date_modified"),
    )
    index = ix.write_index(docs, scratch_path(spark, "t"), 8)
    hits = search.search(index, search.any_of("w1 w2"))
    text = plan(hits)
    assert text.count("Exchange hashpartitioning") == 1
    assert "PartitionFilters: [((bucket" in text or "PartitionFilters: [(bucket" in text
    assert "PushedFilters: [In(term" in text and "positions" not in text.split("ReadSchema")[1].split("\n")[0]


def test_pages_are_only_projected(spark):
    raw = spark.createDataFrame([(1, "u", "<meta name='a' content='b'>")], "page_id BIGINT, url STRING, html STRING")
    text = plan(pages.page_metadata(written(raw, "pages")))
    assert "Exchange" not in text and "Python" not in text and "Generate" not in text
