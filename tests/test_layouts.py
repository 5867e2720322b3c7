"""Tables as folders of files, and addresses that several pages share: the queries give what their statements say."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import canonical
from foliant.plans.views import table

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = contract.queries()[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(contract.oracle_sql()[name])
    assert got == canonical([d[0] for d in cur.description], cur.fetchall())
    assert got


@pytest.mark.parametrize("name, read", [("stream_categorise", "embeddings"), ("stream_index", "documents")])
def test_stream_of_a_folder(spark, tmp_path, name, read):
    table(spark, SF, read).repartition(3).write.parquet(f"{tmp_path}/{read}.parquet")
    same(spark, str(tmp_path), name, [read])


@pytest.mark.parametrize("name", ["import_urls", "reason_counts"])
def test_pages_that_share_an_address(spark, tmp_path, name):
    read = ("documents", "labels", "pages")
    for t in read:
        rows = table(spark, SF, t)
        if t == "pages":  # three pages an address, so direct documents and landing pages repeat
            rows = rows.selectExpr("page_id", "concat('https://a.example.com/', page_id div 3) AS url", "html")
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    same(spark, str(tmp_path), name, read)


def test_stream_of_a_single_file(spark):
    assert contract.queries()["stream_categorise"](spark, SF).count() > 0
