"""Benchmark items without an id, against the query's SQL."""

import duckdb
import pytest

from tests.conftest import rows_of
from tidemill.llm import decontam
from tidemill.llm import queries as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("items"))
    long = " ".join(f"w{k}" for k in range(14))
    docs = [(1, f"before {long} after"), (2, "a known phrase here"), (3, "nothing of it"), (4, f"known phrase and {long}"), (5, None)]
    items = [(None, long), (7, "known phrase"), (None, "phrase here"), (8, "w3 w4"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


def test_items_without_id_hit_as_in_sql(spark, tables):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    got = Q.op9_decontamination(spark, tables).toPandas()
    assert rows_of(got) == rows_of(c.sql(Q.ORACLE_SQL["op9_decontamination"]).df())
    assert set(got[got.contaminated].doc_id) == {1, 2, 4}


def test_items_without_id(spark, tables):
    docs, items = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    for how in (decontam.Winnowing(), decontam.Winnowing(filter_bits=10)):
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs, items, how).collect()}
        assert got[1]["n_hit"] == 14 and got[1]["items"] == ["8"] and got[1]["n_items"] == 2
        assert got[2]["n_hit"] == 3 and got[2]["items"] == ["7"] and got[2]["n_items"] == 2
        assert {r["doc_id"] for r in decontam.keep_clean(docs, items, how).collect()} == {3, 5}
        only = decontam.decontaminate(docs, items.where("item_id is null"), how).where("doc_id = 1").first()
        assert only["contaminated"] and only["items"] == [] and only["n_items"] == 1
