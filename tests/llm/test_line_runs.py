"""The line index: compaction in production, and joins that leave the runs where they are."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemill.llm import line_dedup
from tidemill.llm.common import sorted_buckets


def test_production_parameters_compact(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    index = line_dedup.LineIndex()
    drops = line_dedup.dropped_lines(docs, line_dedup.LineDedup(), index)
    assert index.compactions == 3 and [len(x) for x in index.levels] == [0, 0, 1]
    assert index.runs()[0].groupBy("h1", "h2").count().where("count > 1").isEmpty()
    key = ["doc_id", "of_text", "at"]
    assert sorted(map(tuple, drops.select(key).collect())) == sorted(map(tuple, line_dedup.dropped_lines(docs).select(key).collect()))
    tables = list(index.tables)
    index.close(spark)
    assert not set(tables) & {t.name for t in spark.catalog.listTables()}


def test_runs_are_not_moved_or_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = line_dedup.LineIndex()
        rows = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("owner")).repartition(4, "h1", "h2")
        index.levels = [[index._run(rows.where("owner < 300"))], [index._run(rows.where("owner >= 500"))]]
        batch = rows.repartition(3).groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
        with sorted_buckets(spark, 4):
            out = index.meeting(batch)
            plan = out._jdf.queryExecution().executedPlan().toString()
        tree = plan.split("Initial Plan")[-1]
        # the batch is dealt once (and once by this test); neither run is
        assert tree.count("SortMergeJoin") == 2 and tree.count("Exchange hashpartitioning") == 1
        assert tree.count("Sort [") == 1  # the batch's
        assert out.where("known is null").count() == 200 and out.where("known <> owner").count() == 0
        merged = index._merged(index.runs())
        assert merged.count() == 800 and merged.agg(F.sum("owner")).first()[0] == sum(range(300)) + sum(range(500, 1000))
        index.close(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_doc_id_with_two_texts(spark):
    a, b = "a line of some length here", "another line of some length"
    rows = [(3, a, "en", "s", 1), (3, f"{a}\n{b}", "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([("3", a, a), ("3", f"{a}\n{b}", a), ("2", b, b), ("3", b, ""), ("None", a, a)])
