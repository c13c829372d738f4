"""Each stage against what it should keep, then the whole run."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SMALL
from tidemill.llm import decontam, line_dedup, ngram_join, toxicity
from tidemill.llm.common import written


def test_stages_decide_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, docs, SMALL), name)
        assert out.columns == list(P.COLUMNS)
        ids, before = {r["doc_id"]: r["text"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(ids) <= set(before) and len(ids) == out.count()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert set(ids) == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
        elif name == "line_dedup":
            owner = {}
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            for d in sorted(before):
                for x in (before[d] or "").split("\n"):
                    owner.setdefault(key(x), d)
            for d, t in before.items():
                kept = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d)
                assert ids.get(d, "") == kept if kept.strip(" \t\n\x0b\x0c\r") else d not in ids
            assert out.where("n_chars <> char_length(text)").count() == 0
        elif name == "ngram_jaccard_join":
            assert set(ids) == {r["class_id"] for r in ngram_join.near_classes(docs).collect()}
        else:
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert set(ids) == {r["doc_id"] for r in decontam.decontaminate(docs, items).where("not contaminated").collect()}
        docs = out
    packed = P.pack_sequences(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert P.run(spark, SMALL).count() == packed.count()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "words without an id, quite a few of them", "en", "s", 1), (2, "", "en", "s", 0), (3, "a line that is here twice\n", "en", "s", 9), (4, "A line that is here twice", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept_text", F.lit(1))
    out = P.drop_repeated_lines(spark, docs, SMALL)
    assert {r["doc_id"] for r in out.collect()} == {1, None, 2, 3}
    assert P.drop_near_copies(spark, out, SMALL).count() == 4
    assert P.drop_contaminated(spark, out, SMALL).count() == 4
    assert P.pack_sequences(spark, out.limit(0), SMALL).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 5


def test_lines_that_end_in_other_separators_stay(spark):
    lines = [f"hello world foo{gap}{end}" for end in ("\x85", " ", " ") for gap in (" ", "  ")]
    docs = spark.createDataFrame([(i, x, "en", "s", 9) for i, x in enumerate([*lines, lines[0] + " "])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in P.drop_repeated_lines(spark, docs, SMALL).collect()} == dict(enumerate(lines))
