"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, line_dedup, ngram_join, packing, toxicity
from tidemill.llm.common import whole, written
from tidemill.llm.queries import table, tokenizer_path

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}

#: SQL can't express a trained classifier or the tokenizer's ids; tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is trained on these documents and the labels."""
    docs = whole(docs, COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; a document that lost lines and has no word left goes too."""
    out = line_dedup.dedup_lines(whole(docs, COLUMNS))
    emptied = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~emptied).select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that with the smallest id. Where an id is repeated or null, rows are told apart by a key of their own."""
    docs = whole(docs, COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = ngram_join.near_classes(docs).where("doc_id <> class_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    keyed = written(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    classes = ngram_join.near_classes(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    copies = written(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("row_key"), "class_id"), "copies")
    members = copies.unionByName(copies.select(F.col("class_id").alias("row_key"), "class_id").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    best = members.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("class_id").agg(first.alias("x")).select("x.row_key")
    gone = members.join(best, "row_key", "left_anti").select("row_key")
    return keyed.join(gone, "row_key", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = whole(docs, COLUMNS)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences of 4096 tokens."""
    return packing.pack(docs, packing.Packing(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a table in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
