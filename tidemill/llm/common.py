"""What the training-data operators share: word rules, column helpers and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where value is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound_batches(spark: SparkSession, rows: int = 2_000, size: int = 8 << 20) -> None:
    """Batches between the JVM and Python of that many rows and bytes at most, as a row is a whole text; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast way where all is ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder; its files go when the application ends."""
    path = f"{shared_folder(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, a_task: int = 100_000) -> DataFrame:
    """df, of which the number of rows is known, in no more tasks than these need: many tiny files cost more than they hold."""
    return df.coalesce(max(8, rows // a_task))


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int) -> tuple[DataFrame, str]:
    """df as a table of sorted buckets in the shared folder, and the table's name: joins by the keys move no row of it."""
    spark = df.sparkSession
    name = f"tidemill_{label}_{uuid.uuid4().hex}"
    # rows are dealt into as many partitions already, unless the session holds another number
    out = df.coalesce(buckets).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    out.option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name), name


@contextmanager
def sorted_buckets(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Within this, what is shuffled by the keys goes to as many partitions, a task reads a bucket as it is, and Spark relies on the order of buckets of one file and does not sort them again."""
    wanted = {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def numbered(df: DataFrame, order: list[Column], name: str, a_task: int = 200_000) -> DataFrame:
    """df with ``name``: 1, 2, 3 and so on in the order given. Ties come in any order.

    Ranges of the order are sorted apart, each in a task of its own, so no task sees all rows; a range
    adds the number of rows in the ranges before it, of which there are as many as tasks. Rows that
    are alike in the order are spread by their place in df. df is best a written table, as it is read twice.
    """
    tasks = df.count() // a_task + 1
    keys = [*order, F.asc("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_range").withColumn(name, place).select(*df.columns, name)


def whole(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; one that is missing is null. Other columns of the caller never clash with ours."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
