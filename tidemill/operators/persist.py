"""Writers: manuals and runs as appended events, artifacts, and a corpus cleared as a whole. Folders are any that Spark writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_manual(manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A manual's row and its first revision. manual: manual_id, title, revision, effective."""
    first = manual.select("manual_id", F.col("revision").alias("label"), "effective", F.lit(None).cast("string").alias("superseded_by"), F.lit("first").alias("summary"))
    return manual, first


def append_manual(manual: DataFrame, folder: str) -> None:
    rows, revisions = new_manual(manual)
    rows.write.mode("append").parquet(f"{folder}/manuals")
    revisions.write.mode("append").parquet(f"{folder}/manual_revisions")


def run_event(spark: SparkSession, run_id: str, manual_id: str | None, status: str, pages: dict[str, int] | None = None) -> DataFrame:
    """Start or end of an ingest run, as an event; the latest event of a run is its state."""
    row = spark.createDataFrame([(run_id, manual_id, status, pages or {})], "run_id string, manual_id string, status string, pages map<string,int>")
    return row.withColumn("at", F.current_timestamp())


def append_run(event: DataFrame, folder: str) -> None:
    event.coalesce(1).write.mode("append").parquet(f"{folder}/ingest_runs")


def run_states(events: DataFrame) -> DataFrame:
    """The latest event of each run."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("manual_id", "status", "pages", "at"), F.struct("at", F.col("status") != "running")).alias("x")).select("run_id", "x.*")


def append_log(rows: DataFrame, folder: str) -> None:
    """Query log rows, by day."""
    rows.withColumn("day", F.current_date()).write.mode("append").partitionBy("day").parquet(f"{folder}/query_log")


def write_routes(routed: DataFrame, folder: str) -> None:
    """The routing of pages as JSON lines, one folder a manual."""
    routed.write.mode("overwrite").partitionBy("manual_id").json(f"{folder}/page_routes")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their sizes, listed by the executors' reader; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", "modificationTime")


def clear(spark: SparkSession, folder: str, prefix: str = "") -> bool:
    """Deletes a folder, or a table in it, as a whole; whether there was one."""
    where, files = _files(spark, f"{folder}/{prefix}" if prefix else folder)
    return bool(files.exists(where) and files.delete(where, True))


def recreate(spark: SparkSession, folder: str, tables: dict[str, str]) -> None:
    """Each table empty, with its schema."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
