"""Cutting lineage and keeping tables: checkpoints and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, so that a plan used many times is run once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: later plans read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    """df as a table of sorted buckets, by whose keys joins move the other side only."""
    spark, name = df.sparkSession, f"tidemill_{label}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *[F.col(k) for k in keys])
    out = rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    out.option("path", f"{shared_folder(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)
