"""Ingest as a stream: new page files of a landing folder are routed and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import route_pages

PAGES = "manual_id string, page int, chars int, images int, drawings int, ratio double"


def landing(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def route_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Routes each batch to Parquet; stops when what is there is done. A batch that is run again writes its folder anew."""

    def write(batch: DataFrame, number: int) -> None:
        route_pages(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
