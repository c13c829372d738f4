"""Queries that carry values along an order, in which one client or manual may hold most rows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carry, graph
from ..sources import project


def sales_asof_change(spark: SparkSession, d: str) -> DataFrame:
    """Every sale with what the client's last change said when it was sold."""
    sales = project.load(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    return carry.asof(sales, project.load(spark, d, "client_changes"), ["client_id"], "sold_at", "valid_at", ["change_id", "segment", "city", "balance"])


def clicks_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every click with its client's last known kind and value."""
    clicks = project.load(spark, d, "clicks").drop("props")
    filled = carry.last_known(clicks, ["client_id"], ["ts", "click_id", "arrived_at", "kind", "value"], {"last_kind": F.col("kind"), "last_value": F.col("value")})
    return filled.select("click_id", "client_id", "ts", "last_kind", "last_value")


def sale_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Which of its client's sales a sale is in order of time, and how many were done before it."""
    sales = project.load(spark, d, "sales").drop("priority")
    order = ["sold_at", "sale_id", "arrived_at", "status", "total"]
    numbered = carry.running_sum(sales, ["client_id"], order, {"nth": F.lit(1)})
    done = carry.running_sum(numbered, ["client_id"], ["nth"], {"done_before": (F.col("status") == "done").cast("int")}, own=False)
    return done.select("sale_id", "client_id", "sold_at", "nth", "done_before")


def chapter_asof_volume(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every manual with the section that last began at or before it."""
    docs = project.load(spark, d, "documents")
    pages = project.elements(docs).select("manual_id", "page").distinct()
    return graph.chapter_asof(pages, project.sections(docs).select("manual_id", F.col("page_start").alias("page"), F.col("title").alias("chapter")))


def elements_under_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every line with the heading that it stands under in its manual."""
    lines = project.elements(project.load(spark, d, "documents")).select("manual_id", "element_id", F.when(F.col("type") == "heading", F.col("text")).alias("own"))
    return carry.last_known(lines, ["manual_id"], ["element_id"], {"heading": F.col("own")}).drop("own")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (sales_asof_change, clicks_filled, sale_numbers, chapter_asof_volume, elements_under_headings)}

SQL: dict[str, str] = {
    "sales_asof_change": """SELECT sale_id, s.client_id, sold_at, change_id, segment, city, balance FROM sales s ASOF LEFT JOIN
(SELECT * FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY change_id DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) = 1) c
ON s.client_id = c.client_id AND s.sold_at >= c.valid_at""",
    "clicks_filled": """SELECT click_id, client_id, ts, last_value(kind IGNORE NULLS) OVER w AS last_kind, last_value(value IGNORE NULLS) OVER w AS last_value FROM clicks
WINDOW w AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, arrived_at NULLS FIRST, kind NULLS FIRST, value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sale_numbers": """SELECT sale_id, client_id, sold_at, row_number() OVER w AS nth, CAST(sum((status = 'done')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS done_before FROM sales
WINDOW w AS (PARTITION BY client_id ORDER BY sold_at NULLS FIRST, sale_id NULLS FIRST, arrived_at NULLS FIRST, status NULLS FIRST, total NULLS FIRST)""",
    "chapter_asof_volume": f"""WITH {project.SQL}, p AS (SELECT DISTINCT manual_id, page FROM el),
c AS (SELECT manual_id, page_start, max(title) AS chapter FROM sec GROUP BY manual_id, page_start)
SELECT p.manual_id, p.page, chapter FROM p ASOF LEFT JOIN c ON p.manual_id = c.manual_id AND p.page >= c.page_start""",
    "elements_under_headings": f"WITH {project.SQL} SELECT manual_id, element_id, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY manual_id ORDER BY element_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM el",
}
