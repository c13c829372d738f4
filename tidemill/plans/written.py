"""Queries over what upserts wrote and over JSON of unknown depth, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, variant
from ..operators.upsert import Upserts
from ..sources import project
from .storage import shared_folder

CHANGES = "change_id long, client_id long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


def client_table(folder: str, buckets: int = 16) -> Upserts:
    """Clients as their changes leave them; what a change does not give stays."""
    schema = "client_id long, at timestamp_ntz, change_id long, gone boolean, source string, segment string, city string, balance double, name string, email string"
    return Upserts(folder, schema, ("client_id",), ("at", "change_id"), ("segment", "city", "balance", "name", "email"), ("source",), (), "gone", buckets)


def section_table(folder: str, buckets: int = 16) -> Upserts:
    """Sections by manual and component: codes are filled, what the newest document says of itself is replaced, the first page stays."""
    schema = "manual_id string, component_title string, section_id long, procedure_no string, plate_no string, doc_code string, kind string, edition string, page_start long"
    return Upserts(folder, schema, ("manual_id", "component_title"), ("section_id",), ("procedure_no", "plate_no"), ("doc_code", "kind", "edition"), ("page_start",), None, buckets)


def upserted_clients(spark: SparkSession, d: str) -> DataFrame:
    """Changes as a stream, then the list of clients, whose rows are older than some changes and newer than others."""
    folder = _folder(spark, "clients")
    table = client_table(f"{folder}/table").create(spark)
    # a pattern, as a stream takes one for a file as well as for a folder
    changes = spark.readStream.schema(CHANGES).parquet(f"{d}/client_changes.parque[t]")
    none = F.lit(None).cast("string")
    table.write_stream(changes.select("*", F.col("valid_at").alias("at"), (F.col("op") == "D").alias("gone"), none.alias("name"), none.alias("email")), f"{folder}/checkpoint").awaitTermination()
    clients = project.load(spark, d, "clients").select("*", F.col("updated_at").alias("at"), F.lit(None).cast("long").alias("change_id"), F.lit(False).alias("gone"))
    table.write(clients, 1_000_000)
    return table.rows(spark)


def upserted_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents in three batches that come out of order."""
    table = section_table(_folder(spark, "sections")).create(spark)
    sections = project.Knowledge(spark, d).sections()
    for number, part in enumerate((2, 0, 1)):
        table.write(sections.where(F.pmod("section_id", F.lit(3)) == part), number)
    return table.rows(spark)


def upsert_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the ledger observed while all sections were written at once: rows read and keys written."""
    table = section_table(_folder(spark, "sections")).create(spark)
    table.write(project.Knowledge(spark, d).sections(), 0)
    return table.ledger(spark)


def click_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every click's props."""
    return variant.paths(project.load(spark, d, "clicks"), "props", ["click_id"]).drop("place")


def props_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The places of the props of events and clicks alike."""
    both = project.load(spark, d, "events").select("props").unionByName(project.load(spark, d, "clicks").select("props"))
    return variant.catalog(variant.paths(both, "props", []))


def page_elements(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list items, tables and paragraphs of all pages."""
    return html.elements(project.load(spark, d, "pages"), ["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (upserted_clients, upserted_sections, upsert_ledger, click_paths, props_catalog, page_elements)}

_FILLED = ", ".join(f"first({c} ORDER BY v DESC, {c} DESC) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("segment", "city", "balance", "name", "email"))
_CODES = ", ".join(f"first({c} ORDER BY section_id DESC, {c} DESC) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("procedure_no", "plate_no"))
_NEWEST = ", ".join(f"first({c} ORDER BY section_id DESC, doc_code DESC, kind DESC, edition DESC) AS {c}" for c in ("doc_code", "kind", "edition"))
# members and items of all levels
_TREE = """RECURSIVE raw AS (SELECT {keys}, props, CASE WHEN json_valid(props) THEN props::JSON END AS node FROM {table} WHERE props IS NOT NULL),
tree AS (
  SELECT {keys}, '$' AS path, '$' AS place, node FROM raw
  UNION ALL
  SELECT {keys}, path || CASE WHEN member IS NULL THEN '[' || i || ']' ELSE '.' || member END, place || CASE WHEN member IS NULL THEN '[*]' ELSE '.' || member END, child
  FROM (SELECT {keys}, path, place, unnest(CASE WHEN json_type(node) = 'OBJECT' THEN json_keys(node) WHEN json_type(node) = 'ARRAY' THEN list_transform(range(json_array_length(node)::BIGINT), lambda x: NULL::VARCHAR) ELSE [] END) AS member,
               unnest(CASE WHEN json_type(node) = 'OBJECT' THEN list_transform(json_keys(node), lambda k: json_extract(node, '$."' || k || '"')) WHEN json_type(node) = 'ARRAY' THEN json_extract(node, '$[*]') ELSE [] END) AS child,
               unnest(CASE WHEN json_type(node) = 'OBJECT' THEN range(len(json_keys(node))) WHEN json_type(node) = 'ARRAY' THEN range(json_array_length(node)::BIGINT) ELSE [] END) AS i FROM tree)),
val AS (SELECT {keys}, path, place, CASE WHEN node IS NULL THEN 'invalid' WHEN json_type(node) IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(json_type(node)) WHEN json_type(node) = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
  CASE WHEN json_type(node) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN node ->> '$' END AS value FROM tree)"""



def _seen(x: str) -> str:
    """Text as a reader sees it, numbered characters one by one."""
    bare = rf"regexp_replace(regexp_replace({x}, '(?i)<br\b[^>]*>', ' ', 'g'), '</?[A-Za-z!][^>]*>', '', 'g')"
    for entity, sign in html.ENTITIES:
        quoted = sign.replace("'", "''")
        bare = f"replace({bare}, '{entity}', '{quoted}')"
    known = "TRY_CAST(regexp_extract(x, '^([0-9]{1,7});', 1) AS INT)"
    pieces = f"list_transform(string_split({bare}, '&#'), lambda x, i: CASE WHEN i = 1 THEN x WHEN {known} BETWEEN 1 AND 55295 OR {known} BETWEEN 57344 AND 1114111 THEN chr({known}) || regexp_replace(x, '^[0-9]+;', '') ELSE '&#' || x END)"
    return rf"trim(regexp_replace(replace(array_to_string({pieces}, ''), '&amp;', '&'), '[ \t\r\n\x{{A0}}]+', ' ', 'g'))"


_CELLS = rf"list_transform(string_split_regex(r, '(?i)<t[dh]\b[^>]*>')[2:], lambda c: {{'text': {_seen('c')}}})"

SQL: dict[str, str] = {
    "upserted_clients": f"""WITH ch AS (
  SELECT client_id, valid_at AS told, change_id, coalesce(op = 'D', false) AS gone, source, segment, city, balance, NULL::VARCHAR AS name, NULL::VARCHAR AS email FROM client_changes
  UNION ALL SELECT client_id, updated_at, NULL, false, source, segment, city, balance, name, email FROM clients),
r AS (SELECT *, dense_rank() OVER (PARTITION BY client_id ORDER BY told NULLS FIRST, change_id NULLS FIRST) AS v FROM ch),
d AS (SELECT client_id, coalesce(max(v) FILTER (WHERE gone), 0) AS last FROM r GROUP BY client_id)
SELECT r.client_id, {_FILLED}, first(source ORDER BY v DESC, source DESC NULLS LAST) AS source
FROM r JOIN d ON r.client_id IS NOT DISTINCT FROM d.client_id WHERE NOT gone AND v > last GROUP BY r.client_id""",
    "upserted_sections": f"WITH {project.knowledge_sql('sections')} SELECT manual_id, component_title, {_CODES}, {_NEWEST}, first(page_start ORDER BY section_id, page_start) AS page_start FROM i_sections GROUP BY manual_id, component_title",
    "upsert_ledger": f"WITH {project.knowledge_sql('sections')} SELECT 0::BIGINT AS batch, 'done' AS event, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT manual_id, component_title FROM i_sections)) AS n_keys FROM i_sections",
    "click_paths": f"WITH {_TREE.format(keys='click_id', table='clicks')} SELECT click_id, path, kind, value FROM val",
    "props_catalog": f"WITH {_TREE.format(keys='z', table='(SELECT 0 AS z, props FROM events UNION ALL SELECT 0, props FROM clicks)')} SELECT place, kind, count(*) AS n, count(DISTINCT value) AS n_values FROM val GROUP BY place, kind",
    "page_elements": rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '[\x01-\x03]', ' ', 'g'), '{html.UNSEEN}', '', 'g') AS c FROM pages WHERE html IS NOT NULL),
f AS (SELECT page_id, flatten(list_transform(string_split(regexp_replace(c, '{html.TABLE}', chr(2) || chr(3) || '\1' || chr(2), 'g'), chr(2)),
  lambda x: CASE WHEN starts_with(x, chr(3)) THEN [x] ELSE string_split(regexp_replace(x, '{html.BLOCK}', chr(1) || '\1', 'g'), chr(1)) END)) AS pieces FROM p),
u AS (SELECT page_id, unnest(pieces) AS x, (generate_subscripts(pieces, 1) - 1)::INT AS pos FROM f),
t AS (SELECT *, lower(regexp_extract(x, '^<([A-Za-z0-9]+)', 1)) AS tag, starts_with(x, chr(3)) AS tabular FROM u),
e AS (SELECT page_id, pos, CASE WHEN tabular THEN 'table' WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS type,
  CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN tag[2]::INT END AS level, CASE WHEN NOT tabular THEN {_seen('x')} END AS text,
  CASE WHEN tabular THEN to_json({{'grid': list_transform(string_split_regex(x, '(?i)<tr\b[^>]*>')[2:], lambda r: {_CELLS})}})::VARCHAR END AS table_json FROM t)
SELECT * FROM e WHERE type = 'table' OR text <> ''""",
}
