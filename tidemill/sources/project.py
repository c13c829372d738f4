"""The test tables as a knowledge model: documents become sections, their lines elements.

Everything follows from doc_id and the text, so the projection needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages left for a document, and lines on a page.
PAGES, LINES = 100, 10


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(docs: DataFrame) -> DataFrame:
    """One section per document."""
    kind = F.element_at(F.array(*map(F.lit, ("data", "procedure", "plate", "schedule", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, "DMPSX")), (F.col("doc_id") % 5 + 1).cast("int"))
    n = F.size(F.split("text", "\n", -1))
    code = F.concat(letter, F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("manual_id"), F.array("source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("path"),
        F.substring(F.get(F.split("text", "\n", -1), F.lit(0)), 1, 60).alias("title"), kind.alias("kind"), code.alias("doc_code"),
        F.when(F.col("doc_id") % 5 < 2, F.concat((F.floor(F.col("doc_id") / 10) % 900 + 100).cast("string"), F.lit("-"), (F.col("doc_id") % 10).cast("string"))).alias("procedure_no"),
        F.concat(F.lit("E"), (F.col("doc_id") % 4).cast("string")).alias("edition"),
        (F.col("doc_id") * PAGES + 1).cast("long").alias("page_start"), (F.col("doc_id") * PAGES + 1 + F.floor((n - 1) / LINES)).cast("long").alias("page_end"),
    )


def elements(docs: DataFrame) -> DataFrame:
    """One element per line that is not blank."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where(F.trim("text") != "")
    kind = F.when(F.col("pos") == 0, "heading").when(F.char_length("text") < 60, "list").otherwise("paragraph")
    return lines.select(
        (F.col("doc_id") * 100_000 + F.col("pos")).alias("element_id"), F.col("doc_id").alias("section_id"), F.col("source").alias("manual_id"), kind.alias("type"),
        (F.col("doc_id") * PAGES + 1 + F.floor(F.col("pos") / LINES)).cast("long").alias("page"), (F.col("pos") % LINES).cast("int").alias("step"), "text",
    )


def questions(conversations: DataFrame) -> DataFrame:
    """Every user turn of every conversation, with its whole text, as a question to one manual."""
    asked = conversations.where("role = 'user' and text is not null")
    return asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("manual_id"), "text")


def passages(benchmark: DataFrame) -> DataFrame:
    """Every benchmark text as a question to each of the manuals that questions go to."""
    n = F.explode(F.sequence(F.lit(0), F.lit(19)))
    asked = benchmark.where("text is not null").select("item_id", "text", n.alias("n"))
    return asked.select((F.col("item_id") * 100 + F.col("n")).alias("query_id"), F.concat(F.lit("src"), F.col("n").cast("string")).alias("manual_id"), "text")


SQL = """
sec AS (
  SELECT doc_id AS section_id, source AS manual_id, [source, lang, 'doc-' || doc_id] AS path, left(string_split(text, chr(10))[1], 60) AS title,
         ['data', 'procedure', 'plate', 'schedule', 'other'][doc_id % 5 + 1] AS kind, ['D', 'M', 'P', 'S', 'X'][doc_id % 5 + 1] || lpad(doc_id::VARCHAR, 6, '0') AS doc_code,
         CASE WHEN doc_id % 5 < 2 THEN (doc_id // 10 % 900 + 100) || '-' || (doc_id % 10) END AS procedure_no, 'E' || (doc_id % 4) AS edition,
         doc_id * 100 + 1 AS page_start, doc_id * 100 + 1 + (len(string_split(text, chr(10))) - 1) // 10 AS page_end
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
el AS (
  SELECT doc_id * 100000 + pos AS element_id, doc_id AS section_id, source AS manual_id, CASE WHEN pos = 0 THEN 'heading' WHEN length(text) < 60 THEN 'list' ELSE 'paragraph' END AS type,
         doc_id * 100 + 1 + pos // 10 AS page, (pos % 10)::INT AS step, text FROM ln WHERE trim(text) <> ''),
qu AS (SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 20) AS manual_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
qb AS (SELECT item_id * 100 + n AS query_id, 'src' || n AS manual_id, text FROM benchmark, range(20) AS r(n) WHERE text IS NOT NULL)
"""


def _procedure(d: Column) -> Column:
    return F.concat((F.floor(d / 10) % 90 + 100).cast("string"), F.lit("-"), (d % 10).cast("string"))


def _last_text() -> Column:
    """What follows a document's lines: references to a plate, a data sheet and a section of the same ten; none in data sheets."""
    d = F.col("doc_id")
    ten = d - d % 10
    plate = F.concat(F.lit("P"), F.lpad((d - d % 5 + 2).cast("string"), 6, "0"))
    return F.when(d % 5 != 0, F.concat(F.lit("Refer to Plate "), plate, F.lit(". See data "), _procedure(ten), F.lit(" and Section "), _procedure(ten + 1), F.lit(". Gap 0."), (d % 7).cast("string"), F.lit(" mm at "), _limit_code(d)))


def _limit_code(d: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad((F.floor(d / 10) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.floor(d / 1000) % 100).cast("string"), 2, "0"))


def _table() -> Column:
    """The table of a data sheet: one code and its limit."""
    d = F.col("doc_id")
    return F.concat(F.lit('{"grid":[[{"text":"'), _limit_code(d), F.lit('"},{"text":"max 0.'), (d % 7).cast("string"), F.lit(' mm"}]]}'))


class Knowledge:
    """All tables of the knowledge model from documents and conversations, by rule.

    Codes, titles, editions and pages follow from doc_id; after its lines a document has one more element, which refers to others or, in
    data sheets, is a table with a limit. A user turn asks the manual of the document that has its conversation's number and
    names that document's codes; its first hits are elements of this document and the next two. No table needs a window
    or a shuffle but for the join of questions.
    """

    #: The columns each table has.
    TABLES = ("manuals", "sections", "elements", "figures", "edges", "questions", "hits")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        docs = load(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
        self.turns = load(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
        letter, kind, action = (F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % 5 + 1).cast("int")) for v in ("DMPSX", ("data", "procedure", "plate", "schedule", "other"), ("Data", "Checking", "Plate", "Interval", "Notes")))
        self.docs = docs.select(
            "doc_id", "lang", "text", F.col("source").alias("manual_id"), kind.alias("kind"), action.alias("action_title"), F.concat(letter, F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("doc_code"),
            F.concat(F.lit("Part "), F.floor(F.col("doc_id") / 100).cast("string")).alias("component_title"), F.concat(F.lit("E"), (F.floor(F.col("doc_id") / 10) % 4).cast("string")).alias("edition"),
            F.when(F.col("doc_id") % 5 < 2, _procedure(F.col("doc_id"))).alias("procedure_no"),
            F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("AB"), F.lpad((F.col("doc_id") % 10_000).cast("string"), 4, "0"), F.lit("-1"))).alias("drawing_code"),
            F.concat(F.split("text", "\n", -1), F.array(_last_text())).alias("lines"), (F.col("doc_id") * PAGES + 1).cast("long").alias("page_start"),
        ).withColumn("plate_no", F.when(F.col("doc_id") % 5 == 2, F.col("doc_code")))

    def __call__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    @staticmethod
    def _lines(docs: DataFrame, *columns: str) -> DataFrame:
        """A row a line that is not blank, and one for what follows the lines."""
        rows = docs.select("doc_id", *columns, (F.size("lines") - 1).alias("last"), F.posexplode("lines").alias("pos", "text"))
        return rows.where((F.trim("text") != "") | (F.col("pos") == F.col("last")))

    def manuals(self) -> DataFrame:
        return self.docs.where("manual_id is not null").select("manual_id").distinct().select("manual_id", F.concat(F.lit("Handbook "), "manual_id").alias("title"), F.col("manual_id").alias("equipment"), F.upper("manual_id").alias("model"))

    def sections(self) -> DataFrame:
        end = F.col("page_start") + F.floor((F.size("lines") - 2) / LINES).cast("long")
        path = F.concat_ws("/", "component_title", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
        return self.docs.select(F.col("doc_id").alias("section_id"), "manual_id", path.alias("path"), "kind", "procedure_no", "plate_no", "doc_code", "component_title", "action_title", "edition", "page_start", end.alias("page_end"))

    def elements(self) -> DataFrame:
        rows = self._lines(self.docs, "manual_id", "procedure_no", "plate_no", "edition", "drawing_code", "page_start")
        at_end = F.col("pos") == F.col("last")
        kind = F.when(at_end, F.when(F.col("text").isNull(), "table").otherwise("paragraph")).when(F.col("pos") == 0, "heading").when(F.char_length("text") < 60, "list").otherwise("paragraph")
        return rows.select(
            (F.col("doc_id") * 100_000 + F.col("pos")).alias("element_id"), F.col("doc_id").alias("section_id"), "manual_id", kind.alias("type"), (F.col("page_start") + F.floor((F.col("pos") - at_end.cast("int")) / LINES)).cast("long").alias("page"), "text",
            F.when(at_end & F.col("text").isNull(), _table()).alias("table_json"), "procedure_no", "plate_no", "edition", F.when(F.col("pos") == 0, F.col("drawing_code")).alias("drawing_code"), F.when(kind == "list", F.col("pos") % LINES).cast("int").alias("step"),
        )

    def figures(self) -> DataFrame:
        d = F.col("doc_id")
        return self.docs.where("plate_no is not null").select(
            d.alias("figure_id"), F.when(d % 35 != 2, d * 100_000).alias("element_id"), "manual_id", d.alias("section_id"), F.col("page_start").alias("page"), F.concat(F.lit("p"), F.col("page_start").cast("string"), F.lit(".png")).alias("image"),
            F.col("plate_no").alias("label"), F.when(d % 10 == 7, 1).alias("panel_index"), "drawing_code", F.when(d % 10 == 7, (F.floor(d / 10) % 10).cast("int")).alias("step"),
        )

    def edges(self) -> DataFrame:
        d = F.col("doc_id")
        kinds = ("references_data", "references_section", "cross_ref", "describes", "illustrates_step", "illustrates")
        return self.docs.select((d * 100_000).alias("from_id"), ((d - d % 100 + (d * 7) % 100) * 100_000).alias("to_id"), F.element_at(F.array(*map(F.lit, kinds)), (d % 6 + 1).cast("int")).alias("type"))

    def questions(self) -> DataFrame:
        about = self.docs.select(F.col("doc_id").alias("conv_id"), "manual_id", "doc_code", "procedure_no")
        text = F.concat_ws(" ", "text", "doc_code", "procedure_no")
        wanted = F.when(F.col("conv_id") % 3 == 0, F.upper("manual_id")).when(F.col("conv_id") % 3 == 1, "AC77")
        return self.turns.join(about, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "manual_id", text.alias("text"), wanted.alias("equipment"))

    def hits(self) -> DataFrame:
        asked = self.turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(F.sequence(F.col("conv_id"), F.col("conv_id") + 2)).alias("k", "doc_id")).join(self.docs.select(F.col("doc_id").alias("conv_id")), F.floor(F.col("query_id") / 1000) == F.col("conv_id"), "left_semi")
        rows = self._lines(self.docs).where((F.col("pos") < 8) | (F.col("pos") == F.col("last")))
        return rows.join(asked, "doc_id").select("query_id", (F.col("doc_id") * 100_000 + F.col("pos")).alias("element_id"), (10.0 - F.least(F.col("pos"), F.lit(9)) + 0.25 * F.col("k")).alias("score"))


KNOWLEDGE_SQL = {
    "base": """d0 AS (
  SELECT doc_id, lang, source AS manual_id, list_append(string_split(text, chr(10)), CASE WHEN doc_id % 5 <> 0 THEN 'Refer to Plate P' || lpad((doc_id - doc_id % 5 + 2)::VARCHAR, 6, '0') || '. See data ' || (doc_id // 10 % 90 + 100) || '-0 and Section ' || (doc_id // 10 % 90 + 100) || '-1. Gap 0.' || doc_id % 7 || ' mm at A' || lpad((doc_id // 10 % 100)::VARCHAR, 2, '0') || '-' || lpad((doc_id // 1000 % 100)::VARCHAR, 2, '0') END) AS lines, ['data', 'procedure', 'plate', 'schedule', 'other'][doc_id % 5 + 1] AS kind, ['Data', 'Checking', 'Plate', 'Interval', 'Notes'][doc_id % 5 + 1] AS action_title,
         ['D', 'M', 'P', 'S', 'X'][doc_id % 5 + 1] || lpad(doc_id::VARCHAR, 6, '0') AS doc_code, 'Part ' || doc_id // 100 AS component_title, 'E' || doc_id // 10 % 4 AS edition,
         CASE WHEN doc_id % 5 < 2 THEN (doc_id // 10 % 90 + 100) || '-' || doc_id % 10 END AS procedure_no, CASE WHEN doc_id % 5 = 2 THEN 'AB' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '-1' END AS drawing_code,
         doc_id * 100 + 1 AS page_start, CASE WHEN doc_id % 5 = 2 THEN 'P' || lpad(doc_id::VARCHAR, 6, '0') END AS plate_no FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l1 AS (SELECT *, len(lines) - 1 AS last, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS pos FROM d0),
l0 AS (SELECT *, pos = last AS at_end FROM l1 WHERE trim(text) <> '' OR pos = last),
t0 AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)""",
    "manuals": "SELECT DISTINCT manual_id, 'Handbook ' || manual_id AS title, manual_id AS equipment, upper(manual_id) AS model FROM d0 WHERE manual_id IS NOT NULL",
    "sections": "SELECT doc_id AS section_id, manual_id, concat_ws('/', component_title, lang, 'doc-' || doc_id) AS path, kind, procedure_no, plate_no, doc_code, component_title, action_title, edition, page_start, page_start + (len(lines) - 2) // 10 AS page_end FROM d0",
    "elements": """SELECT doc_id * 100000 + pos AS element_id, doc_id AS section_id, manual_id, CASE WHEN at_end AND text IS NULL THEN 'table' WHEN at_end THEN 'paragraph' WHEN pos = 0 THEN 'heading' WHEN length(text) < 60 THEN 'list' ELSE 'paragraph' END AS type, page_start + (pos - at_end::INT) // 10 AS page, text,
  CASE WHEN at_end AND text IS NULL THEN '{"grid":[[{"text":"A' || lpad((doc_id // 10 % 100)::VARCHAR, 2, '0') || '-' || lpad((doc_id // 1000 % 100)::VARCHAR, 2, '0') || '"},{"text":"max 0.' || doc_id % 7 || ' mm"}]]}' END AS table_json,
  procedure_no, plate_no, edition, CASE WHEN pos = 0 THEN drawing_code END AS drawing_code, CASE WHEN pos > 0 AND NOT at_end AND length(text) < 60 THEN (pos % 10)::INT END AS step FROM l0""",
    "figures": """SELECT doc_id AS figure_id, CASE WHEN doc_id % 35 <> 2 THEN doc_id * 100000 END AS element_id, manual_id, doc_id AS section_id, page_start AS page, 'p' || page_start || '.png' AS image, plate_no AS label,
  CASE WHEN doc_id % 10 = 7 THEN 1 END AS panel_index, drawing_code, CASE WHEN doc_id % 10 = 7 THEN (doc_id // 10 % 10)::INT END AS step FROM d0 WHERE plate_no IS NOT NULL""",
    "edges": "SELECT doc_id * 100000 AS from_id, (doc_id - doc_id % 100 + doc_id * 7 % 100) * 100000 AS to_id, ['references_data', 'references_section', 'cross_ref', 'describes', 'illustrates_step', 'illustrates'][doc_id % 6 + 1] AS type FROM d0",
    "questions": "SELECT query_id, manual_id, concat_ws(' ', t0.text, doc_code, procedure_no) AS text, CASE conv_id % 3 WHEN 0 THEN upper(manual_id) WHEN 1 THEN 'AC77' END AS equipment FROM t0 JOIN d0 ON doc_id = conv_id",
    "hits": "SELECT query_id, l0.doc_id * 100000 + pos AS element_id, 10 - least(pos, 9) + 0.25::DOUBLE * k AS score FROM t0, range(3) AS r(k) JOIN l0 ON l0.doc_id = conv_id + k WHERE (pos < 8 OR at_end) AND conv_id IN (SELECT doc_id FROM d0)",
}


def knowledge_sql(*names: str) -> str:
    """The tables as common table expressions named i_<name>."""
    return ",\n".join([KNOWLEDGE_SQL["base"], *[f"i_{n} AS MATERIALIZED ({KNOWLEDGE_SQL[n]})" for n in names]])
