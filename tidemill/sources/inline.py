"""A small corpus of invented rows that carries what the volume tables lack: codes, units, tables, figures, steps, edges.

The rows are given once and rendered for Spark and, as VALUES, for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_T = '{"grid":[[{"text":"Gap"},{"text":"Gap"},{"text":"0.30 mm"}],[{"text":"A12-03"},{"text":"max 0.45 mm"}]]}'
_U = '{"grid":[[{"text":"A12-03"},{"text":"max 0.50 mm"}]]}'

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "manuals": ("manual_id string, title string, equipment string, model string", [("m1", "Feed pump handbook", "Feed pump", "FP120"), ("m2", "Air compressor handbook", "Air compressor", "AC77")]),
    "fleet": ("equipment_id string, manual_id string, manufacturer string, model string, status string", [("eq1", "m1", "Acme", "FP120", "current"), ("eq2", "m2", "Acme", "AC77", "current"), ("eq1", "m2", None, "FP120", "old")]),
    "sections": (
        "section_id long, manual_id string, path string, kind string, procedure_no string, plate_no string, doc_code string, component_title string, action_title string, edition string, page_start int, page_end int",
        [
            (10, "m1", "Pump/Valve cover", "procedure", "301-1", None, "M30101", "Valve cover", "Checking", "A2", 10, 12),
            (11, "m1", "Pump/Valve cover/Data", "data", "301-1", None, "D30101", "Valve cover", "Data", "A2", 13, 13),
            (12, "m1", "Pump/Valve cover/Plate", "plate", None, "P30101", "P30101", "Valve cover", "Plate", "A2", 14, 14),
            (13, "m1", "Pump/Rotor", "procedure", "302-1", None, "M30201", "Rotor", "Dismantling", "A1", 15, 18),
            (14, "m1", "Pump/Rotor/Data", "data", "302-2", None, "D30202", "Rotor", "Data", "A3", 19, 19),
            (15, "m1", "Pump/Rotor/Plate", "plate", None, "P30201", "P30201", "Rotor", "Plate", "A1", 20, 21),
            (16, "m1", "Upkeep", "schedule", None, None, "S90001", "Upkeep plan", None, "A1", 21, 25),
            (17, "m1", "Pump", "other", None, None, None, "Pump", None, None, 10, 20),
            (18, "m1", "Pump/Rotor/New", "procedure", "302-1", None, "M30203", "Rotor shaft", "Dismantling", "A4", 40, 41),
            (20, "m2", "Compressor/Valve cover", "procedure", "301-1", None, "M30101", "Valve cover", "Mounting", "B1", 5, 6),
            (21, "m2", "Compressor/Valve cover/Data", "data", "301-1", None, "D30101", "Valve cover", "Data", "B1", 7, 7),
        ],
    ),
    "elements": (
        "element_id long, section_id long, manual_id string, type string, page int, text string, table_json string, procedure_no string, plate_no string, edition string, drawing_code string, step int",
        [
            (100, 10, "m1", "heading", 10, "Valve cover checking", None, "301-1", None, "A2", None, None),
            (101, 10, "m1", "list", 11, "1. Loosen the nuts of the valve cover", None, "301-1", None, "A2", None, 1),
            (102, 10, "m1", "list", 11, "2. Lift the valve cover. See data 301-1 and Section 302-1", None, "301-1", None, "A2", None, 2),
            (103, 10, "m1", "paragraph", 12, "Tightening torque of the cover nuts is 45 Nm. Refer to Plate P30101", None, "301-1", None, "A2", None, None),
            (104, 11, "m1", "table", 13, None, _T, "301-1", None, "A2", None, None),
            (105, 12, "m1", "plate", 14, "Valve cover plate", None, None, "P30101", "A2", "AB1234-5", None),
            (106, 13, "m1", "heading", 15, "Rotor dismantling", None, "302-1", None, "A1", None, None),
            (107, 13, "m1", "list", 16, "1. Remove the rotor. The clearance must not exceed 0.30 mm", None, "302-1", None, "A1", None, 1),
            (108, 13, "m1", "warning", 16, "Shut off the hydraulic pressure before work", None, "302-1", None, "A1", None, None),
            (109, 14, "m1", "table", 19, "A12-03 rotor gap", _U, "302-2", None, "A3", None, None),
            (110, 15, "m1", "plate", 20, None, None, None, "P30201", "A1", "AB1235-1", None),
            (111, 16, "m1", "paragraph", 21, "Check the rotor every 2000 hours", None, None, None, "A1", None, None),
            (115, 13, "m1", "paragraph", 17, "For the gap see data. Tighten evenly", None, "302-1", None, "A1", None, None),
            (112, None, "m1", "paragraph", 30, "Loose page without a section", None, None, None, None, None, None),
            (113, 15, "m1", "figure", 16, "Step picture of the rotor", None, None, None, None, "AB1235-2", 1),
            (114, 18, "m1", "heading", 40, "Rotor shaft dismantling, new tools", None, "302-1", None, "A4", None, None),
            (120, 20, "m2", "heading", 5, "Valve cover mounting", None, "301-1", None, "B1", None, None),
            (121, 20, "m2", "list", 5, "1. Mount the valve cover of the compressor", None, "301-1", None, "B1", None, 1),
            (122, 21, "m2", "table", 7, None, _U, "301-1", None, "B1", None, None),
        ],
    ),
    "figures": (
        "figure_id long, element_id long, manual_id string, section_id long, page int, image string, label string, panel_index int, drawing_code string, step int",
        [(1, 105, "m1", 12, 14, "p14.png", "P30101", None, "AB1234-5", None), (2, 110, "m1", 15, 20, "p20.png", "P30201", None, None, None), (3, 113, "m1", 15, 16, "p16-1.png", None, 1, "AB1235-2", 1), (4, None, "m1", 15, 20, "lost.png", None, None, None, None)],
    ),
    "edges": (
        "from_id long, to_id long, type string",
        [(102, 104, "references_data"), (102, 106, "references_section"), (103, 105, "cross_ref"), (103, 105, "cross_ref"), (104, 101, "describes"), (113, 107, "illustrates_step"), (105, 101, "illustrates"), (101, 999, "cross_ref")],
    ),
    "questions": (
        "query_id long, manual_id string, text string, equipment string",
        [
            (1, "m1", "What is the tightening torque of the valve cover nuts in 301-1?", "FP120"),
            (2, "m1", "How do I remove the rotor?", None),
            (3, "m1", "Show me the plate P30201 of the rotor", None),
            (4, "m1", "Is the rotor clearance of 0.30 mm still valid?", "AC77"),
            (5, "m2", "Checking interval of the valve cover 301-1, edition B9", None),
            (6, "m1", "Rotor data, not the valve cover", None),
            (7, "m2", "Which pistons need replacing?", None),
        ],
    ),
    "asked": (
        "query_id long, text string",
        [
            (1, "Compare the rotor limits with plate P30101. Do not use the valve cover data, see AB1234-5"), (2, "Is 0.45 mm right for the gap, and is it the same for the casing?"), (3, "Rotor gap, not shaft-seal. Is that a drive-belt? Quote it"),
            (4, "Which limit holds for A12-03, even if A12-04 (bearing shell gap) looks familiar"), (5, "Torque of D30101 and KN902-1.3"), (6, ""), (7, None), (8, "not the 301-1 sheet but 302-1; avoid P30201."),
        ],
    ),
    "hits": (
        "query_id long, element_id long, score double",
        [(1, 103, 9.0), (1, 102, 7.0), (1, 104, 5.0), (1, 121, 1.0), (2, 107, 8.0), (2, 108, 6.0), (2, 106, 4.0), (3, 110, 7.0), (3, 113, 3.0), (4, 107, 9.0), (4, 109, 8.0), (4, 104, 2.0), (5, 120, 6.0), (5, 122, 5.0), (6, 109, 5.0), (6, 104, 4.0), (6, 103, 3.0)],
    ),
    "picks": ("query_id long, section_id long", [(1, 10), (1, 11), (2, 13), (2, 13), (5, 20)]),
    "codes": ("manual_id string, code string", [("m1", "301-1.2"), ("m1", "302-1.4"), ("m1", "303-2.1"), ("m1", "D30101"), ("m2", "301-1"), ("m2", "AB-123"), ("m2", "CD-4567"), ("m3", "odd"), ("m3", "7.1.2")]),
    "new_fleet": ("equipment_id string, manual_id string, manufacturer string, model string, status string", [("eq1", "m1", None, "FP121", "current"), ("eq3", "m2", "Bolt", "AC80", "current")]),
    "rects": (
        "manual_id string, page int, x0 double, y0 double, x1 double, y1 double, width double, height double",
        [("m1", 1, 50.0, 50.0, 290.0, 390.0, 600.0, 800.0), ("m1", 1, 310.0, 50.0, 560.0, 390.0, 600.0, 800.0), ("m1", 1, 60.0, 60.0, 200.0, 200.0, 600.0, 800.0), ("m1", 1, 50.0, 420.0, 290.0, 760.0, 600.0, 800.0), ("m1", 1, 0.0, 0.0, 600.0, 800.0, 600.0, 800.0), ("m1", 2, 100.0, 100.0, 130.0, 500.0, 600.0, 800.0), ("m1", 2, 100.0, 100.0, 400.0, 400.0, 600.0, 800.0), ("m2", 1, 0.0, 0.0, 100.0, 100.0, 200.0, 200.0)],
    ),
    "labels": ("manual_id string, page int, code string, x double, y double", [("m1", 1, "AB1-1", 280.0, 380.0), ("m1", 1, "AB1-2", 550.0, 380.0), ("m1", 1, "AB1-3", 300.0, 400.0), ("m1", 2, "AB2-1", 390.0, 390.0), ("m1", 2, "AB2-2", 391.0, 391.0), ("m2", 1, "ZZ9-9", 50.0, 50.0)]),
    "spans": (
        "manual_id string, page int, x0 double, y0 double, y1 double, text string",
        [("m1", 1, 300.0, 21.0, 30.0, "Edition 07"), ("m1", 1, 20.0, 19.0, 30.0, "Quote 902-1.3"), ("m1", 1, 20.0, 40.0, 50.0, "Rotor"), ("m1", 1, 20.0, 100.0, 110.0, "body"), ("m1", 2, 20.0, 30.0, 62.0, "Cover"), ("m1", 3, 20.0, 60.0, 70.0, "low"), ("m2", 1, 10.0, 20.0, 30.0, "Compressor"), ("m2", 1, 10.0, 34.0, 44.0, "Plate"), ("m2", 1, 300.0, 34.0, 44.0, "P99001"), ("m2", 2, 10.0, 20.0, 30.0, "Plate"), ("m2", 2, 10.0, 34.0, 44.0, "Valve cover")],
    ),
    "steps": ("manual_id string, page int, step int, x double, y double", [("m1", 1, 1, 55.0, 55.0), ("m1", 1, 2, 315.0, 52.0), ("m1", 1, 3, 52.0, 425.0), ("m1", 1, 4, 60.0, 300.0), ("m1", 2, 1, 90.0, 95.0), ("m2", 1, 7, 5.0, 5.0)]),
    "pages": (
        "manual_id string, page int, chars int, images int, drawings int, ratio double",
        [("m1", 1, 0, 0, 4, 0.0), ("m1", 2, 0, 1, 0, 0.0), ("m1", 3, 399, 0, 200, 0.0), ("m1", 4, 400, 0, 200, 0.0), ("m1", 5, 299, 3, 0, 0.0), ("m1", 6, 300, 3, 0, 0.0), ("m1", 7, 79, 1, 0, 0.0), ("m1", 8, 80, 1, 0, 0.0), ("m1", 9, 79, 0, 20, 0.0), ("m1", 10, 500, 0, 0, 0.3), ("m1", 11, 300, 0, 150, 0.0), ("m1", 12, 1200, 0, 150, 0.0), ("m1", 13, 1201, 0, 150, 0.0), ("m1", 14, 0, 0, 5, 0.0), ("m1", 15, 1300, 0, 10, 0.25), ("m2", 1, 0, 0, 4, 0.0), ("m2", 2, 700, 0, 160, 0.0), ("m2", 3, 700, 0, 160, 0.0)],
    ),
    "bands": (
        "manual_id string, page int, header string, footer string, drawings int",
        [
            ("q", 1, "Rotor", "Please quote Procedure 902-1.3 Edition 07M when writing", 0), ("q", 2, "Rotor", "Please quote Procedure 902-1.4 Edition 07M when writing", 3), ("q", 3, None, "Please quote Data D90310 Edition 08 when writing", 0),
            ("s", 1, "Section 4.2.1 Rev C   Pump", None, 0), ("s", 2, "Section 4.2.2 Rev C   Wheel", "Page 2", 0), ("s", 3, "Section 4.3.1 Rev. D", None, 0),
            ("n", 14, "Some loose words", "Page 14", 0), ("n", 15, "More loose words", "Page 15", 0),
            ("d", 1, "Chapter 7 Cooling", "Drawing DWG-4471", 9), ("d", 2, "Cooling", None, 0),
            ("c", 1, "301-1 Pump", "301-2", 0), ("c", 2, "302-1.1", None, 0),
        ],
    ),
    "answers": (
        "manual_id string, pattern string, revision_field string, granularity string, word string",
        [("q", "[0-9]{3}-[0-9]+(?:\\.[0-9]+)?", "edition", None, "Procedure"), ("n", "[0-9", None, None, None), ("c", "X[0-9]+", None, None, None), ("s", "[0-9]+\\.[0-9]+\\.[0-9]+", "revision", "per_document", "Section")],
    ),
    "texts": (
        "manual_id string, page int, text string",
        [
            ("q", 1, "902-1.1 is above\nPlease quote Procedure 902-1.3 Edition 07M when writing"), ("q", 2, "Nothing to quote but 903-2"), ("q", 3, "no code"), ("s", 1, "Section 4.2.1 Rev C\nRefer to Section 7.1.0 for the wheel"), ("s", 2, "Page 88 (120)"),
            ("d", 1, "See drawing DWG-4471 and see DWG-4472"), ("n", 14, "words\nPage 14"), ("n", 15, None),
        ],
    ),
    "bookmarks": (
        "manual_id string, pos int, title string, page int",
        [("m1", 1, "C:\\docs\\901_vol1.pdf", 1), ("m1", 2, "M30101-0249 Valve cover", 2), ("m1", 3, "D30101 Valve cover-Data", 4), ("m1", 4, "a/b/c/d", 5), ("m1", 5, "Chapter 12 Notes.pdf", 6), ("m1", 6, "Checking of the rotor", 6), ("m1", 7, " ", 7), ("m2", 1, "Foreword", 0), ("m2", 2, "Foreword", 3)],
    ),
    "scanned": (
        "manual_id string, page int, text string",
        [
            ("m1", 1, "901 first"), ("m1", 2, "301-1 text\nquote Procedure M30101 Edition 02 49 ."), ("m1", 3, "more"), ("m1", 4, "quote Data D30101 Edition 0S48"), ("m1", 5, "quote Plate P30150 Edition 01"),
            ("m1", 6, "Page 6 (9)"), ("m1", 7, "quote Maintenance Schedules A30101 Edition 03"), ("m2", 1, "x"), ("m2", 2, "P99001"), ("m2", 3, None), ("m2", 4, "end"),
        ],
    ),
    "heads": (
        "manual_id string, page int, x0 double, y0 double, y1 double, text string",
        [("m1", 2, 10.0, 20.0, 30.0, "Checking"), ("m1", 2, 10.0, 34.0, 44.0, "Valve cover"), ("m1", 2, 300.0, 20.0, 30.0, "301-1"), ("m1", 3, 10.0, 20.0, 30.0, "301-2"), ("m1", 3, 10.0, 34.0, 44.0, "Page 3"), ("m1", 4, 10.0, 20.0, 30.0, "Valve cover"), ("m1", 4, 10.0, 34.0, 44.0, "Data"), ("m2", 2, 10.0, 20.0, 30.0, "P99001")],
    ),
    "raws": (
        "id int, text string, answer string",
        [(1, "a\x01b  c\td", '```json\n{"k": 3}\n```'), (2, " Two\nlines ", "none"), (3, "AB-12 c/3", 'x {"k": 4} y'), (4, None, None), (5, "\x02\x03xy", '{"k": "no"}')],
    ),
    "ocr": (
        "manual_id string, page int, panel int, answer string",
        [("m1", 1, 1, "CODE: AB12\nSTEP: 4"), ("m1", 1, 2, "see AB1234-5\n 3. turn"), ("m1", 2, 1, '{"blocks":[{"type":"title","content":" Pump ","bbox":"{\\"l\\":1,\\"t\\":2,\\"r\\":3,\\"b\\":4}"},{"type":"text","content":" "}],"markdown":"# Pump\\nFigure 7"}'), ("m2", 1, 1, '{"markdown":"# Head\\n\\n- one\\n- two\\n\\nwords"}')],
    ),
    "layouts": (
        "manual_id string, layout string",
        [("m1", '{"texts":[{"label":"section_header","text":" A  b ","page":1,"bbox":{"l":1,"t":2,"r":3,"b":4}},{"label":"list_item","text":"x","page":2}],"tables":[{"grid":[[{"text":"y"}]],"page":2}],"pictures":[{"page":1,"caption":"Pump"}]}'), ("m2", "no json")],
    ),
    "keys": ("manual_id string, key string", [("m1", "301-1"), ("m1", "301-2.1"), ("m1", "p.7"), ("m1", None), ("m2", "p.1"), ("m2", "P.2")]),
    "files": (
        "manual_id string, stem string, pdf_title string, author string, first_page string",
        [("f1", "feed_pump-manual", "a.pdf", " Acme ", "Handbook of the FP120AX pump, 45NM max"), ("f2", "__", "Compressor book", None, None), ("f3", "x9", None, "", "6S50MC-C engine")],
    ),
    "toc": (
        "manual_id string, pos int, level int, title string, page int",
        [("m1", 1, 1, "Pump", 10), ("m1", 2, 2, "Valve cover", 10), ("m1", 3, 2, "Rotor", 15), ("m1", 4, 1, "Upkeep", 21), ("m1", 5, 2, "Weekly", 21), ("m1", 6, 2, "Yearly", 24), ("m2", 1, 2, "Foreword", 1), ("m2", 2, 1, "Compressor", 5), ("m2", 3, 2, "Valve cover", 5)],
    ),
    "runs": ("run_id long, manual_id string, status string, started int", [(1, "m1", "failed", 5), (2, "m1", "completed", 9), (3, "m2", "completed", 7), (4, "m2", "running", 9)]),
    "upserts": (
        "manual_id string, path string, title string, edition string, page_end int, seq int",
        [("m1", "Pump/Rotor", None, "A9", 18, 1), ("m1", "Pump/Rotor", "Rotor again", None, 19, 2), ("m1", "Pump/New", "New", "A1", 30, 1), ("m1", "Upkeep", None, None, 26, 1), ("m2", "Pump/Rotor", "Another rotor", "B7", 9, 1)],
    ),
}


class Inline:
    """The tables by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, name: str) -> DataFrame:
        schema, rows = TABLES[name]
        return self.spark.createDataFrame(rows, schema)


def sql(*names: str) -> str:
    """The tables as common table expressions named i_<name>."""
    kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    out = []
    for name in names:
        schema, rows = TABLES[name]
        columns = [c.split() for c in schema.split(", ")]
        lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
        casts = ", ".join(f"{c}::{kinds[k]} AS {c}" for c, k in columns)
        out.append(f"i_{name} AS (SELECT {casts} FROM (VALUES {values}) AS v({', '.join(c for c, _ in columns)}))")
    return ",\n".join(out)
