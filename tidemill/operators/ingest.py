"""Ingest operators: routing of pages, citation conventions, panels, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import carry

# The limits of the routing rules, in the order in which they are tried.
ROUTES = (
    ("skip", "blank", "chars = 0 and images = 0 and drawings < 5"),
    ("ocr", "image only", "chars = 0 and images >= 1"),
    ("ocr", "drawing", "drawings >= 200 and chars < 400"),
    ("ocr", "many images", "images >= 3 and chars < 300"),
    ("ocr", "little text", "chars < 80 and (images >= 1 or drawings >= 20)"),
    ("ocr", "garbled", "ratio > 0.25"),
    ("ambiguous", "text and drawing", "chars between 300 and 1200 and drawings >= 150"),
)


def route_pages(pages: DataFrame, ambiguous: str = config.Settings.ocr_default) -> DataFrame:
    """Route and reason of each page. pages: manual_id, page, chars, images, drawings, and ratio (of control characters) or text.

    What stays ambiguous goes the default way; escalated() gives a service's say.
    """
    if "ratio" not in pages.columns:
        pages = pages.withColumn("ratio", T.control_ratio(F.col("text")))

    def chain(value: int) -> Column:
        return reduce(lambda acc, r: acc.when(F.expr(r[2]), r[value]), ROUTES[1:], F.when(F.expr(ROUTES[0][2]), ROUTES[0][value]))

    rows = pages.withColumn("first", chain(0).otherwise("text")).withColumn("reason", chain(1).otherwise("text layer"))
    return rows.select("manual_id", "page", F.when(F.col("first") == "ambiguous", ambiguous).otherwise(F.col("first")).alias("route"), "reason")


def escalated(routed: DataFrame, answers: DataFrame, most: int = config.Settings.router_escalations) -> DataFrame:
    """A service's routes for the first ambiguous pages of each manual; all other pages as they are. answers: manual_id, page, said."""
    unsure = F.col("reason") == "text and drawing"
    counted = carry.running_sum(routed, ["manual_id"], ["page"], {"nth": unsure.cast("int")})
    rows = counted.withColumn("asked", unsure & (F.col("nth") <= most)).join(answers.where("said in ('text', 'ocr')"), ["manual_id", "page"], "left")
    return rows.select("manual_id", "page", F.when(F.col("asked"), F.coalesce("said", "route")).otherwise(F.col("route")).alias("route"), "reason")


SECTION_COLUMNS = ("title", "page_start", "page_end", "doc_code", "edition", "kind", "procedure_no", "plate_no", "component_title", "action_title")


def upsert_sections(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming over existing by manual and path: the last value given wins, an old one stays where none is; and the path of the parent, which is one step shorter, where there is one.

    An aggregate, not an upsert row by row. A column that incoming lacks stays as it is.
    """
    none = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast(dict(existing.dtypes).get(c, "string")).alias(c)
    rows = existing.select("manual_id", "path", *[none(existing, c) for c in SECTION_COLUMNS], F.lit(0).alias("seq"))
    rows = rows.unionByName(incoming.select("manual_id", "path", *[none(incoming, c) for c in SECTION_COLUMNS], "seq"))
    out = rows.groupBy("manual_id", "path").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SECTION_COLUMNS])
    up = out.select("manual_id", F.col("path").alias("parent_path"))
    return out.withColumn("parent_path", F.regexp_replace("path", "/?[^/]*$", "")).join(up.withColumn("there", F.lit(True)), ["manual_id", "parent_path"], "left").withColumn("parent_path", F.when(F.col("there"), F.col("parent_path"))).drop("there")


def upsert_fleet(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By equipment and manual, incoming rows replace manufacturer, model and status."""
    cols = ("manufacturer", "model", "status")
    new = incoming.select("equipment_id", "manual_id", *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("new"))
    both = existing.join(new, ["equipment_id", "manual_id"], "full")
    return both.select("equipment_id", "manual_id", *[F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def fleet_context(fleet: DataFrame, manuals: DataFrame) -> DataFrame:
    """The current fleet row of each manual with its title."""
    return fleet.where("status = 'current'").join(manuals.select("manual_id", "title"), "manual_id").groupBy("manual_id").agg(F.min(F.struct("equipment_id", "model", "title")).alias("x")).select("manual_id", "x.*")


def plate_pages(sections: DataFrame, elements: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Pages of plate sections, and pages whose own meta names a plate, that hold no plate or figure element yet. meta: manual_id, page, plate_no."""
    pages = sections.where("kind = 'plate'").select("manual_id", "section_id", "plate_no", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    if meta is not None:
        more = meta.where("plate_no is not null").select("manual_id", F.lit(None).cast("long").alias("section_id"), "plate_no", "page")
        pages = pages.unionByName(more).groupBy("manual_id", "page").agg(F.max("section_id").alias("section_id"), F.max("plate_no").alias("plate_no"))
    return pages.join(elements.where("type in ('plate', 'figure')").select("manual_id", "page").distinct(), ["manual_id", "page"], "left_anti")


def section_catalog(sections: DataFrame, limit: int = 280) -> DataFrame:
    """Sections in order of page (without one last), then path."""
    return sections.orderBy(F.asc_nulls_last("page_start"), "path", "section_id").limit(limit)


def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


_BOX = "manual_id string, page int, panel int, x0 double, y0 double, x1 double, y1 double"


def panel_boxes(rects: DataFrame) -> DataFrame:
    """Panels of a page: rectangles of 2 to 40 % of it and sides of 50 at least; one that lies 70 % in a larger kept one goes; reading order.

    Keeping depends on what was kept before, so each page, which has few rectangles, is worked through in pandas.
    rects: manual_id, page, x0, y0, x1, y1, width, height (of the page).
    """

    def pick(pdf):
        import pandas as pd

        area = (pdf.x1 - pdf.x0) * (pdf.y1 - pdf.y0)
        share = area / (pdf.width * pdf.height)
        pdf = pdf[(share >= 0.02) & (share <= 0.4) & (pdf.x1 - pdf.x0 >= 50) & (pdf.y1 - pdf.y0 >= 50)].assign(area=area).sort_values(["area", "y0", "x0"], ascending=[False, True, True], kind="stable")
        kept: list = []
        for r in pdf.itertuples():
            inside = [max(0.0, min(r.x1, k.x1) - max(r.x0, k.x0)) * max(0.0, min(r.y1, k.y1) - max(r.y0, k.y0)) for k in kept]
            if all(i < 0.7 * r.area for i in inside):
                kept.append(r)
        kept.sort(key=lambda r: (round(r.y0 / 20), r.x0, r.y0))
        return pd.DataFrame([(r.manual_id, r.page, n, round(r.x0, 2), round(r.y0, 2), round(r.x1, 2), round(r.y1, 2)) for n, r in enumerate(kept)], columns=["manual_id", "page", "panel", "x0", "y0", "x1", "y1"])

    return rects.groupBy("manual_id", "page").applyInPandas(pick, _BOX)


def panel_codes(panels: DataFrame, labels: DataFrame) -> DataFrame:
    """One drawing code a panel, one panel a code: pairs by inside first, then distance. labels: manual_id, page, code, x, y."""
    pairs = panels.join(labels, ["manual_id", "page"])

    def match(pdf):
        import pandas as pd

        inside = (pdf.x >= pdf.x0 - 5) & (pdf.x <= pdf.x1 + 5) & (pdf.y >= pdf.y0 - 5) & (pdf.y <= pdf.y1 + 5)
        far = ((pdf.x - (pdf.x0 + pdf.x1) / 2) ** 2 + (pdf.y - (pdf.y0 + pdf.y1) / 2) ** 2) ** 0.5
        pdf = pdf.assign(late=(~inside).astype(int), far=far).sort_values(["late", "far", "panel", "code"], kind="stable")
        panels_done, codes_done, out = set(), set(), []
        for r in pdf.itertuples():
            if r.panel not in panels_done and r.code not in codes_done:
                panels_done.add(r.panel)
                codes_done.add(r.code)
                out.append((r.manual_id, r.page, r.panel, r.code))
        return pd.DataFrame(out, columns=["manual_id", "page", "panel", "code"])

    return pairs.groupBy("manual_id", "page").applyInPandas(match, "manual_id string, page int, panel int, code string")


def layout_elements(pages: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """A layout service's answer as typed elements: texts, tables and pictures, with their boxes. pages: manual_id, layout.

    The answer is {"texts": [{"label", "text", "page", "bbox"}], "tables": [{"grid", "page", "bbox"}], "pictures": [{"page", "bbox", "caption"}]}.
    Where only some pages were sent, its page numbers are places among these; selected (manual_id, nth, page) turns them back.
    """
    from .pages import boxes_of

    parsed = F.from_json("layout", "texts array<struct<label:string,text:string,page:int,bbox:string>>, tables array<struct<grid:array<array<struct<text:string>>>,page:int,bbox:string>>, pictures array<struct<page:int,bbox:string,caption:string>>")
    p = pages.select("manual_id", parsed.alias("p"))
    kind = F.when(F.col("t.label") == "section_header", "heading").when(F.col("t.label") == "list_item", "list").when(F.col("t.label") == "caption", "caption").otherwise("paragraph")
    none = F.lit(None).cast("string")

    def part(name: str, kind: Column, text: Column, table: Column) -> DataFrame:
        rows = p.select("manual_id", F.explode(f"p.{name}").alias("t"))
        return rows.select("manual_id", kind.alias("type"), F.col("t.page").alias("page"), text.alias("text"), table.alias("table_json"), boxes_of(F.col("t.bbox")).alias("bbox"))

    out = part("texts", kind, T.squeezed(F.col("t.text")), none).unionByName(part("tables", F.lit("table"), none, F.to_json(F.struct(F.col("t.grid").alias("grid")))))
    out = out.unionByName(part("pictures", F.lit("figure"), T.squeezed(F.col("t.caption")), none))
    if selected is None:
        return out
    return out.withColumnRenamed("page", "nth").join(selected.select("manual_id", "nth", "page"), ["manual_id", "nth"]).select("manual_id", "type", "page", "text", "table_json", "bbox")


def panel_ocr(answers: DataFrame) -> DataFrame:
    """CODE and STEP lines of a panel's OCR answer, else patterns anywhere in it. answers: manual_id, page, panel, answer."""
    tagged = lambda tag: F.nullif(F.trim(F.regexp_extract("answer", rf"(?im)^{tag}: *(.*)$", 1)), F.lit(""))
    code = F.coalesce(tagged("CODE"), F.nullif(F.regexp_extract("answer", f"({config.DRAWING_PATTERN})", 1), F.lit("")))
    step = F.coalesce(tagged("STEP"), F.nullif(F.regexp_extract("answer", r"(?:^|\n) *([0-9]{1,2})\.", 1), F.lit("")))
    return answers.select("manual_id", "page", "panel", code.alias("code"), F.nullif(F.regexp_extract(step, "([0-9]+)", 1), F.lit("")).cast("int").alias("step"))


def panel_steps(panels: DataFrame, labels: DataFrame, slack: float = 40.0) -> DataFrame:
    """The step label nearest to a panel's top left corner (dy + 0.1 dx) within the slack. labels: manual_id, page, step, x, y."""
    near = (F.abs(F.col("y") - F.col("y0")) + 0.1 * F.abs(F.col("x") - F.col("x0"))).alias("far")
    rows = panels.join(labels, ["manual_id", "page"]).where((F.col("x") >= F.col("x0") - slack) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0") - slack) & (F.col("y") <= F.col("y1")))
    return rows.groupBy("manual_id", "page", "panel").agg(F.min_by("step", F.struct(near, "step")).alias("step"))


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def citation_backfill(elements: DataFrame) -> DataFrame:
    """Key of elements without one: procedure, plate, else page; and the fields that are there as JSON."""
    own = [T.blank_to_null(F.col(c)) for c in ("citation_key", "procedure_no", "plate_no", "doc_code") if c in elements.columns]
    key = F.coalesce(*own, F.concat(F.lit("p."), F.col("page").cast("string")))
    return elements.select("element_id", key.alias("citation_key"), F.to_json(F.struct("procedure_no", "plate_no", "edition")).alias("fields"))


def placed_elements(parsed: DataFrame, sections: DataFrame) -> DataFrame:
    """Parsed elements with their page's most specific section, its numbers, and the step of their text where none is given."""
    from .graph import page_to_section

    own = page_to_section(parsed.select("manual_id", "page").distinct(), sections)
    numbers = sections.select("section_id", F.col("procedure_no").alias("p"), F.col("plate_no").alias("l"))
    rows = parsed.drop("section_id").join(own, ["manual_id", "page"], "left").join(numbers, "section_id", "left")
    return rows.select("element_id", "section_id", F.coalesce("procedure_no", "p").alias("procedure_no"), F.coalesce("plate_no", "l").alias("plate_no"), F.coalesce("step", T.leading_step(F.col("text"))).alias("step"))


def diagram_panels(rects: DataFrame, labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Panels of each page with their drawing code and step: manual_id, page, panel, box, code, step."""
    boxes = panel_boxes(rects)
    key = ["manual_id", "page", "panel"]
    rows = boxes.join(panel_codes(boxes, labels), key, "left").join(panel_steps(boxes, steps), key, "left")
    return rows.select(*key, F.array("x0", "y0", "x1", "y1").alias("bbox"), "code", "step")


def split_pages(pages: DataFrame, panels: DataFrame, most: int = 8) -> DataFrame:
    """Pages with the number of their panels, and whether the split is messy: none, or more than ``most``."""
    n = panels.groupBy("manual_id", "page").agg(F.count("*").cast("int").alias("panels"))
    return pages.join(n, ["manual_id", "page"], "left").withColumn("panels", F.coalesce("panels", F.lit(0))).withColumn("messy", (F.col("panels") == 0) | (F.col("panels") > most))


def diagram_modes(pages: DataFrame, panels: DataFrame, backend: str = "skip") -> DataFrame:
    """How each diagram page is read: a plate and a messy split as a whole page, else panel by panel. pages: manual_id, page, plate_no.

    A page service reads only whole pages, so clean splits are attached to its answer afterwards.
    """
    rows = split_pages(pages, panels.join(pages.where("plate_no is not null").select("manual_id", "page"), ["manual_id", "page"], "left_anti"))
    mode = F.when(F.col("plate_no").isNotNull(), "whole page, plate").when(F.col("messy"), "whole page").otherwise("panels")
    return rows.select("manual_id", "page", "panels", mode.alias("mode"), F.when((mode == "panels") & (F.lit(backend) != "page service"), "panels").otherwise(backend).alias("reader"))


def panel_caption(component: Column, action: Column, step: Column, code: Column, panel: Column, page: Column) -> Column:
    """Titles of the page, step and drawing code, as far as there are any; else the panel's place."""
    parts = F.concat_ws(" - ", component, action, F.when(step.isNotNull(), F.concat(F.lit("step "), step.cast("string"))), code)
    return F.when(parts != "", parts).otherwise(F.concat(F.lit("Panel "), panel.cast("string"), F.lit(" on page "), page.cast("string")))


_FIGURE = ["manual_id", "page", "type", "text", "caption", "figure_ref", "panel", "code", "step"]


def _panel_figures(panels: DataFrame, meta: DataFrame) -> DataFrame:
    titles = meta.select("manual_id", "page", "component_title", "action_title")
    rows = panels.join(titles, ["manual_id", "page"], "left")
    named = panel_caption(F.col("component_title"), F.col("action_title"), F.col("step"), F.col("code"), F.col("panel"), F.col("page"))
    ref = F.coalesce("code", F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit("-panel-"), F.col("panel").cast("string")))
    text = F.col("answer") if "answer" in panels.columns else F.lit(None).cast("string")
    return rows.select("manual_id", "page", F.lit("figure").alias("type"), text.alias("text"), named.alias("caption"), ref.alias("figure_ref"), "panel", "code", "step")


def panel_page_elements(modes: DataFrame, panels: DataFrame, meta: DataFrame, texts: DataFrame, answers: DataFrame) -> DataFrame:
    """Elements of pages that are read panel by panel: the page's own text, if it has 40 characters, and a figure a panel.

    The panel's code and step win over those that OCR read. texts: manual_id, page, text; answers: manual_id, page, panel, answer.
    """
    pages = modes.where("mode = 'panels'").select("manual_id", "page")
    own = texts.join(pages, ["manual_id", "page"], "left_semi").select("manual_id", "page", F.trim("text").alias("t")).where(F.char_length("t") >= 40)
    none = F.lit(None).cast("string")
    layer = own.select("manual_id", "page", F.lit("paragraph").alias("type"), F.substring("t", 1, 4000).alias("text"), none.alias("caption"), none.alias("figure_ref"), F.lit(None).cast("int").alias("panel"), none.alias("code"), F.lit(None).cast("int").alias("step"))
    read = panel_ocr(answers).select("manual_id", "page", "panel", F.col("code").alias("read_code"), F.col("step").alias("read_step")).join(answers, ["manual_id", "page", "panel"])
    rows = panels.join(pages, ["manual_id", "page"], "left_semi").join(read, ["manual_id", "page", "panel"], "left")
    rows = rows.withColumn("code", F.coalesce("code", "read_code")).withColumn("step", F.coalesce("step", "read_step"))
    return layer.unionByName(_panel_figures(rows, meta))


def skipped_pages(modes: DataFrame) -> DataFrame:
    """Without a service, a whole page is one figure named after it."""
    name = F.concat(F.lit("page-"), F.col("page").cast("string"))
    none = F.lit(None).cast("string")
    return modes.where("mode <> 'panels'").select("manual_id", "page", F.lit("figure").alias("type"), none.alias("text"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("caption"), name.alias("figure_ref"), F.lit(None).cast("int").alias("panel"), none.alias("code"), F.lit(None).cast("int").alias("step"))


def diagram_elements(pages: DataFrame, panels: DataFrame, meta: DataFrame, texts: DataFrame, answers: DataFrame) -> DataFrame:
    """All diagram pages without a page service: panel by panel where the split is clean, else as one figure."""
    modes = diagram_modes(pages, panels)
    return panel_page_elements(modes, panels, meta, texts, answers).unionByName(skipped_pages(modes))


def attach_panels(elements: DataFrame, panels: DataFrame, meta: DataFrame) -> DataFrame:
    """On text pages with a clean split that are no plates, the panels stand for the figures and plates found there. elements: the columns of diagram_elements."""
    pages = elements.select("manual_id", "page").distinct().join(meta.where("plate_no is not null").select("manual_id", "page"), ["manual_id", "page"], "left_anti")
    clean = split_pages(pages, panels).where("not messy").select("manual_id", "page")
    gone = clean.withColumn("type", F.explode(F.array(F.lit("figure"), F.lit("plate"))))
    kept = elements.join(gone, ["manual_id", "page", "type"], "left_anti").select(_FIGURE)
    return kept.unionByName(_panel_figures(panels.join(clean, ["manual_id", "page"], "left_semi"), meta))


def plate_caption(component: Column, plate: Column) -> Column:
    """A plate's caption: its title and number, else its number alone."""
    return F.concat_ws(" - ", T.blank_to_null(component), T.blank_to_null(plate))


def completed_plates(missing: DataFrame, sections: DataFrame) -> DataFrame:
    """One plate element for each page that plate_pages found, with its key always there."""
    titles = sections.select("section_id", "component_title", "edition")
    rows = missing.join(titles, "section_id", "left")
    key = F.coalesce("plate_no", F.concat(F.lit("p."), F.col("page").cast("string")))
    return rows.select("manual_id", "section_id", "page", F.lit("plate").alias("type"), F.coalesce(T.blank_to_null(plate_caption(F.col("component_title"), F.col("plate_no"))), F.concat(F.lit("Plate on page "), F.col("page").cast("string"))).alias("text"), "plate_no", "edition", key.alias("citation_key"))


def upsert_figures(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By manual, page and image: an incoming value wins where there is one."""
    key = ["manual_id", "page", "image"]
    cols = [c for c in existing.columns if c not in key]
    rows = existing.withColumn("seq", F.lit(0)).unionByName(incoming.withColumn("seq", F.lit(1)))
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in cols]).select(existing.columns)


def filled_steps(elements: DataFrame, links: DataFrame, figures: DataFrame) -> DataFrame:
    """Elements with the step of the panel that illustrates them, where they have none of their own. links: from_id (the panel's element), to_id."""
    own = figures.where("element_id is not null and step is not null").select(F.col("element_id").alias("from_id"), F.col("step").alias("panel_step"))
    given = links.where("type = 'illustrates_step'").join(own, "from_id").groupBy(F.col("to_id").alias("element_id")).agg(F.min("panel_step").alias("panel_step"))
    return elements.join(given, "element_id", "left").withColumn("step", F.coalesce("step", "panel_step")).drop("panel_step")


def corpus_status(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """One row: the size of each table, whether there is any data, and the latest run."""
    counts = corpus_counts(tables).groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in tables], F.sum("n").alias("rows"))
    last = runs.groupBy().agg(F.max_by(F.struct("run_id", "manual_id", "status"), F.struct("started", "run_id")).alias("last"))
    return counts.crossJoin(last).select(*tables, (F.col("rows") > 0).alias("has_data"), "last.*")  # one row each
