"""Sections, ranges and the typed cross-reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import carry
from .retrieve import top


def page_to_section(pages: DataFrame, sections: DataFrame, width: int = 64) -> DataFrame:
    """Range join: each page's most specific section (deepest path, narrowest span, smallest id).

    Spans are cut into bins of ``width`` pages, so the join is an equality on manual and bin.
    """
    depth = F.size(F.split("path", "/"))
    binned = sections.select("manual_id", "section_id", "page_start", "page_end", depth.alias("depth"), F.explode(F.sequence(F.floor(F.col("page_start") / width), F.floor(F.col("page_end") / width))).alias("bin"))
    rows = pages.withColumn("bin", F.floor(F.col("page") / width)).join(binned, ["manual_id", "bin"]).where("page between page_start and page_end")
    return top(rows, ["manual_id", "page"], [F.desc("depth"), F.col("page_end") - F.col("page_start"), "section_id"], 1).select("manual_id", "page", "section_id")


def chapter_asof(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """As-of join: the last chapter whose first page is not after the row's page. rows: manual_id, page; chapters: manual_id, page, chapter."""
    return carry.asof(rows.select("manual_id", "page"), chapters, ["manual_id"], "page", "page", ["chapter"])


def toc_chapters(toc: DataFrame) -> DataFrame:
    """Bookmarks with the chapter (level 1) they stand under: carried forward in order, manual by manual."""
    return carry.last_known(toc, ["manual_id"], ["pos"], {"chapter": F.when(F.col("level") == 1, F.col("title"))})


def section_ends(starts: DataFrame, page_count: Column) -> DataFrame:
    """page_end: the page before the next greater start in the manual, else the last page. starts: manual_id, page_start and more."""
    once = starts.select("manual_id", "page_start").where("page_start is not null").distinct()
    later = carry.last_known(once, ["manual_id"], [F.desc("page_start")], {"later": F.col("page_start")}, own=False)
    later = later.select(F.col("manual_id").alias("_manual"), F.col("page_start").alias("_start"), F.col("later").alias("_later"))
    rows = starts.join(later, F.col("manual_id").eqNullSafe(F.col("_manual")) & (F.col("page_start") == F.col("_start")), "left")
    return rows.withColumn("page_end", F.coalesce(F.col("_later") - 1, page_count)).drop("_manual", "_start", "_later")


def unique_sections(sections: DataFrame) -> DataFrame:
    """One row a path: the first edition and code that are there, the last page."""
    at = F.col("page_start")
    return sections.groupBy("manual_id", "path").agg(F.min("section_id").alias("section_id"), F.min_by("edition", F.when(F.col("edition").isNotNull(), at)).alias("edition"), F.min_by("doc_code", F.when(F.col("doc_code").isNotNull(), at)).alias("doc_code"), F.max("page_end").alias("page_end"))


def parents(sections: DataFrame) -> DataFrame:
    """The section whose path is one step shorter."""
    up = F.regexp_replace("path", "/?[^/]*$", "")
    own = sections.select("manual_id", "section_id", up.alias("up"))
    return own.join(sections.select("manual_id", F.col("path").alias("up"), F.col("section_id").alias("parent_id")), ["manual_id", "up"], "left").select("section_id", "parent_id")


def describes_by_title(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Data elements describe one element of the procedure of the same component: checking first, then the longest text."""
    key = F.trim(F.lower(F.col("component_title")))
    data = sections.where("kind = 'data'").select("manual_id", key.alias("key"), "section_id").join(elements.select("section_id", F.col("element_id").alias("from_id")), "section_id").drop("section_id")
    proc = sections.where("kind = 'procedure'").select("manual_id", key.alias("key"), "section_id", (F.lower("action_title") == "checking").alias("checking")).join(elements.select("section_id", F.col("element_id").alias("to_id"), F.char_length("text").alias("n")), "section_id").drop("section_id")
    best = top(proc, ["manual_id", "key"], [F.desc_nulls_last("checking"), F.desc_nulls_last("n"), "to_id"], 1)
    return data.join(best, ["manual_id", "key"]).select("from_id", "to_id", F.lit("describes").alias("type"))


def first_elements(elements: DataFrame) -> DataFrame:
    """The first element of each section, by page and id."""
    return elements.where("section_id is not null").groupBy("section_id").agg(F.min_by("element_id", F.struct("page", "element_id")).alias("element_id"))


def plates_by_code(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Plates illustrate the first procedure section of the same code tail, else of the same chapter family."""
    first = first_elements(elements)
    s = sections.join(first, "section_id").select("manual_id", "section_id", "kind", "element_id", T.code_tail(F.col("doc_code")).alias("tail"), T.chapter_family(F.col("doc_code")).alias("family"))
    plate = s.where("kind = 'plate'").select("manual_id", F.col("element_id").alias("from_id"), F.col("tail").alias("ptail"), F.col("family").alias("pfamily"))
    proc = s.where("kind = 'procedure'")
    proc = proc.withColumnRenamed("manual_id", "own")
    # of the procedures of a code only the first is met by its plates
    first = lambda code: top(proc.where(F.col(code).isNotNull()), ["own", code], ["section_id"], 1)
    tail, family = (plate.join(first(b), (F.col("manual_id") == F.col("own")) & (F.col(a) == F.col(b))) for a, b in (("ptail", "tail"), ("pfamily", "family")))
    pairs = tail.unionByName(family)
    best = top(pairs, ["from_id"], [F.when(F.col("ptail") == F.col("tail"), 0).otherwise(1), "section_id"], 1)
    return best.select("from_id", F.col("element_id").alias("to_id"), F.lit("illustrates").alias("type"))


def own_data(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Texts that say "see data" without a number point at the first element of their component's data sheet."""
    bare = r"(?i)(?:^|[^a-z])(?:see|refer to|as per|according to|acc\. to) +(?:the +)?data(?: sheet)?[ .,;)]*(?:$|[a-z(]|\n)"
    key = F.trim(F.lower("component_title"))
    said = elements.where(F.col("text").rlike(bare)).select("element_id", "section_id").join(sections.select("section_id", "manual_id", key.alias("key")), "section_id")
    sheets = sections.where("kind = 'data'").select("section_id", "manual_id", key.alias("key")).join(first_elements(elements), "section_id").join(elements.select("element_id", "page"), "element_id")
    first = sheets.groupBy("manual_id", "key").agg(F.min_by("element_id", F.struct("page", "element_id")).alias("to_id"))
    rows = said.select("manual_id", "key", F.col("element_id").alias("from_id")).join(first, ["manual_id", "key"])
    return rows.where("from_id <> to_id").select("from_id", "to_id", F.lit("references_data").alias("type"))


def _first_targets(targets: DataFrame) -> DataFrame:
    """Of each reference the targets that a text can still take: of the first two keys and of each the first two data targets and others, as one may be the text itself.

    So a number that many sections carry is not multiplied by the texts that refer to it. targets: manual_id, ref, key, kind, to_id.
    """
    w = Window.partitionBy("manual_id", "ref", "key", F.col("kind") == "data").orderBy("to_id")
    rows = targets.withColumn("rn", F.dense_rank().over(w)).where("rn <= 2")
    return rows.withColumn("rn", F.dense_rank().over(Window.partitionBy("manual_id", "ref").orderBy("key"))).where("rn <= 2").drop("rn")


def cross_references(elements: DataFrame, sections: DataFrame, conventions: DataFrame | None = None) -> DataFrame:
    """Edges from texts that refer to a number: "see", "refer to", "as per" and the like, then words, then the number; with conventions, also to what a manual's own words and pattern name."""
    verb = r"(?i)(?:see|refer to|as per|according to|acc\. to) +(?:the +)?(?:data|section|plate|procedure|sheet)? *"
    number = rf"({config.PROCEDURE_PATTERN}|{config.PLATE_PATTERN}|{config.DOC_CODE_PATTERN})"
    also = rf"(?i)(?:and|or) +(?:data|section|plate) +{number}"
    hits = F.concat(F.regexp_extract_all("text", F.lit(verb + number), F.lit(1)), F.regexp_extract_all("text", F.lit(also), F.lit(1)))
    refs = elements.select("manual_id", F.col("element_id").alias("from_id"), F.lower("text").alias("low"), F.explode(F.array_distinct(hits)).alias("ref")).withColumn("ref", F.upper("ref"))
    if conventions is not None:
        from .conventions import references

        more = references(elements, conventions).select("manual_id", F.col("element_id").alias("from_id"), F.lower(F.concat_ws(" ", "label", "ref")).alias("low"), "ref")
        refs = refs.unionByName(more.select(refs.columns)).groupBy("manual_id", "from_id", "ref").agg(F.max("low").alias("low"))
    refs = refs.withColumn("as_data", F.col("low").contains(F.concat(F.lit("data "), F.lower("ref"))))
    keys = sections.select("manual_id", "section_id", "kind", F.explode(F.array_distinct(F.filter(F.array("procedure_no", "plate_no", "doc_code"), lambda c: c.isNotNull()))).alias("ref"))
    targets = keys.join(first_elements(elements), "section_id").withColumnRenamed("element_id", "to_id")
    exact = refs.join(_first_targets(targets.withColumn("key", F.col("ref"))), ["manual_id", "ref"])
    # a reference without a target of its own: the first key that goes on after a dot
    begins = targets.withColumn("key", F.col("ref")).where(F.col("ref").contains(".")).withColumn("ref", F.regexp_replace("ref", r"\.[^.]*$", ""))
    longer = refs.join(targets.select("manual_id", "ref").distinct(), ["manual_id", "ref"], "left_anti").join(_first_targets(begins), ["manual_id", "ref"])
    rows = exact.unionByName(longer.select(exact.columns)).where("from_id <> to_id")
    best = top(rows, ["from_id", "ref"], ["key", F.when(F.col("as_data") == (F.col("kind") == "data"), 0).otherwise(1), "to_id"], 1)
    kind = F.when(F.col("kind") == "data", "references_data").when(F.col("kind") == "procedure", "references_section").otherwise("cross_ref")
    return best.select("from_id", "to_id", kind.alias("type")).unionByName(own_data(elements, sections)).distinct()


def step_links(elements: DataFrame, figures: DataFrame) -> DataFrame:
    """Panels with a step illustrate the text of that step on their page: the first with a line that begins with the number, else the longest there."""
    panels = figures.where("step is not null and element_id is not null").select("manual_id", "page", F.col("element_id").alias("from_id"), F.col("step").alias("wanted"))
    texts = elements.where("type not in ('figure', 'plate') and text is not null").select("manual_id", "page", F.col("element_id").alias("to_id"), T.control_to_dash(F.col("text")).alias("lines"), F.char_length("text").alias("n"))
    rows = panels.join(texts, ["manual_id", "page"]).withColumn("tier", F.when(F.expr(r"lines rlike concat('(^|\\n)[ \\t]*', wanted, '[.][ \\t\\n]')"), 0).otherwise(1))
    best = top(rows, ["from_id"], ["tier", F.when(F.col("tier") == 0, F.col("to_id")), F.desc("n"), "to_id"], 1)
    return best.select("from_id", "to_id", F.lit("illustrates_step").alias("type"))


def new_edges(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges to insert: each once, none that is there."""
    key = ["from_id", "to_id", "type"]
    return fresh.select(*key).distinct().join(existing.select(*key), key, "left_anti")


def hop(hits: DataFrame, edges: DataFrame, elements: DataFrame, kinds: tuple[str, ...], k: int, score: float) -> DataFrame:
    """One hop along edges from hits to elements not among the question's hits; the longest texts, k a question."""
    rows = hits.select("query_id", F.col("element_id").alias("from_id")).join(edges.where(F.col("type").isin(*kinds)).select("from_id", "to_id").distinct(), "from_id")
    rows = rows.select("query_id", F.col("to_id").alias("element_id")).distinct().join(hits.select("query_id", "element_id"), ["query_id", "element_id"], "left_anti")
    rows = rows.join(elements.select("element_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")), "element_id")
    return top(rows, ["query_id"], [F.desc("n"), "element_id"], k).select("query_id", "element_id", F.lit(score).alias("score"))


def reverse_hop(hits: DataFrame, edges: DataFrame, elements: DataFrame, kind: str, k: int, score: float) -> DataFrame:
    """The other way: what points at the hits by one type of edge."""
    turned = edges.where(F.col("type") == kind).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type")
    return hop(hits, turned, elements, (kind,), k, score)
