"""The registered queries over the given tables, each whole, and the rules that only the small corpus has the data for, which tests run."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import clauses, conventions, gate, graph, ingest, pages, rank, retrieve, textindex
from ..sources import inline, project
from . import engine, ordered, written
from .projected import PROJECTED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = written.QUERIES | ordered.QUERIES


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _volume(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = project.load(spark, d, "documents")
    return project.sections(docs), project.elements(docs), project.questions(project.load(spark, d, "conversations"))


def _small(t: Tables, *names: str) -> list[DataFrame]:
    return [t(n) for n in names]


@query
def lexical_or_topk(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.lexical_or(e, q)


@query
def project_sections(spark: SparkSession, d: str) -> DataFrame:
    return _volume(spark, d)[0].withColumn("path", F.array_join("path", "/"))


@query
def project_elements(spark: SparkSession, d: str) -> DataFrame:
    return _volume(spark, d)[1]


@query
def lexical_and_topk(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.lexical_and(e, q)


@query
def lexical_and_passages(spark: SparkSession, d: str) -> DataFrame:
    """No line holds all terms of a whole user turn; lines that quote a passage hold all of its."""
    return retrieve.lexical_and(_volume(spark, d)[1], project.passages(project.load(spark, d, "benchmark")))


@query
def lexical_bm25(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.bm25(e, q)


@query
def phrase_probe(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.phrase_probe(e, q)


@query
def overlap_probe(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.overlap_probe(e, q)


@query
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    _, e, q = _volume(spark, d)
    return retrieve.rrf([retrieve.lexical_or(e, q), retrieve.overlap_probe(e, q).select("query_id", "element_id", F.col("hits").cast("double").alias("score"))])


def _indexed(spark: SparkSession, d: str) -> tuple[textindex.TextIndex, DataFrame]:
    """An index over all lines, without positions, which no query here asks for, and all questions."""
    _, e, q = _volume(spark, d)
    return textindex.build(e, textindex.LEAN), q


@query
def fulltext_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d)[0].vocabulary


@query
def fulltext_or_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fulltext_or(*_indexed(spark, d))


@query
def fulltext_and_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fulltext_and(_indexed(spark, d)[0], project.passages(project.load(spark, d, "benchmark")))


@query
def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.fulltext_bm25(*_indexed(spark, d))


@query
def section_catalog(spark: SparkSession, d: str) -> DataFrame:
    s = _volume(spark, d)[0].withColumn("path", F.array_join("path", "/"))
    return ingest.section_catalog(s).select("section_id", "path", "title", "page_start", "page_end")


@query
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    s, e, q = _volume(spark, d)
    return ingest.corpus_counts({"sections": s, "elements": e, "questions": q})


@query
def element_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _volume(spark, d)[1].groupBy("manual_id", "type").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


@query
def page_to_section_volume(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _volume(spark, d)
    return graph.page_to_section(e.select("manual_id", "page").distinct(), s.withColumn("path", F.array_join("path", "/")))


@query
def section_page_end(spark: SparkSession, d: str) -> DataFrame:
    s = _volume(spark, d)[0].select("manual_id", "section_id", "page_start")
    return graph.section_ends(s, F.lit(10**12).cast("long"))


@query
def first_elements(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_elements(_volume(spark, d)[1])


@query
def current_editions_volume(spark: SparkSession, d: str) -> DataFrame:
    return gate.current_editions(_volume(spark, d)[0].withColumn("plate_no", F.lit(None).cast("string")))


@query
def diversify(spark: SparkSession, d: str) -> DataFrame:
    s, e, q = _volume(spark, d)
    return retrieve.diversified(e, s, q)


# rules over the knowledge model
Tables = project.Knowledge | inline.Inline
#: Every rule over tables by name: registered over the projection where that has its tables, tested over the small corpus in any case.
RULES: dict[str, Callable[[Tables], DataFrame]] = {}


def _hit_rule(rule: Callable[[DataFrame, DataFrame], DataFrame], t: Tables) -> DataFrame:
    hits, e, s, q = _small(t, "hits", "elements", "sections", "questions")
    out = rule(rank.candidates(hits, e, s), q)
    return out.select("query_id", "element_id", F.round("score", 6).alias("score"), "pinned")


def _text_functions(t: Tables) -> DataFrame:
    x = F.col("text")
    return t("raws").select("id", T.control_to_dash(x).alias("dashed"), T.squeezed(x).alias("squeezed"), T.code_key(x).alias("code"), F.round(T.control_ratio(x), 6).alias("ratio"), T.json_object(F.col("answer"), "k int")["k"].alias("k"))


def _two(f, *names):
    return lambda t: f(*_small(t, *names))


def _ranked(t: Tables) -> DataFrame:
    hits, e, s = _small(t, "hits", "elements", "sections")
    return rank.in_order(rank.candidates(hits, e, s))


def _knowledge(t: Tables) -> engine.Knowledge:
    return engine.Knowledge(*_small(t, "manuals", "sections", "elements", "figures", "edges"))


def _query_features(t: Tables) -> DataFrame:
    q = t("questions")
    i = q.select("query_id", T.intent(F.col("text")).alias("i"), T.phrases(T.content_tokens(F.col("text"))).alias("p"), T.named_edition(F.col("text")).alias("edition"))
    flags = [F.col(f"i.{f}").alias(f) for f in ("wants_figure", "wants_data", "wants_proc", "wants_decision", "wants_schedule")]
    return i.select("query_id", F.array_join("i.tokens", " ").alias("tokens"), F.array_join("i.component_tokens", " ").alias("component"), F.array_join("i.codes", " ").alias("codes"), F.array_join("p", ";").alias("phrases"), "edition", *flags)


def _element_text(t: Tables) -> DataFrame:
    e = t("elements")
    return e.select("element_id", T.row_text(F.col("text"), F.col("table_json")).alias("text"), T.citation_ref(F.col("plate_no"), F.col("procedure_no"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("edition"), F.col("page")).alias("ref"), T.leading_step(F.col("text")).alias("step"), T.text_key(F.col("text")).alias("key"))


def _section_text(t: Tables) -> DataFrame:
    s = t("sections")
    title = F.concat_ws(" ", "component_title", "action_title")
    return s.select("section_id", T.procedure_stem(F.col("procedure_no")).alias("pstem"), T.component_stem(title).alias("stem"), T.kind_of(F.col("doc_code"), title).alias("kind"), T.chapter_family(F.col("doc_code")).alias("family"), T.code_tail(F.col("doc_code")).alias("tail"), T.edition_key(F.col("edition")).alias("edition"))


def _asof(t: Tables) -> DataFrame:
    e, toc = _small(t, "elements", "toc")
    at = e.select("manual_id", "page").distinct()
    return graph.chapter_asof(at, toc.where("level = 1").select("manual_id", "page", F.col("title").alias("chapter")))


def _gate(t: Tables) -> DataFrame:
    q, hits, e, m = _small(t, "questions", "hits", "elements", "manuals")
    return gate.checks(q, hits, e, m).withColumn("failed", F.array_join("failed", ","))


def _hops(t: Tables) -> DataFrame:
    hits, edges, e = _small(t, "hits", "edges", "elements")
    kinds = ("cross_ref", "references_section", "references_data")
    return graph.hop(hits, edges, e, kinds, config.MAX_HOPS, config.CROSS_REF)


def _panel_hops(t: Tables) -> DataFrame:
    hits, edges, e = _small(t, "hits", "edges", "elements")
    return graph.reverse_hop(hits, edges, e, "illustrates_step", config.MAX_PANELS, config.PANEL)


def _conflicts(t: Tables) -> DataFrame:
    return gate.numeric_conflicts(*_small(t, "hits", "elements")).withColumn("values", F.array_join("values", ","))


def _edges(t: Tables) -> DataFrame:
    fresh, = _small(t, "edges")
    return graph.new_edges(fresh, fresh.where("type = 'describes'"))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, to be compared."""
    return df.select(*[F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c) if c in columns else c for c in df.columns])


def _citations(t: Tables) -> DataFrame:
    return conventions.citations(t("texts"), conventions.detect(t("bands")))


def _replaced(t: Tables) -> DataFrame:
    bands, answers = _small(t, "bands", "answers")
    out = conventions.replaced(conventions.detect(bands), answers.withColumn("label_words", F.array("word")), bands)
    return _joined(out, "label_words")


def _references(t: Tables) -> DataFrame:
    texts = t("texts").withColumn("element_id", F.col("page").cast("long"))
    return conventions.references(texts, conventions.detect(t("bands")))


def _scan(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    scanned, heads, keys = _small(t, "scanned", "heads", "keys")
    return scanned, heads, conventions.from_keys(keys)


def _page_meta(t: Tables) -> DataFrame:
    return pages.page_meta(*_scan(t))


def _extracted(t: Tables) -> DataFrame:
    return pages.extract_sections(t("bookmarks"), *_scan(t))


def _plates(t: Tables) -> DataFrame:
    s, e = _small(t, "sections", "elements")
    meta = _page_meta(t).select("manual_id", "page", "plate_no")
    return ingest.completed_plates(ingest.plate_pages(s, e, meta), s)


def _drafts(t: Tables) -> DataFrame:
    return ingest.diagram_panels(*_small(t, "rects", "labels", "steps"))


def _titles(t: Tables) -> DataFrame:
    """Two titled pages and a plate, beside the panels' pages."""
    return t.spark.createDataFrame([("m1", 1, "Rotor", "Mounting", None), ("m1", 3, "Cover", None, "P30101")], "manual_id string, page int, component_title string, action_title string, plate_no string")


def _diagram_elements(t: Tables) -> DataFrame:
    drafts, meta = _drafts(t), _titles(t)
    asked = t.spark.createDataFrame([("m1", 1, None), ("m1", 2, None), ("m1", 3, "P30101"), ("m2", 1, None)], "manual_id string, page int, plate_no string")
    texts = t.spark.createDataFrame([("m1", 1, " A text of some forty characters or a little more "), ("m1", 2, "short")], "manual_id string, page int, text string")
    answers = t.spark.createDataFrame([("m1", 1, 0, "CODE: XX1-1\nSTEP: 9"), ("m1", 2, 0, "CODE: none\nturn it\n 5. lift")], "manual_id string, page int, panel int, answer string")
    return ingest.diagram_elements(asked, drafts, meta, texts, answers)


def _attached_panels(t: Tables) -> DataFrame:
    kinds = "manual_id string, page int, type string, text string, caption string, figure_ref string, panel int, code string, step int"
    rows = [("m1", 1, "figure", None, "old", "x", None, None, None), ("m1", 1, "paragraph", "stays", None, None, None, None, None), ("m1", 3, "plate", None, "plate", "y", None, None, None), ("m1", 9, "figure", None, "alone", "z", None, None, None)]
    return ingest.attach_panels(t.spark.createDataFrame(rows, kinds), _drafts(t), _titles(t))


def _filled_steps(t: Tables) -> DataFrame:
    e, f = _small(t, "elements", "figures")
    return ingest.filled_steps(e.withColumn("step", F.lit(None).cast("int")), graph.step_links(e, f), f).select("element_id", "step")


def _upsert_figures(t: Tables) -> DataFrame:
    f = t("figures")
    fresh = f.where("figure_id in (2, 4)").withColumn("label", F.when(F.col("figure_id") == 4, "P30299")).withColumn("drawing_code", F.lit("CD1-1")).withColumn("page", F.when(F.col("figure_id") == 4, 22).otherwise(F.col("page")))
    return ingest.upsert_figures(f, fresh)


def _status(t: Tables) -> DataFrame:
    names = ("manuals", "sections", "elements", "figures", "edges", "fleet")
    return ingest.corpus_status({n: t(n) for n in names}, t("runs"))


def _escalated(t: Tables) -> DataFrame:
    answers = t("pages").select("manual_id", "page", F.lit("text").alias("said"))
    return ingest.escalated(ingest.route_pages(t("pages")), answers, 1)


def _selected(t: Tables) -> DataFrame:
    p = t("pages").select("manual_id", "page")
    some = pages.selected(p, "1-2, 12,40").withColumn("by", F.lit("spec"))
    return some.unionByName(pages.selected(p, limit=3).withColumn("by", F.lit("limit"))).unionByName(pages.selected(p).withColumn("by", F.lit("all")))


def _clauses(t: Tables) -> DataFrame:
    q, t = t("asked"), F.col("text")
    return _joined(q.select("query_id", F.array_sort(clauses.negatives(t)).alias("negatives"), clauses.positive(t).alias("positive"), clauses.primary(t).alias("first_clause"), clauses.compares(t).cast("int").alias("compares"), F.array_sort(clauses.references(t)).alias("named"), F.array_sort(clauses.keys(t, F.lit("[A-Z]{2}[0-9]{4}-[0-9]"))).alias("keys")), "negatives", "named", "keys")


def _pin_pairs(t: Tables) -> DataFrame:
    hits, e, s = _small(t, "hits", "elements", "sections")
    return rank.pin_pairs(rank.candidates(hits, e, s)).select("query_id", "element_id", "pinned", "rule")


def _passes(t: Tables) -> DataFrame:
    rows = engine._pictured(_knowledge(t), _ranked(t))
    return rank.diversify_passes(rows, t("questions")).select("query_id", "element_id", "pass_no", "place")


def _single(t: Tables) -> DataFrame:
    return engine.single_pass(_knowledge(t), t("questions")).select("query_id", "element_id", "score", "place")


def _final(t: Tables) -> DataFrame:
    k, q = _knowledge(t), t("questions")
    order = t.spark.createDataFrame([(1, [104, 999, 103]), (4, [109])], "query_id long, ids array<long>")
    rows = rank.diversify_passes(engine._pictured(k, _ranked(t)), q)
    return engine.finalized(rows, order, k, q).select("query_id", "element_id", "pass_no", "place")


def _rerank(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame([(1, [104, 999, 103]), (4, [109])], "query_id long, ids array<long>")
    return retrieve.rerank(_ranked(t).select("query_id", "element_id", "place"), order)


def _boosts(t: Tables) -> DataFrame:
    hits, e, s, q = _small(t, "hits", "elements", "sections", "questions")
    return retrieve.boosts(rank.candidates(hits, e, s), q).select("query_id", "element_id", "score")


def _panel_steps(t: Tables) -> DataFrame:
    rects, steps = _small(t, "rects", "steps")
    return ingest.panel_steps(ingest.panel_boxes(rects), steps)


def _log(t: Tables) -> DataFrame:
    q, hits, e, m = _small(t, "questions", "hits", "elements", "manuals")
    rows = _ranked(t)
    return engine.query_log(gate.answers(gate.checks(q, hits, e, m), rows), q, rows).withColumn("retrieved", F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ","))


def _panel_codes(t: Tables) -> DataFrame:
    rects, labels = _small(t, "rects", "labels")
    return ingest.panel_codes(ingest.panel_boxes(rects), labels)


for _name, _build in {
    "query_features": _query_features,
    "element_text": _element_text,
    "section_text": _section_text,
    "identifier_probe": _two(retrieve.identifier_probe, "elements", "questions"),
    "structural_search": _two(retrieve.structural, "sections", "elements", "questions"),
    "structural_picks": _two(retrieve.from_picks, "elements", "picks"),
    "figure_probe": _two(retrieve.figure_probe, "figures", "elements", "sections", "questions"),
    "figure_backfill": _two(retrieve.figure_backfill, "figures", "elements"),
    "related_figures": _two(retrieve.related_figures, "hits", "elements", "sections", "figures"),
    "dedup_best": lambda t: retrieve.dedup_best(t("hits").unionByName(t("hits").withColumn("score", 10 - F.col("score")))),
    "rerank_hits": _rerank,
    "current_editions": _two(gate.current_editions, "sections"),
    "superseded": _two(gate.superseded, "elements", "sections"),
    "latest_run": _two(gate.latest_runs, "runs"),
    "page_to_section": lambda t: graph.page_to_section(t("elements").select("manual_id", "page").distinct(), t("sections")),
    "chapter_asof": _asof,
    "toc_chapters": _two(graph.toc_chapters, "toc"),
    "unique_sections": lambda t: graph.unique_sections(t("sections").unionByName(t("sections").withColumn("section_id", F.col("section_id") + 100).withColumn("page_end", F.col("page_end") + 5).withColumn("page_start", F.col("page_start") + 1))),
    "section_parents": _two(graph.parents, "sections"),
    "describes_by_title": _two(graph.describes_by_title, "sections", "elements"),
    "illustrates_plate": _two(graph.plates_by_code, "sections", "elements"),
    "cross_refs": _two(graph.cross_references, "elements", "sections"),
    "step_links": _two(graph.step_links, "elements", "figures"),
    "dedup_edges": _edges,
    "xref_hop": _hops,
    "panel_hop": _panel_hops,
    "kind_pairs": _two(rank.kind_pairs, "hits", "elements", "sections"),
    "section_mates": _two(rank.section_mates, "hits", "elements", "sections", "questions"),
    "lexical_by_kind": lambda t: retrieve.lexical_or(*_small(t, "elements", "questions"), 3, t("sections")),
    "text_functions": _text_functions,
    "panel_ocr": lambda t: ingest.panel_ocr(t("ocr").where("manual_id = 'm1' and page = 1")),
    "ocr_elements": lambda t: _joined(pages.ocr_elements(t("ocr").where("manual_id <> 'm1' or page <> 1")), "bbox"),
    "layout_elements": lambda t: _joined(ingest.layout_elements(t("layouts")), "bbox"),
    "lexical_and_inline": _two(retrieve.lexical_and, "elements", "questions"),
    "lexical_or_inline": _two(retrieve.lexical_or, "elements", "questions"),
    "list_siblings": _two(rank.list_siblings, "hits", "elements"),
    "table_code_siblings": _two(rank.table_code_siblings, "hits", "elements", "questions"),
    "step_panels": _two(rank.step_panels, "hits", "elements", "figures"),
    "named_exact": partial(_hit_rule, rank.named_exact),
    "component_priority": partial(_hit_rule, rank.component_priority),
    "negation_demote": partial(_hit_rule, rank.negation_demote),
    "final_boost": partial(_hit_rule, rank.final_boost),
    "weak_titles": partial(_hit_rule, rank.weak_titles),
    "chapter_siblings": partial(_hit_rule, rank.chapter_siblings),
    "clause_features": _clauses,
    "pin_pairs": _pin_pairs,
    "describes_pairs": _two(rank.describes_pairs, "hits", "edges", "elements", "sections"),
    "diversify_passes": _passes,
    "single_pass": _single,
    "finalized_order": _final,
    "citation_records": lambda t: rank.citation_records(_ranked(t)).select("query_id", "element_id", "reference", "citation_key", "page", "kind", "score", "snippet"),
    "short_citations": lambda t: rank.short_citations(_ranked(t)),
    "citation_window": lambda t: rank.citation_window(_ranked(t), t("questions")),
    "diagram_window": lambda t: rank.diagram_window(engine._pictured(_knowledge(t), _ranked(t)), t("questions")),
    "phrase_probe_titles": lambda t: retrieve.phrase_probe(t("elements"), t("questions"), sections=t("sections")),
    "lexical_path": _two(retrieve.lexical_path, "elements", "sections", "questions"),
    "visual_path": lambda t: retrieve.visual_path(*_small(t, "figures", "elements", "sections", "questions")).select("query_id", "figure_id", "score", "text"),
    "every_manual": lambda t: retrieve.identifier_probe(t("elements"), retrieve.for_every_manual(t("questions").withColumn("manual_id", F.when(F.col("query_id") != 1, F.col("manual_id"))), t("manuals"))),
    "gate_checks": _gate,
    "numeric_conflicts": _conflicts,
    "route_pages": _two(ingest.route_pages, "pages"),
    "escalated_routes": _escalated,
    "detect_convention": lambda t: _joined(conventions.detect(t("bands")), "label_words"),
    "extract_citation": _citations,
    "infer_pattern": lambda t: t("codes").groupBy("manual_id").agg(F.collect_list("code").alias("c")).select("manual_id", conventions.vote(F.col("c")).alias("pattern")),
    "fitting_patterns": _two(conventions.fitting, "answers", "bands"),
    "replaced_conventions": _replaced,
    "conventions_of_keys": lambda t: _joined(conventions.from_keys(t("keys")), "label_words"),
    "see_references": _references,
    "sampled_pages": lambda t: conventions.sampled(t("pages"), 4).select("manual_id", "page"),
    "page_meta": _page_meta,
    "primary_citations": lambda t: _page_meta(t).select("manual_id", "page", pages.primary_citation(F.col("citation_key"), F.col("plate_no"), F.col("procedure_no"), F.col("doc_code"), F.col("edition")).alias("primary")),
    "bookmark_sections": lambda t: pages.bookmark_sections(t("bookmarks")),
    "extract_sections": _extracted,
    "selected_pages": _selected,
    "text_layer": lambda t: pages.text_layer(t("scanned")),
    "manual_identity": lambda t: pages.manual_identity(t("files")),
    "completed_plates": _plates,
    "diagram_panels": lambda t: _joined(_drafts(t), "bbox"),
    "diagram_modes": lambda t: ingest.diagram_modes(_titles(t).select("manual_id", "page", "plate_no"), _drafts(t)),
    "diagram_elements": _diagram_elements,
    "attached_panels": _attached_panels,
    "filled_steps": _filled_steps,
    "upsert_figures": _upsert_figures,
    "corpus_status": _status,
    "upsert_sections": lambda t: ingest.upsert_sections(t("sections").withColumn("title", F.col("component_title")), t("upserts")),
    "upsert_fleet": _two(ingest.upsert_fleet, "fleet", "new_fleet"),
    "fleet_context": _two(ingest.fleet_context, "fleet", "manuals"),
    "plate_pages": _two(ingest.plate_pages, "sections", "elements"),
    "panel_boxes": _two(ingest.panel_boxes, "rects"),
    "panel_codes": _panel_codes,
    "route_query": lambda t: retrieve.route_query(t("questions")).withColumn("labels", F.array_join("labels", ",")),
    "ranking_boosts": _boosts,
    "fetch_named": _two(rank.fetch_named, "hits", "elements", "sections", "questions"),
    "fetch_drawings": _two(rank.fetch_drawings, "figures", "questions"),
    "best_plate": lambda t: rank.best_plate(_ranked(t), t("figures")),
    "images_first": lambda t: rank.images_first(_ranked(t), *_small(t, "figures", "questions")),
    "header_lines": lambda t: pages.header_lines(t("spans")).select("manual_id", "page", F.array_join("lines", " ").alias("header")),
    "panel_steps": _panel_steps,
    "route_counts": lambda t: ingest.route_counts(ingest.route_pages(t("pages"))),
    "citation_backfill": _two(ingest.citation_backfill, "elements"),
    "placed_elements": _two(ingest.placed_elements, "elements", "sections"),
    "query_log": _log,
    "build_edges": lambda t: engine.build_edges(_knowledge(t)),
    "ask": lambda t: _joined(engine.ask(_knowledge(t), t("questions")), "citations", "diagrams"),
}.items():
    RULES[_name] = _build
for _name in PROJECTED:
    QUERIES[_name] = partial(lambda build, spark, d: build(project.Knowledge(spark, d)), RULES[_name])
