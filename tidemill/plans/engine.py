"""Compositions: a batch of questions to answers, and pages to knowledge tables.

No step collects hits. They are used by many rules, so they are written on the way (a few dozen
rows a question); without that the plan would grow with every rule. Texts are not in these rows: the rules that read
them send questions to the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import clauses, gate, graph, rank, retrieve
from .storage import kept, settle


@dataclass
class Knowledge:
    """The tables a question runs over."""

    manuals: DataFrame
    sections: DataFrame
    elements: DataFrame
    figures: DataFrame
    edges: DataFrame


def fused(k: Knowledge, questions: DataFrame) -> DataFrame:
    """The three retrieval paths and their fusion."""
    lexical = retrieve.lexical_path(k.elements, k.sections, questions)
    structural = retrieve.structural(k.sections, k.elements, questions)
    visual = retrieve.figure_probe(k.figures, k.elements, k.sections, questions).select("query_id", "element_id", "score")
    return retrieve.rrf([lexical, structural, visual])


def _joined(k: Knowledge, rows: DataFrame, fetched: list[tuple[DataFrame, int, bool, str]]) -> DataFrame:
    """rows with what some rules fetch (hits, step, pinned, rule), after all that is there. What is there already stays as it is; what several fetch comes by the first."""
    every = None
    for more, step, pinned, rule in fetched:
        one = more.select("query_id", "element_id", "score", F.lit(step).alias("nth"), F.lit(pinned).alias("pin"), F.lit(rule).alias("by"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("query_id", "element_id").agg(F.min(F.struct("nth", (-F.col("score")).alias("low"), "pin", "by")).alias("x"))
    new = first.join(rows.select("query_id", "element_id"), ["query_id", "element_id"], "left_anti").select("query_id", "element_id", (-F.col("x.low")).alias("score"), "x.nth", "x.pin", "x.by")
    out = rank.candidates(new, _slim(k.elements), k.sections).withColumn("seq", F.col("seq") + F.col("nth") * 1000).withColumn("pinned", F.col("pin")).withColumn("rule", F.col("by"))
    return rows.unionByName(out.drop("nth", "pin", "by").select(rows.columns))


def expanded(k: Knowledge, hits: DataFrame, questions: DataFrame, put: DataFrame) -> DataFrame:
    """Hits with what the rules fetch: named elements and drawings; after component priority the best plate's figures and pairs of kinds; mates, lists, table codes and panels; references.

    Each of the four parts sees what those before it added, and is written. put: questions as they are put to manuals, one each, for rules that look there.
    """
    rows = rank.named_exact(rank.candidates(hits, _slim(k.elements), k.sections), questions)
    named = [(rank.fetch_named(hits, k.elements, k.sections, put, named=clauses.references), 1, True, "exact identifier"), (rank.fetch_drawings(k.figures, put, 8, clauses.references), 2, True, "exact identifier")]
    rows = kept(rank.component_priority(kept(_joined(k, rows, named), "named"), questions), "prior")
    plate = rank.best_plate(rows, k.figures).withColumn("score", F.lit(0.0))
    lead = retrieve.top(rows, ["query_id"], [F.desc("pinned"), F.desc("score"), "seq"], 12).select("query_id", "element_id", "score")
    pairs = rank.kind_pairs(lead, k.elements, k.sections).unionByName(rank.describes_pairs(lead, k.edges, k.elements, k.sections))
    rows = kept(rank.pin_pairs(_joined(k, rows, [(plate, 3, False, "plate figure"), (pairs, 4, True, "kind pair")])), "pairs")
    own = rows.select("query_id", "element_id", "score")
    lists = rank.list_siblings(own, k.elements)
    rows = kept(_joined(k, rows, [
        (rank.section_mates(own, k.elements, k.sections, questions, best=12), 5, False, "section mate"),
        (lists.where("pinned"), 6, True, "limit"), (lists.where("not pinned"), 7, False, "list"),
        (rank.table_code_siblings(own, k.elements, put), 8, False, "table code"),
        (rank.step_panels(own, k.elements, k.figures), 9, False, "panel"),
        (graph.reverse_hop(own, k.edges, k.elements, "illustrates_step", config.MAX_PANELS, config.PANEL), 10, False, "panel"),
    ]), "fetched")
    lead = retrieve.top(rows, ["query_id", "pinned"], [F.desc("score"), "seq"], 8).unionByName(rows.where("pinned")).select("query_id", "element_id", "score").distinct()
    hops = graph.hop(lead, k.edges, k.elements, ("cross_ref", "references_section", "references_data", "references_procedure"), config.MAX_HOPS, config.CROSS_REF)
    return kept(_joined(k, rows, [(hops, 11, False, "reference")]), "expanded")


def _pictured(k: Knowledge, rows: DataFrame) -> DataFrame:
    """Rows with the image of their element, the first if there are several."""
    image = k.figures.where("element_id is not null and image is not null").groupBy("element_id").agg(F.min_by("image", "figure_id").alias("image"))
    return rows.join(image, "element_id", "left")


def ranked(k: Knowledge, questions: DataFrame) -> DataFrame:
    """The ranking rules in their order, then order and passes: what is left are the best hits of each question, by place."""
    put = retrieve.for_every_manual(questions, k.manuals)
    rows = expanded(k, kept(fused(k, put), "fused"), questions, put)
    rows = rank.final_boost(rows, questions, _texts(k.elements))
    for rule in (rank.negation_demote, rank.chapter_siblings, rank.weak_titles):
        rows = rule(rows, questions)
    rows = rank.in_order(_pictured(k, rows))
    return kept(rank.diversify_passes(rows, questions), "ranked")


def _slim(elements: DataFrame) -> DataFrame:
    """Elements with a number for what they say (said) instead of their text and table."""
    return elements.withColumn("said", F.xxhash64("text", "table_json")).drop("text", "table_json")


def _texts(elements: DataFrame) -> DataFrame:
    """What elements say, each once: element_id, said, text, table_json."""
    return elements.select("element_id", F.xxhash64("text", "table_json").alias("said"), "text", "table_json").dropDuplicates(["element_id", "said"])


def single_pass(k: Knowledge, questions: DataFrame) -> DataFrame:
    """The path without fusion: the best score of each hit over all probes, the additive signals, plates of the hits' chapters where figures or work are asked for, low plates out where data alone is."""
    put = retrieve.for_every_manual(questions, k.manuals)
    lexical = retrieve.lexical(k.elements, put).select("query_id", "element_id", "score")
    structural = retrieve.structural(k.sections, k.elements, put)
    visual = retrieve.figure_probe(k.figures, k.elements, k.sections, put).select("query_id", "element_id", "score")
    hits = settle(retrieve.dedup_best(lexical.unionByName(structural).unionByName(visual)))
    wants = questions.select("query_id", T.intent(F.col("text")).alias("i")).select("query_id", "i.wants_figure", "i.wants_proc", "i.wants_data")
    plates = retrieve.related_figures(hits, k.elements, k.sections, k.figures).join(wants.where("wants_figure or wants_proc").select("query_id"), "query_id", "left_semi")
    hits = retrieve.dedup_best(hits.unionByName(plates.select("query_id", "element_id", "score")))
    rows = retrieve.boosts(rank.candidates(hits, _slim(k.elements), k.sections), questions, _texts(k.elements)).join(wants, "query_id")
    low = F.coalesce(F.col("kind") == "plate", F.lit(False)) & F.col("wants_data") & ~F.col("wants_figure") & (F.col("score") < 5)
    rows = rank.in_order(rows.where(~low).drop("wants_figure", "wants_proc", "wants_data"))
    return rows.where(F.col("place") <= config.FUSED)


def finalized(rows: DataFrame, order: DataFrame, k: Knowledge, questions: DataFrame) -> DataFrame:
    """Ranked rows after a service's order of the first of them: pinned ones stay ahead, then the passes again."""
    new = retrieve.rerank(rows.select("query_id", "element_id", "place"), order).withColumnRenamed("place", "given")
    rows = rows.drop("pass_no").join(new, ["query_id", "element_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("pinned"), "given")
    rows = rows.withColumn("place", F.row_number().over(w)).drop("given", "image")
    return rank.diversify_passes(_pictured(k, rows), questions)


def asked(k: Knowledge, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Answers, ranked evidence, citations and diagrams. A question without a manual asks all of them, as if it were put to each."""
    rows = ranked(k, questions)
    texts = _texts(k.elements)
    verdict = gate.checks(questions, rows.select("query_id", "element_id", "said", "plate_no", "procedure_no", "edition"), texts, k.manuals)
    first = rows.where(F.col("place") <= gate.SHOWN).join(texts, ["element_id", "said"])
    return gate.answers(verdict, first), rows, rank.citation_window(rows, questions), rank.diagram_window(rows, questions)


def ask(k: Knowledge, questions: DataFrame) -> DataFrame:
    """query_id, passed, reason, abstained, answer for each question, with the ids it cites and the images it shows."""
    answers, _, cited, shown = asked(k, questions)
    listed = lambda df, c, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]).alias(name))
    return answers.join(listed(cited, "element_id", "citations"), "query_id", "left").join(listed(shown, "image", "diagrams"), "query_id", "left")


def build_edges(k: Knowledge) -> DataFrame:
    """All edges that the rules draw, each once and none that is there."""
    fresh = graph.describes_by_title(k.sections, k.elements)
    for more in (graph.plates_by_code(k.sections, k.elements), graph.cross_references(k.elements, k.sections), graph.step_links(k.elements, k.figures)):
        fresh = fresh.unionByName(more)
    return graph.new_edges(fresh, k.edges)


def query_log(answers: DataFrame, questions: DataFrame, ranked_rows: DataFrame) -> DataFrame:
    """A row per question for an append-only log."""
    ids = ranked_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "element_id"))), lambda x: x["element_id"]).alias("retrieved"))
    return answers.join(questions.select("query_id", F.col("text").alias("query_text")), "query_id").join(ids, "query_id", "left").withColumn("fusion_method", F.lit("rrf"))
