"""The verification gate: six checks per question over its evidence, then an answer or an abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

# The operating conditions a question may set.
CONDITION = r"(?:^|[^a-z0-9])([0-9]+ *% *(?:mcr|load)|mcr|cold start|overload|idle|man(?:o?eu)v(?:re|ring|er|ering)|during start|warm-?up)(?:[^a-z]|$)"


def current_editions(sections: DataFrame) -> DataFrame:
    """The greatest edition of each code a section goes by: procedure, plate, document and citation key."""
    names = [c for c in ("procedure_no", "plate_no", "doc_code", "citation_key") if c in sections.columns]
    keys = sections.select("manual_id", T.edition_key(F.col("edition")).alias("edition"), F.explode(F.array_distinct(F.filter(F.array(*names), lambda c: c.isNotNull()))).alias("code"))
    return keys.where("edition is not null").groupBy("manual_id", "code").agg(F.max("edition").alias("current"))


def superseded(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Elements whose edition is older than the current one of their number."""
    rows = elements.where("edition is not null").select("element_id", "manual_id", T.edition_key(F.col("edition")).alias("edition"), F.coalesce("plate_no", "procedure_no").alias("code"))
    return rows.join(current_editions(sections), ["manual_id", "code"]).where("edition < current").select("element_id", "edition", "current")


def numeric_conflicts(hits: DataFrame, elements: DataFrame) -> DataFrame:
    """Values that differ for one table code and unit within a question's evidence."""
    blob = F.concat_ws(" ", "text", T.table_cells(F.col("table_json")))
    rows = hits.join(elements, "element_id").select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(blob, F.lit(f"({config.TABLE_ROW_PATTERN})"), F.lit(1)))).alias("code"), F.regexp_extract_all(F.lower(blob), F.lit(rf"([0-9]+(?:\.[0-9]+)? *(?:{'|'.join(config.UNITS)}))"), F.lit(1)).alias("values"))
    rows = rows.withColumn("v", F.explode("values")).select("query_id", "code", F.regexp_extract("v", "([a-z]+)$", 1).alias("unit"), F.regexp_extract("v", r"^([0-9.]+)", 1).alias("value"))
    return rows.groupBy("query_id", "code", "unit").agg(F.array_sort(F.collect_set("value")).alias("values")).where("size(values) > 1")


def _manuals(manuals: DataFrame) -> DataFrame:
    """Model and revision granularity of each manual; by section where the manual's convention does not say."""
    said = F.col("granularity") if "granularity" in manuals.columns else F.lit(None).cast("string")
    return manuals.select("manual_id", "model", F.coalesce(said, F.lit("per_section")).alias("granularity"))


def _said(questions: DataFrame) -> DataFrame:
    """What the checks ask of each question, worked out once and before evidence is joined: no rule goes through the text again."""
    low, units = F.lower("text"), "|".join(config.UNITS)

    def terms(i: Column) -> Column:
        words = F.filter(F.when(F.size(i["component_tokens"]) > 0, i["component_tokens"]).otherwise(i["tokens"]), lambda t: F.char_length(t) >= 4)
        return F.struct(i["codes"].alias("ids"), F.concat(F.slice(T.phrases(i["tokens"]), 1, 6), F.slice(words, 1, 6)).alias("terms"))

    return questions.select(
        "query_id", "manual_id", T.let(T.intent(F.col("text")), terms).alias("said"),
        F.coalesce(F.col("equipment"), T.equipment_token(F.col("text"))).alias("wanted"), T.named_edition(F.col("text")).alias("named_edition"),
        low.rlike(rf"[0-9] *({units})([^a-z]|$)").alias("stated"), F.regexp_extract(low, rf"(?:^|[^a-z])({units})(?:[^a-z]|$)", 1).alias("unit"),
        F.regexp_replace(F.regexp_extract(low, CONDITION, 1), " +", " ").alias("condition"),
    )


def checks(questions: DataFrame, hits: DataFrame, elements: DataFrame, manuals: DataFrame) -> DataFrame:
    """One row a question: each check, the failed ones in order, the reason, and whether all passed.

    Conflicts of numbers are told, not judged. A question's evidence is bounded by the fusion's limit. hits have codes and editions themselves where
    elements are only what is said (element_id, said, text, table_json).
    """
    blob = F.lower(F.concat_ws(" ", "text", T.table_cells(F.col("table_json"))))
    ev = hits.join(elements, ["element_id", "said"]) if "said" in elements.columns else hits.select("query_id", "element_id").join(elements, "element_id")
    ev = ev.groupBy("query_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list(blob))).alias("blob"), F.count("*").cast("int").alias("n"), F.flatten(F.collect_set(F.transform(F.array("plate_no", "procedure_no"), lambda c: F.struct(c.alias("code"), T.edition_key(F.col("edition")).alias("edition"))))).alias("editions"))
    q = _said(questions).join(ev, "query_id", "left").join(_manuals(manuals), "manual_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("blob", F.coalesce("blob", F.lit("")))
    wanted, edition, terms, stated, unit, condition = map(F.col, ("wanted", "named_edition", "said.terms", "stated", "unit", "condition"))
    named = F.filter(F.coalesce("editions", F.array().cast("array<struct<code:string,edition:string>>")), lambda e: F.array_contains("said.ids", F.upper(e["code"])) & (e["edition"] != ""))
    spaceless = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    rules = {
        "equipment": wanted.isNull() | T.models_agree(wanted, F.col("model")),
        # only an edition that a named number has and the question does not want is a mismatch
        "revision": F.col("granularity").isin("none", "unknown") | edition.isNull() | ~F.exists(named, lambda e: e["edition"] != edition),
        "condition": (condition == "") | F.col("blob").contains(condition) | spaceless(F.col("blob")).contains(spaceless(condition)),
        "units": (F.col("n") == 0) | (unit == "") | stated | F.col("blob").contains(unit) | ((unit == "deg") & F.col("blob").contains("\u00b0")),
        "scope": (F.col("n") > 0) & ((F.size(terms) == 0) | F.exists(terms, lambda t: F.col("blob").contains(t))),
        "conflicts": F.lit(True),
    }
    q = q.select("query_id", "n", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in rules.items()])
    failed = F.filter(F.array(*[F.when(~F.col(name), name) for name in rules]), lambda x: x.isNotNull())
    reason = F.coalesce(*[F.when(~F.col(name), text) for name, text in (("scope", "no evidence covers the question"), ("equipment", "the evidence is for other equipment"), ("revision", "the evidence is of another edition"), ("condition", "a condition is not in the evidence"), ("units", "a unit is not in the evidence"))], F.lit("ok"))
    return q.withColumn("failed", failed).withColumn("reason", reason).withColumn("passed", F.size("failed") == 0)


#: Pieces of evidence that an answer shows.
SHOWN = 5


def answers(gate: DataFrame, ranked: DataFrame, most: int = SHOWN) -> DataFrame:
    """Without a model: the first pieces of evidence as they are, or the abstention."""
    rows = ranked.where(F.col("place") <= most).select("query_id", F.struct("place", F.concat(F.lit("["), T.citation_ref(F.col("plate_no"), F.col("procedure_no"), F.col("doc_code"), F.col("doc_code"), F.col("edition"), F.col("page")), F.lit("] "), F.substring(F.coalesce(T.row_text(F.col("text"), F.col("table_json")), F.lit("")), 1, 240)).alias("t")).alias("x"))
    dump = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("dump"))
    text = F.when(F.col("passed"), F.coalesce("dump", F.lit(config.Settings.abstain_text))).otherwise(config.Settings.abstain_text)
    return gate.join(dump, "query_id", "left").select("query_id", "passed", "reason", (~F.col("passed")).alias("abstained"), text.alias("answer"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last ingest run of each manual."""
    w = Window.partitionBy("manual_id").orderBy(F.desc("started"), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
