"""Citation conventions as data: how each manual wants to be quoted, found in its own headers and footers.

A convention is a row (manual_id, field, pattern, revision_field, granularity, label_words, has_page, source).
Its pattern is a regular expression held in a column, so a manual never seen before needs no new code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes that codes are tried against, in order of priority, as (pattern, number of it).
SHAPES = (r"[0-9]{3}-[0-9]+(?:\.[0-9]+)?", r"[A-Z][0-9]{4,6}", r"P[0-9]{4,6}", r"[0-9]+(?:\.[0-9]+)+", r"[A-Z]{2,5}-?[0-9][A-Za-z0-9_.-]*")
DOTTED, LETTER = SHAPES[0], SHAPES[1]
# What precedes a quoted code, and the verbs of a reference.
QUOTED = r"(?i)quote +(Procedure|Data|Plate|Section|Chapter|Drawing) +([^ \n]+) +(?:Edition|Revision|Rev\.?) +([^ \n]+)"
SECTION = r"(?i)(?:^|[^a-z])Section +([0-9]+(?:\.[0-9]+)+) +Rev(?:ision)?\.? *([A-Z0-9]+)"
DRAWING = r"(?is)(?:^|[^a-z])Chapter +[0-9]+(?:[^0-9a-z].*?[^a-z]|[^0-9a-z])Drawing +([A-Z0-9][A-Za-z0-9_.-]*)"
CODE = r"(?:^|[^A-Za-z0-9_])([0-9]{3}-[0-9]+(?:\.[0-9]+)?)"
REVISION = r"(?i)(?:Edition|Revision|Rev\.?) +([A-Za-z0-9._-]+)"
PRINTED = r"(?i)(?:^|[^A-Za-z0-9_])page +([0-9]+)"
VERBS = ("see", "refer to", "as per", "according to", "acc. to")
LABELS = ("procedure", "section", "chapter", "plate", "data", "drawing", "appendix")
ANY = r"[A-Za-z0-9][A-Za-z0-9_.-]*"

SCHEMA = "manual_id string, field string, pattern string, revision_field string, granularity string, label_words array<string>, has_page boolean, source string"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bare(code: Column) -> Column:
    """A code without marks around it."""
    return F.regexp_replace(code, "[^A-Za-z0-9.-]", "")


def vote(codes: Column) -> Column:
    """The shape that most of an array's codes have; it needs a third of them, two at least; the first among equals."""
    known = F.filter(F.transform(codes, bare), lambda c: c != "")
    n = F.size(known)

    def hits(shape: str) -> Column:
        return F.size(F.filter(known, lambda c: c.rlike(f"^(?:{shape})$")))

    found = [F.struct(hits(p).alias("hits"), F.lit(-k).alias("order"), F.lit(p).alias("pattern")) for k, p in enumerate(SHAPES)]
    best = F.array_max(F.array(*found))
    return F.when(best["hits"] >= F.greatest(F.lit(2), F.floor((n + 2) / 3)), best["pattern"])


def _texts(bands: DataFrame) -> DataFrame:
    """Header and footer of the sampled pages, as lines of a manual. A manual has a few dozen sampled pages."""
    line = F.concat_ws("\n", F.coalesce("header", F.lit("")), F.coalesce("footer", F.lit("")))
    return bands.groupBy("manual_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("text")))), lambda x: x["text"]), "\n").alias("blob"))


def detect(bands: DataFrame) -> DataFrame:
    """One convention a manual, from its sampled bands: a quoted code, a section with a revision, a chapter with a drawing, repeated dotted codes, else the printed page."""
    b = _texts(bands)
    kinds, codes = F.transform(_all(F.col("blob"), QUOTED, 1), lambda k: F.lower(k)), _all(F.col("blob"), QUOTED, 2)
    own = F.filter(codes, lambda c, i: F.get(kinds, i).isin("procedure", "section", "chapter"))
    voted = F.coalesce(vote(own), vote(codes), F.lit(DOTTED))
    # a document code quoted below often stands beside a dotted number above, so both are taken
    quoted = F.when(voted == LETTER, f"(?:{LETTER}|{DOTTED})").otherwise(voted)
    rows = b.select("manual_id", kinds.alias("kinds"), quoted.alias("quoted"), F.size(_all(F.col("blob"), SECTION, 1)).alias("sections"), F.size(_all(F.col("blob"), DRAWING, 1)).alias("drawings"), F.size(_all(F.col("blob"), CODE, 1)).alias("dotted"), F.col("blob").rlike(PRINTED).alias("has_page"))
    ways = (
        (F.size("kinds") > 0, "citation_key", F.col("quoted"), "edition", "per_section", F.array_sort(F.array_distinct("kinds")), "heuristic"),
        (F.col("sections") > 0, "citation_key", F.lit(SHAPES[3]), "revision", "per_section", F.array(F.lit("section")), "heuristic"),
        (F.col("drawings") > 0, "citation_key", F.lit(SHAPES[4]), None, "per_document", F.array(F.lit("chapter"), F.lit("drawing")), "heuristic"),
        (F.col("dotted") >= 3, "citation_key", F.lit(DOTTED), "edition", "per_section", F.array(F.lit("procedure")), "heuristic"),
        (F.lit(True), "page_number_printed", F.lit(None).cast("string"), None, "none", F.array().cast("array<string>"), "fallback"),
    )

    def struct(w: tuple) -> Column:
        return F.struct(F.lit(w[1]).alias("field"), w[2].alias("pattern"), F.lit(w[3]).cast("string").alias("revision_field"), F.lit(w[4]).alias("granularity"), w[5].alias("label_words"), F.lit(w[6]).alias("source"))

    chosen = reduce(lambda acc, w: acc.when(w[0], struct(w)), ways[1:-1], F.when(ways[0][0], struct(ways[0]))).otherwise(struct(ways[-1]))
    return rows.select("manual_id", chosen.alias("c"), "has_page").select("manual_id", "c.field", "c.pattern", "c.revision_field", "c.granularity", "c.label_words", "has_page", "c.source")


#: What a service's pattern may be made of, piece by piece: all that Python and Java read alike. A named group is taken as a plain one.
_ESCAPE = r"\\(?:[dDwWsSntrf]|[^A-Za-z0-9]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})"
_NAMED = r"\(\?P<[A-Za-z_]\w*>"
_PIECES = (
    _ESCAPE, r"\\[bB]", rf"\[\^?(?:{_ESCAPE}|[^\[\]\\&^])+\]", _NAMED, r"\((?!\?)|\(\?(?:[:=!]|<[=!]|[ims]+:)", r"[)|^$.]",
    r"(?:[*+?]|\{[0-9]{1,3}(?:,(?:[0-9]{1,3})?)?\})\??", r"[^\\\[\](){}|^$.*+?]",
)
PORTABLE = rf"(?:\(\?[ims]+\))?(?:{'|'.join(_PIECES)})+"


def usable(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Rows whose pattern is a regular expression for Spark too, with named groups as plain ones; null, empty, broken and other patterns go.

    The table has a row a manual, so it is looked at in pandas: Java would fail the job where a pattern is broken. A pattern that one of
    the two would read in another way, or not at all, is refused, as one that fits nothing is.
    """
    def plain(p: str | None) -> str | None:
        import re

        try:
            return re.sub(rf"({_ESCAPE})|{_NAMED}", lambda m: m[1] or "(", p) if p and re.fullmatch(PORTABLE, p) and re.compile(p) else None
        except (re.error, OverflowError):
            return None

    def ok(batches):
        for b in batches:
            b[column] = [plain(p) for p in b[column]]
            yield b[b[column].notna()]

    return patterns.mapInPandas(ok, patterns.schema)


def fitting(patterns: DataFrame, bands: DataFrame) -> DataFrame:
    """Of patterns (manual_id, pattern) those that hit half of the quoted codes (one at least), or where none is quoted come twice in the bands."""
    rows = usable(patterns).join(_texts(bands), "manual_id")
    codes = F.transform(_all(F.col("blob"), r"(?i)quote +[A-Za-z0-9_]+ +([^ \n]+) +(?:Edition|Rev)", 1), bare)
    hit = F.expr("size(filter(codes, c -> regexp_like(c, pattern)))")
    rows = rows.withColumn("codes", codes).withColumn("hits", hit).withColumn("seen", F.expr("regexp_count(blob, pattern)"))
    ok = F.when(F.size("codes") > 0, F.col("hits") >= F.greatest(F.lit(1), F.floor(F.size("codes") / 2))).otherwise(F.col("seen") >= 2)
    return rows.where(ok).select("manual_id", "pattern")


def replaced(found: DataFrame, answers: DataFrame, bands: DataFrame) -> DataFrame:
    """Conventions with a service's answers where these fit the bands. answers: manual_id, pattern, revision_field, granularity, label_words."""
    answers = usable(answers)
    good = answers.join(fitting(answers.select("manual_id", "pattern"), bands), ["manual_id", "pattern"], "left_semi")
    new = good.select("manual_id", F.lit("citation_key").alias("field"), "pattern", "revision_field", F.coalesce("granularity", F.lit("per_section")).alias("granularity"), F.transform("label_words", lambda w: F.lower(w)).alias("label_words"), F.lit("service").alias("source"))
    pages = found.select("manual_id", "has_page")
    kept = found.join(new, "manual_id", "left_anti")
    return kept.unionByName(new.join(pages, "manual_id").select(kept.columns))


def from_keys(keys: DataFrame) -> DataFrame:
    """Conventions of manuals whose keys are known already; page keys say nothing. keys: manual_id, key."""
    own = keys.where("key is not null and not lower(key) like 'p.%'").groupBy("manual_id").agg(F.array_sort(F.collect_set("key")).alias("codes"))
    rows = keys.select("manual_id").distinct().join(own, "manual_id", "left").withColumn("pattern", vote(F.coalesce("codes", F.array().cast("array<string>"))))
    some = F.col("pattern").isNotNull()
    return rows.select(
        "manual_id", F.when(some, "citation_key").otherwise("page_number_printed").alias("field"), "pattern", F.when(some, "edition").alias("revision_field"),
        F.when(some, "per_section").otherwise("none").alias("granularity"), F.array().cast("array<string>").alias("label_words"), F.lit(True).alias("has_page"), F.when(some, "backfill").otherwise("fallback").alias("source"),
    )


def updated(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored conventions with the fresh ones over them; a manual without a fresh one keeps its own."""
    return fresh.unionByName(stored.join(fresh.select("manual_id"), "manual_id", "left_anti"))


def _first(pattern: str, text: Column, where: str = "") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def citations(pages: DataFrame, conventions: DataFrame) -> DataFrame:
    """Key, revision and printed page of each page by its manual's convention. pages: manual_id, page, text.

    The key is looked for where the page says how to quote it (80 characters on), else in its first 800 characters, then
    in the whole page; without one it is the printed page, else the page.
    """
    quote = F.nullif(F.regexp_extract("text", r"(?i)((?:quote|referring to this page)[^\n]{0,80})", 1), F.lit(""))
    rows = pages.join(conventions.select("manual_id", "pattern", "revision_field"), "manual_id", "left")
    rows = rows.withColumn("near", F.coalesce(quote, F.substring("text", 1, 800)))
    key = F.coalesce(*[F.when(F.col("pattern").isNotNull(), F.nullif(F.expr(f"regexp_extract({c}, pattern, 0)"), F.lit(""))) for c in ("near", "text")])
    printed = _first(PRINTED, F.col("text"))
    page = F.concat(F.lit("p."), F.coalesce(printed, F.col("page").cast("string")))
    return rows.select("manual_id", "page", F.coalesce(key, page).alias("key"), F.when(F.col("revision_field").isNotNull(), _first(REVISION, F.col("text"))).alias("revision"), printed.alias("printed"))


def see_pattern(pattern: Column, label_words: Column) -> Column:
    """The regular expression of a reference in a manual's own words: a verb, one of its labels, its code. Groups: label, code."""
    verbs = "|".join(v.replace(".", r"\.") for v in VERBS)
    labels = F.when(F.size(F.coalesce(label_words, F.array().cast("array<string>"))) > 0, F.array_join(label_words, "|")).otherwise("|".join(LABELS))
    return F.concat(F.lit(rf"(?i)(?:{verbs})\s+(?:("), labels, F.lit(r")\s+)?("), F.coalesce(pattern, F.lit(ANY)), F.lit(")"))


def references(elements: DataFrame, conventions: DataFrame) -> DataFrame:
    """(manual_id, element_id, label, ref): what each text refers to, by its manual's convention."""
    rows = elements.where("text is not null").join(conventions.select("manual_id", see_pattern(F.col("pattern"), F.col("label_words")).alias("see")), "manual_id")
    found = F.expr("arrays_zip(regexp_extract_all(text, see, 1), regexp_extract_all(text, see, 2))")
    return rows.select("manual_id", "element_id", F.explode(found).alias("x")).select("manual_id", "element_id", F.lower(F.nullif(F.col("x")["0"], F.lit(""))).alias("label"), F.upper(F.col("x")["1"]).alias("ref")).distinct()


def sampled(pages: DataFrame, most: int = 18) -> DataFrame:
    """Evenly spaced pages of each manual, halves rounded to even; the page with most drawings, if not among them, stands for the last. pages: manual_id, page, drawings and more."""
    n = pages.groupBy("manual_id").agg(F.max("page").alias("n"), F.max_by("page", F.struct("drawings", (-F.col("page")).alias("first"))).alias("densest"))
    count = F.least(F.lit(most), F.col("n"))
    even = F.when(count < 2, F.array(F.lit(1))).otherwise(F.expr(f"transform(sequence(0, least({most}, n) - 1), i -> cast(bround(i * (n - 1) / (least({most}, n) - 1)) + 1 as int))"))
    wanted = n.withColumn("even", F.array_distinct(even))
    wanted = wanted.withColumn("even", F.when(F.array_contains("even", F.col("densest")), F.col("even")).otherwise(F.concat(F.slice("even", F.lit(1), F.size("even") - 1), F.array("densest"))))
    return pages.join(wanted.select("manual_id", F.explode("even").alias("page")), ["manual_id", "page"], "left_semi")
