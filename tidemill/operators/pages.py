"""Pages of manuals: what their headers say, sections from bookmarks and page codes, and elements from services' answers.

Every key has manual_id, so page 1 of two manuals are two pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from . import carry
from . import conventions as C
from .graph import section_ends
from .retrieve import top

# The line that tells how to quote a page, what its code's letter means, and what a header line is that no title is.
QUOTE = r"(?im)quote +(Procedure|Data|Plate|Maintenance Schedules) +([A-Z][0-9][A-Za-z0-9_.]*) +Edition +([A-Za-z0-9. ]+?)[^A-Za-z0-9\n]*$"
LETTERS = {"D": "data", "M": "procedure", "P": "plate", "A": "schedule"}
NOISE = r"(?i)^(Page +[0-9]+.*|[0-9]{3}-[0-9]+(\.[0-9]+)?|[A-Z][0-9]{4,6}(-[A-Za-z0-9_.]+)?|[- .]*)$"
BOOKMARK = r"^([A-Z][0-9]{4,6})(?:-([A-Za-z0-9_.]+))?[ \t]*(.*)$"


def header_lines(spans: DataFrame, band: float = 62.0, bucket: float = 12.0) -> DataFrame:
    """Texts of each page's header band in reading order. spans: manual_id, page, x0, y0, y1, text."""
    rows = spans.where((F.col("y1") <= band) & (F.trim("text") != ""))
    order = F.struct(F.bround(F.col("y0") / bucket).cast("int").alias("line"), "x0", "text")
    return rows.groupBy("manual_id", "page").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: T.control_to_dash(s["text"])).alias("lines"))


def _group(pattern: str, text: Column, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def letter_kind(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, kind in LETTERS.items():
        out = F.when(F.upper(F.substring(code, 1, 1)) == letter, kind).otherwise(out)
    return out


def section_kind(code: Column, title: Column) -> Column:
    """By the code's letter, else by whole words of the title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    word = lambda words: low.rlike(f"(^|[^a-z])({words})([^a-z]|$)")
    return F.coalesce(
        letter_kind(code),
        F.when(word("data|specifications?|specs?|limits?|clearances?"), "data")
        .when(word("procedure|checking|inspection|dismantl[a-z]*|mounting|overhaul|removal|replacement"), "procedure")
        .when(word("plate|drawing|figure"), "plate").otherwise("other"),
    )


def page_meta(pages: DataFrame, spans: DataFrame, conventions: DataFrame) -> DataFrame:
    """One row a page: its citation, codes, edition, kind and titles. pages: manual_id, page, text; spans as in header_lines."""
    pages = pages.withColumn("text", T.control_to_dash(F.coalesce("text", F.lit(""))))
    rows = pages.join(C.citations(pages, conventions), ["manual_id", "page"]).join(header_lines(spans), ["manual_id", "page"], "left")
    line = F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x: F.trim(x))
    numbers = F.filter(line, lambda x: x.rlike(r"^[0-9]{3}-[0-9]+(\.[0-9]+)?$"))
    plates = F.filter(line, lambda x: x.rlike("(?i)^P[0-9]{4,6}$"))
    titles = F.array_distinct(F.filter(line, lambda x: ~x.rlike(NOISE) & (F.char_length(x) >= 3) & ~x.rlike("(?i)^P[0-9]{4,6}$")))
    word, code = F.lower(_group(QUOTE, F.col("text"), 1)), _group(QUOTE, F.col("text"), 2)
    action = lambda x: F.lower(x).isin(*config.ACTION_WORDS)
    swap = (F.size("titles") > 1) & action(F.get("titles", F.lit(0))) & ~action(F.get("titles", F.lit(1)))
    rows = rows.withColumn("titles", titles).withColumn("doc_code", code).withColumn("numbers", numbers).withColumn("plates", plates)
    kind = F.when(word == "plate", "plate").when(word == "data", "data").when(word == "procedure", "procedure").when(word.isNotNull(), "schedule").when(F.col("key").rlike("(?i)^P[0-9]{4,6}$"), "plate").otherwise("other")
    plate = F.coalesce(F.when((kind == "plate") | F.upper("doc_code").startswith("P"), F.col("doc_code")), F.when(F.col("key").rlike("(?i)^P[0-9]{4,6}$"), F.upper("key")), F.upper(F.get("plates", F.lit(0))))
    number = F.coalesce(F.when(F.size("numbers") > 0, F.element_at("numbers", -1)), F.when(F.col("key").rlike(r"^[0-9]{3}-[0-9]+(\.[0-9]+)?$"), F.col("key")))
    rows = rows.withColumn("kind", kind).withColumn("plate_no", plate).withColumn("procedure_no", number)
    richer = F.when(F.col("key").startswith("p."), F.coalesce("plate_no", "procedure_no", "doc_code"))
    at = lambda i: F.substring(F.get("titles", F.when(swap, F.lit(1 - i)).otherwise(F.lit(i))), 1, 200)
    edition = F.coalesce(F.regexp_replace(_group(QUOTE, F.col("text"), 3), " +", ""), F.col("revision"))
    return rows.select("manual_id", "page", F.coalesce(richer, "key").alias("citation_key"), "doc_code", edition.alias("edition"), "kind", "procedure_no", "plate_no", "printed", at(0).alias("component_title"), at(1).alias("action_title"))


def primary_citation(key: Column, plate: Column, procedure: Column, doc: Column, edition: Column) -> Column:
    """What a page wants to be quoted as, with its edition."""
    return F.concat_ws(" Ed.", F.coalesce(key, plate, procedure, doc), F.when(F.coalesce(key, plate, procedure, doc).isNotNull(), edition))


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, "‎", ""), "[\r\n]", " "))


def is_junk(title: Column) -> Column:
    """A bookmark that is a file's path."""
    low = F.lower(title)
    return low.contains(".pdf") | low.rlike(r"^[a-z]:\\") | (F.size(F.split(title, r"\\")) > 2) | (F.size(F.split(title, "/")) > 3)


def chapter_of_path(title: Column) -> Column:
    number = F.coalesce(_group(r"(?i)([0-9]{3})_vol[0-9]", title, 1), _group(r"(?i)chapter\s+([0-9]{1,3})", title, 1))
    return F.when(number.isNotNull(), F.concat(F.lit("Chapter "), number))


def bookmark_sections(toc: DataFrame) -> DataFrame:
    """Sections from bookmarks: paths of files become chapters, carried on to what follows. toc: manual_id, pos, title, page."""
    t = toc.withColumn("title", clean_title(F.col("title"))).where("title <> ''").withColumn("junk", is_junk(F.col("title")))
    t = t.withColumn("named", F.when(F.col("junk"), chapter_of_path(F.col("title"))))
    t = carry.last_known(t, ["manual_id"], ["pos"], {"chapter": F.col("named")}).where("not junk or named is not null")
    first = _group(BOOKMARK, F.col("title"), 1)
    code = F.when(~F.col("junk") & letter_kind(first).isNotNull(), first)
    rest = F.nullif(F.regexp_replace(F.regexp_extract("title", BOOKMARK, 3), "^[ _\t-]+|[ _\t-]+$", ""), F.lit(""))
    title = F.when(F.col("junk"), F.col("named")).when(code.isNotNull(), F.coalesce(rest, "title")).otherwise(F.col("title"))
    rows = t.select("manual_id", "pos", "junk", "chapter", title.alias("title"), F.greatest("page", F.lit(1)).alias("page_start"), code.alias("doc_code"), F.when(code.isNotNull(), _group(BOOKMARK, F.col("title"), 2)).alias("edition"))
    path = F.when(F.col("junk") | F.col("chapter").isNull(), F.col("title")).otherwise(F.concat_ws("/", "chapter", "title"))
    kind = F.when(F.col("junk"), "other").otherwise(section_kind(F.col("doc_code"), F.col("title")))
    return rows.select("manual_id", "pos", path.alias("path"), "title", "page_start", F.lit(None).cast("int").alias("page_end"), "doc_code", "edition", kind.alias("kind"))


def merged_sections(found: DataFrame, meta: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Bookmark sections with what pages' codes add: editions and kinds, sections of codes that no bookmark has (under the chapter of their page), last pages, one row a path.

    meta: manual_id, page, doc_code, edition, kind; page_counts: manual_id, pages.
    """
    codes = meta.where("doc_code is not null").groupBy("manual_id", "doc_code").agg(F.min("page").alias("at"), F.min_by("edition", F.when(F.col("edition").isNotNull(), F.col("page"))).alias("own_edition"), F.min_by("kind", "page").alias("own_kind"))
    rows = found.join(codes.drop("at"), ["manual_id", "doc_code"], "left")
    rows = rows.withColumn("edition", F.coalesce("edition", "own_edition")).withColumn("kind", F.when((F.col("kind") == "other") & F.col("own_kind").isNotNull(), F.col("own_kind")).otherwise(F.col("kind"))).drop("own_edition", "own_kind")
    unseen = codes.join(found.select("manual_id", "doc_code"), ["manual_id", "doc_code"], "left_anti")
    # the chapter of a page: the last path of one step that begins no later, by order and without an inequality join
    marks = found.where("not path like '%/%'").select("manual_id", F.col("page_start").alias("at"), F.lit(0).alias("side"), "pos", F.col("title").alias("chapter"), *[F.lit(None).cast("string").alias(c) for c in ("doc_code", "own_edition", "own_kind")])
    asked = unseen.select("manual_id", "at", F.lit(1).alias("side"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("chapter"), "doc_code", "own_edition", "own_kind")
    placed = carry.last_known(marks.unionByName(asked), ["manual_id"], ["at", "side", "pos"], {"chapter": F.col("chapter")}).where("side = 1")
    added = placed.select("manual_id", F.lit(1 << 30).alias("pos"), F.concat_ws("/", "chapter", "doc_code").alias("path"), F.col("doc_code").alias("title"), F.col("at").alias("page_start"), F.col("at").alias("page_end"), "doc_code", F.col("own_edition").alias("edition"), F.col("own_kind").alias("kind"))
    every = rows.select(added.columns).unionByName(added)
    ends = section_ends(every.withColumnRenamed("page_end", "given"), F.lit(None).cast("int")).join(page_counts, "manual_id", "left")
    ends = ends.withColumn("page_end", F.coalesce("given", "page_end", "pages").cast("int")).drop("given", "pages")
    order = F.struct("page_start", F.size(F.split("path", "/")).alias("depth"), "pos")
    some = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return ends.groupBy("manual_id", "path").agg(F.min_by("title", order).alias("title"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), some("doc_code"), some("edition"), F.min_by("kind", order).alias("kind"))


def attached(sections: DataFrame, meta: DataFrame) -> DataFrame:
    """Sections with the first citation, numbers and titles that their pages have; the range join is an equality on page."""
    wanted = ["procedure_no", "plate_no", "component_title", "action_title", "citation_key"]
    pages = sections.select("manual_id", "path", F.explode(F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start")))).alias("page"))
    first = pages.join(meta.select("manual_id", "page", F.col("edition").alias("page_edition"), *wanted), ["manual_id", "page"])
    first = first.groupBy("manual_id", "path").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c) for c in ("page_edition", *wanted)])
    return sections.join(first, ["manual_id", "path"], "left").withColumn("edition", F.coalesce("edition", "page_edition")).drop("page_edition")


def extract_sections(toc: DataFrame, pages: DataFrame, spans: DataFrame, conventions: DataFrame) -> DataFrame:
    """All sections of manuals, from bookmarks, page codes and headers."""
    meta = page_meta(pages, spans, conventions)
    counts = pages.groupBy("manual_id").agg(F.max("page").alias("pages"))
    return attached(merged_sections(bookmark_sections(toc), meta, counts), meta)


def selected(pages: DataFrame, spec: str | None = None, limit: int | None = None) -> DataFrame:
    """Pages of a specification such as "1-20,405", else up to a limit, else all."""
    if spec:
        ranges = [p.strip().split("-", 1) for p in spec.split(",") if p.strip()]
        return pages.where(T.any_of([F.col("page").between(int(r[0]), int(r[-1])) for r in ranges]))
    return pages.where(F.col("page") <= limit) if limit else pages


def text_layer(pages: DataFrame) -> DataFrame:
    """Without a layout service: each page's text as one paragraph. pages: manual_id, page, text."""
    text = F.trim(T.control_to_dash(F.col("text")))
    return pages.where(text != "").select("manual_id", "page", F.lit("paragraph").alias("type"), text.alias("text"), F.lit("text_layer").alias("extractor"))


def first_line(text: Column, most: int = 240) -> Column:
    return F.substring(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), 1, most)


def guessed_caption(text: Column) -> Column:
    """The first line that names a figure, plate or the like, else the first line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "^[#* ]+", ""))), lambda x: x != "")
    named = F.get(F.filter(lines, lambda x: x.rlike("(?i)^(fig(ure|\\.)?|plate|drawing|diagram)([^a-z]|$)")), F.lit(0))
    return F.substring(F.coalesce(named, F.get(lines, F.lit(0))), 1, 240)


def boxes_of(value: Column) -> Column:
    """A box as four numbers, from {"l","t","r","b"} or {"x0","y0","x1","y1"}, rounded to two digits; null if it is neither."""
    names = (("l", "x0"), ("t", "y0"), ("r", "x1"), ("b", "y1"))
    own = [F.bround(F.coalesce(*[F.get_json_object(value, f"$.{n}").cast("double") for n in pair]), 2) for pair in names]
    return F.when(F.forall(F.array(*own), lambda x: x.isNotNull()), F.array(*own))


def ocr_elements(answers: DataFrame) -> DataFrame:
    """An OCR service's answer as elements and always one figure a page: typed blocks, else the paragraphs of its markdown.

    answers: manual_id, page, answer ({"blocks": [{"type", "content", "bbox"}], "markdown"}).
    """
    p = answers.select("manual_id", "page", F.from_json("answer", "blocks array<struct<type:string,content:string,bbox:string>>, markdown string").alias("a"))
    blocks = F.coalesce("a.blocks", F.array().cast("array<struct<type:string,content:string,bbox:string>>"))
    kind = lambda t: F.when(t.isin("title", "section_header"), "heading").when(t.isin("list", "list_item"), "list").when(t == "table", "table").when(t == "caption", "caption").otherwise("paragraph")
    typed = p.where(F.size(blocks) > 0).select("manual_id", "page", F.posexplode(blocks).alias("nth", "b")).where(F.trim("b.content") != "")
    typed = typed.select("manual_id", "page", "nth", kind(F.col("b.type")).alias("type"), F.trim("b.content").alias("text"), boxes_of(F.col("b.bbox")).alias("bbox"))
    plain = p.where((F.size(blocks) == 0) & F.col("a.markdown").isNotNull()).select("manual_id", "page", F.posexplode(F.split("a.markdown", "\n[ \t]*\n")).alias("nth", "t")).where(F.trim("t") != "")
    heading, item = F.col("t").rlike("^[ \n]*#"), F.col("t").rlike("^[ \n]*([-*]|[0-9]{1,2}[.)]) ")
    none = F.lit(None).cast("array<double>")
    plain = plain.select("manual_id", "page", "nth", F.when(heading, "heading").when(item, "list").when(F.col("t").rlike(r"^[ \n]*\|"), "table").otherwise("paragraph").alias("type"), F.trim(F.regexp_replace("t", "^[ \n]*#+ *", "")).alias("text"), none.alias("bbox"))
    figure = p.select("manual_id", "page", F.lit(1 << 20).alias("nth"), F.lit("figure").alias("type"), F.coalesce(guessed_caption(F.col("a.markdown")), F.concat(F.lit("Page "), F.col("page").cast("string"))).alias("text"), none.alias("bbox"))
    return typed.unionByName(plain).unionByName(figure)


def manual_identity(files: DataFrame) -> DataFrame:
    """Title, manufacturer, model and id of each file. files: manual_id, stem, pdf_title, author, first_page."""
    stem_title = F.coalesce(F.nullif(F.trim(F.regexp_replace("stem", "[-_]+", " ")), F.lit("")), F.col("stem"))
    given = F.trim(F.coalesce("pdf_title", F.lit("")))
    title = F.when((F.char_length(given) > 3) & ~F.lower(given).endswith(".pdf"), given).otherwise(stem_title)
    blob = F.regexp_replace(F.upper(F.concat_ws(" ", title, "stem", F.substring("first_page", 1, 2000))), "([^A-Z0-9-])", "$1$1")
    hits = F.regexp_extract_all(blob, F.lit(r"(?:^|[^A-Z0-9_])([A-Z]{1,3}[0-9]{2,5}[A-Z]{1,8}(?:-[A-Z0-9]+)?|[0-9]{1,2}[A-Z][0-9]{1,4}[A-Z]{1,8}(?:-[A-Z0-9]+)?)(?:[^A-Z0-9_]|$)"), F.lit(1))
    units = [u.upper() for u in (*config.UNITS, "kpa", "mpa", "rpm", "deg")]
    letters = lambda h: F.regexp_replace(h, "[^A-Z]", "")
    model = F.get(F.filter(hits, lambda h: (F.char_length(letters(h)) >= 2) & ~letters(h).isin(*units)), F.lit(0))
    slug = F.nullif(F.substring(F.upper(F.regexp_replace(F.regexp_replace("stem", "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")), 1, 80), F.lit(""))
    return files.select("manual_id", F.substring(title, 1, 300).alias("title"), F.nullif(F.substring(F.trim("author"), 1, 200), F.lit("")).alias("manufacturer"), F.substring(F.coalesce(model, title), 1, 80).alias("model"), F.coalesce(slug, F.lit("INGESTED-MANUAL")).alias("equipment_id"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files below a folder with their page counts, from the page objects that a file names; null for what is no PDF or keeps them packed.

    Reading pages' text is a service's work; page texts enter the other operators as a column.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    body = F.decode("content", "ISO-8859-1")
    count = F.regexp_count(body, F.lit(r"/Type\s*/Page[^s]"))
    return raw.select("path", "length", F.when(F.substring(body, 1, 5) == "%PDF-", F.nullif(count, F.lit(0))).alias("pages"))


def chapter_marks(sections: DataFrame) -> DataFrame:
    """Sections of one step, in order, as chapters of their manual."""
    return top(sections.where("not path like '%/%'"), ["manual_id", "path"], ["page_start"], 1).select("manual_id", F.col("page_start").alias("page"), F.col("title").alias("chapter"))
