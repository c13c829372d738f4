"""Scalar text functions as Column expressions: all run inside the JVM, none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where value stands in the plan once however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def control_to_dash(text: Column) -> Column:
    """Control bytes other than tab and line ends become a dash."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "-")


def squeezed(text: Column) -> Column:
    """NUL dropped, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"[ \t\r\n]+", " "))


def edition_key(edition: Column) -> Column:
    return F.upper(F.regexp_replace(edition, "[^A-Za-z0-9]", ""))


def named_edition(query: Column) -> Column:
    """The edition a question names, normalised; null if none. A word that only ends like "ed." names none."""
    return edition_key(F.nullif(F.regexp_extract(F.lower(query), r"(?:^|[^a-z0-9])(?:edition|revision|rev\.?|ed\.?) +([a-z]?[0-9]+[a-z]?)", 1), F.lit("")))


def codes_in(text: Column, pattern: str) -> Column:
    """All codes of a grammar in a text, upper case, that stand by themselves: no letter, digit or underscore touches them.

    Separators are doubled first, as one ends a code and begins the next.
    """
    wide = F.regexp_replace(F.upper(text), "([ ,;:()/\n])", "$1$1")
    return F.regexp_extract_all(wide, F.lit(f"(?:^|[^A-Z0-9_])({pattern})(?:[^A-Z0-9_]|$)"), F.lit(1))


def identifiers(query: Column) -> Column:
    """Procedure numbers, drawing codes, then letter-digit codes, each once in order. Of the text only what has a digit between blanks is looked at, once for all."""
    parts = F.array_join(F.filter(F.split(query, " "), lambda w: w.rlike("[0-9]")), " ")
    return let(parts, lambda x: F.array_distinct(F.concat(*[codes_in(x, p) for p in (config.PROCEDURE_PATTERN, config.DRAWING_PATTERN, config.DOC_CODE_PATTERN)])))


def procedure_stem(number: Column) -> Column:
    return F.regexp_extract(number, r"^([0-9]{3}-[0-9]+)", 1)


def component_stem(title: Column) -> Column:
    """Lower case without a trailing action word."""
    return F.trim(F.regexp_replace(F.lower(title), rf"[ ,-]+({'|'.join(config.ACTION_WORDS)})$", ""))


def code_key(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))


def text_key(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def singular(token: Column) -> Column:
    n = F.char_length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("ses"), F.substr(token, F.lit(1), n - 2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substr(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def content_tokens(query: Column) -> Column:
    """Words and numbers that carry content: no stopwords, three letters at least unless a data word, singular, each once."""
    raw = F.regexp_extract_all(F.lower(F.regexp_replace(query, ",", "")), F.lit(r"([a-z][a-z0-9]*|[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    number = lambda t: t.rlike(r"^[0-9]")
    stop, data = F.array(*map(F.lit, config.STOPWORDS)), F.array(*map(F.lit, config.DATA_WORDS))
    # stopwords go by a set of them, not one after the other a token
    kept = F.filter(F.array_except(raw, stop), lambda t: F.when(number(t), t.contains(".") | (F.char_length(t) >= 2)).otherwise((F.char_length(t) >= 3) | F.array_contains(data, t)))
    stems = F.transform(kept, lambda t: F.when(number(t), t).otherwise(singular(t)))
    return F.array_except(stems, stop)


def phrases(tokens: Column) -> Column:
    """Eight bigrams, then skip-grams (first of five letters, other of three at least), the other bigrams, trigrams."""
    return let(tokens, _phrases)


def _phrases(tokens: Column) -> Column:
    n = F.size(tokens)
    upto = lambda k: F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(tokens, i)
    two = F.transform(upto(2), lambda i: F.concat_ws(" ", at(i), at(i + 1)))
    skip = F.transform(F.filter(upto(3), lambda i: (F.char_length(at(i)) >= 5) & (F.char_length(at(i + 2)) >= 3)), lambda i: F.concat_ws(" ", at(i), at(i + 2)))
    three = F.transform(upto(3), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2)))
    return let(two, lambda pairs: F.concat(F.slice(pairs, 1, 8), skip, F.slice(pairs, 9, 1000), three))


def or_terms(tokens: Column) -> Column:
    """The first ten tokens, letters and digits only, of three characters at least."""
    return F.filter(F.transform(F.slice(tokens, 1, 10), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")), lambda t: F.char_length(t) >= 3)


def kind_of(code: Column, title: Column) -> Column:
    """Section kind from a code's first letter, else from words of the title."""
    first, low = F.upper(F.substr(code, F.lit(1), F.lit(1))), F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(first == "D", "data").when(first.isin("M", "A"), "procedure").when(first == "P", "plate")
        .when(low.rlike("schedule|interval"), "schedule").when(low.rlike("data|specification"), "data")
        .when(low.rlike("plate|drawing"), "plate").when(low.rlike("checking|dismantling|mounting|overhaul|procedure"), "procedure").otherwise("other")
    )


def chapter_family(code: Column) -> Column:
    """The first three digits of a code; of data codes in the hundreds, the nine hundreds."""
    digits = F.regexp_extract(code, r"([0-9]{3})", 1)
    return F.when(code.rlike("^D1[0-9]{2}"), F.concat(F.lit("9"), F.substr(digits, F.lit(2), F.lit(2)))).otherwise(digits)


def code_tail(code: Column) -> Column:
    """The last four digits of a code."""
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.when(F.char_length(digits) >= 4, F.right(digits, F.lit(4)))


def leading_step(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^ *([0-9]{1,2})\. ", 1), F.lit("")).cast("int")


def citation_ref(plate: Column, procedure: Column, key: Column, doc: Column, edition: Column, page: Column, label: Column | None = None) -> Column:
    """Label, the first of plate, procedure, key and document code, and the edition; else the page."""
    plate, procedure, key, doc = map(blank_to_null, (plate, procedure, key, doc))
    word = F.when(plate.isNotNull(), "Plate").otherwise(F.coalesce(label, F.lit("Procedure")) if label is not None else F.lit("Procedure"))
    number = F.coalesce(plate, procedure, key, doc)
    return F.when(number.isNotNull(), F.concat_ws(" ", word, number, F.when(blank_to_null(edition).isNotNull(), F.concat(F.lit("edition "), edition)))).otherwise(F.concat(F.lit("page "), page.cast("string")))


def row_text(text: Column, table_json: Column) -> Column:
    """The text, or else the table's cells, cut to 2000 characters."""
    return F.substring(whole_row_text(text, table_json), 1, 2000)


def whole_row_text(text: Column, table_json: Column) -> Column:
    """The text, or else the table's cells."""
    return F.coalesce(blank_to_null(text), table_cells(table_json))


def table_cells(table_json: Column) -> Column:
    """The "text" of a table's cells in the order in which they stand, however deep, without repeats in a row, joined by bars; null for what is no JSON."""
    quoted = F.regexp_extract_all(table_json, F.lit(r'"text"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    texts = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    cells = F.filter(F.transform(texts, lambda c: F.trim(c)), lambda t: t.isNotNull() & (t != ""))
    joined = let(cells, lambda x: F.array_join(F.filter(x, lambda t, i: (i == 0) | (t != F.get(x, i - 1))), " | "))
    return F.when(F.from_json(table_json, "map<string,string>").isNotNull() | F.from_json(table_json, "array<string>").isNotNull(), blank_to_null(joined))


def json_object(answer: Column, schema: str) -> Column:
    """The outermost object of a service's answer, fences or not; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def models_agree(a: Column, b: Column) -> Column:
    """One normalised name in the other, or five characters in a row in common; an empty one agrees with all."""
    x, y = F.lower(F.regexp_replace(F.coalesce(a, F.lit("")), "[^A-Za-z0-9]", "")), F.lower(F.regexp_replace(F.coalesce(b, F.lit("")), "[^A-Za-z0-9]", ""))
    return let(F.struct(x.alias("x"), y.alias("y")), lambda names: _agree(names["x"], names["y"]))


def _agree(x: Column, y: Column) -> Column:
    shared = F.when(F.char_length(x) >= 5, F.exists(F.sequence(F.lit(1), F.char_length(x) - 4), lambda i: y.contains(F.substr(x, i, F.lit(5))))).otherwise(F.lit(False))
    return (x == "") | (y == "") | x.contains(y) | y.contains(x) | shared


def equipment_token(query: Column) -> Column:
    """A model-like word (two letters or more, then digits) that is no unit."""
    found = F.regexp_extract_all(F.upper(query), F.lit(r"([A-Z]{2,}[0-9]+[A-Z0-9]*)"), F.lit(1))
    return F.get(F.filter(found, lambda t: ~F.lower(F.regexp_replace(t, "[0-9]", "")).isin(*config.UNITS)), F.lit(0))


def control_ratio(text: Column) -> Column:
    """Share of control characters in the first 4000."""
    head = F.substring(text, 1, 4000)
    n = F.char_length(head)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))) / n).otherwise(F.lit(0.0))


def contained(blob: Column, tokens: Column) -> Column:
    """How many tokens are substrings of the blob."""
    return F.size(F.filter(tokens, lambda t: blob.contains(t)))


def number_units(text: Column) -> Column:
    """Numbers with their units, lower case and without the blanks between them."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([0-9]+(?:\.[0-9]+)? *(?:{'|'.join(config.UNITS)}))(?:[^a-z]|$)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


# What a verdict compares with.
_SOURCES = "sheet|recorded|fitted|original|reference"


def intent(query: Column) -> Column:
    """What a question wants, from the keyword tables: a struct of tokens, codes and flags.

    A verdict needs data and a procedure; a named code makes each of these two imply the other; "which" with data asks for a verdict.
    """
    return let(F.struct(query.alias("text"), F.lower(query).alias("low"), content_tokens(query).alias("tokens"), identifiers(query).alias("codes")), _intent)


def _intent(q: Column) -> Column:
    low, tokens = q["low"], q["tokens"]
    table = lambda words: F.array(*map(F.lit, words))
    has = lambda words: F.arrays_overlap(tokens, table(words))
    figure = any_of([low.contains(w) for w in (*config.FIGURE_WORDS, "show me", "show the")]) | F.upper(q["text"]).rlike(f"{config.PLATE_PATTERN}|{config.DRAWING_PATTERN}")
    gap = "[^a-z](?:.{0,46}[^a-z])?"
    decide = has(config.DECISION_WORDS) | low.rlike(rf"(?:^|[^a-z])(?:(?:above|below){gap}(?:{_SOURCES})|(?:{_SOURCES}){gap}(?:above|below))(?:[^a-z]|$)")
    first = F.struct(
        decide.alias("decide"), (has(config.DATA_WORDS) | low.rlike(rf"[0-9] *({'|'.join(config.UNITS)})([^a-z]|$)")).alias("data"), (has(config.SCHEDULE_WORDS) | low.rlike(r"[0-9] *(h|hours)([^a-z]|$)")).alias("schedule"),
        F.array_intersect(tokens, table(config.PROCEDURE_WORDS)).alias("work"), F.exists(q["codes"], lambda c: c.rlike(f"^(?:{config.DOC_CODE_PATTERN}|{config.PROCEDURE_PATTERN})$")).alias("named"), low.rlike("(^|[^a-z])which([^a-z]|$)").alias("which"),
    )

    def second(f: Column) -> Column:
        asked = low.startswith("how ") | has(config.ACTION_TOKENS) | ~f["data"] | (F.size(F.array_except(f["work"], table(config.FITTING_TOKENS))) > 0)
        return F.struct(f["decide"].alias("decide"), (f["data"] | f["decide"]).alias("data"), (f["decide"] | ((F.size(f["work"]) > 0) & asked)).alias("proc"), f["schedule"].alias("schedule"), f["named"].alias("named"), f["which"].alias("which"))

    def third(f: Column) -> Column:
        proc = f["proc"] | (f["named"] & f["data"])
        return F.struct(f["decide"].alias("decide"), (f["data"] | (f["named"] & proc)).alias("data"), proc.alias("proc"), f["schedule"].alias("schedule"), f["which"].alias("which"))

    component = F.filter(tokens, lambda t: ~F.array_contains(table(config.DATA_WORDS), t) & ~F.array_contains(table(config.PROCEDURE_WORDS), t))

    def last(f: Column) -> Column:
        which = f["which"] & f["data"]
        return F.struct(tokens.alias("tokens"), component.alias("component_tokens"), q["codes"].alias("codes"), figure.alias("wants_figure"), f["data"].alias("wants_data"), (f["proc"] | which | f["schedule"]).alias("wants_proc"), (f["decide"] | which).alias("wants_decision"), f["schedule"].alias("wants_schedule"))

    return let(first, lambda a: let(second(a), lambda b: let(third(b), last)))
