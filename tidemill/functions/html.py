"""Web pages as typed elements in reading order: headings, list items, tables as grids, paragraphs. Column expressions, linear in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Tags that begin or end a block, and named entities, as HTML has them.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "ul")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
TABLE = r"(?is)(<table\b.*?</table\s*>)"
BLOCK = rf"(?i)(</?(?:{'|'.join(BLOCKS)})\b[^>]*>)"


def _numbered(piece: Column) -> Column:
    """What follows "&#": a character by its number, else left as it stands."""
    number = F.regexp_extract(piece, "^([0-9]{1,7});", 1)
    n = F.nullif(number, F.lit("")).cast("int")
    known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    sign = F.decode(F.unhex(F.lpad(F.hex(F.when(known, n).otherwise(32)), 8, "0")), "UTF-32")
    return F.when(known, F.concat(sign, F.substr(piece, F.char_length(number) + 2))).otherwise(F.concat(F.lit("&#"), piece))


def seen_text(html: Column) -> Column:
    """The text of a piece of HTML: tags gone (a line break is a blank), entities read, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\b[^>]*>", " "), r"</?[A-Za-z!][^>]*>", "")
    for entity, sign in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    bare = let(F.split(bare, "&#", -1), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, 2**30), _numbered), "")))
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), r"[ \t\r\n\x{A0}]+", " "))


def grid(table: Column) -> Column:
    """A table's cells as JSON, row by row."""
    after = lambda x, tag: F.slice(F.split(x, rf"(?i)<{tag}\b[^>]*>", -1), 2, 2**30)
    rows = F.transform(after(table, "tr"), lambda r: F.transform(after(r, "t[dh]"), lambda c: F.struct(seen_text(c).alias("text"))))
    return F.to_json(F.struct(rows.alias("grid")))


def elements(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns, pos (from 0 in reading order, with gaps), type, level (of headings), text, table_json.

    A block tag, opening or closing, ends what came before it, so tags that are never closed do no harm; text after a closing tag is a
    paragraph. A table is one element, with the text of its cells as JSON and no text of its own; one in another is read as its rows.
    Scripts, styles, comments and the head are left out. Blocks without text give no row, nor does a null or empty page.
    """
    # separators are control characters, which a page may not hold; those it holds become blanks
    clean = F.regexp_replace(F.regexp_replace(F.col(html), r"[\x01\x02\x03]", " "), UNSEEN, "")
    parts = F.split(F.regexp_replace(clean, TABLE, "\x02\x03$1\x02"), "\x02", -1)
    pieces = F.flatten(F.transform(parts, lambda p: F.when(p.startswith("\x03"), F.array(p)).otherwise(F.split(F.regexp_replace(p, BLOCK, "\x01$1"), "\x01", -1))))
    rows = pages.select(*keep, F.posexplode(pieces).alias("pos", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^<([A-Za-z0-9]+)", 1))
    is_table = F.col("piece").startswith("\x03")
    kind = F.when(is_table, "table").when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").otherwise("paragraph")
    text = F.when(~is_table, seen_text(F.col("piece")))
    out = rows.select(*keep, "pos", kind.alias("type"), F.when(tag.rlike("^h[1-6]$"), F.substr(tag, F.lit(2)).cast("int")).alias("level"), text.alias("text"), F.when(is_table, grid(F.col("piece"))).alias("table_json"))
    return out.where((F.col("type") == "table") | (F.col("text") != ""))
