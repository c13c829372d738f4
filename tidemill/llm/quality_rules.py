"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of
each reference language by Jensen-Shannon distance (base 2, square root, 0 to 1). The references
are counted over all documents of a language. A text is kept if some language is near enough in
both histograms. Below ``min_words`` words the common-word histogram says too little, and below
``min_chars`` characters the other one, so each is then passed over. The guards follow from the noise of a
histogram: one of k classes from n independent words lies about sqrt((k - 1) / (8 n ln 2)) from its source by chance
alone. For a language's eight common words and the rest that is 0.22 at 30 words, close to the limit of
0.26, and 0.15 at 60; for the seven classes of characters, which come in words, 0.25 in 100 characters (17 words), the
limit itself, and 0.15 in 300 (50 words).

Nulls and edges: a null or empty text has no words, fails the base rule and is not kept; a
document whose lang is null or not listed counts towards the reference ``other`` (compared like
the rest); repeated rows each get a row; on an empty table the result is empty; only doc_id, text
and lang are read, so further columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, whole, words_of, written

# Frequent short words of four languages, lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "de": ["der", "die", "und", "den", "das", "von", "ist", "mit"],
    "fr": ["le", "les", "des", "et", "que", "qui", "pour", "un"],
    "es": ["el", "los", "las", "y", "por", "con", "una", "se"],
}
# The character classes, in the order in which they are taken from a text.
CHAR_CLASSES = {
    "lower": "[a-z]+",
    "space": f"[{SPACE}]+",
    "upper": "[A-Z]+",
    "beyond": r"[^\x00-\x7F]+",
    "digit": "[0-9]+",
    "mark": r"""[.,;:!?'"()\-]+""",
}
SYMBOLS = "[#*$%&|<>]+"
OTHER = "other"


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules; the two limits are Jensen-Shannon distances."""

    char_limit: float = 0.25
    word_limit: float = 0.26
    min_words: int = 60
    min_chars: int = 300
    base_words: int = 10
    base_repeat_percent: int = 20


def _listed() -> list[str]:
    return [w for words in COMMON_WORDS.values() for w in words]


def _repeated_words(hashes: Column) -> Column:
    """Words in 5-word windows whose content comes twice or more, from the hashes of the words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            twice = F.filter(F.transform(s, lambda x, i: F.when(same(i, i + 1) | same(i, i - 1), x["i"])), lambda i: i.isNotNull())
            gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), add)
            return let(F.array_sort(twice), gaps)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, starts))

    return F.when(F.size(hashes) < 6, F.lit(0)).otherwise(let(windows, covered))


def document_counts(docs: DataFrame) -> DataFrame:
    """Per document the counts that rules and references are made of, in one pass and without a shuffle.

    c.chars: one count per character class, then the rest; w.commons: one per listed word, then the other words.
    The structs are taken apart only after they are written: a projection over them would count anew for each field.
    """
    listed = _listed()
    docs = whole(docs, {"doc_id": "long", "text": "string", "lang": "string"})

    def of_characters(text: Column, left: list[Column], todo: list[str]) -> Column:
        if todo:
            return let(F.regexp_replace(left[-1], todo[0], ""), lambda rest: of_characters(text, [*left, rest], todo[1:]))
        sizes = [F.char_length(x).cast("long") for x in left]
        counts = [a - b for a, b in zip(sizes, sizes[1:], strict=False)]
        spaceless = left[2]  # after letters and white space went; no symbol did
        return F.struct(
            F.array(*counts, sizes[-1]).alias("chars"),
            (sizes[0] - counts[1]).alias("word_chars"),
            (F.char_length(spaceless) - F.char_length(F.regexp_replace(spaceless, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )

    def of_words(words: Column) -> Column:
        n = F.size(words)
        place = F.array(*[F.lit(w) for w in listed])
        # each listed word as one letter: then a count is a difference of lengths
        letters = F.array_join(F.transform(words, lambda w: F.when(F.char_length(w) <= max(map(len, listed)), F.char(F.array_position(place, F.lower(w)) + 64))), "")

        def histogram(s: Column) -> Column:
            counts = [(F.char_length(s) - F.char_length(F.replace(s, F.lit(chr(65 + k)), F.lit("")))).cast("long") for k in range(len(listed))]
            return let(F.array(*counts), lambda c: F.concat(c, F.array(n.cast("long") - F.aggregate(c, F.lit(0).cast("long"), add))))
        return F.struct(
            n.cast("long").alias("n_words"),
            let(F.transform(words, lambda w: F.xxhash64(w)), _repeated_words).cast("long").alias("n_repeat_words"),
            let(letters, histogram).alias("commons"),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return docs.select(
        "doc_id",
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(OTHER).alias("lang"),
        let(text, lambda t: of_characters(t, [t], list(CHAR_CLASSES.values()))).alias("c"),
        let(words_of(F.col("text")), of_words).alias("w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def references(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of character classes and common words by language, over all documents.

    At most one row per listed language and one for the rest comes to the driver.
    """
    n_chars, n_commons = len(CHAR_CLASSES) + 1, len(_listed()) + 1
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(n_chars)] + [F.sum(F.get("commons", F.lit(k))).alias(f"w{k}") for k in range(n_commons)]
    out = {}
    for row in counts.groupBy("lang").agg(*sums).collect():
        chars, commons = [row[f"c{k}"] or 0 for k in range(n_chars)], [row[f"w{k}"] or 0 for k in range(n_commons)]
        if sum(chars) and sum(commons):
            out[row["lang"]] = ([x / sum(chars) for x in chars], [x / sum(commons) for x in commons])
    return out


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """The distance between an array of counts and an array of shares; 0 where there are no counts."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    both = lambda p, q: let((p + q) / 2, lambda m: term(p, m) + term(q, m))
    total = F.aggregate(counts, F.lit(0).cast("long"), add)
    far = lambda n: F.aggregate(F.zip_with(counts, shares, lambda c, q: both(c / n, q)), F.lit(0.0), add) / 2
    return let(total, lambda n: F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), far(n)))).otherwise(0.0))


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per document the base counts, both distances to the nearest language, and the verdicts."""
    counts = written(document_counts(docs), "quality").select("doc_id", "lang", "c.*", "w.*", "n_dup_lines")
    near = []
    for chars, commons in (x[1] for x in sorted(references(counts).items())):
        far_c = jensen_shannon(F.col("chars"), F.array(*map(F.lit, chars)))
        far_w = jensen_shannon(F.col("commons"), F.array(*map(F.lit, commons)))
        far_c = F.when(F.col("word_chars") >= rules.min_chars, far_c).otherwise(0.0)
        far_w = F.when(F.col("n_words") >= rules.min_words, far_w).otherwise(0.0)
        near.append(let(F.struct(far_c.alias("c"), far_w.alias("w")), lambda x: F.struct(F.greatest(x["c"] / rules.char_limit, x["w"] / rules.word_limit).alias("ratio"), x["c"].alias("char_distance"), x["w"].alias("word_distance"))))
    best = F.array_min(F.array(*near)) if near else F.lit(None).cast("struct<ratio:double,char_distance:double,word_distance:double>")
    failed = (F.col("n_words") < rules.base_words) | (100 * F.col("n_repeat_words") > rules.base_repeat_percent * F.col("n_words"))
    return counts.withColumn("best", best).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("best.ratio") <= 1, F.lit(True))).alias("kept"),
        F.col("best.char_distance").alias("char_distance"),
        F.col("best.word_distance").alias("word_distance"),
    )

