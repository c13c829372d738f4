"""The stem of an English word, as a Column: the published suffix rules of the Porter2 (Snowball English) stemmer.

A word is lower-case letters and digits. Every step looks for the longest suffix of its table and applies it where
its condition holds; a longer suffix whose condition fails keeps shorter ones from being tried. Stems are meant to be
made once a distinct word, not once an occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tables of the published algorithm.
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
#: Suffix, what takes its place, and the region it has to lie in.
STEP_2 = (
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
)
STEP_3 = (("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where value is evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _cut(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.char_length(w) - n)


def _region(w: Column) -> Column:
    """What follows the first letter that isn't a vowel and comes after one."""
    return F.regexp_extract(w, f"^.*?{VOWEL}{OTHER}(.*)$", 1)


def _starts(w: Column) -> Column:
    """(w, r1, r2): the word with its two regions; regions are suffixes, so a suffix lies in one that is as long at least."""
    r1 = F.coalesce(F.nullif(F.regexp_extract(w, f"^(?:{'|'.join(PREFIXES)})(.*)$", 1), F.lit("")), _region(w))
    r1 = F.when(F.array_contains(F.array(*map(F.lit, PREFIXES)), w), F.lit("")).otherwise(r1)
    return _let(r1, lambda r: F.struct(w.alias("w"), F.char_length(r).alias("r1"), F.char_length(_region(r)).alias("r2"), F.char_length(w).alias("n")))


class _Word:
    """A word between two steps; p1 and p2 are where its regions begin, which no step moves."""

    def __init__(self, s: Column):
        self.s, self.w, self.p1, self.p2 = s, s["w"], s["n"] - s["r1"], s["n"] - s["r2"]
        self.size = F.char_length(self.w)

    def r1(self, n: int) -> Column:
        return self.size - n >= self.p1

    def r2(self, n: int) -> Column:
        return self.size - n >= self.p2

    def becomes(self, w: Column) -> Column:
        return F.struct(w.alias("w"), self.s["r1"].alias("r1"), self.s["r2"].alias("r2"), self.s["n"].alias("n"))


def _is_short(w: Column) -> Column:
    """Ends in a short syllable."""
    return w.rlike(f"{OTHER}{VOWEL}[^aeiouywxY]$|^{VOWEL}{OTHER}$")


def _table(x: _Word, rules, region, special: dict[str, Column]) -> Column:
    """The longest suffix decides; special: conditions beyond the region."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        n = len(suffix)
        fits = region(n) & special[suffix] if suffix in special else region(n)
        changed = F.when(fits, F.concat(_cut(x.w, n), F.lit(new)) if new else _cut(x.w, n)).otherwise(x.w)
        ends = x.w.endswith(suffix)
        out = F.when(ends, changed) if out is None else out.when(ends, changed)
    return x.becomes(out.otherwise(x.w))


def _plural(x: _Word) -> Column:
    w = x.w
    ied = F.when(x.size > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    s = F.when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w)
    return x.becomes(F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ied") | w.endswith("ies"), ied).when(w.endswith("us") | w.endswith("ss"), w).when(w.endswith("s"), s).otherwise(w))


def _past(x: _Word) -> Column:
    w, out = x.w, None
    mended = lambda b: (
        F.when(b.endswith("at") | b.endswith("bl") | b.endswith("iz"), F.concat(b, F.lit("e")))
        .when(F.array_contains(F.array(*map(F.lit, DOUBLES)), F.right(b, F.lit(2))), _cut(b, 1))
        .when((F.char_length(b) <= x.p1) & _is_short(b), F.concat(b, F.lit("e"))).otherwise(b)
    )
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        n = len(suffix)
        if suffix.startswith("eed"):
            changed = F.when(x.r1(n), F.concat(_cut(w, n), F.lit("ee"))).otherwise(w)
        else:
            changed = F.when(_cut(w, n).rlike(VOWEL), _let(_cut(w, n), mended)).otherwise(w)
        out = F.when(w.endswith(suffix), changed) if out is None else out.when(w.endswith(suffix), changed)
    return x.becomes(out.otherwise(w))


def _last(x: _Word) -> Column:
    w, b = x.w, _cut(x.w, 1)
    e = F.when(x.r2(1) | (x.r1(1) & ~_is_short(b)), b).otherwise(w)
    ll = F.when(x.r2(1) & w.endswith("ll"), b).otherwise(w)
    return F.when(w.endswith("e"), e).when(w.endswith("l"), ll).otherwise(w)


def _steps(s: Column) -> Column:
    step = lambda f: lambda v: f(_Word(v))
    kept = F.array(*map(F.lit, KEPT_AFTER_PLURAL))

    def rest(v: Column) -> Column:
        y = lambda x: x.becomes(F.regexp_replace(x.w, f"^(.+{OTHER})[yY]$", "$1i"))
        two = lambda x: _table(x, STEP_2, x.r1, {"ogi": x.w.endswith("logi"), "li": x.w.rlike("[cdeghkmnrt]li$")})
        three = lambda x: _table(x, STEP_3, x.r1, {"ative": x.r2(5)})
        four = lambda x: _table(x, [(t, "") for t in STEP_4], x.r2, {"ion": x.w.rlike("[st]ion$")})
        out = _let(v, step(_past))
        for f in (y, two, three, four):
            out = _let(out, step(f))
        return _let(out, step(_last))

    return _let(_let(s, step(_plural)), lambda v: F.when(F.array_contains(kept, v["w"]), v["w"]).otherwise(rest(v)))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters, and null, stay."""
    known = F.create_map(*[F.lit(x) for pair in WHOLE_WORDS.items() for x in pair])
    # a y that begins the word or follows a vowel is none
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y")
    done = F.translate(_steps(_starts(marked)), "Y", "y")
    return F.when(F.char_length(word) <= 2, word).otherwise(F.coalesce(F.try_element_at(known, word), done))
