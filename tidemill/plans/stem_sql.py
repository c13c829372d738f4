"""The stemmer in DuckDB's SQL, step by step over a table of words; only the tables of suffixes are shared with the Columns."""

from __future__ import annotations

from ..functions.stem import DOUBLES, KEPT_AFTER_PLURAL, PREFIXES, STEP_2, STEP_3, STEP_4, WHOLE_WORDS


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _longest(rules: dict[str, tuple[str, str]]) -> str:
    """rules: suffix to (condition, new word)."""
    cases = "\n".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {rules[s][0]} THEN {rules[s][1]} ELSE w END" for s in sorted(rules, key=len, reverse=True))
    return f"CASE {cases} ELSE w END"


def stems(words: str) -> str:
    """Common table expressions that end in ``stems (word, stem)``, of the column word of the relation named."""
    in_r = lambda p, s: f"length(w) - {len(s)} >= {p}"
    put = lambda s, new: f"{_cut('w', len(s))} || '{new}'"
    short = lambda w: f"regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
    two = {s: (in_r("p1", s) + {"ogi": " AND ends_with(w, 'logi')", "li": " AND regexp_matches(w, '[cdeghkmnrt]li$')"}.get(s, ""), put(s, new)) for s, new in STEP_2}
    three = {s: (in_r("p1", s) + (" AND " + in_r("p2", s) if s == "ative" else ""), put(s, new)) for s, new in STEP_3}
    four = {s: (in_r("p2", s) + (" AND regexp_matches(w, '[st]ion$')" if s == "ion" else ""), put(s, "")) for s in STEP_4}
    eed = {s: (in_r("p1", s), put(s, "ee")) for s in ("eed", "eedly")}
    gone = {s: (f"regexp_matches({_cut('w', len(s))}, '[aeiouy]')", _cut("w", len(s)) + " || '+'") for s in ("ed", "edly", "ing", "ingly")}
    prefix = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in PREFIXES)
    return f"""
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM {words}),
s1 AS (SELECT *, CASE {prefix} ELSE coalesce(nullif(length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')), 0), length(w)) END AS p1 FROM s0),
s2 AS (SELECT *, coalesce(nullif(length(regexp_extract(substr(w, p1 + 1), '^.*?[aeiouy][^aeiouy]')), 0) + p1, length(w)) AS p2 FROM s1),
s3 AS (SELECT word, p1, p2, CASE WHEN ends_with(w, 'sses') THEN {_cut('w', 2)} WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut('w', 2)} ELSE {_cut('w', 1)} END
  WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN {_cut('w', 1)} ELSE w END AS w FROM s2),
s4 AS (SELECT word, p1, p2, w AS whole, {_longest(eed | gone)} AS w FROM s3),
s5 AS (SELECT word, p1, p2, whole, rtrim(w, '+') AS w, ends_with(w, '+') AS cut FROM s4),
s6 AS (SELECT word, p1, p2, whole, CASE WHEN NOT cut THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN right(w, 2) IN {_in(DOUBLES)} THEN {_cut('w', 1)} WHEN length(w) <= p1 AND {short('w')} THEN w || 'e' ELSE w END AS w FROM s5),
s7 AS (SELECT word, p1, p2, whole, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM s6),
s8 AS (SELECT word, p1, p2, whole, {_longest(two)} AS w FROM s7),
s9 AS (SELECT word, p1, p2, whole, {_longest(three)} AS w FROM s8),
s10 AS (SELECT word, p1, p2, whole, {_longest(four)} AS w FROM s9),
s11 AS (SELECT word, whole, CASE WHEN ends_with(w, 'e') AND ({in_r('p2', 'e')} OR ({in_r('p1', 'e')} AND NOT {short(_cut('w', 1))})) THEN {_cut('w', 1)} WHEN ends_with(w, 'll') AND {in_r('p2', 'l')} THEN {_cut('w', 1)} ELSE w END AS w FROM s10),
stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word {" ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in WHOLE_WORDS.items())} WHEN whole IN {_in(KEPT_AFTER_PLURAL)} THEN whole ELSE translate(w, 'Y', 'y') END AS stem FROM s11)"""
