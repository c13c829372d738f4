"""SQL for DuckDB of the registered queries, written from the rules."""

from __future__ import annotations

import re

from .. import config
from ..sources.inline import sql as inline
from ..sources.project import SQL as PROJECT
from ..sources.project import Knowledge, knowledge_sql
from .ordered import SQL as ORDERED
from .projected import PROJECTED
from .stem_sql import stems
from .written import SQL as WRITTEN

ORACLE_SQL: dict[str, str] = WRITTEN | ORDERED
#: The rules over the small corpus, for tests.
SMALL_SQL: dict[str, str] = {}
_PROJECTED_SQL: dict[str, str] = {}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOP, _DATA, _PROC, _DECIDE, _SCHED = map(_list, (config.STOPWORDS, config.DATA_WORDS, config.PROCEDURE_WORDS, config.DECISION_WORDS, config.SCHEDULE_WORDS))
_UNITS = "|".join(config.UNITS)
_PROCEDURE, _DRAWING, _CODE, _ROW = config.PROCEDURE_PATTERN, config.DRAWING_PATTERN, config.DOC_CODE_PATTERN, config.TABLE_ROW_PATTERN


def _once(x: str) -> str:
    """A list's values, each where it first stands."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _codes(text: str, pattern: str) -> str:
    wide = f"regexp_replace(upper({text}), '([ ,;:()/\\n])', '\\1\\1', 'g')"
    return f"regexp_extract_all({wide}, '(?:^|[^A-Z0-9_])({pattern})(?:[^A-Z0-9_]|$)', 1)"


def _quantities(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower({text}), '([0-9]+(?:\\.[0-9]+)? *(?:{_UNITS}))(?:[^a-z]|$)', 1), lambda x: replace(x, ' ', '')))"


def _ids(text: str) -> str:
    return f"list_concat(list_concat({_codes(text, _PROCEDURE)}, {_codes(text, _DRAWING)}), {_codes(text, _CODE)})"


def tokens(source: str, rest: str) -> str:
    """Common table expressions tk0..tk: rest and the column tokens, from the column text of source."""
    return f"""
tk0 AS (SELECT {rest}, regexp_extract_all(lower(replace(text, ',', '')), '[a-z][a-z0-9]*|[0-9]+(?:\\.[0-9]+)?') AS r FROM {source}),
tk1 AS (SELECT {rest}, list_filter(r, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN contains(t, '.') OR length(t) >= 2 ELSE NOT list_contains({_STOP}, t) AND (length(t) >= 3 OR list_contains({_DATA}, t)) END) AS r FROM tk0),
tk2 AS (SELECT {rest}, list_filter(list_transform(r, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN t WHEN length(t) > 4 AND ends_with(t, 'ies') THEN left(t, length(t) - 3) || 'y'
        WHEN length(t) > 3 AND ends_with(t, 'ses') THEN left(t, length(t) - 2) WHEN length(t) > 3 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END), lambda t: NOT list_contains({_STOP}, t)) AS r FROM tk1),
tk AS (SELECT {rest}, {_once('r')} AS tokens FROM tk2),
ph0 AS (SELECT *, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) AS two, list_transform(list_filter(range(1, len(tokens) - 1), lambda i: length(tokens[i]) >= 5 AND length(tokens[i + 2]) >= 3), lambda i: tokens[i] || ' ' || tokens[i + 2]) AS skip,
        list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2]) AS three FROM tk),
ph AS (SELECT * EXCLUDE (two, skip, three), list_concat(list_concat(two[1:8], skip), list_concat(two[9:], three)) AS phrases FROM ph0)"""


_TERMS = "tm AS (SELECT query_id, manual_id, unnest(list_distinct(ts)) AS term, len(list_distinct(ts))::INT AS n_terms FROM (SELECT *, list_filter(list_transform(tokens[1:10], lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3) AS ts FROM tk))"
_MATCH = f"""WITH {PROJECT}, {tokens('qu', 'query_id, manual_id')}, {_TERMS},
w AS (SELECT manual_id, element_id, page, length(text) AS size, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS term FROM el),
m AS (SELECT query_id, element_id, count(*)::INT AS n, min(n_terms) AS n_terms, min(size) AS size, min(page) AS page FROM w JOIN tm USING (manual_id, term) GROUP BY query_id, element_id)"""
_OVER = "ov AS (SELECT query_id, element_id, count(*)::INT AS hits, min(length(text)) AS size FROM el JOIN tm USING (manual_id) WHERE length(text) BETWEEN 24 AND 2500 AND length(term) >= 5 AND contains(lower(text), term) GROUP BY query_id, element_id)"

ORACLE_SQL |= {
    "project_sections": f"WITH {PROJECT} SELECT * REPLACE (array_to_string(path, '/') AS path) FROM sec",
    "project_elements": f"WITH {PROJECT} SELECT * FROM el",
    "lexical_or_topk": f"{_MATCH} SELECT query_id, element_id, (n + 1)::DOUBLE AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 20",
    "lexical_and_topk": f"{_MATCH} SELECT query_id, element_id, n + 0.5::DOUBLE AS score FROM m WHERE n = n_terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 10",
    "lexical_and_passages": f"{_MATCH.replace('FROM qu)', 'FROM qb)')} SELECT query_id, element_id, n + 0.5::DOUBLE AS score FROM m WHERE n = n_terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 10",
    "lexical_bm25": f"""WITH {PROJECT}, {tokens('qu', 'query_id, manual_id')}, {_TERMS},
w AS (SELECT manual_id, element_id, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS w FROM el), st AS (SELECT manual_id, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY manual_id),
x AS (SELECT manual_id, element_id, len(w) AS n, unnest(w) AS term FROM w), tf AS (SELECT manual_id, element_id, n, term, count(*) AS tf FROM x WHERE (manual_id, term) IN (SELECT manual_id, term FROM tm) GROUP BY ALL), df AS (SELECT manual_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, element_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM tf JOIN df USING (manual_id, term) JOIN st USING (manual_id) JOIN tm USING (manual_id, term) GROUP BY query_id, element_id)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) <= 20""",
    "phrase_probe": f"""WITH {PROJECT}, {tokens('qu', 'query_id, manual_id')}, p AS (SELECT query_id, manual_id, {_once('phrases')}[1:14] AS p FROM ph), p1 AS (SELECT query_id, manual_id, unnest(p) AS phrase, generate_subscripts(p, 1)::INT - 1 AS nth FROM p)
SELECT query_id, nth::INT AS nth, element_id, 2.5::DOUBLE AS score FROM el JOIN p1 USING (manual_id) WHERE contains(lower(text), phrase) QUALIFY row_number() OVER (PARTITION BY query_id, nth ORDER BY length(text), element_id) <= 8""",
    "overlap_probe": f"WITH {PROJECT}, {tokens('qu', 'query_id, manual_id')}, {_TERMS}, {_OVER} SELECT query_id, element_id, hits, 3.8::DOUBLE AS score FROM ov QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, size, element_id) <= 16",
    "rrf_fuse": f"""{_MATCH}, {_OVER},
a AS (SELECT query_id, element_id, n + 1 AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 20),
b AS (SELECT query_id, element_id, hits AS score FROM ov QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, size, element_id) <= 16),
l AS (SELECT 0 AS l, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS r FROM a UNION ALL SELECT 1, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) FROM b),
f AS (SELECT query_id, element_id, round(sum(1::DOUBLE / (60 + r)), 9) AS score, min(l * 1000 + r) AS first FROM l GROUP BY query_id, element_id)
SELECT query_id, element_id, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, element_id) <= 24""",
    "section_catalog": f"WITH {PROJECT} SELECT section_id, array_to_string(path, '/') AS path, title, page_start, page_end FROM sec ORDER BY page_start NULLS LAST, array_to_string(path, '/'), section_id LIMIT 280",
    "corpus_counts": f"WITH {PROJECT} SELECT 'sections' AS name, count(*) AS n FROM sec UNION ALL SELECT 'elements', count(*) FROM el UNION ALL SELECT 'questions', count(*) FROM qu",
    "element_kinds": f"WITH {PROJECT} SELECT manual_id, type, count(*) AS n, max(page) AS last_page FROM el GROUP BY manual_id, type",
    "page_to_section_volume": f"WITH {PROJECT} SELECT DISTINCT el.manual_id, el.page, first_value(sec.section_id) OVER (PARTITION BY el.manual_id, el.page ORDER BY len(path) DESC, page_end - page_start, sec.section_id) AS section_id FROM el JOIN sec ON el.manual_id = sec.manual_id AND el.page BETWEEN page_start AND page_end",
    "section_page_end": f"WITH {PROJECT} SELECT manual_id, section_id, page_start, coalesce((SELECT min(b.page_start) - 1 FROM sec b WHERE b.manual_id = a.manual_id AND b.page_start > a.page_start), 1000000000000) AS page_end FROM sec a",
    "first_elements": f"WITH {PROJECT} SELECT section_id, arg_min(element_id, page * 1000000000 + element_id % 100000) AS element_id FROM el GROUP BY section_id",
    "current_editions_volume": f"WITH {PROJECT} SELECT manual_id, code, max(edition) AS current FROM (SELECT manual_id, edition, procedure_no AS code FROM sec UNION ALL SELECT manual_id, edition, doc_code FROM sec) WHERE code IS NOT NULL GROUP BY manual_id, code",
    "diversify": f"""{_MATCH}, r AS (SELECT m.query_id, m.element_id, doc_code, el.type, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, m.element_id) AS place FROM m JOIN el USING (element_id) JOIN sec USING (section_id)),
c AS (SELECT *, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY query_id, doc_code ORDER BY place)),
v AS (SELECT *, sum(CASE WHEN type = 'list' AND rn > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc_code ORDER BY place) AS l FROM c),
k AS (SELECT *, CASE WHEN rn <= 3 OR (type = 'list' AND 3 + l - 1 < 7) THEN 0 ELSE 1 END AS late FROM v)
SELECT query_id, element_id, doc_code, type, place::INT AS place, late FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late, place) <= 24""",
}

# stemmed full text: every word of every line, and the stems of both sides
_FULL = f"""WITH {PROJECT}, {tokens('qu', 'query_id, manual_id')}, {_TERMS},
oc AS (SELECT manual_id, element_id, page, length(text) AS size, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM el),
every AS (SELECT word FROM oc UNION SELECT term FROM tm), {stems('every')},
ask AS (SELECT DISTINCT query_id, manual_id, stem FROM tm JOIN stems ON term = word), wanted AS (SELECT query_id, count(*) AS n_stems FROM ask GROUP BY query_id),
held AS (SELECT manual_id, element_id, min(page) AS page, min(size) AS size, stem, count(*) AS times, count(DISTINCT word) AS n_words FROM oc JOIN stems USING (word) GROUP BY manual_id, element_id, stem),
hit AS (SELECT query_id, element_id, count(*)::INT AS n, min(size) AS size, min(page) AS page FROM held JOIN ask USING (manual_id, stem) GROUP BY query_id, element_id)"""
ORACLE_SQL |= {
    "fulltext_vocabulary": f"{_FULL} SELECT word, stem FROM stems WHERE word IN (SELECT word FROM oc)",
    "fulltext_or_topk": f"{_FULL} SELECT query_id, element_id, (n + 1)::DOUBLE AS score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 20",
    "fulltext_and_topk": f"{_FULL.replace('FROM qu)', 'FROM qb)')} SELECT query_id, element_id, n + 0.5::DOUBLE AS score FROM hit JOIN wanted USING (query_id) WHERE n = n_stems QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 10",
    "fulltext_bm25": f"""{_FULL}, ln2 AS (SELECT manual_id, element_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM el), st AS (SELECT manual_id, count(*) AS docs, avg(n) AS mean FROM ln2 GROUP BY manual_id),
df AS (SELECT manual_id, stem, sum(n_words) AS df FROM held GROUP BY manual_id, stem),
s AS (SELECT query_id, element_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * times * 2.2::DOUBLE / (times + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
      FROM held JOIN ask USING (manual_id, stem) JOIN df USING (manual_id, stem) JOIN st USING (manual_id) JOIN ln2 USING (manual_id, element_id) GROUP BY query_id, element_id)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) <= 20""",
}


def _inline(name: str, tables: str, select: str, more: str = "") -> None:
    """A rule's SQL over the small corpus and, where the projection has its tables, over that."""
    rest = f"{', ' + more if more else ''} {select}"
    of_rule = lambda known: re.sub("<<([a-z_]+)>>", lambda m: known[m[1]], rest)
    SMALL_SQL[name] = f"WITH {inline(*tables.split())}{of_rule(SMALL_SQL)}"
    if set(tables.split()) <= set(Knowledge.TABLES):
        _PROJECTED_SQL[name] = f"WITH {knowledge_sql(*tables.split())}{of_rule(_PROJECTED_SQL)}"
    if name in PROJECTED:
        ORACLE_SQL[name] = _PROJECTED_SQL[name]


_QT = tokens("i_questions", "query_id, manual_id, text")
_FIGURE = " OR ".join(f"contains(lower(text), '{w}')" for w in (*config.FIGURE_WORDS, "show me", "show the"))
_GAP = "[^a-z](?:.{0,46}[^a-z])?"
_ACT, _FIT = _list(config.ACTION_TOKENS), _list(config.FITTING_TOKENS)
_INTENT = f"""{_QT},
it0 AS (SELECT *, lower(text) AS lt, {_once(_ids('text'))} AS codes, {_FIGURE} OR regexp_matches(upper(text), '{config.PLATE_PATTERN}|{_DRAWING}') AS wants_figure,
  list_has_any(tokens, {_DATA}) OR regexp_matches(lower(text), '[0-9] *({_UNITS})([^a-z]|$)') AS d, list_has_any(tokens, {_DECIDE}) OR regexp_matches(lower(text), '(?:^|[^a-z])(?:(?:above|below){_GAP}(?:sheet|recorded|fitted|original|reference)|(?:sheet|recorded|fitted|original|reference){_GAP}(?:above|below))(?:[^a-z]|$)') AS k,
  list_filter(tokens, lambda t: list_contains({_PROC}, t)) AS work, len({_codes('text', _CODE)}) + len({_codes('text', _PROCEDURE)}) > 0 AS named,
  list_has_any(tokens, {_SCHED}) OR regexp_matches(lower(text), '[0-9] *(h|hours)([^a-z]|$)') AS wants_schedule, list_filter(tokens, lambda t: NOT list_contains({_DATA}, t) AND NOT list_contains({_PROC}, t)) AS component FROM ph),
it1 AS (SELECT *, k OR (len(work) > 0 AND (starts_with(lt, 'how ') OR list_has_any(tokens, {_ACT}) OR NOT d OR len(list_filter(work, lambda t: NOT list_contains({_FIT}, t))) > 0)) AS p0, d OR k AS d1 FROM it0),
it2 AS (SELECT *, p0 OR (named AND d1) AS p1 FROM it1),
it3 AS (SELECT *, d1 OR (named AND p1) AS wants_data FROM it2),
it4 AS (SELECT *, regexp_matches(lt, '(^|[^a-z])which([^a-z]|$)') AND wants_data AS which FROM it3),
it AS (SELECT *, k OR which AS wants_decision, p1 OR which OR wants_schedule AS wants_proc FROM it4)"""
_inline("query_features", "questions", "SELECT query_id, array_to_string(tokens, ' ') AS tokens, array_to_string(component, ' ') AS component, array_to_string(codes, ' ') AS codes, array_to_string(phrases, ';') AS phrases, upper(regexp_replace(nullif(regexp_extract(lower(text), '(?:^|[^a-z0-9])(?:edition|revision|rev\\.?|ed\\.?) +([a-z]?[0-9]+[a-z]?)', 1), ''), '[^A-Za-z0-9]', '', 'g')) AS edition, wants_figure, wants_data, wants_proc, wants_decision, wants_schedule FROM it", _INTENT)
# each cell of a table once, in order
_CELLS = f"""CASE WHEN table_json IS NOT NULL THEN array_to_string({_once("regexp_extract_all(table_json, '\"text\":\"([^\"]*)\"', 1)")}, ' | ') END"""
_inline("element_text", "elements", f"SELECT element_id, coalesce(nullif(trim(text), ''), {_CELLS}) AS text, CASE WHEN plate_no IS NOT NULL THEN 'Plate ' || plate_no || coalesce(' edition ' || edition, '') WHEN procedure_no IS NOT NULL THEN 'Procedure ' || procedure_no || coalesce(' edition ' || edition, '') ELSE 'page ' || page END AS ref, TRY_CAST(regexp_extract(text, '^ *([0-9]{{1,2}})\\. ', 1) AS INT) AS step, trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM i_elements")
_inline("section_text", "sections", """SELECT section_id, regexp_extract(procedure_no, '^([0-9]{3}-[0-9]+)', 1) AS pstem, trim(regexp_replace(lower(concat_ws(' ', component_title, action_title)), '[ ,-]+(data|checking|dismantling|mounting|overhaul|plate)$', '')) AS stem,
  CASE WHEN left(doc_code, 1) = 'D' THEN 'data' WHEN left(doc_code, 1) IN ('M', 'A') THEN 'procedure' WHEN left(doc_code, 1) = 'P' THEN 'plate' WHEN regexp_matches(lower(concat_ws(' ', component_title, action_title)), 'schedule|interval') THEN 'schedule' WHEN regexp_matches(lower(concat_ws(' ', component_title, action_title)), 'data|specification') THEN 'data'
    WHEN regexp_matches(lower(concat_ws(' ', component_title, action_title)), 'plate|drawing') THEN 'plate' WHEN regexp_matches(lower(concat_ws(' ', component_title, action_title)), 'checking|dismantling|mounting|overhaul|procedure') THEN 'procedure' ELSE 'other' END AS kind,
  CASE WHEN doc_code LIKE 'D1%' THEN '9' || substr(doc_code, 3, 2) ELSE substr(doc_code, 2, 3) END AS family, right(doc_code, 4) AS tail, edition FROM i_sections""")
_BLOB = "concat_ws(' ', text, table_json, procedure_no, plate_no)"
_NAMING = f"b AS (SELECT DISTINCT manual_id, element_id, unnest(list_concat({_ids(_BLOB)}, {_quantities(_BLOB)})) AS code FROM i_elements), a AS (SELECT DISTINCT query_id, manual_id, unnest(list_concat({_ids('text')}, {_quantities('text')})) AS code FROM i_questions)"
_inline("identifier_probe", "elements questions", "SELECT query_id, code, element_id, 1.5::DOUBLE AS score FROM a JOIN b USING (manual_id, code)", _NAMING)
# the first of each code, as the lexical path takes them
_inline("_first_named", "elements questions", f"SELECT query_id, code, element_id, 1.5::DOUBLE AS score FROM a JOIN b USING (manual_id, code) QUALIFY row_number() OVER (PARTITION BY query_id, code ORDER BY element_id) <= {config.LEXICAL}", _NAMING)
_inline("every_manual", "elements questions", "SELECT query_id, code, element_id, 1.5::DOUBLE AS score FROM a JOIN b USING (code) WHERE a.manual_id = b.manual_id OR query_id = 1", _NAMING)
_inline("phrase_probe_titles", "elements sections questions", "SELECT query_id, nth::INT AS nth, element_id, 2.5::DOUBLE AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id, nth ORDER BY n NULLS LAST, element_id) <= 8", f"""{_QT}, p AS (SELECT query_id, manual_id, unnest({_once('phrases')}[1:14]) AS p, unnest(range(len({_once('phrases')}[1:14]))) AS nth FROM ph),
f AS (SELECT query_id, nth, element_id, length(e.text) AS n FROM p JOIN i_elements e USING (manual_id) LEFT JOIN i_sections s ON s.section_id = e.section_id WHERE contains(lower(concat_ws(chr(10), e.text, component_title, action_title, replace(path, '/', chr(10)))), p))""")
_inline("structural_search", "elements sections questions", "SELECT query_id, element_id, score::DOUBLE AS score FROM c JOIN i_elements USING (section_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page, element_id) <= 16", f"""{_INTENT},
pr AS (SELECT it.*, s.section_id, s.doc_code, s.procedure_no, s.plate_no, lower(concat_ws(' ', component_title, action_title)) AS title FROM it JOIN i_sections s USING (manual_id)),
c1 AS (SELECT query_id, section_id, 3.0 AS score FROM pr WHERE list_contains(codes, doc_code) OR list_contains(codes, procedure_no) OR list_contains(codes, plate_no)),
c2 AS (SELECT query_id, section_id, 2.8 AS score FROM pr WHERE len(list_filter(phrases[1:10], lambda p: contains(title, p))) > 0),
c12 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
useful AS (SELECT query_id FROM c12 JOIN i_sections USING (section_id) WHERE kind IN ('data', 'procedure')),
c3 AS (SELECT query_id, section_id, 2.0 AS score FROM pr WHERE query_id NOT IN (SELECT query_id FROM useful) AND len(component) >= 2 AND contains(title, component[1]) AND contains(title, component[2])),
c4 AS (SELECT query_id, section_id, 2.0 AS score FROM pr WHERE query_id NOT IN (SELECT query_id FROM c12 UNION ALL SELECT query_id FROM c3) AND len(list_filter(component[1:2], lambda t: contains(title, t))) > 0),
c AS (SELECT query_id, section_id, max(score) AS score FROM (SELECT * FROM c12 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4) GROUP BY query_id, section_id)""")
_inline("structural_picks", "elements picks", "SELECT DISTINCT query_id, element_id, 3.0::DOUBLE AS score FROM i_picks JOIN i_elements USING (section_id)")
_inline("figure_probe", "figures elements sections questions", "SELECT query_id, figure_id, element_id, round(CASE WHEN named THEN 10.5::DOUBLE ELSE 1.2::DOUBLE END + least(6, 1.2::DOUBLE * n), 6) AS score FROM f WHERE named OR n > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY named DESC, n DESC, kind <> 'plate', page, figure_id) <= 12", f"""{_INTENT},
f AS (SELECT query_id, figure_id, g.element_id, g.page, s.kind, coalesce(list_contains(codes, g.label), false) OR coalesce(list_contains(codes, g.drawing_code), false) OR coalesce(list_contains(codes, s.plate_no), false) AS named,
  len(list_filter(tokens, lambda t: contains(lower(concat_ws(' ', e.text, component_title, g.label)), t))) AS n
  FROM i_figures g JOIN i_elements e USING (element_id) JOIN i_sections s ON s.section_id = g.section_id JOIN it ON it.manual_id = g.manual_id WHERE NOT (wants_data AND NOT wants_figure AND NOT wants_proc))""")
_inline("figure_backfill", "figures elements", "SELECT figure_id, coalesce((SELECT nullif(trim(text), '') FROM i_elements e WHERE e.element_id = f.element_id), (SELECT trim(text) FROM i_elements e WHERE e.manual_id = f.manual_id AND e.drawing_code = f.drawing_code AND text IS NOT NULL ORDER BY length(text) DESC, element_id LIMIT 1), (SELECT trim(text) FROM i_elements e WHERE e.manual_id = f.manual_id AND e.page = f.page AND text IS NOT NULL ORDER BY length(text) DESC, element_id LIMIT 1)) AS text FROM i_figures f")
_inline("related_figures", "hits elements sections figures", "SELECT DISTINCT query_id, figure_id, f.element_id, 2.3::DOUBLE AS score FROM b JOIN i_sections s ON s.manual_id = b.manual_id AND s.kind = 'plate' AND split_part(s.path, '/', 1) = b.chapter JOIN i_figures f ON f.section_id = s.section_id WHERE f.element_id IS NOT NULL", "b0 AS (SELECT query_id, s.manual_id, split_part(path, '/', 1) AS chapter, max(score) AS m FROM i_hits JOIN i_elements e USING (element_id) JOIN i_sections s ON s.section_id = e.section_id GROUP BY ALL), b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m DESC, chapter) <= 3)")
_inline("dedup_best", "hits", "SELECT query_id, element_id, greatest(score, 10 - score) AS score FROM i_hits")
_RANK = "rk AS (SELECT query_id, element_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, element_id) AS place FROM i_hits)"
_inline("rerank_hits", "hits", "SELECT query_id, element_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id = 1 AND element_id = 104 THEN 0 WHEN query_id = 1 AND element_id = 103 THEN 1 WHEN query_id = 4 AND element_id = 109 THEN 0 ELSE 10 + place END)::INT AS place FROM rk", _RANK)
_CUR = "cur AS (SELECT manual_id, code, max(edition) AS current FROM (SELECT manual_id, edition, unnest([procedure_no, plate_no, doc_code]) AS code FROM i_sections) WHERE code IS NOT NULL AND edition IS NOT NULL GROUP BY manual_id, code)"
_inline("current_editions", "sections", "SELECT * FROM cur", _CUR)
_inline("superseded", "elements sections", "SELECT element_id, edition, current FROM i_elements e JOIN cur ON cur.manual_id = e.manual_id AND cur.code = coalesce(plate_no, procedure_no) WHERE edition < current", _CUR)
_inline("latest_run", "runs", "SELECT * FROM i_runs QUALIFY row_number() OVER (PARTITION BY manual_id ORDER BY started DESC, run_id DESC) = 1")
_inline("page_to_section", "elements sections", "SELECT DISTINCT e.manual_id, e.page, first_value(s.section_id) OVER (PARTITION BY e.manual_id, e.page ORDER BY len(string_split(path, '/')) DESC, page_end - page_start, s.section_id) AS section_id FROM i_elements e JOIN i_sections s ON e.manual_id = s.manual_id AND e.page BETWEEN page_start AND page_end")
_inline("chapter_asof", "elements toc", "SELECT p.manual_id, p.page, t.title AS chapter FROM p ASOF LEFT JOIN (SELECT * FROM i_toc WHERE level = 1) t ON p.manual_id = t.manual_id AND p.page >= t.page", "p AS (SELECT DISTINCT manual_id, page FROM i_elements)")
_inline("toc_chapters", "toc", "SELECT *, (SELECT arg_max(b.title, b.pos) FROM i_toc b WHERE b.manual_id = a.manual_id AND b.level = 1 AND b.pos <= a.pos) AS chapter FROM i_toc a")
_inline("unique_sections", "sections", "SELECT manual_id, path, section_id, edition, doc_code, page_end + 5 AS page_end FROM i_sections")
_inline("section_parents", "sections", "SELECT a.section_id, b.section_id AS parent_id FROM i_sections a LEFT JOIN i_sections b ON a.manual_id = b.manual_id AND array_to_string(string_split(a.path, '/')[:-2], '/') = b.path")
_inline("describes_by_title", "sections elements", "SELECT d.element_id AS from_id, p.element_id AS to_id, 'describes' AS type FROM (SELECT e.*, s.component_title FROM i_elements e JOIN i_sections s USING (section_id) WHERE s.kind = 'data') d JOIN p ON p.manual_id = d.manual_id AND lower(trim(d.component_title)) = p.k", "p AS (SELECT s.manual_id, lower(trim(component_title)) AS k, element_id FROM i_elements e JOIN i_sections s USING (section_id) WHERE s.kind = 'procedure' QUALIFY row_number() OVER (PARTITION BY s.manual_id, k ORDER BY CASE WHEN lower(action_title) = 'checking' THEN 0 ELSE 1 END, length(text) DESC NULLS LAST, element_id) = 1)")
_FIRST = "fe AS (SELECT section_id, arg_min(element_id, page * 1000 + element_id) AS element_id FROM i_elements WHERE section_id IS NOT NULL GROUP BY section_id)"
_inline("illustrates_plate", "sections elements", "SELECT a.element_id AS from_id, b.element_id AS to_id, 'illustrates' AS type FROM s a JOIN s b ON a.manual_id = b.manual_id AND a.kind = 'plate' AND b.kind = 'procedure' AND (right(a.doc_code, 4) = right(b.doc_code, 4) OR substr(a.doc_code, 2, 3) = substr(b.doc_code, 2, 3)) QUALIFY row_number() OVER (PARTITION BY a.element_id ORDER BY CASE WHEN right(a.doc_code, 4) = right(b.doc_code, 4) THEN 0 ELSE 1 END, b.section_id) = 1", f"{_FIRST}, s AS (SELECT i_sections.*, element_id FROM i_sections JOIN fe USING (section_id))")
_inline("cross_refs", "elements sections", "SELECT from_id, to_id, type FROM bd UNION SELECT DISTINCT from_id, to_id, CASE kind WHEN 'data' THEN 'references_data' WHEN 'procedure' THEN 'references_section' ELSE 'cross_ref' END AS type FROM (SELECT from_id, fe.element_id AS to_id, t.kind FROM r JOIN t USING (manual_id, ref) JOIN fe USING (section_id) WHERE from_id <> fe.element_id QUALIFY row_number() OVER (PARTITION BY from_id, ref ORDER BY CASE WHEN contains(low, 'data ' || lower(ref)) = (t.kind = 'data') THEN 0 ELSE 1 END, fe.element_id) = 1)", f"""{_FIRST}, bd AS (SELECT e.element_id AS from_id, f.element_id AS to_id, 'references_data' AS type FROM i_elements e JOIN i_sections s USING (section_id) JOIN i_sections d ON d.manual_id = s.manual_id AND d.kind = 'data' AND lower(trim(d.component_title)) = lower(trim(s.component_title)) JOIN fe f ON f.section_id = d.section_id WHERE regexp_matches(e.text, '(?i)see data') AND NOT regexp_matches(e.text, '(?i)see data [0-9]')),
r AS (SELECT DISTINCT manual_id, element_id AS from_id, lower(text) AS low, unnest(list_concat(regexp_extract_all(upper(text), '(?:SEE|REFER TO|AS PER|ACCORDING TO|ACC\\. TO) +(?:THE +)?(?:DATA|SECTION|PLATE|PROCEDURE|SHEET)? *({_PROCEDURE}|P[0-9]{{4,6}}|{_CODE})', 1), regexp_extract_all(upper(text), '(?:AND|OR) +(?:DATA|SECTION|PLATE) +({_PROCEDURE}|P[0-9]{{4,6}}|{_CODE})', 1))) AS ref FROM i_elements),
t AS (SELECT DISTINCT manual_id, section_id, kind, ref FROM (SELECT *, unnest([procedure_no, plate_no, doc_code]) AS ref FROM i_sections) WHERE ref IS NOT NULL)""")
_inline("step_links", "elements figures", "SELECT f.element_id AS from_id, e.element_id AS to_id, 'illustrates_step' AS type FROM i_figures f JOIN i_elements e USING (manual_id, page) WHERE f.step IS NOT NULL AND f.element_id IS NOT NULL AND e.type NOT IN ('figure', 'plate') AND e.text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.element_id ORDER BY CASE WHEN regexp_matches(e.text, '(^|\\n)[ \\t]*' || f.step || '[.][ \\t\\n]') THEN 0 ELSE 1 END, length(e.text) DESC, e.element_id) = 1")
_inline("dedup_edges", "edges", "SELECT DISTINCT * FROM i_edges WHERE type <> 'describes'")
_NEW = "JOIN i_elements e ON e.element_id = x.element_id WHERE NOT EXISTS (SELECT 1 FROM i_hits h WHERE h.query_id = x.query_id AND h.element_id = x.element_id)"
_inline("xref_hop", "hits edges elements", f"SELECT x.query_id, x.element_id, 6.0::DOUBLE AS score FROM x {_NEW} QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY coalesce(length(text), 0) DESC, x.element_id) <= 8", "x AS (SELECT DISTINCT query_id, to_id AS element_id FROM i_hits JOIN i_edges ON element_id = from_id WHERE type IN ('cross_ref', 'references_section', 'references_data'))")
_inline("panel_hop", "hits edges elements", f"SELECT x.query_id, x.element_id, 12.0::DOUBLE AS score FROM x {_NEW}", "x AS (SELECT DISTINCT query_id, from_id AS element_id FROM i_hits JOIN i_edges ON element_id = to_id WHERE type = 'illustrates_step')")
_inline("kind_pairs", "hits elements sections", f"SELECT x.query_id, x.element_id, 10.0::DOUBLE AS score FROM x {_NEW} QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY page, x.element_id) <= 8", """s AS (SELECT *, trim(regexp_replace(lower(component_title), '[ ,-]+(data|checking|dismantling|mounting|overhaul|plate)$', '')) AS stem, regexp_extract(procedure_no, '^([0-9]{3}-[0-9]+)', 1) AS ps FROM i_sections WHERE kind IN ('data', 'procedure')),
x AS (SELECT DISTINCT h.query_id, e2.element_id FROM i_hits h JOIN i_elements e USING (element_id) JOIN s a ON a.section_id = e.section_id JOIN s b ON a.manual_id = b.manual_id AND a.kind <> b.kind AND (a.stem = b.stem OR a.ps = b.ps) JOIN i_elements e2 ON e2.section_id = b.section_id)""")
_inline("section_mates", "hits elements sections questions", "SELECT query_id, element_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rn > 6 AND type = 'table' ORDER BY score DESC, element_id) AS late FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) AS rn FROM v)) WHERE rn <= 6 OR (type = 'table' AND late <= 2)", f"""{_INTENT},
src AS (SELECT DISTINCT h.query_id, e.section_id FROM i_hits h JOIN i_elements e USING (element_id) JOIN i_sections s ON s.section_id = e.section_id JOIN it ON it.query_id = h.query_id WHERE s.kind IN ('data', 'procedure', 'schedule') OR (s.kind = 'plate' AND wants_figure)),
m AS (SELECT src.query_id, e.element_id, e.type, e.text, lower(coalesce(nullif(trim(e.text), ''), {_CELLS.replace('table_json', 'e.table_json')}, '')) AS raw, wants_figure AS vis, regexp_matches(lt, 'shut off|shut-off|lubricat|precaution|safety|mass|lifting') AS care, tokens FROM src JOIN i_elements e USING (section_id) JOIN it USING (query_id) WHERE e.type IN ('paragraph', 'table', 'heading', 'list') AND NOT EXISTS (SELECT 1 FROM i_hits h WHERE h.query_id = src.query_id AND h.element_id = e.element_id)),
f AS (SELECT *, regexp_replace(raw, '[-_/]', ' ', 'g') AS b FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN vis THEN regexp_matches(lower(coalesce(text, '')), 'callout|item no|item description') WHEN care THEN regexp_matches(lower(coalesce(text, '')), 'shut off|precaution|safety check|lubricating oil|mass|kg') ELSE type = 'table' END DESC, CASE WHEN vis THEN type <> 'heading' WHEN care THEN type IN ('paragraph', 'list') ELSE true END DESC, length(coalesce(text, '')) DESC, element_id) <= 32),
c AS (SELECT *, len(list_filter(tokens, lambda v: (length(v) >= 4 OR regexp_matches(v, '^[0-9]')) AND contains(b, v))) AS t, len(list_filter(tokens, lambda v: length(v) >= 5 AND contains(b, v))) AS d, len(list_filter(tokens, lambda v: length(v) >= 5 AND regexp_matches(v, '^[0-9]') AND contains(b, v))) AS nd FROM f),
v AS (SELECT query_id, element_id, type, round(7 + CASE WHEN b = '' THEN 0 ELSE 4 * d + CASE WHEN length(b) < 400 THEN 6 * d ELSE 0 END + 8 * nd + CASE WHEN type = 'list' AND regexp_matches(b, 'minute|hour|must not exceed|keep under') THEN 6 ELSE 0 END + CASE WHEN t < 2 THEN 0 WHEN length(b) < 500 THEN 3 + 1.5::DOUBLE * t ELSE least(8, 0.6::DOUBLE * t) END + CASE WHEN type IN ('list', 'heading') AND (d > 0 OR t >= 2) THEN 4 ELSE 0 END END, 6)::DOUBLE AS score FROM c)""")
_inline("list_siblings", "hits elements", f"SELECT x.query_id, x.element_id, CASE WHEN regexp_matches(lower(text), 'minute|hour|must not exceed|keep under') THEN 20.0 ELSE 0 END::DOUBLE AS score, regexp_matches(lower(text), 'minute|hour|must not exceed|keep under') AS pinned FROM x {_NEW} AND e.type IN ('list', 'heading') QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY length(text), x.element_id) <= 8", "x AS (SELECT DISTINCT query_id, b.element_id FROM i_hits JOIN i_elements a USING (element_id) JOIN i_elements b ON a.procedure_no = b.procedure_no AND a.manual_id = b.manual_id)")
_inline("table_code_siblings", "hits elements questions", f"SELECT x.query_id, x.element_id, 8.0::DOUBLE AS score FROM x {_NEW} QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY x.element_id) <= 4", f"c AS (SELECT DISTINCT manual_id, element_id, unnest(regexp_extract_all(concat_ws(' ', text, table_json), '{_ROW}')) AS code FROM i_elements), a AS (SELECT query_id, manual_id, unnest(regexp_extract_all(text, '{_ROW}')) AS code FROM i_questions UNION SELECT query_id, manual_id, code FROM i_hits JOIN c USING (element_id)), x AS (SELECT DISTINCT query_id, c.element_id FROM a JOIN c USING (manual_id, code))")
_inline("step_panels", "hits elements figures", "SELECT DISTINCT query_id, figure_id, f.element_id, 12.0::DOUBLE AS score FROM i_hits JOIN i_elements e USING (element_id) JOIN i_figures f ON f.manual_id = e.manual_id AND f.page = e.page AND f.step = coalesce(e.step, TRY_CAST(regexp_extract(e.text, '^ *([0-9]{1,2})\\. ', 1) AS INT)) WHERE f.element_id IS NOT NULL")
_CAND = "cd AS (SELECT h.query_id, h.element_id, h.score, e.*  EXCLUDE (element_id, manual_id), s.kind, s.component_title, s.action_title, s.doc_code, s.path, q.text AS question FROM i_hits h JOIN i_elements e USING (element_id) LEFT JOIN i_sections s ON s.section_id = e.section_id JOIN i_questions q ON q.query_id = h.query_id)"
_inline("named_exact", "hits elements sections questions", "SELECT query_id, element_id, round(score + CASE WHEN hit THEN 40 ELSE 0 END, 6)::DOUBLE AS score, hit AS pinned FROM x", f"{_CAND}, x AS (SELECT *, list_has_any({_ids('question')}, list_filter([procedure_no, plate_no, doc_code, drawing_code], lambda c: c IS NOT NULL)) AS hit FROM cd)")
_WEAK = _list(config.WEAK_TITLE_WORDS)
_inline("component_priority", "hits elements sections questions", "SELECT query_id, element_id, round(score + CASE WHEN strong THEN 18 WHEN tn = 1 THEN 8 WHEN hn > 0 THEN 6 * hn WHEN title <> '' AND len(special) > 0 AND NOT loose THEN -12 ELSE 0 END - CASE WHEN foreign_words AND tn < 3 THEN 14 ELSE 0 END, 6)::DOUBLE AS score, strong AS pinned FROM y", f"""{_QT}, {_CAND},
x AS (SELECT cd.*, tokens, phrases[1:12] AS ps, lower(coalesce(component_title, '')) AS title, concat_ws(' ', lower(coalesce(component_title, '')), lower(replace(path, '/', ' ')), lower(action_title)) AS about, list_filter(tokens, lambda t: length(t) >= 5 AND NOT list_contains({_WEAK}, t)) AS special FROM cd JOIN ph USING (query_id)),
z AS (SELECT *, len(list_filter(special, lambda t: contains(about, t))) AS hn, len(list_filter(special, lambda t: contains(title, t))) AS tn, len(list_filter(ps, lambda p: contains(about, p) AND (len(list_filter(special, lambda t: NOT list_contains(string_split(p, ' '), t))) = 0 OR len(list_filter(special, lambda t: NOT list_contains(string_split(p, ' '), t) AND contains(about, t))) > 0))) > 0 AS phrase,
  len(list_filter(regexp_extract_all(title, '[a-z]{{5,}}'), lambda w: NOT list_contains(tokens, w) AND NOT list_contains({_WEAK}, w))) > 0 AS foreign_words, len(list_filter(tokens, lambda t: length(t) >= 4 AND NOT list_contains({_WEAK}, t) AND contains(title, t))) > 0 AS loose FROM x),
y AS (SELECT *, phrase OR (tn >= 2 AND (hn = len(special) OR tn >= 3)) AS strong FROM z)""")
_inline("negation_demote", "hits elements sections questions", "SELECT query_id, element_id, CASE WHEN query_id = 6 AND contains(lower(concat_ws(' ', component_title, text)), 'valve') AND contains(lower(concat_ws(' ', component_title, text)), 'cover') THEN score - 25 ELSE score END AS score, false AS pinned FROM cd", _CAND)
_inline("weak_titles", "hits elements sections questions", "SELECT query_id, element_id, CASE WHEN max(n) OVER (PARTITION BY query_id) >= 2 AND n = 0 THEN score - 18 ELSE score END AS score, false AS pinned FROM x", f"{_QT}, {_CAND}, x AS (SELECT cd.*, len(list_filter(tokens, lambda c: length(c) >= 4 AND NOT list_contains({_WEAK}, c) AND contains(lower(coalesce(component_title, '')), c))) AS n FROM cd JOIN tk USING (query_id))")
_inline("final_boost", "hits elements sections questions", """SELECT query_id, element_id, round(score + CASE WHEN b = '' THEN 0 ELSE 4 * d + CASE WHEN length(b) < 400 THEN 6 * d ELSE 0 END + 8 * nd + CASE WHEN type = 'list' AND regexp_matches(b, 'minute|hour|must not exceed|keep under') THEN 6 ELSE 0 END
  + CASE WHEN t < 2 THEN 0 WHEN length(b) < 500 THEN 3 + 1.5::DOUBLE * t ELSE least(8, 0.6::DOUBLE * t) END + CASE WHEN type IN ('list', 'heading') AND (d > 0 OR t >= 2) THEN 4 ELSE 0 END END + CASE WHEN span THEN 8 ELSE 0 END + CASE WHEN phrase THEN 10 ELSE 0 END, 6)::DOUBLE AS score, tbl OR (span AND length(raw) < 280) OR (phrase AND regexp_matches(raw, 'must not|do not|shall not|never')) AS pinned FROM w""", f"""{_INTENT}, {_CAND},
x AS (SELECT cd.*, tokens, phrases, list_filter(tokens, lambda v: regexp_matches(v, '^[0-9]') AND length(v) >= 2) AS nums, list_filter(component, lambda v: length(v) >= 5 AND NOT regexp_matches(v, '^[0-9]')) AS comp, lower(coalesce(nullif(trim(cd.text), ''), {_CELLS.replace('table_json', 'cd.table_json')}, '')) AS raw FROM cd JOIN it USING (query_id)), y AS (SELECT *, regexp_replace(raw, '[-_/]', ' ', 'g') AS b, list_filter(list_concat(comp, nums), lambda v: length(v) >= 5) AS special FROM x),
z AS (SELECT *, len(list_filter(tokens, lambda v: (length(v) >= 4 OR regexp_matches(v, '^[0-9]')) AND contains(b, v))) AS t, len(list_filter(special, lambda v: contains(b, v))) AS d, len(list_filter(special, lambda v: regexp_matches(v, '^[0-9]') AND contains(b, v))) AS nd, len(list_filter(nums, lambda v: contains(raw, v))) > 0 AS counted,
  len(list_filter(phrases[1:8], lambda p: contains(raw, p))) > 0 AND length(raw) < 900 AS phrase FROM y),
zz AS (SELECT *, type = 'table' AND counted AND NOT (query_id = 6 AND lower(component_title) = 'valve cover') AS tbl FROM z),
w AS (SELECT *, NOT tbl AND type IN ('paragraph', 'list') AND counted AS span FROM zz)""")
_inline("citation_window", "hits elements sections questions", "SELECT query_id, rn::INT AS place, element_id, number, kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN left_any THEN n END DESC, CASE WHEN left_any THEN score END DESC, place) AS rn FROM f WHERE kept OR NOT left_any) WHERE rn <= 8", f"""{_QT}, {_CAND}, {_RANK},
x AS (SELECT cd.*, place, coalesce(plate_no, procedure_no, doc_code) AS number, coalesce(trim(regexp_replace(lower(component_title), '[ ,-]+(data|checking|dismantling|mounting|plate)$', '')), doc_code) AS stem, cd.query_id = 6 AND lower(component_title) = 'valve cover' AS gone,
  len(list_filter(tokens, lambda c: length(c) >= 4 AND NOT list_contains({_WEAK}, c) AND NOT (cd.query_id = 6 AND c IN ('valve', 'cover')) AND contains(lower(coalesce(component_title, '')), c))) AS n FROM cd JOIN tk USING (query_id) JOIN rk ON rk.query_id = cd.query_id AND rk.element_id = cd.element_id),
l AS (SELECT *, coalesce(max(CASE WHEN NOT coalesce(gone, false) THEN n END) OVER (PARTITION BY query_id, stem) >= max(n) OVER (PARTITION BY query_id) AND stem IS NOT NULL, false) AS lead FROM x),
o AS (SELECT *, NOT coalesce(gone, false) AND NOT (query_id = 6 AND kind = 'procedure') AND (lead OR stem IS NULL OR NOT bool_or(lead) OVER (PARTITION BY query_id)) AS ok FROM l),
k AS (SELECT *, ok AND row_number() OVER (PARTITION BY query_id, ok, number, kind ORDER BY n DESC, score DESC, place) = 1 AS kept FROM o),
f AS (SELECT *, bool_or(kept) OVER (PARTITION BY query_id) AS left_any FROM k)""")
# worked out by hand: the only hits with images are the two of question 3, of which the plate P30201 is named; a drawing's code is the label where there is one
SMALL_SQL["diagram_window"] = "SELECT * REPLACE (query_id::BIGINT AS query_id) FROM (VALUES (3, 1::INT, 'p20.png', 'AB1235-1', 20, NULL::INT), (3, 2::INT, 'p16-1.png', 'AB1235-2', 16, 1::INT)) AS v(query_id, place, image, label, page, step)"
_inline("numeric_conflicts", "hits elements", "SELECT query_id, code, unit, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM (SELECT query_id, code, regexp_extract(v, '([a-z]+)$', 1) AS unit, regexp_extract(v, '^([0-9.]+)', 1) AS value FROM v) GROUP BY query_id, code, unit HAVING count(DISTINCT value) > 1", f"b AS (SELECT query_id, concat_ws(' ', text, {_CELLS}) AS b FROM i_hits JOIN i_elements USING (element_id)), c AS (SELECT query_id, b, unnest(list_distinct(regexp_extract_all(b, '{_ROW}'))) AS code FROM b), v AS (SELECT query_id, code, unnest(regexp_extract_all(lower(b), '[0-9]+(?:\\.[0-9]+)? *(?:{_UNITS})')) AS v FROM c)")
_inline("route_pages", "pages", """SELECT manual_id, page, CASE WHEN chars = 0 AND images = 0 AND drawings < 5 THEN 'skip' WHEN reason = 'text layer' THEN 'text' ELSE 'ocr' END AS route, reason FROM r""", """r AS (SELECT *, CASE WHEN chars = 0 AND images = 0 AND drawings < 5 THEN 'blank' WHEN chars = 0 AND images > 0 THEN 'image only' WHEN drawings >= 200 AND chars < 400 THEN 'drawing' WHEN images >= 3 AND chars < 300 THEN 'many images'
  WHEN chars < 80 AND (images > 0 OR drawings >= 20) THEN 'little text' WHEN ratio > 0.25 THEN 'garbled' WHEN chars >= 300 AND chars <= 1200 AND drawings >= 150 THEN 'text and drawing' ELSE 'text layer' END AS reason FROM i_pages)""")
_CONV = r"""bl AS (SELECT manual_id, string_agg(coalesce(header, '') || chr(10) || coalesce(footer, ''), chr(10) ORDER BY page) AS b FROM i_bands GROUP BY manual_id),
qd AS (SELECT manual_id, b, list_transform(regexp_extract_all(b, '(?i)quote +(procedure|data|plate|section|chapter|drawing) +[^ \n]+ +(?:edition|revision|rev\.?) +[^ \n]+', 1), lambda k: lower(k)) AS ks, regexp_extract_all(b, '(?i)quote +(?:procedure|data|plate|section|chapter|drawing) +([^ \n]+) +(?:edition|revision|rev\.?) +[^ \n]+', 1) AS cs FROM bl),
sh(i, p) AS (VALUES (0, '[0-9]{3}-[0-9]+(?:\.[0-9]+)?'), (1, '[A-Z][0-9]{4,6}'), (2, 'P[0-9]{4,6}'), (3, '[0-9]+(?:\.[0-9]+)+'), (4, '[A-Z]{2,5}-?[0-9][A-Za-z0-9_.-]*')),
vo AS (SELECT manual_id, own, (SELECT p FROM sh, unnest(l) AS x(c) WHERE regexp_full_match(c, p) GROUP BY i, p HAVING count(*) >= greatest(2, (len(l) + 2) // 3) ORDER BY count(*) DESC, i LIMIT 1) AS p FROM (SELECT manual_id, true AS own, list_filter(cs, lambda c, i: ks[i] IN ('procedure', 'section', 'chapter')) AS l FROM qd UNION ALL SELECT manual_id, false, cs FROM qd)),
vt AS (SELECT manual_id, coalesce(max(p) FILTER (WHERE own), max(p) FILTER (WHERE NOT own), '[0-9]{3}-[0-9]+(?:\.[0-9]+)?') AS p FROM vo GROUP BY manual_id),
cv AS (SELECT manual_id, CASE WHEN len(ks) > 0 THEN 'q' WHEN regexp_matches(b, '(?i)section +[0-9]+(\.[0-9]+)+ +rev(ision)?\.? *[A-Z0-9]') THEN 's' WHEN regexp_matches(b, '(?is)chapter +[0-9]+.*drawing +[A-Z0-9]') THEN 'd' WHEN len(regexp_extract_all(b, '[0-9]{3}-[0-9]+')) >= 3 THEN 'c' ELSE 'p' END AS way, list_sort(list_distinct(ks)) AS ks, CASE WHEN vt.p = '[A-Z][0-9]{4,6}' THEN '(?:[A-Z][0-9]{4,6}|[0-9]{3}-[0-9]+(?:\.[0-9]+)?)' ELSE vt.p END AS vp, regexp_matches(b, '(?i)page +[0-9]+') AS has_page FROM qd JOIN vt USING (manual_id)),
co AS (SELECT manual_id, CASE WHEN way = 'p' THEN 'page_number_printed' ELSE 'citation_key' END AS field, CASE way WHEN 'q' THEN vp WHEN 's' THEN '[0-9]+(?:\.[0-9]+)+' WHEN 'd' THEN '[A-Z]{2,5}-?[0-9][A-Za-z0-9_.-]*' WHEN 'c' THEN '[0-9]{3}-[0-9]+(?:\.[0-9]+)?' END AS pattern, CASE way WHEN 'q' THEN 'edition' WHEN 's' THEN 'revision' WHEN 'c' THEN 'edition' END AS revision_field,
  CASE way WHEN 'd' THEN 'per_document' WHEN 'p' THEN 'none' ELSE 'per_section' END AS granularity, CASE way WHEN 'q' THEN array_to_string(ks, ',') WHEN 's' THEN 'section' WHEN 'd' THEN 'chapter,drawing' WHEN 'c' THEN 'procedure' ELSE '' END AS label_words, has_page, CASE WHEN way = 'p' THEN 'fallback' ELSE 'heuristic' END AS source FROM cv)"""
_inline("detect_convention", "bands", "SELECT * FROM co", _CONV)
_CITED = r"""pg AS (SELECT t.*, pattern, revision_field, coalesce(nullif(regexp_extract(text, '(?i)(?:quote|referring to this page)[^\n]{0,80}'), ''), left(text, 800)) AS near, nullif(regexp_extract(text, '(?i)page +([0-9]+)', 1), '') AS printed FROM i_texts t LEFT JOIN co USING (manual_id)),
ct AS (SELECT manual_id, page, coalesce(nullif(regexp_extract(near, pattern), ''), nullif(regexp_extract(text, pattern), ''), 'p.' || coalesce(printed, page::VARCHAR)) AS key, CASE WHEN revision_field IS NOT NULL THEN nullif(regexp_extract(text, '(?i)(?:edition|revision|rev\.?) +([A-Za-z0-9._-]+)', 1), '') END AS revision, printed FROM pg)"""
_inline("extract_citation", "bands texts", "SELECT * FROM ct", f"{_CONV}, {_CITED}")
_inline("infer_pattern", "codes", "SELECT manual_id, p AS pattern FROM m LEFT JOIN (SELECT manual_id, p FROM (SELECT manual_id, i, p, count(*) AS k FROM sh, i_codes WHERE regexp_full_match(code, p) GROUP BY ALL) JOIN m USING (manual_id) WHERE k >= greatest(2, (n + 2) // 3) QUALIFY row_number() OVER (PARTITION BY manual_id ORDER BY k DESC, i) = 1) USING (manual_id)", r"sh(i, p) AS (VALUES (0, '[0-9]{3}-[0-9]+(?:\.[0-9]+)?'), (1, '[A-Z][0-9]{4,6}'), (2, 'P[0-9]{4,6}'), (3, '[0-9]+(?:\.[0-9]+)+'), (4, '[A-Z]{2,5}-?[0-9][A-Za-z0-9_.-]*')), m AS (SELECT manual_id, count(*) AS n FROM i_codes GROUP BY manual_id)")
# which answers fit is written out by hand: q hits its quoted codes, s comes three times, c and n do not fit
_inline("fitting_patterns", "answers", "SELECT manual_id, pattern FROM i_answers WHERE manual_id IN ('q', 's')")
_inline("replaced_conventions", "bands answers", "SELECT co.* FROM co WHERE manual_id NOT IN ('q', 's') UNION ALL SELECT manual_id, 'citation_key', a.pattern, a.revision_field, coalesce(a.granularity, 'per_section'), lower(word), has_page, 'service' FROM i_answers a JOIN co USING (manual_id) WHERE manual_id IN ('q', 's')", _CONV)
_inline("conventions_of_keys", "keys", r"""SELECT manual_id, CASE WHEN n >= 2 THEN 'citation_key' ELSE 'page_number_printed' END AS field, CASE WHEN n >= 2 THEN '[0-9]{3}-[0-9]+(?:\.[0-9]+)?' END AS pattern, CASE WHEN n >= 2 THEN 'edition' END AS revision_field, CASE WHEN n >= 2 THEN 'per_section' ELSE 'none' END AS granularity, '' AS label_words, true AS has_page, CASE WHEN n >= 2 THEN 'backfill' ELSE 'fallback' END AS source
  FROM (SELECT manual_id, count(DISTINCT key) FILTER (WHERE regexp_full_match(key, '[0-9]{3}-[0-9]+(\.[0-9]+)?')) AS n FROM i_keys GROUP BY manual_id)""")
_inline("see_references", "bands texts", r"""SELECT DISTINCT manual_id, page::BIGINT AS element_id, nullif(lower(x[1]), '') AS label, upper(x[2]) AS ref FROM (SELECT manual_id, page, unnest(list_zip(regexp_extract_all(text, see, 1), regexp_extract_all(text, see, 2))) AS x FROM (SELECT t.*, '(?i)(?:see|refer to|as per|according to|acc\. to)\s+(?:(' || CASE WHEN label_words = '' THEN 'procedure|section|chapter|plate|data|drawing|appendix' ELSE replace(label_words, ',', '|') END || ')\s+)?(' || coalesce(pattern, '[A-Za-z0-9][A-Za-z0-9_.-]*') || ')' AS see FROM i_texts t JOIN co USING (manual_id) WHERE text IS NOT NULL))""", _CONV)
_inline("sampled_pages", "pages", "SELECT manual_id, page FROM (VALUES ('m1', 1), ('m1', 6), ('m1', 10), ('m1', 3), ('m2', 1), ('m2', 2), ('m2', 3)) AS v(manual_id, page)")
_inline("upsert_sections", "sections upserts", "SELECT * EXCLUDE (up), CASE WHEN EXISTS (SELECT 1 FROM u AS v WHERE v.manual_id = u.manual_id AND v.path = u.up) THEN up END AS parent_path FROM u", """x AS (SELECT manual_id, path, component_title AS title, page_start, page_end, doc_code, edition, kind, procedure_no, plate_no, component_title, action_title, 0 AS seq FROM i_sections UNION ALL SELECT manual_id, path, title, NULL, page_end, NULL, edition, NULL, NULL, NULL, NULL, NULL, seq FROM i_upserts),
u AS (SELECT manual_id, path, array_to_string(string_split(path, '/')[:-2], '/') AS up, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(page_start, seq) FILTER (WHERE page_start IS NOT NULL) AS page_start, arg_max(page_end, seq) FILTER (WHERE page_end IS NOT NULL) AS page_end, arg_max(doc_code, seq) FILTER (WHERE doc_code IS NOT NULL) AS doc_code, arg_max(edition, seq) FILTER (WHERE edition IS NOT NULL) AS edition, arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL) AS kind, arg_max(procedure_no, seq) FILTER (WHERE procedure_no IS NOT NULL) AS procedure_no, arg_max(plate_no, seq) FILTER (WHERE plate_no IS NOT NULL) AS plate_no, arg_max(component_title, seq) FILTER (WHERE component_title IS NOT NULL) AS component_title, arg_max(action_title, seq) FILTER (WHERE action_title IS NOT NULL) AS action_title FROM x GROUP BY manual_id, path)""")
_inline("upsert_fleet", "fleet new_fleet", "SELECT * FROM i_new_fleet UNION ALL SELECT * FROM i_fleet f WHERE NOT EXISTS (SELECT 1 FROM i_new_fleet n WHERE n.equipment_id = f.equipment_id AND n.manual_id = f.manual_id)")
_inline("fleet_context", "fleet manuals", "SELECT manual_id, equipment_id, f.model, title FROM i_fleet f JOIN i_manuals USING (manual_id) WHERE status = 'current'")
_inline("plate_pages", "sections elements", "SELECT manual_id, section_id, plate_no, page::INT AS page FROM (SELECT manual_id, section_id, plate_no, unnest(range(page_start, page_end + 1)) AS page FROM i_sections WHERE kind = 'plate') p WHERE NOT EXISTS (SELECT 1 FROM i_elements e WHERE e.manual_id = p.manual_id AND e.page = p.page AND e.type IN ('plate', 'figure'))")

_inline("route_query", "questions", "SELECT query_id, CASE WHEN wants_figure THEN 'lexical,structural,visual' ELSE 'lexical,structural' END AS labels FROM it", _INTENT)
_inline("ranking_boosts", "hits elements sections questions", """SELECT query_id, element_id, round(score + 4 * named + 6 * own + 2 * near
  + CASE WHEN len(list_filter(phrases, lambda p: contains(title, p))) > 0 THEN 8 WHEN len(list_filter(phrases, lambda p: contains(left(low, 400), p))) > 0 THEN 2.5::DOUBLE ELSE 0 END
  + CASE WHEN len(special) = 0 THEN 0 WHEN nt > 0 THEN least(6, 2 * nt) ELSE -10 END + least(2.5::DOUBLE, 0.8::DOUBLE * n8)
  + CASE WHEN wants_data AND kd = 'data' THEN 3 + CASE WHEN NOT wants_proc AND length(low) > 120 AND regexp_matches(low, 'clearance|diameter|torque|pressure|wear|mm|bar|nm|kg|deg|mpa|kpa|rpm|max|min') THEN 2 WHEN contains(low, 'plate') AND contains(low, 'item no') THEN -1.5::DOUBLE ELSE 0 END ELSE 0 END
  + CASE WHEN wants_proc AND kd = 'procedure' THEN 3.5::DOUBLE WHEN wants_proc AND NOT wants_data AND kd = 'data' THEN 0.5::DOUBLE ELSE 0 END
  - CASE WHEN NOT wants_figure AND kd = 'plate' THEN 2 ELSE 0 END + CASE WHEN (wants_data OR wants_proc) AND kd IN ('other', 'schedule') THEN CASE WHEN wants_schedule AND kd = 'schedule' THEN 4 ELSE -1.5::DOUBLE END ELSE 0 END
  + CASE WHEN (wants_data OR contains(asked, 'shut')) AND regexp_matches(low, 'shut off|precaution|safety check|lubricating oil') THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN wants_data AND regexp_matches(low, 'clearance|torque|diameter|wear') THEN 1 ELSE 0 END
  + CASE WHEN wants_data AND contains(low, 'nm') AND contains(concat_ws(' ', title, low), 'torque') THEN 0.8::DOUBLE ELSE 0 END
  + CASE WHEN low = '' THEN 0 ELSE 4 * d + CASE WHEN length(b) < 400 THEN 6 * d ELSE 0 END + CASE WHEN type = 'list' AND regexp_matches(b, 'minute|hour|must not exceed|keep under') THEN 6 ELSE 0 END + CASE WHEN t < 2 THEN 0 WHEN length(b) < 500 THEN 3 + 1.5::DOUBLE * t ELSE least(8, 0.6::DOUBLE * t) END + CASE WHEN type IN ('list', 'heading') AND (d > 0 OR t >= 2) THEN 4 ELSE 0 END END
  + CASE WHEN wants_decision OR list_has_any(tokens, ['stay', 'keep', 'reuse', 'scrap']) THEN CASE WHEN contains(act, 'check') THEN 3 ELSE 0 END - CASE WHEN away THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN contains(asked, 'mount') THEN CASE WHEN contains(left(low, 220), 'mount') OR contains(act, 'mount') THEN 3.5::DOUBLE ELSE 0 END - CASE WHEN away THEN 3 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS score FROM z""", f"""{_INTENT}, {_CAND},
x AS (SELECT cd.*, it.* EXCLUDE (query_id, manual_id, text, named, d), coalesce(kind, 'other') AS kd, lower(concat_ws(' ', component_title, action_title)) AS title, lower(coalesce(cd.text, '')) AS low, regexp_replace(lower(coalesce(cd.text, '')), '[-_/]', ' ', 'g') AS b, lower(coalesce(action_title, '')) AS act, array_to_string(tokens, ' ') AS asked, list_filter(component, lambda t: length(t) >= 5) AS special, {_codes('question', _PROCEDURE)} AS nums FROM cd JOIN it USING (query_id)),
z AS (SELECT *, contains(act, 'dismantl') AND NOT contains(asked, 'dismantl') AS away, len(list_filter(special, lambda t: contains(title, t))) AS nt, len(list_filter(tokens[1:8], lambda t: contains(title, t))) AS n8, len(list_filter(codes, lambda c: NOT list_contains(nums, c) AND (coalesce(c = doc_code, false) OR contains(upper(low), c)))) AS named, len(list_filter(nums, lambda c: coalesce(c = procedure_no, false))) AS own, len(list_filter(nums, lambda c: coalesce(c <> procedure_no, true) AND (contains(title, c) OR contains(low, c)))) AS near,
  len(list_filter(tokens, lambda v: (length(v) >= 4 OR regexp_matches(v, '^[0-9]')) AND contains(b, v))) AS t, len(list_filter(special, lambda v: contains(b, v))) AS d FROM x)""")
_inline("fetch_named", "hits elements sections questions", f"SELECT x.query_id, x.element_id, 40.0::DOUBLE AS score FROM x {_NEW} QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY page, x.element_id) <= 10", f"c AS (SELECT e.manual_id, e.element_id, unnest([e.procedure_no, e.plate_no, s.doc_code, e.drawing_code]) AS code FROM i_elements e LEFT JOIN i_sections s ON s.section_id = e.section_id), q AS (SELECT query_id, manual_id, unnest({_ids('text')}) AS code FROM i_questions), x AS (SELECT DISTINCT query_id, element_id FROM q JOIN c USING (manual_id, code))")
_inline("fetch_drawings", "figures questions", "SELECT DISTINCT query_id, figure_id, element_id, 48.0::DOUBLE AS score FROM i_figures f JOIN q ON q.manual_id = f.manual_id AND length(code) >= 5 AND (contains(upper(coalesce(drawing_code, '')), code) OR contains(upper(coalesce(label, '')), code)) WHERE element_id IS NOT NULL", f"q AS (SELECT query_id, manual_id, unnest({_ids('text')}) AS code FROM i_questions)")
_inline("best_plate", "hits elements figures", "SELECT query_id, figure_id, f.element_id FROM b JOIN i_figures f USING (section_id) WHERE f.element_id IS NOT NULL", "b AS (SELECT query_id, section_id FROM i_hits JOIN i_elements USING (element_id) WHERE plate_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, element_id) = 1)")
_inline("images_first", "hits figures questions", "SELECT query_id, element_id, place, image FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN wants_figure AND NOT image THEN 1 ELSE 0 END, p)::INT AS place FROM r WHERE NOT (wants_figure AND image AND nth > 6)) WHERE place <= 8 OR NOT wants_figure", f"{_INTENT}, {_RANK}, r AS (SELECT *, place AS p, row_number() OVER (PARTITION BY query_id, image ORDER BY place) AS nth FROM (SELECT rk.query_id, rk.element_id, rk.place, wants_figure, rk.element_id IN (SELECT element_id FROM i_figures WHERE element_id IS NOT NULL) AS image FROM rk JOIN it USING (query_id)))")
_inline("header_lines", "spans", "SELECT manual_id, page, string_agg(text, ' ' ORDER BY round_even(y0 / 12, 0), x0, text) AS header FROM i_spans WHERE y1 <= 62 GROUP BY manual_id, page")
_inline("route_counts", "pages", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN chars = 0 AND images = 0 AND drawings < 5 THEN 'skip' WHEN (chars = 0 AND images > 0) OR (drawings >= 200 AND chars < 400) OR (images >= 3 AND chars < 300) OR (chars < 80 AND (images > 0 OR drawings >= 20)) OR ratio > 0.25 OR (chars BETWEEN 300 AND 1200 AND drawings >= 150) THEN 'ocr' ELSE 'text' END AS route FROM i_pages) GROUP BY route")
_inline("citation_backfill", "elements", """SELECT element_id, coalesce(procedure_no, plate_no, 'p.' || page) AS citation_key, '{' || concat_ws(',', '"procedure_no":"' || procedure_no || '"', '"plate_no":"' || plate_no || '"', '"edition":"' || edition || '"') || '}' AS fields FROM i_elements""")
_inline("placed_elements", "elements sections", "SELECT e.element_id, s.section_id, coalesce(e.procedure_no, s.procedure_no) AS procedure_no, coalesce(e.plate_no, s.plate_no) AS plate_no, coalesce(step, TRY_CAST(regexp_extract(text, '^ *([0-9]{1,2})\\. ', 1) AS INT)) AS step FROM i_elements e LEFT JOIN i_sections s ON e.manual_id = s.manual_id AND e.page BETWEEN page_start AND page_end QUALIFY row_number() OVER (PARTITION BY e.element_id ORDER BY len(string_split(path, '/')) DESC NULLS LAST, page_end - page_start, s.section_id) = 1")

_inline("gate_checks", "questions hits elements manuals", """SELECT query_id, n, equipment, revision, condition, units, scope, true AS conflicts, concat_ws(',', CASE WHEN NOT equipment THEN 'equipment' END, CASE WHEN NOT revision THEN 'revision' END, CASE WHEN NOT condition THEN 'condition' END, CASE WHEN NOT units THEN 'units' END, CASE WHEN NOT scope THEN 'scope' END) AS failed,
  CASE WHEN NOT scope THEN 'no evidence covers the question' WHEN NOT equipment THEN 'the evidence is for other equipment' WHEN NOT revision THEN 'the evidence is of another edition' WHEN NOT condition THEN 'a condition is not in the evidence' WHEN NOT units THEN 'a unit is not in the evidence' ELSE 'ok' END AS reason,
  equipment AND revision AND condition AND units AND scope AS passed FROM c""", f"""{_INTENT.replace(_QT, tokens('i_questions', 'query_id, manual_id, text, equipment'))},
ev AS (SELECT query_id, lower(concat_ws(' ', text, {_CELLS})) AS b, coalesce(plate_no, procedure_no) AS code, edition FROM i_hits JOIN i_elements USING (element_id)),
bl AS (SELECT query_id, string_agg(b, ' ' ORDER BY b) AS blob, count(*)::INT AS n FROM ev GROUP BY query_id),
q AS (SELECT it.query_id, it.manual_id, it.text, phrases, tokens, component, codes, coalesce(n, 0) AS n, coalesce(blob, '') AS blob, lower(model) AS model, lower(coalesce(it.equipment, nullif(regexp_extract(upper(it.text), '[A-Z]{{2,}}[0-9]+[A-Z0-9]*'), ''))) AS wanted, upper(nullif(regexp_extract(lower(it.text), '(?:^|[^a-z0-9])(?:edition|revision|rev\\.?|ed\\.?) +([a-z]?[0-9]+[a-z]?)', 1), '')) AS ed FROM it LEFT JOIN bl USING (query_id) LEFT JOIN i_manuals m USING (manual_id)),
c AS (SELECT query_id, n, wanted IS NULL OR contains(model, wanted) OR contains(wanted, model) AS equipment, ed IS NULL OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.query_id = q.query_id AND ev.edition <> ed AND list_contains(q.codes, ev.code)) AS revision,
  NOT regexp_matches(lower(text), '(^|[^a-z0-9])(mcr|cold start|overload|idle|during start|warm-?up)([^a-z]|$)') AS condition,
  n = 0 OR regexp_matches(lower(text), '[0-9] *({_UNITS})([^a-z]|$)') OR NOT regexp_matches(lower(text), '(^|[^a-z])({_UNITS})([^a-z]|$)') OR contains(blob, regexp_extract(lower(text), '(?:^|[^a-z])({_UNITS})(?:[^a-z]|$)', 1)) AS units,
  n > 0 AND (len(list_concat(phrases[1:6], ws)) = 0 OR len(list_filter(list_concat(phrases[1:6], ws), lambda x: contains(blob, x))) > 0) AS scope FROM (SELECT *, list_filter(CASE WHEN len(component) > 0 THEN component ELSE tokens END, lambda t: length(t) >= 4)[1:6] AS ws FROM q) AS q)""")

_inline("escalated_routes", "pages", "SELECT manual_id, page, CASE WHEN (manual_id, page) IN (('m1', 4), ('m2', 2)) THEN 'text' WHEN chars = 0 AND images = 0 AND drawings < 5 THEN 'skip' WHEN reason = 'text layer' THEN 'text' ELSE 'ocr' END AS route, reason FROM r", """r AS (SELECT *, CASE WHEN chars = 0 AND images = 0 AND drawings < 5 THEN 'blank' WHEN chars = 0 AND images > 0 THEN 'image only' WHEN drawings >= 200 AND chars < 400 THEN 'drawing' WHEN images >= 3 AND chars < 300 THEN 'many images'
  WHEN chars < 80 AND (images > 0 OR drawings >= 20) THEN 'little text' WHEN ratio > 0.25 THEN 'garbled' WHEN chars >= 300 AND chars <= 1200 AND drawings >= 150 THEN 'text and drawing' ELSE 'text layer' END AS reason FROM i_pages)""")
_inline("selected_pages", "pages", "SELECT manual_id, page, 'spec' AS by FROM i_pages WHERE page IN (1, 2, 12, 40) UNION ALL SELECT manual_id, page, 'limit' FROM i_pages WHERE page <= 3 UNION ALL SELECT manual_id, page, 'all' FROM i_pages")
_inline("text_layer", "scanned", "SELECT manual_id, page, 'paragraph' AS type, trim(text) AS text, 'text_layer' AS extractor FROM i_scanned WHERE trim(text) <> ''")
_inline("filled_steps", "elements figures", "SELECT element_id, min(wanted)::INT AS step FROM i_elements LEFT JOIN (SELECT to_id AS element_id, wanted FROM y) USING (element_id) GROUP BY element_id", r"""x AS (SELECT f.element_id AS from_id, f.step AS wanted, e.element_id AS to_id, length(e.text) AS n, regexp_matches(e.text, '(^|\n)[ \t]*' || f.step || '[.][ \t\n]') AS begins
  FROM i_figures f JOIN i_elements e ON e.manual_id = f.manual_id AND e.page = f.page WHERE f.step IS NOT NULL AND f.element_id IS NOT NULL AND e.type NOT IN ('figure', 'plate') AND e.text IS NOT NULL),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY NOT begins, CASE WHEN begins THEN to_id END, n DESC, to_id) = 1)""")
_inline("upsert_figures", "figures", "SELECT figure_id, element_id, manual_id, section_id, page, image, label, panel_index, CASE WHEN figure_id = 2 THEN 'CD1-1' ELSE drawing_code END AS drawing_code, step FROM i_figures UNION ALL SELECT figure_id, element_id, manual_id, section_id, 22, image, 'P30299', panel_index, 'CD1-1', step FROM i_figures WHERE figure_id = 4")
_inline("corpus_status", "manuals sections elements figures edges fleet runs", "SELECT (SELECT count(*) FROM i_manuals) AS manuals, (SELECT count(*) FROM i_sections) AS sections, (SELECT count(*) FROM i_elements) AS elements, (SELECT count(*) FROM i_figures) AS figures, (SELECT count(*) FROM i_edges) AS edges, (SELECT count(*) FROM i_fleet) AS fleet, true AS has_data, run_id, manual_id, status FROM (SELECT * FROM i_runs ORDER BY started DESC, run_id DESC LIMIT 1)")
# worked out by hand from the rules, as the rows are few
SMALL_SQL["diagram_modes"] = "SELECT * FROM (VALUES ('m1', 1, 3::INT, 'panels', 'panels'), ('m1', 3, 0::INT, 'whole page, plate', 'skip')) AS v(manual_id, page, panels, mode, reader)"
SMALL_SQL["manual_identity"] = "SELECT * FROM (VALUES ('f1', 'feed pump manual', 'Acme', 'FP120AX', 'FEED-PUMP-MANUAL'), ('f2', 'Compressor book', NULL, 'Compressor book', 'INGESTED-MANUAL'), ('f3', 'x9', NULL, '6S50MC-C', 'X9')) AS v(manual_id, title, manufacturer, model, equipment_id)"
SMALL_SQL["bookmark_sections"] = """SELECT manual_id, pos, path, title, page_start, NULL::INT AS page_end, doc_code, edition, kind FROM (VALUES
  ('m1', 1, 'Chapter 901', 'Chapter 901', 1, NULL, NULL, 'other'), ('m1', 2, 'Chapter 901/Valve cover', 'Valve cover', 2, 'M30101', '0249', 'procedure'), ('m1', 3, 'Chapter 901/Valve cover-Data', 'Valve cover-Data', 4, 'D30101', NULL, 'data'),
  ('m1', 5, 'Chapter 12', 'Chapter 12', 6, NULL, NULL, 'other'), ('m1', 6, 'Chapter 12/Checking of the rotor', 'Checking of the rotor', 6, NULL, NULL, 'procedure'),
  ('m2', 1, 'Foreword', 'Foreword', 1, NULL, NULL, 'other'), ('m2', 2, 'Foreword', 'Foreword', 3, NULL, NULL, 'other')) AS v(manual_id, pos, path, title, page_start, doc_code, edition, kind)"""
_META = """(VALUES ('m1', 1, 'p.1', NULL, NULL, 'other', NULL, NULL, NULL, NULL, NULL), ('m1', 2, '301-1', 'M30101', '0249', 'procedure', '301-1', NULL, NULL, 'Valve cover', 'Checking'), ('m1', 3, '301-2', NULL, NULL, 'other', '301-2', NULL, NULL, NULL, NULL),
  ('m1', 4, 'D30101', 'D30101', '0S48', 'data', NULL, NULL, NULL, 'Valve cover', 'Data'), ('m1', 5, 'P30150', 'P30150', '01', 'plate', NULL, 'P30150', NULL, NULL, NULL), ('m1', 6, 'p.6', NULL, NULL, 'other', NULL, NULL, '6', NULL, NULL), ('m1', 7, 'A30101', 'A30101', '03', 'schedule', NULL, NULL, NULL, NULL, NULL),
  ('m2', 1, 'p.1', NULL, NULL, 'other', NULL, NULL, NULL, NULL, NULL), ('m2', 2, 'P99001', NULL, NULL, 'other', NULL, 'P99001', NULL, NULL, NULL), ('m2', 3, 'p.3', NULL, NULL, 'other', NULL, NULL, NULL, NULL, NULL), ('m2', 4, 'p.4', NULL, NULL, 'other', NULL, NULL, NULL, NULL, NULL)) AS v(manual_id, page, citation_key, doc_code, edition, kind, procedure_no, plate_no, printed, component_title, action_title)"""
SMALL_SQL["page_meta"] = f"SELECT * FROM {_META}"
SMALL_SQL["primary_citations"] = f"SELECT manual_id, page, citation_key || coalesce(' Ed.' || edition, '') AS primary FROM {_META}"
SMALL_SQL["extract_sections"] = """SELECT * FROM (VALUES
  ('m1', 'Chapter 901', 'Chapter 901', 1, 1, NULL, NULL, 'other', NULL, NULL, NULL, NULL, 'p.1'), ('m1', 'Chapter 901/Valve cover', 'Valve cover', 2, 3, 'M30101', '0249', 'procedure', '301-1', NULL, 'Valve cover', 'Checking', '301-1'),
  ('m1', 'Chapter 901/Valve cover-Data', 'Valve cover-Data', 4, 4, 'D30101', '0S48', 'data', NULL, NULL, 'Valve cover', 'Data', 'D30101'), ('m1', 'Chapter 901/P30150', 'P30150', 5, 5, 'P30150', '01', 'plate', NULL, 'P30150', NULL, NULL, 'P30150'),
  ('m1', 'Chapter 12', 'Chapter 12', 6, 6, NULL, NULL, 'other', NULL, NULL, NULL, NULL, 'p.6'), ('m1', 'Chapter 12/Checking of the rotor', 'Checking of the rotor', 6, 6, NULL, NULL, 'procedure', NULL, NULL, NULL, NULL, 'p.6'), ('m1', 'Chapter 12/A30101', 'A30101', 7, 7, 'A30101', '03', 'schedule', NULL, NULL, NULL, NULL, 'A30101'),
  ('m2', 'Foreword', 'Foreword', 1, 4, NULL, NULL, 'other', NULL, 'P99001', NULL, NULL, 'p.1')) AS v(manual_id, path, title, page_start, page_end, doc_code, edition, kind, procedure_no, plate_no, component_title, action_title, citation_key)"""

_inline("chapter_siblings", "hits elements sections questions", "SELECT query_id, element_id, CASE WHEN low THEN score - 22 ELSE score END AS score, false AS pinned FROM (SELECT *, query_id = 1 AND coalesce(procedure_no LIKE '301-%' AND procedure_no NOT LIKE '301-1%', false) AS low FROM cd)", _CAND)
# worked out by hand from the rules
SMALL_SQL["clause_features"] = """SELECT * REPLACE (query_id::BIGINT AS query_id) FROM (VALUES
  (1, 'cover,valve', 'Compare the rotor limits with plate P30101.', 'Compare the rotor limits with plate P30101.', 1, 'P30101', ''),
  (2, '', 'Is 0.45 mm right for the gap,', 'Is 0.45 mm right for the gap', 0, '', ''),
  (3, 'belt,drive,seal,shaft', 'Rotor gap', 'Rotor gap, not shaft-seal.', 0, '', ''),
  (4, 'a12-03,a12-04,bearing,shell', 'Which limit holds for A12-03,', 'Which limit holds for A12-03,', 0, '', ''),
  (5, '', 'Torque of D30101 and KN902-1.3', 'Torque of D30101 and KN902-1.3', 0, '902-1.3,D30101,KN902-1.3', ''),
  (6, '', '', '', 0, '', ''), (7, NULL, NULL, NULL, NULL, NULL, NULL),
  (8, '301-1,p30201', '', 'not the 301-1 sheet but 302-1; avoid P30201.', 0, '', '')) AS v(query_id, negatives, positive, first_clause, compares, named, keys)"""
_inline("pin_pairs", "hits elements sections", "SELECT query_id, element_id, pin AS pinned, CASE WHEN pin THEN 'kind pair' END AS rule FROM (SELECT *, coalesce(kind IN ('data', 'procedure') AND kinds = 2 AND row_number() OVER (PARTITION BY query_id, component_title, kind ORDER BY score DESC, element_id) = 1, false) AS pin FROM (SELECT h.*, s.kind, component_title, count(DISTINCT CASE WHEN s.kind IN ('data', 'procedure') THEN s.kind END) OVER (PARTITION BY query_id, component_title) AS kinds FROM i_hits h JOIN i_elements e USING (element_id) LEFT JOIN i_sections s ON s.section_id = e.section_id))")
_inline("describes_pairs", "hits edges elements sections", f"SELECT x.query_id, x.element_id, 10.0::DOUBLE AS score FROM x JOIN i_sections s USING (section_id) {_NEW} AND e.type IN ('paragraph', 'table', 'heading', 'list') QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY CASE WHEN regexp_matches(lower(coalesce(action_title, '')), 'check|inspect') THEN 0 ELSE 1 END, e.type <> 'table', length(coalesce(e.text, '')) DESC, x.element_id) <= 8", """p AS (SELECT a.section_id AS a, b.section_id AS b FROM i_edges r JOIN i_elements a ON a.element_id = from_id JOIN i_elements b ON b.element_id = to_id WHERE r.type = 'describes'),
x AS (SELECT DISTINCT query_id, o.section_id, o.element_id FROM i_hits h JOIN i_elements e USING (element_id) JOIN (SELECT * FROM p UNION SELECT b, a FROM p) y ON y.a = e.section_id JOIN i_elements o ON o.section_id = y.b)""")
_inline("citation_records", "hits elements sections", f"SELECT query_id, h.element_id, coalesce('Plate ' || e.plate_no, 'Procedure ' || coalesce(e.procedure_no, s.doc_code), 'page ' || e.page) || CASE WHEN coalesce(e.plate_no, e.procedure_no, s.doc_code) IS NOT NULL THEN coalesce(' edition ' || e.edition, '') ELSE '' END AS reference, coalesce(e.plate_no, e.procedure_no, s.doc_code, 'p.' || e.page) AS citation_key, e.page, s.kind, round(score, 6) AS score, left(coalesce(nullif(trim(e.text), ''), {_CELLS}, 'Figure/plate on page ' || e.page), 240) AS snippet FROM i_hits h JOIN i_elements e USING (element_id) LEFT JOIN i_sections s ON s.section_id = e.section_id")
_inline("short_citations", "hits elements sections", f"SELECT query_id, place, element_id, reference FROM (SELECT rk.query_id, rk.place::INT AS place, rk.element_id, coalesce('Plate ' || e.plate_no, 'Procedure ' || coalesce(e.procedure_no, s.doc_code), 'page ' || e.page) || CASE WHEN coalesce(e.plate_no, e.procedure_no, s.doc_code) IS NOT NULL THEN coalesce(' edition ' || e.edition, '') ELSE '' END AS reference FROM rk JOIN i_elements e USING (element_id) LEFT JOIN i_sections s ON s.section_id = e.section_id) QUALIFY row_number() OVER (PARTITION BY query_id, reference ORDER BY place) = 1", _RANK)
# worked out by hand from the rules, as the rows are few
_BOXES = "(VALUES ('m1', 1, 0, 50.0, 50.0, 290.0, 390.0, 'AB1-1', 1), ('m1', 1, 1, 310.0, 50.0, 560.0, 390.0, 'AB1-2', 2), ('m1', 1, 2, 50.0, 420.0, 290.0, 760.0, 'AB1-3', 3), ('m1', 2, 0, 100.0, 100.0, 400.0, 400.0, 'AB2-1', 1), ('m2', 1, 0, 0.0, 0.0, 100.0, 100.0, 'ZZ9-9', 7)) AS v(manual_id, page, panel, x0, y0, x1, y1, code, step)"
SMALL_SQL["panel_boxes"] = f"SELECT manual_id, page, panel, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM {_BOXES}"
SMALL_SQL["panel_codes"] = f"SELECT manual_id, page, panel, code FROM {_BOXES}"
SMALL_SQL["panel_steps"] = f"SELECT manual_id, page, panel, step FROM {_BOXES}"
SMALL_SQL["diagram_panels"] = f"SELECT manual_id, page, panel, x0::DOUBLE || ',' || y0::DOUBLE || ',' || x1::DOUBLE || ',' || y1::DOUBLE AS bbox, code, step FROM {_BOXES}"
SMALL_SQL["completed_plates"] = "SELECT manual_id, section_id::BIGINT AS section_id, page, 'plate' AS type, text, plate_no, edition, plate_no AS citation_key FROM (VALUES ('m1', NULL, 5, 'P30150', 'P30150', NULL), ('m1', 15, 21, 'Rotor - P30201', 'P30201', 'A1'), ('m2', NULL, 2, 'P99001', 'P99001', NULL)) AS v(manual_id, section_id, page, text, plate_no, edition)"
_PANELS = f"SELECT manual_id, page, 'figure' AS type, CASE WHEN page = 1 AND panel = 0 AND manual_id = 'm1' THEN 'CODE: XX1-1' || chr(10) || 'STEP: 9' WHEN page = 2 THEN 'CODE: none' || chr(10) || 'turn it' || chr(10) || ' 5. lift' END AS text, CASE WHEN manual_id = 'm1' AND page = 1 THEN 'Rotor - Mounting - ' ELSE '' END || 'step ' || step || ' - ' || code AS caption, code AS figure_ref, panel, code, step FROM {_BOXES}"
SMALL_SQL["diagram_elements"] = f"{_PANELS} UNION ALL SELECT 'm1', 1, 'paragraph', 'A text of some forty characters or a little more', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'm1', 3, 'figure', NULL, 'Page 3', 'page-3', NULL, NULL, NULL"
SMALL_SQL["attached_panels"] = f"SELECT * REPLACE (NULL::VARCHAR AS text) FROM ({_PANELS}) WHERE manual_id = 'm1' AND page = 1 UNION ALL SELECT 'm1', 1, 'paragraph', 'stays', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'm1', 3, 'plate', NULL, 'plate', 'y', NULL, NULL, NULL UNION ALL SELECT 'm1', 9, 'figure', NULL, 'alone', 'z', NULL, NULL, NULL"
# compositions of the statements above
_DRAWN = " UNION ".join(f"SELECT from_id, to_id, type FROM (<<{x}>>)" for x in ("describes_by_title", "illustrates_plate", "cross_refs", "step_links"))
_inline("build_edges", "edges", f"{_DRAWN} EXCEPT SELECT from_id, to_id, type FROM i_edges")
_inline("query_log", "questions hits elements sections", f"SELECT g.query_id, passed, reason, NOT passed AS abstained, CASE WHEN passed THEN coalesce(dump, '{config.Settings.abstain_text}') ELSE '{config.Settings.abstain_text}' END AS answer, text AS query_text, ids AS retrieved, 'rrf' AS fusion_method FROM (<<gate_checks>>) g JOIN i_questions USING (query_id) LEFT JOIN dm USING (query_id)", f"""{_RANK},
ln AS (SELECT rk.query_id, rk.place, rk.element_id, '[' || coalesce('Plate ' || e.plate_no, 'Procedure ' || coalesce(e.procedure_no, s.doc_code), 'page ' || e.page) || CASE WHEN coalesce(e.plate_no, e.procedure_no, s.doc_code) IS NOT NULL THEN coalesce(' edition ' || e.edition, '') ELSE '' END || '] ' || left(coalesce(nullif(trim(e.text), ''), {_CELLS}, ''), 240) AS t FROM rk JOIN i_elements e USING (element_id) LEFT JOIN i_sections s ON s.section_id = e.section_id),
dm AS (SELECT query_id, string_agg(t, chr(10) ORDER BY place) FILTER (WHERE place <= 5) AS dump, string_agg(element_id::VARCHAR, ',' ORDER BY place) AS ids FROM ln GROUP BY query_id)""")

_TERMS = f"{_QT}, te AS (SELECT query_id, manual_id, unnest(list_distinct(list_filter(list_transform(tokens[1:10], lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3))) AS term FROM ph), nt AS (SELECT query_id, count(*) AS nt FROM te GROUP BY query_id), mt AS (SELECT query_id, element_id, count(*) AS n, any_value(length(text)) AS size, any_value(page) AS page FROM te JOIN (SELECT manual_id, element_id, text, page, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS term FROM i_elements WHERE text IS NOT NULL) USING (manual_id, term) GROUP BY query_id, element_id)"
_inline("lexical_or_inline", "elements questions", "SELECT query_id, element_id, (n + 1.0)::DOUBLE AS score FROM mt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 20", _TERMS)
_inline("lexical_and_inline", "elements questions", "SELECT query_id, element_id, (n + 0.5)::DOUBLE AS score FROM mt JOIN nt USING (query_id) WHERE n = nt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size DESC, page, element_id) <= 10", _TERMS)

_inline("lexical_by_kind", "elements sections questions", "SELECT query_id, element_id, (n + 1.0)::DOUBLE AS score FROM (SELECT mt.*, CASE WHEN wants_schedule THEN CASE WHEN kd IN ('schedule', 'data', 'procedure') THEN 0 ELSE 1 END WHEN wants_proc AND wants_data THEN CASE WHEN kd IN ('data', 'procedure') THEN 0 ELSE 1 END WHEN wants_proc THEN CASE kd WHEN 'procedure' THEN 0 WHEN 'data' THEN 1 ELSE 2 END ELSE CASE kd WHEN 'data' THEN 0 WHEN 'procedure' THEN 1 ELSE 2 END END AS early FROM mt JOIN it USING (query_id) JOIN (SELECT element_id, coalesce(kind, '') AS kd FROM i_elements LEFT JOIN i_sections USING (section_id)) USING (element_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY early, n DESC, size DESC, page, element_id) <= 3", _TERMS.replace(_QT, _INTENT))
_inline("text_functions", "raws", r"SELECT id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '-', 'g') AS dashed, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS squeezed, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS code, CASE WHEN text IS NULL THEN 0.0 ELSE round(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / length(text), 6) END::DOUBLE AS ratio, CASE id WHEN 1 THEN 3 WHEN 3 THEN 4 END::INT AS k FROM i_raws")
# worked out by hand from the rules
SMALL_SQL["panel_ocr"] = "SELECT * FROM (VALUES ('m1', 1, 1, 'AB12', 4), ('m1', 1, 2, 'AB1234-5', 3)) AS v(manual_id, page, panel, code, step)"
SMALL_SQL["ocr_elements"] = "SELECT * FROM (VALUES ('m1', 2, 0, 'heading', 'Pump', '1.0,2.0,3.0,4.0'), ('m1', 2, 1048576, 'figure', 'Figure 7', NULL), ('m2', 1, 0, 'heading', 'Head', NULL), ('m2', 1, 1, 'list', '- one' || chr(10) || '- two', NULL), ('m2', 1, 2, 'paragraph', 'words', NULL), ('m2', 1, 1048576, 'figure', 'Head', NULL)) AS v(manual_id, page, nth, type, text, bbox)"
SMALL_SQL["layout_elements"] = """SELECT * FROM (VALUES ('m1', 'heading', 1, 'A b', NULL, '1.0,2.0,3.0,4.0'), ('m1', 'list', 2, 'x', NULL, NULL), ('m1', 'table', 2, NULL, '{"grid":[[{"text":"y"}]]}', NULL), ('m1', 'figure', 1, 'Pump', NULL, NULL)) AS v(manual_id, type, page, text, table_json, bbox)"""
# compositions of the statements above
for _known in (SMALL_SQL, _PROJECTED_SQL):
    _known["_early"] = _known["lexical_by_kind"].replace("<= 3", "<= 20")
    _known["_all_terms"] = _known["lexical_by_kind"].replace("<= 3", "<= 10").replace("(n + 1.0)", "(n + 0.5)").replace("FROM mt JOIN it", "FROM (SELECT mt.* FROM mt JOIN nt ON nt.query_id = mt.query_id AND nt.nt = mt.n) AS mt JOIN it")
_inline("lexical_path", "elements questions", "SELECT query_id, element_id, score + 1 AS score FROM (SELECT *, min(probe) OVER (PARTITION BY query_id, element_id) AS first FROM u) WHERE probe = first GROUP BY query_id, element_id, score, probe QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, probe, element_id) <= 20", f"""{_TERMS},
ov AS (SELECT query_id, element_id FROM (SELECT te.query_id, element_id, count(*) AS n, length(text) AS size FROM te JOIN i_elements e ON e.manual_id = te.manual_id AND length(term) >= 5 AND contains(lower(text), term) WHERE length(text) BETWEEN 24 AND 2500 GROUP BY te.query_id, element_id, text) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, size, element_id) <= 16),
u AS (SELECT query_id, element_id, score, 0 AS probe FROM (<<_early>>) UNION ALL SELECT query_id, element_id, score, 1 FROM (<<_all_terms>>) UNION ALL SELECT DISTINCT query_id, element_id, 2.5, 2 FROM (<<phrase_probe_titles>>) UNION ALL SELECT DISTINCT query_id, element_id, 1.5, 3 FROM (<<_first_named>>) UNION ALL SELECT query_id, element_id, 3.8, 4 FROM ov)""")
for _known, _out in ((SMALL_SQL, SMALL_SQL), (_PROJECTED_SQL, ORACLE_SQL)):
    del _known["_early"], _known["_all_terms"], _known["_first_named"]
    _figures = _known["figure_probe"].replace(" WHERE NOT (wants_data AND NOT wants_figure AND NOT wants_proc)", "")
    _out["visual_path"] = f"SELECT query_id, figure_id, score, text FROM ({_figures}) JOIN ({_known['figure_backfill']}) USING (figure_id)"
