"""Whole user turns as questions, against a model of the probes in plain Python."""

import pytest

from tidemill import config
from tidemill.plans.queries import QUERIES
from tidemill.sources import project

TURNS = [
    (1, 0, "system", "rotor casing bearing"), (1, 1, "user", "hello dear friend today our rotor casing near bearing flange quietly leaking again"), (1, 2, "assistant", "rotor casing"),
    (1, 3, "user", "rotor"), (2, 0, "user", "good morning dear colleague flange gasket torn"), (2, 2, "user", "flange gasket\nand rotor casing"), (3, 0, "user", None), (22, 398, "user", "gasket torn"),
]
DOCS = [
    (10, "our rotor casing was opened\nbearing flange, quietly leaking again\nrotor rotor\n\nnothing of note"), (11, "a flange gasket, torn at an edge\nflange gasket torn\ndear colleague good morning hello"), (12, "friend today"),
]
MANUAL = {10: "src1", 11: "src2", 12: "src1"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("questions"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    rows = [(i, t, "en", MANUAL[i], len(t)) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def _asked():
    return {c * 1000 + n: (f"src{c % 20}", t) for c, n, role, t in TURNS if role == "user" and t is not None}


def _lines():
    return [(i * 100_000 + k, MANUAL[i], i * 100 + 1 + k // 10, x) for i, t in DOCS for k, x in enumerate(t.split("\n")) if x.strip()]


def _tokens(text):
    return list(dict.fromkeys(w for w in text.replace("\n", " ").split() if w not in config.STOPWORDS and len(w) >= 3))


def _words(line):
    return set(line.replace(",", " ").split())


def test_every_user_turn_is_a_whole_question(spark, small):
    got = {r["query_id"]: (r["manual_id"], r["text"]) for r in project.questions(project.load(spark, small, "conversations")).collect()}
    assert got == _asked() and set(got) == {1001, 1003, 2000, 2002, 22398}
    assert {r["name"]: r["n"] for r in QUERIES["corpus_counts"](spark, small).collect()} == {"sections": 3, "elements": len(_lines()), "questions": 5}


def test_lexical_probes_use_whole_questions(spark, small):
    either, every = {}, {}
    for q, (m, text) in _asked().items():
        terms = _tokens(text)[:10]
        for e, of, _, line in _lines():
            n = len([t for t in terms if t in {w for w in _words(line) if len(w) >= 3}])
            if of == m and n:
                either[q, e] = n + 1.0
                if n == len(terms):
                    every[q, e] = n + 0.5
    rows = lambda name: {(r["query_id"], r["element_id"]): r["score"] for r in QUERIES[name](spark, small).collect()}
    assert rows("lexical_or_topk") == either
    assert rows("lexical_and_topk") == every
    assert set(rows("lexical_bm25")) == set(either)
    hits = {(r["query_id"], r["element_id"]) for r in QUERIES["diversify"](spark, small).collect()}
    assert hits == set(either)


def test_phrases_and_overlap_use_whole_questions(spark, small):
    phrases, overlap = set(), {}
    for q, (m, text) in _asked().items():
        t = _tokens(text)
        two = [f"{a} {b}" for a, b in zip(t, t[1:])]
        skip = [f"{a} {b}" for a, b in zip(t, t[2:]) if len(a) >= 5 and len(b) >= 3]
        three = [" ".join(x) for x in zip(t, t[1:], t[2:])]
        every = list(dict.fromkeys(two[:8] + skip + two[8:] + three))[:14]
        for e, of, _, line in _lines():
            if of == m:
                phrases |= {(q, k, e) for k, p in enumerate(every) if p in line}
                if 24 <= len(line) <= 2500 and (n := len([x for x in t[:10] if len(x) >= 5 and x in line])):
                    overlap[q, e] = n
    assert {(r["query_id"], r["nth"], r["element_id"]) for r in QUERIES["phrase_probe"](spark, small).collect()} == phrases
    assert {(r["query_id"], r["element_id"]): r["hits"] for r in QUERIES["overlap_probe"](spark, small).collect()} == overlap
    fused = {(r["query_id"], r["element_id"]) for r in QUERIES["rrf_fuse"](spark, small).collect()}
    assert {x for x in overlap} <= fused
