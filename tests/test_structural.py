"""Sections by codes, titles and components, against loops over all pairs; and how few of them meet questions."""

import pytest

from tidemill.functions import text as T
from tidemill.operators import blocks, retrieve

S = [(i, "m1" if i % 4 else "m2", kind, code, f"Rotor {i % 3} {name}", act) for i, (kind, code, name, act) in enumerate(
    [("data", "D0001", "casing", "Notes"), ("plate", "P0001", "casing", "Plate"), ("other", "X0001", "cover seal", None), ("procedure", "M0001", "seal ring", "Checking"), ("other", "X0001", "bolts", "Notes"), ("other", "X0002", "bolts washer", "Notes")] * 12)]
Q = ["about D0001 please", "where is X0001", "rotor casing of P0001", "the cover seal leaks", "bolts washer", "washer gap", "ring", "nothing named", "casing", "bolts", "bolts washer", "cover seal X0002"]


@pytest.fixture(scope="module")
def tables(spark):
    e = [(i * 10 + j, i, m, 500 - (i * 7) % 90 + j // 2) for i, m, *_ in S for j in range(4) if i % 11]
    s = spark.createDataFrame([(i, m, k, c, None, None, t, a) for i, m, k, c, t, a in S], "section_id long, manual_id string, kind string, doc_code string, procedure_no string, plate_no string, component_title string, action_title string")
    q = spark.createDataFrame([(n, m, t) for n, (m, t) in enumerate((m, t) for t in Q for m in ("m1", "m2"))], "query_id long, manual_id string, text string")
    return s, spark.createDataFrame(e, "element_id long, section_id long, manual_id string, page int"), q, e


def _want(questions, e, k):
    out = {}
    for r in questions.select("query_id", "manual_id", T.intent(questions.text).alias("i"), T.phrases(T.content_tokens(questions.text)).alias("p")).collect():
        own = [(i, kind, c, " ".join(x for x in (t, a) if x).lower()) for i, m, kind, c, t, a in S if m == r["manual_id"]]
        two = r["i"]["component_tokens"][:2]
        c = {i: 2.8 for i, _, _, t in own if any(p in t for p in list(dict.fromkeys(r["p"]))[:10])} | {i: 3.0 for i, _, code, _ in own if code in r["i"]["codes"]}
        if not any(kind in ("data", "procedure") for i, kind, *_ in own if i in c):
            both = [i for i, _, _, t in own if len(two) == 2 and all(x in t for x in two)]
            more = both or ([] if c else [i for i, _, _, t in own if any(x in t for x in two)])
            c = {i: 2.0 for i in more} | c
        rows = sorted((-c[s], page, x) for x, s, _, page in e if s in c)[:k]
        out |= {(r["query_id"], x): -s for s, _, x in rows}
    return out


def test_sections_of_questions(tables, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 5)
    s, e, q, rows = tables
    got = {(r["query_id"], r["element_id"]): r["score"] for r in retrieve.structural(s, e, q, 6).collect()}
    assert got == _want(q, rows, 6) and len(set(got.values())) == 3


def test_a_code_of_many_sections_is_not_multiplied(tables):
    s, e, q, _ = tables
    titled = retrieve._titled(s, e)
    assert retrieve._by_code(titled, q.where("text = 'where is X0001'"), 2).count() == 4  # 24 sections have it
    assert retrieve._by_title(titled, q.where("text = 'the cover seal leaks'"), 2).count() == 4
    assert retrieve._by_component(titled, q.where("text = 'bolts'"), 2).count() == 4
