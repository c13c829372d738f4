"""Edges from texts to numbers that many sections carry."""

import pytest

from tidemill.operators import graph

SECTIONS = [(i, "m1", k, n) for i, (k, n) in enumerate([("procedure", "100-1")] * 20 + [("data", "100-1")] * 20 + [("data", "200-1.2"), ("procedure", "200-1.2"), ("data", "200-1.3")])]


@pytest.fixture(scope="module")
def tables(spark):
    """Each section's first text refers to numbers; the first sections carry these themselves."""
    said = "see data 100-1, refer to 100-1 and see 200-1"
    s = spark.createDataFrame([(i, m, k, n, None, None, "Part", None) for i, m, k, n in SECTIONS], "section_id long, manual_id string, kind string, procedure_no string, plate_no string, doc_code string, component_title string, action_title string")
    e = spark.createDataFrame([(i * 10, i, m, 1, said if i % 2 else "see 100-1 or see 200-1") for i, m, _, _ in SECTIONS], "element_id long, section_id long, manual_id string, page int, text string")
    return e, s


def _want():
    out = set()
    for i, *_ in SECTIONS:
        for ref in ("100-1", "200-1"):
            data = ref == "100-1" and i % 2 == 1
            own = [(n, (k == "data") != data, j * 10, k) for j, _, k, n in SECTIONS if j != i and (n == ref or (ref == "200-1" and n.startswith("200-1.")))]
            _, _, to, kind = min(own)
            out.add((i * 10, to, "references_data" if kind == "data" else "references_section"))
    return out


def test_a_number_of_many_sections(tables):
    e, s = tables
    assert {tuple(r) for r in graph.cross_references(e, s).collect()} == _want()


def test_texts_do_not_meet_all_sections_of_a_number(spark):
    rows = spark.createDataFrame([("m1", "100-1", "100-1", k, i) for i, k in enumerate(["data", "procedure"] * 50)] + [("m1", "100-1", f"100-1.{j}", "data", 900 + j) for j in range(30)], "manual_id string, ref string, key string, kind string, to_id long")
    assert sorted(r["to_id"] for r in graph._first_targets(rows).collect()) == [0, 1, 2, 3, 900]


def test_plates_take_the_first_procedure_of_their_code(spark):
    s = spark.createDataFrame([(i, "m1", k, c) for i, (k, c) in enumerate([("plate", "P012302"), ("procedure", "M012399"), ("procedure", "M992302"), ("procedure", "M012301"), ("plate", "P012303"), ("procedure", "M992302")])], "section_id long, manual_id string, kind string, doc_code string")
    e = spark.createDataFrame([(i * 10, i, 1) for i in range(6)], "element_id long, section_id long, page int")
    assert {(r["from_id"], r["to_id"]) for r in graph.plates_by_code(s, e).collect()} == {(0, 20), (40, 10)}
