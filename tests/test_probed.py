"""The lexical probes that meet a block together, against each probe on its own."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, retrieve

TEXTS = ["Rotor casing, worn down by use", "rotor rotor gasket and its housing", "casing gasket rotor bearing seat", None, "Gasket\nring of steel and rubber", "the rotorcasing holds, casing", "bearing-gasket torn by the rotor", ""]
ASKED = {1: "rotor casing gasket", 2: "bearing gasket pump", 3: "torn flange", 4: "rotor", 5: "of the"}
PROBES = ["query_id", "element_id", "score", "probe"]


@pytest.fixture
def rows(spark, monkeypatch):
    """Blocks of about three elements; an element and a section are there twice, and some sections are of no element or not there."""
    monkeypatch.setattr(blocks, "SIZE", 3)
    monkeypatch.setattr(blocks, "ASKED", 2)
    e = [(i, f"m{i % 2}", i // 3 if i % 7 else None, i // 4, t) for i, t in enumerate(TEXTS * 5)]
    s = [(i, kind, f"Pump {i}", "Bearing gasket" if i % 3 else None, f"Torn/flange/doc-{i}") for i, kind in enumerate(["data", "procedure", "schedule", None, "other", "plate"])]
    q = [(i + 10 * m, f"m{m}", t) for i, t in ASKED.items() for m in (0, 1)]
    elements = spark.createDataFrame([*e, e[2]], "element_id long, manual_id string, section_id long, page long, text string")
    sections = spark.createDataFrame([*s, s[1], (99, "data", "Rotor", None, "x")], "section_id long, kind string, component_title string, action_title string, path string")
    return elements, sections, spark.createDataFrame(q, "query_id long, manual_id string, text string")


def _apart(e, q, k, s):
    """Each probe with a pass over the texts of its own, and phrases pair by pair: an element counts as often as it is there with its section."""
    parts = [retrieve.lexical_or(e, q, k, s), retrieve.lexical_and(e, q, k, s), None, None, retrieve.overlap_probe(e, q)]
    out = [(r["query_id"], r["element_id"], round(r["score"], 6), n) for n, p in enumerate(parts) if p is not None for r in p.collect()]
    about = F.concat_ws("\n", "component_title", "action_title", "path") if s is not None else F.lit(None)
    texts = [r.asDict() for r in (e.join(s, "section_id", "left") if s is not None else e).withColumn("about", about).collect()]
    for r in retrieve.by_phrases(q, 14).collect():
        held = [t for t in texts if t["manual_id"] == r["manual_id"] and r["term"] in "\n".join(x for x in (t["text"], t["about"]) if x).lower()]
        held.sort(key=lambda t: (t["text"] is None, len(t["text"] or ""), t["element_id"]))
        out += [(r["query_id"], t["element_id"], 2.5, 2) for t in held[:8]]
    return sorted(out)


@pytest.mark.parametrize("with_sections", [True, False])
def test_probes_together_are_the_probes_apart(rows, with_sections):
    e, s, q = rows
    s = s if with_sections else None
    got = sorted((r["query_id"], r["element_id"], round(r["score"], 6), r["probe"]) for r in retrieve._probed(e, q, 5, s).select(*PROBES).collect())
    want = _apart(e, q, 5, s)
    assert {p for *_, p in want} >= {0, 1, 2, 4}
    assert got == want


def test_texts_meet_questions_once(rows, monkeypatch):
    """Every probe dealt the texts into blocks anew, and a join with sections moved them before that."""
    e, s, q = rows
    calls, dealt = [], blocks.dealt
    monkeypatch.setattr(blocks, "dealt", lambda *a, **k: calls.append(1) or dealt(*a, **k))
    retrieve.lexical_path(e, s, q).collect()
    assert len(calls) == 1


def test_words_that_contain_a_part():
    import numpy as np
    import pyarrow as pa

    words = ["steamdrivenfeedpumps", "pump", "feedpump", "pumps", "12.5", "umpump", "steamdrivenfeedpump", "x"]
    w = blocks.Words.listed(pa.chunked_array([pa.array([[x] for x in words])]), np.arange(len(words)), len(words))
    for part in ("p", "pump", "feedpump", "pumps", "steamdrivenfeedpump", "amdrivenfeedpumps", "2.5", "umpum", "zz", "pumpspump"):
        assert w.containing(part).tolist() == [i for i, x in enumerate(words) if part in x]


def test_boosts_are_the_same_where_questions_go_to_texts(spark):
    """Hits brought their texts to the questions: a text was shuffled once a hit."""
    from tidemill.operators import rank
    from tidemill.plans import engine

    e = [(1, 1, "m1", "list", "Rotor seal: torque 12 nm, see 100-1", None, "100-1", "rotor"), (2, 1, "m1", "paragraph", None, "{}", "100-1", None), (2, 1, "m1", "paragraph", "Rotor and seal of steel", None, "100-1", None), (3, None, "m1", "heading", "ROTOR D0001", None, None, None)]
    elements = spark.createDataFrame([*e, e[0]], "element_id long, section_id long, manual_id string, type string, text string, table_json string, procedure_no string, drawing_code string")
    sections = spark.createDataFrame([(1, "data", "Rotor seal", "Checking", "D0001", "a/b")], "section_id long, kind string, component_title string, action_title string, doc_code string, path string")
    q = spark.createDataFrame([(1, "m1", "torque of the rotor seal 100-1 D0001"), (2, "m1", "steel")], "query_id long, manual_id string, text string")
    hits = spark.createDataFrame([(a, b, 1.0 + b) for a in (1, 2) for b in (1, 2, 3)], "query_id long, element_id long, score double")
    columns = ["query_id", "element_id", "score", "seq"]
    want = retrieve.boosts(rank.candidates(hits, elements, sections), q).select(*columns)
    # copies that differ share an element, so which of them comes first is open
    scores = lambda df: sorted((r["query_id"], r["element_id"], r["score"]) for r in df.collect())
    slim = rank.candidates(hits, engine._slim(elements), sections)
    assert "text" not in slim.columns
    got = retrieve.boosts(slim, q, engine._texts(elements)).select(*columns)
    assert len(scores(want)) == 10 and scores(got) == scores(want)


def test_codes_of_a_text_are_what_they_were(spark):
    texts = ["See AB1234-5, D000123;P1234 100-1 100-1.5", "no code", "x_D000123 D000123_x D000123-1\n200-3", None, "(M1234)/A12-34 12345", "D0001 D0002  D0003"]
    from tidemill import config
    from tidemill.functions import text as T

    old = F.array_distinct(F.concat(*[T.codes_in(F.col("t"), p) for p in (config.PROCEDURE_PATTERN, config.DRAWING_PATTERN, config.DOC_CODE_PATTERN)]))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(old.alias("old"), T.identifiers(F.col("t")).alias("new")).collect()
    assert [r["old"] for r in rows] == [r["new"] for r in rows]
    assert rows[0]["new"] == ["100-1", "100-1.5", "AB1234-5", "AB1234", "D000123", "P1234"]
