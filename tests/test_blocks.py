"""Questions that meet elements block by block, against loops in Python."""

import pytest

from tidemill.operators import blocks, retrieve

TEXTS = ["rotor casing", "rotor rotor gasket", "casing gasket rotor bearing", "nothing here", "gasket", "the rotor, casing", "bearing-gasket torn"]
ASKED = {1: "rotor casing gasket", 2: "bearing gasket", 3: "torn flange", 4: "rotor"}


@pytest.fixture
def rows(spark, monkeypatch):
    """Blocks of about three elements and parts of two questions; one element is there twice."""
    monkeypatch.setattr(blocks, "SIZE", 3)
    monkeypatch.setattr(blocks, "ASKED", 2)
    e = [(i, "m1", i // 4, t) for i, t in enumerate(TEXTS * 6)]
    q = [(i, "m1", t) for i, t in ASKED.items()]
    return e, spark.createDataFrame([*e, e[2]], "element_id long, manual_id string, page long, text string"), spark.createDataFrame(q, "query_id long, manual_id string, text string")


def test_counts_over_blocks(rows):
    e, elements, questions = rows
    got = {(r["query_id"], r["element_id"]): r["score"] for r in retrieve.lexical_or(elements, questions, 5).collect()}
    want = {}
    for q, text in ASKED.items():
        n = {i: len(set(text.split()) & set(t.replace(",", " ").replace("-", " ").split())) * (2 if i == 2 else 1) for i, _, _, t in e}
        best = sorted((i for i in n if n[i]), key=lambda i: (-n[i], -len(e[i][3]), e[i][2], i))[:5]
        want |= {(q, i): n[i] + 1.0 for i in best}
    assert got == want


def test_few_rows_leave_a_block(rows):
    _, elements, questions = rows
    words = retrieve._worded(elements)
    out = blocks.counted(words, retrieve._asked(questions), [("size", False), ("page", True), ("element_id", True)], 1)
    assert 0 < out.count() <= len(ASKED) * 15  # 43 rows in 15 blocks, one each a question


def test_phrases_begin_and_end_inside_words(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 2)
    texts = ["heatpump seals", "pump seal", "pump  seal", "pump, seal", "a pump seal ring", "the old pump seal ring fits", "gap 12.5 mm", "é pump sealé", "", "..", "pump seal\nring", "old  pump seal ringlet"]
    terms = ["pump seal", "2.5 mm", "pump seal ring", "old seal", "dpump seal"]
    e = spark.createDataFrame([(i, "m1", t, len(t)) for i, t in enumerate(texts)], "element_id long, manual_id string, low string, size int")
    q = spark.createDataFrame([("m1", t) for t in terms], "manual_id string, low string")
    got = {(r["low"], r["element_id"]) for r in blocks.with_phrases(e, q, 9).collect()}
    assert got == {(t, i) for t in terms for i, x in enumerate(texts) if t in x}


def test_a_shared_key_is_not_multiplied_by_its_questions(spark):
    """Hits at the head of a key push others in, and a key's rows beyond those are never joined with its questions."""
    from tidemill.operators import rank

    elements = spark.createDataFrame([(i, "m1", "100-1", "list", "x" * (i + 1)) for i in range(60)], "element_id long, manual_id string, procedure_no string, type string, text string")
    hits = spark.createDataFrame([(q, e, 1.0) for q, es in {1: range(0, 10), 2: [3], 3: [59]}.items() for e in es], "query_id long, element_id long, score double")
    got = {(r["query_id"], r["element_id"]) for r in rank.list_siblings(hits, elements).collect()}
    assert got == {(1, i) for i in range(10, 18)} | {(2, i) for i in (0, 1, 2, 4, 5, 6, 7, 8)} | {(3, i) for i in range(8)}
    own = elements.select("manual_id", "procedure_no", "element_id", "text").withColumn("size", __import__("pyspark.sql.functions", fromlist=["x"]).length("text"))
    asked = hits.select("query_id").distinct().selectExpr("query_id", "'m1' as manual_id", "'100-1' as procedure_no")
    assert rank._first_new(asked, own, hits, ["manual_id", "procedure_no"], ["size", "element_id"], 8).count() == 24
