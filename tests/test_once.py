"""Work on a text that is done once: the plans of rules that go through tokens, and what they return."""

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import gate, retrieve


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_lowered_once_for_all_tokens(spark):
    """What stood in a lambda over tokens was done again for each of them."""
    rows = spark.createDataFrame([("Seal_ring 42 mm, hour", ["seal", "ring", "42"], ["seal", "42000"], "list"), (None, ["seal"], [], "list"), ("seal", [], [], "list")], "text string, tk array<string>, special array<string>, kind string")
    out = rows.select(retrieve.overlap_score(F.col("text"), F.col("tk"), F.col("special"), F.col("kind")).alias("x"))
    assert _plan(out).count("[-_/]") == 1
    # three tokens: 3 + 1.5 * 3; a limit: 6; a list with two tokens: 4
    assert [r["x"] for r in out.collect()] == [17.5, 0.0, 0.0]


def test_a_question_is_read_once_by_the_gate(spark):
    q = spark.createDataFrame([(1, "m1", "what gap has the seal ring 100-1", None)], "query_id long, manual_id string, text string, equipment string")
    e = spark.createDataFrame([(7, "the seal ring", None, None, "100-1", "E1")], "element_id long, text string, table_json string, plate_no string, procedure_no string, edition string")
    m = spark.createDataFrame([("m1", "AC77")], "manual_id string, model string")
    out = gate.checks(q, spark.createDataFrame([(1, 7)], "query_id long, element_id long"), e, m)
    assert _plan(out).count("([a-z][a-z0-9]*|") == 1
    assert [(r["passed"], r["n"]) for r in out.collect()] == [(True, 1)]


def test_stopwords_go_and_tokens_stay_in_order(spark):
    rows = spark.createDataFrame([("The seals, and the seal of a Nm gap; seals 7 12 0.5 gets get",), ("the of",), (None,)], "text string")
    got = [r["t"] for r in rows.select(T.content_tokens(F.col("text")).alias("t")).collect()]
    assert got == [["seal", "nm", "gap", "12", "0.5"], [], None]
