"""Rows of ask hold no texts: questions go to the texts, with the same result."""

from pyspark.sql import functions as F

from tidemill.operators import rank
from tidemill.plans import engine
from tidemill.plans.queries import _knowledge
from tidemill.sources import inline


def test_boost_by_texts_beside_the_rows(spark):
    t = inline.Inline(spark)
    hits, e, s, q = (t(n) for n in ("hits", "elements", "sections", "questions"))
    columns = ["query_id", "element_id", F.round("score", 6), "pinned", "rule", "seq"]
    want = rank.final_boost(rank.candidates(hits, e, s), q).select(*columns).collect()
    got = rank.final_boost(rank.candidates(hits, engine._slim(e), s), q, engine._texts(e))
    assert not {"text", "table_json", "blob"} & set(got.columns)
    assert len(want) > 0 and sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want))


def test_ranked_rows_hold_no_texts(spark):
    t = inline.Inline(spark)
    rows = engine.ranked(_knowledge(t), t("questions"))
    assert rows.count() > 0 and not {"text", "table_json"} & set(rows.columns)
