"""A question without a manual is put to each of them, and answered as if it were asked there."""

from pyspark.sql import functions as F

from tidemill.operators import retrieve
from tidemill.plans import engine
from tidemill.plans.queries import RULES, _knowledge
from tidemill.sources import inline


class _Open(inline.Inline):
    """The small corpus with two questions that name no manual."""

    def __call__(self, name):
        df = super().__call__(name)
        return df.withColumn("manual_id", F.when(~F.col("query_id").isin(1, 3), F.col("manual_id"))) if name == "questions" else df


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_ask_looks_in_every_manual(spark):
    rows = {r["query_id"]: r for r in RULES["ask"](_Open(spark)).collect()}
    assert len(rows) == 7
    assert rows[1]["passed"] and "45 Nm" in rows[1]["answer"]
    assert rows[3]["passed"] and "p20.png" in rows[3]["diagrams"]


def test_single_pass_looks_in_every_manual(spark):
    t = _Open(spark)
    assert {1, 2, 3} <= {r[0] for r in _rows(engine.single_pass(_knowledge(t), t("questions")), "query_id")}


def test_probes_take_a_question_that_is_put_to_several_manuals(spark):
    t = inline.Inline(spark)
    e, s, f = t("elements"), t("sections"), t("figures")
    q = t("questions").where("query_id in (1, 3)").withColumn("manual_id", F.lit(None).cast("string"))
    put = retrieve.for_every_manual(q, t("manuals"))
    assert put.count() == 4
    # questions of their own, a manual each, find the same
    alone = put.withColumn("query_id", F.col("query_id") * 10 + F.substring("manual_id", 2, 1).cast("long"))
    for probe in (lambda x: retrieve.lexical(e, x, 100, s), lambda x: retrieve.structural(s, e, x, 100), lambda x: retrieve.figure_probe(f, e, s, x, 100)):
        one, each = probe(put).select("query_id", "element_id"), probe(alone).select((F.col("query_id") / 10).cast("long").alias("query_id"), "element_id")
        assert len(_rows(one, "query_id", "element_id")) == one.distinct().count()
        assert _rows(one, "query_id", "element_id") == _rows(each.distinct(), "query_id", "element_id")
