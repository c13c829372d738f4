"""Carries against loops in Python, with blocks of four rows, and on tables that are empty, null or one key."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import carry, graph

SCHEMA = "k string, t int, i int, v int, _k int, later string"


def _rows(n, hot, seed):
    r = random.Random(seed)
    return [(r.choice(["hot"] * hot + ["a", "b", None]), r.choice([None, *range(n // 3 + 1)]), i, r.choice([None, None, r.randrange(9)]), i, "x") for i in range(n)]


def _null_first(x):
    return (x is not None, x or 0)


def _loop(rows, own, total):
    want = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", _null_first(r[1]), r[2])), key=lambda r: r[0]):
        state = None
        for r in group:
            new = state if r[3] is None else r[3] + (state or 0 if total else 0)
            want.append((r[2], new if own else state))
            state = new
    return sorted(want)


@pytest.mark.parametrize("n, hot", [(0, 1), (1, 1), (300, 1), (400, 30), (200, 10_000)])
@pytest.mark.parametrize("own", [True, False])
def test_carries_equal_loops(spark, n, hot, own):
    rows = _rows(n, hot, n + own)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for call, total in ((carry.last_known, False), (carry.running_sum, True)):
        out = call(df, ["k"], ["t", "i"], {"v": F.col("v")}, own, 2)
        assert sorted(out.columns) == sorted(df.columns)
        assert sorted((r.i, r.v) for r in out.collect()) == _loop(rows, own, total)


def test_blocks_bound_what_a_task_gets_of_a_key(spark):
    """No window is by key alone but the one over a row a partition."""
    df = spark.range(5_000).select(F.lit("hot").alias("k"), "id", F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))
    out = carry.last_known(df, ["k"], ["id"], {"v": F.col("v")}, block_bits=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [last") == 3 and "CartesianProduct" not in plan
    assert out.where("id >= 7 and v <> floor((id - 7) / 1000) * 1000 + 7 or id < 7 and v is not null").count() == 0


def test_asof_takes_the_last_mark_that_is_not_after(spark):
    r = random.Random(5)
    asked = [(r.choice(["hot"] * 9 + ["a", None]), r.choice([None, *range(60)]), i, "own") for i in range(300)]
    marks = [(r.choice(["hot"] * 9 + ["a", "z", None]), r.choice([None, *range(60)]), r.randrange(5), r.choice([None, "x", "y"])) for _ in range(80)]
    rows = spark.createDataFrame(asked, "k string, t int, i int, said string")
    told = spark.createDataFrame(marks, "k string, at long, n int, said string")
    got = sorted((x.i, x.said, x.n) for x in carry.asof(rows, told, ["k"], "t", "at", ["said", "n"], ["n"], block_bits=2).collect())
    want = []
    for k, t, i, _ in asked:
        before = [m for m in marks if k is not None and t is not None and m[0] == k and m[1] is not None and m[1] <= t]
        best = max(before, key=lambda m: (m[1], m[2], m[3] is not None, m[3] or ""), default=None)
        want.append((i, best and best[3], best and best[2]))
    assert got == sorted(want, key=lambda x: x[0])
    assert carry.asof(rows, told.limit(0), ["k"], "t", "at", ["said"]).where("said is not null").count() == 0


def test_section_ends_with_ties_nulls_and_no_rows(spark):
    starts = spark.createDataFrame([("m", 1), ("m", 1), ("m", 5), ("m", None), (None, 2), (None, 7)], "manual_id string, page_start int")
    got = {(r.manual_id, r.page_start, r.page_end) for r in graph.section_ends(starts, F.lit(99)).collect()}
    assert got == {("m", 1, 4), ("m", 5, 99), ("m", None, 99), (None, 2, 6), (None, 7, 99)}
    assert graph.section_ends(starts.limit(0), F.lit(99)).count() == 0
