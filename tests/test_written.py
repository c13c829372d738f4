"""Upserts that write: order, repeats, cut attempts, awkward rows; JSON of unknown depth against a walk over Python's values."""

import json

import pytest

from tidemill.functions import variant
from tidemill.operators.upsert import Upserts

SCHEMA = "k string, j long, v long, a string, b double, c string, d string, gone boolean"
ROWS = [
    ("x", 1, 1, "a1", 1.0, "c1", "d1", False), ("x", 1, 2, None, 2.0, None, "d2", False), ("x", 1, 3, "a3", None, "c3", None, None),
    ("x", 1, 3, "a3", None, "c3", None, None), ("x", 1, 3, "a9", None, "c2", None, False),
    ("y", 1, 5, "a5", 5.0, "c5", "d5", False), ("y", 1, 6, None, None, None, None, True), ("y", 1, 7, None, 7.0, None, "d7", False),
    ("z", 2, 1, "a1", 1.0, "c1", "d1", False), ("z", 2, 9, None, None, None, None, True), ("z", 2, 4, "a4", None, None, None, False),
    (None, 1, 1, "n1", None, None, None, False), (None, 1, None, "old", 3.0, None, "first", False), ("w", None, 2, None, None, None, None, False),
    ("t", 1, 1, "lost", None, None, None, False), ("t", 1, 1, None, None, None, None, True),
]


def table(folder, spark, buckets=4):
    return Upserts(f"file://{folder}", SCHEMA, ("k", "j"), ("v",), ("a", "b"), ("c",), ("d",), "gone", buckets).create(spark)


def one_by_one(rows):
    """The rule by a loop over all rows in the order of versions."""
    low = lambda x: (x is not None, x if x is not None else 0)
    out, first = {}, {}
    for k, j, v, a, b, c, d, gone in sorted(rows, key=lambda r: (low(r[2]), bool(r[7]), (r[3] is not None, r[3] or ""), (r[5] is not None, r[5] or ""))):
        if gone:
            out.pop((k, j), None)
            continue
        if (k, j) not in first or low(v) == first[k, j][0] and (d is not None, d or "") < first[k, j][1]:
            first[k, j] = low(v), (d is not None, d or ""), d
        old = out.get((k, j), {})
        best = max(c, old["c"], key=lambda x: (x is not None, x or "")) if old.get("v") == low(v) else c
        out[k, j] = {"v": low(v), "a": a if a is not None else old.get("a"), "b": b if b is not None else old.get("b"), "c": best}
    return sorted(((k, j, r["a"], r["b"], r["c"], first[k, j][2]) for (k, j), r in out.items()), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("k", "j", "a", "b", "c", "d").collect()), key=str)


def test_batches_in_any_order_and_again(spark, tmp_path):
    parts = [ROWS[0::3], ROWS[1::3], ROWS[2::3]]
    for n, order in enumerate(((0, 1, 2), (2, 0, 1))):
        t = table(tmp_path / str(n), spark)
        for number in (*order, order[0]):
            t.write(spark.createDataFrame(parts[number], SCHEMA), number)
        assert found(t.rows(spark)) == one_by_one(ROWS)
        if n == 0:
            assert found(t.from_changes(spark)) == one_by_one(ROWS)
            ledger = {r.batch: (r.event, r.n_rows) for r in t.ledger(spark).collect()}
            assert ledger == {i: ("done", len(p)) for i, p in enumerate(parts)}
            assert t.row_of(spark, k="y", j=1).collect()[0].b == 7.0 and t.row_of(spark, k=None, j=1).count() == 1 and t.row_of(spark, k="z", j=2).count() == 0
            assert "bucket" in t.row_of(spark, k="y", j=1)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_empty_batches_and_other_columns(spark, tmp_path):
    t = table(tmp_path, spark)
    assert t.rows(spark).count() == 0
    t.write(spark.createDataFrame([], SCHEMA), 0)
    assert t.rows(spark).count() == 0
    more = spark.createDataFrame([(*ROWS[0], 7, "x", 3)], SCHEMA + ", bucket int, key string, newest int")
    t.write(more, 1)
    assert found(t.rows(spark)) == one_by_one(ROWS[:1])


def test_an_attempt_that_was_cut_loses_nothing(spark, tmp_path):
    t = table(tmp_path, spark)
    t.write(spark.createDataFrame(ROWS[:8], SCHEMA), 0)
    t._note(spark, 1, "started", {})  # and then, between two buckets, the end: a bucket is gone
    spark.createDataFrame([], t._stored(spark)).write.mode("overwrite").partitionBy("bucket").parquet(f"{t.folder}/state")
    assert t.rows(spark).count() == 0
    t.write(spark.createDataFrame(ROWS[8:], SCHEMA), 1)
    assert found(t.rows(spark)) == one_by_one(ROWS)
    assert {r.event for r in t.ledger(spark).collect()} == {"done"}


def test_stream_by_files(spark, tmp_path):
    for i, part in enumerate((ROWS[8:], ROWS[:8])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    t = table(tmp_path / "t", spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t.write_stream(stream, f"{tmp_path}/checkpoint").awaitTermination()
    t.write_stream(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert found(t.rows(spark)) == one_by_one(ROWS) and t.ledger(spark).count() == 2


TEXTS = [
    '{"a": 1, "b": {"c": [1, "x", null, {"d": true}]}, "e": [], "f": {}}', "[[[[1]]], [2]]", '"[{ only a string }]"', "7", "null", "true", "-1.5", '{"q\\"[": "]}{"}', '{"text": "a [b] {c"}',
    '{"deep": ' + '{"x": ' * 30 + '"end"' + "}" * 30 + "}", '["' + "long " * 20000 + '"]', '{"sp ace": {"": 1}}',
]
BROKEN = ["", "{", "{'a': 1}", "nothing", '{"a": 1, "a": 2}', "[1,]"]


def walked(text):
    def walk(path, x):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
        yield path, kind, None if kind in ("object", "array", "null") else json.dumps(x) if kind != "string" else x
        for k, v in x.items() if isinstance(x, dict) else ():
            yield from walk(f"{path}.{k}", v)
        for i, v in enumerate(x if isinstance(x, list) else ()):
            yield from walk(f"{path}[{i}]", v)

    return list(walk("$", json.loads(text)))


@pytest.mark.parametrize("levels", [None, 40])
def test_paths_equal_a_walk(spark, levels):
    rows = [(i, t) for i, t in enumerate(TEXTS + BROKEN + [None] + TEXTS[:1])]
    df = spark.createDataFrame(rows, "id long, j string").selectExpr("id", "j")
    got = sorted((tuple(r) for r in variant.paths(df, "j", ["id"], levels).select("id", "path", "kind", "value").collect()), key=str)
    want = [(i, *p) for i, t in rows if t is not None and t not in BROKEN for p in walked(t)] + [(i, "$", "invalid", None) for i, t in rows if t in BROKEN]
    assert got == sorted(want, key=str)


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, j string")
    assert variant.paths(none, "j", ["id"]).count() == 0 and variant.catalog(variant.paths(none, "j", [])).count() == 0
    assert variant.paths(spark.createDataFrame([(1, None)], "id long, j string"), "j", ["id"]).count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a": [1]}')], "id long, j string")
    assert "Exchange" not in variant.paths(df, "j", ["id"], 4)._jdf.queryExecution().executedPlan().toString()
