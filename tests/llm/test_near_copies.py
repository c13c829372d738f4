"""One row of each class of near copies stays, whatever the ids are."""

import corpus_pipeline as P
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(word, n=60):
    return " ".join(f"{word}{k}" for k in range(n))


def _left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SMALL).collect()), key=str)


def test_repeated_and_null_ids_leave_one_row_a_class(spark):
    a, b, c, d, e = map(_text, "abcde")
    near = a + " more"
    rows = [(1, a), (1, a), (None, b), (None, b), (None, b), (2, c), (None, c), (3, d), (None, e), (4, None), (4, None)]
    assert _left(spark, rows) == sorted([(1, a), (None, b), (2, c), (3, d), (None, e), (4, None), (4, None)], key=str)
    # of one id with two texts, only the text that is a copy goes
    assert _left(spark, [(1, a), (2, near), (2, d)]) == sorted([(1, a), (2, d)], key=str)
    # nor are two texts of one id a class for that
    assert _left(spark, [(1, a), (1, b), (2, near), (3, b)]) == sorted([(1, a), (1, b)], key=str)


def test_smallest_id_stays_wherever_its_row_is(spark):
    a = _text("a")
    assert _left(spark, [(9, a), (5, a + " x"), (7, a), (3, a + " y")]) == [(3, a + " y")]
    assert _left(spark, [(9, a), (5, a + " x"), (7, a), (None, a), (3, a + " y")]) == [(3, a + " y")]
