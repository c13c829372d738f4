"""Phrases are looked for where texts are, against pairs in Python; no text is dealt into blocks for them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, retrieve

WORDS = ["a", "rotor", "motor", "casing", "casings", "in", "inner", "1", "15", "5", "mm", "supercalifragilistic", "é", "bärings", "cover"]


def _case(seed):
    r = random.Random(seed)
    gap = lambda: r.choice([" ", " ", " ", "-", ".", "  ", ", ", "\n", "\t", "/"])
    text = lambda n: "".join(r.choice(WORDS[:8]) + gap() if r.random() < 0.6 else r.choice(WORDS) + gap() for _ in range(n))
    texts = [(i, f"m{i % 2}", i // 20 if i % 11 else None, None if i % 17 == 3 else text(r.randrange(14))) for i in range(400)]
    ascii_words = [w for w in WORDS if w.isascii()]
    terms = {(f"m{r.randrange(2)}", r.choice([" ", " ", " ", "-"]).join(r.choice(ascii_words) for _ in range(r.choice([2, 2, 3, 4])))) for _ in range(150)}
    return texts + texts[:8], sorted(terms | {("m0", "torn away"), ("m3", "rotor casing")})


@pytest.fixture
def undealt(monkeypatch):
    def fail(*a, **k):
        raise AssertionError("texts are dealt")

    monkeypatch.setattr(blocks, "dealt", fail)


def _first(found, k):
    """The first k (size, element) of each term; nulls last."""
    return sorted((m, t, e) for (m, t), rows in found.items() for *_, e in sorted(rows)[:k])


@pytest.mark.parametrize("k", [3, 1000])
def test_phrases_are_found_where_texts_are(spark, undealt, k):
    texts, terms = _case(k)
    df = spark.createDataFrame(texts, "element_id long, manual_id string, section_id long, text string").repartition(5)
    got = blocks.with_phrases(df.select("manual_id", "element_id", F.lower("text").alias("low"), F.char_length("text").alias("size")), spark.createDataFrame(terms, "manual_id string, low string"), k)
    found = {(m, t): [(len(x), e) for e, n, _, x in texts if n == m and x is not None and t in x.lower()] for m, t in terms}
    assert sum(map(len, found.values())) > 30
    assert sorted((r["manual_id"], r["low"], r["element_id"]) for r in got.collect()) == _first(found, k)


@pytest.mark.parametrize("k", [4, 1000])
def test_phrases_of_titles_too(spark, undealt, k):
    texts, terms = _case(k + 1)
    r = random.Random(k)
    say = lambda: " ".join(r.choice(WORDS) for _ in range(3))
    sections = [(i, say() if i % 3 else None, say() if i % 4 else None, f"{say()}/{say()}") for i in range(22)]
    sections = [*sections, sections[1], (2, "torn away", None, None)]
    e = spark.createDataFrame(texts, "element_id long, manual_id string, section_id long, text string")
    s = spark.createDataFrame(sections, "section_id long, component_title string, action_title string, path string")
    found = {}
    for m, t in terms:
        for i, n, section, x in texts:
            for about in [a for a in sections if a[0] == section] or [(None,)]:
                held = (x is not None and t in x.lower()) or any(t in y.lower() for z in about[1:] if z for y in (z.split("/") if z == about[-1] else [z]))
                if n == m and held:
                    found.setdefault((m, t), []).append((x is None, len(x or ""), i))
    got = retrieve.holding(e, spark.createDataFrame(terms, "manual_id string, low string"), k, s)
    assert any(x for rows in found.values() for x, *_ in rows) and ("m0", "torn away") in found
    assert sorted((r["manual_id"], r["low"], r["element_id"]) for r in got.collect()) == _first(found, k)
