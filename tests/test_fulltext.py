"""The stemmer, the stored index and the substring probe against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions.stem import stem
from tidemill.operators import retrieve, textindex

STEMS = """consigned consign;consigning consign;consignment consign;consistency consist;consolatory consolatori;consolidating consolid;consolingly consol;consonant conson;conspicuously conspicu;conspiracies conspiraci
constables constabl;knackeries knackeri;knaves knave;kneeled kneel;knightly knight;knitting knit;knives knive;knockers knocker;bearings bear;tightening tighten;lubrication lubric;pressures pressur;generator generat
hopping hop;hoping hope;happy happi;by by;say say;cries cri;ties tie;gas gas;gaps gap;this this;valves valv;agreed agre;feed feed;operation oper;clearance clearanc;communication communic;skis ski;inning inning
proceed proceed;youth youth;boy boy;flying fli;analogies analog;relational relat;vietnamization vietnam;adjustable adjust;rolling roll;bed bed;shed shed;added ad;3 3;a1s a1;yyys yyi;ly ly"""


def test_stems_of_known_words(spark):
    pairs = [tuple(p.split()) for line in STEMS.splitlines() for p in line.split(";") if "yyys" not in p]
    got = spark.createDataFrame(pairs, "word string, want string").withColumn("got", stem(F.col("word")))
    assert got.where("not got <=> want").collect() == []
    assert spark.sql("select cast(null as string) as w").select(stem(F.col("w"))).first()[0] is None


def _lines(n, seed=4):
    r = random.Random(seed)
    words = "bearing bearings oil oils pump pumping valve 3.5 12 gap-size naïve m2 x".split()
    return [(f"m{i % 3}", i, i // 4, " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(r.choice([0, 1, 3, 9, 30])))) for i in range(n)]


SCHEMA = "manual_id string, element_id long, page long, text string"


@pytest.fixture(scope="module")
def elements(spark):
    rows = _lines(300) + [("m0", 900, 1, None), (None, 901, 1, "oil"), ("m1", 902, 1, "ÖL İ oil")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(elements):
    return textindex.build(elements.repartition(3, "element_id"), textindex.IndexHow(block=16))


def _terms(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, manual_id string, term string")


def _words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_blocks_hold_every_word_once(spark, elements, index):
    rows = index.postings.collect()
    texts = {r["element_id"]: r for r in elements.where("manual_id is not null and text is not null").collect()}
    every = [r for r in rows if r["word"] == textindex.ALL]
    assert sorted(i for r in every for i in r["ids"]) == sorted(texts) and max(r["n"] for r in every) <= 16
    seen = {}
    for r in rows:
        assert r["n"] == len(r["ids"]) == len(set(r["ids"]))
        if r["word"] == textindex.ALL:
            continue
        assert r["most"] == max(r["times"]) and r["least"] == min(r["lens"]) and {texts[i]["manual_id"] for i in r["ids"]} == {r["manual_id"]}
        for s in r["spots"]:
            seen[(r["ids"][s >> 32], (s & 0xFFFFFFFF) >> 2)] = r["word"]
    assert seen == {(i, k): w for i, r in texts.items() for k, w in enumerate(_words(r["text"]))}


def test_early_termination_gives_what_full_scoring_gives(spark, elements, index):
    terms = _terms(spark, (1, "m0", "bearing"), (1, "m0", "pump"), (1, "m0", "naïve"), (2, "m1", "oils"), (3, "m2", "nothing"), (4, "m9", "oil"))
    asked = textindex.words_with_stems(index, terms)
    order = [F.desc("score"), F.desc("size"), F.asc("page"), F.asc("element_id")]
    for scoring, weighed in ((textindex.counting(order), False), (textindex.okapi(), True)):
        opened = []
        got = textindex.best(index, asked, 2, scoring, weighed, opened).select("query_id", "element_id", "score").collect()
        every = textindex.TextIndex(index.postings, index.vocabulary, index.statistics, textindex.IndexHow(block=16, first=10_000))
        assert sorted(got) == sorted(textindex.best(every, asked, 2, scoring, weighed).select("query_id", "element_id", "score").collect())
        blocks, read = opened[0].count(), opened[1].count()
        assert {r["query_id"] for r in got} == {1, 2} and read <= blocks
    # occurrences and lengths differ from block to block, so bounds tell blocks apart
    assert read < blocks


def test_changed_elements_replace_older_ones(spark, elements, index):
    change = spark.createDataFrame([("m0", 0, 0, "governor governor"), ("m0", 3, 0, None), ("m0", 5000, 9, "new governors")], SCHEMA)
    newer = textindex.added(textindex.added(index, change), change.where("element_id = 0"))
    ask = lambda word: {r["element_id"] for r in textindex.best(newer, textindex.words_with_stems(newer, _terms(spark, (1, "m0", word))), 1000, textindex.counting([F.desc("score")])).collect()}
    assert ask("governor") == {0, 5000}
    texts = {r["element_id"]: _words(r["text"]) for r in elements.where("manual_id = 'm0'").collect()}
    assert ask("oil") == {i for i, w in texts.items() if {"oil", "oils"} & set(w)} - {0, 3}
    assert {r["element_id"] for r in textindex.holding(newer, _terms(spark, (1, "m0", "governor"))).collect()} == {0, 5000}


TERMS = ["bearing", "ear", "oil", "il", "oil pump", "g val", "pump 3.5 12", "gs oil", "3.5", "12 gap", "m2", "x x", "zzz", "valve valve"]


def test_substrings_by_brute_force(spark, elements, index):
    terms = [(i, f"m{i % 2}", t) for i, t in enumerate(TERMS * 2)]
    texts = [(r["manual_id"], r["element_id"], r["text"].lower()) for r in elements.where("manual_id is not null and text is not null").collect()]
    want = sorted((i, e) for i, m, t in terms for n, e, x in texts if m == n and t in x)
    asked = _terms(spark, *terms)
    got = retrieve.containing(elements, asked)
    assert sorted((r["query_id"], r["element_id"]) for r in got.collect()) == want
    got = textindex.holding(index, asked, 2)
    assert sorted((r["query_id"], r["element_id"]) for r in got.collect()) == want


def test_empty_tables(spark, elements):
    empty = textindex.build(elements.limit(0))
    terms = _terms(spark, (1, "m0", "oil"), (1, "m0", "oil pump"))
    assert textindex.best(empty, textindex.words_with_stems(empty, terms), 5, textindex.okapi(), True).count() == 0
    assert textindex.holding(empty, terms).count() == 0
    assert retrieve.containing(elements.limit(0), terms).count() == 0 and retrieve.containing(elements, terms.limit(0)).count() == 0


def test_a_batch_meets_groups_of_blocks(spark, elements, monkeypatch):
    """Questions in parts, elements in groups, changed elements and questions alike: scores of loops, and few rows leave a group."""
    monkeypatch.setattr(textindex, "SIZE", 20)
    monkeypatch.setattr(textindex, "ASKED", 2)
    index = textindex.build(elements.repartition(3, "element_id"), textindex.IndexHow(block=8, lean=True))
    index = textindex.added(index, spark.createDataFrame([("m0", 0, 0, "pumps oil"), ("m0", 3, 0, None)], SCHEMA))
    terms = {1: ["bearing", "pump"], 2: ["pump", "bearing"], 3: ["oil"], 4: ["valve", "zzz"], 5: ["zzz"]}
    asked = textindex.words_with_stems(index, _terms(spark, *[(q, "m0", t) for q, ts in terms.items() for t in ts]))
    stems = {"bearings": "bearing", "bearing": "bearing", "oils": "oil", "pumping": "pump", "pumps": "pump"}
    texts = {r["element_id"]: r for r in elements.where("manual_id = 'm0' and text is not null").collect()}
    said = {i: (r["text"], r["page"]) for i, r in texts.items()} | {0: ("pumps oil", 0), 3: ("", 0)}
    held = {i: {stems.get(w, w) for w in _words(t)} for i, (t, _) in said.items()}
    got = [(r["query_id"], r["element_id"], r["score"]) for r in textindex.best_of_batch(index, asked, 4).collect()]
    want = []
    for q, ts in terms.items():
        n = {i: len(set(ts) & held[i]) for i in said}
        want += [(q, i, float(n[i])) for i in sorted((i for i in n if n[i]), key=lambda i: (-n[i], -len(said[i][0]), said[i][1], i))[:4]]
    assert sorted(got) == sorted(want)
    n = spark.createDataFrame([(q, len(ts)) for q, ts in terms.items()], "query_id long, n_features int")
    got = {(r["query_id"], r["element_id"]) for r in textindex.best_of_batch(index, asked, 1000, wanted=n).collect()}
    assert got == {(q, i) for q, ts in terms.items() for i in said if set(ts) <= held[i]} and got
    full = textindex.added(textindex.build(elements, textindex.IndexHow(block=16)), spark.createDataFrame([("m0", 0, 0, "pumps oil"), ("m0", 3, 0, None)], SCHEMA))
    want = textindex.best(full, asked, 4, textindex.okapi(), True).select("query_id", "element_id", "score").collect()
    for one in (index, full):
        got = textindex.best_of_batch(one, asked, 4, (1.2, 0.75)).select("query_id", "element_id", "score").collect()
        assert sorted((q, i, round(x, 5)) for q, i, x in got) == sorted((q, i, round(x, 5)) for q, i, x in want)
    assert index.postings.where("word <> '' and (spots is not null or size(ids) > 0)").count() == 0 < index.postings.count()


def test_rows_that_are_handed_over_have_no_null_lists(spark, monkeypatch):
    """Null lists were gone through again for each row behind them, which took most of the time."""
    real = textindex._group_scores

    def checked(k, weights):
        run = real(k, weights)

        def best(e, q):
            assert not any(e[c].null_count for c in ("ids", "sizes", "pages", "lens", "gone", "at", "times"))
            return run(e, q)

        return best

    monkeypatch.setattr(textindex, "_group_scores", checked)
    rows = [(i, "m0", 1, "rotor " * (1 + i % 3) + ("gasket" if i % 2 else "pump")) for i in range(3000)]
    elements = spark.createDataFrame(rows, "element_id long, manual_id string, page long, text string")
    index = textindex.build(elements, textindex.LEAN)
    asked = textindex.words_with_stems(index, _terms(spark, (1, "m0", "rotor"), (1, "m0", "gasket")))
    assert sorted(r["element_id"] for r in textindex.best_of_batch(index, asked, 4).collect()) == [5, 11, 17, 23]
    found = sorted((-r["score"], r["element_id"]) for r in textindex.best_of_batch(index, asked, 4, (1.2, 0.75)).collect())
    every = sorted((-r["score"], r["element_id"]) for r in textindex.best_of_batch(index, asked, 3000, (1.2, 0.75)).collect())
    assert len(every) == 3000 and found == every[:4]
