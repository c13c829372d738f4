"""Rows that share a doc_id, ties, and models by brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm.test_ops import DOCS, _brute_suffix, _suffix_rows
from tidemill.llm import decontam, lang_id, ngram_join, packing, suffix_dedup, toxicity, url_filter
from tidemill.llm import queries as Q


def _words(seed, n, size):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_near_classes_tell_texts_of_one_id_apart(spark):
    a, b = _words(1, 80, 10**6), _words(2, 80, 10**6)
    rows = [(1, a), (7, a + " x"), (7, b + " x"), (8, b), (9, "alone in the world of words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_classes(docs).collect())
    assert got == [(1, 1, 1), (7, 1, 1), (7, 7, 1), (8, 7, 1), (9, 9, 0)]


def test_loose_groups_fall_apart_before_they_are_verified(spark):
    """A chain of texts that share bands only by chance, and a tight group in it."""
    r, rows, base = random.Random(9), [], [f"c{k}" for k in range(60)]
    for i in range(40):  # each is 0.5 to 0.7 like the next
        base = base[8:] + [f"c{i}n{k}" for k in range(8)]
        rows.append((i, " ".join(base)))
    tight = [f"t{k}" for k in range(100)]
    for i in range(30):
        w = list(tight)
        w[r.randrange(100)] = f"z{i}"
        rows.append((100 + i, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    links = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= 0.8} for d in sets}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.near_classes(docs, ngram_join.NgramJoin(block=6)).collect()}
    assert got == {d: len(x) for d, x in links.items()}


def test_suffix_dedup_with_two_texts_of_one_id(spark):
    a, b, c = _words(3, 30, 10**6), _words(4, 30, 10**6), "-" * 3000
    rows = [(2, a), (2, b), (2, a), (5, a + b), (1, b), (None, a), (6, c), (7, c[:2000] + "x" + c[:70]), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    for how in (suffix_dedup.SuffixDedup(), suffix_dedup.SuffixDedup(flush_bytes=10, windows=50)):
        assert _suffix_rows(docs, how) == _brute_suffix(rows, 50)


def test_suffixes_are_in_order():
    r = random.Random(4)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(4000)).encode() + b"a" * 500, "u1")
    starts = np.arange(0, 4400, 3)
    room = np.array([r.randrange(20, 100) for _ in starts])
    number = suffix_dedup.equal_suffixes(data, starts, room, suffix_dedup.SuffixDedup())
    strings = [data[s : s + n].tobytes() for s, n in zip(starts.tolist(), room.tolist(), strict=True)]
    want = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert number.tolist() == [want[x] for x in strings]


def test_long_common_prefixes(monkeypatch):
    """Prefixes longer than what is compared at once, also at the end of the data."""
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    r = random.Random(6)
    parts = [b"a" * 300, b"a" * 299 + b"b", b"a" * 300, b"ab" * 90, b"ab" * 90, b"a" * 150, b"ab" * 89 + b"b"]
    r.shuffle(parts)
    data = np.frombuffer(b"".join(parts), "u1")
    room = np.array([len(x) for x in parts])
    number = suffix_dedup.equal_suffixes(data, np.cumsum(room) - room, room, suffix_dedup.SuffixDedup())
    want = {x: k for k, x in enumerate(sorted(set(parts)))}
    assert number.tolist() == [want[x] for x in parts]


def test_partition_sort_is_a_sort():
    r = np.random.default_rng(3)
    key = r.integers(0, 50, 20_000).astype("u8")
    new = np.zeros(20_000, bool)
    new[[0, 5, 12_000]] = True
    order = suffix_dedup.partition_sort(key, new, small=16)
    seg = np.cumsum(new)
    assert (order == np.lexsort((key, seg))).all() or ((key[order] == key[np.lexsort((key, seg))]).all() and (np.sort(order) == np.arange(20_000)).all() and (seg[order] == seg).all())


def test_packing_carries_all_that_can_still_move(spark):
    """Sequences are as many as without a bound on what goes up the tree."""
    import pandas as pd

    r = random.Random(5)
    for trial in range(20):
        leaves = [[r.choice((2100, 2600, 3000, 3900, 400, 700, 1500)) for _ in range(60)] for _ in range(9)]
        fills = [[sum(s for s, b in zip(x, packing.best_fit(x, 4096), strict=True) if b == k) for k in range(max(packing.best_fit(x, 4096)) + 1)] for x in leaves]
        small = sum(f <= 2048 for x in fills for f in x)
        how = packing.Packing("", fan_in=3)
        for bound in (small, 10**9):
            level, done = [pd.DataFrame({"node": k // 3, "fill": x, "members": [[{"bin": k * 1000 + i, "shift": 0}] for i in range(len(x))]}) for k, x in enumerate(fills)], 0
            for last in (False, True):
                groups = [pd.concat(level[k : k + 3]) for k in range(0, len(level), 3)]
                merged = [packing._merge(how, last, bound)(g) for g in groups if len(g)]
                done += sum(int((~m.is_open).sum()) for m in merged)
                level = [m[m.is_open][["node", "fill", "members"]].assign(node=0) for m in merged]
            if bound == small:
                bounded = done
        assert bounded == done, trial


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_packing_is_near_the_lower_bound(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs.repartition(parts), packing.Packing(Q.tokenizer_path("word_bpe_49k.json"), fan_in=2)).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(rows) <= -(-sum(r["n"] for r in rows) // 4096) + 1


def test_language_by_brute_force(spark):
    """Profiles, distances, winner and score, counted one by one."""
    def grams(text):
        runs = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        s = " " + " ".join(runs) + " "
        out = Counter()
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                if s[i : i + k].strip():
                    out[s[i : i + k]] += 1
        return out if runs else Counter()

    def ranks(count):
        code = lambda g: sum((ord(c) if c != " " else 0) + 1 << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(count, key=lambda g: (-count[g], code(g)))[:300]

    texts = {"xx": ["one and two and three", "and then the one"], "yy": ["eins und zwei und drei", "und dann das eine"], "zz": ["un et deux et trois"]}
    rows = [(10 + k, t, lang, "s", 0) for k, (lang, t) in enumerate((lang, t) for lang, x in texts.items() for t in x)]
    docs = spark.createDataFrame(rows, DOCS)
    learned = [r for r in rows if lang_id_fold(r[0]) != 2]
    profiles = {lang: ranks(sum((grams(t) for _, t, x, *_ in learned if x == lang), Counter())) for lang in {r[2] for r in learned}}
    got = lang_id.learn(docs)
    assert {x: len(p) for x, p in got.items()} == {x: len(p) for x, p in profiles.items()}
    judge = lang_id.Judge(got, 300)
    for text in ("the one and the two", "und das eine", "et un", "éè q", "7 8"):
        own, best = ranks(grams(text)), None
        for lang in sorted(profiles):
            place = {g: k for k, g in enumerate(profiles[lang])}
            far = sum(min(abs(place[g] - k), 300) if g in place else 300 for k, g in enumerate(own))
            if own and (best is None or far < best[0]):
                best = (far, lang)
        want = (best[1], 1 - best[0] / (300 * len(own))) if best else ("und", 0.0)
        lang, score = judge.judge(text)
        assert lang == want[0] and math.isclose(score, want[1], abs_tol=1e-12), text


def lang_id_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4


def test_language_ties_go_to_the_first():
    same = np.array([5, 6, 7], "u8")
    judge = lang_id.Judge({"b": same, "a": same.copy()}, 300)
    assert judge.near(same).tolist() == [900.0, 900.0] and judge.langs[int(judge.near(same).argmax())] == "a"


def test_pu_risk_by_brute_force():
    """A step of the training is a step down the risk, or up where the unlabelled part is negative."""
    r = np.random.default_rng(2)
    pos = [np.flatnonzero(r.random(6) < 0.6).astype("i4") for _ in range(20)]
    unl = [np.flatnonzero(r.random(6) < 0.4).astype("i4") for _ in range(30)]
    prior, how = 0.3, toxicity.Toxicity(epochs=1, rate=1e-6, decay=0.0)

    def risk(w, b, part):
        loss = lambda x, y: math.log1p(math.exp(-y * (sum(w[k] for k in x) + b)))
        rp, rn = sum(loss(x, 1) for x in pos) / len(pos), sum(loss(x, -1) for x in pos) / len(pos)
        ru = sum(loss(x, -1) for x in unl) / len(unl)
        return prior * rp + (ru - prior * rn) if part is None else -(ru - prior * rn)

    bias = math.log(prior / (1 - prior))
    w0 = np.zeros(6)
    base = risk(w0, bias, None)
    model = toxicity.train(pos, unl, [f"f{k}" for k in range(6)], prior, how)
    # of so small a step only the sign is left: against the gradient, found by differences
    assert model.weights == {}
    big = toxicity.train(pos, unl, [f"f{k}" for k in range(6)], prior, toxicity.Toxicity(epochs=1, rate=0.01, decay=0.0))
    for k in range(6):
        w = np.zeros(6)
        w[k] = 1e-5
        slope = (risk(w, bias, None) - base) / 1e-5
        assert np.sign(big.weights[f"f{k}"]) == -np.sign(slope)
    assert np.sign(big.bias - bias) == -np.sign((risk(w0, bias + 1e-5, None) - base) / 1e-5)


def test_equal_rules_and_bloom_sizes(spark):
    rules = (url_filter.Rule("block", "a.com", "/x"), url_filter.Rule("allow", "com", "/x/aa"), url_filter.Rule("allow", "b.com", "/x"), url_filter.Rule("block", "b.com", "/x"))
    pages = spark.createDataFrame([(1, "http://a.com/x/aa"), (2, "http://b.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, none, url_filter.UrlFilter(rules)).collect()}
    assert got[1] == ("com/x/aa", "allow") and got[2][0] == "b.com/x"
    how = url_filter.UrlFilter()
    assert url_filter.bits_for(0, how) == 4 and url_filter.bits_for(16 * 4096, how) == 12 and url_filter.bits_for(16 * 4096 + 1, how) == 13
    # beyond the bound the filter is joined, with the same rows
    wide = url_filter.judge(pages, spark.createDataFrame([("b.com/x",)], "url string"), url_filter.UrlFilter((), broadcast_blocks=1))
    assert {r["page_id"]: r["verdict"] for r in wide.collect()} == {1: "allow", 2: "block"}


def test_list_is_no_part_of_pages(spark):
    listed = Q.listed_urls(spark)
    assert listed.count() == listed.distinct().count() == 4 * 3 * 4 * 2000
    got = Q.op6_url_filter(spark, "/root/testdata/sf0.01")
    assert got.where("rule is null and verdict = 'block'").count() > 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert listed.join(pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("url")), "url", "left_anti").count() > 40_000


def test_stages_with_repeated_rows(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leak = items.first()["text"]
    rows = [(1, leak, "en", "s", 1), (1, leak, "en", "s", 1), (1, "clean words here", "en", "s", 1), (None, "clean too", "en", "s", 1), (None, leak, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    left = sorted(str(r["text"]) for r in P.drop_contaminated(spark, docs, SMALL).collect())
    assert left == ["clean too", "clean words here"]
    assert {r["doc_id"] for r in decontam.decontaminate(docs, items).where("contaminated").collect()} == {1, None}
    kept = P.drop_toxic(spark, spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(docs), SMALL)
    assert kept.where("text = 'clean words here'").count() == 1
