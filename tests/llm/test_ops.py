"""The operators against brute force and on awkward rows."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemill.llm import chat_format, decontam, lang_id, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, toxicity, url_filter
from tidemill.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = "one two three four five six seven " * 4000
    rows = [(1, "the same line of text here\nshort\n\n", "en", "a", 1), (1, "the same line of text here\nshort\n\n", "en", "a", 1), (2, "The Same line of text here \nother", None, None, None), (3, None, "de", "b", 0), (4, "", "fr", "b", 0), (None, "no id but words that make a line of text", "en", "a", 3), (5, long, "en", "a", len(long)), (6, " \t\n ", "es", "c", 4), (7, "\u00e9\u00e8\ud55c\uae00 \U0001f600 <|endoftext|> it's 10", "fr", "a", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("rid", "h", "kind", "bin", "lines", "gone", "score", "n", "class_id", "node", "key", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    assert len(same(Q.QUERIES[name], Q.ORACLE_SQL[name])) > 0


# quality rules
def test_quality_edges(spark, odd):
    rows = quality_rules.quality(odd).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[5]["n_repeat_words"] == by[5]["n_words"] == 28000
    assert quality_rules.quality(odd.limit(0)).count() == 0


def test_repeated_words_by_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab c d".split()) for _ in range(n)) for n in (0, 4, 5, 6, 9, 12, 30, 80)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for row in quality_rules.quality(df).collect():
        w = texts[row["doc_id"]].split()
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)})
        assert row["n_repeat_words"] == want, w


# packing
def test_packing_round_trip(spark, docs, texts):
    _check_packing(packing.pack(docs.repartition(5), packing.Packing(Q.tokenizer_path("word_bpe_49k.json"), fan_in=2)).collect(), texts.items())


def test_packing_edges(spark, odd):
    how = packing.Packing(Q.tokenizer_path("word_bpe_49k.json"), fan_in=2, nearly_full=0)
    rows = packing.pack(odd.repartition(4), how).collect()
    _check_packing([r for r in rows if r["doc_id"] not in (None, 1)], [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (None, 1)], gaps=True)
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert packing.pack(odd.limit(0), how).count() == 0


def _check_packing(rows, texts, gaps=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}
    total, seq = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and zlib.crc32(array("I", own).tobytes()) == r["ids_crc32"]
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == {d: len(x) for d, x in ids.items()}
    if not gaps:
        for places in seq.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(seq) <= -(-sum(total.values()) // 4096) + 3


def test_best_fit_bins():
    bins = packing.best_fit([5, 5, 4, 3, 3], 10)
    fill = np.bincount(bins, weights=[5, 5, 4, 3, 3])
    assert fill.max() <= 10 and len(fill) == 2
    assert packing.best_fit([], 10) == []


# toxicity
def test_toxicity_learns_and_holds_out(spark, odd):
    r = random.Random(1)
    plain = [" ".join(r.choice("sun moon tree house river stone cloud".split()) for _ in range(30)) for _ in range(600)]
    rows = [(i, t + (" vilest" if i % 8 == 0 else ""), "en", "s", 0) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    held = [x for x in got if x["held_out"]]
    assert held and all(x["predicted"] == int(x["doc_id"] % 8 == 0) for x in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).weights == model.weights
    edge = toxicity.score(odd, model).collect()
    assert len(edge) == 10 and all(0 <= x["score"] <= 1 for x in edge)
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(3), none).agg(F.sum("predicted")).first()[0] == 0
    assert toxicity.keep_clean(docs, model).count() == sum(1 for x in got if not x["predicted"])


# line dedup
def test_line_dedup_edges(spark, odd):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 10
    kept = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert kept[1]["n_dropped"] == 0 and kept[2]["kept_text"] == "other" and kept[2]["n_dropped"] == 1
    assert kept[3]["n_lines"] == 1 and kept[3]["kept_text"] == ""
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["\x85", "\u2028", "\u2029", "\x1f", "\xa0", "\r", ""])
def test_line_keys_end_where_the_contract_says(spark, end):
    """A character that Java takes for a line's end is none here: white space before it belongs to the key."""
    lines = [f"hello world foo  {end}", f"hello world foo {end}", f" Hello World foo  {end} ", f"\t{end}hello world foo  {end}", f"hello world foo  {end}\n{end}a second line of its own{end}"]
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(lines)], DOCS)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    owner: dict[str, int] = {}
    for i, t in enumerate(lines):
        for x in t.split("\n"):
            owner.setdefault(key(x), i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in enumerate(lines)}
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df).collect()} == want


def test_line_index_compacts(spark):
    how = line_dedup.LineDedup(batches=6, fan_in=2)
    rows = [(i, f"line number {i % 4} of some length\nonly in {i}, and long enough", "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    index = line_dedup.LineIndex(how)
    drops = line_dedup.dropped_lines(df, how, index).select("doc_id", "at").collect()
    assert sorted(map(tuple, drops)) == [(i, 0) for i in range(4, 40)]
    assert len(index.runs()) <= 3 and sum(r.count() for r in index.runs()) == 44


# suffix dedup
def _brute_suffix(rows, length):
    first, out = {}, []
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1 if d is not None else 0):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _suffix_rows(df, how):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df, how).collect())


def test_suffix_dedup_by_brute_force(spark, docs, odd):
    how = suffix_dedup.SuffixDedup()
    assert _suffix_rows(docs, how) == _brute_suffix([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    for size in (1, 20_000):  # what a task gathers before it deals out changes nothing
        how = suffix_dedup.SuffixDedup(bucket_bytes=100_000, flush_bytes=size)
        assert _suffix_rows(docs.repartition(3), how) == _brute_suffix([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    small = suffix_dedup.SuffixDedup(length=20, gram=8, shallow=8)
    assert _suffix_rows(odd, small) == _brute_suffix([(r["doc_id"], r["text"]) for r in odd.collect()], 20)
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_dedup_on_periodic_texts(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["ab", "abc", "x" * 30, "abab"]) for _ in range(40)), "en", "s", 0) for i in range(12)]
    how = suffix_dedup.SuffixDedup(length=20, gram=8, shallow=16)
    assert _suffix_rows(spark.createDataFrame(rows, DOCS).repartition(3), how) == _brute_suffix([x[:2] for x in rows], 20)


def test_equal_suffixes_are_equal_strings():
    data = np.frombuffer((b"abcabcabdabc" * 30) + bytes(range(200)), "u1")
    how = suffix_dedup.SuffixDedup(length=24, gram=8, shallow=8)
    starts = np.arange(len(data) - 24)
    leaf = suffix_dedup.equal_suffixes(data, starts, np.full(len(starts), 24), how)
    groups = {}
    for s, x in zip(starts, leaf, strict=True):
        groups.setdefault(x, set()).add(data[s : s + 24].tobytes())
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({data[s : s + 24].tobytes() for s in starts})


# url filter
def test_url_edges(spark):
    urls = [None, "", "no scheme/x", "http://", "https://Example.NET", "https://A.Example.net/en/x?y#z", "http://net/a", "http://notnet/a", "http://x.org/fr/", "http://x.org/fr", "ftp://www.bad.com/p/", "http://bad.com/p", "http://u@h:80/a://b", "http://example.com/de/?q"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([("bad.com/p",), (None,), ("bad.com/p",)], "url string")
    how = url_filter.UrlFilter(Q.RULES, keys_a_block=1)
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, how).collect()}
    assert len(got) == len(urls)
    want = {4: (None, "allow"), 5: ("example.net/en/", "allow"), 6: ("net/", "block"), 7: (None, "allow"), 8: ("org/fr/", "allow"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "block"), 13: ("example.com/de/", "block")}
    assert {k: (got[k]["rule"], got[k]["verdict"]) for k in want} == want
    assert got[12]["host"] == "u@h:80" and got[12]["path"] == "/a://b"
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("", "", "allow")
    assert url_filter.judge(pages.limit(0), listed.limit(0), how).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(keys.where("key not like '%7'"), 8)
    got = url_filter.may_be_listed(keys, blocks, 8).collect()
    assert all(r["maybe"] for r in got if not r["key"].endswith("7"))
    assert sum(r["maybe"] for r in got if r["key"].endswith("7")) < 200


# chat format
def test_chat_round_trip():
    one = chat_format.Assembler(chat_format.ChatFormat(Q.tokenizer_path("byte_bpe_50k.json")))
    turns = [("user", "<|im_end|> <\\|x <|endoftext|>"), ("assistant", ""), ("", "\ud55c\n<\\\\|im_start|>"), ("assistant", "<|im_start|>assistant ok"), ("ro\nle<|im_sep|>", " a ")]
    ids, mask = one.assemble(turns)
    assert [(r, t) for r, t, _ in one.read(ids, mask)] == turns
    assert [lost for _, _, lost in one.read(ids, mask)] == ["", "", "", "<|im_start|>assistant ok", ""]
    assert one.text_of(ids).count("<|im_end|>") == len(turns)


def test_chat_edges(spark):
    how = chat_format.ChatFormat(Q.tokenizer_path("byte_bpe_50k.json"))
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "a", "x"), (1, 0, None, "a", "x"), (None, None, "user", "b", "x"), (2, 0, "assistant", "w " * 30000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat_format.digests(df, how).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"\na\n\na\nassistant\n\n").hexdigest()
    assert got[2]["loss_chars"] == 60000 and got[None]["n_turns"] == 1
    assert chat_format.digests(df.limit(0), how).count() == 0
    assert chat_format.format_turns(df, how).count() == 5


# n-gram join
def _near_rows(n):
    r = random.Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(200)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(200)] = f"z{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    return rows


def test_ngram_join_in_blocks(spark):
    rows = _near_rows(60) + [(100 + i, " ".join(f"u{i}v{k}" for k in range(30)), "en", "s", 0) for i in range(5)] + [(200, rows_text := "a b c", "en", "s", 0), (201, rows_text, "en", "s", 0)]
    sets = {}
    for d, t, *_ in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    links = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= 0.8} for d in sets}
    root = {}
    for d in sorted(sets):
        if d not in root:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = d
                    todo += links[x]
    got = ngram_join.near_classes(spark.createDataFrame(rows, DOCS), ngram_join.NgramJoin(block=8)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {d: (root[d], len(links[d])) for d in sets}


def test_ngram_join_edges(spark, odd):
    got = ngram_join.near_classes(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_links"] == 1 and by[3]["class_id"] == 3 and by[3]["n_links"] == 0 and by[None]["class_id"] is None
    assert ngram_join.near_classes(odd.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 192)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


# decontamination
def test_winnowing_guarantee():
    r = random.Random(6)
    how = decontam.Winnowing()
    of = decontam.Hasher(how)
    item = [f"i{k}".encode() for k in range(25)]
    ids = of(item)
    h = decontam.gram_hashes(ids, 5)
    prints = set(h[decontam.winnow(h, 6)].tolist())
    every = np.full(16, 2**64 - 1, "u8")  # a filter that lets all pass
    for _ in range(300):
        s, n = r.randrange(16), r.randrange(8, 20)
        part = item[s : s + n]
        doc = [b"p"] * r.randrange(9) + part + [b"q"] * r.randrange(9)
        own = of(doc) * np.isin(doc, item)
        got = [x for x in decontam.candidates(doc, own, [10], every, how) if np.int64(x[0]).view("u8") in prints]
        assert bool(got) == (len(part) >= 10)
        # the surroundings of the hits hold every window of the shared span
        windows = {b" ".join(part[i : i + 10]).decode() for i in range(len(part) - 9)}
        assert all(any(w in x[3] for x in got) for w in windows)
    assert decontam.candidates([b"q", b"x"], of([b"q", b"x"]), [3], every, how) == []


def test_decontamination_with_crowded_filters(spark, docs, odd):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    one = decontam.decontaminate(docs, items)
    crowded = decontam.Winnowing(filter_bits=10, cache_words=50)
    assert key(one) == key(decontam.decontaminate(docs, items, crowded))
    bad = {r["doc_id"] for r in one.collect() if r["contaminated"]}
    assert {r["doc_id"] for r in decontam.keep_clean(docs, items, crowded).collect()} == {r["doc_id"] for r in docs.collect()} - bad
    short = spark.createDataFrame([("s", "Same line"), ("n", None), (None, "here"), ("e", "")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(odd, short).collect()}
    # the item without an id hits too, as the contract exempts only null texts
    assert got[2]["n_hit"] == 3 and got[2]["items"] == ["s"] and got[2]["n_items"] == 2 and got[3]["n_words"] == 0
    assert decontam.decontaminate(odd.limit(0), short.limit(0)).count() == 0
    assert decontam.keep_clean(odd, short).columns == odd.columns and decontam.keep_clean(odd, short.limit(0)).count() == 10


# language id
def test_language_id_held_out(spark, docs, odd):
    got = Q.op10_language_id(spark, SMALL).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    edge = {r["doc_id"]: r for r in lang_id.identify(odd, lang_id.learn(docs)).collect()}
    assert edge[3]["lang_pred"] == edge[4]["lang_pred"] == edge[6]["lang_pred"] == "und" and edge[7]["lang_pred"] != "und"
    assert lang_id.learn(odd.limit(0)) == {}
    assert {r["lang_pred"] for r in lang_id.identify(odd, {}).collect()} == {"und"}


def test_ranks_by_brute_force():
    from collections import Counter

    codes = lang_id._codes("Banana, bandana! 7 B\u00c4N")
    count = Counter(codes.tolist())
    want = sorted(count, key=lambda c: (-count[c], c))[:10]
    assert lang_id.ranked(codes, 10).tolist() == want
