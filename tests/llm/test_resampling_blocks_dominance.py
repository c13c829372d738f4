"""Importance resampling, token blocks and dominance counting against brute force and on awkward rows."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemill.llm import dominance, resampling, token_blocks
from tidemill.llm import queries as Q
from tidemill.llm.common import numbered

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Same text, twice " * 9), (1, "Same text, twice " * 9), (2, None), (3, ""), (None, "no id but words " * 8), (4, "é한 글😀x A-Z 09 " + "w" * 200), (5, "one two three " * 9000), (6, " \n\t"), (7, "x" * 70_000), (None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "rank", "weight", "tie", "h", "bucket", "_tie", "_at", "slot"):
        df = df.withColumn(name, F.lit("x"))
    return df


# numbers in order
def test_numbered_in_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("x"), "id")
    rows = numbered(df, [F.desc("x")], "at", a_task=97).collect()
    assert sorted(r["at"] for r in rows) == list(range(1, 5001))
    assert [r["x"] for r in sorted(rows, key=lambda r: r["at"])] == sorted((i % 700 for i in range(5000)), reverse=True)
    assert numbered(df.limit(0), [F.desc("x")], "at").count() == 0


# importance resampling
def _words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute_draw(docs, target, how):
    def buckets(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % how.buckets for n in range(how.shortest, how.longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(how.buckets, int), np.zeros(how.buckets, int)
    for _, x in docs:
        np.add.at(s, buckets(x), 1)
    for x in target:
        np.add.at(t, buckets(x), 1)
    out = []
    for d, x in docs:
        b = buckets(x)
        gain = [math.floor(1000 * math.log((int(t[k]) + 1) * float(s.sum() + how.buckets) / ((int(s[k]) + 1) * float(t.sum() + how.buckets)))) for k in b]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x)) >= how.least_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * how.percent // 100]
    return sorted(([*r[:4], next((i + 1 for i, x in enumerate(drawn) if x is r), None)] for r in out), key=str)


def _drawn(docs, target, how):
    return sorted((list(r) for r in resampling.resample(docs, target, how).collect()), key=str)


@pytest.mark.parametrize("how", [resampling.Resampling(), resampling.Resampling(longest=3, buckets=257, percent=37, least_words=3, steps=8), resampling.Resampling(shortest=2, longest=2, percent=100, least_words=0)])
def test_draw_by_brute_force(spark, odd, how):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).select("doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.where("doc_id is null or doc_id not in (1)").select("doc_id", "text"))
    target = spark.createDataFrame([("The same TEXT, of the same words",), (None,), ("",)], "text string")
    rows = [tuple(r) for r in docs.collect()]
    assert _drawn(docs, target, how) == _brute_draw(rows, [r[0] for r in target.collect()], how)


def test_draw_edges(spark, odd):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = resampling.resample(odd, target, resampling.Resampling(percent=100)).collect()
    assert len(rows) == 10 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    assert {(r["n_features"], r["weight"]) for r in rows if r["doc_id"] in (2, 3, 6)} == {(0, 0)}
    assert resampling.resample(odd.limit(0), target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == 10


def test_crcs_and_words_of_sliced_buffers():
    r = random.Random(5)
    texts = ["".join(r.choice("abZ 09-é한\n_") for _ in range(r.choice([0, 1, 3, 40, 300]))) for _ in range(200)] + [None, "q" * 1000, "w"]
    for array in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        of, bucket, n = resampling.features(array, resampling.Resampling(buckets=1 << 31, steps=16))
        want = [(i, zlib.crc32(w.encode()) % (1 << 31)) for i, t in enumerate(texts) for w in _words(t)]
        assert list(zip(of.tolist(), bucket.tolist(), strict=True)) == want and n.tolist() == [len(_words(t)) for t in texts]
    assert len(resampling.features(pa.array([], pa.string()), resampling.Resampling())[0]) == 0


# token blocks
def _how(**more):
    return token_blocks.TokenBlocks(Q.tokenizer_path("word_bpe_49k.json"), **more)


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("block,percent,at_once", [(256, 90, 1 << 18), (8, 50, 64), (64, 100, 1000), (128, 1, 300)])
def test_blocks_round_trip(block, percent, at_once):
    r, how = random.Random(block), _how(block=block, percent=percent, at_once=at_once)
    high = [1, 2, 300, 49_000, (1 << 32) - 1]
    docs = [(i if i % 7 else None, np.array([r.randrange(r.choice(high)) for _ in range(r.choice([0, 1, 5, 700]))], "<u4")) for i in range(60)]
    sink = io.BytesIO()
    writer = token_blocks.BlockWriter(sink, how)
    for d, ids in docs:
        writer.add(d, ids.tobytes())
    writer.close()
    f, every = token_blocks.BlockReader(_Source(sink.getvalue())), np.concatenate([x for _, x in docs])
    assert f.n_ids == len(every) and (f.ids(0, f.n_ids) == every).all()
    assert [None if n else int(d) for d, n in zip(f.doc_ids, f.null, strict=True)] == [d for d, _ in docs]
    for (_, ids), at in zip(docs, f.begins.tolist(), strict=True):
        assert (f.ids(at, len(ids)) == ids).all()


def test_rare_high_ids_do_not_widen_blocks():
    ids = np.full(2560, 7, "<u4")
    ids[::100] = 1 << 30
    data, _ = token_blocks.pack_blocks(ids, _how())
    assert len(data) == 10 * 8 + 5 * 26
    with pytest.raises(ValueError, match="not a file"):
        token_blocks.BlockReader(_Source(b"\0" * 100))


def _plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_token_files_by_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    ids, at, want = _plain([t for _, t in rows]), 0, []
    for (d, _), x in zip(rows, ids, strict=True):
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, Q.op12_token_blocks(spark, SMALL).collect())) == want
    how = _how(file_bytes=40_000, at_once=500)
    manifest = token_blocks.write(spark.read.parquet(f"{SMALL}/documents.parquet"), how)
    assert manifest.count() > 5 and manifest.agg(F.sum("ids")).first()[0] == at
    assert sorted(map(tuple, token_blocks.read_back(manifest, how).collect())) == want


def test_token_file_edges(spark, odd):
    how = _how(file_bytes=1000, at_once=400)
    rows = sorted(token_blocks.read_back(token_blocks.write(odd, how), how).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows[2:]:
        (want,) = _plain([texts[r["doc_id"]]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(10)]
    assert token_blocks.read_back(token_blocks.write(odd.limit(0), how), how).count() == 0


# dominance counting
def _brute_above(points):
    known = [p for p in points if p[0] is not None and p[1] is not None]
    above = lambda a, b: [w for x, y, w in known if x <= a and y > b]
    return sorted(((a, b, w, *((len(above(a, b)), sum(above(a, b))) if a is not None and b is not None else (None, None))) for a, b, w in points), key=str)


def _above(spark, points, how=dominance.Dominance()):
    df = spark.createDataFrame(points, "slot long, level long, w long").withColumn("one", F.lit(1).cast("long")).withColumn("digit", F.lit("x")).withColumn("rank", F.lit("y"))
    return sorted(((r["slot"], r["level"], r["w"], r["n"], r["m"]) for r in dominance.count_above(df, {"n": "one", "m": "w"}, how).collect()), key=str)


@pytest.mark.parametrize("n,slots,levels,how", [(0, 1, 1, {}), (1, 1, 1, {}), (40, 1, 6, {}), (150, 13, 40, {"digit_bits": 2}), (200, 50, 1 << 33, {"digit_bits": 6}), (300, 5, 3, {"hot_share": 2})])
def test_dominance_by_brute_force(spark, n, slots, levels, how):
    r = random.Random(n)
    points = [(None if r.random() < 0.05 else r.randrange(-3, slots), None if r.random() < 0.05 else r.randrange(-levels, levels), r.randrange(1, 4)) for _ in range(n)]
    points += [(0, -1, 1)] * (n // 2)  # a third of all rows in one cell
    assert _above(spark, points, dominance.Dominance(**how)) == _brute_above(points)


def test_dominance_is_the_same_in_any_zone(spark):
    one = sorted(map(tuple, Q.op13_dominance_counting(spark, SMALL).collect()), key=str)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted(map(tuple, Q.op13_dominance_counting(spark, SMALL).collect()), key=str) == one
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
