"""Importance resampling towards a target distribution of hashed word n-grams.

Features are runs of ``shortest`` to ``longest`` consecutive words, hashed into ``buckets``. A bucket's gain is the
logarithm of how much likelier it is in the target than in the corpus, in thousandths; a document's
weight is the mean gain of its features. With a Gumbel number from its id added, the highest scores are a draw
without replacement in proportion to the weights' exponentials.

Texts are read as bytes, many documents at once: a table classes the bytes of the Arrow buffer, word
starts and ends are where the class changes or a document begins, and the CRCs of all features advance
together, one byte a step, by a table of 256 entries. The features that are longer than ``steps`` bytes, of which few
are left by then, are finished one by one from where they stand.

The corpus is read twice: for the counts of buckets (one row a bucket and task) and for the weights.
The gains, one number a bucket, are all that goes through the driver and to every task. Ranks come from sorted
ranges of scores; texts never move.

Nulls and edges: a null or empty text, or one without words, has no features and weight 0; texts of any
length are read whole, in memory of some ten times their bytes; repeated rows count each and are ranked each; a null
doc_id draws as if its name were empty and comes last among ties; empty tables are counts of zero; only doc_id and text
of documents and text of the target are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, whole, written


@dataclass(frozen=True)
class Resampling:
    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"
    steps: int = 64


def _crc_table() -> np.ndarray:
    """The usual CRC-32 of one byte, by its reflected polynomial."""
    value = np.arange(256, dtype="u4")
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype("u4")
    return value


CRC = _crc_table()
_BYTES = np.arange(256)
#: A-Z in lower case, all other bytes as they are.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype("u1")
#: Digits, letters of ASCII (upper case ones are lower-cased first) and all bytes above ASCII are parts of words.
IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (_BYTES >= 0x80)


def crcs_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """The CRC-32 of data[start : start + size] for all starts at once."""
    order = np.argsort(-np.minimum(sizes, steps + 1).astype("i2"), kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, "u4")
    # longest first: what is still running at a step is a head of the arrays
    running = len(at) - np.searchsorted(np.sort(np.minimum(left, steps + 1)), np.arange(steps + 1), "right")
    for k in range(steps):
        n = running[k]
        if not n:
            break
        c = crc[:n]
        crc[:n] = CRC[(c ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(running[steps]):
        crc[k] = zlib.crc32(data[at[k] + steps : at[k] + left[k]], int(crc[k]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts, how: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For an Arrow array of strings: each feature's text by number and its bucket, and each text's number of words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    data = LOWER[np.frombuffer(buffer, "u1")[offsets[0] : offsets[-1]]] if buffer is not None else np.zeros(0, "u1")
    begins = offsets - offsets[0]
    word = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    before, after = np.r_[False, word], np.r_[word, False]
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    of = np.searchsorted(begins[1:], starts, "right")
    n_words = np.bincount(of, minlength=len(texts))
    sizes = ends - starts
    if how.longest > 1:
        # the words again, one blank after each: a run of words is then one stretch of bytes
        moved = np.cumsum(sizes + 1) - (sizes + 1)
        joined = np.full(int((sizes + 1).sum()), 0x20, "u1")
        joined[np.repeat(moved - starts, sizes) + np.flatnonzero(word)] = data[word]
        data, starts = joined, moved
    texts_of, buckets = [], []
    for n in range(how.shortest, how.longest + 1):
        last = np.arange(n - 1, len(starts))
        first = last - (n - 1)
        one = of[first] == of[last]
        first, last = first[one], last[one]
        texts_of.append(of[first])
        buckets.append(crcs_of(data, starts[first], starts[last] + sizes[last] - starts[first], how.steps) % how.buckets)
    return np.concatenate(texts_of), np.concatenate(buckets).astype("i8"), n_words


def _counts(texts: DataFrame, how: Resampling) -> np.ndarray:
    """Features in each bucket, over all texts; one row a bucket and task is shuffled, one a bucket reaches the driver."""
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        held = np.zeros(how.buckets, "i8")
        for b in batches:
            held += np.bincount(features(b.column(0), how)[1], minlength=how.buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    out = np.zeros(how.buckets, "i8")
    for r in whole(texts, {"text": "string"}).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, how: Resampling) -> np.ndarray:
    """Each bucket's gain: the floored thousandfold logarithm of its smoothed share in the target over that in docs."""
    s, t = _counts(docs, how), _counts(target, how)
    in_docs, in_target = float(s.sum() + how.buckets), float(t.sum() + how.buckets)
    return np.array([math.floor(1000 * math.log(((y + 1.0) * in_docs) / ((x + 1.0) * in_target))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], "i8")


def _weighed(docs: DataFrame, gain: np.ndarray, how: Resampling) -> DataFrame:
    import pyarrow as pa

    def weigh(batches: Iterator) -> Iterator:
        for b in batches:
            of, bucket, words = features(b.column(1), how)
            n = np.bincount(of, minlength=b.num_rows)
            total = np.bincount(of, gain[bucket], b.num_rows).astype("i8")  # sums of whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """A document's own Gumbel number in thousandths, from 32 bits of a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    scored = _weighed(docs, gains(docs, target, how), how).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), how.seed))
    scored = written(scored, "scored")
    able = scored.where(F.col("n_words") >= how.least_words)
    drawn = able.count() * how.percent // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < how.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
