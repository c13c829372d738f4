"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 characters; runs of anything
but letters are one blank, so words keep their edges). A document's profile is compared with each
language's by the out-of-place distance: the sum over the document's n-grams of how far their ranks
lie apart, or of the greatest distance where the language lacks the n-gram. The nearest wins.

Bounds: a language's profile is learned from about ``per_language`` documents, taken by a threshold
on hashed ids at the language's share (no sort, no window), over their whole texts. Every lang value is
learned; it costs ``profile`` numbers (2.4 KB) on the driver and in the broadcast, and a document is compared
only with the entries of its own n-grams. Every document is predicted from its whole text.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0; without any learned
language all is ``und``; ties go to the language that sorts first; a null doc_id is not learned from
and not held out; repeated rows each get a row; an empty table gives no rows; only doc_id, text and,
for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, whole, written

NONE = "und"


@dataclass(frozen=True)
class RankOrder:
    profile: int = 300
    per_language: int = 1_500
    broadcast_langs: int = 100_000
    folds: int = 4
    held_out_fold: int = 2


_MANY = 0x3000  # characters below this are told by a table, the others one by one


def _table() -> np.ndarray:
    """Lower-cased letters to themselves, all else to a blank (0)."""
    out = np.zeros(_MANY, "u4")
    for c in range(_MANY):
        low = chr(c).lower()
        if chr(c).isalpha():
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS = _table()


def letters_of(text: str) -> np.ndarray:
    """Code points of lower-cased letters, with one 0 between, before and after the runs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    out = _LETTERS[np.minimum(points, _MANY - 1)]
    beyond = np.flatnonzero(points >= _MANY)
    for k in beyond.tolist():
        c = chr(points[k])
        out[k] = ord(c.lower()[0]) if c.isalpha() else 0
    out = np.concatenate(([np.uint32(0)], out, [np.uint32(0)]))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def _codes(text: str) -> np.ndarray:
    """A number for each 1-, 2- and 3-gram that has a letter: 21 bits a character, and no gram is another's number."""
    c = letters_of(text).astype("u8")
    if len(c) < 3:
        return np.zeros(0, "u8")
    c += np.uint64(1)  # a blank is 1, so that 0 means no character
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate((c[c > 1], two, three))


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent numbers, most frequent first, smaller first among equals."""
    if not len(codes):
        return codes
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    count = np.diff(np.append(first, len(codes)))
    if len(count) > most:  # only what is at least as frequent as the last that fits
        least = np.partition(count, len(count) - most)[len(count) - most]
        kept = np.flatnonzero(count >= least)
        first, count = first[kept], count[kept]
    order = np.argsort(-count, kind="stable")[:most]
    return codes[first[order]]


def held_out(how: RankOrder, doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, how.folds) == how.held_out_fold, F.lit(False))


def learn(docs: DataFrame, how: RankOrder = RankOrder()) -> dict[str, np.ndarray]:
    """A profile by language; only counts of languages and the leading n-grams reach the driver."""
    import pyarrow as pa

    docs = whole(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(how, F.col("doc_id")))
    # written, so that its size is known: one row a lang value
    share = written(docs.groupBy("lang").count().select("lang", F.least(F.lit(1.0), how.per_language / F.col("count")).alias("share")), "languages")
    share = F.broadcast(share) if share.count() <= how.broadcast_langs else share
    sample = docs.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                values, n = np.unique(_codes(text.as_py()), return_counts=True)
                own = total.setdefault(lang, {})
                for v, k in zip(values.tolist(), n.tolist(), strict=True):
                    own[v] = own.get(v, 0) + k
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "code", "n"])

    counts = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # a language has as many rows here as its sample has n-grams
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= how.profile).orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, "u8") for lang, codes in out.items()}


class Judge:
    """The entries (n-gram, language, rank) of all profiles, by n-gram."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int):
        self.langs, self.most = sorted(profiles), most
        sizes = [len(profiles[x]) for x in self.langs]
        codes = np.concatenate([profiles[x] for x in self.langs]) if profiles else np.zeros(0, "u8")
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, "i8")])[order]

    def near(self, own: np.ndarray) -> np.ndarray:
        """For each language how much nearer it is than one that has none of the n-grams: the sum of what ranks lie less than the greatest distance apart."""
        low, high = np.searchsorted(self.codes, own, "left"), np.searchsorted(self.codes, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat(np.arange(len(own)), n)
        gain = self.most - np.minimum(np.abs(self.rank[at] - place), self.most)
        return np.bincount(self.lang[at], weights=gain, minlength=len(self.langs))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(_codes(text), self.most) if text else np.zeros(0, "u8")
        if not len(own) or not self.langs:
            return NONE, 0.0
        near = self.near(own)
        best = int(near.argmax())
        return self.langs[best], float(near[best] / (self.most * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], how: RankOrder = RankOrder()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (1: all ranks agree) for every row."""
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # profile numbers a lang value

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = Judge(sent.value, how.profile)
        for b in batches:
            made = [one.judge(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    docs = docs.select("doc_id", held_out(how, F.col("doc_id")).alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
