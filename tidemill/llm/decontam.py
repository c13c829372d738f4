"""Benchmark decontamination by winnowing.

Words are A-Z lower-cased runs of ASCII letters, digits and characters beyond ASCII. Of every
``window - gram + 1`` consecutive word k-grams the one with the smallest hash is kept (the rightmost
of equals), in documents and in benchmark items alike. So any span of ``window`` words that both
hold has a fingerprint in common. An item shorter than a window is one window of its own length; its length
then is the gram and the span in one.

One pass over the documents, whatever the size of the benchmark: each document gives its fingerprints with the
words around them, if filters of the items' words and fingerprints (bit arrays of at most 2 ** ``filter_bits`` bits, which are all
that is broadcast) let them pass. Fingerprints are joined with the items'; the windows around each hit are joined with the
items' windows as strings, so no hash decides. Spark chooses how to join by the sizes. What comes to the driver
are the filters and the distinct lengths of windows.

Nulls and edges: a null text has no words, an item without words has no windows; items with the same
text all count; an item with a null item_id hits like any other, counts as one item and is left out of the ids; a null
or repeated doc_id gets a row for each row; empty tables are fine; only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written
from .url_filter import UrlFilter, bits_for, bloom_blocks, may_be_listed

#: The filter of hit texts has 2 ** this many blocks of 40 bytes at most.
FILTER_BITS = 18

# Every byte that no word holds becomes a blank.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Winnowing:
    window: int = 10
    gram: int = 5
    filter_bits: int = 26
    cache_words: int = 150_000


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split() if text else []


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram consecutive numbers."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.zeros(n, "u8")
    for k in range(gram):
        h = (h ^ ids[k : k + n].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of each width consecutive hashes; the rightmost of equals."""
    if not len(hashes):
        return np.zeros(0, "i8")
    width = min(width, len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(view)) + width - 1 - view.argmin(axis=1))


def spans_of(n: int, how: Winnowing) -> tuple[int, int]:
    """Length of the windows of an item of n words, and of its grams."""
    span = min(how.window, n)
    return span, how.gram if span == how.window else span


class Hasher:
    """64-bit hashes of words, never 0; words that a filter does not let pass are 0. What was hashed is kept, a bounded number."""

    def __init__(self, how: Winnowing, passes: np.ndarray | None = None):
        import xxhash

        self.limit, self.passes, self.known, self.hash = how.cache_words, passes, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        lack = list(set(words).difference(known))
        if lack:
            h = np.array([self.hash(w) | 1 for w in lack], "u8")
            if self.passes is not None:
                h[~let_pass(self.passes, h)] = 0
            known.update(zip(lack, h.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def let_pass(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter, as 64-bit words, holds. Another 64 bits of mixing, as hashes of words share their last bit."""
    at = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(rows: DataFrame, how: Winnowing) -> np.ndarray:
    """A filter of the hashes in column h: sixteen bits for each, up to the bound. At most 2 ** filter_bits / 64 rows come to the driver."""
    n = rows.count()
    bits = min(how.filter_bits, max(10, (16 * n).bit_length()))
    out = np.zeros(1 << (bits - 6), "u8")

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).astype("i8").view("u8")
            at = np.unique((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype("i8")), pa.array((np.uint64(1) << (at & np.uint64(63))).view("i8"))], names=["block", "mask"])

    got = rows.select("h").mapInArrow(places, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
    out[got.block.to_numpy("i8")] = got["mask"].to_numpy("i8").view("u8")
    return out


def item_parts(items: DataFrame, how: Winnowing) -> DataFrame:
    """Per item with words: item_id, span, words, their hashes, and the fingerprints."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        of = Hasher(how)
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = _split(text)
                if words:
                    span, gram = spans_of(len(words), how)
                    ids = of(words)
                    h = gram_hashes(ids, gram)
                    prints = np.unique(h[winnow(h, span - gram + 1)]).view("i8")
                    row = [pa.array([item], pa.string()), pa.array([span], pa.int32()), pa.array([[w.decode("utf-8", "replace") for w in words]], pa.list_(pa.string())), pa.array([np.unique(ids).view("i8")], pa.list_(pa.int64())), pa.array([prints], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(row, names=["item_id", "span", "words", "hashes", "prints"])

    return items.select("item_id", "text").mapInArrow(run, "item_id string, span int, words array<string>, hashes array<long>, prints array<long>")


def candidates(words: list[bytes], ids: np.ndarray, spans: list[int], prints: np.ndarray, how: Winnowing) -> list[tuple[int, int, int, str]]:
    """Fingerprints of a document that a filter lets pass: fingerprint, span, first word of its surroundings, and these. ids: 0 for words that no item has."""
    known, out = np.concatenate(([0], np.cumsum(ids > 0))), []
    for span in spans:
        if len(ids) < span:
            continue
        whole_windows = known[span:] - known[:-span] == span
        if not whole_windows.any():
            continue
        gram = spans_of(span, how)[1]
        h = gram_hashes(ids, gram)
        at = winnow(h, span - gram + 1)
        for p in at[let_pass(prints, h[at])].tolist():
            a, b = max(0, p - span + gram), min(len(words), p + span)
            if whole_windows[a : b - span + 1].any():
                out.append((int(h[p : p + 1].view("i8")[0]), span, a, b" ".join(words[a:b]).decode("utf-8", "replace")))
    return out


_BASE = "doc_id long, h long, n_words long, near array<struct<fp:long,span:int,a:long,words:string>>"


def _fingerprinted(docs: DataFrame, spans: list[int], words: np.ndarray, prints: np.ndarray, how: Winnowing) -> DataFrame:
    """Per row of docs (doc_id, h, text) its number of words and the candidates."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((words, prints))  # 2 ** filter_bits bits each at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        passes, known = sent.value
        of, kind = Hasher(how, passes), pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.int32()), ("a", pa.int64()), ("words", pa.string())]))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                n, near = [], []
                for t in part.column("text"):
                    words = _split(t.as_py())
                    n.append(len(words))
                    found = candidates(words, of(words), spans, known, how) if words else []
                    near.append([{"fp": f, "span": s, "a": a, "words": w} for f, s, a, w in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), pa.array(near, kind)], names=["doc_id", "h", "n_words", "near"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, _BASE)


# sorted spans: one that meets the last is joined to it
_UNITED = """aggregate(found, cast(array() as array<struct<a:bigint,b:bigint>>), (s, x) ->
    if(size(s) > 0 and x.a <= element_at(s, -1).b,
       concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).a as a, greatest(element_at(s, -1).b, x.b) as b))),
       concat(s, array(x))))"""
_WINDOWS = "transform(sequence(0, size(words) - span), i -> struct(a + i as a, array_join(slice(words, cast(i + 1 as int), span), ' ') as window))"


def _hits(docs: DataFrame, items: DataFrame, how: Winnowing) -> tuple[DataFrame, DataFrame]:
    """All rows of docs (doc_id, h, text) with their number of words, and of those hit the spans and items."""
    parts = written(item_parts(whole(items, {"item_id": "string", "text": "string"}), how), "items")
    spans = sorted(r["span"] for r in parts.select("span").distinct().collect())  # window lengths: how.window at most
    prints = parts.select("span", F.explode("prints").alias("fp")).distinct()
    windows = parts.withColumn("a", F.lit(0).cast("long")).select("item_id", "span", F.explode(F.expr(_WINDOWS)).alias("x")).select("item_id", "span", F.col("x.window").alias("window")).distinct()
    word_filter, print_filter = filter_of(parts.select(F.explode("hashes").alias("h")).distinct(), how), filter_of(prints.select(F.col("fp").alias("h")), how)
    base = written(_fingerprinted(docs, spans, word_filter, print_filter, how), "fingerprints")
    near = base.where(F.size("near") > 0).select("doc_id", "h", F.inline("near"))
    # the join of fingerprints, then the extension of each hit to whole windows
    near = near.join(prints, ["fp", "span"], "left_semi").select("doc_id", "h", "span", "a", F.split("words", " ").alias("words"))
    own = near.select("doc_id", "h", "span", F.explode(F.expr(_WINDOWS)).alias("x")).select("doc_id", "h", "span", "x.a", "x.window").distinct()
    found = own.join(windows, ["span", "window"])
    hits = found.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.struct(F.col("a"), (F.col("a") + F.col("span")).alias("b")))).alias("found"),
        F.array_sort(F.transform(F.collect_set(F.struct("item_id")), lambda x: x["item_id"])).alias("items"),
    )
    return base.select("doc_id", "h", "n_words"), written(hits.select("doc_id", "h", F.expr(_UNITED).alias("spans"), "items"), "hits")


def find_spans(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """Per document its number of words, the spans of words hit and the items (as strings, null last) whose windows occur."""
    docs = whole(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.xxhash64("text").alias("h"), "text")
    base, hits = _hits(docs, items, how)
    hits = hits.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "of_text")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("of_text")), "left")
    none = F.array().cast("array<struct<a:long,b:long>>")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted, without null), n_items, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return find_spans(docs, items, how).withColumn("n_hit", hit).select("doc_id", "n_words", "n_hit", F.array_compact("items").alias("items"), F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """The rows of docs without a window of any item. Rows that are surely clean do not move: a Bloom filter of bounded size tells them."""
    # the row as it is in one column, so that none of its names can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    _, hits = _hits(keyed.select("doc_id", "h", "text"), items, how)
    gone = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("of_text")).distinct()
    bits = min(FILTER_BITS, bits_for(gone.count(), UrlFilter()))
    key = lambda d: F.concat_ws("/", F.col(d[0]), F.col(d[1]))
    seen = may_be_listed(keyed.drop("text").withColumn("key", key(("doc_id", "h"))), bloom_blocks(gone.select(key(("d", "of_text")).alias("key")), bits), bits)
    rest = seen.where("maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("of_text")), "left_anti")
    return seen.where("not maybe").select("row.*").unionByName(rest.select("row.*"))
