"""N-gram Jaccard self-join of documents by MinHash banding, verified on the full n-gram sets.

1. Each document becomes a MinHash signature of its word 5-grams; bands and rows a band are chosen so
   that a pair at the threshold shares a band with at least the target recall.
2. Documents with the same n-gram set are one class member from here on, with their number, so copies
   never become pairs.
3. Members that share a band hash point to the smallest of them (one edge each, not all pairs), and
   connected components of these edges are the candidate groups. A group above ``block`` members may
   be a chain of chance hits, so its members are banded again within it, with ``strict_hashes``
   hashes in longer bands that reach the same recall, and it falls into its tighter parts.
4. Within a candidate group every pair is verified on the full sets. A group above ``block`` members
   is dealt by hash into blocks, and pairs of blocks are verified as tasks of their own, so no task
   holds a whole large group. Links are counted, not listed: a task returns one row a member.
5. Components of the verified links are the classes; a class id is its smallest doc_id.

A member is an n-gram set, not a doc_id: it has a number of its own, written with it, so several
texts under one doc_id are told apart.

Words are lower-cased runs of anything but white space. A text of one to four words has one n-gram,
the whole. n_links is the number of other rows with similarity >= threshold, copies included.

Nulls and edges: a text without words (null, empty, blank) has no n-grams, is similar to nothing and
is a class of its own; a row with a null doc_id keeps a null class and has no links; several rows of
one doc_id are several copies; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, whole, written


@dataclass(frozen=True)
class NgramJoin:
    gram: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    max_hashes: int = 192
    strict_hashes: int = 1_536
    block: int = 512
    cache_words: int = 150_000


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows a band: the most rows (fewest false candidates) that reach the recall within max_hashes."""
    for rows in range(max_hashes, 0, -1):
        bands = max_hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return max_hashes, 1


class Shingler:
    """Distinct 64-bit hashes of a text's word n-grams, sorted."""

    def __init__(self, how: NgramJoin):
        import xxhash

        self.how, self.known, self.hash = how, {}, xxhash.xxh3_64_intdigest

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, "u8")
        known, hashed = self.known, self.hash
        if len(known) > self.how.cache_words:
            known.clear()
        get = known.get
        found = [get(w) for w in words]
        if None in found:
            for w, h in zip(words, found, strict=True):
                if h is None:
                    known[w] = hashed(w)
            found = [known[w] for w in words]
        h = np.array(found, "u8")
        n = min(self.how.gram, len(h))
        out = np.full(len(h) - n + 1, n, "u8")
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


class Signer:
    def __init__(self, how: NgramJoin, hashes: int):
        self.bands, self.rows = choose_bands(how.threshold, how.recall, hashes)
        r = np.random.default_rng(hashes)
        n = self.bands * self.rows
        self.mul = r.integers(1, 2**63, n, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.add = r.integers(0, 2**63, n, dtype="u8")

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.mul), 2**32 - 1, "u8")
        for k in range(0, len(shingles), 256):
            some = shingles[k : k + 256, None] * self.mul + self.add
            best = np.minimum(best, (some >> np.uint64(32)).min(axis=0))
        out = np.arange(1, self.bands + 1, dtype="u8")
        for row in best.reshape(self.bands, self.rows).T:
            out = (out ^ row) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out.view("i8")


def _digest(shingles: bytes) -> tuple[int, int]:
    import xxhash

    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles), "i8").tolist()
    return a, b


def signatures(docs: DataFrame, how: NgramJoin) -> DataFrame:
    """doc_id, a 128-bit digest of the n-gram set (d1, d2), its size n, and the band hashes."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        one, sign = Shingler(how), Signer(how, how.max_hashes)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                n, bands, d1, d2 = [], [], [], []
                for t in part.column("text"):
                    s = one.shingles(t.as_py())
                    d = _digest(s.tobytes())
                    n.append(len(s))
                    d1.append(d[0])
                    d2.append(d[1])
                    bands.append(sign.bands_of(s) if len(s) else np.zeros(0, "i8"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "d1", "d2", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it is connected with.

    Alternating large and small stars, each round written to the shared folder, until nothing changes. The
    smallest neighbours are written too, so both sides of their join come from plain exchanges and Spark may
    split a node with very many neighbours. The number of edges tells how many files are enough.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(e)

    def small_table(df: DataFrame, label: str) -> DataFrame:
        return written(few(df, before[0]), label)

    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = small_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = small_table(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share, as a matrix; only those that several sets have are looked at."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    number = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], number[often]
    out = np.zeros((m, m), "f4")
    if len(number):
        number = np.cumsum(np.concatenate(([0], number[1:] != number[:-1])))
        width = max(64, 8_000_000 // m)  # columns at once: 32 MB
        for k in range(0, int(number[-1]) + 1, width):
            a, b = np.searchsorted(number, (k, k + width))
            part = np.zeros((m, min(width, int(number[b - 1]) - k + 1)), "f4")
            part[owner[a:b], number[a:b] - k] = 1
            out += part @ part.T
    return out.astype("i8")


def _verify(how: NgramJoin):
    """Links between two blocks of a candidate group, or within one: per member their number and its smallest reachable member."""

    def verify(table):
        import pyarrow as pa

        # where the smallest doc_id has a member's text in several rows, the member is here as often
        ids, own = np.unique(table.column("m").to_numpy(), return_index=True)
        side, copies = (table.column(c).to_numpy()[own] for c in ("side", "copies"))
        blobs = table.column("shingles").to_pylist()
        sets = [np.frombuffer(blobs[k], "u8") for k in own.tolist()]
        sizes = np.array([len(s) for s in sets], "i8")
        shared = common_counts(sets)
        union = sizes[:, None] + sizes[None, :] - shared
        linked = shared / union >= how.threshold
        np.fill_diagonal(linked, False)
        if table.column("i")[0] != table.column("j")[0]:
            linked &= side[:, None] != side[None, :]
        links = linked @ copies.astype("f8")
        label = np.arange(len(ids))
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.table({"m": ids, "links": links.astype("i8"), "near": ids[label]})

    return verify


def _lead_edges(banded: DataFrame, keys: list[str]) -> DataFrame:
    """From each member to the smallest of its bucket; buckets with one member end here."""
    buckets = banded.groupBy(*keys).agg(F.min("m").alias("lead"), F.count("*").alias("n")).where("n > 1")
    return banded.join(buckets, keys).where("m <> lead").select(F.col("m").alias("a"), F.col("lead").alias("b"))


def _sized(groups: DataFrame, how: NgramJoin) -> DataFrame:
    """(m, root, blocks) of groups (m, root): sizes are pre-aggregated counts, and n members have ceil(n / block) blocks."""
    return groups.join(groups.groupBy("root").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks")), "root")


def _tighter(large: DataFrame, how: NgramJoin) -> DataFrame:
    """(m, root) of the parts into which large groups (m, root, shingles) fall under longer bands; members alone are left out."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = Signer(how, how.strict_hashes)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                bands = [signer.bands_of(np.frombuffer(x, "u8")) for x in part.column("shingles").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("m"), part.column("root"), pa.array(bands, pa.list_(pa.int64()))], names=["m", "root", "bands"])

    signed = written(large.select("m", "root", "shingles").mapInArrow(sign, "m long, root long, bands array<long>"), "strict")
    edges = _lead_edges(signed.select("m", "root", F.posexplode("bands").alias("band", "h")), ["root", "band", "h"])
    return written(few(components(edges).select(F.col("node").alias("m"), "root"), signed.count()), "parts")


def near_classes(docs: DataFrame, how: NgramJoin = NgramJoin()) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    signed = written(signatures(docs, how), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    members = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    n = usable.count()
    members = written(few(members, n).withColumn("m", F.monotonically_increasing_id()), "members")
    edges = _lead_edges(members.select("m", F.posexplode("bands").alias("band", "h")), ["band", "h"])
    groups = written(few(components(edges).select(F.col("node").alias("m"), "root"), n), "groups")
    grouped = _sized(groups, how).join(members.select("m", "rep", "d1", "d2", "copies"), "m")

    def shingle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one, names = Shingler(how), ["m", "root", "blocks", "copies"]
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, seen = b.slice(k, 256), []
                blobs = [one.shingles(t.as_py()).tobytes() for t in part.column("text")]
                # of several texts under one doc_id, the member's own
                for x, p, q in zip(blobs, part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True):
                    seen.append(_digest(x) == (p, q))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(blobs, pa.binary())], names=[*names, "shingles"]).filter(pa.array(seen, pa.bool_()))

    full = docs.join(grouped.withColumnRenamed("rep", "doc_id"), "doc_id").select("m", "root", "blocks", "copies", "d1", "d2", "text")
    full = full.mapInArrow(shingle, "m long, root long, blocks int, copies long, shingles binary")
    full = written(few(full, n, 20_000), "sets")
    small, large = full.where("blocks = 1"), full.where("blocks > 1")
    tasks = small.select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "m", F.lit(0).alias("side"), "copies", "shingles")
    if not large.isEmpty():
        dealt = _sized(_tighter(large, how), how).withColumn("side", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
        pair = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, side) as i, greatest(k, side) as j))")
        rest = large.select("m", "copies", "shingles").join(dealt, "m").withColumn("p", F.explode(pair))
        # parts of a large group are numbered by a member, as whole groups are, and never share one with these
        tasks = tasks.unionByName(rest.select("root", "p.i", "p.j", "m", "side", "copies", "shingles"))
    verified = tasks.groupBy("root", "i", "j").applyInArrow(_verify(how), "m long, links long, near long")
    verified = written(few(verified, n, 20_000), "verified")

    classes = components(verified.where("m <> near").select(F.col("m").alias("a"), F.col("near").alias("b")))
    classes = written(few(classes.select(F.col("node").alias("m"), "root").join(members.select("m", "rep"), "m"), n), "classes")
    least = written(few(classes.groupBy("root").agg(F.min("rep").alias("class")), n), "least")
    links = verified.groupBy("m").agg(F.sum("links").alias("links"))
    known = members.select("m", "d1", "d2", "rep", "copies").join(links, "m", "left").join(classes.join(least, "root").select("m", "class"), "m", "left")
    known = known.select("d1", "d2", F.coalesce("class", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    usable_row = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", F.when(usable_row, F.col("d1")).alias("d1"), F.when(usable_row, F.col("d2")).alias("d2")).join(known, ["d1", "d2"], "left")
    return out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
