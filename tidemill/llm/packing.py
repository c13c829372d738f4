"""Best-fit packing of tokenised documents into fixed sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts those above the sequence length into pieces and packs
the pieces by best fit, longest first. Bins that are nearly full are final. Underfull bins go up a
tree of partitions as items: at each node the bins of up to ``fan_in`` children are packed into one
another by best fit again, until one node is left.

What goes up is bounded without changing the packing. Two bins above half can never be one, and best
fit leaves at most one bin of half or less in a partition, as two of them would have been one. So all merges of the
tree together need no more bins of any fill than there are such small bins in all partitions, and
that many of each fill go up; the others of that fill are final as they are.

Nulls and edges: a null or empty text is the end token alone; texts of any length are tokenised
whole; repeated rows are packed each; a null doc_id stays null; an empty table gives no rows; only
doc_id and text are read. Every row of the result is deterministic for a given split of the input.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written

END = 1
#: Marks that the tokenizer splits from the letters before them, as one piece of text.
_MARKS = r"""!"#$%&()*+,-./:;=?@[\]^_`{}~"""
#: Words above this length are not kept in the cache.
_LONG = 40
#: Letters beyond ASCII that NFC leaves as they are and whose lower case is one of them too.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    length: int = 4096
    nearly_full: int = 16
    fan_in: int = 8
    cache_words: int = 120_000
    slice_rows: int = 2_048


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts, little-endian unsigned 32-bit, from ids of their words.

    The tokenizer normalises and splits within white space, so a text's ids are those of its words
    in a row. The words of many texts are numbered at once, and each distinct one is looked at once: one of
    plain letters and marks goes straight to the tokenizer's model, any other through the whole tokenizer.
    The cache of letters' ids has two generations of ``limit`` entries at most: what the older one holds and
    is met again moves to the newer, the rest goes when the newer is full. An encoder belongs to one task
    and goes with it.
    """

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pre_token(self, part: str) -> bytes:
        """Ids of lower-case letters, or of marks."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, w: str) -> bytes:
        core = w.rstrip(_MARKS)
        plain = core.isalpha() and (core.isascii() or _LATIN.fullmatch(core))
        key = core.lower() if plain else w
        ids = self.known.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = self._pre_token(key) if plain else array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
            if len(key) <= _LONG:
                if len(self.known) >= self.limit:
                    self.known, self.older = {}, self.known
                self.known[key] = ids
        if not plain or len(core) == len(w):
            return ids
        mark = w[len(core) :]
        more = self.marks.get(mark)
        if more is None:
            more = self._pre_token(mark)
            if len(mark) <= 4:
                self.marks[mark] = more
        return ids + more

    def encode(self, texts) -> list[bytes]:
        """texts: an Arrow array of strings; null has no ids."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(lists.flatten())
        blobs = list(map(self._word, words.dictionary.to_pylist()))
        pool = np.frombuffer(b"".join(blobs), "u4")
        size = np.fromiter(map(len, blobs), "i8", len(blobs)) // 4
        which = words.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        ids = pool[np.repeat((np.cumsum(size) - size)[which] - (ends - n), n) + np.arange(int(n.sum()))]
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """A bin for each size: longest first, each into the fullest bin that has room. O(1) a step, as room is a small integer."""
    sizes = list(sizes)
    out, open_bins, rooms, n = [0] * len(sizes), [[] for _ in range(capacity + 1)], 0, 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[k]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        out[k] = b
        if room > need:
            open_bins[room - need].append(b)
            rooms |= 1 << (room - need)
    return out


def _pieces(batches: Iterator, how: Packing) -> Iterator:
    """One row a piece, placed in a bin of this partition; open_fill: tokens in the bin, if it is underfull."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    code, most, end = WordEncoder(how.tokenizer, how.cache_words), how.length, array("I", [END]).tobytes()
    ids, piece, start, size, crc = [], array("i"), array("q"), array("q"), array("q")
    for batch in batches:
        for k in range(0, batch.num_rows, how.slice_rows):
            some = batch.slice(k, how.slice_rows)
            for doc, tokens in zip(some.column(0).to_pylist(), code.encode(some.column(1)), strict=True):
                tokens += end
                for n, at in enumerate(range(0, len(tokens), 4 * most)):
                    part_of = tokens[at : at + 4 * most]
                    ids.append(doc)
                    piece.append(n)
                    start.append(at // 4)
                    size.append(len(part_of) // 4)
                    crc.append(zlib.crc32(part_of))
    if not ids:
        return
    length = np.frombuffer(size, "i8")
    bins = np.array(best_fit(length.tolist(), most), "i8")
    fill = np.bincount(bins, weights=length).astype("i8")
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    first = np.r_[True, np.diff(bins[order]) != 0]
    offset = np.empty_like(before)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    is_open = (most - fill > how.nearly_full)[bins]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.frombuffer(piece, "i4")), pa.array(np.frombuffer(start, "i8")), pa.array(length), pa.array(np.frombuffer(crc, "i8")), pa.array((part << 32) + bins), pa.array(offset), pa.array(fill[bins], mask=~is_open), pa.array(np.full(len(ids), part, "i4"))],
        names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open_fill", "part"],
    )


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open_fill long, part int"
_BINS = "node int, fill long, is_open boolean, members array<struct<bin:long,shift:long>>"


def _merge(how: Packing, last: bool, small: int):
    """Packs the bins of a node's children, as items, into one another; small: how many bins of half or less there were."""

    def merge(bins):
        import pandas as pd

        bins = bins.sort_values("fill", kind="stable", ascending=False)
        groups: dict[int, list[int]] = {}
        for k, b in enumerate(best_fit(bins.fill.tolist(), how.length)):
            groups.setdefault(b, []).append(k)
        fills, members, rows = bins.fill.tolist(), bins.members.tolist(), []
        for own in groups.values():
            at, held = 0, []
            for k in own:
                held += [{"bin": int(m["bin"]), "shift": int(m["shift"]) + at} for m in members[k]]
                at += fills[k]
            rows.append((at, held))
        same, is_open = Counter(), []
        for fill, _ in rows:
            same[fill] += 1
            is_open.append(not last and how.length - fill > how.nearly_full and same[fill] <= small)
        return pd.DataFrame({"node": bins.node.iloc[0], "fill": [r[0] for r in rows], "is_open": is_open, "members": [r[1] for r in rows]})

    return merge


def pack(docs: DataFrame, how: Packing) -> DataFrame:
    """Per piece: its document, place in it, ids' crc32, sequence and place in that."""
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    pieces = written(docs.mapInArrow(lambda batches: _pieces(batches, how), _PIECES), "pieces")
    bins = pieces.where("open_fill is not null").groupBy("bin").agg(F.first("part").alias("node"), F.first("open_fill").alias("fill"))
    level = bins.select("node", "fill", F.lit(True).alias("is_open"), F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))
    width, done = (pieces.agg(F.max("part")).first()[0] or 0) + 1, None
    small = bins.where(F.col("fill") <= how.length // 2).count()
    while True:
        last = width <= how.fan_in
        # the node is a place in the tree, so a group holds fan_in children's bounded rests
        level = level.withColumn("node", F.floor(F.col("node") / how.fan_in).cast("int"))
        level = written(level.groupBy("node").applyInPandas(_merge(how, last, small), _BINS).coalesce(max(8, width)), "bins")
        final = level.where("not is_open")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        level, width = level.where("is_open"), -(-width // how.fan_in)
    moved = done.select(F.col("members")[0]["bin"].alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
    open_pieces = pieces.where("open_fill is not null").join(moved, "bin")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (
        pieces.where("open_fill is null").select(*columns, F.col("bin").alias("sequence_id"), "offset")
        .unionByName(open_pieces.select(*columns, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset")))
    )
