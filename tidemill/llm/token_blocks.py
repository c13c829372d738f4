"""Token ids as binary files of patched frame-of-reference blocks.

Documents are dealt into ranges of rising doc_id, one task and one file each; a task sorts its range, encodes it
and streams the ids into its file. A file holds, one after another, blocks of ``block`` ids, then its index:

    block:  minimum u4 | width u1 | 0 | exceptions u2 | ids less the minimum, their low ``width`` bits | places u1 | what is above the width u4
    index:  where each block starts u8 ... | doc_id i8 ... | whether it is null u1 ... | where its ids begin in the file u8 ...
    end:    blocks u8 | documents u8 | ids u8 | block u4 | magic 8 bytes

The width is the least that ``percent`` of a block's ids fit; the others are its exceptions, so that a rare high
id doesn't widen its block. All numbers are little-endian; the last block is filled up with its last id. From the index any
stretch of ids is read without the blocks before it.

A file counts only once the manifest names it. Tasks write under a name of their own and the manifest is a Spark table, so
a task that is run again, or twice at a time, leaves at most a file that nobody reads. Files are opened through Arrow's
file systems by the URI of the shared folder.

Nulls and edges: a null or empty text is the end id alone; texts of any length are encoded whole; a null doc_id comes
first; rows with one doc_id follow one another by their text's hash, alike ones in any order, and need not share a file; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, whole, written
from .packing import WordEncoder

MAGIC = b"PFORIDS1"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("n", "<u2")])
_END = np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("block", "<u4"), ("magic", "S8")])


@dataclass(frozen=True)
class TokenBlocks:
    tokenizer: str
    end: int = 2
    block: int = 256
    percent: int = 90
    #: Ids that are packed or unpacked at a time.
    at_once: int = 1 << 18
    file_bytes: int = 32 << 20
    cache_words: int = 120_000
    slice_rows: int = 2_048


def pack_blocks(ids: np.ndarray, how: TokenBlocks) -> tuple[bytes, np.ndarray]:
    """Whole blocks of unsigned 32-bit ids as bytes, and the bytes of each."""
    size = how.block
    rows = ids.reshape(-1, size)
    low = rows.min(1)
    rest = rows - low[:, None]
    bits = np.frexp(rest.astype("f8"))[1].astype("u1")
    width = np.sort(bits, 1)[:, min(size - 1, -(-size * how.percent // 100) - 1)]
    above = rest >> np.minimum(width, 31)[:, None]
    above[width == 32] = 0
    block_of, place = np.nonzero(above)
    n = np.bincount(block_of, minlength=len(rows))
    packed = width.astype("i8") * (size // 8)
    length = _HEAD.itemsize + packed + 5 * n
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), "u1")
    head = np.zeros(len(rows), _HEAD)
    head["low"], head["width"], head["n"] = low, width, n
    out[at[:, None] + np.arange(_HEAD.itemsize)] = head.view("u1").reshape(-1, _HEAD.itemsize)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        lanes = np.unpackbits(rest[some].astype("<u4").view("u1").reshape(len(some), size, 4), axis=2, bitorder="little")[:, :, :w]
        out[(at[some] + _HEAD.itemsize)[:, None] + np.arange(w * size // 8)] = np.packbits(lanes.reshape(len(some), -1), axis=1, bitorder="little")
    if len(block_of):
        nth = np.arange(len(block_of)) - (np.cumsum(n) - n)[block_of]
        first = (at + _HEAD.itemsize + packed)[block_of]
        out[first + nth] = place
        out[(first + n[block_of] + 4 * nth)[:, None] + np.arange(4)] = above[block_of, place].astype("<u4").view("u1").reshape(-1, 4)
    return out.tobytes(), length


def unpack_blocks(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ids of the blocks that start at the given bytes of data."""
    head = data[at[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD).reshape(-1)
    width, n = head["width"], head["n"].astype("i8")
    rest = np.zeros((len(at), size), "<u4")
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        lanes = np.zeros((len(some), size, 32), "u1")
        lanes[:, :, :w] = np.unpackbits(data[(at[some] + _HEAD.itemsize)[:, None] + np.arange(w * size // 8)], axis=1, bitorder="little").reshape(len(some), size, w)
        rest[some] = np.packbits(lanes, axis=2, bitorder="little").view("<u4").reshape(len(some), size)
    block_of = np.repeat(np.arange(len(at)), n)
    if len(block_of):
        nth = np.arange(len(block_of)) - (np.cumsum(n) - n)[block_of]
        first = (at + _HEAD.itemsize + width.astype("i8") * (size // 8))[block_of]
        above = data[(first + n[block_of] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        rest[block_of, data[first + nth]] |= above << width[block_of].astype("u4")
    return (rest + head["low"][:, None]).reshape(-1)


class BlockWriter:
    """Streams documents' ids into one file; holds less than ``at_once`` ids and the index."""

    def __init__(self, sink, how: TokenBlocks):
        self.sink, self.how = sink, how
        self.waiting, self.held, self.ids, self.at = [], 0, 0, 0
        self.starts, self.docs, self.begins = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.begins.append(self.ids)
        self.ids += len(ids) // 4
        view = memoryview(ids)
        for k in range(0, len(ids), 4 * self.how.at_once):
            part = view[k : k + 4 * self.how.at_once]
            self.waiting.append(part)
            self.held += len(part) // 4
            if self.held >= self.how.at_once:
                self._flush(self.held // self.how.block * self.how.block)

    def _flush(self, n: int) -> None:
        held = np.frombuffer(b"".join(self.waiting), "<u4")
        if n > len(held):
            held = np.r_[held, np.repeat(held[-1:], n - len(held))].astype("<u4")
        if n:
            data, length = pack_blocks(held[:n], self.how)
            self.starts.append(self.at + np.cumsum(length) - length)
            self.sink.write(data)
            self.at += len(data)
        rest = held[n:]
        self.waiting, self.held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(-(-self.held // self.how.block) * self.how.block)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0)
        null = np.array([d is None for d in self.docs], "u1")
        end = np.array([(len(starts), len(self.docs), self.ids, self.how.block, MAGIC)], _END)
        for part in (starts.astype("<u8"), np.array([d or 0 for d in self.docs], "<i8"), null, np.array(self.begins, "<u8"), end):
            self.sink.write(part.tobytes())


class BlockReader:
    """A file's index and its ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        end = np.frombuffer(source.read_at(_END.itemsize, size - _END.itemsize), _END)[0]
        if end["magic"] != MAGIC:
            raise ValueError("not a file of token blocks")
        blocks, docs, self.n_ids, self.block = (int(end[k]) for k in ("blocks", "docs", "ids", "block"))
        self.index_at = size - _END.itemsize - 8 * blocks - 17 * docs
        index = source.read_at(8 * blocks + 17 * docs, self.index_at)
        self.starts = np.frombuffer(index, "<u8", blocks).astype("i8")
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(index, "u1", docs, 8 * blocks + 8 * docs).astype(bool)
        self.begins = np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs).astype("i8")

    def ids(self, first: int, n: int) -> np.ndarray:
        """ids first ... first + n - 1 of the file; only their blocks are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = first // self.block, -(-(first + n) // self.block)
        low = int(self.starts[a])
        high = int(self.starts[b]) if b < len(self.starts) else self.index_at
        data = np.frombuffer(self.source.read_at(high - low, low), "u1")
        return unpack_blocks(data, self.starts[a:b] - low, self.block)[first - a * self.block :][:n]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_MANIFEST = "file long, path string, docs long, ids long, bytes long"


def write(docs: DataFrame, how: TokenBlocks, folder: str | None = None) -> DataFrame:
    """Writes all documents; the manifest: file (its place in the order of doc_id), path, documents, ids and bytes of each file."""
    import pyarrow as pa

    docs = whole(docs, {"doc_id": "long", "text": "string"})
    folder = folder or new_path(docs.sparkSession, "ids")

    def encode(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        for batch in batches:
            if out is None:
                code, end = WordEncoder(how.tokenizer, how.cache_words), np.array([how.end], "<u4").tobytes()
                where, path = _open(f"{folder}/ids-{task.partitionId():06d}-{uuid.uuid4().hex}.pfor")
                where.create_dir(path.rpartition("/")[0], recursive=True)
                stream = where.open_output_stream(path)
                out = BlockWriter(stream, how)
            for k in range(0, batch.num_rows, how.slice_rows):
                some = batch.slice(k, how.slice_rows)
                for doc, ids in zip(some.column(0).to_pylist(), code.encode(some.column(1)), strict=True):
                    out.add(doc, ids + end)
        if out is not None:
            out.close()
            size = stream.tell()
            stream.close()
            name = f"{folder}/{path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist([{"file": task.partitionId(), "path": name, "docs": len(out.docs), "ids": out.ids, "bytes": size}])

    files = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // how.file_bytes + 1
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("tie")]
    ranged = docs.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(ranged.select("doc_id", "text").mapInArrow(encode, _MANIFEST), "manifest")


def read_back(manifest: DataFrame, how: TokenBlocks) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, for every document."""
    import pyarrow as pa

    def decode(batches: Iterator) -> Iterator:
        for batch in batches:
            for path, before in zip(*(batch.column(c).to_pylist() for c in ("path", "before")), strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    f = BlockReader(source)
                    bounds = np.append(f.begins, f.n_ids)
                    crc, doc = np.zeros(len(f.begins), "i8"), 0
                    for first in range(0, f.n_ids, how.at_once):
                        data = memoryview(f.ids(first, min(how.at_once, f.n_ids - first)).astype("<u4").tobytes())
                        last = first + len(data) // 4
                        while doc < len(crc) and bounds[doc] < last:
                            a, b = max(bounds[doc], first) - first, min(bounds[doc + 1], last) - first
                            crc[doc] = zlib.crc32(data[4 * a : 4 * b], int(crc[doc]))
                            if bounds[doc + 1] > last:
                                break
                            doc += 1
                for k in range(0, len(crc), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[part], mask=f.null[part]), pa.array(f.begins[part] + before), pa.array(np.diff(bounds)[part]), pa.array(crc[part])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # a row a file; which files there are is known on the driver anyway
    before = F.sum("ids").over(Window.orderBy("file")) - F.col("ids")
    files = manifest.select("path", before.alias("before")).repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
