"""Removal of repeated byte strings by distributed suffix sorting (deep-shallow).

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Each start position is a suffix, and suffixes equal in their first ``length`` bytes are
found by sorting; no candidate is dropped, and hashes only choose where things meet:

1. The smallest hash of the ``gram``-byte strings within a window of ``length`` bytes depends on the
   window alone, so equal windows have equal smallest hashes. Consecutive windows with the same one
   form a run. Runs' hashes (shortened) are dealt into buckets; those of one text only are done.
2. Documents get back their hashes that others have too and send just those runs' bytes to buckets.
3. A run's first suffix is sorted to the run's end, the others to ``length`` bytes: multikey quicksort
   over eight-byte characters to the depth ``shallow``, then blind tries order the groups that are
   still equal. Neighbours without a difference are equal: runs of one class, or, where a hash has
   several classes, windows. They get the smallest document; the covered spans go back to the documents.

Texts move compressed. A hash or run that many documents share is pre-aggregated: a task sends it once in
``flush_bytes`` of text and settles the rest itself by the same sort, so a passage or a copied text in a third
of all documents makes one row for every such amount of text. In a bucket, equals are sorted, never paired.

A row is known by its doc_id and 128 bits of its text's hash, never by its place in the input, so a lost
executor or another split of the files changes nothing. Rows alike in both have the same result.

Nulls and edges: a null text is empty; texts shorter than ``length`` stay whole; a row with a null
doc_id keeps all bytes and removes none; rows with the same doc_id do not remove from each other;
repeats within a document stay; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written
from .url_filter import UrlFilter, bits_for, bloom_blocks, may_be_listed

#: The filter has 2 ** this many blocks of 40 bytes at most, however many rows lose bytes.
FILTER_BITS = 18


@dataclass(frozen=True)
class SuffixDedup:
    length: int = 50
    gram: int = 20
    shallow: int = 16
    #: Bytes of text for which one bucket is made at least, and what a task gathers before it deals out.
    bucket_bytes: int = 32_000_000
    flush_bytes: int = 32_000_000
    #: Windows whose suffixes are sorted at once, of whole hashes.
    windows: int = 400_000


#: Bytes of a common prefix that are compared at once, at most.
_PIECE = 1 << 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram consecutive bytes, by doubling."""
    h = (data.astype("u8") + np.uint64(1)) * _M1
    h ^= h >> np.uint64(32)
    done = 1
    while done < gram:
        step = min(done, gram - done)
        m = len(h) - step
        if m <= 0:
            return h[:0]
        h = (h[:m] * _M2) ^ h[step:]
        h *= _M3
        h ^= h >> np.uint64(29)
        done += step
    return h


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width consecutive values, by doubling."""
    done = 1
    while done < width and len(h):
        step = min(done, width - done)
        h = np.minimum(h[: max(0, len(h) - step)], h[step:])
        done += step
    return h


def runs(data: np.ndarray, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window of each run of windows with the same smallest hash."""
    if len(data) < how.length:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    least = window_least(gram_hashes(data, how.gram), how.length - how.gram + 1)
    low = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[low], low, np.concatenate((low[1:], [len(least)])) - 1


def bucket_and_key(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a hash is dealt, and the 32 bits that stand for it there."""
    g = g * _M2
    return ((g >> np.uint64(40)) % np.uint64(buckets)).astype("i8"), (g & np.uint64(0xFFFFFFFF)).astype("u4")


def eight_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, big-endian, as one character; data reaches eight bytes beyond the last place."""
    view = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))
    return view[at].astype("u8")


def _heads(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment number of each place and the sizes of segments, from where they begin."""
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, np.diff(np.append(first, len(new)))


def partition_sort(key: np.ndarray, new: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order that sorts key within segments, which begin where new is set.

    Quicksort's partition into less, equal and greater around a median of three, for all large segments
    at once; the equal part is done. Segments of up to ``small`` are finished by one sort.
    """
    order, new, live = np.arange(len(key)), new.copy(), np.ones(len(key), bool)
    while True:
        number, size = _heads(new)
        k = np.flatnonzero(live & (size > small)[number])
        if not len(k):
            break
        own = key[order[k]]
        begins = np.concatenate(([True], number[k][1:] != number[k][:-1]))
        seg, n = _heads(begins)
        first = np.flatnonzero(begins)
        three = np.sort(np.stack([own[first], own[first + n // 2], own[first + n - 1]]), axis=0)
        pivot = three[1][seg]
        side = (own > pivot).astype("i8") + (own >= pivot)
        code = seg * 3 + side
        count = np.bincount(code, minlength=3 * len(n))
        base = np.cumsum(count) - count
        place = np.empty(len(k), "i8")
        for c in range(3):
            mine = np.flatnonzero(side == c)
            # places come in order, so the nth of a code in this list is the nth of its part
            part = code[mine]
            start = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=3 * len(n)))))[part]
            place[mine] = base[part] + np.arange(len(mine)) - start
        moved = order[k]
        order[k[place]] = moved
        live[k[place]] = side != 1
        new[k[base[count > 0]]] = True
    k = np.flatnonzero(live)
    if len(k):
        number, _ = _heads(new)
        order[k] = order[k[np.lexsort((key[order[k]], number[k]))]]
    return order


def shallow_sort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over characters of eight bytes to the given depth: the order, and where groups begin of what is equal so far."""
    order, new = np.arange(len(starts)), np.zeros(len(starts), bool)
    new[:1] = True
    for at in range(0, depth, 8):
        number, size = _heads(new)
        k = np.flatnonzero((size > 1)[number])  # only groups of two or more go deeper
        if not len(k):
            break
        key = eight_bytes(data, starts[order[k]] + at)
        begins = np.concatenate(([True], number[k][1:] != number[k][:-1]))
        sub = partition_sort(key, begins)
        order[k], key = order[k[sub]], key[sub]
        new[k] |= begins | np.concatenate(([True], key[1:] != key[:-1]))
    return order, new


def blind_tries(data: np.ndarray, starts: np.ndarray, room: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int, width: int) -> None:
    """Orders the groups that are equal to ``depth`` by the next ``width`` bytes, each suffix as far as it has room, in place.

    The tries of all groups grow at once. In each round the first suffix of a node is its path; every
    other is compared with it once and hangs where it branches off, at the length of their common prefix
    and the next byte, which is all that a blind trie keeps. What branches off to the left stands
    before the path, the earlier the farther; what branches off to the right stands behind it, the later the
    nearer. Suffixes on one branch are the next round's nodes.
    """
    rows = np.lib.stride_tricks.sliding_window_view(data, width)
    step = np.arange(width)
    todo = np.ones(len(order), bool)
    while True:
        number, size = _heads(new)
        k = np.flatnonzero(todo & (size > 1)[number])
        if not len(k):
            return
        begins = np.concatenate(([True], number[k][1:] != number[k][:-1]))
        path = order[k][np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))]
        code = np.full(len(k), 1 << 40)  # equal to the path
        rest = np.flatnonzero(~begins)
        for x in range(0, len(rest), max(1, 3_000_000 // width)):
            r = rest[x : x + max(1, 3_000_000 // width)]
            one, two = order[k[r]], path[r]
            own, other = (np.where(step < (room[s] - depth)[:, None], rows[np.minimum(starts[s] + depth, len(rows) - 1)].astype("i2") + 1, 0) for s in (one, two))
            differ = own != other
            at = differ.argmax(axis=1)
            nth = np.arange(len(r))
            branched = differ[nth, at]
            byte, left = own[nth, at], own[nth, at] < other[nth, at]
            far = np.where(left, (at << 9) | byte, (2 << 40) + ((width - at) << 9) + byte)
            code[r[branched]] = far[branched]
        sub = np.lexsort((code, number[k]))
        order[k], code = order[k[sub]], code[sub]
        new[k] |= begins | np.concatenate(([True], code[1:] != code[:-1]))
        todo[k] = code != 1 << 40


def equal_suffixes(data: np.ndarray, starts: np.ndarray, room: np.ndarray, how: SuffixDedup) -> np.ndarray:
    """A number for each start, in the order of the suffixes; equal for equal suffixes, each as long as its room. Deep-shallow sorting.

    Long common prefixes are gone through piece by piece, so what is compared at once is bounded however long they are.
    """
    if not len(starts):
        return np.zeros(0, "i8")
    most = int(room.max())
    lack = int((starts + room).max()) + min(most, _PIECE) + 8 - len(data)
    if lack > 0:  # places are read whole, beyond the end of the last text too
        data = np.concatenate((data, np.zeros(lack, "u1")))
    depth = min(how.shallow, int(room.min()) // 8 * 8)
    order, new = shallow_sort(data, starts, depth)
    while depth < most:
        number, size = _heads(new)
        deep = np.zeros(len(size), bool)
        deep[number[room[order] > depth]] = True  # groups of which some go on
        k = np.flatnonzero((deep & (size > 1))[number])
        if not len(k):
            break
        width = min(_PIECE, most - depth, max(64, 4_000_000 // len(k)))
        own = order[k]
        begins = np.concatenate(([True], number[k][1:] != number[k][:-1]))
        sub = np.arange(len(k))
        blind_tries(data, starts[own], room[own], sub, begins, depth, width)
        order[k] = own[sub]
        new[k] |= begins
        depth += width
    out = np.empty(len(starts), "i8")
    out[order] = np.cumsum(new) - 1
    return out


def _join(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _expand(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


class _Held:
    """The documents of a block, the amount of text that a task gathers: their rows, and what was found in them."""

    def __init__(self):
        self.docs, self.found, self.size = [], [], 0

    def add(self, doc: tuple[int, int, int], found, size: int) -> None:
        self.docs.append(doc)
        self.found.append(found)
        self.size += size

    def table(self) -> tuple[int, bytes]:
        """The block's number and its documents (doc_id and hash of the text); the number is told by these alone."""
        import xxhash

        docs = np.array(self.docs, "i8").tobytes()
        return int(np.array(xxhash.xxh3_64_intdigest(docs), "u8").view("i8")), docs


_HASHES = "bucket int, home int, block long, keys binary, low binary, high binary, docs binary"
_ANSWERS = "block long, bucket int, keys binary, rows binary, docs binary"


def _batch(schema: dict, *values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.values(), strict=True)], names=list(schema))


def _deal_hashes(how: SuffixDedup, buckets: int):
    """Step 1: hashes of runs, dealt out; a row holds what one block sends to one bucket.

    However many texts share a hash, a block sends it once. Buckets below 0 carry answers and the documents of blocks.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = {"bucket": pa.int32(), "home": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "low": pa.binary(), "high": pa.binary(), "docs": pa.binary()}
        held = _Held()

        def flush():
            block, docs = held.table()
            back = -1 - block % buckets
            yield _batch(names, back, -1, block, b"", b"", b"", docs)
            g, row = np.concatenate(held.found), np.repeat(np.arange(len(held.found), dtype="u4"), [len(x) for x in held.found])
            b, key = bucket_and_key(g, buckets)
            order = np.lexsort((key, b))
            b, key, row = b[order], key[order], row[order]
            # a key of several texts here is known to be shared: it sends one row, and the answer goes back at once
            same = (b[1:] == b[:-1]) & (key[1:] == key[:-1])
            many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            head = np.concatenate(([True], ~same))
            for known, own in ((False, head), (True, many)):
                home, keys, rows = b[own], key[own], row[own]
                if not len(home):
                    continue
                cuts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True])))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    low, high = (rows[x:y] & np.uint32(0xFFFF)).astype("u2"), (rows[x:y] >> np.uint32(16)).astype("u2")
                    yield _batch(names, back if known else int(home[x]), int(home[x]), block, keys[x:y].tobytes(), low.tobytes(), high.tobytes(), None)

        for batch in batches:
            ids = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2")), strict=True)
            for doc, text in zip(ids, batch.column("text"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), "u1")
                held.add(doc, np.unique(runs(data, how)[0]), len(data))
                if held.size > how.flush_bytes:
                    yield from flush()
                    held = _Held()
        if held.docs:
            yield from flush()

    return run


def _shared_hashes(table):
    """Step 1, in a bucket: keys that two or more texts have, by the block that sent them."""
    import pyarrow as pa

    keys, rows, blocks = [], [], []
    names = ["block", "bucket", "keys", "rows", "docs"]
    for block, k, low, high in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "low", "high")), strict=True):
        keys.append(np.frombuffer(k, "u4"))
        rows.append(np.frombuffer(low, "u2").astype("u4") | (np.frombuffer(high, "u2").astype("u4") << np.uint32(16)))
        blocks.append(np.full(len(keys[-1]), block, "i8"))
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return pa.table([table.column("block"), table.column("home"), table.column("keys"), pa.array([r.tobytes() for r in rows], pa.binary()), table.column("docs")], names=names)
    key, row, block = np.concatenate(keys), np.concatenate(rows), np.concatenate(blocks)
    del keys, rows, blocks
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    key, row, block = key[many], row[order[many]], block[order[many]]
    order = np.argsort(block, kind="stable")
    key, row, block = key[order], row[order], block[order]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.zeros(1, "i8")
    own = [(int(block[x]), key[x:y].tobytes(), row[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([pa.array([x[0] for x in own], pa.int64()), pa.array([bucket] * len(own), pa.int32()), pa.array([x[1] for x in own], pa.binary()), pa.array([x[2] for x in own], pa.binary()), pa.array([None] * len(own), pa.binary())], names=names)


def _documents_of(table) -> np.ndarray:
    """doc_id and hash of each document of a block; a block that comes twice has the same ones."""
    return np.frombuffer(next(x for x in table.column("docs").to_pylist() if x is not None), "i8").reshape(-1, 3)


def _by_document(table):
    """All buckets' answers for one block, by document: (bucket, key) as one number each."""
    import pyarrow as pa

    keys, rows, docs = [], [], _documents_of(table)
    for bucket, k, r in zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "rows")), strict=True):
        if bucket >= 0:
            keys.append(np.frombuffer(k, "u4").astype("u8") | np.uint64(bucket << 32))
            rows.append(np.frombuffer(r, "u4"))
    key, row = _join(keys, "u8"), _join(rows, "u4").astype("i8")
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, "i8")
    own = docs[row[cuts[:-1]]]
    return pa.table([*(pa.array(own[:, c]) for c in range(3)), pa.array([key[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "h1", "h2", "keys"])


_RUNS = "bucket int, block long, blob binary, docs binary"


def run_classes(n: np.ndarray, pieces: np.ndarray, doc: np.ndarray, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of n bytes each: their class, equal for equal runs, and each class's first run and smallest document."""
    at = np.concatenate(([0], np.cumsum(n)))
    of = equal_suffixes(pieces, at[:-1], n, how)
    first = np.unique(of, return_index=True)[1]
    least = np.full(len(first), np.iinfo("i8").max)
    np.minimum.at(least, of, doc)
    return of, first, least


def _deal_runs(how: SuffixDedup, buckets: int):
    """Step 2: the bytes of runs whose hashes others have too, dealt out.

    However many documents hold the same run, a block sends its bytes once. Buckets below 0 carry spans and the documents of blocks.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = {"bucket": pa.int32(), "block": pa.int64(), "blob": pa.binary(), "docs": pa.binary()}
        held = _Held()

        def flush():
            block, docs = held.table()
            back = -1 - block % buckets
            yield _batch(names, back, block, None, docs)
            row = np.repeat(np.arange(len(held.found), dtype="i4"), [len(x[0]) for x in held.found])
            g, low, n = (np.concatenate([x[k] for x in held.found]) for k in range(3))
            doc = np.array(held.docs, "i8")[row, 0]
            room = bytes(min(int(n.max()), _PIECE) + 8) if len(n) else b""
            pieces = b"".join([held.found[t][3][a : a + m] for t, a, m in zip(row.tolist(), low.tolist(), n.tolist(), strict=True)] + [room])
            held.found.clear()
            # equal runs here: those of a later document are covered, whatever other blocks hold, and only the first's go on
            of, _, least = run_classes(n, np.frombuffer(pieces, "u1"), doc, how)
            ends = np.cumsum(n)
            later = doc > least[of]
            done = np.flatnonzero(later)
            yield _batch(names, back, block, _span_blob(row[done], low[done].astype("u4"), (low[done] + n[done]).astype("u4")), None)
            b = bucket_and_key(g, buckets)[0]
            order = np.lexsort((g, b))
            order = order[~later[order]]
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(b[order]) != 0, [True])))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                k = order[x:y]
                own = b"".join([pieces[e - m : e] for e, m in zip(ends[k].tolist(), n[k].tolist(), strict=True)])
                blob = _squeeze(np.array([len(k)], "i8"), g[k], row[k], doc[k], low[k].astype("i4"), n[k].astype("i4"), np.frombuffer(own, "u1"))
                yield _batch(names, int(b[k[0]]), block, blob, None)

        for batch in batches:
            for doc, h1, h2, z, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "z", "keys")), strict=True):
                data = _expand(z)
                g, low, high = runs(np.frombuffer(data, "u1"), how)
                b, key = bucket_and_key(g, buckets)
                wanted = np.frombuffer(keys, "u8")
                own = (b.astype("u8") << np.uint64(32)) | key
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                k = np.flatnonzero(wanted[at] == own)
                if len(k):
                    n = high[k] - low[k] + how.length
                    held.add((doc, h1, h2), (g[k], low[k], n, data), len(data) + int(n.sum()))
                if held.size > how.flush_bytes:
                    yield from flush()
                    held = _Held()
        if held.docs:
            yield from flush()

    return run


def covered(g: np.ndarray, doc: np.ndarray, n: np.ndarray, pieces: np.ndarray, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered spans (run, from, to), relative to each run's first byte, of runs with the given hashes, documents and bytes."""
    at = np.concatenate(([0], np.cumsum(n)))
    of, first, least = run_classes(n, pieces, doc, how)
    out_run, out_a, out_b = [], [], []
    full = np.flatnonzero(doc > least[of])
    out_run.append(full)
    out_a.append(np.zeros(len(full), "i8"))
    out_b.append(n[full].astype("i8"))
    # hashes with one class have no other text's windows to meet
    order = np.argsort(g[first], kind="stable")
    same = np.diff(g[first][order].view("i8")) == 0
    several = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if len(several):
        members = np.flatnonzero(doc == least[of])  # of each class those in its first document
        members = members[np.argsort(of[members], kind="stable")]
        windows = n[first[several]].astype("i8") - how.length + 1
        # classes of some hashes at a time: equal windows have equal hashes
        ends = np.flatnonzero(np.concatenate((np.diff(g[first][several].view("i8")) != 0, [True]))) + 1
        done = np.cumsum(windows)[ends - 1]
        cuts = np.concatenate(([0], ends[np.concatenate((np.diff(done // how.windows) > 0, [True]))]))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            cls, a, b = _partly(several[x:y], windows[x:y], first, least, at, pieces, how)
            lo, hi = np.searchsorted(of[members], cls, "left"), np.searchsorted(of[members], cls, "right")
            times = hi - lo
            nth_member = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            out_run.append(members[np.repeat(lo, times) + nth_member])
            out_a.append(np.repeat(a, times))
            out_b.append(np.repeat(b, times))
    return np.concatenate(out_run), np.concatenate(out_a), np.concatenate(out_b)


def _partly(several: np.ndarray, windows: np.ndarray, first: np.ndarray, least: np.ndarray, at: np.ndarray, pieces: np.ndarray, how: SuffixDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (class, from, to) of classes of runs that windows of other classes with smaller documents cover."""
    base = np.concatenate(([0], np.cumsum(windows + how.length - 1)))
    data = np.concatenate([pieces[at[k] : at[k + 1]] for k in first[several].tolist()])
    owner = np.repeat(np.arange(len(several)), windows)
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    number = equal_suffixes(data, base[owner] + nth, np.full(len(owner), how.length), how)
    lowest = np.full(int(number.max()) + 1, np.iinfo("i8").max)
    np.minimum.at(lowest, number, least[several][owner])
    hit = np.flatnonzero(lowest[number] < least[several][owner])
    # maximal rows of covered windows
    s = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)))) if len(hit) else hit
    e = np.concatenate((s[1:], [len(hit)])) - 1 if len(hit) else hit
    return several[owner[hit[s]]], nth[hit[s]], nth[hit[e]] + how.length


def _span_blob(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Spans of the documents of one block."""
    return _squeeze(np.array([len(row)], "i8"), row.astype("i4"), a, b)


def _bucket_spans(how: SuffixDedup):
    """Step 3, in a bucket: covered spans, by the block they go back to."""

    def run(table):
        import pyarrow as pa

        if table.column("bucket")[0].as_py() < 0:
            return table.select(["block", "blob", "docs"])
        blocks, sizes, fields = [], [], [[] for _ in range(6)]
        for block, blob in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True):
            raw = _expand(blob)
            m, at = int(np.frombuffer(raw, "i8", 1)[0]), 8
            for k, kind in enumerate(("u8", "i4", "i8", "i4", "i4")):
                fields[k].append(np.frombuffer(raw, kind, m, at))
                at += fields[k][-1].nbytes
            fields[5].append(np.frombuffer(raw, "u1", -1, at))
            blocks.append(block)
            sizes.append(m)
        g, row, doc, low, n, pieces = (np.concatenate(x) for x in fields)
        k, a, b = covered(g, doc, n.astype("i8"), pieces, how)
        # runs of a block stand together
        sender = np.repeat(np.arange(len(blocks)), sizes)[k]
        order = np.lexsort((a, k, sender))
        k, a, b, sender = k[order], a[order], b[order], sender[order]
        cuts = np.flatnonzero(np.concatenate(([True], sender[1:] != sender[:-1], [True]))) if len(k) else np.zeros(1, "i8")
        out = [(blocks[sender[x]], _span_blob(row[k[x:y]], (low[k[x:y]] + a[x:y]).astype("u4"), (low[k[x:y]] + b[x:y]).astype("u4"))) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), pa.array([None] * len(out), pa.binary())], names=["block", "blob", "docs"])

    return run


def _united_spans(table):
    """All buckets' spans of one block, united by document."""
    import pyarrow as pa

    rows, starts, ends, docs = [], [], [], _documents_of(table)
    for blob in table.column("blob").to_pylist():
        if blob is None:
            continue
        raw = _expand(blob)
        m = int(np.frombuffer(raw, "i8", 1)[0])
        rows.append(np.frombuffer(raw, "i4", m, 8))
        starts.append(np.frombuffer(raw, "u4", m, 8 + 4 * m))
        ends.append(np.frombuffer(raw, "u4", m, 8 + 8 * m))
    row, a, b = _join(rows, "i4"), _join(starts, "u4"), _join(ends, "u4")
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    own, out = [], []
    cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, "i8")
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        top = np.maximum.accumulate(b[x:y])
        new = np.concatenate(([True], a[x + 1 : y] > top[:-1]))
        s = np.flatnonzero(new)
        own.append(int(row[x]))
        out.append(np.column_stack((a[x:y][s], top[np.concatenate((s[1:], [y - x])) - 1])).astype("u4").tobytes())
    named = docs[np.array(own, "i8")]
    return pa.table([*(pa.array(named[:, c]) for c in range(3)), pa.array(out, pa.binary())], names=["doc_id", "h1", "h2", "spans"])


_ROW = ["doc_id", "h1", "h2"]


def _compressed(rows: DataFrame) -> DataFrame:
    """A row's key and the text's bytes, compressed before they move."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in _ROW), pa.array([c.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part.column("text")], pa.binary())], names=[*_ROW, "z"])

    return rows.select(*_ROW, "text").mapInArrow(run, "doc_id long, h1 long, h2 long, z binary")


def _keyed(docs: DataFrame) -> DataFrame:
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    return docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")


def repeated_spans(rows: DataFrame, how: SuffixDedup = SuffixDedup()) -> DataFrame:
    """rows: doc_id, h1, h2, text. Result: for rows that lose bytes doc_id, h1, h2 and spans (pairs of unsigned 32-bit from and to)."""
    spark = rows.sparkSession
    long_enough = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= how.length))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // how.bucket_bytes))

    hashes = long_enough.mapInArrow(_deal_hashes(how, buckets), _HASHES)
    shared = hashes.groupBy("bucket").applyInArrow(_shared_hashes, _ANSWERS)
    wanted = shared.groupBy("block").applyInArrow(_by_document, "doc_id long, h1 long, h2 long, keys binary")
    # repeated rows are in several blocks, with the same answers
    wanted = wanted.groupBy(*_ROW).agg(F.first("keys").alias("keys"))

    dealt = _compressed(long_enough).join(wanted, _ROW).mapInArrow(_deal_runs(how, buckets), _RUNS)
    spans = dealt.groupBy("bucket").applyInArrow(_bucket_spans(how), "block long, blob binary, docs binary")
    spans = spans.groupBy("block").applyInArrow(_united_spans, "doc_id long, h1 long, h2 long, spans binary")
    return written(spans.groupBy(*_ROW).agg(F.first("spans").alias("spans")), "spans")


def remove_repeats(docs: DataFrame, how: SuffixDedup = SuffixDedup()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for every row of docs."""
    import pyarrow as pa

    rows = _keyed(docs)
    found = repeated_spans(rows, how)

    def cut(batches: Iterator) -> Iterator:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n, gone, count, kept = [], [], [], []
                for z, spans in zip(*(part.column(c).to_pylist() for c in ("z", "spans")), strict=True):
                    data = _expand(z)
                    pairs = np.frombuffer(spans, "u4").reshape(-1, 2).tolist() if spans else []
                    out, at = [], 0
                    for x, y in pairs:
                        out.append(data[at:x])
                        at = y
                    out.append(data[at:])
                    n.append(len(data))
                    kept.append(b"".join(out))
                    gone.append(len(data) - len(kept[-1]))
                    count.append(len(pairs))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    # rows that surely lose nothing do not move: a Bloom filter of bounded size tells them
    bits = bits_for(found.count(), UrlFilter())
    key = F.concat_ws("/", *_ROW)
    rows = may_be_listed(rows.withColumn("key", key), bloom_blocks(found.select(key.alias("key")), min(bits, FILTER_BITS)), min(bits, FILTER_BITS))
    sure = _compressed(rows.where("not maybe")).withColumn("spans", F.lit(None).cast("binary"))
    open_rows = _compressed(rows.where("maybe")).join(found, _ROW, "left")
    return sure.select("doc_id", "z", "spans").unionByName(open_rows.select("doc_id", "z", "spans")).mapInArrow(cut, schema)
