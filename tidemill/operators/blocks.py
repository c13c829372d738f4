"""The best elements of questions, block by block: no pair of a question and an element is shuffled.

Elements of a manual are dealt into blocks of about ``SIZE``, and each block meets all questions of the manual in one group. There a
question's terms are counted in a dense vector over the block, and only its best k leave. So what moves is the elements
once, the questions once a block, and k rows a question and block. A repeated element counts as often as it is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import storage

#: Elements in a block, and questions that meet it in one group; what a group holds follows from these two.
SIZE, ASKED = 1 << 16, 1 << 16
_LAST = 2**31 - 1
_KEY = ["manual_id", "block", "part"]


def dealt(elements: DataFrame, questions: DataFrame, together: str | Column = "element_id", one: str | Column = "*") -> tuple[DataFrame, DataFrame]:
    """Elements, of which those with the same value of a column stay together, and questions repeated for every block of their manual, with block and part. Manuals of very many questions (rows where one is not null) meet their blocks in several parts."""
    sizes = elements.groupBy("manual_id").agg(F.ceil(F.count("*") / SIZE).cast("int").alias("blocks"))
    asked = questions.groupBy("manual_id").agg(F.greatest(F.lit(1), F.ceil(F.count(one) / ASKED)).cast("int").alias("parts"))
    plan = F.broadcast(sizes.join(asked, "manual_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = elements.join(plan, "manual_id").withColumn("block", F.pmod(F.xxhash64(together), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
    q = questions.join(plan, "manual_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
    e, q = e.drop("blocks", "parts"), q.drop("blocks", "parts")
    return e.toDF(*e.columns), q.toDF(*q.columns)  # columns of their own, as both may come of one table


class Words:
    """The words of a block's rows: for each word the places of the rows that hold it, once for each time it stands there."""

    def __init__(self, vocabulary: pa.Array, code: np.ndarray, at: np.ndarray, n: int):
        """Of n places those (at) where each word (code) stands, by word."""
        self.n, self.at, self.words = n, at.astype(np.int32), vocabulary
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(vocabulary)))])
        self.codes = {w: i for i, w in enumerate(vocabulary.to_pylist())}
        self.seen: dict[str, np.ndarray] = {}
        self.pieces: tuple[np.ndarray, ...] | None = None

    @staticmethod
    def listed(words: pa.ChunkedArray, place: np.ndarray, n: int) -> Words:
        """Of a list of words a row, with the place of each row."""
        lists = pa.concat_arrays([pa.array([], words.type), *words.chunks])
        offsets = np.asarray(lists.offsets)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        at, code = np.repeat(place.astype(np.int32), np.diff(offsets)), np.asarray(flat.indices)
        by = np.lexsort((at, code))
        return Words(flat.dictionary, code[by], at[by], n)

    def _of(self, c: int) -> np.ndarray:
        return self.at[self.ends[c]:self.ends[c + 1]]

    def holding(self, word: str) -> np.ndarray:
        c = self.codes.get(word)
        return self.at[:0] if c is None else self._of(c)

    def _sorted(self) -> tuple[np.ndarray, ...]:
        """Where each word starts, the eight bytes from each place of all words on, and these in order with their places."""
        if self.pieces is None:
            sizes = np.asarray(pc.binary_length(self.words)).astype(np.int64)
            data = np.frombuffer(("\n".join([*self.words.to_pylist(), ""]) + "\0" * 8).encode(), np.uint8)
            size = len(data) - 8
            eight = np.zeros(size, np.uint64)
            for i in range(8):
                eight = eight << np.uint64(8) | data[i:i + size]
            by = np.argsort(eight)
            self.pieces = np.concatenate([[0], np.cumsum(sizes + 1)]), eight, eight[by], by
        return self.pieces

    def containing(self, part: str) -> np.ndarray:
        """Places of rows with a word that holds the part, each once. Its first eight bytes are looked up, further ones compared."""
        starts, eight, keys, by = self._sorted()
        whole = part.encode()
        number = lambda x, end: int.from_bytes(x.ljust(8, end), "big")
        first, last = (np.uint64(number(whole[:8], end)) for end in (b"\0", b"\xff"))
        at = by[np.searchsorted(keys, first, "left"):np.searchsorted(keys, last, "right")]
        for i in {*range(8, len(whole) - 7, 8), *([len(whole) - 8] if len(whole) > 8 else [])}:
            at = at[at + i < len(eight)]
            at = at[eight[at + i] == np.uint64(number(whole[i:i + 8], b"\0"))]
        codes = np.unique(np.searchsorted(starts, at, "right") - 1)
        start, size = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        return np.unique(self.at[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]) if len(codes) else self.at[:0]

    def once(self, term: str, find: Callable[[str], np.ndarray]) -> np.ndarray:
        """The places of a term; where it is frequent, a mask over all."""
        if term not in self.seen:
            at = find(term)
            if len(at) * 16 > self.n:
                mask = np.zeros(self.n, np.uint8)
                mask[at] = 1
                at = mask
            self.seen[term] = at
        return self.seen[term]


def _largest(count: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest counts above 0, smaller places first among equals."""
    out, left = [np.empty(0, np.int64)], k
    for c in range(int(count.max(initial=0)), 0, -1):
        out.append(np.flatnonzero(count == c)[:left])
        left -= len(out[-1])
        if left == 0:
            break
    return np.concatenate(out)


def _in_turn(ids: np.ndarray, values: dict[str, np.ndarray], order: Sequence[tuple[str, bool]]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in the order, their values, the place of each row and the places where an element begins. Repeated elements have the least of their values."""
    one, first, same = np.unique(ids, return_index=True, return_inverse=True)
    if len(one) < len(ids):
        for c, v in values.items():
            least = v[first].copy()
            np.minimum.at(least, same, v)
            values = values | {c: least[same]}
    keys = [ids if c == "element_id" else values[c] for c, _ in order]
    by = np.lexsort([v if up else -v for v, (_, up) in zip(keys, order)][::-1])
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    ids = ids[by]
    return by, {c: v[by] for c, v in values.items()}, place, np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))


def _first(count: np.ndarray, lift: np.ndarray, early: Sequence[int], k: int) -> np.ndarray:
    """Places of the first k counts above 0: by lift, then the largest."""
    found, left = [], k
    for level in sorted(set(early)):
        found.append(_largest(count if len(set(early)) == 1 else np.where(lift == level, count, 0), left))
        left -= len(found[-1])
        if left == 0:
            break
    return np.concatenate(found)


def _questions(q: pa.Table, *columns: str) -> Iterator[tuple]:
    for batch in q.select(columns).to_batches(max_chunksize=4096):
        yield from zip(*[c.to_pylist() for c in batch.columns])


def counted(elements: DataFrame, questions: DataFrame, order: Sequence[tuple[str, bool]], k: int, contains: bool = False, every: bool = False) -> DataFrame:
    """(query_id, element_id, n, early, columns of the order): of each block the k elements a question that have most of its terms; first by early, then n falling, then the order.

    elements: manual_id, element_id, words (each once), what (an index into early) and the columns of the order (name, rising); its
    last one is element_id. questions: query_id, manual_id, terms (65535 at most), n_terms, early (a place for each what, 0 the first).
    contains: words that hold a term count as it. every: only elements that have n_terms.
    """
    names = [c for c, _ in order if c != "element_id"]
    types = dict(elements.dtypes)
    schema = f"query_id long, element_id long, n int, early int, {', '.join(f'{c} {types[c]}' for c in names)}"
    arrow = pa.schema([("query_id", pa.int64()), ("element_id", pa.int64()), ("n", pa.int32()), ("early", pa.int32()), *[(c, {"int": pa.int32(), "bigint": pa.int64()}[types[c]]) for c in names]])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return arrow.empty_table()
        ids = np.asarray(e["element_id"])
        by, values, place, heads = _in_turn(ids, {c: np.asarray(e[c].fill_null(0)) for c in names}, order)
        ids, what = ids[by], np.asarray(e["what"])[by]
        words = Words.listed(e["words"], place, len(by))
        find, lifts, out = words.containing if contains else words.holding, {}, []
        for query, terms, wanted, early in _questions(q, "query_id", "terms", "n_terms", "early"):
            count = _matched(words, heads, terms, find)
            if every:
                count = np.where(count == wanted, count, 0)
            if tuple(early) not in lifts:
                lifts[tuple(early)] = np.asarray(early, np.int32)[what[heads]]
            lift = lifts[tuple(early)]
            at = _first(count, lift, early, k)
            out.append((np.full(len(at), query, np.int64), heads[at], count[at].astype(np.int32), lift[at]))
        query, at, n, lift = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip([query, ids[at], n, lift, *[values[c][at] for c in names]], arrow)], schema=arrow)

    e, q = dealt(elements, questions)
    return e.groupBy(*_KEY).cogroup(q.groupBy(*_KEY)).applyInArrow(best, schema)


def _matched(words: Words, heads: np.ndarray, terms: list[str], find: Callable[[str], np.ndarray] | None = None) -> np.ndarray:
    """How many terms each element of a block has."""
    count = np.zeros(words.n, np.uint16)
    for t in terms:
        at = words.once(t, find or words.holding)
        if at.dtype == np.uint8:
            count += at
        else:
            count[at] += 1
    return np.add.reduceat(count, heads, dtype=np.int64) if len(heads) < len(count) else count


def _in_order(e: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Words]:
    """Rows by element, the first row of each element, each row's element as a place among them, and the words of rows."""
    e = e.take(pa.array(np.argsort(np.asarray(e["element_id"]), kind="stable")))
    ids = np.asarray(e["element_id"])
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    words = Words.listed(pc.split_pattern(e["words"], " "), np.arange(len(ids)), len(ids))
    return e.drop_columns("words"), heads, np.cumsum(np.bincount(heads, minlength=len(ids))) - 1, words


def spread(elements: DataFrame, questions: DataFrame, per_code: int, per_code_lists: int, k: int) -> DataFrame:
    """(query_id, element_id, doc_code, type, n, late): of each block the k elements a question that come first by late, n falling, element_id.

    late is 0 for the first ``per_code`` matched elements of a code, and for its lists up to ``per_code_lists``, else 1. All elements of a code are in one block.
    elements: manual_id, element_id, doc_code, type, words (each once, parted by blanks), copies (rows that each row stands for). questions: query_id, manual_id, terms.
    """
    arrow = pa.schema([("query_id", pa.int64()), ("element_id", pa.int64()), ("doc_code", pa.string()), ("type", pa.string()), ("n", pa.int32()), ("late", pa.int32())])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return arrow.empty_table()
        e, heads, head, words = _in_order(e)
        code = np.asarray(pc.fill_null(e["doc_code"].combine_chunks().dictionary_encode().indices, -1))
        lists, copies = np.asarray(pc.fill_null(pc.equal(e["type"], "list"), False)), np.asarray(e["copies"])
        first, rows = np.concatenate([heads, [len(code)]]), len(heads) < len(code)

        def judged(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows in order, each as often as it stands for rows, and whether they are late; that follows from those before them."""
            at = np.repeat(at, copies[at])
            by = np.argsort(code[at], kind="stable")  # by code, in order within it
            c, place = code[at][by], np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), place, 0))
            rn = place - start + 1
            extra = lists[at][by] & (rn > per_code)
            so_far = np.cumsum(extra)
            so_far = so_far - (so_far[start] - extra[start])
            late = np.empty(len(at), bool)
            late[by] = ~((c < 0) | (rn <= per_code) | (extra & (so_far + per_code - 1 < per_code_lists)))
            return at, late

        asked, taken, late_ones, counts = [], [np.empty(0, np.int32)], [np.empty(0, bool)], [np.empty(0, np.int32)]
        for query, terms in _questions(q, "query_id", "terms"):
            count, most = _matched(words, heads, terms), 8 * k
            while True:  # the first elements mostly have k rows that are not late; if not, more of them are looked at
                one = _largest(count, most)
                size = first[one + 1] - first[one]
                at = np.repeat(first[one] - np.cumsum(size) + size, size) + np.arange(size.sum()) if rows else heads[one]
                at, late = judged(at)
                if len(one) < most or np.count_nonzero(~late) >= k:
                    break
                most *= 8
            here = np.concatenate([np.flatnonzero(~late)[:k], np.flatnonzero(late)[:k]])[:k]
            asked.append((query, len(here)))
            taken.append(at[here].astype(np.int32))
            late_ones.append(late[here])
            counts.append(count[head[at[here]]].astype(np.int32))
        query, n = (np.array(x, np.int64) for x in zip(*asked))
        at = np.concatenate(taken)
        e = e.select(["element_id", "doc_code", "type"]).take(pa.array(at))
        cells = [pa.array(np.repeat(query, n)), e["element_id"], e["doc_code"].cast(pa.string()), e["type"].cast(pa.string()), pa.array(np.concatenate(counts)), pa.array(np.concatenate(late_ones).astype(np.int32))]
        return pa.Table.from_arrays(cells, schema=arrow)

    e, q = dealt(elements, questions, "doc_code")
    return e.groupBy(*_KEY).cogroup(q.groupBy(*_KEY)).applyInArrow(best, "query_id long, element_id long, doc_code string, type string, n int, late int")


def places(elements: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, element_id, n, ahead): of each block how many matched elements come before a question's own ones, by n falling, then element_id. The sum over blocks is their place.

    elements: as in spread. questions: query_id, manual_id, terms, ids and ns (the elements whose places are asked, and how many terms each has).
    """
    arrow = pa.schema([("query_id", pa.int64()), ("element_id", pa.int64()), ("n", pa.int32()), ("ahead", pa.int64())])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return arrow.empty_table()
        e, heads, head, words = _in_order(e)
        ids = np.asarray(e["element_id"])[heads]
        weight = np.bincount(head, weights=np.asarray(e["copies"]), minlength=len(heads)).astype(np.int64)
        out = [(np.empty(0, np.int64),) * 4]
        for query, terms, wanted, ns in _questions(q, "query_id", "terms", "ids", "ns"):
            count, wanted, ns = _matched(words, heads, terms), np.asarray(wanted, np.int64), np.asarray(ns)
            ahead = np.empty(len(wanted), np.int64)
            for n in np.unique(ns):
                level = np.flatnonzero(count == n)
                before = np.concatenate([[0], np.cumsum(weight[level])])
                mine = ns == n
                ahead[mine] = weight[count > n].sum() + before[np.searchsorted(ids[level], wanted[mine])]
            out.append((np.full(len(wanted), query, np.int64), wanted, ns.astype(np.int64), ahead))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    e, q = dealt(elements, questions, "doc_code")
    return e.groupBy(*_KEY).cogroup(q.groupBy(*_KEY)).applyInArrow(best, "query_id long, element_id long, n int, ahead long")


def weighed(elements: DataFrame, questions: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, element_id, score): of each block the k elements a question with the highest BM25, rounded to six digits.

    elements: manual_id, element_id, words (as often as they stand there). questions: query_id, manual_id, terms, idfs (one a term), mean
    (words of an element of the manual).
    """
    arrow = pa.schema([("query_id", pa.int64()), ("element_id", pa.int64()), ("score", pa.float64())])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        if not e.num_rows or not q.num_rows:
            return arrow.empty_table()
        lens = np.asarray(pc.list_value_length(e["words"])).astype(np.int64)
        # rows of one element and length are one
        pairs, place = np.unique(np.stack([np.asarray(e["element_id"]), lens]), axis=1, return_inverse=True)
        place = place.reshape(-1)
        ids, size = pairs
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        words, parts, out = Words.listed(e["words"], place, len(ids)), {}, []
        for query, terms, idfs, mean in _questions(q, "query_id", "terms", "idfs", "mean"):
            score = np.zeros(len(ids))
            for t, idf in zip(terms, idfs):
                if t not in parts:
                    at, tf = np.unique(words.holding(t), return_counts=True)
                    parts[t] = at, tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[at] / mean))
                at, part = parts[t]
                score[at] += idf * part
            if len(heads) < len(score):
                score = np.add.reduceat(score, heads)
            at = np.flatnonzero(score)
            if len(at) > k:  # what rounds to the k-th score may have to stay
                low = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] >= low - 1e-5]
            rounded = np.round(score[at], 6)
            by = np.lexsort((at, -rounded))[:k]
            out.append((np.full(len(by), query, np.int64), ids[heads[at[by]]], rounded[by]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    e, q = dealt(elements, questions)
    return e.groupBy(*_KEY).cogroup(q.groupBy(*_KEY)).applyInArrow(best, "query_id long, element_id long, score double")


class Runs:
    """The words of texts in their order."""

    def __init__(self, texts: list[str]):
        data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        inside = np.zeros(256, bool)
        inside[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
        mask = inside[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[mask])]).dictionary_encode()
        self.words, self.code = words.dictionary.cast(pa.large_string()), np.asarray(words.indices).astype(np.int64)
        self.text, self.size = np.searchsorted(np.flatnonzero(data == 10), start), end - start

    def counted(self, place: np.ndarray, shortest: int) -> Words:
        """The words of at least so many letters, once a text, by the texts' places; texts at -1 have none."""
        use = np.flatnonzero((self.size >= shortest) & (place[self.text] >= 0))
        n = int(place.max(initial=-1)) + 1
        both = np.sort(self.code[use] * max(n, 1) + place[self.text[use]])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return Words(self.words, both // max(n, 1), both % max(n, 1), n)


#: How many letters of the words beside a gap tell where a phrase may be; bits of the filter of what phrases have there, at most, and how many of them each sets.
ENDS, FILTER_BITS, MARKS = range(1, 9), 28, 4
#: Rows of a task that are put together, to let go the first of each alone.
GATHERED = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Gaps:
    """The places of lower-case ASCII texts (bytes, a line each) where one byte parts two words."""

    def __init__(self, data: np.ndarray):
        inside = np.zeros(256, bool)
        inside[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside[data].view(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        at = np.flatnonzero((start[1:] - end[:-1] == 1) & (data[np.minimum(end[:-1], len(data) - 1)] != 10))
        self.data, self.start, self.end = data, start[at], end[at]
        self.before, self.after = end[at] - start[at], end[at + 1] - start[at + 1]

    def _letters(self, first: np.ndarray, step: int) -> dict[int, np.ndarray]:
        """For each of ENDS so many letters from the first on, as a number; what lies beyond a word is not used."""
        out, x = {}, np.zeros(len(first), np.uint64)
        for n in ENDS:
            out[n] = x = x << np.uint64(8) | self.data[np.clip(first + step * (n - 1), 0, len(self.data) - 1)]
        return out

    def hashes(self, of: np.ndarray, kinds: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """kind, gaps whose words are as long, and the hashes of these letters, of what parts them and of a number of the gap's manual.

        A kind is 16 times the letters before the gap, and the letters after it; or 0, where a whole word has to follow.
        """
        ends, begins = self._letters(self.end - 1, -1), self._letters(self.end + 1, 1)
        gap = self.data[np.minimum(self.end, len(self.data) - 1)].astype(np.uint64) << np.uint64(56)
        whole = np.choose(np.minimum(self.after, ENDS[-1]) - 1, [begins[n] for n in ENDS]) + (self.after.astype(np.uint64) << np.uint64(48)) if len(self.end) else self.end
        for kind in kinds:
            a, b = divmod(kind, 16)
            at = np.flatnonzero((self.before >= a) & (self.after >= b))
            h = (ends[a][at] * _MIX[0]) ^ (((begins[b] if b else whole)[at] + np.uint64(kind)) * _MIX[1] + gap[at]) ^ of[at]
            h = (h ^ (h >> np.uint64(29))) * _MIX[2]
            yield kind, at, h ^ (h >> np.uint64(32))


def _marks(h: np.ndarray, bits: int, n: int) -> np.ndarray:
    return (h * _MIX[n]) >> np.uint64(64 - bits)


def _joined(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lines of bytes, and where each begins."""
    data = np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode(), np.uint8)
    size = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
    return data, np.cumsum(size) - size


def _signed(terms: DataFrame) -> DataFrame:
    """manual_id, low, kind, sig: what the first gap of each term has beside it, and how many letters of the first word."""
    schema = "manual_id string, low string, kind int, sig long, ahead int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = _joined(batch["low"])
            gaps = Gaps(data)
            first = np.searchsorted(gaps.start, begin)
            a, b = (np.minimum(c[first], ENDS[-1]) for c in (gaps.before, gaps.after))
            words = np.bincount(np.searchsorted(begin, gaps.start, "right") - 1, minlength=len(begin))
            kind, sig = a * 16 + np.where(words == 1, b, 0), np.zeros(len(first), np.uint64)
            of = np.zeros(len(gaps.start), np.uint64)
            of[first] = np.asarray(batch["of"]).view(np.uint64)
            for k, at, h in gaps.hashes(of, sorted(set(kind.tolist()))):
                mine = np.flatnonzero(kind == k)
                sig[mine] = h[np.searchsorted(at, first[mine])]
            yield pa.RecordBatch.from_arrays([batch["manual_id"], batch["low"], pa.array(kind, pa.int32()), pa.array(sig.view(np.int64)), pa.array(gaps.before[first].astype(np.int32))], names=["manual_id", "low", "kind", "sig", "ahead"])

    return terms.select("manual_id", "low", F.xxhash64("manual_id").alias("of")).mapInArrow(run, schema)


def _filter_of(sigs: DataFrame) -> tuple[np.ndarray, int]:
    """Bytes of a filter of column sig with 2 ** bits bits, 32 to 64 for each up to FILTER_BITS; that is all that comes to the driver."""
    bits = min(FILTER_BITS, max(16, (32 * sigs.count()).bit_length()))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        held = np.zeros(1 << 16, bool)
        held[np.asarray(rows["at"])] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch["sig"]).view(np.uint64)
            at = np.unique(np.concatenate([_marks(h, bits, n) for n in range(MARKS)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32))], names=["chunk", "at"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for chunk, held in sigs.select("sig").mapInArrow(spots, "chunk int, at int").groupBy("chunk").applyInArrow(run, "chunk int, bits binary").collect():
        out[chunk << 13:(chunk + 1) << 13] = np.frombuffer(held, np.uint8)
    return out, bits


@dataclass(frozen=True)
class Phrases:
    """Terms to be looked for: their letters at their first gaps; for each number of these the most characters that terms have up to there and behind it; and the filter, sent to all executors."""

    asked: DataFrame
    kinds: dict[int, tuple[int, int]]
    sent: Broadcast

    @staticmethod
    def of(terms: DataFrame) -> Phrases:
        """terms: manual_id, low (each once): words of a-z and 0-9, two at least, parted by single ASCII characters."""
        asked = storage.kept(_signed(terms), "phrases")
        most = asked.groupBy("kind").agg(F.max("ahead").alias("ahead"), F.max(F.char_length("low") - F.col("ahead")).alias("behind"))
        kinds = {r["kind"]: (r["ahead"], r["behind"]) for r in most.collect()}  # of 72 at most
        held = _filter_of(asked.select("sig").distinct())  # 2 ** FILTER_BITS bits at most
        return Phrases(asked, kinds, terms.sparkSession.sparkContext.broadcast(held))


def with_phrases(texts: DataFrame, terms: DataFrame | Phrases, k: int, order: Sequence[str] = ("size",)) -> DataFrame:
    """(manual_id, low, element_id, columns of the order): of each term the first k elements (by default the shortest) that hold it as a substring; those without a value come last.

    texts: manual_id, element_id, low (lower case), columns of the order. terms: as in Phrases.of. A repeated row counts as often as it is there.
    Texts stay where they are: of them moves what stands at gaps that may be the first gap of a term, by a filter of the letters that terms of the manual
    have there. It is compared with the terms of these letters then.
    """
    types, names = dict(texts.dtypes), list(order)
    terms = terms if isinstance(terms, Phrases) else Phrases.of(terms)
    kinds, sent = terms.kinds, terms.sent
    ints = {"int": pa.int32(), "bigint": pa.int64()}
    schema = f"manual_id string, sig long, _ahead int, _said string, element_id long, _row long{''.join(f', {c} {types[c]}' for c in names)}"
    arrow = pa.schema([("manual_id", pa.string()), ("sig", pa.int64()), ("_ahead", pa.int32()), ("_said", pa.string()), ("element_id", pa.int64()), ("_row", pa.int64()), *[(c, ints[types[c]]) for c in names]])

    def best(some: list[pa.RecordBatch]) -> pa.Table:
        """Of what stands at a gap in the same way, as it holds the same terms, the rows that come first, k of them."""
        rows = pa.Table.from_batches(some, arrow).combine_chunks()
        said = np.asarray(rows["_said"].combine_chunks().dictionary_encode().indices) if rows.num_rows else np.empty(0, np.int64)
        order = [np.asarray(rows[c].fill_null(2 ** (rows[c].type.bit_width - 1) - 1)) for c in (*names, "element_id", "_row")]
        sig, row = np.asarray(rows["sig"]), order[-1]
        by = np.lexsort((*order[::-1], said, sig))
        sig, said, row = sig[by], said[by], row[by]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (said[1:] != said[:-1])])[:len(by)]
        other = new | np.concatenate([[True], row[1:] != row[:-1]])[:len(by)]
        nth = np.cumsum(other)
        nth = nth - np.maximum.accumulate(np.where(new, nth, 0))
        return rows.take(pa.array(np.sort(by[other & (nth < k)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in met(batches):
            some, size = [*some, batch], size + batch.num_rows
            if size > GATHERED:
                rows = best(some)
                some, size = rows.to_batches(), rows.num_rows
                if size > GATHERED // 2:
                    yield from some
                    some, size = [], 0
        yield from best(some).to_batches()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = sent.value
        one, done = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            data, begin = _joined(batch["low"])
            gaps = Gaps(data)
            text = np.searchsorted(begin, gaps.start, "right") - 1
            found = [(np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)]
            for kind, at, h in gaps.hashes(np.asarray(batch["of"]).view(np.uint64)[text], kinds):
                for n in range(MARKS):
                    spot = _marks(h, bits, n)
                    ok = (held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, h = at[ok], h[ok]
                found.append((at, h, *[np.full(len(at), n) for n in kinds[kind]]))
            at, h, ahead, behind = (np.concatenate(c) for c in zip(*found))
            # what stands there: as many bytes as a term has, but not beyond the first word, the end of the line or of ASCII
            stop, ahead = np.flatnonzero((data == 10) | (data > 127)), np.minimum(ahead, gaps.before[at])
            start, last = gaps.end[at] - ahead, np.minimum(gaps.end[at] + behind, stop[np.searchsorted(stop, gaps.end[at])])
            said = np.concatenate([[0], np.cumsum(last - start)])
            flat = data[np.repeat(start - said[:-1], last - start) + np.arange(said[-1])]
            said = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(said), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.string())
            rows = pa.array(text[at])
            taken = batch.select(["manual_id", "element_id", *names]).take(rows)
            cells = {"manual_id": taken["manual_id"], "sig": pa.array(h.view(np.int64)), "_ahead": pa.array(ahead.astype(np.int32)), "_said": said, "element_id": taken["element_id"], "_row": pa.array(one + done + text[at])}
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([(cells.get(f.name) if f.name in cells else taken[f.name]).cast(f.type) for f in arrow], schema=arrow)

    low = F.regexp_replace("low", "\n", "\r").alias("low")
    found = texts.where("low is not null").select("manual_id", F.col("element_id").cast("long").alias("element_id"), low, F.xxhash64("manual_id").alias("of"), *names).mapInArrow(run, schema)
    rows = found.join(terms.asked.select("manual_id", "sig", "low", F.col("ahead").alias("_own")), ["manual_id", "sig"])
    rows = rows.where("_own <= _ahead and substring(_said, _ahead - _own + 1, length(low)) = low")
    # a row that holds a term several times is one
    place = F.dense_rank().over(Window.partitionBy("manual_id", "low").orderBy(*[F.asc_nulls_last(c) for c in names], "element_id", "_row"))
    rows = rows.select("manual_id", "low", "element_id", "_row", *names).withColumn("_rn", place).where(F.col("_rn") <= k).drop("_rn")
    return rows.distinct().drop("_row")


def probed(elements: DataFrame, questions: DataFrame, k: int, k_all: int, k_overlap: int) -> DataFrame:
    """(probe, query_id, element_id, n, early, size, page): what several probes take of each block, in one meeting of elements and questions, so that texts move once.

    Probe 0: the k elements a question that come first by early, terms they have (n, falling), size (here negative, so that it rises), page and element_id; 1: k_all of those that have all;
    4: k_overlap of 24 to 2500 characters by terms of five letters that one of their words holds, size and element_id.
    elements: manual_id, section_id, element_id, page, size, low (text, lower case) and, as rows without an element_id, what (an index into early; the last
    where there is none) their sections are. questions: manual_id, query_id, terms (65535 at most), n_terms and early (as in counted).
    """
    schema = "probe int, query_id long, element_id long, n int, early int, size int, page long"
    arrow = pa.schema([("probe", pa.int32()), ("query_id", pa.int64()), ("element_id", pa.int64()), ("n", pa.int32()), ("early", pa.int32()), ("size", pa.int32()), ("page", pa.int64())])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        about, rows = e.filter(pc.is_null(e["element_id"])), e.filter(pc.is_valid(e["element_id"]))
        if not rows.num_rows or not q.num_rows:
            return arrow.empty_table()
        rows = rows.select(["section_id", "element_id", "page", "size", "low"]).append_column("nth", pa.array(np.arange(rows.num_rows))).join(about.select(["section_id", "what"]), "section_id", join_type="left outer", use_threads=False)
        rows = rows.take(pa.array(np.lexsort((np.asarray(rows["element_id"]), np.asarray(rows["size"].fill_null(_LAST))))))
        ids, size, page = (np.asarray(rows[c].fill_null(0)) for c in ("element_id", "size", "page"))
        low, what = rows["low"].fill_null(""), np.asarray(rows["what"].fill_null(-1))
        runs = Runs(low.to_pylist())
        by, own, place, heads = _in_turn(ids, {"size": size, "page": page}, [("size", False), ("page", True), ("element_id", True)])
        words, kinds = runs.counted(place, 3), what[by][heads]
        single = np.unique(np.asarray(rows["nth"]), return_index=True)[1]  # a section that is there twice gives its elements twice, but not here
        middle = single[(size[single] >= 24) & (size[single] <= 2500)]
        by5, own5, place5, heads5 = _in_turn(ids[middle], {"size": size[middle]}, [("size", True), ("element_id", True)])
        spot = np.full(len(ids), -1)
        spot[middle] = place5
        words5, out, lifts = runs.counted(spot, 5), [], {}
        # of each element once, not once a question
        heads5 = heads5[:len(middle)]
        ids5, size5 = ids[middle][by5][heads5], own5["size"][heads5]
        ids, size, page = ids[by][heads], -own["size"][heads], own["page"][heads]

        def add(probe: int, query: int, *columns: np.ndarray) -> None:
            out.append((np.full(len(columns[0]), probe), np.full(len(columns[0]), query), *columns))

        for query, terms, wanted, early in _questions(q, "query_id", "terms", "n_terms", "early"):
            count = _matched(words, heads, terms)
            if tuple(early) not in lifts:
                lifts[tuple(early)] = np.asarray(early, np.int32)[kinds]
            lift = lifts[tuple(early)]
            for probe, n, most in ((0, count, k), (1, np.where(count == wanted, count, 0) if count.max(initial=0) >= wanted else count[:0], k_all)):
                at = _first(n, lift[:len(n)], early, most)
                add(probe, query, ids[at], n[at], lift[at], size[at], page[at])
            n = _matched(words5, heads5, [t for t in terms if len(t) >= 5], words5.containing)
            at = _largest(n, k_overlap)
            none = np.zeros(len(at), np.int64)
            add(4, query, ids5[at], n[at], none, size5[at], none)
        if not out:
            return arrow.empty_table()
        cells = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([pa.array(c.astype(t.type.to_pandas_dtype())) for c, t in zip(cells, arrow)], schema=arrow)

    e, q = dealt(elements, questions, F.coalesce("section_id", "element_id"))
    return e.groupBy(*_KEY).cogroup(q.groupBy(*_KEY)).applyInArrow(best, schema)
