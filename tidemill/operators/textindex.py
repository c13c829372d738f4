"""A stored positional inverted index, and probes that read it instead of the texts.

Texts are split into words once, when the index is built or a batch of elements is added. A posting row is a
word in a block of up to ``block`` elements of one manual: the elements in rising order of place, how often and
where each has the word, and what bounds its share of a score (most occurrences, fewest words). Rows lie in sorted buckets of
(manual_id, word, block), so one hot word of one hot manual is spread over its blocks.

Probes first read the narrow columns of the rows of asked words. A top-k then works by blocks: the blocks with the
highest bounds are scored, the k-th best score so far becomes the question's threshold, and blocks whose bound stays below
it are never opened. The result is that of scoring everything.

A substring of letters and digits lies inside one word: such terms are looked up among the distinct words. A term of
several words is met at consecutive positions, its rarest word first: the first word by its end, the last by its
beginning, those between as a whole, with the very separators between them.

Nulls and edges: elements with a null text, manual or id are not indexed; a text without ASCII letters or digits has no words but
counts as an element; repeated elements count once each; an element that is added again replaces the older one, which
statistics still count until the index is built anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..plans.storage import bucketed, kept
from .blocks import ASKED, SIZE

KEYS = ["manual_id", "word", "block"]
_SCHEMA = "manual_id string, word string, block long, n int, most int, least int, ids array<long>, sizes array<int>, pages array<long>, lens array<int>, times array<int>, spots array<long>, at array<smallint>"
#: The row of a block that stands for all its elements.
ALL = ""


@dataclass(frozen=True)
class IndexHow:
    block: int = 512
    #: Characters by which parts of terms meet the ends and beginnings of words, before the whole part is looked for.
    piece: int = 3
    #: Blocks of the highest bounds that are scored before the others are judged.
    first: int = 3
    #: Rows of words hold the places of elements in the block and how often they have the word, no more: enough for ``best_of_batch``.
    lean: bool = False


#: A lean index has larger blocks, as its probes read all of them.
LEAN = IndexHow(block=8192, lean=True)
#: Elements that a task splits at once for a lean index.
GATHERED, GATHERED_BYTES = 100_000, 16 << 20


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    vocabulary: DataFrame
    statistics: DataFrame
    how: IndexHow
    #: Elements of earlier segments that a later one replaced: element_id, block.
    stale: DataFrame | None = None

    @property
    def heads(self) -> DataFrame:
        return self.postings.select(*KEYS, "n", "most", "least")


def _posting_rows(how: IndexHow, segment: int):
    """Arrow batches of elements to posting rows; all work is on arrays of a whole batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        code = np.arange(256)
        part_of_word = ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A))
        block = (segment << 52) | (TaskContext.get().partitionId() << 28)

        def lists(flat, ends):
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat)

        def gathered(batches):
            """Batches of a lean index are joined, so that a block has many elements of its manual."""
            some, rows, size = [], 0, 0
            for batch in batches:
                some, rows, size = [*some, batch], rows + batch.num_rows, size + batch.nbytes
                if rows >= GATHERED or size >= GATHERED_BYTES:
                    yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                    some, rows, size = [], 0, 0
            if some:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()

        for batch in gathered(batches) if how.lean else batches:
            manuals = pc.dictionary_encode(batch.column("manual_id"))
            order = np.argsort(manuals.indices.to_numpy(), kind="stable")
            batch, manual = batch.take(pa.array(order)), manuals.indices.to_numpy()[order]
            # a new block with each manual, and after every how.block elements of it
            first = np.flatnonzero(np.r_[True, manual[1:] != manual[:-1]])
            nth = np.arange(len(manual)) - first[np.searchsorted(first, np.arange(len(manual)), "right") - 1]
            new = nth % how.block == 0
            block_of, n_blocks = np.cumsum(new) - 1, int(new.sum())

            low = batch.column("low").cast(pa.large_string())
            offsets = np.frombuffer(low.buffers()[1], "i8")[low.offset : low.offset + len(low) + 1]
            data = np.frombuffer(low.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
            begins, inside = offsets - offsets[0], part_of_word[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[begins] = True
            before, after = np.r_[False, inside], np.r_[inside, False]
            starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
            row = np.searchsorted(begins[1:], starts, "right")
            lens = np.bincount(row, minlength=len(low))
            place = np.arange(len(row)) - (np.cumsum(lens) - lens)[row]
            # how a word goes on to the next: 1 by one blank, 2 by one point, 0 in another way or not at all
            one = np.zeros(len(row), "i8")
            if len(row) > 1:
                near = (row[1:] == row[:-1]) & (starts[1:] - ends[:-1] == 1)
                mark = data[np.minimum(ends[:-1], len(data) - 1)]
                one[:-1] = np.where(near & (mark == 0x20), 1, np.where(near & (mark == 0x2E), 2, 0))
            words = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype("i8")), pa.py_buffer(np.ascontiguousarray(data[inside])))
            words = pc.dictionary_encode(words)
            names, which = words.dictionary, words.indices.to_numpy().astype("i8")

            key = block_of[row] * max(1, len(names)) + which
            sort = np.argsort(key, kind="stable")
            key, row_s, place_s, one_s = key[sort], row[sort], place[sort], one[sort]
            group = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            entry = group | np.r_[True, row_s[1:] != row_s[:-1]] if len(key) else group
            g_first, e_first = np.flatnonzero(group), np.flatnonzero(entry)
            entry_of, group_of = np.cumsum(entry) - 1, np.cumsum(group) - 1
            times = np.diff(np.r_[e_first, len(key)])
            e_group, e_row = group_of[e_first], row_s[e_first]
            e_of_group = np.searchsorted(e_group, np.arange(len(g_first)))
            e_ends, s_ends = (np.r_[at[1:], n].astype("i8") if len(at) else np.zeros(0, "i8") for at, n in ((e_of_group, len(e_first)), (g_first, len(key))))
            spots = ((entry_of - e_of_group[group_of]) << 32) | (place_s << 2) | one_s if len(key) else np.zeros(0, "i8")

            ids, sizes, pages = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("element_id", "size", "page"))
            every = np.r_[np.flatnonzero(new)[1:], len(manual)]
            reduced = lambda f, x, at: f.reduceat(x, at) if len(at) else np.zeros(0, "i8")
            # a row for each block that has all its elements, then one for each word in it
            rows_of = np.r_[np.arange(len(manual)), e_row].astype("i8")
            entries_end = np.r_[every, e_ends + len(manual)]
            n_all, blocks = len(every), np.r_[np.arange(n_blocks), key[g_first] // max(1, len(names))].astype("i8")
            head = np.flatnonzero(new)[blocks]
            at = lists(pa.array((nth[e_row] % how.block).astype("i2"), pa.int16()), np.r_[np.zeros(n_all, "i8"), e_ends])
            if how.lean:
                rows_of, of_elements = rows_of[: len(manual)], np.r_[every, np.full(len(e_ends), len(manual))]
            else:
                of_elements = entries_end
            names = pa.concat_arrays([pa.array([ALL] * n_all, pa.string()), names.take(pa.array(key[g_first] % max(1, len(names)))).cast(pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("manual_id").take(pa.array(head)), names, pa.array(block + blocks), pa.array(np.diff(np.r_[0, entries_end]), pa.int32()),
                    pa.array(np.r_[reduced(np.add, lens, np.flatnonzero(new)), reduced(np.maximum, times, e_of_group)], pa.int32()),
                    pa.array(np.r_[reduced(np.minimum, lens, np.flatnonzero(new)), reduced(np.minimum, lens[e_row], e_of_group)], pa.int32()),
                    lists(pa.array(ids[rows_of], pa.int64()), of_elements), lists(pa.array(sizes[rows_of], pa.int32()), of_elements), lists(pa.array(pages[rows_of].astype("i8")), of_elements),
                    lists(pa.array(lens[rows_of], pa.int32()), of_elements), lists(pa.array(np.r_[np.zeros(len(manual), "i8"), times], pa.int32()), entries_end),
                    pa.nulls(len(blocks), pa.list_(pa.int64())) if how.lean else lists(pa.array(spots, pa.int64()), np.r_[np.zeros(n_all, "i8"), s_ends]), at,
                ],
                names=["manual_id", "word", "block", "n", "most", "least", "ids", "sizes", "pages", "lens", "times", "spots", "at"],
            )
            block += n_blocks

    return run


def _postings(elements: DataFrame, how: IndexHow, segment: int) -> DataFrame:
    page = F.col("page").cast("long") if "page" in elements.columns else F.lit(0).cast("long")
    rows = elements.where("manual_id is not null and element_id is not null and text is not null")
    rows = rows.select("manual_id", F.col("element_id").cast("long").alias("element_id"), F.coalesce(page, F.lit(0)).alias("page"), F.char_length("text").alias("size"), F.lower("text").alias("low"))
    return rows.mapInArrow(_posting_rows(how, segment), _SCHEMA)


def _index(postings: DataFrame, how: IndexHow, stale: DataFrame | None = None) -> TextIndex:
    words = kept(postings.where(F.col("word") != ALL).select("word").distinct().select("word", stem(F.col("word")).alias("stem")), "vocabulary")
    statistics = postings.where(F.col("word") == ALL).groupBy("manual_id").agg(F.sum("n").alias("elements"), (F.sum("most") / F.sum("n")).alias("mean"))
    return TextIndex(postings, words, kept(statistics, "statistics"), how, stale)


def build(elements: DataFrame, how: IndexHow = IndexHow()) -> TextIndex:
    """elements: manual_id, element_id, text and, where there are any, pages."""
    spark = elements.sparkSession
    if how.lean:
        return _index(kept(_postings(elements, how, 0), "postings"), how)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _index(bucketed(_postings(elements, how, 0), "postings", KEYS, buckets), how)


def _elements_of(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("word") == ALL).select(F.explode("ids").alias("element_id"), "block")


def added(index: TextIndex, elements: DataFrame) -> TextIndex:
    """The index with a batch of new or changed elements as a segment of its own; an element whose text became null has no words any more."""
    segment = (index.postings.agg(F.max("block")).first()[0] or 0) // (1 << 52) + 1
    texts = elements.withColumn("text", F.coalesce("text", F.lit("")))
    buckets = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = bucketed(_postings(texts, index.how, segment), "postings", KEYS, buckets)
    replaced = _elements_of(index.postings).join(_elements_of(new).select("element_id").distinct(), "element_id")
    stale = replaced if index.stale is None else index.stale.unionByName(replaced)
    return _index(index.postings.unionByName(new), index.how, kept(stale.distinct(), "stale"))


def words_with_stems(index: TextIndex, terms: DataFrame) -> DataFrame:
    """terms: query_id, manual_id, term. Result: query_id, manual_id, feature (the stem of the term) and each word that has it."""
    # a stem is made once a term, not once a question
    stems = terms.select("term").distinct().withColumn("feature", stem(F.col("term")))
    feature = terms.select("query_id", "manual_id", "term").join(stems, "term").select("query_id", "manual_id", "feature").distinct()
    return feature.join(index.vocabulary.withColumnRenamed("stem", "feature"), "feature")


def words_containing(index: TextIndex, terms: DataFrame, shortest: int) -> DataFrame:
    """terms of letters and digits, ``shortest`` of them at least, in a column term; each distinct one with the words that contain it."""
    asked = terms.select("term").distinct().withColumn("piece", F.substring("term", 1, shortest))
    word = F.col("word")
    pieces = F.transform(F.sequence(F.lit(1), F.char_length(word) - shortest + 1), lambda i: F.substr(word, i, F.lit(shortest)))
    pieces = index.vocabulary.where(F.char_length(word) >= shortest).select("word", F.explode(F.array_distinct(pieces)).alias("piece"))
    return pieces.join(asked, "piece").where(word.contains(F.col("term"))).select("term", "word")


@dataclass(frozen=True)
class Scoring:
    """What a matched feature adds to an element, and what it can add at most in a block; both are columns over a feature's rows."""

    part: Column
    bound: Column
    eligible: Column
    order: Sequence[Column]


def counting(order: Sequence[Column], eligible: Column | None = None) -> Scoring:
    """One for each feature."""
    return Scoring(F.lit(1.0), F.lit(1.0), F.lit(True) if eligible is None else eligible, order)


def okapi(k1: float = 1.2, b: float = 0.75) -> Scoring:
    """Okapi BM25 as published; its share of a score rises with occurrences and falls with the words of an element."""
    part = lambda times, words: F.col("idf") * times * (k1 + 1) / (times + k1 * (1 - b + b * words / F.col("mean")))
    return Scoring(part(F.col("times"), F.col("len")), part(F.col("most"), F.col("least")), F.lit(True), [F.desc("score"), F.asc("element_id")])


def _features(index: TextIndex, asked: DataFrame, weighed: bool) -> DataFrame:
    """manual_id, feature, block: what bounds the feature there; with its idf and its manual's mean length where wanted. No question is in it."""
    words = asked.select("manual_id", "word", "feature").distinct()
    rows = index.heads.join(words, ["manual_id", "word"]).groupBy("manual_id", "feature", "block").agg(F.sum("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n"))
    if not weighed:
        return rows
    rows = kept(rows, "heads")
    df = rows.groupBy("manual_id", "feature").agg(F.sum("n").alias("df")).join(index.statistics, "manual_id")
    idf = F.log(1 + (F.col("elements") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.join(df.select("manual_id", "feature", "mean", idf.alias("idf")), ["manual_id", "feature"])


def _scored(index: TextIndex, asked: DataFrame, features: DataFrame, blocks: DataFrame, scoring: Scoring, extra: list[str]) -> DataFrame:
    """The scores of all elements in the blocks (query_id, block) of questions."""
    wanted = kept(blocks.join(asked.select("query_id", "manual_id", "feature").distinct(), "query_id").join(features.select("manual_id", "feature", "block", *extra), ["manual_id", "feature", "block"]), "wanted")
    needed = wanted.select("manual_id", "feature", "block").distinct().join(asked.select("manual_id", "word", "feature").distinct(), ["manual_id", "feature"])
    opened = index.postings.select(*KEYS, "ids", "sizes", "pages", "lens", "times").join(needed, KEYS)
    rows = opened.select("feature", "block", F.inline(F.arrays_zip("ids", "sizes", "pages", "lens", "times")))
    # an element has a feature once, however many of its words stand for it; all questions share this
    rows = rows.groupBy("feature", "block", F.col("ids").alias("element_id")).agg(F.sum("times").alias("times"), F.first("sizes").alias("size"), F.first("pages").alias("page"), F.first("lens").alias("len")).where(scoring.eligible)
    rows = rows.join(wanted.drop("manual_id"), ["feature", "block"])
    out = rows.groupBy("query_id", "element_id", "block").agg(F.round(F.sum(scoring.part), 6).alias("score"), F.count("*").cast("int").alias("n"), F.first("size").alias("size"), F.first("page").alias("page"))
    return out if index.stale is None else out.join(index.stale, ["element_id", "block"], "left_anti")


def bounds(asked: DataFrame, features: DataFrame, scoring: Scoring) -> DataFrame:
    """For each question and block the most that an element can score there, and how many of the question's features the block has."""
    rows = features.join(asked.select("query_id", "manual_id", "feature").distinct(), ["manual_id", "feature"])
    return rows.groupBy("query_id", "block").agg(F.sum(scoring.bound).alias("bound"), F.count("*").cast("int").alias("features"), F.max("n").alias("n"))


def best(index: TextIndex, asked: DataFrame, k: int, scoring: Scoring, weighed: bool = False, opened: list | None = None) -> DataFrame:
    """The k best elements of each question: query_id, element_id, score, n (features held), size, page.

    asked: query_id, manual_id, feature, word. ``opened`` takes the blocks and those that were opened, for those who want to count them.
    """
    asked, extra = kept(asked, "asked"), ["idf", "mean"] if weighed else []
    features = kept(_features(index, asked, weighed), "features")
    most = bounds(asked, features, scoring)
    most = kept(most.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("n"), "block"))), "bounds")
    ahead = most.where(F.col("nth") <= index.how.first).select("query_id", "block")
    early = kept(_scored(index, asked, features, ahead, scoring, extra), "early")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = early.withColumn("nth", place).where(F.col("nth") == k).select("query_id", F.col("score").alias("least_score"))
    # sums of rounded shares may differ in the last digit
    open_blocks = most.where(F.col("nth") > index.how.first).join(least, "query_id", "left").where(F.col("least_score").isNull() | (F.col("bound") >= F.col("least_score") - 1e-5)).select("query_id", "block")
    if opened is not None:
        opened += [most, ahead.unionByName(open_blocks)]
    rows = early.unionByName(_scored(index, asked, features, open_blocks, scoring, extra)).drop("block")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*scoring.order))).where(F.col("rn") <= k).drop("rn")


def with_all(index: TextIndex, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements that hold every feature of a question; wanted: query_id, n_features. Only blocks that hold all of them are opened."""
    asked, scoring = kept(asked, "asked"), counting([])
    features = kept(_features(index, asked, False), "features")
    some = bounds(asked, features, scoring).join(wanted, "query_id").where("features = n_features").select("query_id", "block")
    return _scored(index, asked, features, some, scoring, []).join(wanted, "query_id").where("n = n_features").drop("block", "n_features")


def best_of_batch(index: TextIndex, asked: DataFrame, k: int, weights: tuple[float, float] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The k best elements of each of many questions, of every kind of index: query_id, element_id, score, n, size, page.

    asked: query_id, manual_id, feature, word. Blocks of a manual are put together to groups of about ``blocks.SIZE`` elements, each group meets
    the manual's questions once, and k rows a question and group leave. So no row of a question, a word and a block is
    made, and what moves does not grow with the questions but for that. Questions with the same features are asked once.
    weights (k1, b): Okapi BM25, ties by element_id; else the number of features, then the longest, the first page. wanted: query_id, n_features; elements with all of these alone.
    """
    asked = kept(asked.select("query_id", "manual_id", "feature", "word"), "terms")
    own = asked.select("query_id", "manual_id", "feature").distinct().groupBy("query_id", "manual_id").agg(F.array_sort(F.collect_list("feature")).alias("features"))
    own = own.withColumn("n_wanted", F.lit(0)) if wanted is None else own.join(wanted.select("query_id", F.col("n_features").cast("int").alias("n_wanted")), "query_id").where(F.size("features") == F.col("n_wanted"))
    own = kept(own, "asked")
    words = kept(asked.select("manual_id", "word", "feature").distinct(), "words")
    sets = own.select("manual_id", "features", "n_wanted").distinct().withColumn("set_id", F.monotonically_increasing_id())
    sets = kept(sets, "sets")
    if weights is not None:
        df = index.heads.groupBy("manual_id", "word").agg(F.sum("n").alias("n")).join(words, ["manual_id", "word"]).groupBy("manual_id", "feature").agg(F.sum("n").alias("df")).join(index.statistics, "manual_id")
        idf = F.log(1 + (F.col("elements") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        words = kept(words.join(df.select("manual_id", "feature", "mean", idf.alias("idf")), ["manual_id", "feature"]), "words")
    else:
        words = words.withColumn("mean", F.lit(1.0)).withColumn("idf", F.lit(1.0))
    plan = index.statistics.select("manual_id", F.ceil(F.col("elements") / SIZE).cast("int").alias("groups")).join(sets.groupBy("manual_id").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")), "manual_id")
    plan = F.broadcast(kept(plan, "plan"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # lists are empty, not null, where a row has none: null ones are gone through again for each row that is handed over behind them
    none = lambda kind: (F.array() if kind.startswith("array") else F.lit(None)).cast(kind)
    found = index.postings.select("manual_id", "word", "block", "at", "times").join(words, ["manual_id", "word"])
    found = found.select("manual_id", "block", "feature", "mean", "idf", "at", "times", *[none(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("sizes", "int"), ("pages", "long"), ("lens", "int"), ("gone", "long"))])
    whole = index.postings.where(F.col("word") == ALL).select("manual_id", "block", "ids", "sizes", "pages", "lens")
    whole = whole.withColumn("gone", none("array<long>")) if index.stale is None else whole.join(index.stale.groupBy("block").agg(F.collect_list("element_id").alias("gone")), "block", "left").withColumn("gone", F.coalesce("gone", none("array<long>")))
    whole = whole.select("manual_id", "block", none("string").alias("feature"), none("double").alias("mean"), none("double").alias("idf"), none("array<smallint>").alias("at"), none("array<int>").alias("times"), "ids", "sizes", "pages", "lens", "gone")
    rows = found.unionByName(whole).join(plan, "manual_id").withColumn("group", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int")).withColumn("part", every("parts")).drop("groups", "parts")
    q = sets.join(plan, "manual_id").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")).withColumn("group", every("groups")).drop("groups", "parts")
    rows, q = rows.toDF(*rows.columns), q.toDF(*q.columns)
    key = ["manual_id", "group", "part"]
    best = rows.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_group_scores(k, weights), "set_id long, element_id long, score double, n int, size int, page long")
    order = [F.desc("score"), "element_id"] if weights is not None else [F.desc("n"), F.desc("size"), "page", "element_id"]
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("set_id").orderBy(*order))).where(F.col("rn") <= k).drop("rn")
    return own.join(sets, ["manual_id", "features", "n_wanted"]).select("query_id", "set_id").join(kept(best, "best"), "set_id").drop("set_id")


def _group_scores(k: int, weights: tuple[float, float] | None):
    """The k best elements of a group for each set of features; all work on arrays is by feature, and once for all sets."""

    def best(e, q):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("set_id", pa.int64()), ("element_id", pa.int64()), ("score", pa.float64()), ("n", pa.int32()), ("size", pa.int32()), ("page", pa.int64())])
        if not e.num_rows or not q.num_rows:
            return schema.empty_table()
        e = e.combine_chunks()
        is_all = ~np.asarray(e["feature"].is_valid())
        flat = lambda rows, c: np.asarray(rows[c].combine_chunks().flatten())
        whole, found = e.filter(pa.array(is_all)), e.filter(pa.array(~is_all))
        ids, sizes, pages, lens = (flat(whole, c) for c in ("ids", "sizes", "pages", "lens"))
        count = np.asarray(pc.list_value_length(whole["ids"]), "i8")
        starts, block = np.cumsum(count) - count, np.asarray(whole["block"])
        keys = (ids,) if weights is not None else (ids, pages, -sizes.astype("i8"))
        by = np.lexsort(keys)
        place = np.empty(len(by), "i8")
        place[by] = np.arange(len(by))
        # an element that a block has several times is one; one that is replaced counts no more
        block_of = np.repeat(block, count)
        pair = np.lexsort((place, ids, block_of))
        again = np.flatnonzero((ids[pair][1:] == ids[pair][:-1]) & (block_of[pair][1:] == block_of[pair][:-1])) + 1
        for i in again:
            place[pair[i]] = place[pair[i - 1]]
        gone = np.zeros(len(ids), bool)
        for b, g in zip(block, whole["gone"].to_pylist()):
            if g:
                gone[place[(block_of == b) & np.isin(ids, g)]] = True
        ids, sizes, pages, lens = ids[by], sizes[by], pages[by], lens[by]

        sorted_blocks = np.argsort(block)
        length = np.asarray(pc.list_value_length(found["at"]), "i8")
        start = starts[sorted_blocks[np.searchsorted(block[sorted_blocks], np.asarray(found["block"]))]] if found.num_rows else np.zeros(0, "i8")
        at = place[np.repeat(start, length) + flat(found, "at")] if found.num_rows else np.zeros(0, "i8")
        feature = found["feature"].combine_chunks().dictionary_encode()
        code = np.repeat(np.asarray(feature.indices), length)
        key = code.astype("i8") * max(1, len(ids)) + at
        key, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, weights=flat(found, "times"), minlength=len(key)) if len(key) else np.zeros(0)
        code, at = key // max(1, len(ids)), key % max(1, len(ids))
        ends = np.searchsorted(code, np.arange(len(feature.dictionary) + 1))
        names = {f: i for i, f in enumerate(feature.dictionary.to_pylist())}
        _, first = np.unique(np.asarray(feature.indices), return_index=True)
        idf, mean = np.asarray(found["idf"])[first], np.asarray(found["mean"])[first]
        alive, parts = ~gone, {}

        def part(f):
            """Places of a feature and what it adds there; of a frequent one, what it adds everywhere."""
            if f not in parts:
                i = names[f]
                span = slice(ends[i], ends[i + 1])
                here, tf = at[span], times[span]
                here, tf = here[alive[here]], tf[alive[here]]
                add = np.ones(len(here), np.uint8)
                if weights is not None:
                    k1, b = weights
                    add = idf[i] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[here] / mean[i])))
                if len(here) * 16 > len(ids):
                    dense = np.zeros(len(ids), add.dtype)
                    dense[here] = add
                    here, add = None, dense
                parts[f] = here, add
            return parts[f]

        def kth(some):
            return np.partition(some, len(some) - k)[len(some) - k] if len(some) > k else 0.0

        out = []
        for batch in q.select(["set_id", "features", "n_wanted"]).to_batches(max_chunksize=4096):
            for set_id, features, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                known = [f for f in features if f in names]
                if not known or len(known) < wanted:
                    continue
                score = np.zeros(len(ids), np.uint16 if weights is None else float)
                for f in known:
                    here, add = part(f)
                    if here is None:
                        score += add
                    else:
                        score[here] += add
                if weights is None:
                    chosen, left = [np.empty(0, "i8")], k
                    for level in [wanted] if wanted else range(int(score.max(initial=0)), 0, -1):
                        chosen.append(np.flatnonzero(score == level)[:left])
                        left -= len(chosen[-1])
                        if left == 0:
                            break
                    chosen = np.concatenate(chosen)
                    value = score[chosen].astype(float)
                else:
                    # what rounds to the k-th score may have to stay; of a part of the scores the k-th is not above that of all
                    least = kth(score[::16] if len(score) >= 64 * k else score)
                    chosen = np.flatnonzero(score >= least - 1e-5) if least > 1e-5 else np.flatnonzero(score > 0)
                    least = kth(score[chosen])
                    chosen = chosen[(score[chosen] >= least - 1e-5) & (score[chosen] > 0)]
                    value = np.round(score[chosen], 6)
                    top = np.lexsort((chosen, -value))[:k]
                    chosen, value = chosen[top], value[top]
                if len(chosen):
                    out.append((np.full(len(chosen), set_id, "i8"), ids[chosen], value, value.astype("i4") if weights is None else np.zeros(len(chosen), "i4"), sizes[chosen], pages[chosen]))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return best


def _places(index: TextIndex, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Every occurrence of the words of chosen rows: their keys, element_id, size, at (the word's place) and goes_on."""
    rows = index.postings.select(*KEYS, "ids", "sizes", "spots").join(chosen.select(*keys, *KEYS), KEYS)
    rows = rows.select("manual_id", *keys, "block", "ids", "sizes", F.explode("spots").alias("s")).withColumn("spot", F.shiftright("s", 32).cast("int"))
    rest = F.col("s").bitwiseAND(F.lit((1 << 32) - 1))
    rows = rows.select("manual_id", *keys, "block", F.get("ids", F.col("spot")).alias("element_id"), F.get("sizes", F.col("spot")).alias("size"), F.shiftright(rest, 2).alias("at"), rest.bitwiseAND(F.lit(3)).alias("goes_on"))
    return rows if index.stale is None else rows.join(index.stale, ["element_id", "block"], "left_anti")


def holding(index: TextIndex, terms: DataFrame, shortest: int = 3) -> DataFrame:
    """Elements that hold a term as a substring of their lower-cased text: element_id, size and the columns of terms.

    terms: manual_id, term and more; a term begins and ends with an ASCII letter or digit, and its words are parted by single blanks or
    points; one of a single word has ``shortest`` characters at least.
    """
    own = [c for c in terms.columns if c not in ("manual_id", "term")]
    low = F.lower("term")
    distinct = kept(terms.select("manual_id", low.alias("term")).distinct().withColumn("parts", F.split("term", "[ .]")), "terms")
    lone = distinct.where(F.size("parts") == 1)
    words = words_containing(index, lone, shortest).join(lone.select("manual_id", "term"), "term")
    heads = index.heads.select(*KEYS).join(words, ["manual_id", "word"])
    found = index.postings.select(*KEYS, "ids", "sizes").join(heads, KEYS).select("manual_id", "term", "block", F.inline(F.arrays_zip("ids", "sizes")))
    found = found.select("manual_id", "term", "block", F.col("ids").alias("element_id"), F.col("sizes").alias("size")).distinct()
    if index.stale is not None:
        found = found.join(index.stale, ["element_id", "block"], "left_anti")
    found = found.drop("block").unionByName(_consecutive(index, distinct.where(F.size("parts") > 1)))
    return _with_terms(found, terms, own)


def _with_terms(found: DataFrame, terms: DataFrame, own: list[str]) -> DataFrame:
    asked = terms.select("manual_id", *own, F.col("term").alias("as_asked"), F.lower("term").alias("term"))
    return found.join(asked, ["manual_id", "term"]).select("element_id", "manual_id", *own, F.col("as_asked").alias("term"), "size")


def _consecutive(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Terms of several words: manual_id, term, element_id, size."""
    marks = F.transform(F.split(F.regexp_replace("term", "[a-z0-9]+", ""), ""), lambda m: F.when(m == " ", 1).otherwise(2))
    parts = terms.select("manual_id", "term", F.size("parts").alias("m"), marks.alias("marks"), F.posexplode("parts").alias("i", "part"))
    parts = parts.withColumn("side", F.when(F.col("i") == 0, "end").when(F.col("i") == F.col("m") - 1, "begin").otherwise("whole")).withColumn("mark", F.get("marks", F.col("i"))).drop("marks")
    asked = parts.select("part", "side").distinct()
    v = index.vocabulary.select("word")
    piece = index.how.piece
    whole = asked.join(v, F.col("part") == F.col("word"))
    ends = v.withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(piece), F.char_length("word"))), lambda k: F.right("word", k)))))
    ends = asked.where("side = 'end'").withColumn("piece", F.right("part", F.least(F.lit(piece), F.char_length("part")))).join(ends, "piece").where(F.endswith("word", "part")).drop("piece")
    begins = v.withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(piece), F.char_length("word"))), lambda k: F.left("word", k)))))
    begins = asked.where("side = 'begin'").withColumn("piece", F.left("part", F.least(F.lit(piece), F.char_length("part")))).join(begins, "piece").where(F.startswith("word", "part")).drop("piece")
    words = whole.where("side = 'whole'").unionByName(ends).unionByName(begins)
    # which blocks hold a part, by any of its words; phrases share their parts
    held = index.heads.select("manual_id", "word", "block", "n").join(words, "word").groupBy("manual_id", "part", "side", "block").agg(F.sum("n").alias("n"))
    rows = parts.join(held, ["manual_id", "part", "side"])
    alike = Window.partitionBy("manual_id", "term", "block")
    rows = kept(rows.withColumn("met", F.count("*").over(alike)).where("met = m").drop("met", "n"), "parts")
    rows = rows.join(words, ["part", "side"])
    places = _places(index, rows, ["term", "i", "m", "mark"])
    chained = (F.col("i") == F.col("m") - 1) | (F.col("goes_on") == F.col("mark"))
    begin = (F.col("at") - F.col("i")).alias("begin")
    runs = places.where(chained).groupBy("manual_id", "term", "element_id", begin).agg(F.count("*").alias("found"), F.first("m").alias("m"), F.first("size").alias("size"))
    return runs.where(F.col("found") == F.col("m")).select("manual_id", "term", "element_id", "size").distinct()
