"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

The index is a set of runs, each a bucketed table of (hash, owner) in the shared folder, every bucket
one sorted file. Documents come in batches of rising doc_id. A batch pre-aggregates its hashes, which
deals them into the same buckets, and merge-joins them with run after run: the runs are neither moved nor
sorted again. What no run has (the anti-join's side) becomes a run of level 0. As soon as a level has
``fan_in`` runs they are merged, bucket by bucket, into one run of the next level, so a batch meets a
number of runs that grows with the logarithm of the number of batches. Input of up to four times ``batch_bytes``
takes ``batches`` = 4, with ``fan_in`` = 2 compacted after the second and, where the caller keeps the index, the
fourth; beyond it the number of batches follows the text, up to 256.

A key is a line stripped of white space and A-Z lower-cased; keys of fewer than ``min_chars`` code
points are never dropped. The owner of a key is the smallest doc_id that holds it; every line of the
key in other documents is dropped. Hashes have 128 bits.

Nulls and edges: a null or empty text is one empty line; rows with a null doc_id keep all lines and
own none (their hash is null if the text is null); several rows of one doc_id count as one document
and each get a row; an empty table gives no rows; only doc_id and text are read, so clashing names
do no harm. Texts of any length are split whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bucketed, sorted_buckets, whole, written

#: The very ends of a line: ``$`` would also match before a final U+0085, U+2028 or U+2029.
_EDGES = rf"\A[{SPACE}]+|[{SPACE}]+\z"


@dataclass(frozen=True)
class LineDedup:
    min_chars: int = 10
    batches: int = 4
    fan_in: int = 2
    #: Text for which the runs have one bucket, up to the number of buckets that Spark takes.
    bucket_bytes: int = 64_000_000
    #: Text of a batch at most, where there would be fewer than ``batches`` otherwise.
    batch_bytes: int = 1 << 40
    #: Text that makes a task at least; input in smaller splits is taken together.
    task_bytes: int = 16_000_000


def key_of(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, _EDGES, ""))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


_KEYS = ["h1", "h2"]


@dataclass
class LineIndex:
    """The runs by level, the oldest first; each holds (h1, h2, owner), and no hash is in two of them."""

    how: LineDedup = field(default_factory=LineDedup)
    buckets: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    compactions: int = 0

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _run(self, rows: DataFrame) -> DataFrame:
        with sorted_buckets(rows.sparkSession, self.buckets):
            run, name = bucketed(rows, "run", _KEYS, self.buckets)
        self.tables.append(name)
        return run

    def meeting(self, batch: DataFrame) -> DataFrame:
        """The batch (one row for each hash) with ``known``, the owner that a run has; a merge join with each run."""
        out = batch.withColumn("known", F.lit(None).cast("long"))
        for run in self.runs():
            out = out.join(run.select(*_KEYS, F.col("owner").alias("held")), _KEYS, "left").withColumn("known", F.coalesce("known", "held")).drop("held")
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: each bucket is merged with its like. A hash is in one of them only."""
        self.compactions += 1
        one = runs[0]
        for other in runs[1:]:
            both = one.join(other.withColumnRenamed("owner", "others"), _KEYS, "full_outer")
            one = self._run(both.select(*_KEYS, F.coalesce("owner", "others").alias("owner")))
        return one

    def add(self, new: DataFrame) -> None:
        """Adds hashes that no run has, as a run of level 0, and compacts full levels."""
        level = 0
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(new))
        while len(self.levels[level]) >= self.how.fan_in:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)

    def close(self, spark: SparkSession) -> None:
        """Takes the tables out of the catalog; their files go with the application."""
        for name in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        self.levels.clear()


def _occurrences(docs: DataFrame, how: LineDedup) -> DataFrame:
    """One row per line long enough: doc_id, its place, and the hash of its key."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("of_text"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    lines = lines.where(F.char_length("line") >= how.min_chars).select("doc_id", "of_text", "at", key_of(F.col("line")).alias("key"))
    lines = lines.where(F.char_length("key") >= how.min_chars)
    return lines.select("doc_id", "of_text", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _bounds(docs: DataFrame, how: LineDedup) -> tuple[list[int], int]:
    """Ids that cut the documents into batches of about the same size, and the bytes of text; only a sketch's quantiles reach the driver."""
    cuts, size = docs.agg(F.percentile_approx("doc_id", [k / 256 for k in range(1, 256)], 1000), F.sum(F.octet_length("text"))).first()
    n = min(256, max(how.batches, -(-(size or 0) // how.batch_bytes)))
    return sorted({cuts[256 * k // n - 1] for k in range(1, n)}) if cuts else [], size or 0


def dropped_lines(docs: DataFrame, how: LineDedup = LineDedup(), index: LineIndex | None = None) -> DataFrame:
    """doc_id, hash of the text and place of the lines to drop, batch by batch against the index.

    A given index keeps what is new in every batch; an own one is done with after the last batch.
    """
    docs = whole(docs, {"doc_id": "long", "text": "string"})
    (cuts, size), out = _bounds(docs, how), None
    tasks = max(8, size // how.task_bytes)
    most = int(docs.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    kept, index = index is not None, index or LineIndex(how, max(1, min(most, -(-size // how.bucket_bytes))))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        lines = written(_occurrences(batch.coalesce(tasks), how), "lines")
        # pre-aggregated before the shuffle: a line that all documents share is one row a task
        first = lines.groupBy(*_KEYS).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"))
        met = index._run(index.meeting(first))
        if kept or high is not None:
            index.add(met.where("known is null").select(*_KEYS, "owner"))
        seen = written(met.where("known is not null or owner < other").select(*_KEYS, F.coalesce("known", "owner").alias("owner")).coalesce(tasks), "seen")
        hit = lines.join(seen, _KEYS).where("doc_id <> owner").select("doc_id", "of_text", "at")
        out = hit if out is None else out.unionByName(hit)
    if not kept:
        index.close(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """The columns of documents with n_lines, n_dropped and kept_text; the text moves once."""
    docs = whole(docs, {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"})
    drops = dropped_lines(docs, how)
    drops = drops.groupBy("doc_id", "of_text").agg(F.array_distinct(F.collect_list("at")).alias("gone"))
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return (
        docs.withColumn("of_text", F.xxhash64("text"))
        .join(drops, ["doc_id", "of_text"], "left")
        .withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .select(*docs.columns, "n_lines", "n_dropped", "kept_text")
    )
