"""Upserts that write: a keyed table in buckets of files that batches, of a stream or not, are folded into.

Each column keeps its value beside the version that gave it, so folding is a maximum (or, for what stays as first written, a minimum):
batches give the same table in any order, and one that is applied again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch long, event string, n_rows long, n_keys long, at timestamp"


@dataclass(frozen=True)
class Upserts:
    """A table of one row a key.

    schema: columns of the batches, as DDL. version: columns that order the writes of a key; where they tie, the greater value wins.
    filled: the newest value that is not null stands (COALESCE of new and old). replaced: all of the newest row stands, nulls too.
    first: all of the oldest row stands (DO NOTHING), also over a deletion. deleted: a boolean column; true removes what is not newer.

    Nulls: a null key is a key, a null version the oldest, a null in `deleted` is false. Repeated rows count once, more columns of a batch
    are left out, an empty batch leaves the table as it is. buckets: choose so that one bucket's rows suit one task; another number is
    another table, which `from_changes` of this one fills.
    """

    folder: str
    schema: str
    keys: tuple[str, ...]
    version: tuple[str, ...]
    filled: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    deleted: str | None = None
    buckets: int = 64

    @property
    def _versions(self) -> list[str]:
        return [f"set_{i}" for i in range(len(self.filled))] + ["newest", "oldest", "gone"]

    def _lifted(self, rows: DataFrame) -> DataFrame:
        """Rows with each value as a pair of version and value; the aggregates that fold them are by the same names."""
        version = F.struct(*self.version)
        gone = F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(False)
        pairs = [F.when(F.col(c).isNotNull() & ~gone, F.struct(version.alias("version"), F.col(c).alias("value"))) for c in self.filled]
        pairs.append(F.when(~gone, F.struct(version.alias("version"), F.struct(F.lit(0).alias("none"), *self.replaced).alias("value"))))
        pairs.append(F.when(~gone, F.struct(version.alias("version"), F.struct(F.lit(0).alias("none"), *self.first).alias("value"))))
        pairs.append(F.when(gone, F.struct(version.alias("version"))))
        key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")
        return rows.select(bucket, key.alias("key"), *[p.alias(n) for p, n in zip(pairs, self._versions, strict=True)])

    def _folded(self, lifted: DataFrame) -> DataFrame:
        fold = lambda n: (F.min if n == "oldest" else F.max)(n).alias(n)
        return lifted.groupBy("bucket", "key").agg(*[fold(n) for n in self._versions])

    def _stored(self, spark: SparkSession) -> S.StructType:
        """The columns of the files."""
        return S.StructType([S.StructField(f.name, f.dataType) for f in self._folded(self._lifted(spark.createDataFrame([], self.schema))).schema])

    def _read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.schema(self._stored(spark)).parquet(f"{self.folder}/{part}")

    def create(self, spark: SparkSession) -> Upserts:
        """The empty table, where there is none yet."""
        empty = spark.createDataFrame([], self._stored(spark))
        empty.write.mode("ignore").partitionBy("bucket").parquet(f"{self.folder}/state")
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{self.folder}/ledger")
        return self

    def _note(self, spark: SparkSession, number: int, event: str, found: dict[str, int]) -> None:
        row = spark.createDataFrame([(number, event, found.get("n_rows"), found.get("n_keys"))], "batch long, event string, n_rows long, n_keys long")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Each batch's latest event, with the rows read and keys written as they were observed while writing."""
        events = spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")
        last = F.max_by(F.struct("event", "n_rows", "n_keys"), F.struct("at", F.col("event") == "done"))
        return events.groupBy("batch").agg(last.alias("x")).select("batch", "x.*")

    def write(self, batch: DataFrame, number: int) -> None:
        """Folds a batch into the table; fit for foreachBatch.

        The folded batch is written first and the buckets it touches are then exchanged. Where the ledger tells of an attempt that
        did not end, whose exchange may have been cut between two buckets, all buckets are folded anew from the batches, until the batch
        is run again. One writer at a time.
        """
        spark = batch.sparkSession
        cut = bool(self.ledger(spark).where("event <> 'done'").head(1))
        self._note(spark, number, "started", {})
        read, wrote = Observation(), Observation()
        seen = self._lifted(batch).observe(read, F.count(F.lit(1)).alias("n_rows"))
        self._folded(seen).observe(wrote, F.count(F.lit(1)).alias("n_keys")).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        if cut:
            rows = self._read(spark, "changes")
        else:
            fresh = self._read(spark, f"changes/batch={number}")
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most self.buckets numbers
            rows = self._read(spark, "state").where(F.col("bucket").isin(touched)).unionByName(fresh)
        # keys of a bucket are in one partition, so grouping needs no second shuffle; a key has one row a side
        merged = self._folded(rows.repartition(self.buckets, "bucket"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/state")
        self._note(spark, number, "done", read.get | wrote.get)

    def write_stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """A stream's batches, by their numbers; stops when what is there is done."""
        return rows.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _plain(self, folded: DataFrame) -> DataFrame:
        """Keys and values as the schema names them, without what was deleted."""
        after = lambda n: F.col("gone").isNull() | (F.col(f"{n}.version") > F.col("gone.version"))
        value = lambda n, c: F.when(after(n), F.col(f"{n}.{c}"))
        columns: list[Column] = [F.col(f"key.k{i}").alias(k) for i, k in enumerate(self.keys)]
        columns += [value(f"set_{i}", "value").alias(c) for i, c in enumerate(self.filled)]
        columns += [F.col(f"newest.value.{c}").alias(c) for c in self.replaced] + [F.col(f"oldest.value.{c}").alias(c) for c in self.first]
        return folded.where(F.col("newest").isNotNull() & after("newest")).select(*columns)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table."""
        return self._plain(self._read(spark, "state"))

    def row_of(self, spark: SparkSession, **key: object) -> DataFrame:
        """The row of one key: one bucket is read."""
        types = dict(spark.createDataFrame([], self.schema).dtypes)
        given = {k: F.lit(key[k]).cast(types[k]) for k in self.keys}
        bucket = F.pmod(F.hash(*given.values()), F.lit(self.buckets))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in given.items()])
        return self._plain(self._read(spark, "state").where(F.col("bucket") == bucket)).where(same)

    def from_changes(self, spark: SparkSession) -> DataFrame:
        """The table, folded from the written batches."""
        return self._plain(self._folded(self._read(spark, "changes")))
