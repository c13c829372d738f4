"""Values carried along an order: fill-forward, as-of joins and running sums in which one key may hold most rows.

A window by key is one task a key. Here rows are sorted once across the cluster by key and order and numbered in that order, in a table of the shared
folder; a block is a run of at most 2^18 of these numbers. Each block is folded by itself, what it ends with goes to a table of one row a block,
and that is folded in the same way by partitions of the sort. So a task gets of one key a block, the blocks of a partition, or a row a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import kept

#: Row numbers have the partition of the sort from bit 33 on, and the row in it below.
BLOCK_BITS, PARTITION_BITS = 18, 33


def _folded(rows: DataFrame, values: Sequence[str], shifts: Sequence[int], total: bool, own: bool) -> DataFrame:
    """rows (_k, _at, values): each value becomes what the rows of the key up to this one leave, this one counted where own is set. shifts: what makes a number a block's, level by level."""
    rows = rows.withColumn("_block", F.shiftright("_at", shifts[0]) if shifts else F.lit(0).cast("long"))
    w = Window.partitionBy("_k", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    inside = rows.withColumns({v: F.sum(v).over(w) if total else F.last(v, ignorenulls=True).over(w) for v in values})
    if not shifts:
        return inside.drop("_block")
    ends = [F.sum(v).alias(v) if total else F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in values]
    before = _folded(rows.groupBy("_k", F.col("_block").alias("_at")).agg(*ends), values, shifts[1:], total, own=False)
    before = before.select("_k", F.col("_at").alias("_block"), *[F.col(v).alias(f"{v}_before") for v in values])
    # the key is a struct, in which null equals null; both sides are as the windows left them
    both = inside.join(before, ["_k", "_block"], "left")
    sums = {v: F.coalesce(F.col(v) + F.col(f"{v}_before"), v, f"{v}_before") if total else F.coalesce(v, f"{v}_before") for v in values}
    return both.withColumns(sums).drop("_block", *[f"{v}_before" for v in values])


def _carried(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], total: bool, own: bool, block_bits: int) -> DataFrame:
    inner = {name: f"_v{i}" for i, name in enumerate(values)}
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rest = [c for c in df.columns if c not in values]
    rows = rows.select(F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.struct(*keys).alias("_k"), *[c.alias(inner[name]) for name, c in values.items()], F.monotonically_increasing_id().alias("_at"))
    out = _folded(kept(rows, "ordered"), list(inner.values()), (block_bits, PARTITION_BITS - block_bits), total, own)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rest], *[F.col(v).alias(name) for name, v in inner.items()])


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], own: bool = True, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Each value as the last row of the key had it that has one, by order; from the rows before alone where own is not set.

    Rows whose key is null are one group. Rows that are equal in key and order are in some order, the same for all values. A name that the rows have is
    replaced. Runs a job: the sorted rows are written.
    """
    return _carried(df, keys, order, values, False, own, block_bits)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], own: bool = True, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Sums along the order, null until there is a value; else as last_known."""
    return _carried(df, keys, order, values, True, own, block_bits)


def asof(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, marked_at: str, columns: Sequence[str], ties: Sequence[str] = (), block_bits: int = BLOCK_BITS) -> DataFrame:
    """As-of join: every row with columns of the last mark of its key that is not after it; of marks at one time the last by ties, then by columns.

    Both sides go through one order, so there is no inequality join. Rows without a key, a time or an earlier mark get nulls, marks without a key or time are
    left out; a mark's own nulls stay. Columns that the rows have under the same name are replaced.
    """
    known = marks.dropna(subset=[*keys, marked_at])
    mark = F.struct(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    at_type = F.col(marked_at).cast(rows.schema[at].dataType)
    marked = known.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], at_type.alias("_time"), F.lit(0).alias("_side"), mark.alias("_mark"))
    asked = rows.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(at).alias("_time"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_asked"))
    every = marked.unionByName(asked, allowMissingColumns=True)
    found = last_known(every, [f"_key{i}" for i in range(len(keys))], ["_time", "_side", "_mark"], {"_mark": F.col("_mark")}, block_bits=block_bits).where("_side = 1")
    return found.select(*[F.col("_asked").getField(c).alias(c) for c in rows.columns if c not in columns], *[F.col("_mark").getField(f"_c{i}").alias(c) for i, c in enumerate(columns)])
