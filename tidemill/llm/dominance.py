"""Dominance counting by divide and conquer on slot ranks.

A point is above another if its slot is smaller or equal and its level strictly larger. Points are first
summed into cells, one for each slot and level, map-side: what follows is as large as the cells, however
often a cell is hit. The ranks of slots are halved again and again. At each level of the recursion one
shuffle by node brings the halves of every node together, merged by level: a cell of the right half is below
all that the left half has at larger levels, a suffix sum. A pair of different slots is parted
at exactly one node, so sums over a cell's nodes are whole; pairs within a slot are met at the recursion's end.

A node near the root holds all levels, which no task may see at once. So levels are written in digits of
``digit_bits`` bits, and a larger level is one that is larger in a digit, the digits before it being
alike. A suffix sum then runs over the digits under one (node, digits before): at most 2 ** digit_bits rows a half, as
halves are summed by digit before they are shuffled. No group grows with points, slots or levels.

The answers of cells go back to the points by an equality join on (slot, level). Cells that hold more than one of
``hot_share`` of all points are fewer than that many: they are broadcast, and their points spread.

Nulls and edges: points with a null slot or level are above none and have null answers; repeated points
count each; ties in slot or level follow the rule above; negative slots and levels are as good as others; an
empty table gives no rows. Columns of the caller are kept apart from ours by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written


@dataclass(frozen=True)
class Dominance:
    digit_bits: int = 4
    #: Cells with more than one of so many of all points are hot; there are fewer of them than this.
    hot_share: int = 256
    #: Ways that the cells of one slot are spread where they get their slot's rank.
    spread: int = 16


def _bits(n: int) -> int:
    return max(0, n - 1).bit_length()


def _cells(points: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One row for each slot and level, with the sums of the points' weights."""
    return points.where("slot is not null and level is not null").groupBy("slot", "level").agg(F.count("*").alias("points"), *[F.sum(w).alias(s) for s, w in sums.items()])


def _with_ranks(cells: DataFrame, how: Dominance) -> tuple[DataFrame, int]:
    """The cells with the rank of their slot from 0, and how many slots there are."""
    slots = written(numbered(written(cells.select("slot").distinct(), "slots"), [F.asc("slot")], "rank"), "ranks")
    n = slots.count()
    ranks = slots.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(how.spread - 1)))).withColumn("rank", F.col("rank") - 1)
    ranked = cells.withColumn("way", F.pmod("level", F.lit(how.spread)).cast("int")).join(ranks.hint("merge"), ["slot", "way"]).drop("way")
    return ranked, n


def _digits(level: Column, low: int, places: int, how: Dominance) -> Column:
    """(place, digits before, digit) at every place of a level, the last digit first."""
    offset = level - F.lit(low)
    at = [(k, F.shiftright(offset, how.digit_bits * k)) for k in range(places)]
    return F.array(*[F.struct(F.lit(k).alias("place"), F.shiftright(x, how.digit_bits).alias("prefix"), x.bitwiseAND(F.lit((1 << how.digit_bits) - 1)).alias("digit")) for k, x in at])


_KEY = ["place", "prefix", "digit"]


def _in_right(depth: int) -> Column:
    """Whether a rank is in the right half of its node of this depth."""
    return F.shiftright("rank", depth - 1).bitwiseAND(F.lit(1).cast("long")) == 1 if depth else F.lit(True)


def _met(rows: DataFrame, depth: int, sums: dict[str, str]) -> DataFrame:
    """One level of the recursion: what the left halves of the nodes of this depth have above the digits of the right ones.

    rows: rank, place, prefix, digit and sums. Depth 0 is the slots themselves, of which both halves are the slot.
    """
    half = rows.withColumn("node", F.shiftright("rank", depth)).withColumn("right", _in_right(depth))
    half = half.groupBy("node", "right", *_KEY).agg(*[F.sum(s).alias(s) for s in sums])
    above = Window.partitionBy("node", "place", "prefix").orderBy(F.desc("digit")).rangeBetween(Window.unboundedPreceding, -1)
    given = lambda s: F.col(s) if depth == 0 else F.when(~F.col("right"), F.col(s))
    # a digit of the right half has one row, and only digits strictly above it are in its frame
    out = half.select("node", "right", *_KEY, *[F.coalesce(F.sum(given(s)).over(above), F.lit(0)).alias(s) for s in sums])
    return out.where("right").select(F.lit(depth).alias("depth"), "node", *_KEY, *sums).where(" or ".join(f"{s} <> 0" for s in sums))


def above_cells(points: DataFrame, sums: dict[str, str], how: Dominance = Dominance()) -> DataFrame:
    """points: slot, level and weights. For each (slot, level): how many points it has, and each of ``sums``, a name and the weight summed over all points above it."""
    cells = written(_cells(points, sums), "cells")
    low, high = cells.agg(F.min("level"), F.max("level")).first()
    if low is None:
        return cells.select("slot", "level", "points", *[F.col(s).cast("long").alias(s) for s in sums])
    ranked, slots = _with_ranks(cells, how)
    ranked, places = written(ranked, "ranked"), max(1, -(-_bits(high - low + 1) // how.digit_bits))
    spelt = ranked.select("rank", F.inline(_digits(F.col("level"), low, places, how)), *sums)
    spelt = written(spelt.groupBy("rank", *_KEY).agg(*[F.sum(s).alias(s) for s in sums]), "digits")
    met = None
    for depth in range(_bits(slots) + 1):
        one = _met(spelt, depth, sums)
        met = one if met is None else met.unionByName(one)
    # a cell looks up the slot itself and every node of whose right half it is
    node = lambda d: F.struct(F.lit(d).alias("depth"), F.shiftright("rank", d).alias("node"))
    nodes = F.array_compact(F.array(node(0), *[F.when(_in_right(d), node(d)) for d in range(1, _bits(slots) + 1)]))
    asked = ranked.select("slot", "level", nodes.alias("nodes"), F.inline(_digits(F.col("level"), low, places, how))).select("slot", "level", *_KEY, F.inline("nodes"))
    got = asked.join(met.hint("merge"), ["depth", "node", *_KEY]).select("slot", "level", *sums)
    # cells with nothing above them are met by no node
    got = got.withColumn("points", F.lit(0)).unionByName(cells.select("slot", "level", "points", *[F.lit(0).cast("long").alias(s) for s in sums]))
    return written(got.groupBy("slot", "level").agg(F.sum("points").alias("points"), *[F.sum(s).cast("long").alias(s) for s in sums]), "above")


def count_above(points: DataFrame, sums: dict[str, str], how: Dominance = Dominance()) -> DataFrame:
    """The columns of points with ``sums``, the weights of all points above each; null where its slot or level is."""
    above = above_cells(points, sums, how)
    total = above.agg(F.sum("points")).first()[0] or 0
    answers = [F.col(s).alias(f"_{s}") for s in sums]
    hot = above.where(F.col("points") * how.hot_share > total).select("slot", "level", *answers, F.lit(True).alias("_hot"))
    cold = above.where(F.col("points") * how.hot_share <= total).select(F.col("slot").alias("_slot"), F.col("level").alias("_level"), *[F.col(s).alias(f"_cold_{s}") for s in sums])
    met = points.join(F.broadcast(hot), ["slot", "level"], "left")
    # points that have their answer, or none, would all have one key here: they are spread and meet nothing
    done = F.col("_hot").isNotNull() | F.col("slot").isNull() | F.col("level").isNull()
    spread = F.xxhash64(*points.columns)
    met = met.withColumn("_a", F.when(done, spread).otherwise(F.col("slot"))).withColumn("_b", F.when(done, F.lit(None).cast("long")).otherwise(F.col("level")))
    out = met.join(cold.hint("merge"), (F.col("_a") == F.col("_slot")) & (F.col("_b") == F.col("_level")), "left")
    known = F.col("slot").isNotNull() & F.col("level").isNotNull()
    return out.select(*points.columns, *[F.when(known, F.coalesce(f"_{s}", f"_cold_{s}", F.lit(0))).alias(s) for s in sums])
