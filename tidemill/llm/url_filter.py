"""URL filters: rules on host and path, then a list of canonical URLs behind a blocked Bloom filter.

A rule fits a host and all its subdomains if the path starts with the rule's path; the longest that
fits decides. URLs without a rule are looked up in the list: a split-block Bloom filter (blocks of
four 64-bit words, one bit in each) passes possible hits, and an exact hash join on the canonical
URL removes false positives. Filter and lookup are DataFrame expressions; no Python runs on the
executors.

The filter has a block for ``keys_a_block`` listed URLs, which keeps false positives below 1 % whatever
the length of the list. It is broadcast up to ``broadcast_blocks`` blocks (40 bytes each) and joined by the
block's number beyond; the list itself is shuffled by the exact join, never broadcast by hint. Possible
hits meet the list as distinct URLs, so a URL that a third of all pages share is one row there; the
verdicts go back by a join that Spark may split. Of equally long rules the one that sorts first decides.

Canonical: host without a leading ``www.`` and a trailing dot, then the path without its last ``/``.

Nulls and edges: a null URL, or one without ``://``, has empty host and path, fits no rule, is on no
list and is allowed; repeated rows each get a row; an empty table or list is fine; null entries of
the list are left out; only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


@dataclass(frozen=True)
class UrlFilter:
    rules: tuple[Rule, ...] = ()
    keys_a_block: int = 16
    broadcast_blocks: int = 1 << 18


def bits_for(keys: int, how: UrlFilter) -> int:
    """The filter has 2 ** this many blocks."""
    return max(4, (-(-keys // how.keys_a_block) - 1).bit_length())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(authority) + 1), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(authority), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.\z", ""), F.regexp_replace(path, r"/\z", ""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bits(key: Column, block_bits: int) -> tuple[Column, list[Column]]:
    """Block and, for each of its four words, the mask of one bit."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit("bits"), key)
    masks, place = [], F.pmod(h1, F.lit(1 << block_bits))
    for k in range(4):
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h2, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return place, masks


def bloom_blocks(listed: DataFrame, block_bits: int) -> DataFrame:
    """The filter as a table (block, w0..w3) of at most 2 ** block_bits rows, from a column ``key``."""
    block, masks = _bits(F.col("key"), block_bits)
    rows = listed.select(block.alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def may_be_listed(pages: DataFrame, blocks: DataFrame, block_bits: int, broadcast_blocks: int = UrlFilter.broadcast_blocks) -> DataFrame:
    """pages (with ``key``) and the column ``maybe``."""
    blocks = F.broadcast(blocks) if 1 << block_bits <= broadcast_blocks else blocks
    block, masks = _bits(F.col("key"), block_bits)
    hit = None
    for k, m in enumerate(masks):
        one = F.col(f"w{k}").bitwiseAND(m) != 0
        hit = one if hit is None else hit & one
    return pages.withColumn("block", block).join(blocks, "block", "left").withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")


def judge(pages: DataFrame, listed: DataFrame, how: UrlFilter) -> DataFrame:
    """page_id, host, path, rule and verdict; listed: canonical URLs to block, in the column ``url``."""
    pages = whole(pages, {"page_id": "long", "url": "string"})
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("r", rule_of(F.col("host"), F.col("path"), how.rules)).withColumn("key", canonical(F.col("host"), F.col("path")))
    listed = written(whole(listed, {"url": "string"}).where("url is not null").select(F.col("url").alias("key")).distinct(), "listed")
    bits = bits_for(listed.count(), how)
    judged = written(may_be_listed(pages, bloom_blocks(listed, bits), bits, how.broadcast_blocks), "judged")
    open_hits = F.col("maybe") & F.col("r").isNull()
    sure = judged.where(open_hits).select("key").distinct().join(listed, "key", "left_semi")
    blocked = judged.where(open_hits).join(sure.withColumn("listed", F.lit(True)), "key", "left").withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    rest = judged.where(~open_hits).withColumn("verdict", F.coalesce("r.verdict", F.lit("allow")))
    columns = ["page_id", "host", "path", F.col("r.rule").alias("rule"), "verdict"]
    return rest.select(*columns).unionByName(blocked.select(*columns))
