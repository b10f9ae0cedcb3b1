"""Sharding by minimax contiguous partition.

Atomic groups (equal texts) in the order of their digest are cut into contiguous shards so that the
largest shard is as small as can be. The capacity is found by binary search with a greedy check. The
check runs on the driver over block sums of bounded number; blocks in which a cut may fall are split
further by another aggregation, until only single groups are left where cuts can be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import pick, spool, table, text_of

#: Keys are the first 60 bits of a SHA-256.
KEY_BITS = 60


@dataclass(frozen=True)
class Block:
    """Groups whose keys are in [low, high): their weight and number."""

    low: int
    high: int
    weight: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.high - self.low == 1


def reach(blocks: list[Block], ends: list[int], start: int, capacity: int, whole: bool) -> int:
    """How far a shard that begins at weight ``start`` gets: to a block's end if blocks are ``whole``, else also inside a block that can be split."""
    from bisect import bisect_right

    at = bisect_right(ends, start + capacity)
    sure = ends[at - 1] if at else 0
    if whole or at == len(ends) or blocks[at].atomic:
        return sure
    return start + capacity


def walk(blocks: list[Block], ends: list[int], shards: int, capacity: int, whole: bool) -> list[int]:
    """Where the shards end, by weight, when each takes as much as it can."""
    out, at = [], 0
    for _ in range(shards):
        at = max(at, reach(blocks, ends, at, capacity, whole))
        out.append(at)
    return out


def smallest(blocks: list[Block], ends: list[int], shards: int, whole: bool) -> int:
    """The smallest capacity with which ``shards`` shards hold everything."""
    total = ends[-1]
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if walk(blocks, ends, shards, mid, whole)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(sums: Callable[[list[tuple[int, int]], int], list[Block]], shards: int, fanout: int = 256) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... begin, and the capacity. ``sums`` splits key ranges into blocks."""
    blocks = sums([(0, 1 << KEY_BITS)], 4096)
    if not blocks:
        return [], 0
    while True:
        ends, total = [], 0
        for b in blocks:
            total += b.weight
            ends.append(total)
        least, most = smallest(blocks, ends, shards, False), smallest(blocks, ends, shards, True)
        if least == most:
            break
        spans = list(zip(walk(blocks, ends, shards, least, True), walk(blocks, ends, shards, most, False)))
        split = [b for b, end in zip(blocks, ends) if not b.atomic and any(end - b.weight <= hi and end >= lo for lo, hi in spans[:-1])]
        if not split:
            break
        finer: dict[int, list[Block]] = {}
        for x in sums([(b.low, b.high) for b in split], fanout):
            finer.setdefault(next(b.low for b in split if b.low <= x.low < b.high), []).append(x)
        blocks = [y for b in blocks for y in finer.get(b.low, [b])]
    cuts, stops = [], walk(blocks, ends, shards, most, True)
    for stop in stops[:-1]:
        if stop >= total:
            break
        cuts.append(next(b.low for b, end in zip(blocks, ends) if end > stop))
    return cuts, most


def block_sums(groups: DataFrame) -> Callable[[list[tuple[int, int]], int], list[Block]]:
    """Aggregates ``groups`` (key, weight) over equal parts of key ranges; returns only the non-empty ones."""

    def sums(ranges: list[tuple[int, int]], parts: int) -> list[Block]:
        out, spark = [], groups.sparkSession
        edges = spark.createDataFrame([(lo, hi, max(1, -(-(hi - lo) // parts))) for lo, hi in ranges], "lo long, hi long, step long")
        # the ranges are a few dozen rows that this function has just made
        found = groups.join(F.broadcast(edges), (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        part = F.expr("(key - lo) div step")
        for r in found.groupBy("lo", "hi", "step", part.alias("part")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            low = r.lo + r.part * r.step
            out.append(Block(low, min(r.hi, low + r.step), r.w, r.n))
        return sorted(out, key=lambda b: b.low)

    return sums


def shard(docs: DataFrame, shards: int = 8, slot_rows: int = 100_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each input row; the law is ``bytes``.

    A null text has no bytes (size 1) and goes with empty texts. Equal texts share a shard. Repeated
    rows each get a slot. With fewer groups than shards some shards stay empty; an empty table gives
    an empty result. Extra columns are ignored.
    """
    hexed = F.sha2("t", 256)
    rows = spool(
        pick(docs, "doc_id", "text")
        .select("doc_id", text_of().alias("t"))
        .select("doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"), F.conv(F.substring(hexed, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    # 60 bits order the groups; texts that share them stay together, which equal texts must
    groups = spool(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "groups")
    cuts, _ = minimax_cuts(block_sums(groups), shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("key") >= F.lit(c)).cast("int")
    # slots: rows are spread over parts by row number, not by key, so that a hot group is spread too
    parts = max(1, -(-rows.count() // slot_rows))
    placed = rows.withColumn("shard", number.cast("int")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("within", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")))
    return numbered.join(before, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
