"""Sharding by a minimax contiguous partition (DataFrame operations only).

Documents with equal texts form one atomic group. Groups are ordered by the
64-bit hash of their text, and the ordered line is cut into contiguous shards so
that the largest shard is as small as it can be: the smallest feasible capacity
is found by binary search, each candidate checked by a greedy walk. Within that
capacity the greedy walk from the left gives the latest place of each cut, one
from the right the earliest; each cut is moved to the place between them that is
nearest the even share, so that the last shards aren't left small.

The line of groups is never collected. The driver holds it as segments (ranges
of the hash with their total), at most ``2 ** SEGMENT_BITS`` from the first
pass. A segment can be bounded from both sides: treated as divisible at will it
can only make the partition easier, treated as one atom only harder. The two
give bounds on the smallest capacity; segments that a cut could touch anywhere
within those bounds are broken up by a further pass, until the cuts fall between
single groups and the two bounds meet.

A group that exceeds the even share takes a shard of its own, the rest is
partitioned over the remaining shards (the same minimax, applied again to what
is left, so one hot group doesn't leave other shards empty).

Defined results: a null text has size 16 and forms one group with other null
texts, apart from the group of empty texts; repeated rows are kept and share a
shard; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

SHARDS = 40
OVERHEAD = 16
SEGMENT_BITS = 13
#: Rows in one numbering cell; bounds the sort of the slot window.
CELL_ROWS = 50_000
KEY_BITS = 62


def _key() -> Column:
    """Non-negative 62-bit position of a text on the line."""
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - KEY_BITS)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        _key().alias("key"),
    )


class Line:
    """Ordered segments [lo, hi] of the key with their bytes; ``atom`` marks a single group."""

    def __init__(self, segments: list[tuple[int, int, int, bool]]):
        self.segments = sorted(segments)
        self.ends = [0]
        for s in self.segments:
            self.ends.append(self.ends[-1] + s[2])
        self.total = self.ends[-1]

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int] | None:
        """Greedy walk: offsets where shards end, or None if the capacity doesn't do."""
        at, out = 0, []
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                return out
            i = bisect.bisect_right(self.ends, reach) - 1
            if not divisible or self.segments[i][3]:
                reach = self.ends[i]
            if reach <= at:
                return None
            out.append(at := reach)
        return None

    def smallest(self, shards: int, divisible: bool) -> int:
        lo = -(-self.total // shards)
        hi = max(lo, lo + max((s[2] for s in self.segments), default=0))
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, divisible) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def open_segments(self, shards: int) -> tuple[int, int, set[int]]:
        """Bounds on the smallest capacity, and the segments that a cut may touch between them."""
        easy, hard = self.smallest(shards, True), self.smallest(shards, False)
        touched: set[int] = set()
        low, high = 0, 0
        for _ in range(shards):
            # the earliest and latest this cut can fall for a capacity within the bounds
            i = max(0, bisect.bisect_right(self.ends, low + easy) - 1)
            j = min(len(self.segments) - 1, bisect.bisect_right(self.ends, high + hard) - 1)
            if i >= len(self.segments):
                break
            touched.update(k for k in range(i, j + 1) if not self.segments[k][3])
            low, high = self.ends[i], min(self.total, high + hard)
        return easy, hard, touched

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cut offsets within the capacity, each as near the even share as feasible.

        The greedy walk from the left gives the latest place of each cut, one
        from the right the earliest; any walk between them stays feasible.
        """
        latest = [self.total] * (shards - 1)
        for k, c in enumerate(self.cuts(capacity, shards, False) or []):
            latest[k] = c
        earliest, at = [0] * (shards - 1), self.total
        for k in range(shards - 2, -1, -1):
            i = bisect.bisect_left(self.ends, max(0, at - capacity))
            earliest[k] = at = self.ends[min(i, len(self.ends) - 1)]
        out, at = [], 0
        for k in range(shards - 1):
            want = self.total * (k + 1) // shards
            top = min(latest[k], at + capacity)
            i = bisect.bisect_right(self.ends, top) - 1
            j = bisect.bisect_left(self.ends, max(earliest[k], at))
            n = bisect.bisect_left(self.ends, want)
            if n > 0 and n < len(self.ends) and want - self.ends[n - 1] < self.ends[n] - want:
                n -= 1
            at = self.ends[min(i, max(j, min(n, len(self.ends) - 1)))]
            out.append(at)
        return out


def _segments(rows: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    width = KEY_BITS - bits
    got = (
        rows.groupBy(F.shiftright("key", width).alias("s"))
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("b"))
        .collect()
    )
    return [(r.lo, r.hi, r.b, r.lo == r.hi) for r in got]


def _finer(rows: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """Break up ranges, each within one cell of the first pass; at most ``2 ** SEGMENT_BITS`` ranges are broadcast."""
    parts = max(2, 2**SEGMENT_BITS // len(ranges))
    width = KEY_BITS - SEGMENT_BITS
    spans = rows.sparkSession.createDataFrame(
        [(lo >> width, lo, hi, (hi - lo) // parts + 1) for lo, hi in ranges], "cell long, lo long, hi long, step long"
    )
    got = (
        rows.withColumn("cell", F.shiftright("key", width))
        .join(F.broadcast(spans), "cell")
        .where(F.col("key").between(F.col("lo"), F.col("hi")))
        .groupBy("lo", F.expr("(key - lo) div step").alias("part"))
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("b"))
        .collect()
    )
    return [(r.first, r.last, r.b, r.first == r.last) for r in got]


def partition_line(rows: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int], int]:
    """Keys of groups that take a shard alone, the last key of each further shard but the last, the capacity of those."""
    segments = _segments(rows, SEGMENT_BITS)
    alone: list[int] = []
    while segments:
        left = shards - len(alone)
        total = sum(s[2] for s in segments)
        big = max(segments, key=lambda s: s[2])
        if left > 1 and big[2] * left > total:
            if big[3]:
                alone.append(big[0])
                segments.remove(big)
                continue
            touched = {big}
        else:
            line = Line(segments)
            easy, hard, at = line.open_segments(left)
            touched = {line.segments[i] for i in at} if easy < hard else set()
            if not touched:
                last = [line.segments[bisect.bisect_left(line.ends, e) - 1][1] if e else -1 for e in line.balanced(hard, left)]
                return alone, last, hard
        segments = [s for s in segments if s not in touched] + _finer(rows, sorted(s[:2] for s in touched))
    return alone, [], 0


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    rows = materialise(sized(docs).withColumn("row", F.monotonically_increasing_id()), "shard-line")
    alone, last, _ = partition_line(rows, shards)
    shard = F.lit(len(alone))
    # a sorted list of at most `shards` cut keys: counted by expressions, no join
    for end in last:
        shard = shard + (F.col("key") > F.lit(end)).cast("int")
    for n, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), F.lit(n)).otherwise(shard)
    rows = rows.withColumn("shard", shard.cast("int"))
    cells = 4 * max(1, math.ceil(rows.count() / (shards * CELL_ROWS)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "cell").count()
        .select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "row")
    return (
        rows.withColumn("n", F.row_number().over(within))
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
