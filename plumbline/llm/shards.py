"""Sharding by a minimax contiguous partition of atomic groups.

Groups are equal texts; a group lies in one shard. In the order of their first doc_id they are cut into
`n_shards` runs such that the largest run is as small as it can be (law `bytes`): the smallest
capacity is found by binary search, each capacity is checked by filling shard after shard, and the
cuts of the smallest feasible one are taken. If that capacity is the size of one group, the group is a
shard by itself, and what is left is cut again with the shards left, until no single group decides.
So a group with a third of all bytes costs one shard, and the others still share evenly.

The search needs the ends of the groups, the running sums of their bytes, but never all of them:
* the driver holds at most `BUCKETS` buckets of ends, each with its first and last end. From them every
  fill has a place that it reaches at least and one that it reaches at most, so a capacity is feasible,
  infeasible or open.
* between the smallest capacity that may be feasible and the smallest that surely is, every cut has a
  window. The next round reads the ends in those windows alone, in finer buckets, until nothing is open.
A round divides the windows by about a thousand, so a handful reach single bytes, whatever the table.

Equal texts are found by their sha256. Groups are counted before the shuffle; rows of hot groups are
salted when they learn their shard, and slots are running sums over ranges (`ordered.running`), so no
group and no shard has to fit in a task.

Defined results: a null text is an empty one (size 1, crc32 0) and equal to it. Groups without any
doc_id come first. Within a shard the slots follow the groups, then doc_id; repeated rows have a slot
each. With fewer groups than shards the last shards are empty; an empty table has no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import settle, text_or_empty
from plumbline.llm.ordered import running

SHARDS = 16
BUCKETS = 1 << 16  # that the driver holds at a time
HOT = 1000  # a group with more than one in HOT of all rows is salted, so at most HOT groups are


class Ends:
    """What is known of the ends of groups: buckets of neighbouring ends, by their first and last."""

    def __init__(self, buckets: Sequence[tuple[int, int]]):
        self.buckets = sorted(buckets)
        self.firsts = [first for first, _ in self.buckets]

    def at_least(self, x: int) -> int:
        """An end, at most x; the last such end is not before it."""
        return self._last(x)[0]

    def at_most(self, x: int) -> int:
        """The last end up to x is not behind this."""
        return self._last(x)[1]

    def _last(self, x: int) -> tuple[int, int]:
        place = bisect_right(self.firsts, x) - 1
        if place < 0:
            return 0, 0
        first, last = self.buckets[place]
        return (last, last) if last <= x else (first, x)


def fill(capacity: int, n_shards: int, total: int, alone: Sequence[tuple[int, int]], reach: Callable[[int], int]) -> list[int]:
    """The ends of shards that are filled one after another up to the capacity; `alone` are the groups
    (start, end) with a shard of their own. Where the last end is short of the total, the capacity is too small."""
    ends, at = [], 0
    own = dict(alone)
    for _ in range(n_shards):
        if at in own:
            at = own[at]
        elif at < total:
            stop = min((start for start, _ in alone if start > at), default=total)
            at = stop if at + capacity >= stop else max(at, reach(at + capacity))
        ends.append(at)
    return ends


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _windows(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _width(windows: Sequence[tuple[int, int]]) -> int:
    return sum(high - low + 1 for low, high in windows)


def ends_between(groups: DataFrame, windows: Sequence[tuple[int, int]], n_buckets: int = BUCKETS) -> Ends:
    """The ends in the windows, in about `n_buckets` buckets of one width (and one more for each window)."""
    bucket, inside, base = F.lit(None).cast("long"), F.lit(False), 0
    width = -(-_width(windows) // n_buckets)
    for low, high in windows:
        within = F.col("end").between(low, high)
        inside = inside | within
        bucket = F.when(within, F.lit(base) + F.call_function("div", F.col("end") - low, F.lit(width))).otherwise(bucket)
        base += (high - low) // width + 1
    found = groups.where(inside).groupBy(bucket.alias("bucket")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
    return Ends([(r["first"], r["last"]) for r in found.collect()])


def smallest_capacity(groups: DataFrame, n_shards: int, total: int, least: int, alone: Sequence[tuple[int, int]],
                      coarse: Ends, n_buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """The smallest capacity that n_shards need, and the ends of the shards that it fills.

    `groups` have their end; `coarse` are buckets over all of them. `least` is a capacity that is needed.
    """
    ends, low, high, open_ = coarse, least, total, total

    def filled(capacity: int, reach: Callable[[int], int]) -> list[int]:
        return fill(capacity, n_shards, total, alone, reach)

    while True:
        low = _smallest(lambda c: filled(c, ends.at_most)[-1] == total, low, high)
        high = _smallest(lambda c: filled(c, ends.at_least)[-1] == total, low, high)
        first, last = filled(low, ends.at_least), filled(high, ends.at_most)
        if first == last:
            return low, first
        windows = _windows(list(zip(first, last, strict=True)))
        # Too few buckets for the number of shards would leave the windows as wide as they are.
        n_buckets, open_ = (n_buckets if 2 * _width(windows) <= open_ else 2 * n_buckets), _width(windows)
        ends = ends_between(groups, windows, n_buckets)


def cuts(groups: DataFrame, n_shards: int = SHARDS, n_buckets: int = BUCKETS) -> list[int]:
    """The ends of the shards over groups (bytes, end)."""
    total = groups.agg(F.max("end")).first()[0]
    if not total:
        return []
    # No more groups than shards can decide the capacity.
    largest = [(r["end"] - r["bytes"], r["end"]) for r in groups.orderBy(F.desc("bytes"), "end").select("bytes", "end").limit(n_shards).collect()]
    coarse = ends_between(groups, [(0, total)], n_buckets)
    alone: list[tuple[int, int]] = []
    while True:
        rest = [group for group in largest if group not in alone]
        least = max((end - start for start, end in rest[:1]), default=1)
        capacity, ends = smallest_capacity(groups, n_shards, total, least, alone, coarse, n_buckets)
        deciding = [(start, end) for start, end in rest if end - start == capacity]
        if not deciding:
            return ends
        alone = sorted([*alone, deciding[0]])


def _with_groups(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """The rows with what is known of their groups; the rows of a hot group are dealt over salts."""
    limit = max(1, n_rows // HOT)
    # At most HOT digests.
    hot = F.broadcast(groups.where(F.col("n") > limit).select("digest", F.ceil(F.col("n") / limit).alias("salts")))
    salted = rows.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1)))).drop("salts")
    salts = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit)).otherwise(1)
    repeated = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
    return salted.join(repeated, ["digest", "salt"]).drop("digest", "salt")


def _shard(end: Column, ends: Sequence[int]) -> Column:
    """The shard in which a group ends."""
    return sum((F.when(end > cut, 1).otherwise(0) for cut in ends[:-1]), F.lit(0)).cast("int")


def shards(docs: DataFrame, n_shards: int = SHARDS, n_buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not by key)."""
    text, one = text_or_empty(), F.lit(1).cast("long").alias("one")
    rows = settle(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"), one), "shard-rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"), F.sum("one").alias("n"))
    placed = running(groups, ["first_id", "digest"], ["bytes"], "shard-order").withColumn("end", F.col("bytes_before") + F.col("bytes"))
    groups = settle(placed.select("digest", "bytes", "n", "end"), "shard-groups")
    ends = cuts(groups, n_shards, n_buckets)
    known = _with_groups(rows, groups.select("digest", "n", "end", _shard(F.col("end"), ends).alias("shard")), rows.count())
    slots = running(known, ["shard", "end", "doc_id", "row"], ["one"], "shard-slots", "shard")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("one_before").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
