"""Minimax contiguous sharding of documents by size, with equal texts kept together.

The atomic groups are equal texts, by a 64-bit hash of the UTF-8 bytes, in the order of that hash. A group larger than
an equal share of what is left gets a shard of its own, largest first. The other groups stay in order and are cut into
the remaining shards: a binary search over the capacity finds the smallest one for which greedy filling needs no more
shards than there are, and the cuts are laid inside that capacity as close to equal shares as it allows.

The driver never holds all groups. It starts with the bytes of PREFIX_BITS-bit ranges of the hash and splits only the
ranges near a cut, until no cut can fall inside an unsplit range; so the capacity is that of the groups themselves.

Very long texts are only measured and hashed. Groups of one size need no order: that of their hashes is total, and rows of
one group are placed by hashes of their ids. Null text counts as no bytes. Repeated rows are rows of one group. An empty table gives an empty result. Null doc_id is
an ordinary value. Extra columns are dropped; the result is joined by nothing, each row carries its own shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
ROW_BYTES = 16
#: The driver's first view of the groups: so many ranges of the hash, and so many more for each range it splits.
PREFIX_BITS = 15
SPLIT_BITS = 7
#: Rows are numbered in so many slices of doc_id hashes at once.
SLICES = 4096


def greedy(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Ends (exclusive) of the shards that filling from the left makes; None if `shards` do not hold everything."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        ends.append(at)
        if at == len(sizes):
            return np.array(ends + [at] * (shards - len(ends)))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which greedy filling needs no more than `shards` shards."""
    low, high = max(int(sizes.max(initial=0)), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Ends of shards within `capacity`, each as near to an equal share of what is left as the later shards allow."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n, least = len(sizes), [len(sizes)]
    for _ in range(shards - 1):  # from the right: the earliest place where each cut can be
        least.append(int(np.searchsorted(total, total[least[-1]] - capacity, side="left")))
    least = least[::-1]
    ends, at = [], 0
    for j in range(shards):
        latest = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        wish = total[at] + (total[n] - total[at]) / (shards - j)
        k = int(np.searchsorted(total, wish))
        if k > 0 and (k > n or wish - total[k - 1] < total[k] - wish):
            k -= 1
        at = max(min(max(k, least[j]), latest), at)
        ends.append(at)
    return np.array(ends)


def _divisible_need(sizes: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> bool:
    """Whether `shards` might do with ranges that are not whole taken as divisible at any byte."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    for _ in range(shards):
        at = at + capacity
        if at >= total[-1]:
            return True
        i = int(np.searchsorted(total, at, side="right")) - 1
        if whole[i]:
            at = int(total[i])
    return False


def _near_cuts(sizes: np.ndarray, whole: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """The ranges, not whole, in which some cut can fall for a capacity from low to high."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    early, late = 0, 0
    hit = np.zeros(len(sizes), bool)
    for _ in range(shards):
        i = int(np.searchsorted(total, min(early + low, total[-1]), side="right")) - 1
        early = int(total[max(i, 0)])
        late = min(late + high, int(total[-1]))
        j = int(np.searchsorted(total, late, side="left"))
        hit[max(i, 0) : j + 1] = True
    return hit & ~whole


def _prefix(h: Column, bits: Column | int) -> Column:
    """The leading bits of a hash as an unsigned number, with the sign bit turned so that order is kept."""
    turned = h.bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(turned, 64 - bits) if bits < 64 else turned


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h")))
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).collect()[0][0] or 0
    # Fewer than `shards` groups can be larger than an equal share of what is left, so these rows are all the candidates.
    largest = groups.orderBy(F.desc("size"), "h").limit(shards).collect()
    alone: list[int] = []
    rest = total
    for r in largest:
        if len(alone) < shards - 1 and r["size"] * (shards - len(alone)) >= rest:
            alone.append(r["h"])
            rest -= r["size"]
    light = rows.where(~F.col("h").isin(alone)) if alone else rows
    bounds = _cut(light, shards - len(alone))
    shard = F.lit(len(alone))
    for b in bounds:  # the first hash of each later shard
        shard = shard + F.when(F.col("h") >= b, 1).otherwise(0)
    for i, h in enumerate(alone):
        shard = F.when(F.col("h") == h, i).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLICES)).cast("int").alias("slice"))
    return _numbered(placed)


def _cut(rows: DataFrame, shards: int) -> list[int]:
    """The smallest hash of each shard but the first; groups are read as ranges of hashes and split only near cuts."""
    # A unit is (leading bits as a number, how many bits); units lie in the order of their first hash.
    got = rows.groupBy(_prefix(F.col("h"), PREFIX_BITS).alias("p")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")).collect()
    units = [(r["first"], r["last"], r["size"], PREFIX_BITS) for r in got]
    while True:
        units.sort()
        sizes = np.array([u[2] for u in units], np.int64)
        whole = np.array([u[0] == u[1] for u in units], bool)
        if not len(sizes):
            return []
        high = smallest_capacity(sizes, shards)
        low = -(-int(sizes.sum()) // shards)
        if whole.all() or (high > low and not _divisible_need(sizes, whole, high - 1, shards)):
            break
        bottom = low
        top = high
        while bottom < top:  # the least capacity that splitting could still reach
            mid = (bottom + top) // 2
            if _divisible_need(sizes, whole, mid, shards):
                top = mid
            else:
                bottom = mid + 1
        near = _near_cuts(sizes, whole, bottom, high, shards)
        if not near.any():
            break
        units = [u for u, x in zip(units, near) if not x] + _split(rows, [u for u, x in zip(units, near) if x])
    ends = balanced_cuts(sizes, high, shards)
    return [units[e][0] for e in ends[:-1] if e < len(units)]


def _split(rows: DataFrame, units: list[tuple]) -> list[tuple]:
    """The units that lie inside the given ones, by SPLIT_BITS more of the hash."""
    out = []
    spark = rows.sparkSession
    for bits in sorted({u[3] for u in units}):
        ranges = spark.createDataFrame([(int(_lead(u[0], bits)),) for u in units if u[3] == bits], "q long")
        more = min(64, bits + SPLIT_BITS)
        inside = rows.withColumn("q", _prefix(F.col("h"), bits)).join(F.broadcast(ranges), "q", "left_semi")
        for r in inside.groupBy(_prefix(F.col("h"), more).alias("p")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")).collect():
            out.append((r["first"], r["last"], r["size"], more))
    return out


def _lead(h: int, bits: int) -> int:
    lead = ((h + (1 << 63)) & ((1 << 64) - 1)) >> (64 - bits)
    return lead if lead < 1 << 63 else lead - (1 << 64)


def _numbered(placed: DataFrame) -> DataFrame:
    """Slots from 0 without gaps in each shard: counts by (shard, slice) give each slice its first slot."""
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "slice").count()
    first = counts.select("shard", "slice", (F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("first"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")
    # `first` has at most SHARDS * SLICES rows. One shuffle of the documents serves the numbering and the join.
    numbered = placed.repartition("shard", "slice").withColumn("k", F.row_number().over(inside) - 1).join(first, ["shard", "slice"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def digest(docs: DataFrame) -> DataFrame:
    return assign(docs.select("doc_id", "text"))
