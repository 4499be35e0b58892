"""Sharding: minimax contiguous partition of atomic groups of equal texts, by binary search on the shard capacity."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_key, id_or_null, materialize, text_or_empty

SHARDS = 16
#: Hex digits of a group's key that one refinement looks at: 4096 children for a range that a cut can lie in.
STEP, DIGITS = 3, 15
#: Slices of a shard that are numbered apart.
SLICES = 1024


def group_key(text: Column) -> Column:
    """60 bits of the text's MD5: the order of groups, and their identity."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _cuts(parts: list[tuple], capacity: int) -> list[int] | None:
    """Greedy: parts are (low, high, size, atomic) in order; returns the key that each shard begins with."""
    out, filled = [], capacity + 1
    for low, _, size, *_ in parts:
        if size > capacity:
            return None
        if filled + size > capacity:
            out.append(low)
            filled = 0
        filled += size
    return out


def _feasible(parts, capacity: int, shards: int, split: bool) -> bool:
    """split: parts that hold several groups may be cut anywhere, which bounds the answer from below."""
    used, room = 1, capacity
    for _, _, size, atomic, *_ in parts:
        if atomic or not split:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        elif size > room:
            left = size - room
            more = -(-left // capacity)
            used, room = used + more, capacity * more - left
        else:
            room -= size
        if used > shards:
            return False
    return True


def _smallest(parts, shards: int, split: bool) -> int:
    low, high = 1, max(1, sum(p[2] for p in parts))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _feasible(parts, mid, shards, split) else (mid + 1, high)
    return low


def _doubtful(parts, shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Ranges of parts, one for each cut at most, in which cuts can lie for a capacity from low to high."""
    ends, total = [], 0
    for p in parts:
        total += p[2]
        ends.append(total)
    found: list[tuple[int, int]] = []
    early = late = 0  # the earliest and latest place of the current cut
    for _ in range(shards):
        first = bisect_right(ends, early + low)
        late += high
        last = min(bisect_right(ends, late), len(parts) - 1)
        if first >= len(parts):
            break
        if any(not p[3] for p in parts[first : last + 1]):
            if found and first <= found[-1][1] + 1:
                found[-1] = (found[-1][0], max(last, found[-1][1]))
            else:
                found.append((first, last))
        early = ends[first - 1] if first else 0
    return found


def minimax_bounds(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """First group key of each shard after the first: cuts of the smallest capacity that greedy filling can meet.

    groups holds (g long, size long), one row a group. The driver sees sums over key ranges only: 4096 at first, then
    the children of at most one range for each cut in which it can still lie, until the bounds of the capacity, one with ranges whole and
    one with ranges cut anywhere, leave no range of several groups in doubt. The result is exact.
    """

    def children(ranges: list[tuple[int, int]], depth: int) -> list[tuple[int, int, int, bool]]:
        keep = F.lit(not ranges)
        for a, b in ranges:
            keep = keep | F.col("g").between(a, b - 1)
        prefix = F.shiftright("g", 4 * (DIGITS - depth))
        rows = groups.filter(keep).groupBy(prefix.alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).collect()
        return sorted((r.low, r.high + 1, r.size, r.n == 1) for r in rows)

    parts, depth = children([], STEP), STEP
    while parts and depth < DIGITS:
        low, high = _smallest(parts, shards, True), _smallest(parts, shards, False)
        doubt = _doubtful(parts, shards, low, high)
        if not doubt:
            break
        depth += STEP
        finer = children([(parts[i][0], parts[j][1]) for i, j in doubt], depth)
        inside = {k for i, j in doubt for k in range(i, j + 1)}
        parts = sorted([p for k, p in enumerate(parts) if k not in inside] + finer)
    if not parts:
        return []
    return (_cuts(parts, _smallest(parts, shards, False)) or [])[1:]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every row into one of the shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: groups of equal texts are atomic, ordered by the MD5 of the text, and cut into contiguous shards of
    the smallest possible largest size. A row's size is its UTF-8 bytes plus 1 (null: 1, grouped with empty texts).
    slot numbers a shard's rows from 0 without gaps, by slice of the document's MD5, group and doc_id; repeated rows
    take neighbouring slots. An empty table gives none. Only DataFrame functions run; no text is moved.
    """
    text = text_or_empty()
    rows = docs.select(doc_key().alias("d"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(text).alias("g"))
    rows = materialize(rows, "rows")
    bounds = minimax_bounds(materialize(rows.groupBy("g").agg(F.sum("size").alias("size")), "groups"), shards)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("g") >= F.lit(b)).cast("int")
    slice_of = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("d").cast("string"), F.col("g").cast("string"))), 1, 7), 16, 10).cast("long") % SLICES
    placed = rows.withColumn("shard", shard).withColumn("slice", slice_of)
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))  # shards x SLICES rows
    inside = Window.partitionBy("shard", "slice").orderBy("g", "d", "text_crc32")
    out = placed.withColumn("k", F.row_number().over(inside)).join(starts, ["shard", "slice"])
    return out.select(id_or_null("d").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
