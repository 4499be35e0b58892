"""Ordered data without a single sorting task: ranks by prefix sums over blocks, look-ahead by halos, fill by carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block that one window partition holds, and of a task where their number is known.
BLOCK, ROWS = 8192, 1 << 18


def spread(df: DataFrame, rows: int | None, by: list[str]) -> DataFrame:
    """df dealt by columns to tasks of about ROWS of its rows, which Spark doesn't merge; as it is where their number is not known."""
    return df if rows is None else df.repartition(max(1, -(-rows // ROWS)), *by)


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], block: Column, name: str, n: int | None = None) -> DataFrame:
    """df and `name`: the 0-based rank (long) of each row among the rows of its keys.

    block must not fall as order rises. Rows are numbered inside (keys, block) and shifted by the count of the keys'
    earlier blocks, so a hot key, or no key at all, is dealt over its blocks; only counts meet in one place. Rows that
    tie in the order take neighbouring ranks. n: how many rows there are, if known.
    """
    rows = spread(df.withColumn("_block", block).withColumn("_at", F.struct(*keys, "_block")), n, ["_at"])  # a struct of nulls is equal to itself
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_at").agg(F.count("*").alias("_n")).select("_at", "_at.*", "_n")
    starts = starts.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_at").orderBy(*order)
    out = rows.withColumn("_k", F.row_number().over(inside)).join(spread(starts, n, ["_at"]), "_at")
    return out.select(*df.columns, (F.col("_start") + F.col("_k") - 1).cast("long").alias(name))


def ahead(df: DataFrame, keys: list[str], rank: str, value: Column | str, offsets: range, name: str = "next", size: int = BLOCK, n: int | None = None) -> DataFrame:
    """df and `name`: an array of `value` at the given offsets (1 or more) ahead by rank within keys, null beyond the end.

    Blocks of `size` ranks are windows of their own; the first rows of a block are sent to the block before it as well. n: how
    many rows there are, if known.
    """
    reach = offsets[-1]
    home = F.floor(F.col(rank) / size).cast("long")
    halo = F.when((F.col(rank) % size < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    rows = df.withColumn("_home", home).withColumn("_value", F.col(value) if isinstance(value, str) else value)
    rows = spread(rows.withColumn("_block", F.explode(halo)), n, [*keys, "_block"])
    w = Window.partitionBy(*keys, "_block").orderBy(rank)
    rows = rows.withColumn(name, F.array(*(F.lead("_value", k).over(w) for k in offsets)))
    return rows.filter("_block = _home").drop("_home", "_value", "_block")


def filled(df: DataFrame, rank: str, values: list[str], size: int = BLOCK) -> DataFrame:
    """df and, for each of values, `<value>_filled`: its last value that is not null, at or before the row by rank.

    Inside blocks of `size` ranks by a window; what a block inherits is carried over from one row per block.
    """
    rows = df.withColumn("_block", F.floor(F.col(rank) / size).cast("long"))
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(rank))).alias(f"_{v}") for v in values]
    blocks = rows.groupBy("_block").agg(*last)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", *(F.last(f"_{v}", ignorenulls=True).over(before).alias(f"_{v}") for v in values))
    w = Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", *(F.last(v, ignorenulls=True).over(w).alias(f"{v}_here") for v in values)).join(carried, "_block")
    return out.select(*df.columns, *(F.coalesce(f"{v}_here", f"_{v}").alias(f"{v}_filled") for v in values))


def adjacent(events: DataFrame, rank: str = "seq", size: int = BLOCK) -> DataFrame:
    """events with the struct `after` of the next event's id and chapter, null for the last one."""
    out = ahead(events, [], rank, F.struct("id", "chapter"), range(1, 2), "after", size)
    return out.withColumn("after", F.get("after", F.lit(0)))


def follows(events: DataFrame, size: int = BLOCK) -> DataFrame:
    """(src, dst): consecutive events of the whole order that lie in one chapter."""
    return adjacent(events, size=size).filter("chapter = after.chapter").select(F.col("id").alias("src"), F.col("after.id").alias("dst"))
