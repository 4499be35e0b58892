"""Streams of events: parsing, windowed counts with late data, and adjacency per entity kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value) per tumbling window; events later than `late` behind the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def entity_pairs(events: DataFrame) -> DataFrame:
    """(src, dst): consecutive events of a user, as they come; the last event of each user is the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = list(state.get) if state.exists else []
        ids = last + rows["event_id"].tolist()
        state.update((int(ids[-1]),))
        yield pd.DataFrame({"src": ids[:-1], "dst": ids[1:]}, dtype="int64")

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "src long, dst long", "last long", "append", GroupStateTimeout.NoTimeout)
