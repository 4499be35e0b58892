"""Context carried forward along the sequence: places and times, actor sets, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import missing_as_null
from .ordering import BLOCK, filled

#: Strength of what is inherited.
INHERITED, PLACED = 0.5, 0.8


def fill_context(events: DataFrame, columns: tuple[str, ...] = ("location", "time"), size: int = BLOCK) -> DataFrame:
    """events whose missing (null or empty) context is the last one seen before, over the whole order and chapters.

    What is missing from the start stays as it was.
    """
    rows = events.withColumns({f"_{c}": missing_as_null(c) for c in columns})
    rows = filled(rows, "seq", [f"_{c}" for c in columns], size)
    return rows.select(*(F.coalesce(f"_{c}_filled", c).alias(c) if c in columns else F.col(c) for c in events.columns))


def _anchors(events: DataFrame, productions: DataFrame, own: Column, blocked: Column, size: int) -> DataFrame:
    """(id, anchor): events without a production of the class, and the last event before them that has one."""
    has = productions.groupBy(F.col("event_id").alias("_e")).agg(F.max(own.cast("int")).alias("_own"), F.max(blocked.cast("int")).alias("_blocked"))
    rows = events.select("id", "seq").join(has, F.col("id") == F.col("_e"), "left")
    rows = rows.select("id", "seq", F.when(F.col("_own") == 1, F.col("id")).alias("anchor"), (F.coalesce("_blocked", F.lit(0)) == 1).alias("_stop"))
    return filled(rows, "seq", ["anchor"], size).filter("anchor is null and not _stop and anchor_filled is not null").select("id", F.col("anchor_filled").alias("anchor"))


def propagate_actors(events: DataFrame, productions: DataFrame, size: int = BLOCK) -> DataFrame:
    """Productions that events without any actor or patient inherit from the last event with one.

    productions: (event_id, ord, entity_name, entity_type, strength). Of names that differ in case only the last one
    counts. Strength is INHERITED. Inherited rows are no source of further ones.
    """
    acts = F.col("entity_type").isin("actor", "patient")
    anchors = _anchors(events, productions, acts, acts, size)
    source = productions.filter(acts).groupBy("event_id", F.lower("entity_name").alias("_name")).agg(F.max_by(F.struct("entity_name", "entity_type"), "ord").alias("_p"))
    out = anchors.join(source, F.col("anchor") == F.col("event_id"))
    return out.select(F.col("id").alias("event_id"), F.col("_p.entity_name").alias("entity_name"), F.col("_p.entity_type").alias("entity_type"), F.lit(INHERITED).alias("strength"), "anchor")


def propagate_reasons(events: DataFrame, productions: DataFrame, size: int = BLOCK) -> DataFrame:
    """The same for reasons: every one of the anchor's, with its own strength."""
    why = F.col("entity_type") == "whyfactor"
    anchors = _anchors(events, productions, why, why, size)
    out = anchors.join(productions.filter(why).drop("ord"), F.col("anchor") == F.col("event_id"))
    return out.select(F.col("id").alias("event_id"), "entity_name", "entity_type", "strength", "anchor")


def propagate_places(events: DataFrame, size: int = BLOCK) -> DataFrame:
    """(event_id, entity_name, entity_type, strength): a place production per event: its own at PLACED, else the last one at INHERITED."""
    rows = filled(events.select("id", "seq", missing_as_null("location").alias("place")), "seq", ["place"], size).filter("place_filled is not null")
    return rows.select(F.col("id").alias("event_id"), F.col("place_filled").alias("entity_name"), F.lit("place").alias("entity_type"), F.when(F.col("place").isNotNull(), PLACED).otherwise(INHERITED).alias("strength"))


def resolve_pronouns(mentions: DataFrame, is_pronoun: Column, size: int = BLOCK) -> DataFrame:
    """mentions (id, seq, name) with `resolved`: for a pronoun the last name before it, else the name."""
    rows = filled(mentions.withColumn("_own", F.when(~is_pronoun, F.col("name"))), "seq", ["_own"], size)
    return rows.withColumn("resolved", F.col("_own_filled")).drop("_own", "_own_filled")
