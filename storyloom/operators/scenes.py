"""Scenes: membership, rollups, catch-all scenes for orphans, the last scene of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORPHAN_CONFIDENCE = 0.5


def listed(proposed: DataFrame) -> DataFrame:
    """Memberships of scenes that come with an array `ids`."""
    return proposed.select("scene", "scene_ord", "chapter", F.explode("ids").alias("id"))


def members(proposed: DataFrame, events: DataFrame) -> DataFrame:
    """(scene, scene_ord, chapter, id): proposed memberships, each once, whose event exists in the scene's chapter.

    Scenes without any such event vanish.
    """
    rows = proposed.select("scene", "scene_ord", "chapter", "id").distinct()
    return rows.join(events.select("id", "chapter"), ["id", "chapter"], "left_semi").select("scene", "scene_ord", "chapter", "id")


def rollup(member: DataFrame, events: DataFrame, productions: DataFrame) -> DataFrame:
    """One row per scene: chapter, n_events, actors, patients, reasons, participants (sorted, distinct), location, time.

    Location and time are the smallest ones that are not missing. Productions should hold the inherited ones too.
    """
    rows = member.join(events.select("id", F.nullif("location", F.lit("")).alias("location"), F.nullif("time", F.lit("")).alias("time")), "id")
    base = rows.groupBy("scene", "chapter").agg(F.count("*").alias("n_events"), F.min("location").alias("location"), F.min("time").alias("time"))
    names = member.select("scene", "id").join(productions.select(F.col("event_id").alias("id"), "entity_type", "entity_name"), "id").select("scene", "entity_type", "entity_name").distinct()
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("entity_type").isin(*kinds), F.col("entity_name"))))
    sets = names.groupBy("scene").agg(of("actor").alias("actors"), of("patient").alias("patients"), of("whyfactor").alias("reasons"), of("actor", "patient").alias("participants"))
    empty = F.array().cast("array<string>")
    return base.join(sets, "scene", "left").select("scene", "chapter", "n_events", "location", "time", *(F.coalesce(c, empty).alias(c) for c in ("actors", "patients", "reasons", "participants")))


def orphans(events: DataFrame, member: DataFrame) -> DataFrame:
    return events.join(member.select("id"), "id", "left_anti")


def orphan_scenes(events: DataFrame, member: DataFrame) -> DataFrame:
    """A catch-all scene for each chapter with events in no scene."""
    out = orphans(events, member).groupBy("chapter").agg(F.count("*").alias("n_events"), F.min("id").alias("first_id"))
    theme = F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit(" events"))
    return out.select("chapter", "n_events", "first_id", theme.alias("theme"), F.lit(ORPHAN_CONFIDENCE).alias("confidence"))


def last_scene(member: DataFrame) -> DataFrame:
    """(id, scene): the last scene in scene order that holds the event."""
    return member.groupBy("id").agg(F.max_by("scene", F.struct("scene_ord", "scene")).alias("scene"))


def stitched(member: DataFrame, events: DataFrame) -> DataFrame:
    """(scene, src, dst): neighbours in a scene, by seq: PRECEDES edges."""
    rows = member.select("scene", "id").join(events.select("id", "seq"), "id")
    w = Window.partitionBy("scene").orderBy("seq", "id")
    return rows.select("scene", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).filter("dst is not null")
