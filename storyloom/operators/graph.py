"""The property graph: canonical entity nodes and typed edges (star), one node per occurrence (chain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_uid
from ..functions.vocabulary import DEFAULT_AGENT_TYPE, EDGE_OF
from .candidates import ranked_occurrences
from .ordering import ahead, follows

_KIND_ORDER = ("actor", "patient", "whyfactor")


def entity_nodes(productions: DataFrame, agent_types: DataFrame | None = None) -> DataFrame:
    """(uid, label, name, entity_type, agent_type): a node per canonical id of actors, patients and reasons.

    Of several productions the first counts, actors before patients before reasons, then by (event_seq, ord). agent_types:
    (name, agent_type); agents without one are structural.
    """
    kind = F.lit(len(_KIND_ORDER))
    for i, k in enumerate(_KIND_ORDER):
        kind = F.when(F.col("entity_type") == k, i).otherwise(kind)
    rows = productions.filter(F.col("entity_type").isin(*_KIND_ORDER)).withColumn("uid", canonical_uid("entity_type", "entity_name"))
    first = rows.groupBy("uid").agg(F.min_by(F.struct("entity_name", "entity_type"), F.struct(kind, "event_seq", "ord", "entity_name")).alias("_p"))
    out = first.select("uid", F.when(F.col("_p.entity_type") == "whyfactor", "WhyFactor").otherwise("Agent").alias("label"), F.col("_p.entity_name").alias("name"), F.col("_p.entity_type").alias("entity_type"))
    if agent_types is not None:
        out = out.join(agent_types.select("name", "agent_type"), "name", "left")
    else:
        out = out.withColumn("agent_type", F.lit(None).cast("string"))
    return out.select("uid", "label", "name", "entity_type", F.coalesce("agent_type", F.lit(DEFAULT_AGENT_TYPE)).alias("agent_type"))


def nodes(events: DataFrame, productions: DataFrame, scenes: DataFrame, agent_types: DataFrame | None = None) -> DataFrame:
    """(uid, label, name) of all events, entities and scenes."""
    out = events.select(F.col("id").cast("string").alias("uid"), F.lit("Event").alias("label"), F.col("name").cast("string").alias("name"))
    out = out.unionByName(entity_nodes(productions, agent_types).select("uid", "label", "name"))
    return out.unionByName(scenes.select(F.col("scene").alias("uid"), F.lit("Scene").alias("label"), F.col("theme").alias("name")))


def entity_edges(productions: DataFrame, events: DataFrame) -> DataFrame:
    """(start, end, type, strength): canonical entities to their events. Places have no node, so HOSTS never appears."""
    kind = F.lit(None).cast("string")
    for k in _KIND_ORDER:
        kind = F.when(F.col("entity_type") == k, EDGE_OF[k]).otherwise(kind)
    rows = productions.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return rows.select(canonical_uid("entity_type", "entity_name").alias("start"), F.col("event_id").cast("string").alias("end"), kind.alias("type"), "strength").filter("type is not null")


def scene_edges(member: DataFrame, rollup: DataFrame) -> DataFrame:
    """(start, end, type): INCLUDES, HAS_PARTICIPANT, HAS_MOTIVATION."""
    out = member.select(F.col("scene").alias("start"), F.col("id").cast("string").alias("end"), F.lit("INCLUDES").alias("type"))
    who = rollup.select(F.col("scene").alias("start"), F.explode("participants").alias("n")).select("start", canonical_uid(F.lit("actor"), "n").alias("end"), F.lit("HAS_PARTICIPANT").alias("type"))
    why = rollup.select(F.col("scene").alias("start"), F.explode("reasons").alias("n")).select("start", canonical_uid(F.lit("whyfactor"), "n").alias("end"), F.lit("HAS_MOTIVATION").alias("type"))
    return out.unionByName(who.distinct()).unionByName(why.distinct())


def edges(events: DataFrame, productions: DataFrame, member: DataFrame, rollup: DataFrame, links: DataFrame) -> DataFrame:
    """(start, end, type) of the star graph: scene, entity, FOLLOWS and causal edges, the last by their relation."""
    out = scene_edges(member, rollup).unionByName(entity_edges(productions, events).select("start", "end", "type"))
    text = lambda c, n: F.col(c).cast("string").alias(n)
    out = out.unionByName(follows(events).select(text("src", "start"), text("dst", "end"), F.lit("FOLLOWS").alias("type")))
    return out.unionByName(links.select(text("src", "start"), text("dst", "end"), F.col("relation").alias("type")))


def chain_links(productions: DataFrame) -> DataFrame:
    """(start, next_event, type, strength): each occurrence of an entity points to the next event that holds the entity.

    productions: (event_id, event_seq, ord, entity_name, entity_type, strength). An event that holds an entity twice under
    one type counts as two occurrences; its last production gives the node and the strength.
    """
    kind = F.lit(None).cast("string")
    for k in _KIND_ORDER:
        kind = F.when(F.col("entity_type") == k, EDGE_OF[k]).otherwise(kind)
    name = F.btrim(F.lower("entity_name"))
    rows = productions.filter(F.col("entity_type").isin(*_KIND_ORDER)).select(F.concat_ws(":", F.col("entity_type"), name).alias("key"), F.col("event_id").alias("id"), F.col("event_seq").alias("seq"), "ord", kind.alias("type"), "strength")
    last = rows.groupBy("key", "id").agg(F.max_by("strength", "ord").alias("strength"))
    out = ahead(ranked_occurrences(rows.drop("strength")), ["key"], "occ", F.col("id"), range(1, 2), "_next")
    out = out.withColumn("next_event", F.get("_next", F.lit(0))).filter("next_event is not null").join(last, ["key", "id"])
    return out.select(F.concat_ws("@", "key", F.col("id").cast("string")).alias("start"), "next_event", "type", "strength")


def expanded_semantic_links(links: DataFrame) -> DataFrame:
    """(src, dst, type): every source of a link with each of its targets; links: (sources, targets, type)."""
    return links.select(F.explode("sources").alias("src"), "targets", "type").select("src", F.explode("targets").alias("dst"), "type").filter("src <> dst")


def causal_assertions(links: DataFrame) -> DataFrame:
    """Reified links: (start, end, type) with a node for each link, CAUSE from its source and EFFECT to its target."""
    uid = F.concat_ws("__", F.lit("assertion"), F.col("src").cast("string"), F.col("dst").cast("string"))
    return links.select(F.explode(F.array(F.struct(F.col("src").cast("string").alias("start"), uid.alias("end"), F.lit("CAUSE").alias("type")), F.struct(uid.alias("start"), F.col("dst").cast("string").alias("end"), F.lit("EFFECT").alias("type")))).alias("e")).select("e.*")


def chain_nodes(events: DataFrame, productions: DataFrame, scenes: DataFrame) -> DataFrame:
    """(uid, label, name) of the chain graph: entities have a node for each event that holds them, `type:name@event`.

    Of several productions of one node the last by ord gives its name.
    """
    out = events.select(F.col("id").cast("string").alias("uid"), F.lit("Event").alias("label"), F.col("name").cast("string").alias("name"))
    label = F.when(F.col("entity_type") == "whyfactor", "WhyFactor").otherwise("Agent").alias("label")
    own = productions.filter(F.col("entity_type").isin(*_KIND_ORDER)).select(_occurrence_uid().alias("uid"), label, "entity_name", "ord")
    out = out.unionByName(own.groupBy("uid", "label").agg(F.max_by("entity_name", "ord").alias("name")))
    return out.unionByName(scenes.select(F.col("scene").alias("uid"), F.lit("Scene").alias("label"), F.col("theme").alias("name")))


def _occurrence_uid() -> Column:
    return F.concat(F.col("entity_type"), F.lit(":"), F.btrim(F.lower("entity_name")), F.lit("@"), F.col("event_id").cast("string"))


def chain_edges(events: DataFrame, productions: DataFrame, member: DataFrame, links: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(start, end, type) of the chain graph: INCLUDES of scenes, PRODUCES from events to their entities, entities to the
    next event that holds them, FOLLOWS inside a chapter, causal links by their relation, and semantic links between known
    events."""
    text = lambda c, n: F.col(c).cast("string").alias(n)
    fixed = lambda df, a, b, kind: df.select(text(a, "start"), text(b, "end"), kind.alias("type"))
    known = events.select("id")
    out = fixed(member.join(known, "id", "left_semi"), "scene", "id", F.lit("INCLUDES"))
    own = productions.filter(F.col("entity_type").isin(*_KIND_ORDER)).withColumn("uid", _occurrence_uid())
    out = out.unionByName(fixed(own, "event_id", "uid", F.lit("PRODUCES")))
    out = out.unionByName(fixed(chain_links(productions), "start", "next_event", F.col("type")))
    out = out.unionByName(fixed(follows(events), "src", "dst", F.lit("FOLLOWS")))
    out = out.unionByName(fixed(links, "src", "dst", F.col("relation")))
    if semantic is not None:
        both = semantic.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        out = out.unionByName(fixed(both, "src", "dst", F.upper("type")))
    return out
