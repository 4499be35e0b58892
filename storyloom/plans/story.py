"""A whole run: text or answers to the property graph, stage by stage over checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_uid, natural_id
from ..functions.text import chapters, chunks, passages
from ..operators import bm25, candidates, causal, context, graph, parsing, scenes, themes
from ..operators import similarity as like_pairs
from ..operators.assess import Assessor, agent_types, failures
from ..operators.ordering import follows, ranked
from ..runtime import materialize
from ..sources.readers import Settings
from .stages import Checkpoints


@dataclass
class Assessors:
    """What a model answers at each stage.

    events: chunks (chapter, chunk, text) get `answer`, JSON of events, and may get `status`; scenes: events get (scene,
    theme), null for none; pairs: candidate pairs (src, dst, gap, src_text, dst_text, context) get (relation, theory,
    mechanism, weight, confidence, ord); themes: (id, theme) rows get (involvement, role, confidence); agents: names (name)
    get `agent_type`; vectors: texts (text) get `vec`, array of double. Without agents all are structural, without vectors
    proximity stands in for similarity and pairs have no context.
    """

    events: Assessor
    scenes: Assessor
    pairs: Assessor
    themes: Assessor
    agents: Assessor | None = None
    vectors: Assessor | None = None


#: Characters of a text in a pair, in a prompt's context, and of what is embedded; passages of a pair; failed share of chunks at
#: which a run stops.
PAIR_TEXT, CONTEXT_TEXT, EMBED_TEXT, CONTEXT, MOST_FAILED = 150, 250, 200, 2, 0.3


def split_text(texts: DataFrame, size: int = 600, max_chapters: int | None = None) -> DataFrame:
    """(chapter, chunk, text) from one row (text)."""
    rows = texts.select(F.explode(chapters("text")).alias("c")).select(F.col("c.number").alias("chapter"), F.col("c.body").alias("body"))
    rows = rows.filter(F.col("chapter") <= max_chapters) if max_chapters else rows
    return rows.select("chapter", F.posexplode(chunks("body", size)).alias("chunk", "text"))


def candidate_pools(order: DataFrame, occurrences: DataFrame, members: DataFrame, vectors: DataFrame | None, similarity: float) -> dict[str, DataFrame]:
    """Pools of a run by name: local ones, BM25 over descriptions, and events of like meaning.

    order: (id, seq, chapter, text); members: (scene, id); vectors: (id, seq, vec). Where there are no vectors, or
    neither similarity pool finds a pair, events near each other stand in.
    """
    pools = {"adjacent": candidates.adjacent_pairs(order), "window": candidates.window_pairs(order), "entity": candidates.entity_pairs(occurrences)}
    place = order.select("seq", "id")

    def named(pairs: DataFrame) -> DataFrame:  # blocks of numbers hold places, not ids of any type
        return pairs.join(place.toDF("src", "_a"), "src").join(place.toDF("dst", "_b"), "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))

    pools["bm25"] = named(bm25.bm25_pairs(order.select(F.col("seq").alias("id"), "seq", "text")))
    inside = members.select("scene", "id").join(order.select("id", "seq"), "id")
    if vectors is not None:
        like = vectors.join(members.select("id", "scene").distinct(), "id").withColumn("id", F.col("seq"))
        scene = materialize(named(like_pairs.scene_pairs(like, similarity).select("src", "dst").distinct()), "scene-pool")
        far = materialize(named(like_pairs.longshot_pairs(vectors.withColumn("id", F.col("seq")), similarity).select("src", "dst")), "longshot-pool")
        if scene.limit(1).count() or far.limit(1).count():
            return pools | {"scene": scene, "longshot": far}
    return pools | {"proximity": candidates.proximity_pairs(order, inside)}


def pair_context(pairs: DataFrame, events: DataFrame, vectors: DataFrame | None, passage_rows: DataFrame | None) -> DataFrame:
    """pairs with the texts of both events, and the passages nearest to the earlier one as `context`.

    passage_rows: (id, seq, text, vec).
    """
    text = events.select("id", F.substring("description", 1, PAIR_TEXT).alias("text"))
    out = pairs.join(text.toDF("src", "src_text"), "src", "left").join(text.toDF("dst", "dst_text"), "dst", "left")
    if vectors is None or passage_rows is None:
        return out.withColumn("context", F.array().cast("array<string>"))
    asked = vectors.join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    near = like_pairs.passage_topk(asked.withColumn("id", F.col("seq")), passage_rows.select("id", "seq", "vec"), CONTEXT, same_ids=True)
    near = near.join(passage_rows.select(F.col("id").alias("passage"), F.substring("text", 1, CONTEXT_TEXT).alias("found")), "passage")
    near = near.join(asked.select(F.col("seq").alias("query"), F.col("id").alias("src")), "query").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "found"))).alias("_c"))
    return out.join(near, "src", "left").withColumn("context", F.coalesce(F.transform("_c", lambda c: c["found"]), F.array().cast("array<string>"))).drop("_c")


def story_graph(texts: DataFrame, ask: Assessors, store: Checkpoints, settings: Settings | None = None, resume: bool = True) -> dict[str, DataFrame]:
    """All tables of the graph: events, productions, members, rollup, links, notes, nodes, edges."""
    settings, spark = settings or Settings(), texts.sparkSession
    pieces = store.stage("text_split", lambda: split_text(texts), resume)

    def extract() -> DataFrame:
        answered = materialize(ask.events.assess(pieces), "answers")
        if "status" in answered.columns and (lost := failures(answered).first()).rate > MOST_FAILED:
            raise RuntimeError(f"{lost.failed} of {lost.rows} chunks have no answer: {lost.error}")
        found = parsing.parse_events(answered.select("chapter", "chunk", "answer"))
        return found.withColumn("id", natural_id("event", "chapter", "seq"))

    events = store.stage("extraction", extract, resume)

    def propagate() -> DataFrame:
        own = parsing.productions_of(events)
        order = events.select("id", "seq")
        more = context.propagate_actors(order, own).unionByName(context.propagate_reasons(order, own)).drop("anchor")
        more = more.join(order.select(F.col("id").alias("event_id"), F.col("seq").alias("event_seq")), "event_id").withColumn("ord", F.lit(1 << 20))
        return own.unionByName(more.select(*own.columns)).withColumn("entity_id", canonical_uid("entity_type", "entity_name"))

    productions = store.stage("context_propagation", propagate, resume)
    events = context.fill_context(events)

    def classify() -> DataFrame:
        names = productions.filter(F.col("entity_type").isin("actor", "patient")).select(F.col("entity_name").alias("name")).distinct()
        answers = ask.agents.assess(names).select("name", "agent_type") if ask.agents else names.withColumn("agent_type", F.lit(None).cast("string"))
        return agent_types(names, answers)

    agents = store.stage("agent_classification", classify, resume)

    def scene() -> DataFrame:
        proposed = ask.scenes.assess(events).filter("scene is not null").select("scene", "chapter", "id", "seq")
        order = proposed.groupBy("scene", "chapter").agg(F.min("seq").alias("scene_ord"))
        member = scenes.members(proposed.join(order, ["scene", "chapter"]), events)
        rest = scenes.orphans(events, member).select(F.concat(F.lit("scene/"), F.col("chapter").cast("string"), F.lit("/rest")).alias("scene"), F.lit(1 << 40).alias("scene_ord"), "chapter", "id")
        return member.withColumn("scene_ord", F.col("scene_ord").cast("long")).unionByName(rest)

    member = store.stage("scenes", scene, resume)
    rollup = scenes.rollup(member, events, productions)

    def link() -> DataFrame:
        order = events.select("id", "seq", "chapter", F.col("description").alias("text"))
        vectors = found = None
        if ask.vectors:
            cut = F.substring("text", 1, EMBED_TEXT).alias("text")
            vectors = materialize(ask.vectors.assess(order.select("id", "seq", cut)).select("id", "seq", "vec"), "vectors")
            parts = pieces.select("chapter", "chunk", F.posexplode(passages("text")).alias("part", "text"))
            parts = ranked(parts, [], ["chapter", "chunk", "part"], F.col("chapter"), "seq").select("seq", F.col("seq").alias("id"), "text")
            found = materialize(ask.vectors.assess(parts).select("id", "seq", "text", "vec"), "passages")
        pools = candidate_pools(order, parsing.occurrences(productions), member, vectors, settings.similarity)
        pairs = candidates.priority_cap(candidates.with_gap(candidates.pooled(pools), order), list(pools), settings.max_pairs)
        asked = pair_context(pairs.select("src", "dst", "gap"), events, vectors, found)
        judged = causal.valid_assessments(ask.pairs.assess(asked).drop("src_text", "dst_text", "context"), causal.relation_types(spark))
        return causal.with_supertype(causal.admit(judged, order))

    links = store.stage("linking", link, resume)

    def note() -> DataFrame:
        every = events.select("id", F.explode(F.array(*(F.lit(t) for t in themes.THEMES))).alias("theme"))
        return themes.bridged(themes.cleaned(ask.themes.assess(every)), links)

    notes = store.stage("theme_annotation", note, resume)
    named = events.withColumn("name", F.col("description"))
    table = rollup.select("scene", F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("theme"))
    return {
        "events": events, "productions": productions, "members": member, "rollup": rollup, "links": links, "notes": notes, "follows": follows(events), "agents": agents,
        "nodes": graph.nodes(named, productions, table, agents), "edges": graph.edges(events, productions, member, rollup, links),
    }


def run_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): rows of each table."""
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in tables.items()]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
