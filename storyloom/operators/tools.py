"""Ontology terms, why-factor scores, verb actions, because-links, and the consolidated tables for viewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

TERM_BATCH = 300


def ontology_term(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.upper(F.btrim(c)), F.lit(" "), F.lit("_"))


def ontology_terms(raw: DataFrame, size: int = TERM_BATCH) -> DataFrame:
    """(term, rank, batch): distinct normalised terms in order, in batches for consolidation. A vocabulary is small."""
    from pyspark.sql.window import Window

    terms = raw.select(ontology_term("term").alias("term")).filter("term <> ''").distinct()
    rank = (F.row_number().over(Window.orderBy("term")) - 1).cast("long")
    return terms.withColumn("rank", rank).withColumn("batch", F.floor(F.col("rank") / size).cast("long"))


def sub_target(goal: int, n_batches: int) -> int:
    """Terms that each batch is asked for."""
    return max(20, goal // max(1, n_batches))


def why_factors(texts: DataFrame) -> DataFrame:
    """(id, category, weight) from (id, text): categories whose words occur in the text, as shares of 1, 3 digits.

    Each word that the text holds anywhere scores 1 / (1 + |length - 4|); a category's weight lies in its range by its
    share of the score. A text without any is contextual with its base weight.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    score = {c: reduce(lambda a, b: a + b, (F.when(low.contains(w), 1.0 / (1 + abs(len(w) - 4))).otherwise(0.0) for w in words)) for c, words in V.WHY_LEXICON.items()}
    rows = texts.select("id", F.array(*(F.struct(F.lit(c).alias("category"), s.alias("score")) for c, s in score.items())).alias("s"))
    rows = rows.withColumn("s", F.filter("s", lambda x: x["score"] > 0)).withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"]))
    low_of, high_of = (F.create_map(*(F.lit(y) for c, r in V.WHY_RANGES.items() for y in (c, r[i]))) for i in (0, 1))
    weighted = F.transform("s", lambda x: F.struct(x["category"].alias("category"), F.round(low_of[x["category"]] + (high_of[x["category"]] - low_of[x["category"]]) * (x["score"] / F.col("total")), 3).alias("w")))
    rows = rows.select("id", F.when(F.size("s") > 0, weighted).otherwise(F.array(F.struct(F.lit("Contextual Cause").alias("category"), F.lit(V.WHY_BASE["Contextual Cause"]).alias("w")))).alias("s"), (F.size("s") > 0).alias("any"))
    rows = rows.withColumn("sum", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]))
    return rows.select("id", F.explode("s").alias("x"), "any", "sum").select("id", "x.category", F.when(F.col("any"), F.round(F.col("x.w") / F.col("sum"), 3)).otherwise(F.col("x.w")).alias("weight"))


def verb_action(c: Column | str) -> Column:
    """The controlled action of a verb, null if there is none."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.create_map(*(F.lit(x) for kv in V.VERB_ACTIONS.items() for x in kv))[c]


def because_links(events: DataFrame, word: str = "because") -> DataFrame:
    """(cause, effect, weight, confidence): an event whose text holds `word` with the latest other event of its chapter whose
    actor has the same first word. events: (id, seq, chapter, actor, text, confidence).

    The weight is the product of both confidences, the confidence 0.8 of the smaller one. The two latest events of a
    (chapter, actor) are all that is needed, so nothing is joined with a whole group.
    """
    rows = events.withColumn("first", F.get(F.split(F.lower(F.btrim("actor")), r"\s+"), F.lit(0))).filter("first <> ''")
    latest = rows.groupBy("chapter", "first").agg(F.max_by(F.struct("id", "seq", "confidence"), "seq").alias("top"))
    second = rows.join(latest, ["chapter", "first"]).filter("id <> top.id").groupBy("chapter", "first").agg(F.max_by(F.struct("id", "seq", "confidence"), "seq").alias("next"))
    both = latest.join(second, ["chapter", "first"], "left")
    effect = rows.filter(F.lower("text").contains(word)).join(both, ["chapter", "first"])
    other = F.when(F.col("id") != F.col("top.id"), F.col("top")).otherwise(F.col("next"))
    out = effect.withColumn("c", other).filter("c is not null")
    return out.select(F.col("c.id").alias("cause"), F.col("id").alias("effect"), F.round(F.col("c.confidence") * F.col("confidence"), 4).alias("weight"), F.round(0.8 * F.least("c.confidence", "confidence"), 4).alias("confidence"))


def consolidated_nodes(tables: list[tuple[str, DataFrame]], event_scene: DataFrame) -> DataFrame:
    """(id, label, type, group, scene_name, size): node tables (type, (id, label, group)) as one, the first table wins an id.

    event_scene: (id, scene_name). Events are small, other nodes are hubs.
    """
    parts = [df.select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.lit(kind).alias("type"), F.col("group").cast("string").alias("group"), F.lit(i).alias("_t")) for i, (kind, df) in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy("id").agg(F.min_by(F.struct("label", "type", "group"), F.struct("_t", "label")).alias("n")).select("id", "n.*")
    out = first.join(event_scene.select(F.col("id").cast("string").alias("id"), "scene_name"), "id", "left")
    event = F.col("type") == "Event"
    return out.select("id", "label", "type", F.when(event, F.coalesce("group", F.lit("Uncategorized Event"))).otherwise(F.col("type")).alias("group"), F.when(event, F.coalesce("scene_name", F.lit("No Scene"))).otherwise("N/A").alias("scene_name"), F.when(event, 1).otherwise(15).alias("size"))


def consolidated_edges(tables: list[DataFrame]) -> DataFrame:
    """(source, target) of all edge tables (start, end), one after the other."""
    return reduce(DataFrame.unionByName, [t.select(F.col("start").cast("string").alias("source"), F.col("end").cast("string").alias("target")) for t in tables])


def default_ontology(spark: SparkSession) -> DataFrame:
    """(kind, name, theory) of the built-in types."""
    rows = [("event", n, "@McKee") for n in V.EVENT_TYPES] + [("relation", n, t) for t, ns in V.RELATION_TYPES.items() for n in ns] + [("agent", n, "@McKee") for n in V.AGENT_TYPES]
    return spark.createDataFrame(rows, "kind string, name string, theory string")
