"""The driver's tables read as stories: what stands for events, turns, vectors, productions, scenes, links and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import ROLES, THEMES
from ..operators import candidates, causal, scenes
from ..operators.assess import RuleBased
from ..operators.ordering import ranked
from ..runtime import materialize


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(index, values) -> F.Column:
    """values[index] of a constant list; None is null."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), index.cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, chapter, user_id, event_type, value, k, location, time): the day is the chapter; context has gaps."""
    rows = load(spark, sf_dir, "events")
    rows = ranked(rows, [], ["ts", "event_id"], F.date_trunc("hour", "ts"), "seq", rows.count())
    location = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "view", F.col("event_type"))
    hour = F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 != 1, F.concat(F.lit("h"), F.hour("ts").cast("string")))
    return rows.select(F.col("event_id").alias("id"), "seq", F.unix_date(F.to_date("ts")).cast("long").alias("chapter"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"), location.alias("location"), hour.alias("time"))


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, chapter, user_id, event_type)."""
    return events(spark, sf_dir).select("id", "seq", "chapter", "user_id", "event_type")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, chapter, turn, role, text, confidence, actors, patients, reasons): turns of conversations as events."""
    rows = ranked(load(spark, sf_dir, "conversations"), [], ["conv_id", "turn", "role", "text"], F.floor(F.col("conv_id") / 64), "seq")
    none = F.array().cast("array<string>")
    conf = F.round((F.char_length("text") % 100) / 100, 2)
    return rows.select(F.col("seq").alias("id"), "seq", F.col("conv_id").alias("chapter"), "turn", "role", "text", conf.alias("confidence"), F.array("role").alias("actors"), none.alias("patients"), F.when(F.col("seq") % 3 == 0, F.array(F.lit("why"))).otherwise(none).alias("reasons"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, scene, vec)."""
    rows = ranked(load(spark, sf_dir, "embeddings"), [], ["vec_id"], F.floor(F.col("vec_id") / 4096), "seq")
    return rows.select(F.col("vec_id").alias("id"), "seq", F.col("label").cast("string").alias("scene"), F.col("embedding").cast("array<double>").alias("vec"))


def occurrences(rows: DataFrame, column: str) -> DataFrame:
    """(key, id, seq) of one actor per event."""
    return rows.select(F.concat(F.lit("actor:"), F.col(column).cast("string")).alias("key"), "id", "seq")


def productions(ev: DataFrame) -> DataFrame:
    """(event_id, event_seq, ord, entity_name, entity_type, strength, text): up to four per event, none for many."""
    entry = lambda cond, name, kind, strength: F.when(cond, F.struct(name.alias("entity_name"), F.lit(kind).alias("entity_type"), F.lit(strength).alias("strength")))
    i, user = F.col("id"), F.col("user_id").cast("string")
    patient = F.when(i % 2 == 0, F.concat(F.lit("u"), user)).otherwise(F.concat(F.lit("V"), (F.col("user_id") % 10).cast("string")))
    four = [
        entry(i % 3 != 0, F.concat(F.lit("U"), user), "actor", 0.9),
        entry(i % 5 == 0, patient, "patient", 0.8),
        entry(i % 4 == 1, F.concat(F.col("event_type"), F.lit(' "urge": '), (F.col("user_id") % 3).cast("string")), "whyfactor", 0.7),
        entry(i % 8 == 1, F.concat(F.lit("k"), F.col("k")), "whyfactor", 0.6),
    ]
    rows = ev.select(i.alias("event_id"), F.col("seq").alias("event_seq"), F.concat_ws(" ", "event_type", i.cast("string")).alias("text"), F.posexplode(F.array(*four)).alias("ord", "p"))
    return rows.filter("p is not null").select("event_id", "event_seq", F.col("ord").cast("long").alias("ord"), "p.*", "text")


def pool_names() -> list[str]:
    return ["adjacent", "window", "entity", "scene", "longshot"]


def local_pools(ev: DataFrame) -> dict[str, DataFrame]:
    return {"adjacent": candidates.adjacent_pairs(ev), "window": candidates.window_pairs(ev), "entity": candidates.entity_pairs(occurrences(ev, "user_id"))}


#: Assessments of an event, about.
LINKS = 8

# Answers of a stand-in for a model, by a rule on the ids.
MCKEE = ("DIRECT_CAUSE", "enables", "PREVENTS", "TRIGGERS", "MOTIVATES", "NONE", None, "", "FOO", "INHIBITS", "PRECEDES")
TRUBY = ("MORAL_CHALLENGE", "revelation", "NONE", "TRANSFORMATION", "BAR", None, "DESIRE_FULFILLMENT")
INVOLVED = ("direct", "Indirect", "latent", "none", "BOGUS", None, "none", "none")
ROLE = (*ROLES, "bogus", None)
CONFIDENCE = ("0.5", "x", None)


def assessed(pairs: DataFrame) -> DataFrame:
    """Pairs with a relation under each theory."""
    a, b = F.col("src"), F.col("dst")
    answer = lambda t, names, x, y: F.struct(F.lit(t).alias("theory"), pick((a * x + b * y) % len(names), names).alias("relation"))
    both = RuleBased(a=F.array(answer("mckee", MCKEE, 7, 13), answer("@TRUBY", TRUBY, 5, 3)), confidence=F.round(((a + b) % 100) / 100, 2), ord=F.lit(0))
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return both.assess(pairs).select("src", "dst", F.explode("a").alias("a"), "confidence", "ord", *rest).select("src", "dst", "a.*", "confidence", "ord", *rest)


def links(spark: SparkSession, ev: DataFrame) -> DataFrame:
    """Admitted links between locally close events."""
    ev = materialize(ev.select("id", "seq", "chapter", "user_id"), "order")  # ranked once, read by each pool
    n = ev.count()
    near = candidates.offset_gaps(ev, range(1, 4), rows=n)
    far = candidates.entity_gaps(occurrences(ev, "user_id"), n).filter("gap > 3")  # others are among the near ones
    pairs = near.unionByName(far).withColumn("dst_seq", F.col("src_seq") + F.col("gap")).drop("gap")
    return causal.admit(causal.valid_assessments(assessed(pairs), causal.relation_types(spark)), ev, LINKS * n)


def members(ev: DataFrame) -> DataFrame:
    """Scenes of a day: by user group; a mixed one; and memberships in the next day's mixed one, which don't hold."""
    i = F.col("id")
    scene = lambda cond, chapter, tail, rank: F.when(cond, F.struct(F.concat_ws("/", F.lit("scene"), chapter.cast("string"), tail).alias("scene"), (chapter * 10 + rank).cast("long").alias("scene_ord"), chapter.alias("chapter")))
    group, day = F.col("user_id") % 3, F.col("chapter")
    three = F.array(scene(i % 6 != 0, day, group.cast("string"), group), scene(i % 10 == 0, day, F.lit("x"), F.lit(9)), scene(i % 50 == 0, day + 1, F.lit("x"), F.lit(9)))
    rows = ev.select("id", F.explode(three).alias("s")).filter("s is not null").select("s.*", "id")
    return scenes.members(rows, ev)


def notes(ev: DataFrame) -> DataFrame:
    """Raw theme notes (id, theme, involvement, role, confidence)."""
    i = F.col("id")
    each = F.array(*(F.struct(F.lit(t).alias("theme"), pick((i + 3 * n) % len(INVOLVED), INVOLVED).alias("involvement"), pick((i * 5 + n) % len(ROLE), ROLE).alias("role"), pick((i + n) % 3, CONFIDENCE).alias("confidence")) for n, t in enumerate(THEMES)))
    return ev.select("id", F.explode(each).alias("n")).select("id", "n.*")
