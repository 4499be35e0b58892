"""What a prompt may hold: cut texts, capped vocabularies and events, a budget of tokens, and the sizes of answer caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of each text that a prompt, a vector or a node takes.
CUTS = {"pair": 150, "prompt": 80, "embedded_event": 200, "embedded_scene": 300, "query": 200, "passage": 250, "scene": 50, "agent": 60}
#: Types of each vocabulary in a prompt, and events of a chapter that scenes are asked for.
VOCABULARY, CHAPTER_EVENTS = {"event": 20, "relation": 15, "agent": 20}, 200
#: Tokens of an answer: the cap, that of small models, and (base, each pair) of the assessments.
MOST_TOKENS, SMALL_MODEL, SMALL_TOKENS, LEAST_TOKENS = 16_000, "gpt-3.5", 4_096, 8_000
PAIR_TOKENS = {"integrated": (5_000, 400), "causal": (4_000, 300)}


def cut_text(c: Column | str, kind: str) -> Column:
    """The first characters of a text, as many as its use takes."""
    return F.left(F.col(c) if isinstance(c, str) else c, F.lit(CUTS[kind]))


def capped_vocabulary(types: DataFrame) -> DataFrame:
    """types (kind, ord, name): the first ones of each kind that a prompt lists."""
    most = reduce(lambda out, k: F.when(F.col("kind") == k, VOCABULARY[k]).otherwise(out), VOCABULARY, F.lit(0))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("ord", "name"))
    return types.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def capped_events(events: DataFrame, most: int = CHAPTER_EVENTS) -> DataFrame:
    """The first events of each chapter, by seq; ranks beyond the cap are dropped before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("chapter").orderBy("seq"))
    return events.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def token_budget(operation: Column | str, chars: Column | str, pairs: Column | str, asked: Column | str, model: Column | str) -> Column:
    """Tokens that a call may answer with: by pairs for assessments, by text for events, the cap for scenes."""
    operation, chars, pairs, asked, model = (F.col(c) if isinstance(c, str) else c for c in (operation, chars, pairs, asked, model))
    of_events = F.greatest(F.floor(chars / 100), F.lit(15)) * 400 + 4_000
    tokens = F.greatest(asked, F.lit(LEAST_TOKENS)).cast("long")
    tokens = F.when(operation == "scenes", MOST_TOKENS).when(operation == "events", F.when(of_events > 12_000, MOST_TOKENS).otherwise(of_events)).otherwise(tokens)
    for kind, (base, each) in PAIR_TOKENS.items():
        tokens = F.when(operation == kind, F.least(F.lit(MOST_TOKENS), base + each * pairs)).otherwise(tokens)
    return F.when(model.contains(SMALL_MODEL), F.least(tokens, F.lit(SMALL_TOKENS))).otherwise(tokens).cast("long")


def cache_sizes(caches: dict[str, DataFrame]) -> DataFrame:
    """(cache, entries): rows of each cache of answers (key, ...) by distinct key."""
    parts = [df.agg(F.countDistinct("key").alias("entries")).select(F.lit(name).alias("cache"), "entries") for name, df in caches.items()]
    return reduce(DataFrame.unionByName, parts)


def resolver_statistics(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """(what, n): registered characters, their aliases (distinct mentions), and pairs that occur together.

    resolved: (mention, name), name null where none was found; pairs: one row a pair.
    """
    known = resolved.filter("name is not null")
    counts = {"registered_characters": known.agg(F.countDistinct("name").alias("n")), "total_aliases": known.agg(F.countDistinct("name", "mention").alias("n")), "cooccurrence_pairs": pairs.agg(F.count("*").alias("n"))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("what"), "n") for k, df in counts.items()])
