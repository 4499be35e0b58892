"""Theme annotations: clean values, the bridge rule over causal neighbours, flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import INVOLVEMENTS, ROLES, THEMES
from .ordering import spread


def cleaned(notes: DataFrame) -> DataFrame:
    """notes (id, theme, involvement, role, confidence, ...): unknown involvements are `none`; a role goes with `none`, or if unknown.

    Confidence becomes a double, null if it is none. Rows of unknown themes go.
    """
    inv = F.when(F.lower("involvement").isin(*INVOLVEMENTS), F.lower("involvement")).otherwise("none")
    out = notes.filter(F.col("theme").isin(*THEMES)).withColumn("involvement", inv)
    role = F.when((F.col("involvement") != "none") & F.lower("role").isin(*ROLES), F.lower("role"))
    return out.withColumns({"role": role, "confidence": F.try_cast("confidence", "double") if hasattr(F, "try_cast") else F.col("confidence").try_cast("double")})


def bridged(notes: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """Clean notes after the bridge rule: `none` with a neighbour, either way, that is `direct` in the theme becomes
    `indirect` and `mediating`. One pass: no note becomes `direct`, so the order of events doesn't count.
    n: how many notes and links there are, if known."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = spread(both, n, ["dst"]).join(spread(notes.filter("involvement = 'direct'").select(F.col("id").alias("dst"), "theme"), n, ["dst"]), "dst")
    near = spread(near.select(F.col("src").alias("id"), "theme"), n, ["id", "theme"]).distinct().withColumn("_near", F.lit(True))
    out = spread(notes, n, ["id", "theme"]).join(near, ["id", "theme"], "left")
    up = (F.col("involvement") == "none") & F.col("_near").isNotNull()
    return out.withColumns({"role": F.when(up, "mediating").otherwise(F.col("role")), "involvement": F.when(up, "indirect").otherwise(F.col("involvement"))}).drop("_near").select(*notes.columns)


def flattened(notes: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """(id, theme_POWER, ...): the involvement in each theme of every event, `none` without a note. n: how many notes, if known."""
    pick = [F.max(F.when(F.col("theme") == t, F.col("involvement"))).alias(f"theme_{t}") for t in THEMES]
    flat = spread(notes, n, ["id"]).groupBy("id").agg(*pick)
    return spread(events.select("id"), n, ["id"]).join(flat, "id", "left").select("id", *(F.coalesce(f"theme_{t}", F.lit("none")).alias(f"theme_{t}") for t in THEMES))
