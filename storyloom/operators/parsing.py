"""Model answers to rows: events with their productions from JSON, type checks, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import calibrated, missing_as_null
from ..functions.vocabulary import DEFAULT_EVENT_TYPE, EVENT_TYPES
from .ordering import BLOCK, ranked

_STRENGTH = {"actor": 0.9, "patient": 0.8, "whyfactor": 0.7, "place": 0.8}
#: Fields that may be one string or a list of strings.
_LISTS = ("actors", "patients", "why_factors")
_EVENT = "array<struct<raw_description:string,event_category:string,action_type:string,actors:string,patients:string,location_context:string,time_context:string,why_factors:string,confidence:string,quote:string>>"


def unfenced(answer: Column) -> Column:
    """An answer without a Markdown fence, and without control characters."""
    body = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(answer), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def _as_list(c: Column) -> Column:
    """A JSON list, or a bare string, as an array; null and empty give none."""
    listed = F.from_json(c, "array<string>")
    out = F.when(F.btrim(c).startswith("["), listed).when(missing_as_null(F.btrim(c)).isNotNull(), F.array(F.btrim(c)))
    return F.coalesce(F.filter(out, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def parse_events(answers: DataFrame) -> DataFrame:
    """Events of model answers (chapter, chunk, answer), in order: one row each with a gapless seq.

    An answer is a list of events, or an object with `events`; a fence around it doesn't count. What is no JSON gives no
    rows. Lists may be single strings. Unknown types become the default; types come from event_category, else action_type,
    else OTHER. Confidence is calibrated on actors and place.
    """
    text = unfenced(F.col("answer"))
    inner = F.coalesce(F.get_json_object(text, "$.events"), text)
    inner = F.when(F.btrim(inner).startswith("{"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    rows = answers.select("chapter", "chunk", F.posexplode(F.from_json(inner, _EVENT)).alias("pos", "e")).filter("e is not null and e.raw_description is not null")
    named = F.upper(F.coalesce(missing_as_null("e.event_category"), missing_as_null("e.action_type"), F.lit("OTHER")))
    lists = {c: _as_list(F.col(f"e.{c}")) for c in _LISTS}
    rows = rows.select("chapter", "chunk", "pos", F.col("e.raw_description").alias("description"), event_type(named).alias("action_type"), missing_as_null("e.location_context").alias("location"), missing_as_null("e.time_context").alias("time"), *(c.alias(n) for n, c in lists.items()), F.col("e.confidence").try_cast("double").alias("p"), F.col("e.quote").alias("quote"))
    rows = rows.withColumn("confidence", calibrated("p", F.size("actors") > 0, F.col("location").isNotNull())).drop("p")
    return ranked(rows, [], ["chapter", "chunk", "pos"], F.col("chapter"), "seq")


def productions_of(events: DataFrame) -> DataFrame:
    """(event_id, event_seq, ord, entity_name, entity_type, strength) of parsed events; names of one character don't count."""
    parts = []
    for kind, column in (("actor", "actors"), ("patient", "patients"), ("whyfactor", "why_factors")):
        parts.append(F.transform(column, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind"), F.lit(_STRENGTH[kind]).alias("strength"))))
    place = F.when(F.col("location").isNotNull(), F.array(F.struct(F.col("location").alias("name"), F.lit("place").alias("kind"), F.lit(_STRENGTH["place"]).alias("strength")))).otherwise(F.array().cast("array<struct<name:string,kind:string,strength:double>>"))
    rows = events.select(F.col("id").alias("event_id"), F.col("seq").alias("event_seq"), F.posexplode(F.concat(*parts, place)).alias("ord", "p"))
    return rows.filter(F.char_length("p.name") > 1).select("event_id", "event_seq", "ord", F.col("p.name").alias("entity_name"), F.col("p.kind").alias("entity_type"), F.col("p.strength").alias("strength"))


def event_type(c: Column, types: tuple[str, ...] = EVENT_TYPES) -> Column:
    """The type if it is known, else the default."""
    return F.when(c.isin(*types), c).otherwise(DEFAULT_EVENT_TYPE)


def occurrences(productions: DataFrame) -> DataFrame:
    """(key, id, seq): `type:name` in lower case and the events that hold it."""
    return productions.select(F.concat_ws(":", "entity_type", F.lower("entity_name")).alias("key"), F.col("event_id").alias("id"), F.col("event_seq").alias("seq"))


def chunk_failures(chunks: DataFrame) -> DataFrame:
    """(chapter, chunks, failed, rate, flagged) from (chapter, answer): answers without events; over 30 % is flagged."""
    empty = F.coalesce(F.size(F.from_json(F.coalesce(F.get_json_object(unfenced(F.col("answer")), "$.events"), unfenced(F.col("answer"))), "array<string>")) <= 0, F.lit(True))
    out = chunks.groupBy("chapter").agg(F.count("*").alias("chunks"), F.sum(empty.cast("long")).alias("failed"))
    return out.withColumn("rate", F.round(F.col("failed") / F.col("chunks"), 4)).withColumn("flagged", F.col("rate") > 0.3)
