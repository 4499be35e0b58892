"""Readers. Paths go through Spark, so any store it knows will do."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

#: Statements of a Cypher script that a loader runs.
STATEMENTS = ("CREATE", "MERGE", "MATCH", "UNWIND")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file; path may be a glob."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


@dataclass
class Ontology:
    """Types by name: events and agents with their theory, relations with theory and direction, places and times."""

    events: dict[str, str] = field(default_factory=dict)
    relations: dict[str, tuple[str, str]] = field(default_factory=dict)
    agents: dict[str, str] = field(default_factory=dict)
    places: dict[str, str] = field(default_factory=dict)
    times: dict[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(kind, name, theory, directionality)."""
        rows = [("relation", n, t, d) for n, (t, d) in self.relations.items()]
        for kind in ("events", "agents", "places", "times"):
            rows += [(kind[:-1], n, t, None) for n, t in getattr(self, kind).items()]
        return spark.createDataFrame(rows, "kind string, name string, theory string, directionality string")


def default_ontology() -> Ontology:
    """The built-in types."""
    mckee = V.THEORIES[0]
    return Ontology(dict.fromkeys(V.EVENT_TYPES, mckee), {n: (t, "uni") for t, ns in V.RELATION_TYPES.items() for n in ns}, dict.fromkeys(V.AGENT_TYPES, mckee))


def _root_objects(raw: str) -> dict:
    """One object, or several written one after the other, as one; later keys win."""
    decoder, at, out = json.JSONDecoder(), 0, {}
    while at < len(raw := raw.strip()):
        found, at = decoder.raw_decode(raw, at)
        out |= found
        at += len(re.match(r"[\s,]*", raw[at:])[0])
    return out


def parse_ontology(raw: str) -> Ontology:
    """An ontology from JSON text: entries are objects with a name, or bare strings; what can't be read gives the default."""
    try:
        schema = _root_objects(raw)
    except (ValueError, TypeError):
        return default_ontology()

    def entries(*keys: str) -> list[dict]:
        found = next((schema[k] for k in keys if schema.get(k)), [])
        return [{"name": x} if isinstance(x, str) else x for x in found]

    def theories(*keys: str) -> dict[str, str]:
        return {x["name"]: x.get("theory") or V.THEORIES[0] for x in entries(*keys) if x.get("name")}

    relations = entries("RelationTypeDictionary", "relationship_types") or [*entries("RelationTypeDictionary_Truby"), *entries("RelationTypeDictionary_McKee")]
    return Ontology(
        theories("EventTypeDictionary", "event_types"),
        {x["name"]: (x.get("theory") or V.THEORIES[0], x.get("directionality") or "uni") for x in relations if x.get("name")},
        theories("AgentTypeDictionary"),
        theories("PlaceTypeDictionary"),
        theories("TimeTypeDictionary"),
    )


def read_ontology(spark: SparkSession, path: str | None) -> Ontology:
    """The ontology of a schema file; the built-in one without a path."""
    return parse_ontology("\n".join(r.text for r in read_text(spark, path).collect())) if path else default_ontology()


def find_column(df: DataFrame, names: list[str | None]) -> str | None:
    """The first of names that df has, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n and n.lower() in have), None)


def read_csv(spark: SparkSession, path: str, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV table with a header; wanted: new name -> names to look for, as strings, null where none is found."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if wanted is None:
        return df
    found = {new: find_column(df, old) for new, old in wanted.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(n) for n, c in found.items()))


def read_cypher(spark: SparkSession, path: str) -> DataFrame:
    """(statement): what a loader would run of a script; comments and other statements are left out."""
    rows = read_text(spark, path).select(F.explode(F.split("text", r";[ \t]*(?:\r?\n|$)")).alias("statement"))
    rows = rows.select(F.btrim("statement", F.lit(" \t\r\n")).alias("statement"))
    return rows.filter(F.upper(F.regexp_extract("statement", r"^(\w+)", 1)).isin(*STATEMENTS))


@dataclass(frozen=True)
class Settings:
    """Run settings; from_env reads STORYLOOM_<NAME>."""

    model: str = "rule-based"
    cache_size: int = 10_000
    batch: int = 50
    max_pairs: int = 25_000
    similarity: float = 0.5

    @staticmethod
    def from_env() -> Settings:
        base = Settings()
        return Settings(**{k: type(v)(os.environ.get(f"STORYLOOM_{k.upper()}", v)) for k, v in vars(base).items()})
