"""Writers: CSV tables, JSON-LD, and Cypher scripts, all written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cypher_name, cypher_properties, cypher_value, truncate_safe

#: Characters of a quote and of a mechanism that are exported.
QUOTE, MECHANISM = 300, 200
_KEEP_NULLS = {"ignoreNullFields": "false"}


def write_csv_tables(tables: dict[str, DataFrame], out_dir: str, files: int | None = None) -> None:
    """One folder <name>.csv per table, with a header in each file, also where a table is empty; other folders are left alone.

    Every task writes its own file; `files` asks for at most that many, which suits small tables only.
    """
    for name, df in tables.items():
        (df if files is None else df.coalesce(files)).write.mode("overwrite").csv(f"{out_dir}/{name}.csv", header=True, escape='"', emptyValue="")


def _edge(df: DataFrame, start: str, end: str, kind: Column | str, *more: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(start).alias(":START_ID"), F.col(end).alias(":END_ID"), kind.alias(":TYPE"), *more)


def csv_tables(events: DataFrame, productions: DataFrame, links: DataFrame, member: DataFrame, scenes: DataFrame, following: DataFrame) -> dict[str, DataFrame]:
    """The twelve tables of the graph by name.

    events: (id, name, action_type, quote, confidence, seq, chapter, time, location, scene, notes); productions: (event_id,
    entity_id, entity_name, entity_type, strength); links: (src, dst, relation, mechanism, weight, confidence,
    edge_supertype); scenes: (scene, theme, chapter, confidence). Missing text is empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    of = lambda *kinds: productions.filter(F.col("entity_type").isin(*kinds))
    named = lambda df, name: df.groupBy(F.col("entity_id").alias(":ID")).agg(F.max("entity_name").alias(name))
    edge = lambda kind, kind_of, name: _edge(of(kind), "entity_id", "event_id", kind_of, F.col("strength").alias(name))
    return {
        "events": events.select(F.col("id").alias(":ID"), "name", F.col("action_type").alias("actionType"), F.col("quote").alias("source_quote"), "confidence", F.col("seq").alias("sequence"), "chapter", text("time"), text("location"), text("scene").alias("scene_id"), text("notes").alias("theme_annotations")),
        "agents": named(of("actor", "patient"), "name"),
        "places": named(of("place"), "name"),
        "whyfactors": named(of("whyfactor"), "factor"),
        "acts_in": edge("actor", "ACTS_IN", "strength"),
        "affected_in": edge("patient", "AFFECTED_IN", "strength"),
        "motivates": edge("whyfactor", "MOTIVATES", "weight"),
        "hosts": edge("place", "HOSTS", "specificity"),
        "follows": _edge(following, "src", "dst", "FOLLOWS"),
        "causes": _edge(links, "src", "dst", "CAUSES", F.col("relation").alias("relationType"), F.col("mechanism"), F.col("weight"), F.col("confidence"), text("edge_supertype")),
        "scenes": scenes.select(F.col("scene").alias(":ID"), "theme", "chapter", "confidence"),
        "scene_includes_event": _edge(member, "scene", "id", "INCLUDES"),
    }


def jsonld_events(events: DataFrame) -> DataFrame:
    """(id, type, json): an event with all its fields; `id` becomes `@id`."""
    rest = [c for c in events.columns if c != "id"]
    return events.select(F.col("id").cast("string").alias("id"), F.lit("Event").alias("type"), F.to_json(F.struct(F.col("id").alias("@id"), F.lit("Event").alias("type"), *rest), _KEEP_NULLS).alias("json"))


def jsonld_productions(productions: DataFrame) -> DataFrame:
    uid = F.concat_ws("__", F.col("event_id").cast("string"), F.col("relationship"), F.col("entity_id"))
    fields = F.struct(uid.alias("@id"), F.lit("EventProducesEntity").alias("type"), F.col("event_id").alias("from"), F.col("entity_id").alias("to"), "entity_name", "entity_type", "relationship", "strength")
    return productions.select(uid.alias("id"), F.lit("EventProducesEntity").alias("type"), F.to_json(fields, _KEEP_NULLS).alias("json"))


def jsonld_links(links: DataFrame) -> DataFrame:
    uid = F.concat_ws("__", F.col("src").cast("string"), F.lit("CAUSES"), F.col("dst").cast("string"))
    fields = F.struct(uid.alias("@id"), F.lit("CausalEdge").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("relation").alias("relationType"), "mechanism", "weight", "confidence", "edge_supertype")
    return links.select(uid.alias("id"), F.lit("CausalEdge").alias("type"), F.to_json(fields, _KEEP_NULLS).alias("json"))


def write_jsonld(records: DataFrame, path: str) -> None:
    """The records' JSON, one object a line; {"@graph": [...]} is their list."""
    records.select("json").write.mode("overwrite").text(path)


def graph_document(records: DataFrame) -> str:
    """The whole {"@graph": [...]} document as a string, for graphs that fit the driver."""
    return '{"@graph":[' + ",".join(r.json for r in records.orderBy("type", "id").select("json").toLocalIterator()) + "]}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Statements at the head of a script.
CONSTRAINTS = (
    *(f"CREATE CONSTRAINT {n}_id IF NOT EXISTS FOR ({n[0]}:{n.title()}) REQUIRE {n[0]}.id IS UNIQUE" for n in ("event", "agent", "scene")),
    *(f"CREATE INDEX event_{p} IF NOT EXISTS FOR (e:Event) ON (e.{p})" for p in ("sequence", "chapter")),
)


def node_statements(nodes: DataFrame, properties: dict[str, str]) -> DataFrame:
    """(label, uid, statement): MERGE by id, the first write sets the properties (column -> kind); nulls are left out."""
    props = cypher_properties({"id": (F.col("uid"), "string")} | {p: (F.col(p), k) for p, k in properties.items()})
    body = F.concat(F.lit("MERGE (n:"), cypher_name("label"), F.lit(" {id: "), cypher_value("uid"), F.lit("}) ON CREATE SET n = "), props, F.lit(";"))
    return nodes.select("label", "uid", body.alias("statement"))


def edge_statements(edges: DataFrame, properties: dict[str, str]) -> DataFrame:
    """(type, start, end, statement): MERGE between two ids; the last write sets the properties."""
    props = cypher_properties({p: (F.col(p), k) for p, k in properties.items()})
    body = F.concat(F.lit("MATCH (a {id: "), cypher_value("start"), F.lit("}), (b {id: "), cypher_value("end"), F.lit("}) MERGE (a)-[r:"), cypher_name("type"), F.lit("]->(b) SET r = "), props, F.lit(";"))
    return edges.select("type", "start", "end", body.alias("statement"))


def write_cypher(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A script in parts by name: constraints, then nodes by (label, uid), then edges by (type, start, end)."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(c + ";",) for c in CONSTRAINTS], "statement string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/0-constraints")
    nodes.orderBy("label", "uid").select("statement").write.mode("overwrite").text(f"{path}/1-nodes")
    edges.orderBy("type", "start", "end").select("statement").write.mode("overwrite").text(f"{path}/2-edges")


def quote(c: str) -> Column:
    return truncate_safe(c, QUOTE)


def mechanism(c: str) -> Column:
    return truncate_safe(c, MECHANISM)
