"""From assessed pairs to causal links: relation filters, admission in temporal order, theory precedence, graph checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import supertype, theory
from ..functions.vocabulary import RELATION_TYPES, THEORIES
from ..runtime import materialize
from .ordering import spread


def relation_types(spark: SparkSession, types: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(relation, theory) that are valid."""
    return spark.createDataFrame([(r, t) for t, rs in (types or RELATION_TYPES).items() for r in rs], "relation string, theory string")


def valid_assessments(assessed: DataFrame, types: DataFrame) -> DataFrame:
    """Assessments with a relation in upper case that its theory knows; NONE, NULL, empty and null ones go."""
    rows = assessed.withColumns({"relation": F.upper(F.btrim("relation")), "theory": theory("theory")}).filter(~F.col("relation").isin("NONE", "NULL", ""))
    return rows.join(types, ["relation", "theory"], "left_semi")


def admit(assessed: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """Links (src, dst, relation, theory, ...) that may enter the graph.

    Both events exist, the cause comes before the effect, and of several labels of a pair the first counts: by theory in
    the order of THEORIES, then `ord`, then relation. As every edge goes forward in time the result has no cycle, whatever
    the order of insertion. Assessments with src_seq and dst_seq are of known events. n: how many there are, if known.
    """
    rows = assessed.filter("src is not null and dst is not null and src <> dst")
    if "src_seq" not in rows.columns:
        seq = events.select("id", "seq")
        rows = rows.join(seq.select(F.col("id").alias("src"), F.col("seq").alias("src_seq")), "src").join(seq.select(F.col("id").alias("dst"), F.col("seq").alias("dst_seq")), "dst")
    rows = spread(rows.filter("src_seq < dst_seq"), n, ["src", "dst"])
    rank = F.lit(len(THEORIES))
    for i, t in enumerate(THEORIES):
        rank = F.when(F.col("theory") == t, i).otherwise(rank)
    rest = [c for c in rows.columns if c not in ("src", "dst")]
    return rows.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), F.struct(rank, "ord", "relation")).alias("_first")).select("src", "dst", "_first.*")


def theory_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("theory").agg(F.count("*").alias("links"))


def with_supertype(links: DataFrame) -> DataFrame:
    return links.withColumn("edge_supertype", supertype("relation"))


def dag_stats(links: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """One row: nodes, edges, max_in, max_out, avg_in (per event, 2 digits). n: how many rows both have, if known."""
    part = lambda df, c, *v: df.select(F.col(c).alias("id"), *(F.lit(x).cast("long").alias(n) for x, n in zip(v, ("node", "out", "into"))))
    each = part(events, "id", 1, 0, 0).unionByName(part(links, "src", 0, 1, 0)).unionByName(part(links, "dst", 0, 0, 1))
    each = spread(each, n, ["id"]).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("node", "out", "into")))
    total = lambda f, c: F.coalesce(f(c), F.lit(0)).cast("long")
    one = each.agg(total(F.sum, "node").alias("nodes"), total(F.sum, "out").alias("edges"), total(F.max, "into").alias("max_in"), total(F.max, "out").alias("max_out"))
    return one.withColumn("avg_in", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 2))


def backward_edges(links: DataFrame) -> DataFrame:
    """One row: links, and how many of them don't go forward in time (0: no cycle is possible)."""
    return links.agg(F.count("*").alias("links"), F.coalesce(F.sum(F.when(F.col("src_seq") >= F.col("dst_seq"), 1).otherwise(0)), F.lit(0)).cast("long").alias("backward"))


def has_cycle(links: DataFrame, rounds: int = 10_000) -> bool:
    """Whether any graph (src, dst) holds a cycle: nodes that nothing leads to, or that lead nowhere, are peeled in rounds."""
    left = materialize(links.select("src", "dst").distinct(), "edges")
    for _ in range(rounds):
        n = left.count()
        if not n:
            return False
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = materialize(inner.select("src", "dst"), "edges")
        if left.count() == n:
            return True
    raise RuntimeError(f"undecided after {rounds} rounds")


def first_neighbours(links: DataFrame, texts: DataFrame, most: int = 2) -> DataFrame:
    """(id, causes, effects): the texts of each event's first causes and effects by `ord`, joined by `; `.

    links: (src, dst, ord); texts: (id, text). An unknown neighbour counts as an empty text; events without any link are
    left out.
    """
    from pyspark.sql.window import Window

    def side(here: str, there: str, name: str) -> DataFrame:
        w = Window.partitionBy(here).orderBy("ord", there)
        rows = links.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
        rows = rows.join(texts.select(F.col("id").alias(there), "text"), there, "left")
        return rows.groupBy(F.col(here).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "; ").alias(name))

    both = side("dst", "src", "causes").join(side("src", "dst", "effects"), "id", "full_outer")
    return both.select("id", F.coalesce("causes", F.lit("")).alias("causes"), F.coalesce("effects", F.lit("")).alias("effects"))
