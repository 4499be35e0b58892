"""Vector pools: blocks of unit vectors are packed into rows, pairs of blocks are joined, and each is one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize
from .grid import Best, dealt, sides
from .ordering import BLOCK, ranked

#: Vectors of a pack.
PACK = 512
LEAST_NORM = 1e-9
#: What a matrix product may differ by from the products of its rows.
SLACK = 1e-9


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    x = np.array([np.asarray(v, np.float64) for v in rows["vec"]])
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), LEAST_NORM)
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy()], "seqs": [rows["seq"].to_numpy()], "x": [x.tobytes()]})


def packs(vectors: DataFrame, part: Column, block: Column) -> DataFrame:
    """(part, block, ids, seqs, x) from (id, seq, vec): unit vectors of each block as one row. Null vectors are left out."""
    rows = vectors.filter("vec is not null").select(part.cast("string").alias("part"), block.cast("long").alias("block"), "id", "seq", "vec")
    return rows.groupBy("part", "block").applyInPandas(_pack, "part string, block long, ids array<long>, seqs array<long>, x binary")


def _products(threshold: float):
    """Pairs of each pair of packs with a dot product of at least threshold and the right one later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, seqs, x = ([np.asarray(b.column(f"{c}_{s}")[r].as_py()) for s in "ab"] for c in ("ids", "seqs", "x"))
                x = [np.frombuffer(b.column(f"x_{s}")[r].as_py(), np.float64).reshape(len(i), -1) for s, i in zip("ab", ids)]
                score = x[0] @ x[1].T
                i, j = np.nonzero((score >= threshold) & (seqs[1][None, :] > seqs[0][:, None]))
                s = score[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][i]), pa.array(ids[1][j]), pa.array(seqs[0][i]), pa.array(seqs[1][j]), pa.array(s)], names=["src", "dst", "src_seq", "dst_seq", "score"])

    return run


def _pairs(left: DataFrame, right: DataFrame, on, threshold: float) -> DataFrame:
    a = left.select(*(F.col(c).alias(f"{c}_a") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"{c}_b") for c in right.columns))
    both = a.join(b, on).select("ids_a", "seqs_a", "x_a", "ids_b", "seqs_b", "x_b")
    return both.mapInArrow(_products(threshold), "src long, dst long, src_seq long, dst_seq long, score double")


def _nearest(threshold: float, top: int, apart: int | None, own_too: bool):
    """The `top` texts of each query with a dot product of at least threshold: with apart those more than that before it only,
    and without own_too none of its id."""

    def run(asked: list[dict], held: list[dict]) -> Iterator[pa.RecordBatch]:
        unpacked = lambda r: (np.asarray(r["ids"], np.int64), np.asarray(r["seqs"], np.int64), np.frombuffer(r["x"], np.float64).reshape(len(r["ids"]), -1))
        texts = [unpacked(r) for r in held]
        for row in asked:
            ids, seqs, x = unpacked(row)
            best = Best(ids, seqs, top)
            for t_ids, t_seqs, y in texts:
                if apart is not None and t_seqs.min() + apart >= seqs.max():
                    continue
                score = x @ y.T
                if apart is not None and t_seqs.max() + apart >= seqs.min():
                    score[seqs[:, None] - t_seqs[None, :] <= apart] = -np.inf
                if not own_too:
                    score[ids[:, None] == t_ids[None, :]] = -np.inf
                best.offer(score, t_ids, t_seqs, threshold, lambda i, j, _: (x[i] * y[j]).sum(axis=1), SLACK)  # noqa: B023
            yield best.found()

    return run


def _top_pairs(queries: DataFrame, texts: DataFrame, n_queries: int, n_texts: int, threshold: float, top: int, apart: int | None = None, own_too: bool = True) -> DataFrame:
    """(query, id, query_seq, seq, score, rank): packs of both sides over a grid, the best of each cell, then of all; ties by seq."""
    found = dealt(queries.drop("part"), texts.drop("part"), sides(n_queries), sides(n_texts), _nearest(threshold, top, apart, own_too))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "seq")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def scene_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, score): events of one scene with a cosine of at least threshold, the earlier first.

    vectors: (id, seq, vec, scene). A scene's events are dealt to packs by rank, so a long scene is many pairs of packs.
    """
    rows = ranked(vectors.filter("scene is not null"), ["scene"], ["seq", "id"], F.floor(F.col("seq") / BLOCK), "_occ")
    p = packs(rows, F.col("scene"), F.floor(F.col("_occ") / PACK))
    return _pairs(p, p, (F.col("part_a") == F.col("part_b")) & (F.col("block_a") <= F.col("block_b")), threshold).select("src", "dst", "score")


def longshot_pairs(vectors: DataFrame, threshold: float, window: int = 100, step: int = 50) -> DataFrame:
    """(src, dst, score): events of the k-th window from the start and the k-th from the end, for all k before they meet.

    vectors: (id, seq, vec) with gapless seq. Windows are packs, joined on k: n / step matrix products in all.
    """
    n = vectors.count()
    last = -(-(n - 2 * window) // (2 * step)) - 1  # the largest k with step * k + window < n - step * k - window
    inside = lambda at: F.filter(F.sequence(F.greatest(F.floor((at - window) / step).cast("long") + 1, F.lit(0)), F.floor(at / step).cast("long")), lambda k: (k >= 0) & (k <= last))
    if last < 0:
        vectors = vectors.limit(0)
    left = packs(vectors.withColumn("_k", F.explode(inside(F.col("seq")))), F.lit(""), F.col("_k"))
    right = packs(vectors.withColumn("_k", F.explode(inside(F.lit(n - 1) - F.col("seq")))), F.lit(""), F.col("_k"))
    out = _pairs(left, right, F.col("block_a") == F.col("block_b"), threshold)
    return out.groupBy("src", "dst").agg(F.max("score").alias("score"))


def semantic_topk_pairs(vectors: DataFrame, threshold: float = 0.6, top: int = 10, apart: int = 5, sample: int | None = None) -> DataFrame:
    """(src, dst, score): for each event the `top` most similar ones more than `apart` before it; ties by seq.

    Packs are compared in the cells of a grid, each keeping its best, then the best of all are ranked. The work is quadratic, a
    cell's memory is not. `sample` is the legacy cap: of more events, only that many at even steps from the first take part, and
    `apart` counts those.
    """
    rows, n = vectors, vectors.count()
    if sample is not None and n > sample:
        every = n // sample
        rows = vectors.filter((F.col("seq") % every == 0) & (F.col("seq") < every * sample))
        rows = rows.withColumn("seq", F.floor(F.col("seq") / every).cast("long"))
        n = sample
    p = materialize(packs(rows, F.lit(""), F.floor(F.col("seq") / PACK)), "packs")
    found = _top_pairs(p, p, n, n, threshold, top, apart)
    return found.select(F.col("id").alias("src"), F.col("query").alias("dst"), "score")


def passage_topk(queries: DataFrame, passages: DataFrame, top: int = 2, least: float = 0.3, same_ids: bool = False) -> DataFrame:
    """(query, passage, rank, score): the `top` passages of each query with a cosine of at least `least`; ties by seq.

    A row is no passage of its own id, unless ids of queries and passages are of different kinds (same_ids). Packs of both meet
    in the cells of a grid; only the best of a cell go on.
    """
    (q, n_queries), (p, n_passages) = ((packs(df, F.lit(""), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(max(1, -(-n // PACK))))), n) for df, n in ((df, df.count()) for df in (queries, passages)))
    found = _top_pairs(q, p, n_queries, n_passages, least, top, own_too=same_ids)
    return found.select("query", F.col("id").alias("passage"), F.col("rank").cast("int").alias("rank"), "score")
