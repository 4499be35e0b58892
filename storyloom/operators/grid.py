"""All rows against all: packs of both sides are dealt to the cells of a grid, a cell is a task, and each query keeps its best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows and parts of a row (terms) of either side of a cell; cells along a side that spread the work, and rows that are worth one.
CELL, CELL_PARTS, SPREAD, WORTH = 32_768, 1 << 21, 12, 1024
FOUND = "query long, id long, query_seq long, seq long, score double"


def sides(n_rows: int, n_parts: int = 0) -> int:
    """Cells along a side: enough to spread the work, and so many that a cell holds no more of a larger table."""
    return max(1, min(SPREAD, -(-n_rows // WORTH)), -(-n_rows // CELL), -(-n_parts // CELL_PARTS))


def dealt(queries: DataFrame, texts: DataFrame, rows: int, cols: int, run: Callable[[list[dict], list[dict]], Iterator[pa.RecordBatch]], schema: str = FOUND) -> DataFrame:
    """What run(packs of queries, packs of texts) yields for each cell of a grid of rows x cols.

    queries and texts have the same columns, with `block` (long, gapless from 0) among them. Each cell is a partition of its
    own: nothing is broadcast and no key is joined.
    """
    columns, places = queries.columns, lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    home = lambda n: F.pmod("block", F.lit(n)).cast("int")
    q = queries.select(F.lit(True).alias("asks"), home(rows).alias("i"), places(cols).alias("j"), *columns)
    t = texts.select(F.lit(False).alias("asks"), places(rows).alias("i"), home(cols).alias("j"), *columns)
    both = q.unionByName(t).repartitionById(rows * cols, F.col("i") * cols + F.col("j")).drop("i", "j")

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[dict]] = {True: [], False: []}
        for b in batches:
            for r in b.to_pylist():
                sides[r.pop("asks")].append(r)
        if sides[True] and sides[False]:
            yield from run(sides[True], sides[False])

    return both.mapInArrow(cell, schema)


class Best:
    """The `top` texts of each query of a pack so far, by (score descending, seq)."""

    def __init__(self, ids: np.ndarray, seqs: np.ndarray, top: int):
        self.ids, self.seqs, self.top = ids, seqs, top
        self.score = np.full((len(ids), top), -np.inf)
        self.id, self.seq = np.zeros((len(ids), top), np.int64), np.zeros((len(ids), top), np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray, seqs: np.ndarray, least: float, final: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], slack: float) -> None:
        """Texts with their scores (queries x texts). Those within `slack` of a place are scored by `final` (query, text, score)
        for good: it must give a text the same score wherever it stands. Scores below `least` don't count."""
        floor = np.maximum(self.score[:, -1], least)
        keep = np.flatnonzero(score >= (floor - slack)[:, None])
        if len(keep) > 4 * self.top * len(score) and score.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(score, score.shape[1] - self.top, axis=1)[:, score.shape[1] - self.top] - slack)
            keep = np.flatnonzero(score >= (floor - slack)[:, None])
        if not len(keep):
            return
        i, j = np.divmod(keep, score.shape[1])
        s = final(i, j, score[i, j])
        i, j, s = (v[s >= least] for v in (i, j, s))
        if not len(i):
            return
        rows = np.unique(i)
        old = np.repeat(rows, self.top)
        i, s, a, b = np.r_[old, i], np.r_[self.score[rows].ravel(), s], np.r_[self.seq[rows].ravel(), seqs[j]], np.r_[self.id[rows].ravel(), ids[j]]
        order = np.lexsort((a, -s, i))
        i, s, a, b = (v[order] for v in (i, s, a, b))
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, s, a, b, place = (v[place < self.top] for v in (i, s, a, b, place))
        self.score[i, place], self.seq[i, place], self.id[i, place] = s, a, b

    def found(self) -> pa.RecordBatch:
        i, k = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[i], self.id[i, k], self.seqs[i], self.seq[i, k], self.score[i, k])], names=["query", "id", "query_seq", "seq", "score"])
