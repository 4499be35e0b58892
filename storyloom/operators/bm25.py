"""BM25 candidate pairs: blocks of texts as sparse matrices, a product for each pair of blocks, the best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize
from .grid import Best, dealt, sides

K1, B, EPSILON, TOP, DIGITS = 1.5, 0.75, 0.25, 10, 6
#: Texts of a block; a term of a cell is dense if one in DENSE queries holds it, up to SLAB terms; pairs of postings added at once;
#: cells of a cell's dense matrices that are kept.
BLOCK, DENSE, SLAB, PAIRS, KEPT = 512, 32, 2048, 1 << 21, 1 << 23


def postings(texts: DataFrame) -> DataFrame:
    """(id, seq, len, term, tf) from (id, seq, text): terms are lower-cased runs between white space, punctuation included; len
    of them are in the text."""
    terms = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    each = texts.select("id", "seq", terms.alias("terms")).select("id", "seq", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return each.groupBy("id", "seq", "len", "term").agg(F.count("*").alias("tf"))


def weighted(post: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """postings with a number `tid` for each term and `w`: its whole share of the score, for one occurrence in the query.

    idf is log((n - df + 0.5) / (df + 0.5)); where that is negative, EPSILON times the mean idf of all terms. Terms of a
    single text are left out: no other text has them.
    """
    df = F.count("*")
    raw = post.groupBy("term").agg(F.log((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5)).alias("idf"), df.alias("df"))
    raw = materialize(raw.withColumn("tid", F.monotonically_increasing_id()), "terms")
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    idf = raw.filter("df > 1").select("term", "tid", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")).alias("idf"))
    mean_length = n_words / max(1, n_docs)
    denominator = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(max(mean_length, 1e-9)))
    return post.join(idf, "term").select("id", "seq", "tid", "tf", (F.col("idf") * F.col("tf") * (K1 + 1) / denominator).alias("w"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of texts as one row: its texts by seq, and its postings."""
    seqs, first, doc = np.unique(rows["seq"].to_numpy(), return_index=True, return_inverse=True)
    raw = {"tid": rows["tid"].to_numpy(np.int64), "doc": doc.astype(np.int32), "tf": rows["tf"].to_numpy(np.float64), "w": rows["w"].to_numpy(np.float64)}
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy()[first]], "seqs": [seqs]} | {n: [c.tobytes()] for n, c in raw.items()})


class _Block:
    """A pack with its terms numbered as a cell numbers them: dense ones, below n_dense, as columns, others by term."""

    def __init__(self, row: dict, value: str):
        self.block, self.ids, self.seqs = row["block"], np.asarray(row["ids"], np.int64), np.asarray(row["seqs"], np.int64)
        self.tid, self.doc, self.value = (np.frombuffer(row[c], t) for c, t in (("tid", np.int64), ("doc", np.int32), (value, np.float64)))

    def number(self, term: np.ndarray, n_dense: int, known: np.ndarray | None = None) -> None:
        doc, value = (self.doc, self.value) if known is None else (self.doc[known], self.value[known])
        often = term < n_dense
        self.n_dense, self.dense = n_dense, (doc[often], term[often], value[often])
        self.doc, self.term, self.value = doc[~often], term[~often] - n_dense, value[~often]
        self.tid = None

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.ids), self.n_dense))
        out[self.dense[0], self.dense[1]] = self.dense[2]
        return out


def _add_rare(score: np.ndarray, q: _Block, t: _Block, first: np.ndarray, count: np.ndarray) -> None:
    """The share of terms that few texts hold, posting by posting. t is ordered by term: its terms' first places and counts."""
    at = np.flatnonzero(count[q.term])
    n = count[q.term[at]]
    ends = np.cumsum(n)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(n) else 0, PAIRS)), len(n)])
    for a, b in zip(cuts, cuts[1:]):
        some, m = at[a:b], n[a:b]
        other = np.repeat(first[q.term[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cell = np.repeat(q.doc[some] * score.shape[1], m) + t.doc[other]
        np.add.at(score.reshape(-1), cell, np.repeat(q.value[some], m) * t.value[other])


def _rounded(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.floor(score * 10**DIGITS + 0.5) / 10**DIGITS


def _best(top: int):
    def run(asked: list[dict], held: list[dict]) -> Iterator[pa.RecordBatch]:
        queries = [_Block(r, "tf") for r in asked]
        terms, term, often = np.unique(np.concatenate([q.tid for q in queries]), return_inverse=True, return_counts=True)
        dense = np.flatnonzero(often * DENSE >= sum(len(q.ids) for q in queries))
        dense = dense[np.argsort(-often[dense], kind="stable")][:SLAB]
        number, rare = np.empty(len(terms), np.int64), np.ones(len(terms), bool)
        rare[dense] = False
        number[dense], number[rare] = np.arange(len(dense)), np.arange(len(dense), len(terms))
        ends = np.cumsum([len(q.tid) for q in queries])
        for q, own in zip(queries, np.split(number[term], ends[:-1])):
            q.number(own, len(dense))
            q.left = q.matrix() if len(dense) * sum(len(x.ids) for x in queries) <= KEPT else None
            q.best = Best(q.ids, q.seqs, top)
        for row in held:
            t = _Block(row, "w")
            at = np.minimum(np.searchsorted(terms, t.tid), len(terms) - 1)
            known = terms[at] == t.tid
            t.number(number[at[known]], len(dense), known)
            order = np.argsort(t.term, kind="stable")
            t.doc, t.value = t.doc[order], t.value[order]
            count = np.bincount(t.term, minlength=len(terms) - len(dense))
            first, right = np.cumsum(count) - count, np.ascontiguousarray(t.matrix().T)
            score = None
            for q in queries:
                score = np.matmul(q.left if q.left is not None else q.matrix(), right, out=score if score is not None and len(score) == len(q.ids) else None)
                _add_rare(score, q, t, first, count)
                if q.block == t.block:
                    score[q.ids[:, None] == t.ids[None, :]] = 0
                q.best.offer(score, t.ids, t.seqs, 10.0**-DIGITS, _rounded, 2 * 10.0**-DIGITS)
        for q in queries:
            yield q.best.found()

    return run


def bm25_scores(texts: DataFrame, top: int = TOP) -> DataFrame:
    """(query, id, query_seq, seq, score): the `top` texts that score highest above 0 for each text as a query; ties by seq.

    A query's repeated terms count as often as they occur. All terms count, and each text is held against all others: blocks
    of texts are dealt to a grid whose cells multiply them, so no term is a key and a frequent one costs no more rows. The
    work grows with the square of the texts, at the price of a matrix product; a cell's memory doesn't grow. Scores are
    rounded to DIGITS before ranking, so that the order in which terms are added doesn't count.
    """
    texts = materialize(texts.select("id", "seq", "text"), "texts")
    n_docs = texts.count()
    post = materialize(postings(texts), "postings")
    n_words, n_post = post.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.count("*")).first()
    block = F.floor(F.col("seq") / BLOCK).cast("long")
    packs = weighted(post, n_docs, n_words).withColumn("block", block).groupBy("block").applyInPandas(_pack, "block long, ids array<long>, seqs array<long>, tid binary, doc binary, tf binary, w binary")
    packs = materialize(packs, "packs")
    side = sides(n_docs, n_post)
    score = dealt(packs, packs, side, side, _best(top))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "seq")
    return score.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= top).drop("_k")


def bm25_pairs(texts: DataFrame, top: int = TOP) -> DataFrame:
    """(src, dst): each text with its best ones, the earlier first."""
    s = bm25_scores(texts, top)
    first = F.col("query_seq") < F.col("seq")
    return s.select(F.when(first, F.col("query")).otherwise(F.col("id")).alias("src"), F.when(first, F.col("id")).otherwise(F.col("query")).alias("dst")).distinct()
