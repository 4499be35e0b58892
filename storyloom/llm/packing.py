"""Lexical retrieval packing: a BM25 index over lexically near documents fills each seed's window with unused neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, id_or_null, materialize, text_or_empty
from .textvec import spans
from .wordbpe import WordEncoder

WINDOW, END = 2048, 1
#: Documents of an index shard; terms of the key that shards follow; tokens of a range partition, and the most partitions.
SHARD_ROWS, KEY_TERMS, PART_TOKENS, MOST_PARTS = 2048, 8, 4_000_000, 20_000
#: Bytes of text that are encoded together.
SLICE = 1 << 21
#: A term in more than one of DENSE documents of a shard is a row of a matrix, others are lists; queries of one product.
DENSE, QUERIES = 16, 128
#: BM25's constants.
K1, B = 1.5, 0.75
_encoders: dict[str, WordEncoder] = {}


def lexical_keys(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For the rest of each text, ids[at[i]:at[i + 1]], its heaviest terms, heaviest first.

    A term weighs sqrt(tf) * log(id + 2): merges of a vocabulary come in the order of their frequency, so the logarithm of
    an id stands for a term's rarity without a pass over the corpus. It only deals documents to shards.
    """
    n = len(at) - 1
    size = np.diff(at) % WINDOW
    owner = np.repeat(np.arange(n, dtype=np.uint64), size)
    rest = ids[np.repeat(at[1:] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.uint64)
    both, tf = np.unique(owner << np.uint64(16) | rest, return_counts=True)
    term = both & np.uint64(0xFFFF)
    light = 65535 - np.minimum(100 * np.sqrt(tf) * np.log(term.astype(np.float64) + 2), 65535)
    order = np.sort((both >> np.uint64(16)) << np.uint64(32) | light.astype(np.uint64) << np.uint64(16) | term)
    first = np.searchsorted(order, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    terms = (order & np.uint64(0xFFFF)).astype(">u2")
    return [terms[i : min(i + KEY_TERMS, j)].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for b in batches:
            column = b.column("x")
            for i, j in spans(pc.binary_length(column).to_pylist(), SLICE):
                ids, at = encoder.encode([x.as_py() for x in column[i:j]], END)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i), pa.array(lexical_keys(ids, at), pa.binary()), raw], names=["d", "key", "ids"])

    return run


def rest_of(raw) -> np.ndarray:
    """Ids of a document after its whole windows."""
    ids = np.frombuffer(raw, "<u2")
    return ids[len(ids) // WINDOW * WINDOW :]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents that hold each term after their whole windows; -1 all documents, -2 their tokens, -3 tokens of whole documents."""
    df, n, tokens, every = np.zeros(1 << 16, np.int64), 0, 0, 0
    seen = np.full(1 << 16, -1, np.int64)
    for b in batches:
        for x in b.column("ids"):
            raw = x.as_buffer()
            rest = rest_of(raw)
            seen[rest] = n  # each term once
            df[rest[seen[rest] == n]] += 1
            n, tokens, every = n + 1, tokens + len(rest), every + raw.size // 2
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[terms, -1, -2, -3]), pa.array(np.r_[df[terms], n, tokens, every])], names=["term", "n"])


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, float, int]:
    """idf of every term and the mean length over the rests of all documents, and the tokens of all of them.

    The driver sees one row for each id of the vocabulary, 65,536 at most.
    """
    found = dict(map(tuple, rows.select("ids").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    n, tokens, every = (found.pop(k, 0) for k in (-1, -2, -3))
    df = np.zeros(1 << 16)
    df[list(found)] = list(found.values())
    return np.log1p((n - df + 0.5) / (df + 0.5)), tokens / max(1, n), every


class Bm25:
    """Inverted index over pieces of token ids; a posting's weight is its whole BM25 term.

    stats: idf of every term and the mean length; without it those of the pieces. Terms of many pieces are rows of a dense
    matrix, all others lists.
    """

    def __init__(self, pieces: list[np.ndarray], stats: tuple | None = None):
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.uint64), lengths)
        both, tf = np.unique(owner << np.uint64(16) | np.concatenate(pieces).astype(np.uint64), return_counts=True)
        self.size, doc, self.term = n, (both >> np.uint64(16)).astype(np.int64), (both & np.uint64(0xFFFF)).astype(np.int64)
        df = np.bincount(self.term, minlength=1 << 16)
        idf, mean = stats[:2] if stats else (np.log1p((n - df + 0.5) / (df + 0.5)), lengths.mean())
        weight = (idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1.0, mean)))).astype(np.float32)
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        often = np.flatnonzero(df * DENSE > n)
        self.row = np.full(1 << 16, -1, np.int64)
        self.row[often] = np.arange(len(often))
        many = self.row[self.term] >= 0
        self.dense = np.zeros((len(often), n), np.float32)
        self.dense[self.row[self.term[many]], doc[many]] = weight[many]
        order = np.flatnonzero(~many)
        order = order[np.argsort(self.term[order], kind="stable")]
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.count = np.where(self.row >= 0, 0, df)
        self.first = np.cumsum(self.count) - self.count

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """Scores of all pieces for all terms of each seed, one row a seed."""
        spans = self.of_doc[seeds + 1] - self.of_doc[seeds]
        query = np.repeat(np.arange(len(seeds)), spans)
        term = self.term[np.repeat(self.of_doc[seeds] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
        asked = np.zeros((len(seeds), len(self.dense)), np.float32)
        many = self.row[term] >= 0
        asked[query[many], self.row[term[many]]] = 1
        out = asked @ self.dense
        query, term = query[~many], term[~many]
        n = self.count[term]
        at = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return out + np.bincount(np.repeat(query, n) * self.size + self.post_doc[at], self.post_weight[at], len(seeds) * self.size).reshape(out.shape).astype(np.float32)


def _ranked(score: np.ndarray) -> Iterator[int]:
    """Places of the scores from 0 on, best first; of equal ones the first in order."""
    most, given = 64, 0
    while True:
        if most < len(score):
            least = np.partition(score, len(score) - most)[len(score) - most]
            top = np.flatnonzero(score > least) if least >= 0 else np.flatnonzero(score >= 0)
            done = least < 0
            if not done and len(top) <= given:  # one score fills the rest of this list
                top, done = (np.flatnonzero(score >= least), False)
        else:
            top, done = np.flatnonzero(score >= 0), True
        top = top[np.argsort(-score[top], kind="stable")]
        yield from top[given:].tolist()
        if done:
            return
        given, most = len(top), most * 8


def pack_block(lengths: list[int], ids: list[np.ndarray], window: int = WINDOW, stats: tuple | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for the documents of a shard; sequences count from 0.

    Whole windows of a long document stand alone. What is left of each is packed. Seeds are taken evenly from the order
    of the documents, one for each window that can be filled. A window takes its seed, then the seed's nearest unused
    neighbours by BM25 over all terms of the seed; the last one is cut, and what is left of it stays unused. Seeds
    of later windows are neighbours only when nothing else is left. What fills no window is cut into sequences whose
    lengths are powers of two, which take no padding.
    """
    sequence = 0
    starts, rest = [], []
    for doc, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            yield doc, k * window, window, sequence, 0
            sequence += 1
        if n % window:
            starts.append(full * window)
            rest.append(doc)
    if not rest:
        return
    index = Bm25([ids[doc][start:] for doc, start in zip(rest, starts)], stats)
    n, left = len(rest), np.array([lengths[d] - s for d, s in zip(rest, starts)], np.int64)
    whole, tail = divmod(int(left.sum()), window)
    seeds = np.arange(whole) * n // max(1, whole)
    free = np.ones(n, bool)
    free[seeds] = False
    rows: dict[int, np.ndarray] = {}
    for k, goal in enumerate([window] * whole + [1 << b for b in range(window.bit_length() - 1, -1, -1) if tail >> b & 1]):
        if k % QUERIES == 0:
            some = seeds[k : k + QUERIES]
            rows = dict(zip(some.tolist(), index.scores(some)))
        if k < whole and left[seeds[k]]:
            seed = int(seeds[k])
        else:
            if not free.any():
                free = left > 0
            seed = int(free.argmax())
        filled, piece, ranked = 0, seed, None
        while True:
            take = int(min(goal - filled, left[piece]))
            yield rest[piece], starts[piece], take, sequence, filled
            filled += take
            starts[piece] += take
            left[piece] -= take
            free[piece] = left[piece] > 0 and (free[piece] or piece == seed)
            if filled == goal:
                break
            if ranked is None:
                score = rows[seed] if seed in rows else index.scores(np.array([seed]))[0]
                ranked = _ranked(np.where(free, score, np.float32(-1)))
            piece = next(ranked, -1)
            if piece < 0:  # only seeds of later windows are left
                free = left > 0
                ranked = _ranked(np.where(free, score, np.float32(-1)))
                piece = next(ranked)
        sequence += 1


def _pack(stats: tuple):
    """Pieces of rows that come in the order of their keys, a shard of SHARD_ROWS documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, ds, held = TaskContext.get().partitionId() << 32, [], []
        names = ["d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out, used = [], 0
            for k, start, length, q, offset in pack_block([len(x) for x in held], held, stats=stats):
                used = max(used, q + 1)
                out.append((ds[k], start, length, zlib.crc32(held[k][start : start + length].astype("<u4").tobytes()), len(held[k]), sequence + q, offset))
            sequence += used
            ds.clear()
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        tokens = 0
        for b in batches:
            for d, x in zip(b.column("d").to_pylist(), b.column("ids").to_pylist()):
                ds.append(d)
                held.append(np.frombuffer(x, "<u2"))
                tokens += len(held[-1]) // WINDOW * WINDOW
                if len(held) == SHARD_ROWS or tokens > PART_TOKENS:  # whole windows of very long documents bound a shard too
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text, then END; a null or empty text is END alone. Each row of docs is packed,
    repeated ones too; very long texts give whole windows of their own; extra columns, of any name, don't matter; an empty
    table gives no rows.

    Documents are ranged by a lexical key, and each run of SHARD_ROWS of them is a shard of the index with all its terms
    under statistics of all documents, so a seed searches the documents that share its heaviest terms; the work is in
    proportion to the corpus. Copies and ties are ordered by hash, so any number of them spreads over shards.
    """
    base = docs.select(doc_key().alias("d"), text_or_empty().cast("binary").alias("x"))
    rows = base.mapInArrow(_tokens(path or tokenizer_path()), "d long, key binary, ids binary")
    rows = materialize(rows.withColumn("t", F.xxhash64("ids")), "tokens")
    stats = corpus_statistics(rows)
    parts = max(1, min(MOST_PARTS, -(-stats[2] // PART_TOKENS)))
    ranged = rows.repartitionByRange(parts, "key", "t", "d").sortWithinPartitions("key", "t", "d")
    out = ranged.select("d", "ids").mapInArrow(_pack(stats), "d long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(id_or_null("d").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
