"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed into keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACE, ascii_lower, discard, doc_key, id_or_null, materialize, text_or_empty

MIN_CHARS, MIN_DOCS = 40, 5
#: Undecided lines of one key that a task holds before it passes them on.
HELD_LINES = 50_000
#: Column that with_kept_text adds.
KEPT = "__sl_kept"
_MARKED = "kind int, h1 long, h2 long, d long, t long, pos int, n_lines int, n_docs long"
_COLS = ("h1", "h2", "d", "t", "pos", "n_lines")


def _rows(kind: int, cols, n_docs: int = 0) -> pa.RecordBatch:
    n = len(cols[0])
    types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    arrays = [np.full(n, kind, np.int32), *(np.asarray(c, t) for c, t in zip(cols, types)), np.full(n, n_docs, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["kind", *_COLS, "n_docs"])


class _Key:
    """The key that a partition's stream is in: its documents so far, and its lines that are not decided."""

    def __init__(self, key, opening: bool):
        self.key, self.opening, self.parts, self.held = key, opening, [], 0
        self.docs, self.first, self.last, self.passed_on = 0, None, None, False

    def add(self, cols, docs: int) -> None:
        self.first = int(cols[2][0]) if self.first is None else self.first
        self.docs, self.last = self.docs + docs, int(cols[2][-1])
        self.parts.append(cols)
        self.held += len(cols[0])

    def take(self):
        cols = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.held = [], 0
        return cols

    def pass_on(self):
        self.passed_on = True
        yield _rows(1, self.take())

    def close(self, min_docs: int, final: bool = False):
        """Partition ends cut keys: their lines go on as kind 1 with a summary (kind 2); others are decided (kind 0)."""
        if self.opening or final or self.passed_on:
            if self.held:
                yield _rows(1, self.take())
            yield _rows(2, ([self.key[0]], [self.key[1]], [self.first], [0], [0], [0]), self.docs)
        elif self.docs >= min_docs:
            cols = self.take()
            drop = cols[2] != self.first
            if drop.any():
                yield _rows(0, [c[drop] for c in cols])


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = [batch.column(x).to_numpy(zero_copy_only=False) for x in _COLS]
            new = np.ones(n, bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            fresh = new.copy()
            fresh[1:] |= c[2][1:] != c[2][:-1]
            head = (int(c[0][0]), int(c[1][0]))
            if now is not None and now.key == head:
                fresh[0] = int(c[2][0]) != now.last
            elif now is not None:
                yield from now.close(min_docs)
                now = _Key(head, False)
            else:
                now = _Key(head, True)
            docs = np.add.reduceat(fresh.astype(np.int64), starts)
            now.add([x[: ends[0]] for x in c], int(docs[0]))
            if len(starts) > 1:
                yield from now.close(min_docs)
                a, b = starts[1], starts[-1]  # keys that begin and end in this batch
                if b > a:
                    sizes, some = (ends - starts)[1:-1], np.zeros(len(starts) - 2, bool)
                    some |= docs[1:-1] >= min_docs
                    drop = np.repeat(some, sizes) & (c[2][a:b] != np.repeat(c[2][starts[1:-1]], sizes))
                    if drop.any():
                        yield _rows(0, [x[a:b][drop] for x in c])
                now = _Key((int(c[0][b]), int(c[1][b])), False)
                now.add([x[b:] for x in c], int(docs[-1]))
            if now.held > HELD_LINES:
                yield from now.pass_on()
        if now is not None:
            yield from now.close(min_docs, final=True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for gone, n in zip(b.column("gone").to_pylist(), b.column("n_lines").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["d", "t", "n_lines", "n_dropped", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Which lines stay, for each document that loses any: (d, t, n_lines, n_dropped, keep_bitmap).

    d is the doc_id (NO_ID for null), t a fingerprint of the text, so rows that share a doc_id but not their text are
    told apart; keep_bitmap is zlib over one bit per line. A key is a line stripped of ASCII white space with A-Z
    lower-cased. Keys of min_chars code points or more that min_docs different doc_ids hold stay only in the largest
    doc_id; null ids count as one document, the smallest. No text leaves the scan: lines travel as 128-bit hashes,
    ranged by (hash, document), so a key of any frequency spreads over as many tasks as its documents need.
    """
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x"))
    base = base.select("d", F.xxhash64("x").alias("t"), F.split("x", "\n", -1).alias("lines"))
    lines = base.select("d", "t", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    lines = lines.select("d", "t", "n_lines", "pos", key.alias("k")).filter(F.length("k") >= min_chars)
    hashed = lines.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2"), "d", "t", "pos", "n_lines")
    hashed = materialize(hashed, "hashes")  # finding the ranges' bounds reads these, not the texts once more
    order = ["h1", "h2", F.col("d").desc()]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "t", "pos")
    marked = materialize(ranged.mapInArrow(_stream(min_docs), _MARKED), "lines")
    discard(hashed)
    # Two cut keys for each range partition at most, so the lines of a hot key stay in the tasks that hold them.
    cut = marked.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("d").alias("keeper"))
    cut = cut.filter(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    late = marked.filter("kind = 1").join(F.broadcast(cut), ["h1", "h2"]).filter("d <> keeper")
    gone = marked.filter("kind = 0").select("d", "t", "pos", "n_lines").unionByName(late.select("d", "t", "pos", "n_lines"))
    per_doc = gone.groupBy("d", "t").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return per_doc.mapInArrow(_bitmaps, "d long, t long, n_lines int, n_dropped long, keep_bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, bitmap in zip(b.column("x").to_pylist(), b.column("keep_bitmap").to_pylist()):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if bitmap is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).tolist()
                lines = [x for x, k in zip(lines, keep) if k]
                text = "\n".join(lines)
            n_dropped.append(n_lines[-1] - (len(lines) if bitmap is not None else n_lines[-1]))
            kept.append(text)
        cols = [b.column(i) for i, n in enumerate(b.schema.names) if n not in ("x", "keep_bitmap")]
        names = [n for n in b.schema.names if n not in ("x", "keep_bitmap")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])


def _joined(docs: DataFrame, **limits) -> DataFrame:
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x")).withColumn("t", F.xxhash64("x"))
    maps = line_keep_bitmaps(docs, **limits).select(F.col("d").alias("md"), F.col("t").alias("mt"), "keep_bitmap")
    return base.join(maps, (F.col("d") == F.col("md")) & (F.col("t") == F.col("mt")), "left").drop("md", "mt", "t")


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """One row per input row: doc_id, n_lines (before dropping), n_dropped, kept (the text that stays).

    A null or empty text is one empty line and stays as it is; repeated rows come out alike; extra columns don't matter.
    """
    out = _joined(docs, **limits).mapInArrow(_apply, "d long, n_lines long, n_dropped long, kept string")
    return out.select(id_or_null("d").alias("doc_id"), "n_lines", "n_dropped", "kept")


@F.pandas_udf(StringType())
def _keep_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    out = []
    for x, b in zip(text, bitmap):
        if x is not None:
            lines = x.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines)).tolist()
            x = "\n".join(y for y, k in zip(lines, keep) if k)
        out.append(x)
    return pd.Series(out, dtype=object)


def with_kept_text(docs: DataFrame, **limits) -> DataFrame:
    """docs with one more column, KEPT: the text that stays. Null texts stay null; no other column is touched."""
    mine = {n: f"__sl_{n}" for n in ("d", "t", "md", "mt", "map")}
    base = docs.withColumn(mine["d"], doc_key()).withColumn(mine["t"], F.xxhash64(text_or_empty()))
    maps = line_keep_bitmaps(docs, **limits).select(F.col("d").alias(mine["md"]), F.col("t").alias(mine["mt"]), F.col("keep_bitmap").alias(mine["map"]))
    joined = base.join(maps, (F.col(mine["d"]) == F.col(mine["md"])) & (F.col(mine["t"]) == F.col(mine["mt"])), "left")
    cut = F.col(mine["map"]).isNotNull()
    return joined.withColumn(KEPT, F.when(cut, _keep_lines(F.when(cut, F.col("text")), mine["map"])).otherwise(F.col("text"))).drop(*mine.values())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _apply(batches):
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in b.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("n_lines"), b.column("n_dropped"), pa.array(sha)], names=["d", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup_digest(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays, without moving that text on.

    One row per input row. Null and empty texts are one empty line; repeated rows come out alike; very long texts are read
    whole; other columns don't matter, whatever their names; an empty table gives no rows.
    """
    out = _joined(docs, **limits).mapInArrow(_digest, "d long, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(id_or_null("d").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")
