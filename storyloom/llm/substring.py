"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import doc_key, id_or_null, materialize, release, text_or_empty
from .textvec import slices, sliding, windows, word_hashes

WINDOW = 35
#: Words of the short runs inside a window of which the least hash is its anchor.
ANCHOR = 10
#: Bytes of text whose windows are counted together before they travel.
BLOCK = 1 << 20
KEPT = "__sl_kept"
_TOP = np.uint64(2**64 - 1)


class _Slice:
    """Anchors of all windows in a slice of texts. anchor[i] belongs to the window that begins at word i, if valid[i]."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words, self.at = word_hashes(texts)
        n = len(self.words)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.at))
        left = self.at[1:][self.text_of] - np.arange(n)  # words from here to the text's end
        self.valid = left >= window
        self.grams = np.full(n, _TOP)
        g = windows(self.words, anchor)
        self.grams[: len(g)] = np.where(left[: len(g)] >= anchor, g, _TOP)
        span = window - anchor + 1
        self.anchors = np.full(n, _TOP)
        low = sliding(np.minimum, self.grams, span)
        self.anchors[: len(low)] = low
        self.span = span

    def selected(self) -> np.ndarray:
        """Places of the short runs that are the least in any window that holds them; ties all count."""
        n = len(self.words)
        chosen = np.where(self.valid, self.anchors, np.uint64(0))
        top = sliding(np.maximum, np.concatenate([np.zeros(self.span - 1, np.uint64), chosen]), self.span)
        return np.flatnonzero((top[:n] == self.grams) & (self.grams != _TOP)) if n else np.zeros(0, np.int64)


def _count_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("x").to_pylist()
            for i, j in slices(texts):
                s = _Slice(texts[i:j], window, anchor)
                v, n = np.unique(s.grams[s.selected()], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int32))], names=["v", "n"])

    return run


def _text_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, d, t = b.column("x").to_pylist(), b.column("d").to_numpy(), b.column("t").to_numpy()
            for i, j in slices(texts):
                s = _Slice(texts[i:j], window, anchor)
                place = s.selected()
                both = np.unique(np.rec.fromarrays([s.text_of[place], s.grams[place]], names="i,v"))
                yield pa.RecordBatch.from_arrays([pa.array(both.v.view(np.int64)), pa.array(d[i:j][both.i]), pa.array(t[i:j][both.i])], names=["v", "d", "t"])

    return run


def _runs(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of starts in order within each text: where runs of consecutive ones begin, and their lengths."""
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start)))


def _window_rows(window: int, anchor: int):
    """For each text with anchors `vs` that occur elsewhere, its windows with such anchors, counted within a block of texts.

    (h, d, t, start, n): a window hash with its first place in the block, n = 0; of hashes that the block holds twice or more
    also every place, as runs of n starts with h null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, d, t, vs = b.column("x").to_pylist(), b.column("d").to_numpy(), b.column("t").to_numpy(), b.column("vs").to_pylist()
            for i, j in slices(texts, BLOCK):
                s = _Slice(texts[i:j], window, anchor)
                wanted = np.zeros(len(s.words), bool)
                for k in range(i, j):
                    a, e = s.at[k - i], s.at[k - i + 1]
                    wanted[a:e] = s.valid[a:e] & np.isin(s.anchors[a:e].view(np.int64), np.asarray(vs[k], np.int64))
                place = np.flatnonzero(wanted)
                hashes = windows(s.words, window)[place]  # only whole windows are wanted
                found, first, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                at = place[first]
                again = place[count[back] > 1]
                head, n = _runs(s.text_of[again], again)
                both = np.concatenate([at, again[head]])
                own = s.text_of[both]
                h = pa.array(np.concatenate([found.view(np.int64), np.zeros(len(head), np.int64)]), mask=np.arange(len(both)) >= len(at))
                size = np.concatenate([np.zeros(len(at), np.int32), n.astype(np.int32)])
                rows = [h, pa.array(d[i:j][own]), pa.array(t[i:j][own]), pa.array((both - s.at[own]).astype(np.int32)), pa.array(size)]
                yield pa.RecordBatch.from_arrays(rows, names=["h", "d", "t", "start", "n"]).take(pa.array(np.argsort(both, kind="stable")))  # alike ones together

    return run


def _intervals(window: int):
    """(d, t, start, stop): words under the windows of each text, merged; rows (d, t, start, n) come in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, t, start, n = (b.column(c).to_numpy() for c in ("d", "t", "start", "n"))
            start, stop = start.astype(np.int64), start.astype(np.int64) + n - 1 + window
            other = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
            text = np.cumsum(other) << 32
            reach = np.maximum.accumulate(text + stop)
            first = np.flatnonzero(np.append(True, text[1:] + start[1:] > reach[:-1]))
            last = np.append(first[1:], len(d)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), pa.array(start[first].astype(np.int32)), pa.array((reach[last] - text[last]).astype(np.int32))], names=["d", "t", "start", "stop"])

    return run


def _base(docs: DataFrame) -> DataFrame:
    """(d, t, x): the texts as every join here takes them, so that the joins of one query share one shuffle of them."""
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x"))
    return base.select("d", F.xxhash64("x").alias("t"), F.col("x").cast("binary").alias("x"))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removal intervals: (d, t, start, stop), the words from start to before stop of the text t of document d.

    Every window of `window` words is hashed. Equal windows hold the same anchor, the least hash of the short runs in
    them, so a window can repeat only if its anchor does: one count over anchors, a twelfth of the windows, clears the
    rest of the corpus. The windows that are left are counted by hash in Spark. A block of texts sends each of its hashes
    once, so a passage of any frequency brings its key one row for each block; windows that a block itself holds twice
    are settled there.
    """
    anchor = min(ANCHOR, window)
    base = _base(docs)
    counts = base.select("x").mapInArrow(_count_anchors(window, anchor), "v long, n int")
    counts = materialize(counts.groupBy("v").agg(F.sum("n").alias("n")).filter("n > 1").select("v"), "anchors")
    found = base.mapInArrow(_text_anchors(window, anchor), "v long, d long, t long").join(counts, "v")
    found = found.groupBy("d", "t").agg(F.collect_set("v").alias("vs"))
    rows = base.join(found.hint("merge"), ["d", "t"]).mapInArrow(_window_rows(window, anchor), "h long, d long, t long, start int, n int")
    blocks = F.count("*").over(Window.partitionBy("h"))
    across = rows.filter("h is not null").withColumn("blocks", blocks).filter("blocks > 1").select("d", "t", "start", F.lit(1).alias("n"))
    starts = rows.filter("h is null").select("d", "t", "start", "n").unionByName(across)
    ordered = starts.repartition("d", "t").sortWithinPartitions("d", "t", "start")
    return ordered.mapInArrow(_intervals(window), "d long, t long, start int, stop int")


def _hits(words: DataFrame) -> DataFrame:
    return words.groupBy(F.col("d").alias("__sl_md"), F.col("t").alias("__sl_mt")).agg(F.collect_list(F.struct("start", "stop")).alias("__sl_hits"))


def _with_starts(docs: DataFrame, window: int) -> DataFrame:
    """docs with the column __sl_hits: intervals of words that go, null without any."""
    hits = materialize(repeated_words(docs, window), "hits")
    release(docs.sparkSession)  # the first shuffle of texts, before the second
    hits = _hits(hits)
    base = docs.withColumn("__sl_d", doc_key()).withColumn("__sl_t", F.xxhash64(text_or_empty()))
    return base.join(hits.hint("merge"), (F.col("__sl_d") == F.col("__sl_md")) & (F.col("__sl_t") == F.col("__sl_mt")), "left").drop("__sl_md", "__sl_mt", "__sl_t")


def removal_mask(n_words: int, hits: list) -> np.ndarray:
    """True for each word inside an interval."""
    mask = np.zeros(n_words, bool)
    for h in hits:
        mask[h["start"] : h["stop"]] = True
    return mask


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha = [], [], []
        for x, hits in zip(b.column("x"), b.column("__sl_hits").to_pylist()):
            words = x.as_py().split()
            n.append(len(words))
            if hits:
                mask = removal_mask(len(words), hits)
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            gone.append(n[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("__sl_d"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["d", "n_words", "n_removed", "kept_sha256"])


def substring_dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, SHA-256 of the words that stay, joined by one space.

    Null or empty texts have no words; texts shorter than a window lose none. Copies of a text lose all that is as long
    as a window, repeated rows too. Rows of one doc_id with different texts are told apart. A very long text is a block of
    its own. Other columns don't matter, whatever their names. An empty table gives no rows. Texts are shuffled once.
    """
    base, hits = _base(docs), _hits(repeated_words(docs, window))
    joined = base.join(hits.hint("merge"), (F.col("d") == F.col("__sl_md")) & (F.col("t") == F.col("__sl_mt")), "left")
    joined = joined.select(F.col("d").alias("__sl_d"), "x", "__sl_hits")
    out = joined.mapInArrow(_digest, "d long, n_words long, n_removed long, kept_sha256 string")
    return out.select(id_or_null("d").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _cutter():
    space = b" \t\n\x0b\f\r"

    def cut(x: str, hits: list) -> str:
        raw = x.encode()
        a = np.frombuffer(raw, np.uint8)
        word = np.concatenate([[False], ~np.isin(a, np.frombuffer(space, np.uint8)), [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[0::2], edge[1::2]
        mask = removal_mask(len(starts), hits)
        keep = np.ones(len(a), bool)
        change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        for i, j in zip(change[0::2], change[1::2]):  # each maximal interval, with the space before it
            keep[(ends[i - 1] if i else 0) : ends[j - 1]] = False
        return raw[:0].join([a[keep].tobytes()]).decode()

    @F.pandas_udf(StringType())
    def kept(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cut(x, h) for x, h in zip(text, hits)], dtype=object)

    return kept


def with_kept_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with one more column, KEPT: its text without the removed words; the white space between others stays."""
    joined = _with_starts(docs, window)
    hit = F.col("__sl_hits").isNotNull()
    return joined.withColumn(KEPT, F.when(hit, _cutter()(F.when(hit, F.col("text")), "__sl_hits")).otherwise(F.col("text"))).drop("__sl_d", "__sl_hits")
