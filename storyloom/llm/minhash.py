"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_key, id_or_null, materialize, text_or_empty
from .components import connected_components
from .textvec import mix, spans, spans_hash, word_hashes

SHINGLE, PERCENT = 5, 80
#: Rounds in which buckets are tried by one member each once more, before unlinked members are joined by rare shingles.
STAR_ROUNDS = 1
#: Of a round's candidates between two components, how many meet their texts before the others are looked at.
NEAREST = 16


@dataclass(frozen=True)
class Index:
    """values minima of 16 bits; two signatures within `distance` differing values share a key of some chunk.

    Pigeonhole: `distance` errors over `chunks` chunks leave one with at most distance // chunks, so every choice of that
    many values of a chunk is left out in turn. At similarity 0.8 a pair differs in 12.8 of 64 values on average, and in
    more than 27 with a probability of 1.4e-5, the chance that a link of the least similarity is missed. A signature holds
    `checked` values, of which the first `values` are indexed; candidates may differ in `far` of all. At similarity 0.8
    more than 48 of 128 differ with a probability of 1.4e-6; at 0.5 up to 48 do with one of 0.003, so pairs of that kind
    never meet their texts.
    """

    values: int = 64
    distance: int = 27
    chunks: int = 14
    checked: int = 128
    far: int = 48

    def keys(self) -> list[tuple[int, ...]]:
        """The values that each key holds."""
        errors = self.distance // self.chunks
        out = []
        for chunk in np.array_split(np.arange(self.values), self.chunks):
            out += [tuple(i for i in chunk if i not in gone) for gone in combinations(chunk, min(errors, len(chunk) - 1))]
        return out


DEFAULT = Index()


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    at = np.arange(max(1, n - size + 1))
    return np.unique(mix(spans_hash(words, at, np.minimum(at + size, n)) + np.uint64(min(n, size))))


def _signatures(size: int, index: Index):
    """Of each text: the size of its set, the set as a number of 128 bits (a, b), and its signature; a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _constants(index.checked, 1) | np.uint64(1), _constants(index.checked, 2)
        one, two = _constants(2, 3)
        for b in batches:
            column = b.column("x")
            for i, j in spans(pc.binary_length(column).to_pylist()):
                words, at = word_hashes([x.as_py().lower() for x in column[i:j]])
                sizes, sets, sigs = np.diff(at), np.zeros((2, j - i), np.uint64), []
                for k in range(j - i):
                    s = shingle_hashes(words[at[k] : at[k + 1]], size)
                    low = np.full(index.checked, 2**64 - 1, np.uint64)
                    for c in range(0, len(s), 512):
                        np.minimum(low, (s[c : c + 512, None] * mul + add).min(axis=0), out=low)
                    sizes[k] = len(s)
                    # sums of the hashes, each mixed again in two ways
                    sets[:, k] = mix(s ^ one).sum(dtype=np.uint64), mix(s + two).sum(dtype=np.uint64)
                    sigs.append(((low >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                cols = [pa.array(sizes), *(pa.array(x.view(np.int64)) for x in sets), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i), b.column("t").slice(i, j - i), *cols], names=["d", "t", "n", "a", "b", "sig"])

    return run


def _keys(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = index.keys()
        coef = np.zeros((index.values, len(kept)), np.uint64)
        each = _constants(index.values * len(kept), 4).reshape(coef.shape) | np.uint64(1)
        for k, idx in enumerate(kept):
            coef[list(idx), k] = each[list(idx), k]
        salt = _constants(len(kept), 5)
        for b in batches:
            node, sigs = b.column("node").to_numpy(), b.column("sig").to_pylist()
            for a in range(0, len(sigs), 512):
                v = np.frombuffer(b"".join(sigs[a : a + 512]), "<u2").reshape(-1, index.checked)[:, : index.values].astype(np.uint64)
                key = mix(mix(v + np.uint64(1)) @ coef + salt)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node[a : a + 512], len(kept)))], names=["key", "node"])

    return run


def _close(index: Index, percent: int):
    """Pairs within the signature distance whose sizes allow the similarity, and in how many values they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, index.checked) for c in ("sa", "sb"))
            wrong = sa != sb
            far = wrong.sum(axis=1)
            ok = pa.array((wrong[:, : index.values].sum(axis=1) <= index.distance) & (far <= index.far) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
            cols = [b.column(c).filter(ok) for c in ("a", "b", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(far.astype(np.int32)).filter(ok)], names=["a", "b", "lo", "hi", "far"])

    return run


def _confirm(size: int, percent: int):
    def shingles(text: bytes) -> set:
        w = text.lower().split()
        return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, set())
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                if last[0] != a[i]:
                    last = (a[i], shingles(x.as_py()))
                other = shingles(y.as_py())
                common = len(last[1] & other)
                ok.append(100 * common >= percent * (len(last[1]) + len(other) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for k, text in enumerate(b.column("x")):
                h = shingle_hashes(word_hashes([text.as_py().lower()])[0], size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node[k])), pa.array(h.view(np.int64))], names=["node", "h"])

    return run


def _pair(x: str, y: str, low: str = "a", high: str = "b") -> tuple[Column, Column]:
    return F.least(x, y).alias(low), F.greatest(x, y).alias(high)


def _prefix_pairs(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, lo, hi): pairs of members (node, comp, n) of different comp that may reach the similarity, by their rarest shingles.

    An exact refinement of buckets whose members are neither linked nor far apart, where pairs would grow with the square
    of the bucket. Its pairs are held against the signature distance and then the full sets, as all others are.

    With shingles ordered by their number of members, then hash, two sets of that similarity share one among their rarest
    n - ceil(n * percent / 100) + 1, and the shingles from the first shared one on are enough for the overlap. Shingles of
    one member only stand first and join nothing, so members far from all others, and passages that all hold, bring no
    pair.
    """
    each = texts.join(members.select("node"), "node").mapInArrow(_shingle_rows(size), "node long, h long")
    each = materialize(each, "shingles")
    counts = each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    shared = each.join(counts, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("hs"))
    shared = shared.join(members, "node")
    alone, reach = F.col("n") - F.size("hs"), F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1
    prefix = F.slice("hs", F.lit(1), F.greatest(reach - alone, F.lit(0)).cast("int"))
    posts = shared.select("node", "comp", "n", alone.alias("alone"), F.posexplode(prefix).alias("i", "s"))
    posts = materialize(posts.select(F.col("s.h").alias("h"), "node", "comp", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "prefixes")
    torn = posts.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    posts = posts.join(torn, "h")
    other = posts.select("h", F.col("node").alias("onode"), F.col("comp").alias("ocomp"), F.col("n").alias("on"), F.col("rest").alias("orest"))
    enough = (100 + percent) * F.least("rest", "orest") >= percent * (F.col("n") + F.col("on"))
    return posts.join(other, "h").filter((F.col("comp") < F.col("ocomp")) & enough).select(*_pair("node", "onode"), *_pair("comp", "ocomp", "lo", "hi"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, index: Index = DEFAULT) -> DataFrame:
    """One row per input row: (d, t, doc_id, n_shingles, component_id, kept).

    A document's set is its distinct shingles of `shingle` words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text with
    fewer words is one shingle. Documents link if 100 * intersection >= percent * union on the full sets.
    component_id is the smallest doc_id reachable over links (null ids don't count), kept tells whether it is the
    document's own. Texts without words link with nothing: their component is their own doc_id. Repeated rows come out
    alike; very long texts are worked on alone; other columns, of any name, don't matter; an empty table gives no rows.

    Equal sets, by 128 bits of them, form one class. Classes that share a key of the multi-index are candidates. A bucket's
    members are tried against one of them first; then those outside the bucket's largest component against one of it, so
    each member brings a pair for each of its keys at most. In the end all members of buckets that are still apart are
    joined by their rarest shingles, so no component is missed. Of a round's pairs the nearest between two components meet
    their texts first; all others do in the end, if their components are still apart then.
    """
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x"))
    base = base.select("d", F.xxhash64("x").alias("t"), F.col("x").cast("binary").alias("x"))
    rows = materialize(base.mapInArrow(_signatures(shingle, index), "d long, t long, n long, a long, b long, sig binary"), "signatures")
    classes = rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("d", "t")).alias("at"), F.min(id_or_null("d")).alias("low"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # once written, the number stays
    keys = classes.select("node", "sig").mapInArrow(_keys(index), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("lead")).filter("c > 1").drop("c")
    buckets = materialize(keys.join(shared, "key"), "buckets")
    member = buckets.select("node").distinct()
    members = materialize(classes.join(member, "node"), "members")
    home = members.select("node", "at.d", "at.t")
    texts = base.join(home, ["d", "t"]).select("node", "x").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    sig = members.select("node", "n", "sig")

    def close(pairs: DataFrame) -> DataFrame:
        side = lambda c: sig.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "lo", "hi", "na", "nb", "sa", "sb")
        return materialize(both.mapInArrow(_close(index, percent), "a long, b long, lo long, hi long, far int"), "close")

    def confirmed(pairs: DataFrame) -> DataFrame:
        text = lambda c: texts.select(F.col("node").alias(c), F.col("x").alias(f"x{c}"))
        full = pairs.select("a", "b").join(text("b").hint("merge"), "b").join(text("a").hint("merge"), "a").select("a", "b", "xa", "xb")
        return materialize(full.mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")

    def merged(found: DataFrame, links: DataFrame) -> DataFrame:
        return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    tried = buckets.filter("node <> lead").select(*_pair("node", "lead")).distinct()
    tried = materialize(tried, "tried")
    found = connected_components(confirmed(close(tried.select("a", "b", F.col("a").alias("lo"), F.col("b").alias("hi")))))
    left, fresh, step = buckets.select("key", "node"), True, 0
    nears, firsts = [], []
    while True:
        label = found.select("node", "component")
        left = left.select("key", "node").join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        # A bucket of two was settled by its first pair; one whose members are connected is settled too.
        parts = left.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("key", "node", F.lit(step))).alias("pick"))
        torn = parts.groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("parts"), F.max_by(F.struct("pick", "comp"), F.struct("c", "comp")).alias("most")).filter("c > 2 and parts > 1")
        left = materialize(left.join(torn.select("key", "most.pick", F.col("most.comp").alias("ocomp")), "key"), "left")
        if not left.limit(1).count():
            break
        last = not fresh or step >= STAR_ROUNDS
        if last:
            pairs = _prefix_pairs(left.select("node", "comp").distinct().join(sig.select("node", "n"), "node"), texts, shingle, percent)
        else:
            pairs = left.filter("comp <> ocomp").select(*_pair("node", "pick"), *_pair("comp", "ocomp", "lo", "hi"))
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        near = close(pairs)
        rank = F.row_number().over(Window.partitionBy("lo", "hi").orderBy("far", "a", "b"))
        first = near.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).drop("rank")
        nears, firsts = [*nears, near], [*firsts, first]
        more = confirmed(first)
        fresh = bool(more.limit(1).count())
        if fresh:
            found = merged(found, more)
        if last:
            low, high = (found.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}")) for c in ("lo", "hi"))
            apart = F.coalesce("new_lo", "lo") != F.coalesce("new_hi", "hi")
            near, first = reduce(DataFrame.unionByName, nears), reduce(DataFrame.unionByName, firsts)
            rest = near.join(low, "lo", "left").join(high, "hi", "left").filter(apart).join(first.select("a", "b"), ["a", "b"], "left_anti")
            rest = materialize(rest.select("a", "b"), "rest")
            if rest.limit(1).count():
                found = merged(found, confirmed(rest))
            break
        tried, step = tried.unionByName(pairs.select("a", "b")), step + 1
    label = classes.select("a", "b", "n", "low", "node").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    ids = label.groupBy("c").agg(F.min("low").alias("component_id"))
    placed = label.join(ids, "c").select("a", "b", "n", "component_id")
    out = rows.select("d", "t", "n", "a", "b").join(placed, ["a", "b", "n"], "left")
    component = F.coalesce("component_id", id_or_null("d"))
    return out.select("d", "t", id_or_null("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(id_or_null("d") == component, component.isNull()).alias("kept"))


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that stay: one of each group, unchanged; of repeated rows the first."""
    kept = near_duplicates(docs, **settings).filter("kept").select(F.col("d").alias("__sl_d"), F.col("t").alias("__sl_t")).distinct()
    base = docs.withColumn("__sl_d", doc_key()).withColumn("__sl_t", F.xxhash64(text_or_empty()))
    first = Window.partitionBy("__sl_d", "__sl_t").orderBy("__sl_d")
    out = base.join(kept, ["__sl_d", "__sl_t"], "left_semi").withColumn("__sl_k", F.row_number().over(first))
    return out.filter(F.col("__sl_k") == 1).select(*docs.columns)
