"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees, in blocks of bounded size."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .components import connected_components

COSINE = 0.93
#: Vectors of a block on average, levels of its tree (covering radii 2, 1, 1/2, 1/4, 1/8), and prepared blocks kept by a task.
BLOCK, LEVELS, PREPARED = 1024, 5, 16
_SLACK = 1e-6


class CoverTree:
    """Nested levels of centres over unit vectors: those of level k are 2 ** (1 - k) apart and cover all points so.

    A level's centres begin with the level's above. A point hangs below its nearest centre on the last level, that one
    below its nearest one level up, and so on; reach is the largest distance from a centre to a point below it.
    """

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        found, near, own = [0], np.maximum(0, 2 - 2 * (x @ x[0])), np.zeros(len(x), np.int64)
        near[0] = 0
        self.centres, nearest = [], []
        for k in range(levels):
            while near[far := int(np.argmax(near))] > 4.0 ** (1 - k):  # the farthest point becomes a centre
                d = np.maximum(0, 2 - 2 * (x @ x[far]))
                d[far] = 0
                closer = d < near
                own[closer], near[closer] = len(found), d[closer]
                found.append(far)
            self.centres.append(np.array(found))
            nearest.append(own.copy())
        self.up = [nearest[k][self.centres[k + 1]] for k in range(levels - 1)]  # of each centre, the one above
        home, self.reach = nearest[-1], []
        for k in range(levels - 1, -1, -1):
            home = home if k == levels - 1 else self.up[k][home]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[self.centres[k][home]])))
            r = np.zeros(len(self.centres[k]))
            np.maximum.at(r, home, d)
            self.reach.insert(0, r)
        self.below = [self._groups(u, len(self.centres[k])) for k, u in enumerate(self.up)]
        self.members = self._groups(nearest[-1], len(found))

    @staticmethod
    def _groups(owner: np.ndarray, n: int) -> list[np.ndarray]:
        order = np.argsort(owner, kind="stable")
        return np.split(order, np.searchsorted(owner[order], np.arange(1, n)))


def threshold_pairs(a: CoverTree, b: CoverTree, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a dot product of at least `cosine`; with a is b each pair once, i < j.

    Dual traversal: a pair of nodes whose centres are farther apart than the threshold distance and both reaches cannot
    hold a pair and is dropped; others give way to the pairs of their children, the last level's points are multiplied.
    """
    same = a is b
    limit = np.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    i = j = np.zeros(1, np.int64)
    for k in range(len(a.centres)):
        if k:
            grown_i = [np.repeat(a.below[k - 1][p], len(b.below[k - 1][q])) for p, q in zip(i.tolist(), j.tolist())]
            grown_j = [np.tile(b.below[k - 1][q], len(a.below[k - 1][p])) for p, q in zip(i.tolist(), j.tolist())]
            i, j = (np.concatenate([*g, np.zeros(0, np.int64)]) for g in (grown_i, grown_j))
            if same:
                n = len(a.centres[k])
                once = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
                i, j = once // n, once % n
        g = a.x[a.centres[k]] @ b.x[b.centres[k]].T
        keep = np.sqrt(np.maximum(0, 2 - 2 * g[i, j])) <= limit + a.reach[k][i] + b.reach[k][j]
        i, j = i[keep], j[keep]
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in zip(i.tolist(), j.tolist()):
        mp, mq = a.members[p], b.members[q]
        g = a.x[mp] @ b.x[mq].T
        u, v = np.nonzero(g >= cosine - 1e-12)
        close = np.abs(g[u, v] - cosine) < 1e-12  # within rounding: once more, one by one
        good = np.ones(len(u), bool)
        for t in np.flatnonzero(close).tolist():
            s, e = a.x[mp[u[t]]], b.x[mq[v[t]]]
            good[t] = float(np.dot(s, e)) / (float(np.sqrt(np.dot(s, s))) * float(np.sqrt(np.dot(e, e)))) >= cosine
        u, v = mp[u[good]], mq[v[good]]
        if same:
            u, v = (u[u < v], v[u < v]) if p == q else (np.minimum(u, v), np.maximum(u, v))
        out_i.append(u)
        out_j.append(v)
    return np.concatenate(out_i), np.concatenate(out_j)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: nodes, class sizes, vectors, and a ball around them."""
    rows = rows.sort_values("node")
    x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    unit = _unit(x)
    centre = unit.mean(axis=0)
    length = np.sqrt(centre @ centre)
    centre = centre / length if length > 0 else unit[0]
    radius = float(np.sqrt(np.maximum(0, 2 - 2 * (unit @ centre)).max()))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "block": [key[2]], "nodes": [rows["node"].to_numpy()], "sizes": [rows["size"].to_numpy()], "x": [x.tobytes()], "centre": [centre], "radius": [radius]})


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each index is connected to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _traverse(cosine: float):
    """Of each pair of blocks: for every node with links there, the vectors linked and one node it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict = OrderedDict()

        def tree(key, side: str, r: int, b: pa.RecordBatch) -> CoverTree:
            if key not in ready:
                x = np.frombuffer(b.column(f"x{side}")[r].as_py(), np.float64).reshape(-1, key[1])
                ready[key] = CoverTree(_unit(x))
                if len(ready) > PREPARED:
                    ready.popitem(last=False)
            return ready[key]

        for b in batches:
            for r in range(b.num_rows):
                label, dim, one, two = (b.column(c)[r].as_py() for c in ("label", "dim", "a", "b"))
                ta = tree((label, dim, one), "a", r, b)
                tb = ta if one == two else tree((label, dim, two), "b", r, b)
                i, j = threshold_pairs(ta, tb, cosine)
                if not len(i):
                    continue
                na, sa = (np.array(b.column(c)[r].as_py(), np.int64) for c in ("nodesa", "sizesa"))
                nb, sb = (np.array(b.column(c)[r].as_py(), np.int64) for c in ("nodesb", "sizesb"))
                if one == two:
                    nodes, sizes = na, sa
                else:
                    nodes, sizes, j = np.concatenate([na, nb]), np.concatenate([sa, sb]), j + len(na)
                links = np.bincount(i, sizes[j], len(nodes)) + np.bincount(j, sizes[i], len(nodes))
                root = _roots(len(nodes), i, j)
                has = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(links[has].astype(np.int64)), pa.array(nodes[root[has]])], names=["node", "links", "root"])

    return run


def near_vectors(table: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per input row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and their cosine in double precision is at least `cosine`. Null labels, null,
    empty or zero vectors, vectors with null or non-finite components, and vectors of different lengths link with
    nothing. n_links counts the other rows linked directly, component_id is the smallest vec_id reachable (null ids
    don't count), kept tells whether it is the row's own. Repeated rows count as rows.

    Equal vectors of a label form one class. Classes are ordered by their two largest axes and their signs, so that a
    block of about `block` holds neighbours, whatever the size of a label. Pairs of blocks whose balls are farther apart
    than the threshold are dropped before any vector moves; the others are traversed by their trees. Only counts and a
    spanning star leave a task, never all pairs.
    """
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    some = F.exists("vec", lambda v: F.coalesce(v != 0, F.lit(False)))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & some
    rows = rows.withColumn("node", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("label", "vec")))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    axis = F.transform("vec", lambda v, i: F.struct((-F.abs(v)).alias("a"), (2 * i + (v < 0).cast("int")).alias("c")))
    top = F.transform(F.slice(F.sort_array(axis), 1, 2), lambda s: s["c"])
    cell = F.get(top, F.lit(0)).cast("long") * (1 << 31) + F.coalesce(F.get(top, F.lit(1)), F.lit(0))
    classes = materialize(classes.select("node", "vec_id", "size", "label", "vec", F.size("vec").alias("dim"), cell.alias("cell")), "classes")
    before = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = classes.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    cells = cells.select("label", "dim", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.floor((F.col("start") + F.pmod(F.xxhash64("node"), F.col("n"))) / F.lit(block)).cast("long")
    blocked = classes.join(cells, ["label", "dim", "cell"]).select("label", "dim", at.alias("block"), "node", "size", "vec")
    packs = blocked.groupBy("label", "dim", "block").applyInPandas(_pack, "label string, dim int, block long, nodes array<long>, sizes array<long>, x binary, centre array<double>, radius double")
    packs = materialize(packs, "blocks")
    ball = lambda c: packs.select("label", "dim", F.col("block").alias(c), F.col("centre").alias(f"c{c}"), F.col("radius").alias(f"r{c}"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    limit = F.lit(float(np.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK))
    near = (F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) <= limit + F.col("ra") + F.col("rb")) & (F.col("a") <= F.col("b"))
    pairs = ball("a").join(ball("b"), ["label", "dim"]).filter(near).select("label", "dim", "a", "b")
    pairs = materialize(pairs, "block-pairs")
    side = lambda c: packs.select("label", "dim", F.col("block").alias(c), F.col("nodes").alias(f"nodes{c}"), F.col("sizes").alias(f"sizes{c}"), F.col("x").alias(f"x{c}"))
    both = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    found = materialize(both.mapInArrow(_traverse(cosine), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = classes.select("node", "vec_id", "size").join(links, "node", "left").join(parts, "node", "left")
    whole = materialize(whole.select("node", "vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "nodes")
    ids = whole.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    placed = whole.join(ids, "component").select(F.col("node").alias("pn"), "n_links", "component_id")
    out = rows.select("vec_id", "node").join(placed, F.col("node") == F.col("pn"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
