"""Steps that must not gather, square or hold what a larger table brings: small tables with small limits, and what tasks see."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import bm25, candidates, coreference, grid, ordering, similarity


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bm25_over_many_cells(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(60)], k=rng.randint(0, 12))) for _ in range(150)]
    for name, value in (("CELL", 30), ("WORTH", 20)):
        monkeypatch.setattr(grid, name, value)
    for name, value in (("BLOCK", 16), ("PAIRS", 50), ("SLAB", 5)):
        monkeypatch.setattr(bm25, name, value)
    n, bags = len(texts), [t.split() for t in texts]
    df = {w: sum(w in b for b in bags) for w in {w for b in bags for w in b}}
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(map(len, bags)) / n
    score = lambda q, d: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q)
    want = []
    for q in range(n):
        best = sorted((-round(s, 6), d) for d in range(n) if d != q and (s := score(bags[q], bags[d])) > 0)[:3]
        want += [(q, d, round(-s, 6)) for s, d in best]
    out = bm25.bm25_scores(spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("seq", F.col("id")), 3)
    got = {(r.query, r.id): r.score for r in out.collect()}
    assert got == pytest.approx({(q, d): s for q, d, s in want}, abs=2e-6) and grid.sides(150) == 8


def test_cells_hold_no_more_of_a_larger_table():
    for n in (10, 5_000, 262_144, 10_000_000):
        side = grid.sides(n, 70 * n)
        assert -(-n // side) <= max(grid.CELL, grid.WORTH) and 70 * n / side <= max(grid.CELL_PARTS, 70 * grid.WORTH)


def test_best_breaks_ties_by_seq_wherever_a_text_stands():
    best = grid.Best(np.array([7]), np.array([9]), 2)
    same = lambda i, j, s: np.full(len(i), 0.5)
    best.offer(np.array([[0.5, 0.5 + 1e-12]]), np.array([30, 31]), np.array([5, 6]), 0.3, same, 1e-9)
    best.offer(np.array([[0.5 - 1e-12, 0.2]]), np.array([10, 11]), np.array([1, 2]), 0.3, same, 1e-9)
    assert sorted(zip(best.id[0], best.seq[0])) == [(10, 1), (30, 5)]


@pytest.fixture(scope="module")
def near(spark):
    x = np.random.default_rng(5).normal(size=(40, 8))
    rows = [(i, i, x[i % 40].tolist()) for i in range(300)]  # copies: many ties
    want = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "id long, seq long, vec array<double>"), np.round(want @ want.T, 9)


def few_cells(monkeypatch):
    for name, value in (("CELL", 64), ("WORTH", 32)):
        monkeypatch.setattr(grid, name, value)
    monkeypatch.setattr(similarity, "PACK", 16)


def test_top_pairs_over_many_cells(spark, near, monkeypatch):
    few_cells(monkeypatch)
    df, cos = near
    want = [(a, b) for b in range(300) for _, a in sorted((-cos[a % 40, b % 40], a) for a in range(b - 5) if cos[a % 40, b % 40] >= 0.2)[:4]]
    out = similarity.semantic_topk_pairs(df, 0.2, top=4)
    assert sorted((r.src, r.dst) for r in out.collect()) == sorted(want)


def test_passages_send_nothing_to_the_driver(spark, near, monkeypatch):
    few_cells(monkeypatch)
    df, cos = near
    out = similarity.passage_topk(df.filter("id % 7 = 0"), df, 3, 0.2)
    want = [(b, a, k + 1) for b in range(0, 300, 7) for k, (_, a) in enumerate(sorted((-cos[a % 40, b % 40], a) for a in range(300) if a != b and cos[a % 40, b % 40] >= 0.2)[:3])]
    assert sorted((r.query, r.passage, r["rank"]) for r in out.collect()) == sorted(want)
    assert not any(x in out._jdf.queryExecution().toString() for x in ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastExchange"))


def test_a_main_actor_is_many_tasks(spark):
    rows = [(i, i, [["a"], ["a", "b"], ["b"], ["c", "a", "b"]][i % 4], ["c"] if i % 5 == 0 else []) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, seq long, actors array<string>, patients array<string>")
    out = candidates.peak_pairs(df, gap=3, size=8)
    names = [set(a) | set(p) for _, _, a, p in rows]
    assert tuples(out) == sorted(((a, b) for a in range(200) for b in range(a + 1, 200) if b - a < 3 or names[a] & names[b]), key=repr)
    assert max(out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 0.2 * out.count()


def test_caps_need_no_shuffle_of_all_pairs(spark):
    ev = spark.createDataFrame([(i, i) for i in range(60)], "id long, seq long")
    of = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    pools = {"temporal": of([(i, i + 1) for i in range(50)]), "peak": of([(i, i + 1) for i in range(0, 50, 9)] + [(3, 40), (99, 1)]), "entity": of([(i, i + 2) for i in range(40)] + [(9, 10)])}
    want = candidates.tier_cap(candidates.with_gap(candidates.pooled(pools), ev), list(pools), 20)
    got = candidates.capped(pools, ev, 20, candidates.tier_cap)
    assert tuples(got.select("src", "dst", "pools", "gap", "tier")) == tuples(want.select("src", "dst", "pools", "gap", "tier"))
    assert {(r.src, r.dst): r.pools for r in got.collect()}[(9, 10)] == 7


def test_splitting_holds_few_texts_as_strings(spark):
    seen, values = [], pa.array(["a b"] * 300 + [None])
    out = text.each_slice(values, lambda x: seen.append(x) or x.split())
    assert out.to_pylist() == [["a", "b"]] * 300 + [None] and len(seen) == 300
    assert text.each_slice(values[:0], str.split).type == pa.list_(pa.string())
    rows = spark.createDataFrame([(i, None if i == 7 else f"One {i}. " * (i % 5)) for i in range(300)], "id long, text string")
    got = {r.id: r.c for r in rows.select("id", text.chunks("text", 20, 0).alias("c")).collect()}
    assert got[7] is None and got[5] == [] and got[104] == ["One 104. One 104. "] * 2


def test_known_rows_make_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 10)
    df = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(100)], "at long, key string")
    out = ordering.ranked(df, ["key"], ["at"], F.floor(F.col("at") / 3), "r", 100)
    assert out.rdd.getNumPartitions() == 10 and tuples(out.select("at", "r")) == sorted(((i, i // 2) for i in range(100)), key=repr)
    rows = spark.createDataFrame([(i // 3, f"n{i % 4}") for i in range(90)], "event_id long, entity_name string").withColumn("entity_type", F.lit("actor"))
    few = coreference.cooccurrences(rows, 3, 90)
    assert few.rdd.getNumPartitions() == 18 and tuples(few) == tuples(coreference.cooccurrences(rows, 3))
