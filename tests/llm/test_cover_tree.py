import numpy as np

from storyloom.llm import cover_tree

from .fixtures import components

SCHEMA = "vec_id long, embedding array<float>, label int, node long, c int"


def brute(rows, cosine=0.93):
    n, links = len(rows), []
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(np.float64) if ok else None
        unit.append(a)
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links.append((i, j))
    comp = components(n, links)
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((v, sum(i in x for x in links), c, v == c))
    return sorted(out, key=repr)


def sample(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(12, size=n)] + rng.normal(size=(n, 8)) * rng.choice([0.05, 0.25, 0.5], size=(n, 1))
    return [(i, x[i].astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def run(spark, rows, **settings):
    out = cover_tree.near_vectors(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), **settings)
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_brute_force(spark):
    rows = sample(1, 260) + sample(2, 30)
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [None] + [1.0] * 7, 1), (505, rows[0][1], None), (506, rows[0][1], rows[0][2]), (506, rows[0][1], rows[0][2]), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2])]
    expected = brute(rows)
    assert sum(r[1] for r in expected) > 200
    assert run(spark, rows) == expected
    assert run(spark, rows, block=16) == expected


def test_one_large_group_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(3000)] + [(5000, [-1.0, 2.0, 3.0], 0)]
    out = run(spark, rows)
    assert {r[1:3] for r in out if r[0] < 3000} == {(2999, 0)}
    assert (5000, 0, 5000, True) in out


def test_trees_find_what_a_matrix_product_finds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = cover_tree.CoverTree(x[:180]), cover_tree.CoverTree(x[180:])
    for cosine in (0.5, 0.93):
        assert set(zip(*map(list, cover_tree.threshold_pairs(a, b, cosine)))) == set(zip(*map(list, np.nonzero(a.x @ b.x.T >= cosine))))
        i, j = np.nonzero(np.triu(a.x @ a.x.T >= cosine, 1))
        assert set(zip(*map(list, cover_tree.threshold_pairs(a, a, cosine)))) == set(zip(i.tolist(), j.tolist()))


def test_empty(spark):
    assert run(spark, []) == []
