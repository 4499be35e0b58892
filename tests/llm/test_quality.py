import random
import re
import zlib

import numpy as np
import pytest

from storyloom.llm import quality_pu, quality_rules
from storyloom.llm.common import load

from .fixtures import awkward_texts, documents, prose, words


def counts(text):
    w = words(text)
    triples, where = {}, [set() for _ in range(0)]
    for i in range(len(w) - 2):
        triples.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for at in triples.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark):
    rows = awkward_texts() + [(100, "a#b * $ %&|<>\nx\nx\n y\n y\n\n")]
    got = quality_rules.judge_documents(documents(spark, rows)).drop("kept").collect()
    expected = []
    for i, t in rows:
        c = counts(t)
        expected.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(80, 400))) for i in range(600)]
    rows += [(1000 + i, " ".join("#*$%&" * 8 for _ in range(100))) for i in range(4)]
    out = {r.doc_id: r.kept for r in quality_rules.judge_documents(documents(spark, rows)).collect()}
    assert not any(out[1000 + i] for i in range(4))
    assert np.mean([out[i] for i in range(600)]) > 0.99
    kept = quality_rules.kept_documents(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in out.items() if k)
    assert kept.columns == documents(spark, []).columns


def test_junk_of_a_rare_language_goes(spark):
    rng = random.Random(4)
    junk = " ".join("#*$%&" * 8 for _ in range(100))
    rows = [(i, prose(rng, rng.randrange(80, 400)), "en") for i in range(400)] + [(i, prose(rng, rng.randrange(80, 400)), "xx") for i in range(400, 500)]
    rows += [(500, junk, "xx"), (501, junk, "xx"), (502, junk, "en")]
    docs = spark.createDataFrame([(*r, "web") for r in rows], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge_documents(docs).collect()
    out = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and not any(out[i] for i in (500, 501, 502))
    assert np.mean([out[i] for i in range(500)]) > 0.99


def test_few_rows_reject_nothing_and_empty_tables_give_none(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 100)) for i in range(20)]
    assert all(r.kept for r in quality_rules.judge_documents(documents(spark, rows)).collect())
    assert quality_rules.judge_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text", [b"", b" \n", b"x", b"\xff" * 100, b"word " * 10_000])
def test_features_are_finite(text):
    x = quality_pu.features(text)
    assert len(x) == len(quality_pu.FEATURES) and np.isfinite(x).all()


def test_held_out_accuracy(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs, labels = load(spark, path, "documents"), load(spark, path, "labels")
    model = quality_pu.train(docs, labels)
    out = quality_pu.score_documents(docs, model).join(labels, "doc_id").filter("quality is not null")
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.85
    again = quality_pu.train(docs.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)


def test_no_labels_no_texts(spark):
    docs = documents(spark, awkward_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_pu.train(docs, none)
    out = quality_pu.score_documents(docs, model)
    assert {round(r.score, 6) for r in out.collect()} == {0.5}
    assert out.count() == docs.count()
    assert quality_pu.score_documents(documents(spark, []), model).count() == 0


def test_risk_and_its_gradient():
    """Against the definition, row by row, and finite differences where the bracket is positive."""
    rng = np.random.default_rng(1)
    p, u = rng.integers(0, 6, (20, 3)), rng.integers(0, 6, (30, 3))
    loss = lambda z: np.log(1 + np.exp(-z))
    z = lambda w, row: sum(w[i] for i in row) + w[-1]
    seen = set()
    for k in range(40):
        w, prior = rng.normal(0, 1 + k % 4, 7), 0.2 + 0.6 * (k % 2)
        bracket = np.mean([loss(-z(w, r)) for r in u]) - prior * np.mean([loss(-z(w, r)) for r in p])
        risk, step = quality_pu.risk_and_step(w, p, u, prior)
        assert risk == pytest.approx(prior * np.mean([loss(z(w, r)) for r in p]) + max(0, bracket))
        seen.add(bracket >= 0)
        each = np.eye(7) * 1e-6
        if bracket > 0.01:
            assert step == pytest.approx([(quality_pu.risk_and_step(w + e, p, u, prior)[0] - risk) / 1e-6 for e in each], abs=1e-4)
        elif bracket < -0.01:
            part = lambda w: np.mean([loss(-z(w, r)) for r in u]) - prior * np.mean([loss(-z(w, r)) for r in p])
            assert step == pytest.approx([-(part(w + e) - part(w)) / 1e-6 for e in each], abs=1e-4)
    assert seen == {True, False}


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(2)
    positive = rng.beta(6, 2, 4000)
    mixed = np.where(rng.random(8000) < prior, rng.beta(6, 2, 8000), rng.beta(1, 9, 8000))
    assert quality_pu.estimated_prior(positive, mixed) == pytest.approx(prior, abs=0.06)


def test_awkward_texts_and_repeated_rows_score(spark):
    rows = awkward_texts()
    labels = spark.createDataFrame([(i, int((i or 0) % 3 > 0), 0) for i, _ in rows] + [(4, None, None), (4, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    out = quality_pu.score_documents(docs, quality_pu.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
