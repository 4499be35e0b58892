import random

import pytest

import corpus_pipeline
from storyloom.llm import packing, quality_rules

from . import test_line_dedup, test_minhash, test_substring
from .fixtures import documents, prose, words
from .test_tokens import pieces_hold


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    line = "A shared footer line that stands in very many documents"
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, rng.randrange(60, 160))}\n{line if i % 4 == 0 else prose(rng, 8)}\n{passage if i % 11 == 0 else prose(rng, 9)}") for i in range(240)]
    rows += [(300 + i, rows[i][1].replace("w1 ", "changed ")) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "short one"), (403, "same words here " * 60)]
    return rows


def test_stages_against_brute_force(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "minhash_near_dedup", "substring_dedup", "packing"]
    docs = documents(spark, corpus)
    columns = docs.columns
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    verdict = {r.doc_id: r.kept for r in quality_rules.judge_documents(docs).collect()}
    docs = stages["quality_rules"](spark, docs, "").cache()
    now = sorted(((i, t) for i, t in corpus if verdict[i]), key=repr)
    assert pairs(docs) == now and docs.columns == columns and 200 < len(now) < len(corpus)

    digest = {r[0]: r[3] for r in test_line_dedup.brute(now)}
    docs = stages["line_dedup"](spark, docs, "").cache()
    after = pairs(docs)
    assert {i: test_line_dedup.hashlib.sha256((t or "").encode()).hexdigest() for i, t in after} == digest
    assert after != now and docs.columns == columns and all(r.n_chars == len(r.text) for r in docs.collect())

    kept = {r[0] for r in test_minhash.brute(after, 5) if r[3]}
    docs = stages["minhash_near_dedup"](spark, docs, "").cache()
    now = pairs(docs)
    assert now == [r for r in after if r[0] in kept] and len(now) < len(after)

    want = {r[0]: r[3] for r in test_substring.brute(now)}
    docs = stages["substring_dedup"](spark, docs, "").cache()
    after = pairs(docs)
    assert {i: test_substring.hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for i, t in after} == want and after != now

    assert pieces_hold(after, stages["packing"](spark, docs, "").collect()) < 0.05


def test_run(spark, corpus, tmp_path):
    documents(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == packing.pack_documents(documents(spark, [])).columns and 200 < out.select("doc_id").distinct().count() < len(corpus) - 10


def test_run_over_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
