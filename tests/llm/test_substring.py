import hashlib
import random
from collections import Counter

from storyloom.llm import substring

from .fixtures import awkward_texts, documents, prose, words


def brute(rows, window=35):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        last = -1
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                for j in range(max(i, last), i + window):
                    gone[j] = True
                last = i + window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    return sorted(map(tuple, substring.substring_dedup_digest(documents(spark, rows), **settings).collect()), key=repr)


def test_against_brute_force(spark):
    rows = awkward_texts()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=8) == brute(rows, 8)


def test_repeats_inside_a_block_and_across_blocks(spark, monkeypatch):
    rng = random.Random(4)
    passage = prose(rng, 80)
    rows = [(i, f"{prose(rng, i % 30)} {passage if i % 3 else passage[: len(passage) // 2]} {prose(rng, 10)}") for i in range(120)]
    expected = brute(rows)
    assert run(spark, rows) == expected
    for block in (1, 500, 3000):
        monkeypatch.setattr(substring, "BLOCK", block)
        assert run(spark, rows) == expected


def test_texts_and_white_space_stay(spark):
    rng = random.Random(6)
    passage = prose(rng, 50)
    rows = [(1, f"a\tb\n\n{passage} c  d"), (2, f"{passage}\ne"), (3, None), (4, " x \n")]
    docs = documents(spark, rows)
    out = substring.with_kept_text(docs)
    assert out.drop(substring.KEPT).columns == docs.columns
    got = {r.doc_id: r[substring.KEPT] for r in out.collect()}
    assert words(got[1]) == ["a", "b", "c", "d"] and got[1].startswith("a\tb") and got[1].endswith(" c  d")
    assert words(got[2]) == ["e"] and got[3] is None and got[4] == " x \n"


def test_empty(spark):
    assert run(spark, []) == []


def test_texts_are_shuffled_once(spark):
    rng = random.Random(9)
    passage = prose(rng, 40)
    rows = [(i, " ".join([f"{rng.getrandbits(64):x}" for _ in range(1500)] + [passage])) for i in range(80)]
    jsc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def written():
        jsc.listenerBus().waitUntilEmpty()
        stages = jsc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = run(spark, rows)
    assert got == brute(rows)
    # the texts hold half a byte of information for each character, so no codec makes a shuffle of them shorter than that
    assert 0.4 < (written() - before) / sum(len(x) for _, x in rows) < 1.6
