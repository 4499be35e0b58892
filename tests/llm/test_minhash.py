import random

from storyloom.llm import minhash

from .fixtures import awkward_texts, components, documents, lower, prose, words


def shingles(text, size):
    w = words(lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent=80):
    sets, n = [shingles(t, size) for _, t in rows], len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(n, links)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def run(spark, rows, size):
    out = minhash.near_duplicates(documents(spark, rows), shingle=size).drop("d", "t")
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_brute_force(spark):
    rows = awkward_texts()
    for size in (2, 5):
        assert run(spark, rows, size) == brute(rows, size)


def chain(seed, groups=25, steps=6):
    """Chains of near copies, also at similarities close to the threshold."""
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(groups):
        w = prose(rng, rng.choice([12, 40, 120])).split(" ")
        for _ in range(steps):
            rows.append((i := i + 1, " ".join(w)))
            w = list(w)
            for _ in range(max(1, len(w) // rng.choice([14, 20, 30]))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
    return rows


def test_chains_and_thresholds(spark):
    rows = chain(5)
    expected = brute(rows, 2)
    assert 30 < sum(not r[3] for r in expected) < len(rows) - 20
    assert run(spark, rows, 2) == expected


def test_keys_cover_all_errors():
    index = minhash.Index(16, 5, 4)
    rng = random.Random(1)
    for _ in range(300):
        wrong = set(rng.sample(range(16), 5))
        assert any(not wrong & set(k) for k in index.keys())
    wrong = [set(rng.sample(range(64), 27)) for _ in range(300)]
    assert all(any(not w & set(k) for k in minhash.DEFAULT.keys()) for w in wrong)


def test_kept_documents(spark):
    rows = awkward_texts()
    docs = documents(spark, rows)
    kept = minhash.kept_documents(docs)
    expected = {r[0] for r in brute(rows, 5) if r[3]}
    assert {r.doc_id for r in kept.collect()} == expected and kept.columns == docs.columns
    assert kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id = 4").count() == 1
    assert minhash.kept_documents(documents(spark, [])).count() == 0
    assert run(spark, [], 2) == []


def test_texts_that_meet_in_a_large_group(spark, monkeypatch):
    """A group of near copies, many of them just below the threshold: pairs of texts don't grow with its square."""
    rng = random.Random(11)
    base = prose(rng, 150, 5000).split(" ")
    rows = []
    for i in range(250):
        w = list(base)
        for k in range(rng.choice([3] + [4] * 6 + [5] * 3 + [6])):
            w[rng.randrange(len(w))] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    met, real = spark.sparkContext.accumulator(0), minhash._confirm

    def counted(size, percent):
        inner = real(size, percent)

        def each(batches):
            for b in batches:
                met.add(b.num_rows)
                yield b

        return lambda batches: inner(each(batches))

    monkeypatch.setattr(minhash, "_confirm", counted)
    expected = brute(rows, 2)
    assert run(spark, rows, 2) == expected
    assert met.value < 10 * len(rows), met.value
