import hashlib
from collections import defaultdict

from storyloom.llm import line_dedup

from .fixtures import SPACE, awkward_texts, documents, lower


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(SPACE))].add(-1 if i is None else i)
    drop = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if drop.get(lower(x.strip(SPACE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def digest(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = awkward_texts()
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 5
    assert digest(line_dedup.line_dedup_digest(documents(spark, rows))) == sorted(expected, key=repr)


def test_keys_that_range_cuts_split(spark, monkeypatch):
    line = "a line that nearly every document of this small corpus holds"
    rows = [(i, f"{line}\nown line number {i % 7} with quite a few characters in it\n{line}") for i in range(900)]
    monkeypatch.setattr(line_dedup, "HELD_LINES", 50)
    assert digest(line_dedup.line_dedup_digest(documents(spark, rows).repartition(7))) == sorted(brute(rows), key=repr)


def test_texts_and_columns_stay(spark):
    rows = awkward_texts()
    docs = documents(spark, rows)
    out = line_dedup.with_kept_text(docs)
    assert out.drop(line_dedup.KEPT).columns == docs.columns
    got = sorted((r.doc_id, r.text, r[line_dedup.KEPT]) for r in out.filter("doc_id >= 10 and doc_id < 20").collect())
    assert len(got) == 7 and all((t == k) == (i == 16) for i, t, k in got)


def test_empty(spark):
    assert line_dedup.line_dedup_digest(documents(spark, [])).count() == 0
