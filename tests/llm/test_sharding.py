import hashlib
import zlib
from collections import defaultdict

import pytest

from storyloom.llm import sharding

from .fixtures import awkward_texts, documents


def key(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def smallest_capacity(sizes, shards):
    """Exact by dynamic programming over the ordered sizes."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = total[:]
    for _ in range(shards - 1):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(total))]
    return best[-1] if sizes else 0


@pytest.mark.parametrize("case", ["awkward", "hot", "few", "many"])
def test_law_groups_and_slots(spark, case):
    rows = {
        "awkward": awkward_texts(),
        "hot": [(i, "hot" * 50) for i in range(200)] + [(1000 + i, f"text {i}" * (i % 9)) for i in range(150)],
        "few": [(1, "a"), (2, "b"), (2, "b")],
        "many": [(i, f"{i * 37 % 101}" * (i % 13)) for i in range(400)],
    }[case]
    out = [r.asDict() for r in sharding.shard_documents(documents(spark, rows)).collect()]
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    groups = defaultdict(int)
    for _, t in rows:
        groups[key(t)] += len((t or "").encode()) + 1
    assert max(sizes.values()) == smallest_capacity([groups[k] for k in sorted(groups)], 16)


def test_empty(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0
