import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyloom.llm import bpe, packing, wordbpe
from storyloom.llm.common import load

from .fixtures import awkward_texts, documents, prose

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.Ranks(RANKS).ids
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digest_against_the_library(spark, sf, library):
    rows = [r for r in awkward_texts() if r[0] != 72] + [(200, "a  b   c \n\n d  "), (201, " "), (202, "<|endoftext|> x"), (203, "日本語 ありがとう 🙂👩‍👩‍👧"), (204, "x\u0085y\u2028z\u00a0 \u3000w"), (205, "x" * 3000)]
    rows += [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    got = bpe.bpe_digest(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, rows)
    assert bpe.bpe_digest(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab eE\n\t '’sSt123.,É"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = c.encode([text])[0]
    assert c.decode(ids) == text.encode()
    library = test_any_text.__dict__.setdefault("library", tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks.ids, special_tokens={}))
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_both_merge_loops_agree():
    ranks, rng = bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, random.Random(1)
    pieces = ["".join(rng.choice("theringandouABé ") for _ in range(rng.randrange(2, 60))).encode()[:64] for _ in range(200)]
    assert ranks.encode_together([p for p in pieces]) == [ranks.encode_alone(p) for p in pieces]


def test_round_trip(spark):
    rows = awkward_texts()
    docs = documents(spark, rows)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in rows)


def pieces_hold(rows, out, window=2048):
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in rows)
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        fits = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits, r
        covered[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for d, parts in covered.items():
        assert sum(p[1] for p in parts) == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            at = 0
            for start, length, _ in sorted(parts):
                assert start == at
                at += length
    assert len(want) == len(rows)
    totals = [sum(x[1] for x in s) for s in sequences.values()]
    padded = [0 if t & (t - 1) == 0 else window - t for t in totals]
    return sum(padded) / max(1, sum(totals))


def test_packing_is_whole(spark, sf):
    rows = awkward_texts() + [(r.doc_id + 1000, r.text) for r in load(spark, sf, "documents").collect()]
    out = packing.pack_documents(documents(spark, rows)).collect()
    assert pieces_hold(rows, out) < 0.01
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_neighbours_share_windows():
    rng = random.Random(2)
    topics = [[f"{t}" for t in range(100 * k, 100 * k + 60)] for k in range(4)]
    docs = [np.array([int(rng.choice(topics[i % 4])) for _ in range(200)] + [1], "<u2") for i in range(80)]
    rows = list(packing.pack_block([len(x) for x in docs], docs))
    by = defaultdict(list)
    for doc, _, length, sequence, _ in rows:
        by[sequence].append((doc % 4, length))
    pure = sum(max(sum(n for t, n in s if t == k) for k in range(4)) for s in by.values()) / sum(map(len, docs))
    assert pure > 0.75


def test_several_blocks_and_shards(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 400))) for i in range(300)]
    monkeypatch.setattr(packing, "SHARD_ROWS", 60)
    out = packing.pack_documents(documents(spark, rows)).collect()
    pieces_hold(rows, out)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def bm25_scores(pieces, seed):
    """Scores by the definition, term by term."""
    n, mean = len(pieces), sum(map(len, pieces)) / len(pieces)
    counts = [Counter(p.tolist()) for p in pieces]
    df = Counter(t for c in counts for t in c)
    out = []
    for p, c in zip(pieces, counts):
        shared = [t for t in counts[seed] if t in c]
        out.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(p) / mean)) for t in shared))
    return out


def test_every_term_of_a_seed_counts():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(2, 300, 150).astype("<u2") for _ in range(40)]
    index = packing.Bm25(pieces)
    for seed in range(5):
        assert len(set(pieces[seed].tolist())) > 32
        assert index.scores(np.array([seed]))[0] == pytest.approx(bm25_scores(pieces, seed), rel=1e-5)


def test_windows_take_the_nearest_unused():
    """Every piece behind a seed is, by plain BM25, the nearest of all that are unused and no seed of a later window."""
    rng = np.random.default_rng(6)
    pieces = [rng.integers(2, 400, rng.integers(50, 300)).astype("<u2") for _ in range(90)]
    window = 512
    total = sum(map(len, pieces))
    seeds = [k * 90 // (total // window) for k in range(total // window)]
    left, by = [len(p) for p in pieces], defaultdict(list)
    for doc, start, length, sequence, offset in packing.pack_block(left, pieces, window):
        by[sequence].append((doc, start, length, offset))
    for k, (sequence, parts) in enumerate(sorted(by.items())):
        score = bm25_scores(pieces, parts[0][0])
        for i, (doc, start, length, _) in enumerate(parts):
            if i and k < len(seeds):
                free = [j for j in range(90) if left[j] and j not in seeds[k + 1 :] and j not in [p[0] for p in parts[:i]]]
                assert not free or score[doc] == pytest.approx(max(score[j] for j in free), rel=1e-5)
            assert start == len(pieces[doc]) - left[doc]
            left[doc] -= length
        assert sum(p[2] for p in parts) == window or k >= len(seeds)
    assert not any(left)


def test_lexical_neighbours_meet(spark, monkeypatch):
    rng = random.Random(4)
    topics = [[f"{a}{b}" for b in "bcdfghklmn"] for a in ("ma", "te", "ri", "so", "lu", "pa", "ne", "di", "ko", "vu")]
    rows = [(i, " ".join(rng.choice(topics[i % 10]) for _ in range(rng.randrange(200, 500)))) for i in range(400)]
    monkeypatch.setattr(packing, "SHARD_ROWS", 200)
    out = packing.pack_documents(documents(spark, rows)).collect()
    assert pieces_hold(rows, out) < 0.01
    by = defaultdict(lambda: [0] * 10)
    for r in out:
        by[r.sequence_id][r.doc_id % 10] += r.length
    assert sum(map(max, by.values())) / sum(map(sum, by.values())) > 0.7


def test_statistics_cover_all_documents(spark):
    rng = np.random.default_rng(8)
    docs = [rng.integers(2, 50, n).astype("<u2") for n in (10, 2048, 2100, 5, 300)]
    idf, mean, tokens = packing.corpus_statistics(spark.createDataFrame([(x.tobytes(),) for x in docs], "ids binary"))
    rests = [x[len(x) // 2048 * 2048 :] for x in docs]
    assert tokens == sum(map(len, docs)) and mean == pytest.approx(sum(map(len, rests)) / 5)
    for t in range(60):
        df = sum(t in r for r in rests)
        assert idf[t] == pytest.approx(np.log1p((5 - df + 0.5) / (df + 0.5)))


def test_word_encoder_gives_the_library_s_ids():
    """Awkward characters, added tokens in any spelling, long runs, and a table that has to grow and to start anew."""
    encoder, tokenizer, rng = wordbpe.WordEncoder(WORDS), Tokenizer.from_file(WORDS), random.Random(9)
    signs = "aAbBzZ09.,;|<>'\"-_!?\n\t \x00\x1c\x7f\u0301é ΣσİſK中€\U0001f600"
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "it's", "DON'T", "'ll", "'rex", "supercalifragilisticexpialidocious", "x" * 300, "...", "|" * 30, "é" * 40, "Ωσς ΑΣ", "12345"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(1000)]
    texts += ["a <|ENDOFTEXT|> b", "<|StartOfText|>hi", "x <|EndOfText|>.", "", "\0", "a", "a\0"]
    texts += ["".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 17))) for _ in range(40_000)]
    for _ in range(2):
        for a in range(0, len(texts), 9000):
            part = texts[a : a + 9000]
            ids, at = encoder.encode([t.encode() for t in part], 1)
            for i, t in enumerate(part):
                assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1], t
        encoder._forget()
    assert encoder.encode([b"a <|ENDOFTEXT|> b"])[0].tolist() == [320, 27, 347, 40786, 4160, 91, 285, 321]
    assert [len(x) for x in encoder.encode([])] == [0, 1]
