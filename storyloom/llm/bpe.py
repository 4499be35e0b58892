"""Byte-level BPE: a segment tree over byte positions holds the leftmost pair of least rank; merges update it in log time."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, id_or_null, text_or_empty
from .textvec import slices

_NONE = np.uint32(0xFFFFFFFF)
#: Pieces up to this many bytes are encoded many at a time, one tree each; longer ones alone.
TOGETHER = 64
#: Encoded pieces that a worker remembers; beyond it starts anew.
REMEMBERED = 400_000


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space read as Unicode's White_Space property."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Ranks:
    """Merge ranks as arrays: tokens' bytes, and for each pair of tokens that forms a token its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        if len(self.tokens) >= 1 << 16:
            raise ValueError("ranks need 17 bits or more")
        pairs = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = i
        self.pairs = pairs
        keys, values = np.array(list(pairs), np.uint32), np.array(list(pairs.values()), np.uint32)
        self.shift = np.uint32(32 - max(4, (4 * len(keys)).bit_length()))
        slots = 1 << (32 - int(self.shift))
        self.slot_key, self.slot_value = np.full(slots + 64, _NONE), np.full(slots + 64, _NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing: of those that want a free slot the first gets it
            free = self.slot_key[at[todo]] == _NONE
            got = todo[free][np.unique(at[todo[free]], return_index=True)[1]]
            self.slot_key[at[got]], self.slot_value[at[got]] = keys[got], values[got]
            todo = np.setdiff1d(todo, got)
            at[todo] += 1
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, _NONE if the pair is no token."""
        key = a << np.uint32(16) | b
        at = self._slot(key)
        seen = self.slot_key[at]
        out = np.where(seen == key, self.slot_value[at], _NONE)
        todo = np.flatnonzero((seen != key) & (seen != _NONE))
        while len(todo):
            at[todo] += 1
            seen = self.slot_key[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.slot_value[at[todo[hit]]]
            todo = todo[~hit & (seen != _NONE)]
        return out

    def encode_alone(self, piece: bytes) -> bytes:
        """One piece of any length; ids as little-endian 32-bit numbers."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        far = (1 << 62, 0)
        token = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [far] * (2 * size)
        for i in range(n - 1):
            rank = self.pairs.get(token[i] << 16 | token[i + 1])
            if rank is not None:
                tree[size + i] = (rank, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int | None) -> None:
            k = size + i
            tree[k] = far if rank is None else (rank, i)
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low and low[1] != i:
                    break
                tree[k] = low

        while tree[1] != far:
            rank, i = tree[1]
            gone = after[i]
            token[i], token[gone] = rank, -1
            after[i] = nxt = after[gone]
            if nxt < n:
                before[nxt] = i
            put(gone, None)
            put(i, self.pairs.get(rank << 16 | token[nxt]) if nxt < n else None)
            if before[i] >= 0:
                put(before[i], self.pairs.get(token[before[i]] << 16 | rank))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of TOGETHER bytes at most: a tree for each, and one merge in each at a time."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size = 1 << max(1, int(lengths.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        token = self.byte[raw]
        places = np.arange(size)
        alive = places < lengths[:, None]
        tree = np.full((n, 2 * size), _NONE)
        first = self.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size - 1)
        paired = (places[1:] < lengths[:, None]) & (first != _NONE)
        tree[:, size : 2 * size - 1] = np.where(paired, first << np.uint32(16) | places[:-1].astype(np.uint32), _NONE)
        s = size
        while s > 1:
            tree[:, s // 2 : s] = np.minimum(tree[:, s : 2 * s : 2], tree[:, s + 1 : 2 * s : 2])
            s //= 2
        after = np.broadcast_to(places + 1, (n, size)).astype(np.int16)
        before = np.broadcast_to(places - 1, (n, size)).astype(np.int16)
        r = np.flatnonzero(tree[:, 1] != _NONE)

        def put(rows, at, value):
            k = size + at
            tree[rows, k] = value
            while size > 1 and len(rows):
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                if k[0] == 1:
                    break

        while len(r):
            top = tree[r, 1]
            rank, i = top >> np.uint32(16), (top & np.uint32(0xFFFF)).astype(np.int64)
            gone = after[r, i].astype(np.int64)
            token[r, i] = rank
            alive[r, gone] = False
            nxt = after[r, gone].astype(np.int64)
            after[r, i] = nxt
            inside = nxt < lengths[r]
            before[r[inside], nxt[inside]] = i[inside]
            put(r, gone, _NONE)
            pair = self.rank(rank, token[r, np.minimum(nxt, size - 1)])
            put(r, i, np.where(inside & (pair != _NONE), pair << np.uint32(16) | i.astype(np.uint32), _NONE))
            left = before[r, i].astype(np.int64)
            has = left >= 0
            rows, at = r[has], left[has]
            pair = self.rank(token[rows, at], rank[has])
            put(rows, at, np.where(pair != _NONE, pair << np.uint32(16) | at.astype(np.uint32), _NONE))
            r = r[tree[r, 1] != _NONE]
        counts = alive.sum(axis=1) * 4
        ids, ends = token[alive].astype("<u4").tobytes(), np.cumsum(counts).tolist()
        return [ids[e - c : e] for e, c in zip(ends, counts.tolist())]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        groups: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ids.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > TOGETHER:
                out[p] = self.encode_alone(p)
            else:
                groups.setdefault(max(1, (len(p) - 1).bit_length()), []).append(p)
        for group in groups.values():
            for a in range(0, len(group), 8192):
                part = group[a : a + 8192]
                out.update(zip(part, self.encode_together(part)))
        return [out[p] for p in pieces]


class Codec:
    """Texts to ids and back, by a rank file and the pattern whose matches are merged apart."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = Ranks(path), split_pattern(pattern).findall
        self.odd = regex.compile(r" (?:\p{White_Space}|\Z)").search
        self.spaced: dict[str, bytes] = {}  # by what follows a space

    def _learn(self, chunks: set[str], known: dict[str, bytes], before: str) -> None:
        new = list(chunks - known.keys())
        pieces = [self.find(before + c) for c in new]
        own = list({p for ps in pieces for p in ps})
        ids = dict(zip(own, self.ranks.encode_pieces([p.encode() for p in own])))
        known.update((c, b"".join([ids[p] for p in ps])) for c, ps in zip(new, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        Where every space stands before a character that is no white space, matches never run over a space: then each
        run up to the next space is split and merged once and remembered. Other texts are split as a whole.
        """
        if len(self.spaced) > REMEMBERED:
            self.spaced = {}
        plain = [self.odd(x) is None for x in texts]
        runs = [x.split(" ") if ok else [x] for x, ok in zip(texts, plain)]
        self._learn({r[0] for r in runs}, first := {}, "")
        self._learn({c for r in runs for c in r[1:]}, self.spaced, " ")
        return [first[r[0]] + b"".join(map(self.spaced.__getitem__, r[1:])) for r in runs]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each file and pattern in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _digest(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = b.column("x").to_pylist()
            n, ids_sha, back_sha = [], [], []
            for i, j in slices(texts):
                for ids in c.encode(texts[i:j]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    back_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)], names=["d", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to).

    Null texts count as empty: no tokens, and the digest of nothing. Special tokens' names are ordinary text.
    """
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x"))
    out = base.mapInArrow(_digest(path, pattern), "d long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(id_or_null("d").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = b.column("x").to_pylist()
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for i, j in slices(texts) for x in c.encode(texts[i:j])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["d", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its token ids."""
    base = docs.select(doc_key().alias("d"), text_or_empty().alias("x"))
    return base.mapInArrow(_encode(path, pattern), "d long, ids array<int>").select(id_or_null("d").alias("doc_id"), "ids")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(texts, pa.string())], names=["d", "text"])

    return run


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    base = rows.select(doc_key().alias("d"), F.col("ids").cast("array<int>").alias("ids"))
    return base.mapInArrow(_decode(path, pattern), "d long, text string").select(id_or_null("d").alias("doc_id"), "text")
