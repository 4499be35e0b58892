"""Word-level BPE encoding of many texts at once, on numpy arrays: each distinct run of characters is encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Slots that the table of remembered runs begins with and ends at; half of them are used at most, then it starts anew.
SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
_LETTER, _DIGIT, _MARK, _OTHER, _WHOLE = 1, 2, 3, 4, 5
_NEVER = np.int32(2**31 - 1)


def _classes() -> tuple[bytes, bytes]:
    """Lower case of each byte, and its class: 0 white space, a letter, a digit, a mark, or one that needs the library."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    cls = np.full(256, _OTHER, np.uint8)
    cls[33:127] = _MARK
    cls[48:58] = _DIGIT
    cls[65:91] = cls[97:123] = _LETTER
    cls[39] = _OTHER  # contractions
    cls[32] = cls[9:14] = 0
    return lower.tobytes(), cls.tobytes()


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merges:
    """Applies a vocabulary's merges to many runs of ASCII characters at once, always the leftmost of the lowest rank."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        names = _byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + end] for c in names], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        size = 1 << max(4, (8 * len(key)).bit_length())
        self.size, self.keys, self.ranks = size, np.zeros(size, np.uint32), np.full(size, _NEVER, np.int32)
        rank, slot, self.probes = np.arange(len(key), dtype=np.int32), self._slot(key), 1
        while len(rank):
            free = self.ranks[slot] == _NEVER
            self.ranks[slot[free]], self.keys[slot[free]] = rank[free], key[rank[free]]
            again = self.ranks[slot] != rank
            rank, slot = rank[again], (slot[again] + 1) % size
            self.probes += bool(len(rank))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key * np.uint32(0x9E3779B1)
        return ((h ^ (h >> np.uint32(15))) % np.uint32(self.size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NEVER for those that don't merge or lie behind the end."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NEVER)
        wait = np.flatnonzero((self.ranks[slot] != _NEVER) & (self.keys[slot] != key))
        for _ in range(self.probes - 1):
            if not len(wait):
                break
            slot[wait] = (slot[wait] + 1) % self.size
            s = slot[wait]
            hit = self.keys[s] == key[wait]
            out[wait[hit]] = self.ranks[s[hit]]
            wait = wait[~hit & (self.ranks[s] != _NEVER)]
        return np.where(b >= 0, out, _NEVER)

    def apply(self, chars: np.ndarray) -> np.ndarray:
        """chars: runs of one length as columns of bytes, one row a place. Their ids, -1 behind the last."""
        width, n = chars.shape
        out = self.inner[chars]
        out[-1] = self.last[chars[-1]]
        if width == 1:
            return out
        column, ids = np.arange(n), np.concatenate([out, np.full((1, n), -1, np.int32)])
        rank = np.full((width, n), _NEVER, np.int32)
        for k in range(width - 1):
            rank[k] = self._find(out[k], out[k + 1])
        for left in range(width - 1, 0, -1):  # pairs that a run can still have
            j = rank[:left].argmin(axis=0)
            at = np.arange(len(column))
            low = rank[j, at]
            go = low != _NEVER
            if not go.all():
                out[:, column[~go]] = ids[:-1, ~go]
                column, ids, rank, j, low = column[go], ids[:, go], rank[:, go], j[go], low[go]
                at = np.arange(len(column))
                if not len(column):
                    return out
            ids[j, at] = self.made[low]
            for k in range(1, left + 1):
                np.copyto(ids[k], ids[k + 1], where=j < k)
                np.copyto(rank[k - 1], rank[k], where=j < k)
            some = np.flatnonzero(j > 0)
            i = j[some]
            rank[i - 1, some] = self._find(ids[i - 1, some], ids[i, some])
            rank[j, at] = self._find(ids[j, at], ids[j + 1, at])
        out[:, column] = ids[:-1]
        return out


class WordEncoder:
    """Ids of texts as the tokenizer in `path` gives them without special tokens.

    That tokenizer lower-cases, drops white space, and cuts the rest into runs of letters, single digits and runs of
    marks, so nothing reaches over ASCII white space. ASCII runs of up to 16 bytes are packed into two numbers and looked
    up in a table; unknown ones are merged here, all at once. Words with other bytes or an apostrophe are whole entries
    that the library encodes once each. Added tokens are matched on the text as it stands, before lower-casing: a text with
    one in any spelling is left to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        self.tokenizer = Tokenizer.from_str(raw)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        config = json.loads(raw)
        self.merges = Merges(config["model"])
        self.added = re.compile(b"|".join(re.escape(t["content"].encode()) for t in config["added_tokens"]) or b"(?!)", re.IGNORECASE)
        self.lower, self.cls = _classes()
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.rows, self.k1, self.k2 = 0, np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.first, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.filled = np.zeros(4096, np.uint16), 0
        self.long: dict[bytes, int] = {}
        self.table = np.full(SLOTS, -1, np.int32)

    def _slot(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 ^ (k2 * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC4CEB9FE1A85EC53)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        return (h >> np.uint64(32)).astype(np.int64) & (len(self.table) - 1)

    def _look_up(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where unknown."""
        slot = self._slot(k1, k2)
        found = self.table[slot].astype(np.int64)
        wait = np.flatnonzero((found >= 0) & ((self.k1[found] != k1) | (self.k2[found] != k2)))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & (len(self.table) - 1)
            f = self.table[slot[wait]].astype(np.int64)
            found[wait] = f
            wait = wait[(f >= 0) & ((self.k1[f] != k1[wait]) | (self.k2[f] != k2[wait]))]
        return found

    def _place(self, rows: np.ndarray) -> None:
        slot = self._slot(self.k1[rows], self.k2[rows])
        while len(rows):
            free = self.table[slot] < 0
            self.table[slot[free]] = rows[free]  # of several for one slot the last stays
            again = self.table[slot] != rows
            rows, slot = rows[again], (slot[again] + 1) & (len(self.table) - 1)

    def _add(self, ids: list[np.ndarray] | np.ndarray, counts: np.ndarray, k1=None, k2=None) -> np.ndarray:
        """New rows for ids, `counts` of them each."""
        n, flat = len(counts), np.concatenate([*ids, np.zeros(0, np.uint16)]) if isinstance(ids, list) else ids
        while self.rows + n > len(self.first):
            self.k1, self.k2, self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.k1, self.k2, self.first, self.count))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        rows = np.arange(self.rows, self.rows + n)
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.first[rows] = self.filled + np.cumsum(counts) - counts
        self.count[rows] = counts
        self.rows, self.filled = self.rows + n, self.filled + len(flat)
        if k1 is not None:
            self.k1[rows], self.k2[rows] = k1, k2
            while 2 * self.rows > len(self.table):
                self.table = np.full(2 * len(self.table), -1, np.int32)
                old = np.setdiff1d(np.arange(self.rows - n), np.fromiter(self.long.values(), np.int64), assume_unique=True)
                self._place(old)
            self._place(rows)
        return rows

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.uint16) for e in found]

    def _learn(self, a: np.ndarray, starts: np.ndarray, lengths: np.ndarray, whole: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
        """Encode runs that are in no row yet, each once."""
        order = np.lexsort((k1, k2))
        first = np.ones(len(order), bool)
        first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        order = order[first]
        for width in np.unique(lengths[order[~whole[order]]]).tolist():
            some = order[~whole[order] & (lengths[order] == width)]
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                ids = self.merges.apply(a[starts[part] + np.arange(width)[:, None]]).T
                self._add(ids[ids >= 0].astype(np.uint16), (ids >= 0).sum(axis=1), k1[part], k2[part])
        some = order[whole[order]]
        if len(some):
            ids = self._library([a[s : s + n].tobytes() for s, n in zip(starts[some].tolist(), lengths[some].tolist())])
            self._add(ids, np.array([len(i) for i in ids]), k1[some], k2[some])

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as unsigned 16-bit numbers, `end` behind each if given, and where each text's ids begin (one more: the end)."""
        if self.rows > MOST_SLOTS // 2 or self.filled > 8 * MOST_SLOTS:
            self._forget()
        apart = {i: t for i, t in enumerate(texts) if b"<|" in t and self.added.search(t)}
        buf = b"\n".join(b"" if i in apart else t for i, t in enumerate(texts)) + b"\n" * 17
        lowered = buf.translate(self.lower)
        a = np.frombuffer(lowered, np.uint8)
        cls = np.frombuffer(bytearray(buf.translate(self.cls)), np.uint8)
        self._join_words(cls)
        cut = np.append(True, (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT))  # where a run or a space begins
        edge = np.flatnonzero(cut)
        kind = cls[edge]
        run = np.flatnonzero(kind)  # the text ends in white space, so each run has an edge behind it
        starts, ends = edge[run], edge[run + 1]
        lengths = ends - starts
        eight = np.ndarray(len(a) - 8, "<u8", lowered, strides=(1,))
        k1 = eight[starts] & self.mask[np.minimum(lengths, 8)]
        k2 = np.where(lengths > 8, eight[np.minimum(starts + 8, len(a) - 9)] & self.mask[np.clip(lengths - 8, 0, 8)], np.uint64(0))
        row, whole = np.zeros(len(starts), np.int64), kind[run] == _WHOLE
        apart_runs = lengths > 16
        if b"\0" in buf:  # zero bytes pad the keys
            apart_runs |= np.add.reduceat(a == 0, starts) > 0 if len(starts) else False
        short = np.flatnonzero(~apart_runs)
        row[short] = self._look_up(k1[short], k2[short])
        new = short[row[short] < 0]
        if len(new):
            self._learn(a, starts[new], lengths[new], whole[new], k1[new], k2[new])
            row[new] = self._look_up(k1[new], k2[new])
        for i in np.flatnonzero(apart_runs).tolist():
            word = a[starts[i] : ends[i]].tobytes()
            if word not in self.long:
                ids = self._library([word])
                self.long[word] = int(self._add(ids, np.array([len(ids[0])]))[0])
            row[i] = self.long[word]
        sizes = np.array([len(t) + 1 if i not in apart else 1 for i, t in enumerate(texts)], np.int64)
        text_at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        counts = self.count[row].astype(np.int64)
        ids = self.pool[np.repeat(self.first[row] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        at = np.concatenate([[0], np.cumsum(counts)])[text_at]
        if apart or end is not None:
            tail = np.zeros(0 if end is None else 1, np.uint16) + np.uint16(end or 0)
            if not apart:
                ids, at = np.insert(ids, at[1:], tail[0]), at + np.arange(len(at))
            else:
                parts = [np.concatenate([self._library([apart[i]])[0] if i in apart else ids[at[i] : at[i + 1]], tail]) for i in range(len(texts))]
                ids, at = np.concatenate([*parts, np.zeros(0, np.uint16)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, at

    def _join_words(self, cls: np.ndarray) -> None:
        """Words with a byte that needs the library become one run each."""
        other = np.flatnonzero(cls == _OTHER)
        if not len(other):
            return
        space = np.flatnonzero(cls == 0)
        k = np.searchsorted(space, other)  # the text ends in white space
        k = k[np.append(True, k[1:] != k[:-1])]
        starts, ends = np.where(k > 0, space[k - 1] + 1, 0), space[k]
        n = ends - starts
        cls[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = _WHOLE
