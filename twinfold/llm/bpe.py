"""Byte-pair merging of many short byte strings at once, in padded numpy matrices."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

#: Widths of the matrices; a longer string takes several rows of the last width.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256)
#: Cells of a matrix at most.
CELLS = 2_000_000
_NONE = np.int64(1) << 40
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id), looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(left)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            won = one[free[one]]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = keys[todo[won]], rank[todo[won]], merged[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a very large one if the pair doesn't merge) and merged id of each pair; ids below 0 never merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        rank, merged = np.full(keys.shape, _NONE, np.int64), np.full(keys.shape, -1, np.int32)
        todo = np.nonzero(((left >= 0) & (right >= 0)).ravel())[0]
        flat, out_rank, out_merged = keys.ravel(), rank.reshape(-1), merged.reshape(-1)
        slot = self._slot(flat[todo])
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == flat[todo]
            out_rank[todo[hit]], out_merged[todo[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            go = ~hit & (at != -1)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return rank, merged


class Vocabulary:
    """tokens: bytes of each id. pairs: (left, right, rank, merged). single: bytes that are one token before any merge."""

    def __init__(self, tokens: dict[int, bytes], pairs: list[tuple[int, int, int, int]], single: dict[bytes, int] | None = None):
        self.tokens, self.single = tokens, single or {}
        ids = {b: i for i, b in tokens.items()}
        self.first = np.array([ids.get(bytes([x]), -1) for x in range(256)], np.int32)
        cols = np.array(pairs, np.int64).reshape(-1, 4).T
        self.table = PairTable(*cols)
        self.pairs = {(a, b): (r, m) for a, b, r, m in pairs}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        by: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for i, word in enumerate(words):
            if (whole := self.single.get(word)) is not None:
                out[i] = [whole]
            elif len(word) < 2:
                out[i] = [int(self.first[x]) for x in word]
            elif len(word) > WIDTHS[-1]:
                out[i] = self._wide(word)
            else:
                by[next(w for w in WIDTHS if len(word) <= w)].append(i)
        for width, rows in by.items():
            for at in range(0, len(rows), most := max(1, CELLS // width)):
                self._matrix(words, rows[at : at + most], width, out)
        return out  # type: ignore[return-value]

    def _matrix(self, words: list[bytes], rows: list[int], width: int, out: list) -> None:
        """Each round, every row merges its leftmost pair of the lowest rank and closes up; rows without one leave."""
        lengths = np.fromiter((len(words[i]) for i in rows), np.int64, len(rows))
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.first[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        rows_left = np.array(rows)
        rank, merged = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(rows_left):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            go = rank[np.arange(len(ids)), best] < _NONE if rank.shape[1] else np.zeros(len(ids), bool)
            if not go.all():
                for i, x in zip(rows_left[~go].tolist(), ids[~go].tolist(), strict=True):
                    out[i] = x[: x.index(-1)] if x[-1] == -1 else x
                rows_left, ids, rank, merged, best = rows_left[go], ids[go], rank[go], merged[go], best[go]
                if not len(rows_left):
                    break
            n = np.arange(len(ids))
            ids[n, best] = merged[n, best]
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            cols = cols[:-1]
            take = cols + (cols >= best[:, None])
            rank, merged = np.take_along_axis(rank, take, 1), np.take_along_axis(merged, take, 1)
            for at in (best - 1, best):
                ok = np.nonzero((at >= 0) & (at < rank.shape[1]))[0]
                x = at[ok]
                rank[ok, x], merged[ok, x] = self.table.find(ids[ok, x], ids[ok, x + 1])

    def _wide(self, word: bytes) -> list[int]:
        """The same for one string over many rows: each row keeps its leftmost lowest rank, so a round looks at one number a
        row, merges in the first row that has the lowest of them and closes up there."""
        width = WIDTHS[-1]
        count = -(-len(word) // width)
        ids = np.full(count * width, -1, np.int32)
        ids[: len(word)] = self.first[np.frombuffer(word, np.uint8)]
        rank, merged = np.full(count * width, _NONE, np.int64), np.full(count * width, -1, np.int32)
        rank[:-1], merged[:-1] = self.table.find(ids[:-1], ids[1:])
        ids, rank, merged = (x.reshape(count, width) for x in (ids, rank, merged))
        used = np.minimum(width, len(word) - width * np.arange(count)).tolist()
        low = rank.min(1)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))

        def look(row: int, at: int) -> None:
            """The pair of a cell and the one after it anew."""
            right = ids[row, at + 1] if at + 1 < used[row] else ids[after[row], 0] if after[row] < count else -1
            key = (int(ids[row, at]), int(right))
            rank[row, at], merged[row, at] = self.pairs.get(key, (_NONE, -1))

        while True:
            row = int(low.argmin())
            if low[row] >= _NONE:
                break
            at = int(rank[row].argmin())
            ids[row, at] = merged[row, at]
            gone, place = (row, at + 1) if at + 1 < used[row] else (after[row], 0)
            for x, empty in ((ids, -1), (rank, _NONE), (merged, -1)):
                x[gone, place:-1] = x[gone, place + 1 :]
                x[gone, -1] = empty
            used[gone] -= 1
            if not used[gone]:
                if after[gone] < count:
                    before[after[gone]] = before[gone]
                after[before[gone]] = after[gone]
            look(row, at)
            touched = {row, gone}
            if at:
                look(row, at - 1)
            elif before[row] >= 0:
                look(before[row], used[before[row]] - 1)
                touched.add(before[row])
            for x in touched:
                low[x] = rank[x].min()
        return ids[ids >= 0].tolist()


@functools.lru_cache(2)
def from_ranks(data: bytes) -> Vocabulary:
    """A file of base64 bytes and ranks: two ids merge if their bytes together have a rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    pairs = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return Vocabulary({r: t for t, r in ranks.items()}, pairs, ranks)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files: itself if
    printable in Latin-1, else the next character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


@functools.lru_cache(2)
def from_json(data: bytes) -> tuple[Vocabulary, frozenset[str], list[str]]:
    """A byte-level tokenizer file: the vocabulary; the strings (in its letters) that are proven to encode
    alone as one token, by merging each vocabulary string; the special strings."""
    d = json.loads(data)
    letters, vocab = byte_letters(), d["model"]["vocab"]
    special = [x["content"] for x in d.get("added_tokens", [])]
    spelled = {t: bytes(letters[c] for c in t) for t in vocab if t not in special}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in d["model"]["merges"]]
    own = Vocabulary({vocab[t]: b for t, b in spelled.items()}, [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)])
    names = list(spelled)
    return own, frozenset(t for t, x in zip(names, own.encode([spelled[t] for t in names]), strict=True) if x == [vocab[t]]), special
