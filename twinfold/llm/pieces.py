"""Tokenising by cached pieces of text.

Both the byte-level and the word-level patterns of the vocabularies begin a new match at white space that follows another
character, at a sentence mark that follows a letter or digit, and at a character that follows a single line end; so a text may
be cut there: the tokens of the whole are the tokens of the pieces, one after the other. The cuts of all texts of a slice
are found at once on their bytes. Pieces repeat, so each Python worker keeps the results of those it has seen lately, in
Arrow arrays; only new ones reach Python code. What it keeps is bounded; the result doesn't depend on it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sentence marks at which a text is cut. No special string of a vocabulary may hold one, nor white space.
MARKS = b".,;:!?#*%&$\"()"


def _classes() -> np.ndarray:
    """For each byte, what it may begin (bits 0 to 2) and after what (bits 3 to 5) a piece begins: white space after
    what isn't; a mark after an ASCII letter or digit; what isn't white space after a single line end."""
    out = np.zeros(256, np.uint8)
    out[[32, 10]] |= 1
    out[list(MARKS)] |= 2
    out[33:127] |= 4
    out[194:245] |= 4
    out[[0xC2, 0xE1, 0xE2, 0xE3]] &= 0xFB  # these may begin other white space
    out[33:127] |= 8
    out[128:] |= 8
    out[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= 16
    out[10] |= 32
    return out


_CLASS = _classes()


def cuts(data: np.ndarray) -> np.ndarray:
    """For each byte whether a piece begins there, whatever the borders of texts."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        kind = _CLASS[data]
        np.not_equal((kind[:-1] >> 3) & kind[1:] & 7, 0, out=out[1:])
        after = np.flatnonzero(out[1:] & (data[:-1] >= 128)) + 1
        # white space beyond ASCII ends in these bytes; other characters that do so are merely not cut
        b1, b2, b3 = data[after - 1], data[np.maximum(after - 2, 0)], data[np.maximum(after - 3, 0)]
        space = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A))
        out[after[space]] = False
        # a run of white space has its own matches, so what follows a line end begins a piece only if that end stands alone
        lines = np.flatnonzero(out[1:] & (data[:-1] == 10)) + 1
        out[lines[~out[lines - 1]]] = False
    return out


def may_be_cut(special: Iterable[str]) -> bool:
    """Whether no special string holds white space or a mark."""
    marks = MARKS.decode()
    return not any(c.isspace() or c in marks for x in special for c in x)


class Found(NamedTuple):
    """Text ``k`` has the pieces ``bounds[k]`` to ``bounds[k + 1]``; piece ``i`` has the result ``results[of[i]]``."""

    results: pa.Array
    of: np.ndarray
    bounds: np.ndarray

    def joined(self, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """The results, which are bytes of numbers, as one array for all texts; text ``k`` has those from ``ends[k]`` on."""
        whole = self.results.take(pa.array(self.of))
        ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(self.of) + 1]
        data = whole.buffers()[2]
        return np.frombuffer(data[: ends[-1]] if data else b"", kind), ends[self.bounds] // kind.itemsize

    def sums(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.results.to_numpy()[self.of])])
        return np.diff(total[self.bounds])


def closed(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = np.arange(len(ends))
    out, own = np.empty(len(ids) + len(ends) - 1, ids.dtype), np.ones(len(ids) + len(ends) - 1, bool)
    last = ends[1:] + n[:-1]
    own[last] = False
    out[own], out[last] = ids, end_id
    return out, ends + n


class Pieces:
    """encode: from a list of pieces to an array of their results. cut: whether texts may be cut into pieces at all; else
    each text is one. fold: for an array of pieces, forms that have the same results."""

    def __init__(self, encode: Callable[[list[str]], pa.Array], cut: bool = True, fold: Callable[[pa.Array], pa.Array] | None = None, most_pieces: int = 500_000, most_bytes: int = 8_000_000):
        self.encode, self.cut, self.fold, self.most_pieces, self.most_bytes = encode, cut, fold, most_pieces, most_bytes
        self.names: pa.Array | None = None
        self.results: pa.Array | None = None

    def _codes(self, wanted: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The places of the wanted pieces in an array of results, which is kept for later slices."""
        if self.names is None:
            self.names, self.results = pa.array([], wanted.type), self.encode([])
        at = pc.index_in(wanted, value_set=self.names)
        absent = at.is_null()
        codes = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        new = wanted.filter(absent).dictionary_encode()
        if len(new):
            codes[absent.to_numpy(zero_copy_only=False)] = len(self.names) + new.indices.to_numpy()
            self.results = pa.concat_arrays([self.results, self.encode(new.dictionary.cast(pa.large_string()).to_pylist())])
            self.names = pa.concat_arrays([self.names, new.dictionary])
        results = self.results
        if len(self.names) > self.most_pieces or self.names.nbytes > self.most_bytes:
            lately = pa.array(np.unique(codes))
            self.names, self.results = self.names.take(lately), results.take(lately)
            if len(self.names) > self.most_pieces or self.names.nbytes > self.most_bytes:
                self.names, self.results = self.names[:0], results[:0]
        return codes, results

    def __call__(self, column: pa.Array) -> Found:
        """The pieces of each text; null texts are as empty ones."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        begins = cuts(data) if self.cut else np.zeros(len(data), bool)
        begins[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        codes, results = self._codes(self.fold(coded.dictionary) if self.fold else coded.dictionary)
        return Found(results, codes[coded.indices.to_numpy()], np.searchsorted(starts[:-1], ends))
