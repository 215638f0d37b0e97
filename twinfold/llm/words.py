"""Words and word windows of whole batches of texts, as numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9FB21C651E98DF25)


class Words(NamedTuple):
    """Word ``i`` of all texts is ``names[of[i]]`` with the 64-bit hash ``hashes[i]``; text ``k`` has the words
    ``bounds[k]`` to ``bounds[k + 1]``."""

    names: list[str]
    of: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of characters other than space and U+0009 to U+000D; lower: the hashes
    are of the words with A-Z as a-z. Null: no words."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in names:  # before leading and after trailing white space
        real = of != names.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        of = of[real]
    spelled = (x.encode().lower() if lower else x.encode() for x in names)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(names))
    return Words(names, of, hashes[of], bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of each run of ``size`` words, by the place of its first word, over the borders of texts too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n])
    for k in range(1, size):
        out = mixed(out + hashes[k : k + n])
    return out


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``size`` lower-cased words; of all its
    words if it has fewer; none without words."""
    found = split_words(column, lower=True)
    runs, out = windows(found.hashes, size), []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(windows(found.hashes[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
