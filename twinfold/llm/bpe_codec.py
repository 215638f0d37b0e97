"""Operator 2: byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .pieces import Pieces
from .shared import documents, id_and_text, slices


#: The pattern of which it is known where texts may be cut into pieces; any other gets whole texts.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec(NamedTuple):
    """pieces: the ids of texts. decimals, tokens: for each id its decimal number and a space, and the bytes it stands for."""

    pieces: Pieces
    decimals: pa.Array
    tokens: pa.Array


@functools.lru_cache(2)
def codec(data: bytes, pattern: str) -> Codec:
    import regex

    vocabulary, find = bpe.from_ranks(data), regex.compile(pattern).findall

    def encode(pieces: list[str]) -> pa.Array:
        cut = [find(x) for x in pieces]
        words = list({w for x in cut for w in x})
        ids = dict(zip(words, [array("i", x).tobytes() for x in vocabulary.encode([w.encode() for w in words])], strict=True))
        return pa.array([ids[x[0]] if len(x) == 1 else b"".join([ids[w] for w in x]) for x in cut], pa.large_binary())

    top = max(vocabulary.tokens, default=-1) + 1
    return Codec(Pieces(encode, pattern == KNOWN), pa.array([f"{i} ".encode() for i in range(top)], pa.large_binary()), pa.array([vocabulary.tokens.get(i, b"") for i in range(top)], pa.large_binary()))


def _texts(of_id: pa.Array, ids: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """For each text the bytes of its ids, one after the other."""
    whole = of_id.take(ids)
    at, data = np.frombuffer(whole.buffers()[1], np.int64)[ends].tolist(), memoryview(whole.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (binary): ids by lowest rank first, leftmost among equals,
    within each match of the pattern; decoded holds the bytes of those ids. Null and empty texts have no ids.
    Rows repeat as often as in docs, so an empty table gives none; other columns are left out."""
    data = Path(ranks_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, pattern)
        for part in slices(batches):
            ids, ends = own.pieces(part.column("text")).joined(np.dtype("<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            decoded = pa.array([bytes(x) for x in _texts(own.tokens, pa.array(ids), ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), lists, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As encode_texts, with SHA-256 digests in place of the ids (decimal, joined by one space) and the bytes."""
    data = Path(ranks_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, pattern)
        for part in slices(batches):
            ids, ends = own.pieces(part.column("text")).joined(np.dtype("<i4"))
            numbers = pa.array(ids)
            decimals = pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in _texts(own.decimals, numbers, ends)], pa.string())
            decoded = pa.array([hashlib.sha256(x).hexdigest() for x in _texts(own.tokens, numbers, ends)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), decimals, decoded], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return encode_digests(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
