"""Operator 4: token counts with a whole-token shortcut."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .library_ids import direct
from .pieces import Pieces
from .shared import documents, id_and_text, slices


@functools.lru_cache(2)
def counter(data: bytes) -> Pieces:
    """The number of tokens of each piece: 1 for each pre-token that is proven to encode alone as one token;
    the others are merged. A piece that holds a special string goes to the library. Raises for files that aren't
    byte-level BPE with the usual pattern."""
    from tokenizers import Tokenizer

    if direct(json.loads(data)) != "bytes":
        raise ValueError("not a byte-level BPE file whose texts may be cut into pieces")
    library = Tokenizer.from_buffer(data)
    vocabulary, proven, special = bpe.from_json(data)
    split = library.pre_tokenizer.pre_tokenize_str
    letters = bpe.byte_letters()

    def count(pieces: list[str]) -> pa.Array:
        cut = [None if any(s in x for s in special) else [w for w, _ in split(x)] for x in pieces]
        rest = list({w for x in cut if x for w in x if w not in proven})
        merged = dict(zip(rest, map(len, vocabulary.encode([bytes([letters[c] for c in w]) for w in rest])), strict=True))
        return pa.array([len(library.encode(p, add_special_tokens=False).ids) if x is None else sum([merged.get(w, 1) for w in x]) for p, x in zip(pieces, cut, strict=True)], pa.int64())

    return Pieces(count)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each row of docs, for a byte-level BPE tokenizer file.
    Null and empty texts count 0. Rows repeat as often as in docs, so an empty table gives none; other columns are left out."""
    data = Path(tokenizer_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = pa.array(counter(data)(part.column("text")).sums())
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return count_tokens(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.json"))
