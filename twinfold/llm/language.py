"""Operator 10: language identification by bit-sliced Bloom filters of character n-grams.

Slot ``i`` of the filter holds one bit for each language, so the AND of an n-gram's slots is the set of all languages
that contain it. The bits are counted for each language over all n-grams of a text and corrected for the filter's
false positives."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WIDE_STEP_CHARS, documents, id_and_text, slices, written
from .words import mixed

LETTERS = 4
HASHES = 4
#: Slots of the filter for each n-gram of the language that has most, rounded up to a power of two; parts in which the
#: sample of a language is drawn first.
SLOTS_PER_GRAM, SALTS = 8, 16


def held_out() -> Column:
    """The documents that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@functools.cache
def _lowered() -> np.ndarray:
    """The lower-case letter for each letter, a space for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            low = c.lower()
            table[x] = ord(low) if len(low) == 1 else x
    return table


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of LETTERS letters or single spaces, the number of them in each text, and whether it has a letter."""
    texts = [f" {x or ''} " for x in column.to_pylist()]
    code = _lowered()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (of[1:] != of[:-1])
    letter = np.bincount(of[code != 32], minlength=len(texts)) > 0
    code, of = code[keep].astype(np.uint64), of[keep]
    n = max(0, len(code) - LETTERS + 1)
    out = mixed(code[:n] + np.uint64(1))
    for k in range(1, LETTERS):
        out = mixed(out + code[k : k + n])
    inside = of[:n] == of[LETTERS - 1 :]
    return out[inside], np.bincount(of[:n][inside], minlength=len(texts)), letter


class Filter(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # (planes of 64 languages, slots)
    chance: np.ndarray  # false positives of each language


def _slots(hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The places of each n-gram in n slots, a power of two."""
    step = hashes >> np.uint64(40) | np.uint64(1)
    for k in range(HASHES):
        yield ((hashes + np.uint64(k) * step) & np.uint64(n - 1)).astype(np.int64)


def build(counted: list[tuple[str, int]]) -> Filter:
    """From (language, hash as signed number) pairs."""
    own: dict[str, list[int]] = {}
    for lang, h in counted:
        own.setdefault(lang, []).append(h)
    languages = sorted(own)
    n = 1 << max(10, SLOTS_PER_GRAM * max(map(len, own.values()), default=1) - 1).bit_length()
    slots = np.zeros((max(1, -(-len(languages) // 64)), n), np.uint64)
    for i, lang in enumerate(languages):
        for at in _slots(np.array(own[lang], np.int64).view(np.uint64), n):
            slots[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filter(languages, slots, fill**HASHES)


def train(docs: DataFrame, sample_docs: int = 500) -> Filter:
    """Learns all n-grams of the whole texts of at most sample_docs documents of each language (those of the smallest hashes of doc_id and
    text) that aren't held out; the filter has SLOTS_PER_GRAM slots for each of them. docs has doc_id, text and lang; rows with a null in
    one of them, or docs without a column lang, teach nothing."""
    if "lang" not in docs.columns:
        return build([])
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # a language may have most of the rows, so each of its parts draws first; then at most SALTS * sample_docs rows a language
    keyed = labelled.select("doc_id", "lang", F.xxhash64("text").alias("own"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own", F.lit(1)), F.lit(SALTS)))
    order = (F.xxhash64("doc_id", "own"), F.col("doc_id"), F.col("own"))
    drawn = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= sample_docs)
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= sample_docs)
    # equal rows count once here; the texts come by a join on all three, so that no other row of the doc_id does
    drawn = written(drawn.select("doc_id", "lang", "own").distinct(), "sample")
    sample = labelled.withColumn("own", F.xxhash64("text")).join(drawn, ["doc_id", "lang", "own"], "left_semi").dropDuplicates(["doc_id", "lang", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=WIDE_STEP_CHARS):
            hashes, sizes, _ = grams(part.column("text"))
            langs = np.repeat(np.array(part.column("lang").to_pylist(), object), sizes)
            for lang in set(part.column("lang").to_pylist()):
                own = np.unique(hashes[langs == lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64))], ["lang", "gram"])

    found = sample.select("text", "lang").mapInArrow(run, "lang string, gram long").distinct()
    # the n-grams of at most sample_docs documents a language
    return build([(r.lang, r.gram) for r in found.toLocalIterator()])


def identify(column: pa.Array, model: Filter) -> tuple[list[str], np.ndarray]:
    hashes, sizes, letter = grams(column)
    slots = list(_slots(hashes, model.slots.shape[1]))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    share = np.zeros((len(sizes), max(1, len(model.languages))))
    for plane, table in enumerate(model.slots):
        mask = functools.reduce(np.bitwise_and, (table[at] for at in slots))
        for i in range(64 * plane, min(len(model.languages), 64 * plane + 64)):
            bits = np.concatenate([[0], np.cumsum(((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64))])[ends]
            share[:, i] = (np.diff(bits) / np.maximum(sizes, 1) - model.chance[i]) / max(1e-9, 1 - model.chance[i])
    best = share.argmax(1)
    known = letter & bool(model.languages)
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(share.max(1), 0, 1), 0)


def identify_languages(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs: the language with the largest corrected share of the
    text's n-grams, and that share. Null texts, and texts without a letter, are ``und`` with score 0, as all are when
    nothing could be learned; ties go to the first language in alphabetical order. A null doc_id isn't held out.
    Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=WIDE_STEP_CHARS):
            langs, score = identify(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return id_and_text(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_languages(docs: DataFrame, model: Filter, least_score: float = 0.2) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: not ``und``, and at least least_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=WIDE_STEP_CHARS):
            langs, score = identify(part.column("text"), model)
            yield part.filter(pa.array((np.array(langs, object) != "und") & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_languages(docs, train(docs))
