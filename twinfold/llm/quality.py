"""Operator 9: quality rules by the divergence of a document's histograms from language references."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WIDE_STEP_CHARS, documents, id_and_text, slices, written
from .words import split_words, windows

# Frequent words of each language, as plain text.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were there been one all we their has would when if so no will him who more out do up",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux mais comme être cette ont nous été leur fait vous même elle sa ses deux ces dont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde",
}
#: Character classes: lower-case and upper-case ASCII letters, other letters, digits, white space, sentence marks,
#: symbols, all else.
CLASSES = 8
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"-()"


@functools.cache
def _class_of() -> np.ndarray:
    table = np.full(0x110000, 7, np.uint8)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            table[x] = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2
        elif c.isspace():
            table[x] = 4
        elif c.isdigit():
            table[x] = 3
    for marks, k in ((MARKS, 5), (SYMBOLS, 6)):
        for c in marks:
            table[ord(c)] = k
    return table


@functools.cache
def _vocabulary() -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for x in COMMON_WORDS.values() for w in x.split()}))}


def _repeat_words(runs: np.ndarray, n: int) -> int:
    if n < 6:
        return 0
    order = np.sort(runs)
    if (twice := order[1:] == order[:-1]).any():
        again = np.isin(runs, order[1:][twice])
        step = np.zeros(n + 1, np.int64)
        step[: len(runs)] += again
        step[5 : 5 + len(runs)] -= again
        return int((np.cumsum(step[:n]) > 0).sum())
    return 0


def _repeat_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    real = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(real) - len(set(real))


def features(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The base counts of each text and its two histograms."""
    texts = [x or "" for x in part.column("text").to_pylist()]
    found = split_words(part.column("text"))
    n = np.diff(found.bounds)
    runs = windows(found.hashes)
    repeat = [_repeat_words(runs[a : max(a, b - 4)], b - a) for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.repeat(np.arange(len(texts)), lengths) * CLASSES + _class_of()[code]
    chars = np.bincount(at, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    spaces = np.concatenate([[0], np.cumsum(space)])[ends]
    # the word as it is, lower-cased and without sentence marks around it
    vocabulary = _vocabulary()
    other = len(vocabulary)
    names = np.fromiter((vocabulary.get(w.strip(MARKS).lower(), other) for w in found.names), np.int64, len(found.names))
    at = np.repeat(np.arange(len(texts)), n) * (other + 1) + names[found.of]
    words = np.bincount(at, minlength=len(texts) * (other + 1)).reshape(-1, other + 1)
    return {
        "n_words": n, "word_chars": lengths - np.diff(spaces), "n_symbols": chars[:, 6].astype(np.int64),
        "n_dup_lines": np.fromiter(map(_repeat_lines, texts), np.int64, len(texts)), "n_repeat_words": np.array(repeat, np.int64), "chars": chars, "words": words,
    }


#: Languages that have a reference.
MOST_LANGUAGES = 256


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row to the reference; rows without counts have 0."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(1), np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(counts.sum(1) > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each of the MOST_LANGUAGES values of lang with most counts (equal ones by name) the summed histograms of all its documents that
    pass the base rules. Unclean labels may have millions of values; documents of the others are held against these references, too. One
    row for each language and task batch is summed in Spark."""
    size = CLASSES + len(_vocabulary()) + 1
    if "lang" not in docs.columns:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, most=WIDE_STEP_CHARS):
            f = features(part)
            both, ok = np.concatenate([f["chars"], f["words"]], 1), ~base_failed(f)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in {x for x in langs if x is not None}:
                sums[lang] = sums.get(lang, 0) + both[ok & (langs == lang)].sum(0)
        rows = [(lang, i, int(x)) for lang, y in sums.items() for i, x in enumerate(y) if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["lang", "i", "x"])

    counted = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, i int, x long")
    sums = written(counted.groupBy("lang", "i").agg(F.sum("x").alias("x")), "references")
    most = sums.groupBy("lang").agg(F.sum("x").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    out: dict[str, np.ndarray] = {}
    for r in sums.join(F.broadcast(most.select("lang")), "lang", "left_semi").collect():
        out.setdefault(r.lang, np.zeros(size))[r.i] = r.x
    return {k: (v[:CLASSES], v[CLASSES:]) for k, v in sorted(out.items())}


class Limits(NamedTuple):
    """The distance of characters from the nearest language reference up to which a document is kept; the same of words,
    as a share of the distance that a text without any common word has from that reference: for long texts, and for
    texts of least_words; the number of characters and words from which on each of the two counts; and the percent of
    common words in a reference below which (a language without a list) it says nothing about words."""

    most_chars_apart: float = 0.28
    long_words_share: float = 0.6
    short_words_share: float = 0.9
    least_chars: int = 100
    least_words: int = 50
    least_common_percent: int = 10


def most_words_apart(n_words: np.ndarray, reference: np.ndarray, limits: Limits) -> np.ndarray:
    """The word distance up to which a text of n_words is kept. It grows as the text gets shorter, as chance does with the
    root of the number, and stays below that of a text without common words."""
    if 100 * reference[:-1].sum() < limits.least_common_percent * reference.sum():
        return np.ones(len(n_words))
    none = np.zeros((1, len(reference)))
    none[0, -1] = 1
    chance = np.sqrt(limits.least_words / np.maximum(n_words, limits.least_words))
    return distance(none, reference)[0] * (limits.long_words_share + (limits.short_words_share - limits.long_words_share) * chance)


def judge(part: pa.RecordBatch, known: list[tuple[np.ndarray, np.ndarray]], limits: Limits) -> dict[str, pa.Array]:
    f = features(part)
    failed, total = base_failed(f), f["chars"].sum(1)
    long_chars, long_words = total >= limits.least_chars, f["n_words"] >= limits.least_words
    far = np.full(len(failed), np.inf)
    chars = words = np.zeros(len(failed))
    for c, w in known:
        x, y = np.where(long_chars, distance(f["chars"], c), 0), np.where(long_words, distance(f["words"], w), 0)
        # rounded, so that references at equal distance are told apart by the characters and not by their order
        worst = np.round(np.maximum(x / limits.most_chars_apart, y / most_words_apart(f["n_words"], w, limits)), 9)
        nearer = (worst < far) | (worst == far) & (x < chars)
        chars, words, far = np.where(nearer, x, chars), np.where(nearer, y, words), np.minimum(worst, far)
    out = {k: pa.array(f[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": pa.array(failed)}
    return out | {"chars_apart": pa.array(chars, mask=~long_chars | (not known)), "words_apart": pa.array(words, mask=~long_words | (not known)), "kept": pa.array(~failed & ((far <= 1) | (not known)))}


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars_apart, words_apart,
    kept of each row of docs.

    kept: the base rules hold, and some language reference is near enough in both histograms. A histogram counts only
    from a least length on; below, its distance is null and rejects nothing. References are counted over all documents
    with a lang (null langs count for none); without any, or without a column lang, only the base rules decide. Null texts
    have no words and fail; an empty table gives no row. Rows repeat as often as in docs; other columns are left out."""
    known = list(references(docs).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=WIDE_STEP_CHARS):
            found = judge(part, known, limits)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.values()], ["doc_id", *found])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_apart double, words_apart double, kept boolean"
    return id_and_text(docs).mapInArrow(run, schema)


def good_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps."""
    known = list(references(docs).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=WIDE_STEP_CHARS):
            yield part.filter(judge(part, known, limits)["kept"])

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
