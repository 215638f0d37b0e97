"""Operator 12: near-duplicate documents by SimHash fingerprints, compared bit-sliced.

Documents of one fingerprint are one class. If two fingerprints differ in at most RADIUS bits, then of RADIUS + 1 groups of
their bits one is equal, so classes are dealt to buckets by each group. Within a batch of buckets the fingerprints are held
as bit planes: plane b has bit b of all of them, one after the other. Shifted by a lag, a plane meets itself, so one XOR of
words compares 64 pairs in a bit; carry-save counters of two bits add the differences up, a third plane takes what runs over,
and words in which all pairs have run over (or are in one component) are left behind. Of a bucket's links only a spanning forest is given.

A bucket of more than BUCKET fingerprints isn't compared: its rows are dealt again by RADIUS + 1 groups of the bits that
they don't share yet, and so on. Distinct fingerprints share at most 64 bits, so that ends, and no task compares more than BUCKET at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .near_copies import joined
from .shared import WIDE_STEP_CHARS, documents, id_and_text, slices, written

#: Words of a shingle, differing bits of a link, fingerprints that one bucket compares, rows of buckets compared together.
SHINGLE, RADIUS, BUCKET, BATCH = 3, 3, 4096, 1 << 19
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CHUNK = 1 << 16


def hashes(words: list[bytes], first: int, last: int) -> np.ndarray:
    """XXH64 with seed 42 of the shingles that begin at the words first to last - 1 (all words, if there are fewer than a shingle has)."""
    words = words[first : last + SHINGLE - 1]
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist())), np.uint64)  # noqa: B905


def fingerprint(text: bytes) -> int:
    """The bits that are set in over half the hashes of the text's shingles; 0 without words."""
    words = text.translate(_LOWER).split()
    n, ones = max(1, len(words) - SHINGLE + 1) if words else 0, np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes(words, start, min(n, start + _CHUNK)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=WIDE_STEP_CHARS):
        texts = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))], ["doc_id", "fp"])


def planes(x: np.ndarray) -> np.ndarray:
    """Row b: bit b of all fingerprints, packed to words; with a word of zeros behind."""
    out = np.zeros((64, len(x) // 64 + 2), np.uint64)
    for b in range(64):
        bits = np.packbits(((x >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
        out[b].view(np.uint8)[: len(bits)] = bits
    return out


def near_at_lag(p: np.ndarray, lag: int, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The places i with wanted[i] at which the fingerprints i and i + lag differ in at most ``radius`` (at most 3) bits."""
    packed = np.packbits(wanted, bitorder="little")
    alive = np.zeros(-(-len(packed) // 8), np.uint64)
    alive.view(np.uint8)[: len(packed)] = packed
    word = np.flatnonzero(alive)
    alive, far, by = alive[word], lag // 64, np.uint64(lag % 64)
    ones, twos, over = (np.zeros(len(word), np.uint64) for _ in range(3))
    last = p.shape[1] - 1
    for b in range(64):
        if not len(word):
            break
        low, high = p[b, np.minimum(word + far, last)], p[b, np.minimum(word + far + 1, last)]
        other = (low >> by) | (high << (np.uint64(64) - by)) if by else low
        carry = p[b, word] ^ other
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        over |= carry
        if b % 4 == 3:
            alive &= ~over
            if not (stay := alive != 0).all():
                word, alive, ones, twos, over = word[stay], alive[stay], ones[stay], twos[stay], over[stay]
    # counts are twos * 2 + ones; beyond a smaller radius they go, too
    for k in range(radius + 1, 4):
        alive &= ~((twos if k & 2 else ~twos) & (ones if k & 1 else ~ones))
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return word[row] * 64 + bit


def _root(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def spanning_links(x: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) that connect all fingerprints of a bucket that chains of links connect; bucket: ascending numbers."""
    size = np.bincount(bucket)
    order = np.lexsort((np.arange(len(x)), bucket, -size[bucket]))  # large buckets first, so each lag needs a beginning only
    x, of = x[order], bucket[order]
    p, root, a, b = planes(x), np.arange(len(x)), [], []
    # the place after the last one whose bucket has more than lag members
    members = np.sort(size[size > 0])[::-1]
    ends = np.cumsum(members)
    for lag in range(1, int(members[0]) if len(members) else 0):
        m = int(ends[np.searchsorted(-members, -lag, "left") - 1])
        root = root[:m]  # whole buckets, so all roots lie in it
        before = len(a)
        wanted = (of[: m - lag] == of[lag:m]) & (root[: m - lag] != root[lag:m])
        for i in near_at_lag(p, lag, wanted, radius).tolist():
            j = i + lag
            if (s := _root(root, i)) != (t := _root(root, j)):
                root[max(s, t)] = min(s, t)
                a.append(order[i])
                b.append(order[j])
        while len(a) > before and not np.array_equal(up := root[root], root):
            root = up
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (mask, bits): links of whole buckets, about BATCH rows at a time."""
    rest: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[False], (rows[:2, 1:] != rows[:2, :-1]).any(0)])
        a, b = spanning_links(rows[2].view(np.uint64), np.cumsum(new))
        return pa.RecordBatch.from_arrays([pa.array(rows[3][a]), pa.array(rows[3][b])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            rest.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "bits", "fp", "class_id")]))
        if sum(r.shape[1] for r in rest) >= BATCH:
            rows = np.concatenate(rest, 1)
            end = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0))
            if len(end):
                cut = int(end[-1]) + 1
                yield links(rows[:, :cut])
                rest = [rows[:, cut:]]
    if rest:
        yield links(np.concatenate(rest, 1))


def split_bits(mask: int) -> list[int]:
    """RADIUS + 1 masks, each with one group of the bits that mask lacks added; a group may be empty where few are left."""
    free = [b for b in range(64) if not mask >> b & 1]
    groups = np.array_split(np.array(free, int), RADIUS + 1)
    return [mask | sum(1 << int(b) for b in g) for g in groups]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b (class_ids): links that connect all classes (class_id, fp: distinct, not null) that chains of fingerprints at RADIUS
    or fewer differing bits connect."""
    rows, masks, links = classes, [0], None
    while masks:
        # every row has one mask of the round before (the first: none), which splits in RADIUS + 1
        children = {m: split_bits(m) for m in masks}
        split: Column = F.array(*[F.lit(_signed(c)) for c in children[0]]) if masks == [0] else F.element_at(F.create_map(*[v for m, cs in children.items() for v in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))]), F.col("mask"))
        rows = rows.select("class_id", "fp", F.explode(split).alias("mask")).withColumn("bits", F.expr("fp & mask"))
        key = ["mask", "bits"]
        sizes = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, "n", F.col("n").alias("size")), "bucket-sizes")
        shared = written(joined(rows, sizes, key, "class_id"), "buckets")
        small = shared.where(F.col("size") <= bucket).select(*key, "fp", "class_id").repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "a long, b long")
        own = written(small, "fingerprint-links")
        links = own if links is None else links.unionByName(own)
        large = sizes.where(F.col("n") > bucket).select("mask").distinct()
        # masks of this round, at most RADIUS + 1 times those of the round before
        masks = sorted({r.mask % (1 << 64) for r in large.collect()})
        rows = shared.where(F.col("size") > bucket).select("class_id", "fp", "mask").distinct()
    return links


def simhash_links(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of docs.

    Fingerprints are taken over all 3-word shingles of the whole text, A-Z as a-z, repeats included; a text with fewer words is one
    shingle, a null or wordless one has the fingerprint 0 and is linked like any other. Rows with fingerprints of at most 3
    differing bits are linked; component_id is the smallest doc_id that links reach. Rows of equal doc_id are documents of
    their own whose fingerprints count as linked by that id. A null doc_id has no component (null) and links nothing. Repeated rows stay; an empty table gives
    none. Other columns aren't read."""
    prints = written(id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    real = prints.where("doc_id is not null")
    classes = written(real.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    links = fingerprint_links(classes.select("class_id", "fp"))
    # fingerprints of one doc_id that stands on several rows
    repeated = real.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    same = real.join(repeated, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    roots = components(links.unionByName(same)).withColumnRenamed("node", "class_id")
    own = written(classes.join(roots, "class_id", "left").select("fp", "n", F.coalesce("root", "class_id").alias("component_id")), "class-components")
    named = joined(real, own, ["fp"], "doc_id")
    whole = named.select("doc_id", "fp", "component_id").unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
    return whole.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_links(documents(spark, sf_dir))
