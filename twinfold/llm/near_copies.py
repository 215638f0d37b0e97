"""Operator 7: near-duplicate documents by b-bit MinHash.

Each document is sketched once, where it is read: the set of its word shingles, MINIMA minima over that set, hashes
of BANDS groups of them, and the low BITS bits of all minima, packed. Documents of one set are one class. Classes
that share a band are candidates; the packed bits estimate their similarity, corrected for chance agreement, and what
may be alike is confirmed on the full sets. A band shared by many classes isn't expanded into pairs: all compare
with its most central class. Classes that share a band but aren't connected by that are compared by prefixes: shingles
are put in one order, rare ones first, and two sets that are alike enough have one of their first shingles in common, the
fewer the nearer they are in size. Pairs within a component aren't made."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import WIDE_STEP_CHARS, documents, id_and_text, slices, written
from .words import mixed, shingle_sets

BANDS, ROWS, BITS = 24, 4, 4
MINIMA = BANDS * ROWS
#: Slots of the table of shingle frequencies that orders the shingles; ratio of set sizes within a size class.
SLOTS, SIZE_RATIO = 1 << 20, 1.02
#: A key that holds more than this part of a table's rows is hot; fewer than HOT_SHARES keys are, at any size.
HOT_SHARES = 4096


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240)
    return draw.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, MINIMA, np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    times, plus = _functions()
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (times[:, None] * x[None, at : at + 4096] + plus[:, None]).min(1))
    return out


def bands_and_bits(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    groups, keys = low.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys + groups[:, k])
    each = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, each)
    packed = (bits << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=WIDE_STEP_CHARS):
        names, sizes, keys, bits, seen = [], [], [], [], {}
        for x in shingle_sets(part.column("text")):
            name = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None
            if name not in seen:
                seen[name] = bands_and_bits(minima(x)) if len(x) else ([], [])
            names.append(name)
            sizes.append(len(x))
            keys.append(seen[name][0])
            bits.append(seen[name][1])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "set_id", "n_shingles", "bands", "bits"])


def similarity_estimate(a: str, b: str):
    """From the packed bits of two sketches: equal groups of bits, without those that agree by chance."""
    x = "x ^ y"
    differ = f"zip_with({a}, {b}, (x, y) -> bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L))"
    return F.expr(f"((1 - aggregate({differ}, 0, (s, x) -> s + x) / {MINIMA}D) - {1 / 2**BITS}D) / {1 - 1 / 2**BITS}D")


def least_estimate(percent: int) -> float:
    """Estimated similarity below which a pair isn't confirmed: six standard deviations below percent."""
    chance = 1 / 2**BITS
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - 6 * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices([whole], "b_text", WIDE_STEP_CHARS):
                mid = part.column("a_text").dictionary_encode()
                left, right = shingle_sets(mid.dictionary), shingle_sets(part.column("b_text"))
                keep = []
                for i, y in zip(mid.indices.to_pylist(), right, strict=True):
                    both = len(np.intersect1d(left[i], y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(left[i]) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b: doc_ids) whose texts' full sets are alike enough."""
    texts = docs.where("doc_id is not null and text is not null")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    # a centre may have most of the pairs
    sizes = written(pairs.groupBy("a").agg(F.count("*").alias("n")), "centre-sizes")
    both = joined(pairs.join(b, "b"), sizes.join(a, "a"), ["a"], "b", sizes)
    return both.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(percent), "a long, b long")


def joined(rows: DataFrame, own: DataFrame, keys: list[str], by: str, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the columns of own: one row a key, with the number n of its rows (not null; or in a table sizes). The rows of a hot key are dealt to as
    many parts as it has shares, by the column ``by``; each part has a copy of the key's row. So no task gets a hot key
    whole, and what is broadcast has fewer than HOT_SHARES rows."""
    sizes = own if sizes is None else sizes
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARES > total).select(*keys, F.ceil(F.col("n") * HOT_SHARES / total if total else F.lit(1)).cast("long").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    copies = own.drop("n").join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=WIDE_STEP_CHARS):
        n = np.bincount(np.concatenate([np.empty(0, np.int64), *[_slot(x) for x in shingle_sets(part.column("text"))]]), minlength=1)
        slot = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], ["slot", "n"])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(SIZE_RATIO) + 1e-9))


def _prefixes(frequency: np.ndarray, percent: int):
    """For each text, first as the smaller set of a pair: its size class and first shingles; then as the larger one: the
    same for each size class that a smaller set may have. Place counts from 0 in the order by frequency."""

    def least(x: int, y: int) -> int:
        return -(-percent * (x + y) // (100 + percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=500_000):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, r, x in zip(part.column("class_id").to_pylist(), part.column("root").to_pylist(), shingle_sets(part.column("text")), strict=True):
                size = len(x)
                order = x[np.lexsort((x, frequency[_slot(x)]))]
                wanted = [(False, _size_class(size), size - least(size, size) + 1)]
                smallest = -(-percent * size // 100)
                for c in range(_size_class(smallest), _size_class(size) + 1):
                    from_size = max(smallest, int(np.ceil(SIZE_RATIO**c - 1e-6)))
                    wanted.append((True, c, size - least(from_size, size) + 1))
                for larger, c, n in wanted:
                    n = min(n, size)
                    for col, v in zip(cols, (order[:n].view(np.int64), np.full(n, c), np.full(n, larger), np.full(n, i), np.full(n, r), np.full(n, size), np.arange(n)), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, types, strict=True)], ["token", "size_class", "larger", "id", "root", "size", "place"])

    return run


def prefix_pairs(candidates: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b) of candidates (class_id, root, text) with different roots that may be alike enough: none that is gets lost."""
    frequency = np.zeros(SLOTS, np.int64)
    # one number for each slot, however many texts there are
    for r in candidates.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r.slot] = r.n
    rows = candidates.select("class_id", "root", "text").mapInArrow(_prefixes(frequency, percent), "token long, size_class int, larger boolean, id long, root long, size long, place long")
    rows = written(rows, "prefixes")
    cell = ["token", "size_class"]
    groups = rows.groupBy(*cell, "root").agg(F.count("*").alias("n")).groupBy(*cell).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n")).where("roots > 1").drop("roots")
    rows = written(joined(rows, written(groups, "prefix-groups"), cell, "id"), "shared-prefixes")
    x = rows.where("not larger").select(*cell, "main", *[F.col(c).alias(f"x_{c}") for c in ("id", "root", "size", "place")])
    y = rows.where("larger").select(*cell, *[F.col(c).alias(f"y_{c}") for c in ("id", "root", "size", "place")], (F.col("root") == F.col("main")).alias("y_main"))
    alike = F.expr(f"x_root <> y_root and (x_size < y_size or x_size = y_size and x_id <> y_id) and 100 * x_size >= {percent} * y_size and {100 + percent} * least(x_size - x_place, y_size - y_place) >= {percent} * (x_size + y_size)")
    # pairs within the largest component of a group are left out before the join, not after it
    few = x.where("x_root <> main").join(y, cell).where(alike)
    many = x.where("x_root = main").join(y.where("not y_main"), cell).where(alike)
    return few.select("x_id", "y_id").unionByName(many.select("x_id", "y_id")).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Two documents are linked if 100 * common shingles >= percent * all their shingles; a component is what links
    reach, component_id its smallest doc_id, and only that document is kept. Texts without words (null, empty, white
    space) have no shingles and are linked with nothing. Rows that share a doc_id but not the text belong to the component
    of their own text; classes of the same smallest doc_id count as one. Null doc_ids link to nothing and keep a null
    component (kept). Columns other than doc_id and text are left out. percent is from 80 to 100: the bands would miss
    pairs that are less alike."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    docs = id_and_text(docs)
    sketches = written(docs.mapInArrow(_sketch, "doc_id long, set_id binary, n_shingles long, bands array<long>, bits array<long>"), "sketches")
    real = sketches.where("set_id is not null and doc_id is not null")
    classes = written(real.groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
    rows = classes.select("class_id", F.explode("bands").alias("band"))
    sizes = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", "n", F.col("n").alias("rows")), "band-sizes")
    shared = written(joined(rows, sizes, ["band"], "class_id"), "bands")
    weight = shared.groupBy("class_id").agg(F.sum("rows").alias("weight"))
    ranked = written(shared.join(weight, "class_id").select("band", "class_id", "weight"), "ranked-bands")
    bits = classes.select("class_id", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(bits.select(F.col("class_id").alias("a"), F.col("bits").alias("x_bits")), "a").join(bits.select(F.col("class_id").alias("b"), F.col("bits").alias("y_bits")), "b")
        return written(ends.where(similarity_estimate("x_bits", "y_bits") >= least_estimate(percent)).select("a", "b").distinct(), "pairs")

    # every class with the most central one of each of its bands
    centre = written(ranked.groupBy("band").agg((-F.max(F.struct("weight", (-F.col("class_id")).alias("c")))["c"]).alias("centre"), F.count("*").alias("n")), "centres")
    pairs = joined(ranked.select("band", "class_id"), centre, ["band"], "class_id").where("class_id <> centre").select(F.least("class_id", "centre").alias("a"), F.greatest("class_id", "centre").alias("b")).distinct()
    links = written(confirmed(likely(pairs), docs, percent), "confirmed")

    # what shares a band with another component
    roots = components(links).withColumnRenamed("node", "class_id")
    placed = ranked.select("band", "class_id").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    apart = written(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n"), "unlinked-bands")
    apart = joined(placed, apart, ["band"], "class_id").select("class_id", "root").distinct()
    candidates = written(apart.join(docs.withColumnRenamed("doc_id", "class_id"), "class_id"), "unlinked-texts")
    texts = candidates.select(F.col("class_id").alias("doc_id"), "text")
    links = links.unionByName(written(confirmed(likely(prefix_pairs(candidates, percent)), texts, percent), "confirmed"))

    roots = components(links).withColumnRenamed("node", "class_id")
    placed = sketches.select("doc_id", "set_id", "n_shingles").join(classes.select("set_id", "class_id"), "set_id", "left").join(roots, "class_id", "left")
    whole = placed.select("doc_id", "n_shingles", F.coalesce("root", "class_id", "doc_id").alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: the one with the smallest doc_id (null
    last; any of equal ones). Each row counts by itself, whatever doc_id others have. Texts without words all stay."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_own")), "numbered")
    found = near_copies(keyed.select(F.col("_row").alias("doc_id"), F.col("_own.text").alias("text")), percent).select(F.col("doc_id").alias("_row"), "component_id")
    # one row for each component, added up before the shuffle; no join by component
    rows = written(found.join(keyed.select("_row", F.col("_own.doc_id").alias("id")), "_row"), "components")
    stay = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("least")).select("least._row")
    gone = written(rows.select("_row").join(stay, "_row", "left_anti"), "near-copies")
    return keyed.join(gone, "_row", "left_anti").select("_own.*")


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir), percent=85)


OP7_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
 SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""
