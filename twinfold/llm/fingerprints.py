"""Operator 1: document fingerprints as invertible Bloom lookup sketches, in SQL functions.

A text is cut into paragraphs (the sentences of its lines), and each distinct paragraph becomes a digest of 47 bits of
its hash and 16 bits that check them. A digest falls into one cell of each of three parts of the sketch; a cell holds
how many digests it has, and the XOR of them. The sketches of two versions are subtracted cell by cell; a cell with one
digest left shows it, and taking it out of its other cells shows more, until nothing is left. A cell is taken for such a one if its
check bits agree and it is one of the digest's cells; a cell of several digests may still look so, which is why what is put back is
no difference, and why digests that the versions don't have count as a failure. If something stays or fails, the same
is done with larger sketches: the digests are dealt to groups by their hash, and a group that doesn't peel gets four times
the cells and other places in them. A group that no sketch settles (odds below 1e-12) is compared digest by digest. All of it is a projection of one row; its work grows as the number of paragraphs,
but for the dealing, which takes three rounds of as many parts as the cube root of the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, id_and_text

#: Cells of each of the three parts of the fingerprint; of the larger sketches in turn, each with places of its own.
CELLS, LARGER_CELLS = 8, (32, 512, 512, 512)
#: Digests for each group of a larger sketch, and rounds of peeling.
GROUP_DIGESTS, PEEL_ROUNDS = 8, 16
#: Documents in a bucket of neighbouring doc_ids, and slices of the doc_id range that have as many documents each.
BUCKET_DOCS, SLICES = 1024, 64
#: 47 bits of a hash; the 16 bits below them check them.
_BITS, _CHECK = (1 << 63) - (1 << 16), "xxhash64(shiftrightunsigned({0}, 16)) & 65535"
_ZERO = "named_struct('c', 0, 'k', 0L)"


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """Distinct positive 64-bit digests of the paragraphs of a text: the sentences of its lines."""
    found = f"filter(split({text}, '(?=\\\\s)(?:\\\\n+|(?<=[.!?])\\\\s+)'), p -> p <> '')"
    return f"array_distinct(transform(transform({found}, p -> xxhash64(p) & {_BITS}L), h -> h | ({_CHECK.format('h')})))"


def _mask(digest: str) -> str:
    """The cells of a digest as bits of a number."""
    return " | ".join(f"shiftleft({1 << CELLS * t}, cast(shiftright({digest}, {16 + 8 * t}) & {CELLS - 1} as int))" for t in range(3))


def _items(found: str, sign: int, group: str) -> str:
    return f"transform({found}, d -> named_struct('x', {'d' if sign > 0 else '-d'}, 'm', {_mask('d')}, 'n', {group}))"


def _changed(by: str, start: str, sign: str) -> str:
    """A cell (c: how many, k: their XOR) after the items of ``by`` that are in cell i have been put in (+) or taken out (-)."""
    return f"aggregate({by}, {start}, (a, x) -> if((shiftright(x.m, i) & 1) = 1, named_struct('c', a.c {sign} cast(sign(x.x) as int), 'k', a.k ^ abs(x.x)), a))"


def _cells(items: str) -> str:
    """The sketch of items."""
    return f"transform(sequence(0, {3 * CELLS - 1}), i -> {_changed(items, _ZERO, '+')})"


def sketch(found: str) -> str:
    return let("own", _items(found, 1, "0L"), _cells("own"))


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (l, r) -> named_struct('c', l.c - r.c, 'k', l.k ^ r.k))"


#: What was taken out, without digests that were put back later.
_CANCELLED = "if(size(array_distinct(transform(st.got, x -> abs(x)))) = size(st.got), st.got, filter(st.got, x -> not array_contains(st.got, -x)))"


def _peeled(cells: str, pure: str, left: str) -> str:
    step = let("pure", pure, f"if(size(pure) = 0, named_struct('cells', st.cells, 'got', st.got, 'go', false), named_struct('cells', {left}, 'got', st.got || transform(pure, x -> x.x), 'go', true))")
    start = f"named_struct('cells', {cells}, 'got', cast(array() as array<bigint>), 'go', true)"
    return f"aggregate(sequence(1, {PEEL_ROUNDS}), {start}, (st, r) -> if(st.go, {step}, st), st -> if(forall(st.cells, v -> v.c = 0 and v.k = 0) and size(array_distinct(st.got)) = size(st.got), {_CANCELLED}, null))"


_ALONE = f"(v.c = 1 or v.c = -1) and (v.k & 65535) = ({_CHECK.format('v.k')})"


def peeled(cells: str) -> str:
    """The digests that differ, negative if only the second text has them; null if the sketch doesn't peel."""
    pure = f"transform(array_distinct(transform(filter(st.cells, (v, i) -> {_ALONE} and (shiftright({_mask('v.k')}, i) & 1) = 1), v -> v.k * v.c)), x -> named_struct('x', x, 'm', {_mask('abs(x)')}))"
    return _peeled(cells, pure, f"transform(st.cells, (v, i) -> {_changed('pure', 'v', '-')})")


def peeled_larger(items: str) -> str:
    """The same from a sketch of items of m cells a part, in which the salt (from 1) says where a digest lies."""
    place = "pmod(shiftrightunsigned(xxhash64({0}, salt), 10 * {1}), m)"
    cell = "aggregate(filter({0}, x -> {1} = {2}), {3}, (a, x) -> named_struct('c', a.c {4} cast(sign(x.x) as int), 'k', a.k ^ abs(x.x)))"
    cells = f"flatten(transform(sequence(0, 2), t -> transform(sequence(0, m - 1), j -> {cell.format(items, place.format('abs(x.x)', 't'), 'j', _ZERO, '+')})))"
    pure = f"transform(array_distinct(transform(filter(st.cells, (v, i) -> {_ALONE} and {place.format('v.k', 'cast(i div m as int)')} = i % m), v -> v.k * v.c)), x -> named_struct('x', x))"
    return _peeled(cells, pure, f"transform(st.cells, (v, i) -> {cell.format('pure', place.format('abs(x.x)', 'cast(i div m as int)'), 'i % m', 'v', '-')})")


def _dealt(items: str) -> str:
    """Items by the number n of their group, in three rounds of f parts."""
    part = "transform(sequence(0L, f - 1), q -> filter({0}, x -> pmod(x.n div {1}, f) = q))"
    thirds = f"flatten(transform({part.format(items, '(f * f)')}, w -> {part.format('w', 'f')}))"
    return f"filter(flatten(transform({thirds}, w -> {part.format('w', '1')})), w -> size(w) > 0)"


def differences(own: str, others: list[str]) -> str:
    """For each of the others (columns of digests, beside columns of the same name and _cells with their sketches) the
    digests that are in own only, and negative those that are in it only: from the fingerprints, else from larger sketches, else
    (for a group that none of them settles) from the digests themselves."""
    # what was peeled, if the two versions have it
    known = lambda got, every: let("g", got, f"if(size(g) = 0 or size(array_except(g, {every})) = 0, g, null)")
    signed_items = "transform(w, y -> y.x)"
    sizes = ", ".join(map(str, LARGER_CELLS))
    tries = f"aggregate(sequence(1, {len(LARGER_CELLS)}), cast(null as array<bigint>), (got, salt) -> coalesce(got, {known(let('m', f'element_at(array({sizes}), salt)', peeled_larger('w')), signed_items)}))"
    group = f"coalesce({known(peeled(_cells('w')), signed_items)}, {tries}, filter({signed_items}, x -> not exists(w, y -> y.x = -x)))"
    signed = f"{_items(own, 1, 'pmod(xxhash64(d), n)')} || {_items('o.d', -1, 'pmod(xxhash64(d), n)')}"
    dealt = let("n", f"greatest(1L, cast(ceil((size({own}) + size(o.d)) / {GROUP_DIGESTS}D) as bigint))", let("f", "cast(ceil(cbrt(n)) as bigint)", let("every", signed, _dealt("every"))))
    pairs = ", ".join(f"named_struct('d', {x}, 'cells', {x}_cells)" for x in others)
    return f"transform(array({pairs}), o -> coalesce({known(peeled(subtracted(f'{own}_cells', 'o.cells')), f'{own} || transform(o.d, d -> -d)')}, flatten(transform({dealt}, w -> {group}))))"


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Common digests by all digests; 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart))


def serialised(cells: str) -> str:
    """Each cell as 8 and 16 hexadecimal digits."""
    return f"array_join(transform({cells}, v -> concat(lpad(hex(v.c), 8, '0'), lpad(hex(v.k), 16, '0'))), '')"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and next_text: the text of the next row in ascending order of doc_id (null first,
    equal ones by text), for the last row that of the first.

    The rows are dealt to buckets of neighbouring doc_ids, about BUCKET_DOCS each: the id range is cut into SLICES of
    as many rows (approximate percentiles), and these evenly by the id. So one shuffle brings neighbours together; only
    the first row of each bucket goes to the bucket before it."""
    docs = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    quantiles = [i / SLICES for i in range(SLICES + 1)]
    stats = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", quantiles, 10_000).alias("at")).first()
    bounds = sorted(set(stats.at or [0]))
    parts = max(1, -(-stats.n // (BUCKET_DOCS * SLICES)))
    # slice k has the ids from bounds[k - 1] on and below bounds[k]
    edges = F.array(*[F.lit(x) for x in bounds])
    part = F.size(F.filter(edges, lambda x: x <= F.coalesce("doc_id", F.lit(bounds[0]))))
    low, high = F.get(edges, F.col("slice") - 1).cast("double"), F.get(edges, F.col("slice")).cast("double")
    within = F.least(F.lit(parts - 1), F.floor((F.col("doc_id").cast("double") - low) / (high - low) * parts))
    dealt = docs.withColumn("slice", part).withColumn("bucket", F.coalesce(F.col("slice").cast("long") * parts + F.coalesce(within, F.lit(0)), F.lit(0)))

    # bucket is never null, so that no join filters it below this exchange and all three uses share it
    rows = dealt.select("bucket", "doc_id", "text").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    near = rows.withColumns({"next_text": F.lead("text").over(order), "before": F.lag(F.lit(1)).over(order)})
    inner = near.where("next_text is not null").select("doc_id", "text", "next_text")
    last = near.where("next_text is null").select("bucket", "doc_id", "text")
    first = near.where("before is null").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("next_text"))

    # the bucket after each bucket: within its slice, else the first one of the next slice (SLICES rows), else the first of all
    buckets = dealt.select("slice", "bucket").distinct()
    heads = buckets.groupBy("slice").agg(F.min("bucket").alias("head"))
    every = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("slice", F.coalesce(F.lead("head").over(Window.orderBy("slice")), F.min("head").over(every)).alias("after_slice"))
    after = buckets.withColumn("inside", F.lead("bucket").over(Window.partitionBy("slice").orderBy("bucket"))).join(heads, "slice").select("bucket", F.coalesce("inside", "after_slice").alias("next_bucket"))
    return inner.unionByName(last.join(after, "bucket").join(first, "next_bucket").select("doc_id", "text", "next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_difference,
    next_difference of each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    text. The differences are the digests that the sketches' difference peels to, negative for those of the other
    text; likeness is common by all distinct digests by them. Two texts without paragraphs (null,
    empty) have likeness 1. A table of one row is its own next; equal doc_ids follow each other by text, and an empty table
    gives no row. Rows repeat as often as in docs; other columns are left out."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumns({k: F.expr(digests(c)) for k, c in (("a", "text"), ("b", "edited"), ("c", "next_text"))})
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "b", "c")
    rows = rows.withColumns({f"{c}_cells": F.expr(sketch(c)) for c in "abc"}).withColumn("apart", F.expr(differences("a", ["b", "c"])))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(serialised("a_cells")).alias("fingerprint"), F.expr(serialised("b_cells")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.size(F.col("apart")[0])).alias("near_edited"), likeness(F.col("a"), F.col("c"), F.size(F.col("apart")[1])).alias("near_next"),
        F.col("apart")[0].alias("edited_difference"), F.col("apart")[1].alias("next_difference"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).drop("edited_difference", "next_difference")
