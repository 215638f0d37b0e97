"""Operator 11: how the sources of each language differ in their words, by in-mapper stripes.

Each task folds whole documents into a hash of stripes: a term of a language with the number of documents that have it
and its occurrences by source. A hash that has grown to SPILL_CELLS numbers is given out and emptied. Stripes of one term
meet after one sort by (language, term), where they are added up as they pass; most terms go there. The stripes that stay
are dealt to parts of about TERMS_A_PART terms of a language, however many it has; each part gives, from its stripes, the
sums of differences of all its sources and its best terms. Nothing holds all terms of a language or all documents of a source."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WIDE_STEP_CHARS, documents, slices, written

#: Numbers in a task's hash beyond which it is given out; terms of a language in one part; sources that one task compares with all others.
SPILL_CELLS, TERMS_A_PART, SOURCES_A_BLOCK = 400_000, 4096, 256
#: Documents that a kept term is in; what is added to each count; what shares are multiples of (its cube root, three times); ranks of terms.
LEAST_DOCS, ADDED, STEP, RANKS = 30, 5, 1000, 50
#: A-Z as a-z, other ASCII characters that aren't letters as spaces; bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z (as a-z), a-z and all characters beyond ASCII of a text in UTF-8."""
    return text.translate(_FOLD).split()


class Stripes:
    """term -> (documents, occurrences by source) of each language, filled by document."""

    def __init__(self) -> None:
        self.frequency: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        found = terms(text)
        self.counts[lang, source].update(found)
        self.frequency[lang].update(set(found))

    @property
    def cells(self) -> int:
        return sum(map(len, self.frequency.values())) + sum(map(len, self.counts.values()))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each language and term; the empty term stands for the language and has all its sources, with 0."""
        for lang, frequency in self.frequency.items():
            names = [s for of, s in self.counts if of == lang]
            place = {t: i for i, t in enumerate(frequency)}
            at, source, count = [np.zeros(len(names), np.int64)], [np.arange(len(names))], [np.zeros(len(names), np.int64)]
            for k, s in enumerate(names):
                own = self.counts[lang, s]
                at.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)) + 1)
                source.append(np.full(len(own), k))
                count.append(np.fromiter(own.values(), np.int64, len(own)))
            at, source, count = map(np.concatenate, (at, source, count))
            order, bounds = np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(place) + 1))])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x)
            n = len(place) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([b"", *place], pa.binary()).cast(pa.string()), pa.array([0, *frequency.values()], pa.int64()), lists(pa.array(names, pa.string()).take(pa.array(source[order]))), lists(pa.array(count[order]))],
                ["lang", "term", "df", "sources", "counts"],
            )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for part in slices(batches, most=WIDE_STEP_CHARS):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            stripes.add(lang, source, text)
        if stripes.cells > SPILL_CELLS:
            yield from stripes.rows()
            stripes = Stripes()
    yield from stripes.rows()


def _added_up(rows: pa.Table, least: int) -> tuple[pa.Table, pa.Table]:
    """Rows sorted by language and term: one row for each term, of which those below ``least`` documents are left out; and the
    last term, which may go on."""
    new = np.ones(rows.num_rows, bool)
    for c in ("lang", "term"):
        x = rows.column(c).combine_chunks()
        same = pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        new[1:] = new[1:] & same if c == "lang" else ~(new[1:] & same)
    starts = np.flatnonzero(new)
    df = np.add.reduceat(rows.column("df").to_numpy(), starts)
    keep = (df >= least) | pc.equal(rows.column("term").take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
    keep[-1] = True
    stay = pa.array(keep[np.cumsum(new) - 1])
    own, run = rows.filter(stay), np.cumsum(new[stay.to_numpy(zero_copy_only=False)]) - 1
    sources, counts = own.column("sources").combine_chunks(), own.column("counts").combine_chunks().flatten().to_numpy()
    coded, each = sources.flatten().dictionary_encode(), np.repeat(run, pc.list_value_length(sources).to_numpy())
    cells, back = np.unique(each * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)
    total = np.zeros(len(cells), np.int64)
    np.add.at(total, back, counts)
    k = int(keep.sum())
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cells // max(1, len(coded.dictionary)), minlength=k))]), pa.int32())
    first = pa.array(starts[keep])
    out = pa.table([rows.column("lang").take(first), rows.column("term").take(first), pa.array(df[keep]), pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(cells % max(1, len(coded.dictionary))))), pa.ListArray.from_arrays(bounds, pa.array(total))], names=rows.column_names)
    return out.slice(0, k - 1), out.slice(k - 1)


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                done, last = _added_up(pa.concat_tables([last.cast(now.schema), now]) if last else now, least)
                yield from done.combine_chunks().to_batches()
        if last and (last.column("df")[0].as_py() >= least or last.column("term")[0].as_py() == ""):
            yield from last.combine_chunks().to_batches()

    return run


def stripes(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, df, sources, counts of the terms in at least so many documents of their language; and for each language a
    row with the empty term and all its sources."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = texts.mapInArrow(_fold, _STRIPE)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least), _STRIPE)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total) of 0 <= count <= total < 9 * 10^15, in steps of 1000 so that nothing overflows."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * STEP
        out, rest = out * STEP + rest // total, rest % total
    return out + 1


def _best(value: np.ndarray, names: list[str], most: int) -> list[int]:
    """The places of the largest values, equal ones by name in UTF-8."""
    if len(value) > most:
        at = np.flatnonzero(value >= np.partition(value, -most)[-most])
    else:
        at = np.arange(len(value))
    return sorted(at.tolist(), key=lambda i: (-value[i], names[i].encode()))[:most]


def _differences(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one part of a language's stripes (left) and all its sources with their counts (right): for each source of the block its
    differences from all others, summed over the part, and its RANKS best terms of the part."""
    lang, block = key[0].as_py(), key[2].as_py()
    order = sorted(range(right.num_rows), key=lambda i: right.column("source")[i].as_py().encode())
    names = [right.column("source")[i].as_py() for i in order]
    n, v = right.column("n").to_numpy()[order], int(right.column("v")[0].as_py())
    own = np.arange(block * SOURCES_A_BLOCK, min(len(names), (block + 1) * SOURCES_A_BLOCK))
    apart, best = np.zeros((len(own), len(names)), np.int64), [([], np.empty(0, np.int64)) for _ in own]
    place = pa.array(names, pa.string())
    for start in range(0, left.num_rows, step := max(1, 2_000_000 // len(names))):
        part = left.slice(start, step).combine_chunks()
        words, lists = part.column("term").to_pylist(), part.column("sources").combine_chunks()
        count = np.zeros((len(words), len(names)), np.int64)
        at = pc.index_in(lists.flatten(), place).to_numpy()
        count[np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy()), at] = part.column("counts").combine_chunks().flatten().to_numpy()
        p, q = shares(count + ADDED, (n + ADDED * v)[None]), shares(count.sum(1) + ADDED, int(n.sum()) + ADDED * v)
        for k, i in enumerate(own):
            apart[k] += np.abs(p - p[:, i : i + 1]).sum(0)
            more = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
            value = np.concatenate([best[k][1], p[more, i] - q[more]])
            found = [*best[k][0], *(words[j] for j in more)]
            take = _best(value, found, RANKS)
            best[k] = ([found[j] for j in take], value[take])
    rows = [(names[i], "pair", names[j], int(apart[k, j])) for k, i in enumerate(own) for j in range(len(names)) if j != i]
    rows += [(names[i], "term", t, int(x)) for k, i in enumerate(own) for t, x in zip(*best[k], strict=True)]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([lang] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of docs.

    Part ``pair``: item is each other source of the language, value the sum over the language's kept terms (in at least
    ``least`` of its documents) of the difference of the two sources' smoothed shares, in units of 10^-9. Part ``term``: the
    terms that the source uses more than its language, to rank 50. Equal values rank by item in UTF-8. Null texts,
    languages and sources are empty strings; a language without kept terms gives pairs of value 0, one source no pairs; rows
    count as often as they are there, whatever their doc_id; an empty table gives no rows. Other columns aren't read."""
    kept = written(stripes(docs, least), "stripes")
    n_terms = kept.where("term <> ''").count()
    parts = max(1, -(-n_terms // TERMS_A_PART))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.max(F.when(F.col("term") == "", F.size("sources"))).alias("s"))
    groups = written(counted.join(langs, "lang"), "groups")
    # the parts that a language has terms in, and one part for a language without terms
    cells = dealt.select("lang", F.when(F.col("term") != "", F.col("part")).otherwise(0).alias("part")).distinct()
    cells = cells.join(langs.select("lang", "s"), "lang").select("lang", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("s") / SOURCES_A_BLOCK) - 1)).alias("block"))
    cells, key = written(cells, "cells"), ["lang", "part", "block"]
    left = dealt.where("term <> ''").join(cells, ["lang", "part"]).select(*key, "term", "sources", "counts")
    right = groups.join(cells.toDF(*cells.columns), "lang").select(*key, "source", "n", "v")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_differences, "lang string, source string, part string, item string, value long")
    found = written(found, "differences")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    return pairs.unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
 g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2), nl AS (SELECT lang, sum(c) AS n FROM c GROUP BY 1), cl AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY 1, 2),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v))::BIGINT AS p FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
 q AS (SELECT cl.lang, cl.term, (1 + (1000000000::HUGEINT * (cl.c + 5)) // (nl.n + 5 * v.v))::BIGINT AS q FROM cl JOIN nl USING (lang) JOIN v USING (lang)),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
