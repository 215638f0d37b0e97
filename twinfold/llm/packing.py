"""Operator 5: packing token ids into sequences, first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library_ids import id_type, ids_of
from .pieces import closed
from .shared import documents, id_and_text, slices

ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each size, largest first, goes to the leftmost bin that still holds it. A tournament
    tree over the bins keeps the largest room below each node, so that bin is found in log time."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        node = 1
        while node < leaves:
            node = 2 * node + (room[2 * node] < sizes[i])
        at = node - leaves
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        room[node] -= sizes[i]
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): the emptiest bins are cut up into the gaps of the fullest, until at most
    one bin has a gap; that one is split into lengths that are powers of two, which need no padding."""
    used = {i: sum(n for _, _, n in b) for i, b in enumerate(bins)}
    order = sorted(used, key=lambda i: (-used[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        i, j = order[low], order[high]
        if (gap := capacity - used[i]) == 0:
            low += 1
        elif not bins[j]:
            high -= 1
        else:
            item, start, n = bins[j].pop()
            take = min(gap, n)
            if take < n:
                bins[j].append((item, start, n - take))
            bins[i].append((item, start + n - take, take))
            used[i] += take
            used[j] -= take
    out, short = [], []
    for i, b in enumerate(bins):
        if b:
            (out if used[i] == capacity else short).append(b)
    for b in short:
        while b:
            total = sum(n for _, _, n in b)
            want, own = 1 << (total.bit_length() - 1), []
            while want:
                item, start, n = b.pop()
                take = min(want, n)
                own.append((item, start, take))
                if take < n:
                    b.append((item, start + take, n - take))
                want -= take
            out.append(own)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, sequence_length: int = 2048, group_docs: int = 4096) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence.

    Whole stretches of ``sequence_length`` ids are sequences of their own; what remains of each document is
    packed within random groups of about ``group_docs`` documents. Each document has at least its end id (null
    and empty texts only that). Rows of equal doc_id are documents of their own, dealt to groups apart from each
    other. An empty table gives no row; other columns are left out."""
    data = Path(tokenizer_path).read_bytes()
    groups = max(1, -(-docs.count() // group_docs))
    kind = id_type(data)
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for part in slices(batches):
            rows = []
            ids, ends = closed(*ids_of(data)(part.column("text")).joined(kind), end_id)
            wide, stored = ids.astype("<u4"), memoryview(ids).cast("B")
            keys = zip(part.column("grp").to_pylist(), part.column("row").to_pylist(), part.column("doc_id").to_pylist(), strict=True)
            for (grp, row, doc), first, last in zip(keys, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = last - first
                whole = n - n % sequence_length
                for at in range(0, whole, sequence_length):
                    rows.append((grp, row, doc, at, sequence_length, zlib.crc32(wide[first + at : first + at + sequence_length]), n, None))
                if whole < n:
                    rows.append((grp, row, doc, whole, n - whole, None, n, bytes(stored[(first + whole) * kind.itemsize : last * kind.itemsize])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        c = {k: table.column(k).to_pylist() for k in ("grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        ids = table.column("ids")
        parts = [i for i, x in enumerate(c["ids_crc32"]) if x is None]
        bins = [[(i, 0, c["length"][i]) for i in b] for b in ([parts[k] for k in b] for b in first_fit_decreasing([c["length"][i] for i in parts], sequence_length))]
        rows, base = [], c["grp"][0] << 32
        for bin_ in fill(bins, sequence_length):
            at = 0
            for i, start, n in bin_:
                own = np.frombuffer(ids[i].as_py(), kind)[start : start + n]
                rows.append((c["doc_id"][i], c["start"][i] + start, n, crc(own), c["doc_tokens"][i], base, at))
                at += n
            base += 1
        for i, x in enumerate(c["ids_crc32"]):
            if x is not None:
                rows.append((c["doc_id"][i], c["start"][i], c["length"][i], x, c["doc_tokens"][i], base, 0))
                base += 1
        return pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    row = F.monotonically_increasing_id()
    dealt = id_and_text(docs).withColumn("row", row).withColumn("grp", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)))
    return dealt.mapInArrow(encode, "grp long, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary").groupBy("grp").applyInArrow(group, ROWS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return pack(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"), end_id=1)
