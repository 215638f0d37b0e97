"""Operator 3: token ids in Arrow files of equal-length sequences and masks.

Each partition of the documents, in ascending doc_id order (as many as there are shuffle partitions, and more from FILE_BYTES each on), becomes two files in Arrow's file format:
``*.ids.arrow`` with the columns ids (fixed-size list of 16- or 32-bit numbers) and mask (fixed-size list of
booleans, false in the padding of the last sequence), SEQUENCES rows to a batch, and ``*.docs.arrow`` with
doc_id, start (in this file's ids) and n_tokens. Buffers aren't compressed, so a mapped file gives any
sequence without a copy. A file's name holds a fresh random part; only files that finished tasks report are in
the list of files, so lost or repeated tasks leave no trace in it."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library_ids import id_type, ids_of
from .pieces import closed
from .shared import documents, id_and_text, partitions, shared_folder, slices, written

SEQUENCES = 64
#: Bytes of text a file, beyond which there are more files than shuffle partitions.
FILE_BYTES = 256_000_000
FILES = "part int, path string, n_docs long, n_tokens long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, sequence_length: int = 2048) -> DataFrame:
    """The list of files: part (their order), path (without its ending), n_docs, n_tokens. Documents lie in
    ascending doc_id order (null first; equal ids by text) over all files. Null and empty texts have the end id
    only. Empty partitions write no file, so an empty table gives an empty list. Other columns are left out."""
    spark, data = docs.sparkSession, Path(tokenizer_path).read_bytes()
    kind = id_type(data)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = next(found := slices(batches), None)
        if part is None or not part.num_rows:
            return
        store, root = _store(folder)
        store.create_dir(root)
        name, number = uuid.uuid4().hex, TaskContext.get().partitionId()
        row = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence_length)), ("mask", pa.list_(pa.bool_(), sequence_length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        rest, total, n_docs = np.empty(0, kind), 0, 0
        with store.open_output_stream(f"{root}/{name}.ids.arrow") as to, pa.ipc.new_file(to, row) as ids_file, store.open_output_stream(f"{root}/{name}.docs.arrow") as too, pa.ipc.new_file(too, index) as docs_file:

            def put(ids: np.ndarray, real: int) -> None:
                mask = np.arange(len(ids)) < real
                ids_file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), sequence_length), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence_length)], schema=row))

            while part is not None:
                ids, ends = closed(*ids_of(data)(part.column("text")).joined(kind), end_id)
                rest = np.concatenate([rest, ids])
                docs_file.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total + ends[:-1]), pa.array(np.diff(ends))], schema=index))
                total, n_docs = total + len(ids), n_docs + part.num_rows
                step = SEQUENCES * sequence_length
                whole = len(rest) - len(rest) % step
                for at in range(0, whole, step):
                    put(rest[at : at + step], step)
                rest = rest[whole:]
                part = next(found, None)
            if len(rest):
                put(np.pad(rest, (0, -len(rest) % sequence_length)), len(rest))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], [x.split()[0] for x in FILES.split(", ")])

    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(write, FILES), "token-file-list")


def read_token_files(files: DataFrame, sequence_length: int = 2048) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the listed files."""
    spark = files.sparkSession
    # one row for each file: one for FILE_BYTES of text
    listed, base = [], 0
    for x in sorted(files.collect(), key=lambda x: x.part):
        listed.append((x.path, base))
        base += x.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, root = _store(path)
                opened = (lambda p: pa.memory_map(p)) if store.type_name == "local" else store.open_input_file
                with opened(f"{root}.ids.arrow") as ids_from, opened(f"{root}.docs.arrow") as docs_from:
                    ids_file, docs_file = pa.ipc.open_file(ids_from), pa.ipc.open_file(docs_from)
                    step, at, own = SEQUENCES * sequence_length, -1, np.empty(0)
                    for k in range(docs_file.num_record_batches):
                        docs = docs_file.get_batch(k)
                        starts, sizes, sums = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy(), []
                        for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                            crc = 0
                            for b in range(start // step, (start + n - 1) // step + 1):
                                if b != at:
                                    at, own = b, ids_file.get_batch(b).column("ids").flatten().to_numpy()
                                crc = zlib.crc32(own[max(0, start - b * step) : start + n - b * step].astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + before), docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = spark.createDataFrame(listed, "path string, base long").repartition(max(1, len(listed)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    files = write_token_files(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.json"), 0, shared_folder(spark, "token-files"))
    return read_token_files(files)
