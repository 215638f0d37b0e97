"""Archives of vectors as a source that reads parts of the stored arrays, so that an archive may be larger than a task's memory."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of vectors that are read at a time; items a written archive holds.
READ_BYTES, ARCHIVE_ITEMS = 16_000_000, 10_000


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of an array in the format of numpy, whose header has been read then."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or dtype.hasobject:
        raise ValueError("arrays must be of numbers or strings and lie row by row")
    return shape, dtype, f.tell()


class _Rows(InputPartition):
    """Items first to last - 1 of an archive."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ActivationReader(DataSourceReader):
    def __init__(self, path: str, rows: int, layers: set[int] | None):
        self.path, self.rows, self.layers = path, rows, layers

    def partitions(self) -> list[InputPartition]:
        """Slices of items of each archive below the path; only the headers are read."""
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path)
        out: list[InputPartition] = []
        for x in files:
            if x.is_file and x.path.endswith(".npz"):
                with store.open_input_file(x.path) as raw, zipfile.ZipFile(raw) as archive:
                    shapes = {k: self._shape(archive, k) for k in ("X", "item_ids")}
                    n = shapes["X"][0]
                    if shapes["item_ids"] != (n,) or "layers.npy" in archive.namelist() and self._shape(archive, "layers") != shapes["X"][1:2]:
                        raise ValueError(f"{x.path}: X has the shape {shapes['X']} for {shapes['item_ids'][0]} items")
                    if len(shapes["X"]) == 3 and "layers.npy" not in archive.namelist():
                        raise ValueError(f"{x.path}: several layers without their numbers")
                out += [_Rows(x.path, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out

    @staticmethod
    def _shape(archive: zipfile.ZipFile, name: str) -> tuple[int, ...]:
        with archive.open(f"{name}.npy") as f:
            return _header(f)[0]

    @staticmethod
    def _part(archive: zipfile.ZipFile, name: str, first: int, last: int) -> np.ndarray:
        with archive.open(f"{name}.npy") as f:
            shape, dtype, start = _header(f)
            each = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            f.seek(start + first * each)
            return np.frombuffer(f.read((last - first) * each), dtype).reshape(last - first, *shape[1:])

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            numbers = self._part(archive, "layers", 0, self._shape(archive, "layers")[0]).tolist() if "layers.npy" in archive.namelist() else [0]
            wanted = [(k, int(n)) for k, n in enumerate(numbers) if self.layers is None or int(n) in self.layers]
            # before X is opened: two open parts of one archive would move each other's place
            every_id = [str(x) for x in self._part(archive, "item_ids", partition.first, partition.last)]
            with archive.open("X.npy") as f:
                shape, dtype, start = _header(f)
                width, per_item = shape[-1], int(np.prod(shape[1:], dtype=np.int64))
                step = max(1, READ_BYTES // max(1, width * len(wanted) * dtype.itemsize))
                for a in range(partition.first, partition.last, step):
                    b = min(partition.last, a + step)
                    ids = every_id[a - partition.first : b - partition.first]
                    out = np.empty((len(wanted), b - a, width), np.float32)
                    for i in range(a, b):  # forwards only; layers that aren't wanted are passed over
                        for j, (k, _) in enumerate(wanted):
                            f.seek(start + (i * per_item + k * width) * dtype.itemsize)
                            out[j, i - a] = np.frombuffer(f.read(width * dtype.itemsize), dtype)
                    for j, (_, layer) in enumerate(wanted):
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * width, pa.int32()), pa.array(out[j].reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([layer] * (b - a), pa.int32()), lists], ["item_id", "layer", "features"])


class ActivationArchives(DataSource):
    """item_id, layer, features from archives with item_ids, X (items, width) or X (items, layers, width) and layers. Options: rows
    (items of a task, 10000 if not given) and layers (numbers with commas between; all if not given). An archive without items gives no
    rows; one whose arrays don't fit together is an error."""

    @classmethod
    def name(cls) -> str:
        return "activation_archives"

    def schema(self) -> str:
        return "item_id string, layer int, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        layers = self.options.get("layers")
        return ActivationReader(self.options["path"], int(self.options.get("rows", 10_000)), None if layers is None else {int(x) for x in layers.split(",")})


def write_archives(rows: DataFrame, folder: str) -> None:
    """Writes item_id and layers (array of vectors of one width) as archives below a folder that all executors reach."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root)
        for pdf in batches:
            for at in range(0, len(pdf), ARCHIVE_ITEMS):
                part = pdf.iloc[at : at + ARCHIVE_ITEMS]
                x = np.array([np.stack(v) for v in part["layers"]], np.float32)
                held = io.BytesIO()
                np.savez(held, X=x, item_ids=np.array(part["item_id"].tolist()), layers=np.arange(x.shape[1]))
                name = f"{root}/{uuid.uuid4().hex}.npz"
                with store.open_output_stream(name) as to:
                    to.write(held.getbuffer())
                yield pd.DataFrame({"path": [name], "items": [len(part)]})

    rows.select("item_id", "layers").mapInPandas(write, "path string, items long").collect()  # one row an archive
