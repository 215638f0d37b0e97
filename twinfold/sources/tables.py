"""Reading and writing tables: JSON lines, one-object files, catalogs, vectors, reports and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import canonical_json


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str = "fail") -> DataFrame:
    """Rows of a file of JSON objects; blank lines are skipped. bad: ``fail`` raises when a line that isn't an object is
    read, ``keep`` gives such lines in the column ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if bad == "keep":
        return rows
    check = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("_corrupt_record", 1, 200))))
    first = schema.fields[0]
    return rows.withColumn(first.name, F.coalesce(check.cast(first.dataType), F.col(first.name))).select(schema.names)


def read_json_dir(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One row for each file of one object, with the file's name (without ending) as ``file_id``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.withColumn("file_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def write_json_dir(rows: DataFrame, name: str, path: str) -> None:
    """One file of one JSON object for each row, named by a column (different, of letters, digits, ``_`` and ``-``), which isn't in
    the object; written by the tasks, whole or not at all."""
    columns = [c for c in rows.columns if c != name]

    def write(batches: Iterator) -> Iterator:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = f"{root}/_{own}-{uuid.uuid4().hex}"
                with store.open_output_stream(held) as to:
                    to.write(text.encode())
                store.move(held, f"{root}/{own}.json")
            yield batch.slice(0, 0)

    texts = rows.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("text"))
    texts.mapInArrow(write, "name string, text string").count()


def load_catalog(spark: SparkSession, rows: list[dict], schema: str, key: str, **complete: tuple[str, set]) -> DataFrame:
    """A small dimension table. Errors: a repeated key; a column given in ``complete`` as name=(column, values) whose
    values aren't exactly those."""
    seen: set = set()
    for row in rows:
        if row[key] in seen:
            raise ValueError(f"{key} {row[key]} is repeated")
        seen.add(row[key])
    for column, values in complete.values():
        if (found := {row[column] for row in rows}) != values:
            raise ValueError(f"{column}: missing {sorted(values - found)}, unknown {sorted(found - values)}")
    return spark.createDataFrame([tuple(row[f.name] for f in T._parse_datatype_string(schema).fields) for row in rows], schema)


def read_activations(spark: SparkSession, path: str, layers: list[int] | None = None, rows: int = 10_000) -> DataFrame:
    """item_id, layer, features from array archives, in parts of so many items; see activations.ActivationArchives. Write the result as
    Parquet, partitioned by layer, once."""
    from .activations import ActivationArchives

    spark.dataSource.register(ActivationArchives)
    reader = spark.read.format(ActivationArchives.name()).option("rows", rows)
    return (reader if layers is None else reader.option("layers", ",".join(map(str, layers)))).load(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order of their names, nulls included."""
    df.select(sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON object a run from the long table (run, slice_kind, slice_key, metric, value)."""
    key = F.concat_ws("::", "slice_kind", "slice_key", "metric")
    metrics.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "value")))).alias("metrics")).write.json(path)


def manifest(**tables: DataFrame) -> DataFrame:
    """artifact, rows, digest of each table. Equal rows are counted first; their hashes (hexadecimal, with ``:`` and the
    count) are sorted and hashed by their first six digits, these digests by three, and those in one: 4096 times fewer
    each time, so a group stays small with 10^11 rows, and with any number of copies of one row."""

    def one(name: str, df: DataFrame) -> DataFrame:
        level = df.groupBy(F.sha2(canonical_json(*df.columns), 256).alias("h")).agg(F.count("*").alias("n"))
        level = level.select(F.col("h").alias("key"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("d"), "n")
        digest = F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256)
        for digits in (6, 3):
            level = level.groupBy(F.substring("key", 1, digits).alias("key")).agg(digest.alias("d"), F.sum("n").alias("n"))
        return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), digest.alias("digest")).select(F.lit(name).alias("artifact"), "rows", "digest")

    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


def verify_manifest(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """artifact, problem (missing, extra or changed) of each artifact whose digest isn't the stored one."""
    both = observed.select("artifact", F.col("digest").alias("own")).join(stored.select("artifact", F.col("digest").alias("expected")), "artifact", "full_outer")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("own") != F.col("expected"), "changed")
    return both.select("artifact", problem.alias("problem")).where("problem is not null")


def publish_dataset(path: str, **tables: DataFrame) -> DataFrame:
    """Writes each table as Parquet below path, and last, as the mark of completion, the manifest of what was written."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    done = manifest(**{name: spark.read.parquet(f"{path}/{name}") for name in tables})
    done.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")
