"""Subspaces of all blocks but one, made where they are looked at."""

import tracemalloc

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from twinfold.operators import fits
from twinfold.operators.fits import numbered
from twinfold.probe_queries import rowspace_without_block
from twinfold.queries import SQL


@pytest.mark.parametrize("blocks,most_mb", [(3, 20), (400, 20)])
def test_no_basis_comes_to_the_driver(spark, tmp_path, blocks, most_mb):
    """400 bases of 64 x 64 numbers would be 13 MB, and what they are made from twice as much. With 3 blocks the spaces have fewer dimensions than the vectors."""
    x = np.random.default_rng(1).normal(size=(blocks * 32, 64))
    rows = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    # one difference is null: the rows of a pair are equal
    rows = rows.withColumn("embedding", F.when(F.col("vec_id") == 3, F.array(*[F.lit(float(np.float32(v))) for v in x[2]]).cast("array<float>")).otherwise(F.col("embedding")))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    tracemalloc.start()
    try:
        got = rowspace_without_block(spark, str(tmp_path)).collect()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == blocks and peak < most_mb * 1e6
    assert all(r.orthonormal and r.rank == min(64, r.differences - (r.control_block_id != 0)) for r in got)
    assert all(r.without_residual == r.differences - (r.control_block_id != 0) for r in got)


def test_many_numbers(spark):
    df = spark.createDataFrame([(None if k == 5 else 2**60 + k % 700,) for k in range(1400)], "unit long").repartition(3)
    values, at = numbered(df, "unit")
    got = {r.unit: r.n for r in df.select("unit", at.alias("n")).collect()}
    assert len(values) > fits.MANY and got == {None: -1} | {v: i for i, v in enumerate(values)}


def test_same_as_sql_with_more_blocks(spark):
    assert same(rowspace_without_block(spark, "/root/testdata/sf0.1"), SQL["rowspace_without_block"], "/root/testdata/sf0.1") == ""
