"""Subspaces of vector tables: exact row space by distributed QR, mean axes, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rank_for_variance

#: Coordinates of partial sums that a task holds before it gives them on.
HELD_NUMBERS = 4_000_000


def _triangles(column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_numpy()).astype(float)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({column: list(r)})

    return run


def triangle(df: DataFrame, column: str, fan_in: int = 16) -> np.ndarray:
    """The triangular factor of all vectors as rows: each task leaves one of at most width rows, fan_in of them meet in a
    task of the next round (behind a shuffle, so that the rounds before keep their tasks), and the last one comes to the driver. Singular values and right vectors are those of the
    whole table, without squaring its condition number."""
    step = df.select(column).mapInPandas(_triangles(column), f"{column} array<double>")
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        step = step.repartition(parts).mapInPandas(_triangles(column), f"{column} array<double>")
    rows = [r[0] for r in step.collect()]
    return np.array(rows) if rows else np.zeros((0, 0))


def svd_basis(differences: DataFrame, fraction: float = 0.9, column: str = "difference") -> np.ndarray:
    """Leading right singular vectors (as rows) that hold the fraction of the squared mass; not centred."""
    r = triangle(differences, column)
    if not len(r):
        return r
    _, s, v = np.linalg.svd(r, full_matrices=False)
    return v[: rank_for_variance(s.tolist(), fraction)]


def rowspace_basis(differences: DataFrame, column: str = "difference") -> np.ndarray:
    """All right singular vectors above eps * larger side * largest singular value. No rank is an error."""
    n = differences.count()
    r = triangle(differences, column)
    _, s, v = np.linalg.svd(r, full_matrices=False) if len(r) else (None, np.zeros(0), r)
    rank = int((s > np.finfo(float).eps * max(n, r.shape[1] if len(r) else 0) * (s[0] if len(s) else 0)).sum())
    if not rank:
        raise ValueError("the differences have no numerical rank")
    return v[:rank]


def vector_sums(df: DataFrame, by: list[str], column: str = "features") -> DataFrame:
    """by, n, sums, squares of each group: its vectors (not null), and sums of their coordinates and of the squares of these.
    Each task adds up what it reads, a bounded number of groups at a time, so that a large group leaves it as one row;
    these partial sums then meet by group, of which a task holds one."""
    schema = "_key string, n long, sums array<double>, squares array<double>"

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_key", "n", "sums", "squares"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[column].to_numpy()).astype(float)
            of, keys = pd.factorize(pdf["_key"])
            order, n = np.argsort(of, kind="stable"), np.bincount(of)
            x, first = x[order], np.cumsum(n) - n
            for key, *own in zip(keys, n.tolist(), np.add.reduceat(x, first), np.add.reduceat(x * x, first), strict=True):
                held[key] = tuple(a + b for a, b in zip(held[key], own, strict=True)) if key in held else tuple(own)
            if len(held) * x.shape[1] > HELD_NUMBERS:
                yield frame([(k, *v) for k, v in held.items()])
                held = {}
        yield frame([(k, *v) for k, v in held.items()])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            done = []
            for key, *own in zip(pdf["_key"], pdf["n"], pdf["sums"], pdf["squares"], strict=True):
                if last is not None and last[0] == key:
                    last = (key, *(a + b for a, b in zip(last[1:], own, strict=True)))
                    continue
                if last is not None:
                    done.append(last)
                last = (key, *own)
            if done:
                yield frame(done)
        if last is not None:
            yield frame([last])

    key = F.to_json(F.struct(*by)) if by else F.lit("{}")
    parts = df.where(F.col(column).isNotNull()).select(key.alias("_key"), column).mapInPandas(partial, schema)
    whole = parts.repartition("_key").sortWithinPartitions("_key").mapInPandas(meet, schema)
    if not by:
        return whole.drop("_key")
    return whole.withColumn("_key", F.from_json("_key", df.select(*by).schema)).select("_key.*", "n", "sums", "squares")


def mean_and_variance() -> tuple[Column, Column]:
    """Of rows of vector_sums: the mean vector and the vector of population variances."""
    mean = F.transform("sums", lambda x: x / F.col("n"))
    return mean, F.zip_with("squares", mean, lambda q, m: F.greatest(q / F.col("n") - m * m, F.lit(0.0)))


def mean_vectors(df: DataFrame, by: list[str], column: str = "features") -> DataFrame:
    return vector_sums(df, by, column).select(*by, mean_and_variance()[0].alias("mean"))


def mean_axes(controls: DataFrame, column: str = "features") -> np.ndarray:
    """Orthonormal rows: the mean cue axis of each cue family and language (a few rows come to the driver)."""
    means = mean_vectors(controls, ["cue_family", "language", "lexical_cue"], column)
    side = lambda k: means.where(F.col("lexical_cue") == k).select("cue_family", "language", F.col("mean").alias(k))
    rows = side("evaluation").join(side("deployment"), ["cue_family", "language"]).orderBy("cue_family", "language").collect()
    q, _ = np.linalg.qr(np.array([np.array(r.evaluation) - np.array(r.deployment) for r in rows]).T)
    return q.T


def project_out(df: DataFrame, basis: np.ndarray, column: str = "features") -> DataFrame:
    """df with the part of the column in the span of the basis (orthonormal rows) taken off. The basis is at most as large
    as width x width and travels with the code."""
    if not len(basis):
        return df

    @F.pandas_udf("array<double>")
    def off(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, basis.shape[1]))
        return pd.Series(list(m - (m @ basis.T) @ basis))

    return df.withColumn(column, off(column))
