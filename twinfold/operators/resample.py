"""Whole-cluster bootstrap by split multinomials, random-direction and orientation nulls.

How often each of n clusters is drawn in n draws is split down a tree: of the m draws that fall on a range of cluster ranks, a binomial
number falls on its left half, down to single clusters. Each number comes from a hash of seed, replicate and range alone, so a
task finds the weights of the clusters it holds by the ranges above them, and no draw, weight or copy of a row is made elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

#: Draws up to which a binomial is counted one by one; beyond, it is rounded from a normal one. Rows that a task weighs at a time.
COUNTED, WEIGHED_ROWS = 32, 1024
_WORD = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers: shifts by 16, 15 and 16, products with 0x7FEB352D and 0x846CA68B."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & _WORD
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & _WORD
    return x ^ (x >> np.uint64(16))


def binomial(m: np.ndarray, share: float, key: np.ndarray) -> np.ndarray:
    """For each of m a number of draws of it, each of which hits with the probability share, from a hash of its key."""
    u = lambda j: mix((key + np.uint64((j + 1) * 0x9E3779B9 % (1 << 32))) & _WORD).astype(float)
    out = np.zeros(len(m), np.int64)
    for j in range(min(COUNTED, int(m.max(initial=0)))):
        out += (m > j) & (m <= COUNTED) & (u(j) < share * 2.0**32)
    if (m > COUNTED).any():
        z = np.sqrt(-2 * np.log((u(0) + 0.5) / 2.0**32)) * np.cos(2 * np.pi * (u(1) + 0.5) / 2.0**32)
        near = np.floor(m * share + z * np.sqrt(m * share * (1 - share)) + 0.5).astype(np.int64)
        out = np.where(m > COUNTED, np.clip(near, 0, m), out)
    return out


def cluster_weights(ranks: np.ndarray, n: int, samples: int, seed: int) -> np.ndarray:
    """Row i: how often the cluster of rank ranks[i] (ascending, different) of n is drawn in each replicate."""
    out = np.zeros((len(ranks), samples), np.int64)
    rep = mix((np.uint64(seed * 0x9E3779B1 % (1 << 32)) + np.arange(samples, dtype=np.uint64)) & _WORD)
    fold = lambda x: np.uint64((x ^ x >> 32) & 0xFFFFFFFF)
    stack = [(0, n, np.full(samples, n, np.int64), 0, len(ranks))]
    while stack:
        low, high, m, a, b = stack.pop()
        if a == b:
            continue
        if high - low == 1:
            out[a] = m
            continue
        middle = (low + high) // 2
        left = binomial(m, (middle - low) / (high - low), mix(mix(rep ^ fold(low)) ^ fold(high)))
        cut = a + int(np.searchsorted(ranks[a:b], middle))
        stack += [(low, middle, left, a, cut), (middle, high, m - left, cut, b)]
    return out


def ranked_clusters(df: DataFrame, cluster: str) -> tuple[DataFrame, int]:
    """cluster and _rank of each different cluster (not null), and their number."""
    from ..plans.grids import global_rank

    ranked = global_rank(df.select(cluster).where(F.col(cluster).isNotNull()).distinct(), cluster, "_rank")
    return ranked, ranked.count()


def cluster_interval(df: DataFrame, cluster: str, sums: dict[str, Column], metric: Column, samples: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """by, low, high: the 2.5 and 97.5 percentiles of a metric of weighted sums over ``samples`` resamples of as many clusters as there
    are (rows of a null cluster are left out). sums: names and what a row adds to each; metric: an expression of the names. Rows are
    added up by cluster first; a task gives one row of sums a replicate, whatever it holds."""
    by, names = by or [], list(sums)
    ranked, n = ranked_clusters(df, cluster)
    own = df.groupBy(cluster, *by).agg(*[F.sum(c).cast("double").alias(name) for name, c in sums.items()])
    rows = own.join(ranked, cluster).select("_rank", *by, F.array(*[F.coalesce(name, F.lit(0.0)) for name in names]).alias("_s"))
    keys = [f for f in rows.schema.fields if f.name in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for start in range(0, len(pdf), WEIGHED_ROWS):
                part = pdf.iloc[start : start + WEIGHED_ROWS]
                ranks, at = np.unique(part["_rank"].to_numpy(), return_inverse=True)
                w = cluster_weights(ranks, n, samples, seed)
                for key, i in part.assign(_i=np.arange(len(part))).groupby(by, dropna=False)["_i"] if by else [((), pd.Series(np.arange(len(part))))]:
                    v = w[at[i.to_numpy()]].T @ np.stack(part["_s"].iloc[i.to_numpy()].to_numpy())
                    held[key] = held[key] + v if key in held else v
        for key, v in held.items():
            yield pd.DataFrame({"rep": np.arange(samples), **{k: [x] * samples for k, x in zip(by, key, strict=True)}, **{name: v[:, j] for j, name in enumerate(names)}})

    schema = ", ".join(["rep int", *[f"`{f.name}` {f.dataType.simpleString()}" for f in keys], *[f"`{x}` double" for x in names]])
    values = rows.mapInPandas(run, schema).groupBy("rep", *by).agg(*[F.sum(x).alias(x) for x in names]).select(*by, metric.alias("value")).where("value is not null")
    return values.groupBy(*by).agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))


def cluster_recall_interval(df: DataFrame, cluster: str, samples: int, seed: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """low, high of the balanced accuracy."""
    hit = F.col(y) == F.col(pred)
    sums = {f"_n{k}": (F.col(y) == k).cast("double") for k in (0, 1)} | {f"_h{k}": ((F.col(y) == k) & hit).cast("double") for k in (0, 1)}
    a, b = (F.try_divide(F.col(f"_h{k}"), F.col(f"_n{k}")) for k in (0, 1))
    return cluster_interval(df, cluster, sums, F.coalesce((a + b) / 2, a, b), samples, seed)


def cluster_auc_interval(df: DataFrame, cluster: str, samples: int, seed: int) -> DataFrame:
    """low, high of the AUC. Rows lie in ranges of scores; a task weighs its rows in order, for all replicates at once, and gives each
    replicate's wins, positives and negatives of its range. Ranges then meet in order, so no row is copied for a replicate."""
    ranked, n = ranked_clusters(df, cluster)
    # rows of equal cluster, score and class count as one
    same = df.where("score is not null").groupBy(cluster, "score", "y").agg(F.count("*").alias("_same"))
    rows = same.join(ranked, cluster).select("_rank", F.col("score").cast("double").alias("score"), F.col("y").cast("int").alias("y"), "_same")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wins, pos, neg, low = np.zeros(samples), np.zeros(samples), np.zeros(samples), None
        score, own_pos, own_neg = None, np.zeros(samples), np.zeros(samples)  # of the last score, which may go on

        def close():
            nonlocal wins, pos, neg
            wins, pos, neg = wins + own_pos * (neg + own_neg / 2), pos + own_pos, neg + own_neg

        for pdf in batches:
            for start in range(0, len(pdf), WEIGHED_ROWS):
                part = pdf.iloc[start : start + WEIGHED_ROWS]
                low = part["score"].iloc[0] if low is None else low
                ranks, at = np.unique(part["_rank"].to_numpy(), return_inverse=True)
                w = cluster_weights(ranks, n, samples, seed)[at] * part["_same"].to_numpy()[:, None]
                s, one = part["score"].to_numpy(), part["y"].to_numpy() == 1
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                p, q = (np.add.reduceat(w * side[:, None], first, axis=0).astype(float) for side in (one, ~one))
                if score is not None and s[0] == score:
                    p[0], q[0] = p[0] + own_pos, q[0] + own_neg
                elif score is not None:
                    close()
                below = neg + np.cumsum(q, axis=0) - q
                wins, pos, neg = wins + (p[:-1] * (below[:-1] + q[:-1] / 2)).sum(0), pos + p[:-1].sum(0), neg + q[:-1].sum(0)
                score, own_pos, own_neg = s[-1], p[-1], q[-1]
        if low is not None:
            close()
            yield pd.DataFrame({"low": low, "rep": np.arange(samples), "wins": wins, "p": pos, "n": neg})

    ranges = rows.repartitionByRange("score").sortWithinPartitions("score").mapInPandas(run, "low double, rep int, wins double, p double, n double")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("rep").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = ranges.withColumn("_below", below).groupBy("rep").agg(F.try_divide(F.sum(F.col("wins") + F.col("p") * F.col("_below")), F.sum("p") * F.sum("n")).alias("auc"))
    return each.where("auc is not null").agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def mean_interval(df: DataFrame, value: str, ident: str, samples: int, seed: int) -> DataFrame:
    """low, high of the mean of the rows, drawn by ident."""
    return cluster_interval(df, ident, {"_v": F.col(value), "_n": F.lit(1)}, F.try_divide(F.col("_v"), F.col("_n")), samples, seed)


def metric_record(point: DataFrame, interval: DataFrame, name: str, threshold: float | None = None) -> DataFrame:
    """metric, value, low, high, threshold, passed of one-row tables (value) and (low, high)."""
    out = point.crossJoin(interval).select(F.lit(name).alias("metric"), "value", "low", "high", F.lit(threshold).cast("double").alias("threshold"))
    return out.withColumn("passed", F.col("value") >= F.col("threshold"))


def random_direction_null(twins: DataFrame, k: int, seed: int, first: str = "evaluation", second: str = "deployment") -> DataFrame:
    """mean, sd, p95, most of the share of twins (two vectors) that k random directions put in order. Directions are drawn
    from the seed in each task, so only it travels."""
    width = len(twins.select(first).first()[0])

    def run(batches):
        directions = np.random.default_rng(seed).normal(size=(width, k))
        wins, n = np.zeros(k), 0
        for pdf in batches:
            if len(pdf):
                wins += ((np.stack(pdf[first].to_numpy()) - np.stack(pdf[second].to_numpy())).astype(float) @ directions > 0).sum(0)
                n += len(pdf)
        yield pd.DataFrame({"direction": range(k), "wins": wins, "n": n})

    share = twins.select(first, second).mapInPandas(run, "direction int, wins double, n long").groupBy("direction").agg((F.sum("wins") / F.sum("n")).alias("share"))
    return share.agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"), F.percentile("share", 0.95).alias("p95"), F.max("share").alias("most"))


def orientation_labels(items: DataFrame, block: str, rep: int, y: str = "y") -> Column:
    """Labels of a replicate in which each block's classes are swapped or not, by a coin from SHA-256."""
    coin = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(rep)), F.col(block).cast("string")), 256), 1, 2), 16, 10).cast("int") % 2
    return F.when(coin == 1, 1 - F.col(y)).otherwise(F.col(y))


def orientation_null(items: DataFrame, block: str, reps: int, c: float = 0.1, family: str = "family") -> DataFrame:
    """rep, paired_accuracy of probes that are fitted on swapped labels, against the true ones. The folds of all replicates
    are fitted in the same passes: each row is there once for each label that some replicate gives it."""
    from .matching import twins
    from .probe import fit_many, score

    families = sorted(r[0] for r in items.select(family).distinct().collect())
    nf = len(families)
    rows = items.withColumn("_at", F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, i)])[F.col(family)])

    def trains(label: int) -> Column:
        others = lambda rep: F.transform(F.filter(F.sequence(F.lit(0), F.lit(nf - 1)), lambda j: j != F.col("_at")), lambda j: j + rep * nf)
        return F.flatten(F.array(*[F.when(orientation_labels(items, block, rep) == label, others(rep)).otherwise(F.array().cast("array<int>")) for rep in range(reps)]))

    zero, one = (rows.select("features", F.lit(float(y)).alias("y"), trains(y).alias("fits"), F.lit("fit").alias("role")).where("size(fits) > 0") for y in (0, 1))
    table = zero.unionByName(one).cache()
    try:
        fits = fit_many(table, nf * reps, [c] * (nf * reps))
    finally:
        table.unpersist()
    long = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    scored = score(long.withColumn("_fit", F.col("_at") + F.col("rep") * nf), fits, "_fit").drop("_at", "_fit")
    return twins(scored, ["rep", block, "format"]).groupBy("rep").agg(F.avg((F.col("delta") > 0).cast("double")).alias("paired_accuracy"))
