"""Linear probes: many regularised logistic fits in the same passes over a table.

A fit is a row of the table's membership array, so one pass over the vectors gives loss and gradient of all fits that
haven't converged; only parameters and sums, as large as the models, travel."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


FAN_IN = 16
#: Numbers in the vectors of a task of a pass, below which tasks are put together.
TASK_NUMBERS = 4_000_000


@dataclass
class Fit:
    """Scores are (x - mean) / sd * weight + intercept."""

    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray
    intercept: float
    converged: bool = True
    passes: int = 0

    @property
    def direction(self) -> tuple[np.ndarray, float]:
        w = self.weight / self.sd
        return w, self.intercept - float(w @ self.mean)


@dataclass
class Recipe:
    """Weights of the control loss and of the mean squared score change under a cue swap."""

    control_mass: float = 0.0
    cue_penalty: float = 0.0
    continuation: tuple[float, ...] = field(default_factory=tuple)


def minimise(start: np.ndarray, tolerance: float, most: int, memory: int = 12) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, bool, int]]:
    """Limited-memory quasi-Newton steps. Gives the points at which it wants value and gradient; so many fits can share a pass."""
    x, calls = start, 1
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while calls < most:
        if np.abs(g).max() <= tolerance:
            return x, True, calls
        d, rates = -g, []
        for s, y in reversed(steps):
            rates.append(float(s @ d) / float(s @ y))
            d = d - rates[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (float(s @ y) / float(y @ y))
        for (s, y), rate in zip(steps, reversed(rates), strict=True):
            d = d + (rate - float(y @ d) / float(s @ y)) * s
        slope = float(g @ d)
        if slope >= 0:
            d, slope, steps = -g, -float(g @ g), []
        size = 1.0 if steps else min(1.0, 1.0 / float(np.abs(g).sum()))
        while True:
            new = x + size * d
            f_new, g_new = yield new
            calls += 1
            # near the end values differ by less than they are rounded
            if f_new <= f + 1e-4 * size * slope + 4 * np.finfo(float).eps * abs(f) or calls >= most:
                break
            size /= 2
            if size < 1e-14:
                return x, bool(np.abs(g).max() <= 100 * tolerance), calls
        s, y = new - x, g_new - g
        if float(s @ y) > 1e-14 * float(y @ y):
            steps = [*steps, (s, y)][-memory:]
        x, f, g = new, f_new, g_new
    return x, bool(np.abs(g).max() <= tolerance), calls


def in_few_tasks(rows: DataFrame, numbers: float) -> DataFrame:
    """rows with about TASK_NUMBERS numbers a task, if they lie in more tasks than that: a pass over a small table is one task."""
    tasks = max(1, int(-(-numbers // TASK_NUMBERS)))
    return rows.coalesce(tasks) if tasks < rows.rdd.getNumPartitions() else rows


def _sums(df: DataFrame, run, k: int, width: int) -> np.ndarray:
    """Summed vectors of run's output by fit. Each task gives one row for each fit; FAN_IN tasks' rows meet in a task of
    the next round, so none holds those of all, and one row a fit comes to the driver, in one job."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fit, v in zip(pdf.fit, pdf.v, strict=True):
                total[fit] = total[fit] + v if fit in total else np.array(v)
        yield pd.DataFrame({"fit": list(total), "v": list(total.values())})

    parts, tasks = df.mapInPandas(run, "fit int, v array<double>"), df.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInPandas(add, "fit int, v array<double>")
    out = np.zeros((k, width))
    for r in parts.collect():
        out[r.fit] += np.array(r.v)
    return out


def _members(pdf: pd.DataFrame, k: int) -> np.ndarray:
    out = np.zeros((len(pdf), k), bool)
    for i, x in enumerate(pdf["fits"]):
        out[i, np.asarray(x, int)] = True
    return out


def fit_many(rows: DataFrame, k: int, c: list[float], recipe: Recipe = Recipe(), zero_sd: str = "one", tolerance: float = 1e-6, most_passes: int = 400) -> list[Fit]:
    """k fits at inverse strengths c. rows: features, y, fits (array of the numbers of the fits that a row trains), and
    role: ``fit``, ``control`` or ``difference`` (of two standardised vectors; y is not used). zero_sd: ``one`` divides
    constant dimensions by 1, ``add`` adds 1e-6 to all, ``raw`` takes vectors as they are. A fit whose rows have one class only is an error. Cache rows: each
    pass reads them once."""
    width = len(rows.select("features").first()[0])

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((k, 2 * width + 2))
        for pdf in batches:
            x, m = np.stack(pdf["features"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width)), _members(pdf, k).astype(float)
            out[:, :width] += m.T @ x
            out[:, width : 2 * width] += m.T @ (x * x)
            out[:, -2] += m.sum(0)
            out[:, -1] += m.T @ pdf["y"].to_numpy(float)
        yield pd.DataFrame({"fit": range(k), "v": list(out)})

    own = _sums(rows.where("role = 'fit'").select("features", "y", "fits"), stats, k, 2 * width + 2)
    n, ones = own[:, -2], own[:, -1]
    if ((ones == 0) | (ones == n)).any():
        raise ValueError(f"fits {np.flatnonzero((ones == 0) | (ones == n)).tolist()} have rows of one class only")
    mean = own[:, :width] / n[:, None]
    sd = np.sqrt(np.maximum(own[:, width : 2 * width] / n[:, None] - mean**2, 0))
    sd = np.where(sd < 1e-12, 1.0, sd) if zero_sd == "one" else sd + 1e-6
    if zero_sd == "raw":
        mean, sd = np.zeros_like(mean), np.ones_like(sd)

    counts = {r.role: r.n for r in rows.groupBy("role").agg(F.count("*").alias("n")).collect()}
    rows = in_few_tasks(rows, sum(counts.values()) * width)
    strength = 1 / (np.array(c, float) * n)
    theta, passes, good = np.zeros((k, width + 1)), np.zeros(k, int), np.ones(k, bool)
    for penalty in [*recipe.continuation, recipe.cue_penalty]:
        running = {i: minimise(theta[i], tolerance, most_passes) for i in range(k)}
        asked = {i: next(r) for i, r in running.items()}
        while asked:
            now, at = np.array([asked.get(i, theta[i]) for i in range(k)]), sorted(asked)

            def gradients(batches: Iterator[pd.DataFrame], now=now, at=at, penalty=penalty) -> Iterator[pd.DataFrame]:
                out = np.zeros((k, width + 2))
                for pdf in batches:
                    if not len(pdf):
                        continue
                    x, m, y, role = np.stack(pdf["features"].to_numpy()).astype(float), _members(pdf, k), pdf["y"].to_numpy(float), pdf["role"].to_numpy()
                    for i in at:
                        w, b = now[i, :-1], now[i, -1]
                        for kind, mass, total in (("fit", 1.0, n[i]), ("control", recipe.control_mass, counts.get("control", 0)), ("difference", penalty, counts.get("difference", 0))):
                            own = (role == kind) & (m[:, i] if kind == "fit" else True)
                            if not mass or not own.any():
                                continue
                            if kind == "difference":
                                z = (xs := x[own] / sd[i]) @ w
                                value, pull, free = (z * z).sum(), 2 * (xs.T @ z), 0.0
                            else:
                                z = (xs := (x[own] - mean[i]) / sd[i]) @ w + b
                                miss = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z)))) - y[own]
                                value, pull, free = (np.logaddexp(0, z) - y[own] * z).sum(), xs.T @ miss, miss.sum()
                            out[i, 0] += mass / total * value
                            out[i, 1:-1] += mass / total * pull
                            out[i, -1] += mass / total * free
                yield pd.DataFrame({"fit": at, "v": [out[i] for i in at]})

            got = _sums(rows.select("features", "y", "fits", "role"), gradients, k, width + 2)
            for i in at:
                w = asked[i][:-1]
                value, slope = got[i, 0] + 0.5 * strength[i] * float(w @ w), got[i, 1:].copy()
                slope[:-1] += strength[i] * w
                try:
                    asked[i] = running[i].send((value, slope))
                except StopIteration as end:
                    theta[i], ok, calls = end.value
                    good[i], passes[i] = good[i] and ok, passes[i] + calls
                    del asked[i]
    return [Fit(mean[i], sd[i], theta[i, :-1], float(theta[i, -1]), bool(good[i]), int(passes[i])) for i in range(k)]


def score(df: DataFrame, fits: list[Fit], which: Column | str = "fit", features: str = "features", tie: str = ">=") -> DataFrame:
    """df with score and pred by the fit of number ``which``; tie says whether a score of 0 is predicted as 1."""
    lines = [f.direction for f in fits]

    @F.pandas_udf("double")
    def line(x: pd.Series, i: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy()).astype(float)
        w, b = np.stack([lines[k][0] for k in i]), np.array([lines[k][1] for k in i])
        return pd.Series((m * w).sum(1) + b)

    which = F.col(which) if isinstance(which, str) else which
    out = df.withColumn("score", line(F.col(features), which))
    return out.withColumn("pred", ((F.col("score") >= 0) if tie == ">=" else (F.col("score") > 0)).cast("int"))


def regime_rows(items: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Training and test rows of each regime, as conditions on purpose and format."""
    e, b, every = F.col("purpose") == "evaluation", F.col("format") == "benchmark", F.lit(True)
    return {"standard_confounded": ((e & b) | (~e & ~b), every), "decorrelated": (every, every), "benchmark_to_casual": (b, ~b), "casual_to_benchmark": (~b, b)}


def out_of_fold(items: DataFrame, selectors: dict[str, tuple[Column, Column]], c: float = 0.1, family: str = "family", y: str = "y") -> DataFrame:
    """regime, the columns of items, score and pred, from fits that haven't seen the row's family. All regimes and folds
    are fitted in the same passes. A fold of one class is an error."""
    families = sorted(r[0] for r in items.select(family).distinct().collect())
    names = list(selectors)
    at = F.create_map(*[F.lit(x) for i, f in enumerate(families) for x in (f, i)])[F.col(family)]
    nf = len(families)
    others = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(nf - 1)), lambda j: j != F.col("_at")), lambda j: j + k * nf)
    trains = F.flatten(F.array(*[F.when(selectors[r][0], others(k)).otherwise(F.array().cast("array<int>")) for k, r in enumerate(names)]))
    rows = items.withColumn("_at", at)
    table = rows.select("features", F.col(y).cast("double").alias("y"), trains.alias("fits"), F.lit("fit").alias("role")).cache()
    try:
        fits = fit_many(table, nf * len(names), [c] * (nf * len(names)))
    finally:
        table.unpersist()
    tests = F.array_compact(F.array(*[F.when(selectors[r][1], F.struct(F.lit(r).alias("regime"), (F.col("_at") + k * nf).alias("fit"))) for k, r in enumerate(names)]))
    long = rows.withColumn("_test", F.explode(tests)).select("_test.regime", "_test.fit", *items.columns)
    return score(long, fits).drop("fit")


def standardise_by(train: DataFrame, df: DataFrame, key: str, features: str = "features", extra: float = 1e-6) -> DataFrame:
    """df with features standardised by the training statistics of its group (population deviation plus extra); groups
    with fewer than two training rows stay as they are. Column arithmetic on arrays; the statistics are one row a group."""
    from .linalg import mean_and_variance, vector_sums

    mean, variance = mean_and_variance()
    stats = vector_sums(train, [key], features).where("n > 1").select(key, mean.alias("_m"), F.transform(variance, lambda v: F.sqrt(v) + extra).alias("_s"))
    moved = F.zip_with(F.zip_with(features, "_m", lambda x, m: x.cast("double") - m), "_s", lambda x, s: x / s)
    return df.join(stats, key, "left").withColumn(features, F.when(F.col("_m").isNull(), F.transform(features, lambda x: x.cast("double"))).otherwise(moved)).drop("_m", "_s")


def pick_c(items: DataFrame, grid: tuple[float, ...] = (0.005, 0.02, 0.05, 0.2, 0.5), family: str = "family", key: str | None = None) -> DataFrame:
    """outer, c, mean_accuracy, best: for each held-out family the mean balanced accuracy over the other families, held out
    in turn; the first of the best strengths wins. All fits of all outer folds and strengths share their passes."""
    families = sorted(r[0] for r in items.select(family).distinct().collect())
    cells = [(o, i, c) for o in families for i in families if i != o for c in grid]
    rows = items.withColumn("features", F.transform("features", lambda x: x.cast("double")))
    fits_of = {f: [k for k, (o, i, _) in enumerate(cells) if f not in (o, i)] for f in families}
    spark = items.sparkSession
    dim = spark.createDataFrame([(f, fits_of[f], [k for k, (_, i, _) in enumerate(cells) if i == f]) for f in families], f"{family} {dict(items.dtypes)[family]}, fits array<int>, tests array<int>")
    table = rows.join(F.broadcast(dim), family).select("features", F.col("y").cast("double").alias("y"), "fits", F.lit("fit").alias("role"), "tests").cache()
    fits = fit_many(table.drop("tests"), len(cells), [c for _, _, c in cells], zero_sd="add")
    names = spark.createDataFrame([(k, o, i, c) for k, (o, i, c) in enumerate(cells)], f"fit int, outer {dict(items.dtypes)[family]}, inner {dict(items.dtypes)[family]}, c double")
    scored = score(table.select("features", "y", F.explode("tests").alias("fit")), fits, tie=">")
    # a few rows a cell, held here so that the cached vectors can go
    each = scored.join(names, "fit").groupBy("outer", "c", "inner").agg(metrics.balanced_accuracy().alias("a"))
    each = spark.createDataFrame(each.collect(), each.schema)
    table.unpersist()
    agg = each.groupBy("outer", "c").agg(F.avg("a").alias("mean_accuracy"))
    best = agg.groupBy("outer").agg(F.max_by("c", F.struct("mean_accuracy", -F.col("c"))).alias("_best"))
    return agg.join(best, "outer").select("outer", "c", "mean_accuracy", (F.col("c") == F.col("_best")).alias("best"))


def transfer(items: DataFrame, by: str, c: float = 0.1, family: str = "family") -> DataFrame:
    """fit_on, test_on, balanced_accuracy: a fit on each value of ``by`` (families held out), tested on all values."""
    values = sorted(r[0] for r in items.select(by).distinct().collect())
    scored = out_of_fold(items, {str(v): (F.col(by) == v, F.lit(True)) for v in values}, c, family)
    return scored.groupBy(F.col("regime").alias("fit_on"), F.col(by).alias("test_on")).agg(metrics.balanced_accuracy().alias("balanced_accuracy"))


def direction_cosines(items: DataFrame, masks: dict[str, Column], c: float = 0.1) -> DataFrame:
    """left, right, cosine of the directions fitted on each stratum (a few directions, on the driver)."""
    names = list(masks)
    fits_of = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(masks.values())]))
    table = items.select("features", F.col("y").cast("double").alias("y"), fits_of.alias("fits"), F.lit("fit").alias("role")).cache()
    w = [f.weight / np.linalg.norm(f.weight) for f in fit_many(table, len(names), [c] * len(names), zero_sd="add")]
    table.unpersist()
    return items.sparkSession.createDataFrame([(a, b, float(w[i] @ w[j])) for i, a in enumerate(names) for j, b in enumerate(names)], "left string, right string, cosine double")


def pool_tokens(tokens: DataFrame, how: str, span_end: str | None = None) -> DataFrame:
    """One vector an item from (item_id, pos, char_end, features): the last token, the mean, or the last token that lies
    wholly before the end of a span (the last one if there is none)."""
    if how == "mean":
        from .linalg import mean_vectors

        return mean_vectors(tokens, ["item_id"]).withColumnRenamed("mean", "features")
    last = F.max_by("features", "pos")
    if how == "last":
        return tokens.groupBy("item_id").agg(last.alias("features"))
    inside = (F.col("char_end") > 0) & (F.col("char_end") <= F.col(span_end))
    return tokens.groupBy("item_id").agg(F.coalesce(F.max_by(F.when(inside, F.col("features")), F.when(inside, F.col("pos"))), last).alias("features"))
