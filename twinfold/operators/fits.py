"""Batches of linear probes that share passes over one table, however they differ.

A fit is a Spec: a group whose vectors it reads (a layer, a model; each group has a width of its own), the rows it trains on, its
strength, its recipe. Rows carry no lists of fits. They carry the numbers of the selections they lie in and the block that
may be held out, and a fit trains on a selection without its held-out block: what all blocks add up to less the own one. So neither rows
nor plans grow with the number of blocks. Vectors are standardised by the training rows' statistics of their
key (a language) and freed of a subspace; both are linear, so they are folded into the weights before a pass and out of the gradient after
it, and no moved copy of the rows is made.

A pass is one matrix product of the rows of a task with the weights of all fits that go on; what leaves a task has one vector for each
fit and key. Fits that have converged leave the passes. The driver holds about 26 vectors a fit."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rank_for_variance
from .probe import FAN_IN, TASK_NUMBERS, Recipe, in_few_tasks, minimise

ROLES = ("fit", "control", "difference")
#: Numbered units beyond which their numbers are no literals of the plan.
MANY = 256
#: Vectors of more numbers aren't taken by third derivatives, whose numbers are the cube of theirs.
WIDEST = 128


@dataclass
class Spec:
    """One fit at inverse strength c. select: the number of the selection of each role (0 where it isn't named); stats: the
    selection of fit rows whose statistics standardise (that of the fit rows where it is None); held: the blocks (at most a few) left
    out of all of them; label: which number of the rows' y; basis: orthonormal rows that the standardised vectors are freed of."""

    c: float
    group: str = ""
    held: tuple[int, ...] = ()
    select: dict[str, int] = field(default_factory=dict)
    stats: int | None = None
    recipe: Recipe = field(default_factory=Recipe)
    label: int = 0
    basis: np.ndarray | None = None

    def selection(self, role: str) -> int:
        return self.select.get(role, 0)


@dataclass
class Model:
    """Scores are (x - mean) / sd, freed of the basis, * weight + intercept; mean and sd by key. Keys without statistics are taken as they are."""

    spec: Spec
    mean: dict[str, np.ndarray]
    sd: dict[str, np.ndarray]
    weight: np.ndarray
    intercept: float
    n: int = 0
    converged: bool = True
    passes: int = 0

    def line(self, key: str) -> tuple[np.ndarray, float]:
        """Weights and intercept for vectors as they are."""
        w = freed(self.weight, self.spec.basis)
        if key not in self.mean:
            return w, self.intercept
        w = w / self.sd[key]
        return w, self.intercept - float(w @ self.mean[key])


def freed(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    return x if basis is None or not len(basis) else x - (x @ basis.T) @ basis


def _frame(vectors: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    if vectors:
        yield pd.DataFrame({"k": list(vectors), "v": list(vectors.values())})


def totals(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> dict[int, np.ndarray]:
    """Summed vectors (v) by number (k) of what run gives. FAN_IN tasks' vectors meet in a task of the next round, all in
    one job; a task or the driver holds one vector a number."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf.k, pdf.v, strict=True):
                total[k] = total[k] + v if k in total else np.array(v)
        yield from _frame(total)

    schema, tasks = "k int, v array<double>", df.rdd.getNumPartitions()
    parts = df.mapInPandas(run, schema)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInPandas(add, schema)
    return {r.k: np.array(r.v) for r in parts.collect()}


def training_rows(df: DataFrame, role: str = "fit", features: str = "features", y: Column | str | None = "y", key: Column | str | None = None, group: Column | None = None, block: Column | None = None, selections: Column | None = None) -> DataFrame:
    """The columns that a batch reads: group, role, key, block (a number, -1: never held out), selections (array of numbers, [0] if not given), y
    (array of labels), features. Unite those of several roles."""
    text = lambda c: F.lit("") if c is None else F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    labels = F.array(F.lit(0.0)) if y is None else F.array(F.col(y).cast("double")) if isinstance(y, str) else y
    return df.select(
        text(group).alias("group"), F.lit(role).alias("role"), text(key).alias("key"), (F.lit(-1) if block is None else block).cast("int").alias("block"),
        (F.array(F.lit(0)) if selections is None else selections).alias("selections"), labels.alias("y"), F.transform(features, lambda v: v.cast("double")).alias("features"),
    )


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
    for g, own in pdf.groupby("group", sort=False):
        yield g, own, np.stack(own["features"].to_numpy()).astype(float)


def _selected(own: pd.DataFrame) -> list[set[int]]:
    return [set(map(int, s)) for s in own["selections"]]


def statistics(rows: DataFrame, of_vectors: tuple[str, ...] = ROLES) -> dict[tuple, np.ndarray]:
    """(group, role, selection, key, block) -> number of rows, sums of labels, sums of vectors, sums of squares (only the first for roles not in
    of_vectors); one pass."""
    cells = {tuple(r): k for k, r in enumerate(rows.select("group", "role", F.explode("selections").alias("s"), "key", "block").distinct().collect())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, own, x in _groups(pdf):
                y = np.stack(own["y"].to_numpy()).astype(float)
                full = np.hstack([np.ones((len(x), 1)), y, x, x * x])
                of = defaultdict(list)
                for i, (role, key, block, sel) in enumerate(zip(own["role"], own["key"], own["block"], _selected(own), strict=True)):
                    for s in sel:
                        of[cells[g, role, s, key, block]].append(i)
                for k, at in of.items():
                    v = full[at].sum(0) if own["role"].iloc[at[0]] in of_vectors else np.array([float(len(at))])
                    out[k] = out[k] + v if k in out else v
        yield from _frame(out)

    found = totals(rows, run)
    return {c: found[k] for c, k in cells.items()}


def _staged(start: np.ndarray, penalties: list[float], tolerance: float, most: int) -> Generator[tuple[np.ndarray, float], tuple[float, np.ndarray], tuple[np.ndarray, bool, int]]:
    """minimise() at each penalty in turn, from where the one before ended."""
    theta, good, calls = start, True, 0
    for penalty in penalties:
        run = minimise(theta, tolerance, most)
        point = next(run)
        while True:
            answer = yield point, penalty
            try:
                point = run.send(answer)
            except StopIteration as end:
                theta, ok, n = end.value
                good, calls = good and ok, calls + n
                break
    return theta, good, calls


def _losses(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = np.exp(-np.abs(z))
    return np.logaddexp(0, z) - y * z, np.where(z >= 0, 1, small) / (1 + small) - y


def fit_batch(rows: DataFrame, specs: list[Spec], zero_sd: str = "add", tolerance: float = 1e-9, most_passes: int = 400, least_key_rows: int = 2) -> list[Model]:
    """A model for each spec, in the same passes over rows (training_rows; cache them: each pass reads them once).

    The objective is the mean logistic loss of the fit rows, control_mass times that of the control rows, cue_penalty times the mean
    squared score of the difference rows, and half of |weight|^2 / (c * fit rows). zero_sd: ``add`` divides by the population deviation plus
    1e-6, ``one`` by 1 where there is none, ``raw`` takes vectors as they are. Keys with fewer than least_key_rows training rows aren't
    standardised. A fit whose rows have one class is an error; one that doesn't converge says so. tolerance: of each number of the gradient; scores near 0 are
right to about ten times as much."""
    cells = statistics(rows, ("fit",))
    width = {g: (len(v) - 1) for (g, role, *_), v in cells.items() if role == "fit"}
    n_labels = len(rows.first()["y"])
    width = {g: (w - n_labels) // 2 for g, w in width.items()}
    keys = sorted({c[3] for c in cells})

    of: dict[tuple, dict] = defaultdict(dict)
    for (g, r, s, k, b), v in cells.items():
        of[g, r, s, k][b] = v
    whole = {c: np.sum(list(v.values()), 0) for c, v in of.items()}

    def left(cell: tuple, held: tuple[int, ...]) -> np.ndarray | None:
        blocks = of[cell]
        out = [b for b in held if b in blocks]
        if len(out) == len(blocks):
            return None
        if out and len(blocks) <= MANY:
            return np.sum([v for b, v in blocks.items() if b not in out], 0)
        return whole[cell] - np.sum([blocks[b] for b in out], 0) if out else whole[cell]

    def total(spec: Spec, role: str, selection: int, key: str | None = None) -> np.ndarray | None:
        found = [left(c, spec.held) for k in (keys if key is None else [key]) if (c := (spec.group, role, selection, k)) in whole]
        found = [v for v in found if v is not None]
        return np.sum(found, 0) if found else None

    models, counts = [], []
    for i, spec in enumerate(specs):
        own = total(spec, "fit", spec.selection("fit"))
        if own is None or not 0 < own[1 + spec.label] < own[0]:
            raise ValueError(f"fit {i} ({spec.group}, {spec.held}) has rows of one class only")
        mean, sd = {}, {}
        for key in keys if zero_sd != "raw" else []:
            v = total(spec, "fit", spec.selection("fit") if spec.stats is None else spec.stats, key)
            if v is not None and v[0] >= least_key_rows:
                w = width[spec.group]
                m = v[1 + n_labels : 1 + n_labels + w] / v[0]
                s = np.sqrt(np.maximum(v[1 + n_labels + w :] / v[0] - m * m, 0))
                mean[key], sd[key] = m, (np.where(s < 1e-12, 1.0, s) if zero_sd == "one" else s + 1e-6)
        models.append(Model(spec, mean, sd, np.zeros(width[spec.group]), 0.0, int(own[0])))
        counts.append({r: 0 if (v := total(spec, r, spec.selection(r))) is None else v[0] for r in ROLES})

    starts = {i: np.zeros(len(m.weight) + 1) for i, m in enumerate(models)}
    unlike = {(m.spec.c, m.spec.group, str(m.spec.select), m.spec.stats, str(m.spec.recipe), m.spec.label, m.spec.basis is None, len(m.spec.held)) for m in models}
    if len(unlike) == 1 and len(models) > max(MANY, len(models[0].weight)) and len(models[0].weight) <= WIDEST and not models[0].spec.recipe.continuation:
        spec, held = models[0].spec, {m.spec.held[0]: i for i, m in enumerate(models) if len(m.spec.held) == 1}
        if spec.basis is None and len(held) == len(models) and not any(b in held for (g, r, _, _, b) in cells if g == spec.group and r == "fit"):
            base = fit_batch(rows, [replace(spec, held=())], zero_sd, tolerance, most_passes, least_key_rows)[0]
            for b, theta, error in _near(rows, base, held, counts, tolerance):
                starts[held[b]] = theta
                if error <= tolerance:
                    m = models[held[b]]
                    m.weight, m.intercept, m.passes = theta[:-1], float(theta[-1]), base.passes
                    del starts[held[b]]
    rows = in_few_tasks(rows, sum(v[0] * width.get(c[0], 0) for c, v in cells.items()) * max(1.0, len(starts) / 16))
    strength = [1 / (m.spec.c * m.n) for m in models]
    running = {i: _staged(start, [*models[i].spec.recipe.continuation, models[i].spec.recipe.cue_penalty], tolerance, most_passes) for i, start in starts.items()}
    asked = {i: next(r) for i, r in running.items()}
    while asked:
        sums = _gradients(rows, [models[i] for i in asked], [a[0] for a in asked.values()], [a[1] for a in asked.values()], [counts[i] for i in asked], keys)
        for i, v in zip(list(asked), sums, strict=True):
            theta = asked[i][0]
            value, slope = v[0] + 0.5 * strength[i] * float(theta[:-1] @ theta[:-1]), v[1:].copy()
            slope[:-1] += strength[i] * theta[:-1]
            try:
                asked[i] = running[i].send((value, slope))
            except StopIteration as end:
                final, ok, calls = end.value
                models[i].weight, models[i].intercept, models[i].converged, models[i].passes = final[:-1], float(final[-1]), ok, calls
                del asked[i]
    return models


def _near(rows: DataFrame, base: Model, held: dict[int, int], counts: list[dict], tolerance: float) -> list[tuple[int, np.ndarray, float]]:
    """Block, parameters and a bound of the gradient's numbers there, of fits that are like base but for a held-out block without fit rows.

    Losses of all rows are taken by their first three derivatives at base, in one pass over them, and those of the block itself as they are; each block then takes
    Newton steps where its rows lie. So the work doesn't grow with blocks times rows. What the fourth derivatives leave open is in the bound."""
    spec, side = base.spec, len(base.weight) + 1
    at, mass, penalty = np.append(base.weight, base.intercept), spec.recipe.control_mass, spec.recipe.cue_penalty
    ridge = 1 / (spec.c * base.n) * np.append(np.ones(side - 1), 0.0)
    pick = {r: spec.selection(r) for r in ROLES}

    def placed(x: np.ndarray, role: str, key: str) -> np.ndarray:
        if key in base.mean:
            x = (x if role == "difference" else x - base.mean[key]) / base.sd[key]
        return np.hstack([x, np.full((len(x), 1), 0.0 if role == "difference" else 1.0)])

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for g, own, x in _groups(pdf):
            y = np.stack(own["y"].to_numpy()).astype(float)[:, spec.label if own["role"].iloc[0] != "difference" else 0]
            inside = np.array([pick[r] in s for r, s in zip(own["role"], _selected(own), strict=True)])
            for (role, key), of in own.assign(_i=np.arange(len(own)))[inside].groupby(["role", "key"], sort=False)["_i"] if g == spec.group else []:
                i = of.to_numpy()
                yield role, placed(x[i], role, key), y[i]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for role, every, labels in parts(pdf):
                for k in range(0, len(every), 1000):
                    a, y = every[k : k + 1000], labels[k : k + 1000]
                    if role == "difference":
                        v = (a.T @ a).ravel()
                    else:
                        p = 1 / (1 + np.exp(-(a @ at)))
                        q, pairs = p * (1 - p), (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)
                        third = (a * (q * (1 - 2 * p))[:, None]).T @ pairs
                        v = np.concatenate([a.T @ (p - y), q @ pairs, third.ravel(), pairs.sum(0), [(np.linalg.norm(a, axis=1) ** 32).sum()]])
                    j = ROLES.index(role)
                    out[j] = out[j] + v if j in out else v
        yield from _frame(out)

    flat = totals(rows, run)
    shapes = [(side,), (side, side), (side, side, side), (side, side), ()]
    cuts = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    none = np.zeros(cuts[-1])
    taken = [[flat.get(j, none)[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True)] for j in (0, 1)]
    products = flat.get(2, np.zeros(side * side)).reshape(side, side)
    # no row is longer: a sum of 32nd powers is more than the largest
    longest = max(float(t[4]) for t in taken) ** (1 / 32)
    sizes = {b: (max(1, counts[i]["control"]), max(1, counts[i]["difference"])) for b, i in held.items()}

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = sizes[key[0]]
        own = list(parts(pdf))
        x = np.vstack([np.zeros((0, side)), *[a for r, a, _ in own if r == "control"]])
        y = np.concatenate([np.zeros(0), *[t for r, _, t in own if r == "control"]])
        d = np.vstack([np.zeros((0, side)), *[a for r, a, _ in own if r == "difference"]])
        gap = 2 * penalty / m * (products - d.T @ d) + np.diag(ridge)
        first, second, third, square = (taken[0][k] / base.n + mass / n * taken[1][k] for k in range(4))
        step, error = np.zeros(side), np.inf
        for _ in range(20):
            p = 1 / (1 + np.exp(-(x @ (at + step))))
            bent = third @ step
            slope = first + second @ step + 0.5 * bent @ step - mass / n * (x.T @ (p - y)) + gap @ (at + step)
            error = float(np.abs(slope).max())
            if error <= tolerance / 100:
                break
            step = step - np.linalg.solve(second + bent - mass / n * (x.T * (p * (1 - p))) @ x + gap, slope)
        # |fourth derivative| <= 1/8
        error += longest**2 * float(np.linalg.norm(step)) * float(step @ square @ step) / 48
        return pd.DataFrame({"block": key[0], "theta": [at + step], "error": error})

    own = rows.where("role <> 'fit'").where(F.col("block") >= 0)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = own.repartition(tasks, "block").groupBy("block").applyInPandas(solve, "block int, theta array<double>, error double")
    return [(r.block, np.array(r.theta), r.error if np.isfinite(r.error) else np.inf) for r in found.toLocalIterator() if np.isfinite(r.theta).all()]


def _gradients(rows: DataFrame, models: list[Model], thetas: list[np.ndarray], penalties: list[float], counts: list[dict], keys: list[str]) -> list[np.ndarray]:
    """For each model the loss without the ridge, and its gradient by weight and intercept."""
    by_group: dict[str, list[int]] = defaultdict(list)
    for i, m in enumerate(models):
        by_group[m.spec.group].append(i)
    lines, shapes = {}, {}
    for g, at in by_group.items():
        for key in keys:
            each = [Model(models[i].spec, models[i].mean, models[i].sd, thetas[i][:-1], float(thetas[i][-1])).line(key) for i in at]
            lines[g, key] = np.array([w for w, _ in each]).T, np.array([b for _, b in each])
        # per role: what a row of each fit weighs, its selection; per fit: held block and label
        weigh = {r: np.array([(1.0 if r == "fit" else models[i].spec.recipe.control_mass if r == "control" else penalties[i]) / max(1, counts[i][r]) for i in at]) for r in ROLES}
        pick = {r: np.array([models[i].spec.selection(r) for i in at]) for r in ROLES}
        most_held = max([1, *(len(models[i].spec.held) for i in at)])
        held = np.array([[*models[i].spec.held, *[-2] * (most_held - len(models[i].spec.held))] for i in at]).T
        shapes[g] = weigh, pick, held, np.array([models[i].spec.label for i in at]), np.array(at)
    number = {k: j for j, k in enumerate(keys)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, own, x in _groups(pdf):
                if g not in shapes:
                    continue
                weigh, pick, held, label, at = shapes[g]
                y, block, selected = np.stack(own["y"].to_numpy()).astype(float), own["block"].to_numpy(), _selected(own)
                most = 1 + max(int(p.max()) for p in pick.values())
                inside = np.zeros((len(x), most), bool)
                for i, s in enumerate(selected):
                    inside[i, [j for j in s if j < most]] = True
                for (key, role), part in own.assign(_i=np.arange(len(own))).groupby(["key", "role"], sort=False)["_i"]:
                    if not weigh[role].any():
                        continue
                    w, b = lines[g, key]
                    step = max(1, TASK_NUMBERS // len(at))
                    for start in range(0, len(part), step):
                        i = part.to_numpy()[start : start + step]
                        member = inside[i][:, pick[role]] & (block[i][:, None] != held[:, None]).all(0) & (weigh[role] > 0)
                        z = x[i] @ w
                        if role == "difference":
                            # the difference of two vectors of one key: means and intercepts cancel
                            value, pull = z * z, 2 * z
                        else:
                            value, pull = _losses(z + b, y[i][:, label])
                        value, pull = value * member * weigh[role], pull * member * weigh[role]
                        v = np.hstack([value.sum(0)[:, None], np.zeros((len(at), 1)) if role == "difference" else pull.sum(0)[:, None], pull.T @ x[i]])
                        for row, fit in zip(v, at, strict=True):
                            # differences are apart from the others: no mean is taken off them
                            k = (int(fit) * len(number) + number[key]) * 2 + (role == "difference")
                            out[k] = out[k] + row if k in out else row
        yield from _frame(out)

    found = totals(rows, run)
    sums = [np.zeros(len(t) + 1) for t in thetas]
    for k, v in found.items():
        fit, key, apart = k // 2 // len(keys), keys[k // 2 % len(keys)], k % 2
        m, g = models[fit], v[2:]
        if key in m.mean:
            g = (g if apart else g - v[1] * m.mean[key]) / m.sd[key]
        sums[fit] += np.concatenate([[v[0]], freed(g, m.spec.basis), [v[1]]])
    return sums


def score_batch(df: DataFrame, models: list[Model], which: Column | str = "fit", key: Column | str | None = None, features: str = "features", tie: str = ">") -> DataFrame:
    """df with score and pred by the model of number ``which``, standardised by key; tie says whether a score of 0 is predicted as 1."""
    lines = [{k: m.line(k) for k in [*m.mean, ""]} for m in models]

    @F.pandas_udf("double")
    def line(x: pd.Series, i: pd.Series, k: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for (fit, own), at in pd.Series(np.arange(len(x))).groupby([i.to_numpy(), k.to_numpy()]):
            w, b = lines[fit].get(own, (None, None)) if own in lines[fit] else models[fit].line(own)
            out[at] = np.stack(x.iloc[at].to_numpy()).astype(float) @ w + b
        return pd.Series(out)

    col = lambda c: F.col(c) if isinstance(c, str) else c
    own = F.lit("") if key is None else F.coalesce(col(key).cast("string"), F.lit(""))
    out = df.withColumn("score", line(F.col(features), col(which).cast("int"), own))
    return out.withColumn("pred", ((F.col("score") >= 0) if tie == ">=" else (F.col("score") > 0)).cast("int"))


def score_moments(rows: DataFrame, models: list[Model]) -> pd.DataFrame:
    """fit, key, n, mean, sd of the scores of each model's own fit rows: sums in one pass, not a copy of the rows a fit."""
    keys = sorted({k for m in models for k in m.mean} | {r[0] for r in rows.where("role = 'fit'").select("key").distinct().collect()})
    number = {k: j for j, k in enumerate(keys)}
    if len({(m.spec.group, m.spec.selection("fit")) for m in models}) == 1 and len(models) > len(models[0].weight):
        held = sorted({b for m in models for b in m.spec.held})
        lie = {r.block for r in rows.where("role = 'fit'").select("block").distinct().collect()}
        if lie.isdisjoint(held):
            return _moments_of_all(rows, models, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(models) * len(keys), 3))
        for pdf in batches:
            for g, own, x in _groups(pdf):
                selected, block = _selected(own), own["block"].to_numpy()
                for key, part in own.assign(_i=np.arange(len(own))).groupby("key", sort=False)["_i"]:
                    i = part.to_numpy()
                    for k, m in enumerate(models):
                        if m.spec.group == g:
                            w, b = m.line(key)
                            at = i[[m.spec.selection("fit") in selected[j] and block[j] not in m.spec.held for j in i]]
                            z = x[at] @ w + b
                            out[k * len(keys) + number[key]] += len(z), z.sum(), z @ z
        yield pd.DataFrame({"k": range(len(out)), "v": list(out)})

    found = totals(rows.where("role = 'fit'"), run)
    out = [(k // len(keys), keys[k % len(keys)], int(n), s / n, float(np.sqrt(max(0.0, q / n - (s / n) ** 2)))) for k, (n, s, q) in sorted(found.items()) if n]
    return pd.DataFrame(out, columns=["fit", "key", "n", "mean", "sd"])


def _moments_of_all(rows: DataFrame, models: list[Model], keys: list[str]) -> pd.DataFrame:
    """score_moments of models that all have the same fit rows, from the means and products of these rows."""
    spec, width, number = models[0].spec, len(models[0].weight), {k: j for j, k in enumerate(keys)}
    # about where the rows lie, so that products don't cancel
    shift = {k: models[0].mean.get(k, np.zeros(width)) for k in keys}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, own, x in _groups(pdf):
                inside = np.array([spec.selection("fit") in s for s in _selected(own)])
                for key in own["key"].unique() if g == spec.group else []:
                    z = x[inside & (own["key"] == key).to_numpy()] - shift[key]
                    v, k = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]), number[key]
                    out[k] = out[k] + v if k in out else v
        yield from _frame(out)

    parts = []
    for k, v in totals(rows.where("role = 'fit'"), run).items():
        if v[0]:
            key, mean = keys[k], v[1 : 1 + width] / v[0]
            lines = [m.line(key) for m in models]
            w, b = np.array([w for w, _ in lines]), np.array([b for _, b in lines])
            spread = v[1 + width :].reshape(width, width) / v[0] - np.outer(mean, mean)
            parts.append(pd.DataFrame({"fit": range(len(models)), "key": key, "n": int(v[0]), "mean": w @ (mean + shift[key]) + b, "sd": np.sqrt(np.maximum(0, ((w @ spread) * w).sum(1)))}))
    return pd.concat(parts).sort_values(["fit", "key"], ignore_index=True) if parts else pd.DataFrame(columns=["fit", "key", "n", "mean", "sd"])


def held_out_spaces(rows: DataFrame, sd: dict[str, np.ndarray], blocks: int, fraction: float | None, judge: Callable[..., dict], schema: str) -> DataFrame:
    """What judge makes of each block's basis (see held_out_bases), a row each of ``schema``, made where the bases are: none comes to the driver. judge gets
    block, basis, triangle (of the other blocks' rows) and others: n, zeros and low of the other blocks' rows, which are their number, how many are null vectors and the
    least length of the others.

    Each task leaves a triangle for each block, and those of a block meet. Blocks are dealt to about as many segments as a segment has blocks; the driver holds
    a triangle a segment, and a task puts together what each of its blocks leaves out from those of the other segments and the triangles before and behind it."""
    spark = rows.sparkSession
    found, own = "block int, n long, zeros long, low double, r array<double>", F.col("features").alias("r")

    def triangles(scale: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, tuple] = {}
            for pdf in batches:
                for block, own in pdf.groupby("block", sort=False):
                    x = np.stack(own["r"].to_numpy()).astype(float)
                    if scale:
                        x = np.array([v / sd[k] if k in sd else v for v, k in zip(x, own["key"], strict=True)])
                        size = np.linalg.norm(x, axis=1)
                        count, zeros, low = len(x), int((size == 0).sum()), float(size[size > 0].min(initial=np.inf))
                    else:
                        count, zeros, low = int(own["n"].sum()), int(own["zeros"].sum()), float(own["low"].min())
                    n, z, least, r = held.get(block, (0, 0, np.inf, np.zeros((0, x.shape[1]))))
                    held[block] = n + count, z + zeros, min(least, low), np.linalg.qr(np.vstack([r, x]), mode="r")
            for block, (n, z, least, r) in held.items():
                rest = [0] * (len(r) - 1)
                yield pd.DataFrame({"block": block, "n": [n, *rest], "zeros": [z, *rest], "low": least, "r": list(r)})

        return run

    each = rows.where("role = 'difference' and block >= 0").select("block", "key", own).mapInPandas(triangles(True), found)
    segments = max(1, round(blocks**0.5))
    segment = (F.col("block") % segments).alias("segment")
    each = each.repartition(segments, "block").mapInPandas(triangles(False), found).select(segment, "*").cache()
    join = lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r") if len(a) and len(b) else a if len(a) else b

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.stack(pdf["r"].to_numpy()).astype(float), mode="r")
        rest = [0] * (len(r) - 1)
        return pd.DataFrame({"block": key[0], "n": [int(pdf["n"].sum()), *rest], "zeros": [int(pdf["zeros"].sum()), *rest], "low": pdf["low"].min(), "r": list(r)})

    whole = each.groupBy("segment").applyInPandas(together, found).toPandas()
    width = len(whole["r"].iloc[0]) if len(whole) else 0
    triangle = [np.zeros((0, width))] * segments
    for k, of in whole.groupby("block"):
        triangle[k] = np.stack(of["r"].to_numpy())
    low = sorted(whole.groupby("block")["low"].min().tolist() if len(whole) else [])
    n, zeros, least = int(whole["n"].sum()), int(whole["zeros"].sum()), low[0] if low else np.inf
    before, behind = [np.zeros((0, width))], [np.zeros((0, width))]
    for k in range(segments):
        before.append(join(before[-1], triangle[k]))
        behind.append(join(behind[-1], triangle[segments - 1 - k]))
    outside = [join(before[k], behind[segments - 1 - k]) for k in range(segments)]

    def spaces(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, held = {k: of for k, of in pdf[pdf["r"].notna()].groupby("block")}, sorted(pdf["block"].unique())
        of = [np.stack(own[k]["r"].to_numpy()).astype(float) if k in own else np.zeros((0, width)) for k in held]
        tail = [np.zeros((0, width))]
        for r in reversed(of):
            tail.append(join(tail[-1], r))
        head, out = outside[int(key[0])], []
        for k, block in enumerate(held):
            rest = join(head, tail[len(of) - 1 - k])
            less, null = (int(own[block]["n"].sum()), int(own[block]["zeros"].sum())) if block in own else (0, 0)
            # the least length of all rows is not more than that of the others
            out.append(judge(block=int(block), basis=leading(rest, n - less, fraction), triangle=rest, others=(n - less, zeros - null, least)))
            head = join(head, of[k])
        return pd.DataFrame(out)

    every = spark.range(blocks).select(F.col("id").cast("int").alias("block")).select(segment, "block", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("zeros", "long"), ("low", "double"), ("r", "array<double>"))])
    return each.unionByName(every).groupBy("segment").applyInPandas(spaces, schema)


def held_out_bases(rows: DataFrame, sd: dict[str, np.ndarray], blocks: int, fraction: float | None = 0.9) -> list[np.ndarray]:
    """For each block the orthonormal rows that span the difference rows of all other blocks, each divided by the deviation of its key:
    the leading right singular vectors that hold the fraction of the squared mass; with None all above eps * larger side * largest singular
    value. Without differences a basis is empty. The driver holds them all; where a block's basis is only looked at, use held_out_spaces."""

    def plain(block: int, basis: np.ndarray, triangle: np.ndarray, others: tuple) -> dict:
        return {"block": block, "width": basis.shape[1], "basis": basis.ravel()}

    out: list = [None] * blocks
    for r in held_out_spaces(rows, sd, blocks, fraction, plain, "block int, width int, basis array<double>").toLocalIterator():
        out[r.block] = np.array(r.basis, float).reshape(-1, r.width) if r.width else np.zeros((0, 0))
    return out


def leading(triangle: np.ndarray, n: int, fraction: float | None) -> np.ndarray:
    """Right singular vectors (rows) of a triangle of n vectors: those that hold the fraction of the squared mass, or all of numerical rank."""
    if not triangle.size or not triangle.any():
        return np.zeros((0, triangle.shape[1]))
    _, s, v = np.linalg.svd(triangle, full_matrices=False)
    rank = int((s > np.finfo(float).eps * max(n, triangle.shape[1]) * s[0]).sum()) if fraction is None else rank_for_variance(s.tolist(), fraction)
    return v[:rank]


def numbered(df: DataFrame, column: str) -> tuple[list, Column]:
    """The values of a column that names the units held out (families, blocks, banks: as many as there are fits), and their
    numbers as a column; null has none (-1)."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    if not values:
        return values, F.lit(-1)
    if len(values) > MANY:
        # a map in the plan is searched from its start for each row
        number = {r[0]: i for i, r in enumerate(df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema).select(F.col(column).cast("string")).collect())}

        @F.pandas_udf("int")
        def place(names: pd.Series) -> pd.Series:
            return names.map(number).fillna(-1).astype("int32")

        return values, place(F.col(column).cast("string"))
    at = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return values, F.coalesce(F.try_element_at(at, F.col(column)), F.lit(-1))
