"""Protocols of probes, each as one batch of fits: scores of held-out families, sweeps over layers, cross-fits of controls, reciprocal
banks, confirmations. Statistics, subspaces, strengths and penalties of all folds are of their training rows only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fits, metrics
from .fits import Model, Spec, fit_batch, numbered, score_batch, score_moments, training_rows
from .matching import cue_differences
from .probe import Recipe

#: Penalties by which a fit with a larger one gets there.
CONTINUATION = (16.0, 64.0)
CUE_KEYS = ["control_block_id", "cue_family", "language", "intended_purpose"]


def continued(control_mass: float, cue_penalty: float) -> Recipe:
    """A recipe that reaches its penalty through the smaller ones of CONTINUATION."""
    return Recipe(control_mass, cue_penalty, tuple(p for p in CONTINUATION if p < cue_penalty))


def _purpose(df: DataFrame) -> DataFrame:
    return df.withColumn("_y", (F.col("intended_purpose") == "evaluation").cast("double"))


def _control_rows(controls: DataFrame, block: Column | None = None, selections: Column | None = None, group: Column | None = None) -> DataFrame:
    return training_rows(_purpose(controls), "control", y="_y", key="language", block=block, selections=selections, group=group)


def _difference_rows(differences: DataFrame, block: Column | None = None, selections: Column | None = None, group: Column | None = None) -> DataFrame:
    return training_rows(differences, "difference", "difference", None, "language", block=block, selections=selections, group=group)


# -- held-out families -----------------------------------------------------------------------------------------------------


def fold_scores(items: DataFrame, c: float | tuple[float, ...], family: str = "family", key: str = "language", fit_language: str | None = None, fit_mask: Column | None = None, y: str = "y", least: int = 10) -> DataFrame:
    """items of each held-out family with score, pred (1 above 0) and c, standardised by language with the training rows' statistics.

    All families are fitted in one batch. Folds with fewer than ``least`` training rows or one class are skipped. fit_language:
    statistics of all languages, the fit on this one only. c as a tuple: the strength is chosen within each fold, by the mean balanced accuracy
    over its training families, held out in turn (families with fewer than two rows and inner fits with fewer than ``least`` rows or
    one class don't count; the first of equal strengths wins)."""
    families, at = numbered(items, family)
    mask = F.lit(True) if fit_mask is None else fit_mask
    own = F.lit(True) if fit_language is None else F.col(key) == fit_language
    chosen = F.array_compact(F.array(F.when(mask, 0), F.when(mask & own, 1)))
    rows = training_rows(items.withColumn("_y", F.col(y).cast("double")), y="_y", key=key, block=at, selections=chosen).where("size(selections) > 0").cache()
    size = {r.block: (r.n, r.ones) for r in rows.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("y")[0]).alias("ones")).collect()}

    def sound(held: tuple[int, ...]) -> bool:
        n = sum(v[0] for b, v in size.items() if b not in held)
        return n >= least and 0 < sum(v[1] for b, v in size.items() if b not in held) < n

    kept = [k for k in range(len(families)) if sound((k,))]
    strength = {k: c if isinstance(c, (int, float)) else c[0] for k in kept}
    try:
        if not isinstance(c, (int, float)):
            strength |= _inner_strengths(items.where(mask), rows, at, y, key, kept, range(len(families)), size, sound, c)
        models = fit_batch(rows, [Spec(strength[k], held=(k,), select={"fit": 0 if fit_language is None else 1}, stats=0) for k in kept]) if kept else []
    finally:
        rows.unpersist()
    if not models:
        return items.limit(0).withColumns({"score": F.lit(0.0), "pred": F.lit(0), "c": F.lit(0.0)})
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kept) for x in (k, i)])
    scored = score_batch(items.withColumn("_fit", F.try_element_at(place, at)).where("_fit is not null"), models, "_fit", key)
    return scored.withColumn("c", F.element_at(F.array(*[F.lit(float(strength[k])) for k in kept]), F.col("_fit") + 1)).drop("_fit")


def _inner_strengths(items: DataFrame, rows: DataFrame, at: Column, y: str, key: str, outer, every, size, sound, grid) -> dict[int, float]:
    cells = [(o, i, c) for o in outer for i in every if i != o and size.get(i, (0, 0))[0] >= 2 and sound((o, i)) for c in grid]
    if not cells:
        return {}
    models = fit_batch(rows, [Spec(c, held=(o, i)) for o, i, c in cells])
    of = {f: [k for k, (_, i, _) in enumerate(cells) if i == f] for f in every}
    tests = F.create_map(*[x for f, ks in of.items() for x in (F.lit(f), F.array(*map(F.lit, ks)) if ks else F.array().cast("array<int>"))])
    scored = score_batch(items.withColumn("_fit", F.explode(F.element_at(tests, at))), models, "_fit", key)
    got: dict[tuple, list[float]] = {}
    for r in scored.groupBy("_fit").agg(metrics.balanced_accuracy(y, "pred").alias("a")).collect():
        o, _, c = cells[r["_fit"]]
        got.setdefault((o, c), []).append(r.a)
    # the first of the best strengths
    return {o: max((c for c in grid if (o, c) in got), key=lambda c: (np.mean(got[o, c]), -grid.index(c))) for o in {o for o, _ in got}}


# -- layers --------------------------------------------------------------------------------------------------------------------


def sweep(items: DataFrame, activations: DataFrame, selectors: dict[str, tuple[Column, Column]], c: float = 0.1, family: str = "family", labels: dict[str, str] | None = None) -> DataFrame:
    """layer, regime, n, balanced_accuracy, auc, pairs, share_positive, mean_delta, distinct_fraction of each layer of activations
    (item_id, layer, features; a layer has a width of its own) under each regime (training and test rows, as conditions).

    All layers, regimes and held-out families are one batch over one scan. labels: the column of 0 and 1 that a regime is fitted on (``y``
    if it isn't named). Pairs are the evaluation and deployment rows of a block and format. distinct_fraction: different vectors by all of the
    layer."""
    labels, names = {r: (labels or {}).get(r, "y") for r in selectors}, list(selectors)
    columns = sorted(set(labels.values()))
    families, at = numbered(items, family)
    layers, layer_at = numbered(activations, "layer")
    own = items.select("item_id", "block", "purpose", "format", *columns, at.alias("_at"), *[selectors[r][0].alias(f"_train{k}") for k, r in enumerate(names)], *[selectors[r][1].alias(f"_test{k}") for k, r in enumerate(names)])
    table = activations.select("item_id", layer_at.alias("_layer"), "layer", "features").join(own, "item_id")
    chosen = F.array_compact(F.array(*[F.when(F.col(f"_train{k}"), k) for k in range(len(names))]))
    rows = training_rows(table, y=F.array(*[F.col(x).cast("double") for x in columns]), group=F.col("_layer"), block=F.col("_at"), selections=chosen).where("size(selections) > 0").cache()
    specs = [Spec(c, str(g), (f,), {"fit": k}, label=columns.index(labels[r])) for g in range(len(layers)) for k, r in enumerate(names) for f in range(len(families))]
    try:
        models = fit_batch(rows, specs, zero_sd="one")
    finally:
        rows.unpersist()
    tests = F.array_compact(F.array(*[F.when(F.col(f"_test{k}"), F.struct(F.lit(r).alias("regime"), F.col(labels[r]).alias("_y"), ((F.col("_layer") * len(names) + k) * len(families) + F.col("_at")).alias("_fit"))) for k, r in enumerate(names)]))
    long = table.withColumn("_t", F.explode(tests)).select("layer", "block", "purpose", "format", "features", "_t.*")
    scored = score_batch(long, models, "_fit", tie=">=").select("layer", "regime", "block", "purpose", "format", F.col("_y").alias("y"), "score", "pred")
    cell = ["layer", "regime"]
    plain = scored.groupBy(*cell).agg(F.count("*").alias("n"), metrics.balanced_accuracy().alias("balanced_accuracy"))
    ranks = metrics.auc(scored, cell).select(*cell, "auc")
    from .matching import twins

    paired = metrics.paired_deltas(twins(scored, [*cell, "block", "format"]), cell).withColumnRenamed("n_blocks", "pairs")
    distinct = activations.groupBy("layer").agg((F.count_distinct(F.xxhash64("features")) / F.count("*")).alias("distinct_fraction"))
    return plain.join(ranks, cell).join(paired, cell, "left").join(distinct, "layer")


# -- controls ------------------------------------------------------------------------------------------------------------------


def _mean_bases(controls: DataFrame, sd: dict[str, np.ndarray], blocks: int, at: Column) -> list[np.ndarray]:
    """For each block the orthonormal mean cue axes (cue family by language) of all other blocks: means of what all blocks add up to, less
    the own sums."""
    cells, cell_at = numbered(controls.withColumn("_cell", F.to_json(F.array("cue_family", "language", "lexical_cue"))), "_cell")
    rows = _control_rows(controls.withColumn("_cell", F.to_json(F.array("cue_family", "language", "lexical_cue"))), at, F.array(cell_at))
    found = fits.statistics(rows)
    import json

    split = [json.loads(c) for c in cells]
    out = []
    for held in range(blocks):
        axes = []
        for family, language in sorted({(f, k) for f, k, _ in split}):
            side = {}
            for kind in ("evaluation", "deployment"):
                own = [v for (_, _, s, _, b), v in found.items() if split[s] == [family, language, kind] and b != held]
                if own:
                    v = np.sum(own, 0)
                    side[kind] = v[2 : 2 + (len(v) - 2) // 2] / v[0]
            if len(side) == 2:
                axes.append((side["evaluation"] - side["deployment"]) / sd.get(language, 1.0))
        out.append(np.linalg.qr(np.array(axes).T)[0].T if axes else np.zeros((0, 0)))
    return out


def crossfit_controls(controls: DataFrame, fit: DataFrame, recipe: Recipe, c: float, method: str = "none", fraction: float = 0.9) -> DataFrame:
    """controls with score, pred (1 above 0), normalised and converged, from fits whose controls, differences and subspace leave the row's
    control_block_id out; vectors are standardised by language with the statistics of fit. normalised: score less the mean of the fit's own rows of
    the language, by their deviation.

    method: the subspace that vectors are freed of: leading singular vectors of the cue differences (``svd``), all of their row space
    (``rowspace``), the mean cue axes (``mean``) or nothing (``none``). All blocks are one batch, and no row is listed for the blocks it
    trains; a block without a name (null) is never held out and isn't scored."""
    blocks, at = numbered(controls, "control_block_id")
    named, differences = controls.withColumn("_block", at), cue_differences(controls).withColumn("_block", at)
    rows = training_rows(fit.withColumn("_y", F.col("y").cast("double")), y="_y", key="language").unionByName(_control_rows(named, F.col("_block"))).unionByName(_difference_rows(differences, F.col("_block"))).cache()
    try:
        bases: list = [None] * len(blocks)
        if method != "none":
            sd = _deviations(rows)
            bases = _mean_bases(named, sd, len(blocks), F.col("_block")) if method == "mean" else fits.held_out_bases(rows, sd, len(blocks), fraction if method == "svd" else None)
        models = fit_batch(rows, [Spec(c, held=(k,), recipe=recipe, basis=b) for k, b in enumerate(bases)])
        moments = score_moments(rows, models)
    finally:
        rows.unpersist()
    scored = score_batch(named.where("_block >= 0"), models, "_block", "language")
    spark = controls.sparkSession
    known = spark.createDataFrame([(int(r.fit), r.key, float(r.mean), float(r.sd)) for r in moments.itertuples()], "_block int, language string, _mean double, _sd double")
    good = ~F.col("_block").isin([k for k, m in enumerate(models) if not m.converged])
    return scored.join(known, ["_block", "language"], "left").withColumn("normalised", F.try_divide(F.col("score") - F.col("_mean"), F.col("_sd"))).withColumn("converged", good).drop("_block", "_mean", "_sd")


def _deviations(rows: DataFrame) -> dict[str, np.ndarray]:
    """The deviations by key that fit_batch divides by, of all fit rows."""
    found: dict[str, np.ndarray] = {}
    for (_, role, s, key, _), v in fits.statistics(rows.where("role = 'fit'")).items():
        if role == "fit" and s == 0:
            found[key] = found[key] + v if key in found else v
    out = {}
    for key, v in found.items():
        if v[0] >= 2:
            w = (len(v) - 2) // 2
            m = v[2 : 2 + w] / v[0]
            out[key] = np.sqrt(np.maximum(v[2 + w :] / v[0] - m * m, 0)) + 1e-6
    return out


def control_records(controls: DataFrame, spread: DataFrame, by: list[str]) -> DataFrame:
    """by, auc_floor over pooled, surface and within-cue slices, slices, max_effect; spread: by, language, fit_sd."""
    rows = controls.withColumn("y", (F.col("intended_purpose") == "evaluation").cast("int"))
    base = ["cue_family", "language"]
    aucs = metrics.auc(metrics.sliced(rows, {"pooled": base, "surface": [*base, "surface"], "cue": [*base, "lexical_cue"]}), [*by, "slice_kind", "slice_key"])
    mean = lambda k: F.avg(F.when(F.col("lexical_cue") == k, F.col("score")))
    effects = controls.groupBy(*by, "language", "cue_family").agg((mean("evaluation") - mean("deployment")).alias("gap")).join(spread, [*by, "language"])
    worst = effects.groupBy(*by).agg(F.max(F.abs(F.try_divide("gap", "fit_sd"))).alias("max_effect"))
    return aucs.groupBy(*by).agg(F.min("auc").alias("auc_floor"), F.count("*").alias("slices")).join(worst, by)


def reciprocal(banks: dict[str, DataFrame], fit: DataFrame, recipes: dict[str, Recipe], c: float) -> DataFrame:
    """recipe, source, target, auc_floor, slices, max_effect, eligible: controls of one bank steer the fit, those of each other test it.
    Recipes by banks are one batch; a fit that doesn't converge makes its rows ineligible, and holds up no other."""
    names, cells = list(banks), [(r, b) for r in recipes for b in range(len(banks))]
    every = None
    for k, bank in enumerate(banks.values()):
        own = bank.select("control_block_id", "cue_family", "language", "intended_purpose", "lexical_cue", "surface", "features").withColumn("_bank", F.lit(k))
        every = own if every is None else every.unionByName(own)
    of = F.array("_bank")
    rows = training_rows(fit.withColumn("_y", F.col("y").cast("double")), y="_y", key="language").unionByName(_control_rows(every, selections=of))
    for k, bank in enumerate(banks.values()):
        rows = rows.unionByName(_difference_rows(cue_differences(bank), selections=F.array(F.lit(k))))
    rows = rows.cache()
    try:
        models = fit_batch(rows, [Spec(c, select={"control": b, "difference": b}, recipe=recipes[r]) for r, b in cells])
        moments = score_moments(rows, models)
    finally:
        rows.unpersist()
    spark = fit.sparkSession
    others = F.filter(F.sequence(F.lit(0), F.lit(len(cells) - 1)), lambda k: k % len(banks) != F.col("_bank"))
    scored = score_batch(every.withColumn("_fit", F.explode(others)), models, "_fit", "language").withColumnRenamed("_bank", "_target")
    spread = spark.createDataFrame([(int(r.fit), r.key, float(r.sd)) for r in moments.itertuples()], "_fit int, language string, fit_sd double")
    # the spread doesn't depend on the target
    spread = spread.withColumn("_target", F.explode(F.array(*[F.lit(k) for k in range(len(banks))])))
    record = control_records(scored, spread, ["_fit", "_target"])
    known = spark.createDataFrame([(k, r, names[b], models[k].converged) for k, (r, b) in enumerate(cells)], "_fit int, recipe string, source string, eligible boolean")
    targets = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_target") + 1)
    return record.join(known, "_fit").select("recipe", "source", targets.alias("target"), "auc_floor", "slices", "max_effect", "eligible")


# -- one fit, and many models ------------------------------------------------------------------------------------------------


def fit_penalised(fit: DataFrame, controls: DataFrame, differences: DataFrame, recipe: Recipe, c: float) -> Model:
    """One fit with control loss and cue penalty over all rows, without languages. fit, controls: features, y; differences: difference (of
    raw vectors). A fit that doesn't converge says so and isn't an error."""
    side = lambda df, role, x, y: training_rows(df if y is None else df.withColumn("_y", F.col(y).cast("double")), role, x, None if y is None else "_y")
    rows = side(fit, "fit", "features", "y").unionByName(side(controls, "control", "features", "y")).unionByName(side(differences, "difference", "difference", None)).cache()
    try:
        return fit_batch(rows, [Spec(c, recipe=recipe)])[0]
    finally:
        rows.unpersist()


def fit_probe(fit: DataFrame, controls: DataFrame, method: str, c: float, fraction: float = 0.9, recipe: Recipe | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored rows of fit and of controls of a probe whose vectors are standardised by language (statistics of fit) and freed of a
    subspace of the controls: see crossfit_controls. recipe: control loss and penalty of what the subspace leaves."""
    differences = cue_differences(controls)
    rows = training_rows(fit.withColumn("_y", F.col("y").cast("double")), y="_y", key="language").unionByName(_control_rows(controls, F.lit(0))).unionByName(_difference_rows(differences, F.lit(0))).cache()
    try:
        basis = None
        if method != "none":
            sd = _deviations(rows)
            # block 1 is held out, of which there are no rows
            basis = _mean_bases(controls, sd, 2, F.lit(0))[1] if method == "mean" else fits.held_out_bases(rows, sd, 2, fraction if method == "svd" else None)[1]
        model = fit_batch(rows, [Spec(c, recipe=recipe or Recipe(), basis=basis)])
    finally:
        rows.unpersist()
    return score_batch(fit, model, F.lit(0), "language"), score_batch(controls, model, F.lit(0), "language")


def score_frozen(fit: DataFrame, controls: DataFrame, c: float) -> DataFrame:
    """controls, scored by the direction fitted on all of fit."""
    return fit_probe(fit, controls, "none", c)[1]


def confirm(fitted: dict[str, DataFrame], dev: dict[str, DataFrame], fresh: dict[str, DataFrame], recipe: Recipe, c: float, thresholds: DataFrame) -> DataFrame:
    """model, passed, failed_gates, one shot: the frozen recipe fitted on the rows and development controls of each model (its vectors
    have a width of its own), fresh controls scored, gates on auc_floor and max_effect; the row with a null model says whether all models
    pass. All models are one batch."""
    names, rows = list(fitted), None
    for name in names:
        g = F.lit(name)
        own = training_rows(fitted[name].withColumn("_y", F.col("y").cast("double")), y="_y", key="language", group=g)
        own = own.unionByName(_control_rows(dev[name], group=g)).unionByName(_difference_rows(cue_differences(dev[name]), group=g))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.cache()
    try:
        models = fit_batch(rows, [Spec(c, name, recipe=recipe) for name in names])
        moments = score_moments(rows, models)
    finally:
        rows.unpersist()
    every = None
    for k, name in enumerate(names):
        own = fresh[name].select("control_block_id", "cue_family", "language", "intended_purpose", "lexical_cue", "surface", "features").withColumn("_fit", F.lit(k))
        every = own if every is None else every.unionByName(own)
    spark = every.sparkSession
    spread = spark.createDataFrame([(int(r.fit), r.key, float(r.sd)) for r in moments.itertuples()], "_fit int, language string, fit_sd double")
    record = control_records(score_batch(every, models, "_fit", "language"), spread, ["_fit"])
    model = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_fit") + 1)
    good = F.element_at(F.array(*[F.lit(m.converged) for m in models]), F.col("_fit") + 1)
    long = record.select(model.alias("model"), good.alias("_ok"), F.stack(F.lit(2), F.lit("auc_floor"), F.col("auc_floor"), F.lit("max_effect"), F.col("max_effect")).alias("metric", "value"))
    gates = metrics.apply_gates(long, thresholds, ["model", "_ok"]).withColumn("passed", F.col("passed") & F.col("_ok"))
    return gates.rollup("model").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed_gates"))
