"""Classification metrics over any grouping, gates and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- aggregate expressions, for groupBy(...).agg(...) ------------------------------------------------------------------


def accuracy(y: str = "y", pred: str = "pred", weight: Column | None = None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    return F.sum(w * (F.col(y) == F.col(pred)).cast("double")) / F.sum(w)


def _recall(k: int, y: str, pred: str, weight: Column | None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    own = F.col(y) == k
    return F.try_divide(F.sum(F.when(own, w * (F.col(pred) == k).cast("double"))), F.sum(F.when(own, w)))


def balanced_accuracy(y: str = "y", pred: str = "pred", weight: Column | None = None) -> Column:
    """Mean recall over the classes that are there."""
    a, b = _recall(0, y, pred, weight), _recall(1, y, pred, weight)
    return F.coalesce((a + b) / 2, a, b)


# -- tables ------------------------------------------------------------------------------------------------------------


def rank_sums(df: DataFrame, cell: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """cell, wins (positives above negatives, ties a half), p and n (positives and negatives)."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = df.groupBy(*cell, score).agg(F.coalesce(F.sum(F.when(F.col(y) == 1, w)), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.when(F.col(y) == 0, w)), F.lit(0.0)).alias("neg"))
    # a cell may hold most of the rows, so rows are dealt by ranges of (cell, score), about equal in rows and as many as there are
    # shuffle partitions: running sums within each range, then over the ranges of a cell
    at = at.repartitionByRange(*cell, score).withColumn("_range", F.spark_partition_id())
    before = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = at.withColumn("_below", before([*cell, "_range"], score, "neg")).groupBy(*cell, "_range").agg(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_wins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return own.withColumn("_below", before(cell, "_range", "_n")).groupBy(*cell).agg(F.sum(F.col("_wins") + F.col("_p") * F.col("_below")).alias("wins"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))


def auc(df: DataFrame, cell: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """cell, auc (null with one class only), p, n: exact, without bins or joins."""
    return rank_sums(df, cell, y, score, weight).select(*cell, F.try_divide(F.col("wins"), F.col("p") * F.col("n")).alias("auc"), "p", "n")


def cell_rates(df: DataFrame) -> DataFrame:
    """purpose, format, n, percent_predicted_evaluation, mean_score."""
    return df.groupBy("purpose", "format").agg(F.count("*").alias("n"), (F.avg(F.col("pred").cast("double")) * 100).alias("percent_predicted_evaluation"), F.avg("score").alias("mean_score"))


def paired_deltas(twins: DataFrame, by: list[str]) -> DataFrame:
    """n_blocks, mean_delta, share_positive by the given columns; see matching.twins."""
    return twins.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.avg("delta").alias("mean_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"))


def sliced(df: DataFrame, slices: dict[str, list[str]]) -> DataFrame:
    """Each row once for every slice it lies in, as slice_kind and slice_key: one pass serves all groupings."""
    keys = [F.struct(F.lit(k).alias("slice_kind"), (F.concat_ws("/", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("all")).alias("slice_key")) for k, cols in slices.items()]
    return df.withColumn("_slice", F.explode(F.array(*keys))).select("_slice.*", *df.columns)


def slice_metrics(df: DataFrame, slices: dict[str, list[str]]) -> DataFrame:
    """slice_kind, slice_key, n, accuracy, balanced_accuracy, auc of rows with y, pred and score."""
    rows, cell = sliced(df, slices), ["slice_kind", "slice_key"]
    plain = rows.groupBy(*cell).agg(F.count("*").alias("n"), accuracy().alias("accuracy"), balanced_accuracy().alias("balanced_accuracy"))
    return plain.join(auc(rows, cell).select(*cell, "auc"), cell)


def worst_cell(metrics: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    return metrics.groupBy("slice_kind").agg(F.min(metric).alias("worst"), F.min_by("slice_key", F.struct(metric, "slice_key")).alias("slice_key"))


def paired_accuracy(twins: DataFrame, slices: dict[str, list[str]]) -> DataFrame:
    return sliced(twins, slices).groupBy("slice_kind", "slice_key").agg(F.count("*").alias("n"), F.avg((F.col("delta") > 0).cast("double")).alias("paired_accuracy"))


def prediction_bias(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "y").agg(F.avg((F.col("pred") == 1).cast("double")).alias("predicted_evaluation"))


def wilson_lower(correct: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """Lower bound of the Wilson interval; null without trials."""
    n, p = total.cast("double"), F.try_divide(correct.cast("double"), total.cast("double"))
    return F.try_divide(p + z * z / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n))), 1 + z * z / n)


def apply_gates(metrics: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Each metric row with its gate: metrics (by, metric, value), thresholds (metric, op, bound) with op ``>=``, ``>`` or
    ``abs<=``. A null value fails. A small table of thresholds."""
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == ">=", v >= b).when(F.col("op") == ">", v > b).when(F.col("op") == "abs<=", F.abs(v) <= b)
    return metrics.join(thresholds, "metric").select(*by, "metric", "value", "op", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def verdicts(gates: DataFrame, by: list[str]) -> DataFrame:
    """All gates must pass: no pooled result makes up for a failing cell."""
    return gates.groupBy(*by).agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed_gates"))


def fit_spread(fit: DataFrame, by: str = "language") -> DataFrame:
    return fit.groupBy(by).agg(F.stddev_pop("score").alias("fit_sd"))


def control_ordering(controls: DataFrame, fit: DataFrame) -> DataFrame:
    """language, cue_family, auc, gap (means of evaluation minus deployment purpose) and offset (mean of all) in standard
    deviations of the fit."""
    rows = controls.withColumn("y", (F.col("intended_purpose") == "evaluation").cast("int"))
    cell = ["language", "cue_family"]
    means = rows.groupBy(*cell).agg(F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("e"), F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("d"), F.avg("score").alias("m"))
    return means.join(auc(rows, cell).select(*cell, "auc"), cell).join(fit_spread(fit), "language").select(*cell, "auc", ((F.col("e") - F.col("d")) / F.col("fit_sd")).alias("gap"), (F.col("m") / F.col("fit_sd")).alias("offset"))


def crossed_correct(controls: DataFrame, by: list[str]) -> DataFrame:
    want = F.col("intended_purpose") == "evaluation"
    return controls.groupBy(*by).agg(F.count_if((F.col("score") > 0) == want).alias("correct"), F.count("*").alias("n"))


def cue_effect(controls: DataFrame, fit: DataFrame) -> DataFrame:
    """language, cue_family, effect: mean score with the evaluation cue minus with the deployment cue, in fit deviations."""
    mean = lambda k: F.avg(F.when(F.col("lexical_cue") == k, F.col("score")))
    agg = controls.groupBy("language", "cue_family").agg((mean("evaluation") - mean("deployment")).alias("gap"))
    return agg.join(fit_spread(fit), "language").select("language", "cue_family", F.try_divide("gap", "fit_sd").alias("effect"))


def control_record(controls: DataFrame, fit: DataFrame) -> DataFrame:
    """auc_floor over pooled, surface and within-cue slices, and max_effect, for the whole bank."""
    rows = controls.withColumn("y", (F.col("intended_purpose") == "evaluation").cast("int"))
    base = ["cue_family", "language"]
    aucs = auc(sliced(rows, {"pooled": base, "surface": [*base, "surface"], "cue": [*base, "lexical_cue"]}), ["slice_kind", "slice_key"])
    return aucs.agg(F.min("auc").alias("auc_floor"), F.count("*").alias("slices")).crossJoin(cue_effect(controls, fit).agg(F.max(F.abs("effect")).alias("max_effect")))


def delta_effects(twins: DataFrame, scores: DataFrame, by: list[str], sd_by: list[str]) -> DataFrame:
    """by, n, mean_delta, sd, effect, min_delta: deltas against the spread of all scores of sd_by (a part of by)."""
    sd = scores.groupBy(*sd_by).agg(F.stddev_pop("score").alias("sd"))
    agg = twins.groupBy(*by).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"))
    return agg.join(sd, sd_by).withColumn("effect", F.try_divide("mean_delta", "sd"))


def recentred_accuracy(df: DataFrame, cell: list[str], pair: str) -> DataFrame:
    """cell, raw, recentred: balanced accuracy at zero, and after the median of each pair in the cell is taken off."""
    median = df.groupBy(*cell, pair).agg(F.percentile("score", 0.5).alias("_median"))
    rows = df.join(median, [*cell, pair]).withColumn("_raw", (F.col("score") > 0).cast("int")).withColumn("_own", (F.col("score") - F.col("_median") > 0).cast("int"))
    return rows.groupBy(*cell).agg(balanced_accuracy(pred="_raw").alias("raw"), balanced_accuracy(pred="_own").alias("recentred"))


def effective_n(df: DataFrame, group: list[str], features: str = "features") -> DataFrame:
    """n, distinct_vectors, distinct_fraction, within_share: part of the summed variance over all dimensions that lies
    within groups (of two rows or more)."""
    from .linalg import mean_and_variance, vector_sums

    total = F.aggregate(mean_and_variance()[1], F.lit(0.0), lambda s, v: s + v)
    whole = vector_sums(df, [], features).agg(F.first(total).alias("total"))
    each = vector_sums(df, group, features).where("n > 1").agg(F.avg(total).alias("within"))
    size = df.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(features)).alias("distinct_vectors"))
    return size.crossJoin(whole).crossJoin(each).select("n", "distinct_vectors", (F.col("distinct_vectors") / F.col("n")).alias("distinct_fraction"), F.try_divide("within", "total").alias("within_share"))


def core_record(df: DataFrame) -> DataFrame:
    """fold_floor, surface_floor, language_auc_floor, implicit, core_floor of rows with fold, language, surface,
    explicitness, y, pred, score."""
    cells = slice_metrics(df, {"fold": ["fold", "language"], "surface": ["surface", "language"], "language": ["language"], "explicitness": ["explicitness"]})
    floor = lambda kind, m: F.min(F.when(F.col("slice_kind") == kind, F.col(m)))
    agg = cells.agg(floor("fold", "balanced_accuracy").alias("fold_floor"), floor("surface", "balanced_accuracy").alias("surface_floor"), floor("language", "auc").alias("language_auc_floor"), F.min(F.when((F.col("slice_kind") == "explicitness") & (F.col("slice_key") == "implicit"), F.col("balanced_accuracy"))).alias("implicit"))
    return agg.withColumn("core_floor", F.least("fold_floor", "surface_floor", "implicit"))


def folds(items: DataFrame, family: str = "family_id") -> DataFrame:
    """held_out family, train and test counts."""
    n = items.groupBy(family).agg(F.count("*").alias("test"))
    return n.crossJoin(F.broadcast(items.agg(F.count("*").alias("all")))).select(F.col(family).alias("held_out"), (F.col("all") - F.col("test")).alias("train"), "test")


# -- rankings ------------------------------------------------------------------------------------------------------------


def best_layer(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """The layer with the largest metric; the lowest one among equals."""
    return df.groupBy(*by).agg(F.max_by("layer", F.struct(F.col(metric), -F.col("layer"))).alias("layer"), F.max(metric).alias(metric))


def relative_depth(layer: Column, n_layers: Column | int) -> Column:
    return layer / (n_layers - 1) * 100


def select_method(records: DataFrame) -> DataFrame:
    """The method that is eligible in all models with the largest core floor, then AUC floor, then smallest effect, then
    name. A top-one report."""
    n = records.agg(F.count_distinct("model").alias("_all"))
    agg = records.groupBy("method").agg(F.bool_and("eligible").alias("_ok"), F.count_distinct("model").alias("_n"), F.min("core_floor").alias("core_floor"), F.min("auc_floor").alias("auc_floor"), F.max("max_effect").alias("max_effect"))
    return agg.crossJoin(F.broadcast(n)).where("_ok and _n = _all").orderBy(F.desc("core_floor"), F.desc("auc_floor"), "max_effect", "method").limit(1).drop("_ok", "_n", "_all")


def top_cells(df: DataFrame, metrics: list[str], k: int = 8) -> DataFrame:
    """The k admissible cells with the largest minimum over the languages' metrics. k is the feature."""
    return df.where("admissible").withColumn("floor", F.least(*metrics)).orderBy(F.desc("floor"), *[c for c in ("layer", "position") if c in df.columns]).limit(k)


def rank_for_variance(singular_values: list[float], fraction: float) -> int:
    """The smallest number of leading values whose squares reach the fraction of all squares."""
    total, running = sum(s * s for s in singular_values), 0.0
    for i, s in enumerate(singular_values, 1):
        running += s * s
        if running >= fraction * total:
            return i
    return len(singular_values)


def admissible(sweep: DataFrame, aucs: list[str], least_distinct: float = 0.9, least_auc: float = 0.5) -> DataFrame:
    return sweep.withColumn("admissible", reduce(lambda a, c: a & (F.col(c) >= least_auc), aucs, F.col("distinct_fraction") > least_distinct))
