"""Attempt ledgers: append-only records folded into budgets, feedback and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that use up the two budgets, and the prefix that marks an infrastructure failure in old records.
GENERATION_STATUSES = ("accepted", "semantic_rejection", "generator_output_rejection")
SEMANTIC_STATUSES = ("accepted", "semantic_rejection")
LEGACY_STATUS = "generator_or_deterministic_rejection"
LEGACY_PREFIX = "OpenRouter "
FEEDBACK_STATUSES = ("generator_output_rejection", "validator_output_rejection", "semantic_rejection", LEGACY_STATUS)


def uses_generation(status: Column, error: Column) -> Column:
    infrastructure = F.coalesce(error.startswith(LEGACY_PREFIX), F.lit(False))
    return F.coalesce(status.isin(*GENERATION_STATUSES) | ((status == LEGACY_STATUS) & ~infrastructure), F.lit(False))


def uses_semantic(status: Column) -> Column:
    return F.coalesce(status.isin(*SEMANTIC_STATUSES), F.lit(False))


def attempt_counts(attempts: DataFrame, key: str = "payload_block_id") -> DataFrame:
    """key, generation, semantic: attempts of each work item that use up each budget."""
    return attempts.groupBy(key).agg(F.count_if(uses_generation(F.col("status"), F.col("error"))).alias("generation"), F.count_if(uses_semantic(F.col("status"))).alias("semantic"))


def pending(requests: DataFrame, counts: DataFrame, accepted: DataFrame, max_generation: int, max_semantic: int, key: str = "payload_block_id") -> DataFrame:
    """Requests without an accepted result and with both budgets left."""
    left = requests.join(accepted.select(key), key, "left_anti").join(counts, key, "left")
    return left.where((F.coalesce("generation", F.lit(0)) < max_generation) & (F.coalesce("semantic", F.lit(0)) < max_semantic)).drop("generation", "semantic")


def exhaustion(counts: DataFrame, max_generation: int, max_semantic: int) -> DataFrame:
    """counts with ``reason``: which budget is used up, or null."""
    g, s = F.col("generation") >= max_generation, F.col("semantic") >= max_semantic
    return counts.withColumn("reason", F.when(g & s, "semantic_and_generation_budgets").when(s, "semantic_budget").when(g, "generation_budget"))


def _concerns(issues: Column) -> Column:
    return F.transform(issues, lambda x: F.concat(x.code, F.lit(": "), x.message))


def _failed(checks: Column) -> Column:
    return F.map_keys(F.map_filter(checks, lambda _, ok: ~ok))


def latest_feedback(attempts: DataFrame, key: str = "payload_block_id", order: str = "seq") -> DataFrame:
    """key, feedback of the last rejection: its issues, else its failed checks, else its verdict, else its error.
    attempts: validation STRUCT<verdict, confidence, checks MAP<STRING, BOOLEAN>, issues ARRAY<STRUCT<code, message>>>."""
    rejected = attempts.where(F.col("status").isin(*FEEDBACK_STATUSES) & ~F.coalesce(F.col("error").startswith(LEGACY_PREFIX), F.lit(False)))
    last = rejected.groupBy(key).agg(F.max_by(F.struct("validation", "error"), order).alias("last"))
    v = F.col("last.validation")
    text = (
        F.when(v.isNull(), F.nullif(F.col("last.error"), F.lit("")))
        .when(F.size(v.issues) > 0, F.array_join(_concerns(v.issues), "; "))
        .when(F.size(_failed(v.checks)) > 0, F.concat(F.lit("Failed checks: "), F.array_join(_failed(v.checks), ", ")))
        .otherwise(F.format_string("Validator verdict=%s confidence=%s", v.verdict, v.confidence))
    )
    return last.select(key, text.alias("feedback"))


def prior_concerns(attempts: DataFrame, key: str = "payload_block_id", order: str = "seq") -> DataFrame:
    """key, concerns: the distinct concerns of all semantic rejections in the order they were first seen; a rejection
    without issues gives its failed checks."""
    v = F.col("validation")
    own = F.when(F.coalesce(F.size(v.issues), F.lit(0)) > 0, F.filter(_concerns(v.issues), lambda x: x.isNotNull())).otherwise(F.transform(_failed(v.checks), lambda c: F.concat(F.lit("failed_check: "), c)))
    each = attempts.where((F.col("status") == "semantic_rejection") & v.isNotNull()).select(key, order, F.posexplode(own).alias("pos", "concern"))
    first = each.groupBy(key, "concern").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "concern"))), lambda x: x.concern).alias("concerns"))


def run_report(requests: DataFrame, accepted: DataFrame, reasons: DataFrame, key: str = "payload_block_id") -> DataFrame:
    """targeted, accepted, exhausted, status."""
    done, spent = accepted.select(key).distinct().withColumn("done", F.lit(1)), reasons.where("reason is not null").select(key).withColumn("spent", F.lit(1))
    rows = requests.select(key).join(done, key, "left").join(spent, key, "left")
    out = rows.agg(F.count("*").alias("targeted"), F.count("done").alias("accepted"), F.count_if(F.col("spent").isNotNull() & F.col("done").isNull()).alias("exhausted"))
    return out.withColumn("status", F.when(F.col("targeted") == F.col("accepted"), "completed").otherwise("completed_with_exhausted"))


def progress(states: DataFrame, by: str = "language", settled: tuple[str, ...] = ("accepted", "rejected")) -> DataFrame:
    """Jobs, settled share and acceptance of the settled jobs, by language and over all."""
    ok = F.col("status").isin(*settled)
    return states.rollup(by).agg(F.count("*").alias("jobs"), F.count_if(ok).alias("settled"), F.count_if(F.col("status") == "accepted").alias("accepted")).withColumn("settled_share", F.try_divide("settled", "jobs")).withColumn("acceptance", F.try_divide("accepted", "settled"))


def heterogeneous(records: DataFrame) -> DataFrame:
    """model, settings, served of models whose records don't share one settings hash and one served model."""
    return records.groupBy("model").agg(F.array_sort(F.collect_set("settings_sha256")).alias("settings"), F.array_sort(F.collect_set("served_model")).alias("served")).where("size(settings) > 1 or size(served) > 1")


def resolve_revision(records: DataFrame) -> DataFrame:
    """model, revision: the served model and the date of the earliest completion."""
    return records.groupBy("model").agg(F.concat(F.min_by("served_model", "completed_at"), F.lit("@"), F.date_format(F.min("completed_at"), "yyyy-MM-dd")).alias("revision"))


def qc_replay(now: DataFrame, before: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Counts of candidates that passed or failed old and new rules (passed BOOLEAN in both)."""
    both = now.select(key, F.col("passed").alias("new")).join(before.select(key, F.col("passed").alias("old")), key, "left")
    return both.agg(F.count("*").alias("candidates"), F.count_if(F.col("new") & F.col("old")).alias("still_pass"), F.count_if(F.col("new") & ~F.col("old")).alias("now_pass"), F.count_if(~F.col("new") & F.col("old")).alias("now_fail"), F.count_if(~F.col("new") & ~F.col("old")).alias("still_fail"), F.count_if(F.col("old").isNull()).alias("unseen"))


def run_attempts(pending_rows: DataFrame, call, schema: str) -> DataFrame:
    """Pending rows with what the user's function adds: ``call`` takes an iterator of pandas frames and gives frames of
    ``schema``, once for each partition. It may call a model; no client is shipped."""
    return pending_rows.mapInPandas(call, schema)


def revalidate_accepted(accepted: DataFrame, verdict: str = "validation") -> DataFrame:
    """Accepted rows without a passing, consistent verdict, with their errors."""
    from .checks import verdict_errors, verdict_passes

    rows = verdict_errors(accepted, verdict)
    return rows.where(F.col(verdict).isNull() | (F.size("errors") > 0) | ~verdict_passes(F.col(verdict)))
