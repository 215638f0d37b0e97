"""Reader and rater evidence: blinded packets, votes, strata, screening, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_id
from .metrics import wilson_lower


def hash_sample(df: DataFrame, keys: list[str], k: int, salt: str, ident: str) -> DataFrame:
    """k rows of each cell, those with the smallest SHA-256 of salt and id. k is the feature."""
    order = F.sha2(F.concat_ws("|", F.lit(salt), F.col(ident).cast("string")), 256)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, ident))).where(F.col("_rank") <= k).drop("_rank")


def blind_packet(df: DataFrame, salt: str, ident: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The packet (blind_item_id, text), whose order by blind id tells nothing, and the key (blind_item_id, id, class)."""
    rows = df.withColumn("blind_item_id", hash_id("blind_", salt, F.col(ident)))
    return rows.select("blind_item_id", "text"), rows.select("blind_item_id", F.col(ident), F.col(label).alias("class"))


def majority(votes: DataFrame, item: str = "blind_item_id", rater: str = "rater_id", least: int = 1) -> DataFrame:
    """item, evaluation, deployment, majority, problem (tie, too few ratings, a rater twice)."""
    count = lambda k: F.count_if(F.col("prediction") == k)
    agg = votes.groupBy(item).agg(count("evaluation").alias("evaluation"), count("deployment").alias("deployment"), F.count("*").alias("_n"), F.count_distinct(rater).alias("_r"))
    e, d = F.col("evaluation"), F.col("deployment")
    problem = F.when(F.col("_n") != F.col("_r"), "rater twice").when(F.col("_n") < least, "too few").when(e == d, "tie")
    return agg.select(item, "evaluation", "deployment", F.when(e > d, "evaluation").when(d > e, "deployment").alias("majority"), problem.alias("problem"))


def reader_strata(df: DataFrame, by: list[str]) -> DataFrame:
    """by, items, correct, accuracy of each class, balanced_accuracy, gap, wilson: rows with class and prediction."""
    right = F.col("class") == F.col("prediction")
    own = lambda k: F.avg(F.when(F.col("class") == k, F.coalesce(right, F.lit(False)).cast("double")))
    agg = df.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(right).alias("correct"), own("evaluation").alias("accuracy_evaluation"), own("deployment").alias("accuracy_deployment"))
    a, b = F.col("accuracy_evaluation"), F.col("accuracy_deployment")
    return agg.withColumn("balanced_accuracy", F.coalesce((a + b) / 2, a, b)).withColumn("gap", F.abs(a - b)).withColumn("wilson", wilson_lower(F.col("correct"), F.col("items")))


def reader_surface(df: DataFrame) -> DataFrame:
    return df.groupBy("surface").agg(F.avg((F.col("class") == F.col("prediction")).cast("double")).alias("accuracy"))


def screen_readers(predictions: DataFrame, key: DataFrame, floor: float, item: str = "blind_item_id") -> DataFrame:
    """model_id, missing, min_accuracy, passed: the smallest accuracy over language x class must reach the floor, and every
    item of the key must be answered."""
    rows = predictions.join(key, item)
    cells = rows.groupBy("model_id", "language", "class").agg(F.avg((F.col("prediction") == F.col("class")).cast("double")).alias("a"), F.count_distinct(item).alias("n"))
    agg = cells.groupBy("model_id").agg(F.min("a").alias("min_accuracy"), F.sum("n").alias("n"))
    wanted = key.agg(F.count_distinct(item).alias("_all"))
    return agg.crossJoin(F.broadcast(wanted)).select("model_id", (F.col("_all") - F.col("n")).alias("missing"), "min_accuracy", ((F.col("min_accuracy") >= floor) & (F.col("_all") == F.col("n"))).alias("passed"))


def reader_summary(records: DataFrame, labels: tuple[str, ...] = ("evaluation", "deployment")) -> DataFrame:
    """model, predictions by label, retries, downgrades, providers."""
    return records.groupBy("model").agg(*[F.count_if(F.col("prediction") == k).alias(k) for k in labels], F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.count_if("downgraded").alias("downgrades"), F.array_sort(F.collect_set("provider")).alias("providers"))


def reader_eligibility(models: DataFrame, generators: DataFrame, least: int = 2) -> DataFrame:
    """model_id, problems: repeated id or lineage, a lineage that also generates, an attestation that is false; the last
    problem is for all if fewer than ``least`` are left."""
    n = models.groupBy("lineage").agg(F.count("*").alias("_lineage"))
    m = models.groupBy("model_id").agg(F.count("*").alias("_id"))
    used = generators.select("lineage").distinct().withColumn("_used", F.lit(True))
    rows = models.join(n, "lineage").join(m, "model_id").join(used, "lineage", "left")
    problems = F.array_compact(F.array(F.when(F.col("_id") > 1, "id twice"), F.when(F.col("_lineage") > 1, "lineage twice"), F.when(F.col("_used"), "generator"), F.when(~F.coalesce("attested", F.lit(False)), "attestation")))
    own = rows.select("model_id", problems.alias("problems"))
    few = own.agg((F.count_if(F.size("problems") == 0) < least).alias("_few"))
    return own.crossJoin(F.broadcast(few)).select("model_id", F.when(F.col("_few"), F.array_append("problems", F.lit("too few readers"))).otherwise(F.col("problems")).alias("problems"))


def unqualified(votes: DataFrame, raters: DataFrame) -> DataFrame:
    """Votes of raters who aren't qualified for the item's language. raters: rater_id, languages ARRAY<STRING>."""
    known = raters.select("rater_id", F.explode("languages").alias("language"))
    return votes.join(known, ["rater_id", "language"], "left_anti")
