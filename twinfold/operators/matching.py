"""Joins and matching: twins, matched pairs, alignment, keys, freshness, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_topics(payloads: DataFrame, topics: DataFrame) -> DataFrame:
    """payload_block_id, problem: an unknown topic, or a task family that isn't the topic's."""
    known = topics.select("topic_id", F.col("task_family").alias("_family"))
    problem = F.when(F.col("_family").isNull(), "unknown topic").when(F.col("_family") != F.col("task_family"), "task family")
    return payloads.join(known, "topic_id", "left").select("payload_block_id", problem.alias("problem")).where("problem is not null")


def block_cover(items: DataFrame, payloads: DataFrame, key: str = "payload_block_id") -> DataFrame:
    """key, problem: blocks without a payload (``extra``) and payloads without a block (``missing``)."""
    extra = items.select(key).join(payloads, key, "left_anti").distinct().withColumn("problem", F.lit("extra"))
    return extra.unionByName(payloads.select(key).join(items, key, "left_anti").distinct().withColumn("problem", F.lit("missing")))


def align(items: DataFrame, activations: DataFrame, key: str = "item_id") -> DataFrame:
    """key, problem: items without exactly one vector, and vectors without an item."""
    a = activations.groupBy(key).agg(F.count("*").alias("n"))
    both = items.select(key).withColumn("i", F.lit(1)).join(a, key, "full_outer")
    problem = F.when(F.col("i").isNull(), "no item").when(F.col("n").isNull(), "no vector").when(F.col("n") > 1, "several vectors")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def twins(df: DataFrame, block: list[str], kind: str = "purpose", value: str = "score", first: str = "evaluation", second: str = "deployment") -> DataFrame:
    """block, first, second, delta of blocks with exactly one row of each kind."""
    of = lambda k: F.col(kind) == k
    agg = df.groupBy(*block).agg(F.count("*").alias("_n"), F.max(F.when(of(first), F.col(value))).alias(first), F.max(F.when(of(second), F.col(value))).alias(second), F.count_if(of(first)).alias("_a"), F.count_if(of(second)).alias("_b"))
    return agg.where("_n = 2 and _a = 1 and _b = 1").withColumn("delta", F.col(first) - F.col(second)).drop("_n", "_a", "_b")


def cue_differences(controls: DataFrame, features: str = "features") -> DataFrame:
    """Vector of the evaluation cue minus vector of the deployment cue, for each block, family, language and purpose with
    exactly one row of each."""
    keys = ["control_block_id", "cue_family", "language", "intended_purpose"]
    of = lambda k: F.col("lexical_cue") == k
    agg = controls.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.when(of("evaluation"), F.col(features)), True).alias("_e"), F.first(F.when(of("deployment"), F.col(features)), True).alias("_d"))
    return agg.where("_n = 2 and _e is not null and _d is not null").select(*keys, F.zip_with("_e", "_d", lambda x, y: x.cast("double") - y.cast("double")).alias("difference"))


def language_groups(items: DataFrame, keys: list[str], languages: tuple[str, str] = ("en", "ja")) -> DataFrame:
    """keys and the item of each language, for groups that have all languages."""
    wide = items.groupBy(*keys).pivot("language", list(languages)).agg(F.min("item_id"))
    return wide.where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in languages]))


def matched_pairs(items: DataFrame) -> DataFrame:
    """job_id, pair_id, evaluation, deployment, same_payload."""
    of = lambda k: F.max(F.when(F.col("class") == k, F.col("item_id"))).alias(k)
    return items.groupBy("job_id", "pair_id").agg(of("evaluation"), of("deployment"), (F.count_distinct("content_sha256") == 1).alias("same_payload"))


def freshness(new: DataFrame, spent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that occur in a spent bank, compared by the given columns."""
    return new.join(spent.select(*keys).distinct(), keys, "left_semi")


def spent_passages(new: DataFrame, spent: DataFrame, ident: str, width: int = 8, text: str = "text") -> DataFrame:
    """ident, windows, shared of each row of new that shares a run of ``width`` words (all its words, if it has fewer) with
    a text of spent: how many different runs it has, and how many of them occur. Whole texts count on both sides, ASCII
    letters without case. Runs are 64-bit hashes, distinct before they meet, so a common one is no large group; no pairs of
    texts are made. Texts without words share nothing."""

    def runs(n: Column | int) -> Column:
        last = F.size("_w") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, n))))

    def words(df: DataFrame, *keep: str) -> DataFrame:
        plain = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return df.select(*keep, F.filter(F.split(plain, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "").alias("_w")).where("size(_w) > 0")

    own = words(new, ident).withColumn("_n", F.least(F.size("_w"), F.lit(width)))
    widths = sorted(r[0] for r in own.select("_n").distinct().collect())  # at most width numbers
    own = own.select(ident, F.explode(runs(F.col("_n"))).alias("_run")).distinct()
    found = [words(spent).select(F.explode(runs(F.lit(n))).alias("_run")) for n in widths]
    if not found:
        return own.select(ident, F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("shared"))
    met = reduce(DataFrame.unionByName, found).distinct().withColumn("_met", F.lit(1))
    counted = own.join(met, "_run", "left").groupBy(ident).agg(F.count("*").alias("windows"), F.count("_met").alias("shared"))
    return counted.where("shared > 0")


def normalised_cue_line(line: Column, term: Column) -> Column:
    return F.replace(F.lower(line), F.lower(term), F.lit("{cue_term}"))


def pairwise_wins(df: DataFrame, cell: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """cell, wins, pairs: positives above negatives, ties counting a half, by ranks: rows of equal score are summed
    first, and running sums of negatives replace the join of all with all."""
    from .metrics import rank_sums

    return rank_sums(df, cell, y, score).select(*cell, F.col("wins"), (F.col("p") * F.col("n")).alias("pairs"))


def join_key(results: DataFrame, key: DataFrame, item: str = "blind_item_id", labels: tuple[str, ...] = ("evaluation", "deployment")) -> DataFrame:
    """Predictions with the true class and ``problem``: an unknown item, or a label outside the domain."""
    problem = F.when(F.col("class").isNull(), "unknown item").when(~F.coalesce(F.col("prediction").isin(*labels), F.lit(False)), "label")
    return results.join(key, item, "left").withColumn("problem", problem)


def flatten_strings(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, pointer, text: each string value and each name of a nested JSON document, with a JSON pointer."""

    def walk(batches):
        import json as parser

        import pandas as pd

        def strings(value, at: str):
            if isinstance(value, str):
                yield at, value
            elif isinstance(value, dict):
                for k, v in value.items():
                    own = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
                    yield f"{own}#name", k
                    yield from strings(v, own)
            elif isinstance(value, list):
                for i, v in enumerate(value):
                    yield from strings(v, f"{at}/{i}")

        for pdf in batches:
            rows = [(k, at, text) for k, doc in zip(pdf[key], pdf[json], strict=True) if doc is not None for at, text in strings(parser.loads(doc), "")]
            yield pd.DataFrame(rows, columns=[key, "pointer", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, json).mapInPandas(walk, f"{key} {kind}, pointer string, text string")


def stack(**tables: DataFrame) -> DataFrame:
    """All rows of the tables, with the table's name as ``context``."""
    return reduce(DataFrame.unionByName, [df.withColumn("context", F.lit(k)) for k, df in tables.items()])


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, and the keys that occur more often on that side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def intersect_pass(cells: DataFrame, keys: list[str], model: str = "model", flag: str = "passed") -> DataFrame:
    """Cells that pass in every model there is."""
    n = cells.agg(F.count_distinct(model).alias("_all"))
    return cells.groupBy(*keys).agg(F.bool_and(flag).alias("_ok"), F.count_distinct(model).alias("_n")).crossJoin(F.broadcast(n)).where("_ok and _n = _all").select(*keys)
