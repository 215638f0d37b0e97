"""Registered queries of probe protocols. Their SQL fits the same objectives by accelerated gradient descent in a recursive query,
so it shares neither solver nor batching with the Spark side.

Stand-ins: rows of embeddings whose bit 1 of vec_id is 0 are fit rows (class label % 2), the others a bank of controls: bit 0 is the cue,
bit 2 the language, bit 3 the purpose, bit 4 the cue family, the rest the control block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fits, protocols
from .operators.matching import cue_differences
from .operators.probe import Recipe
from .queries import ITEMS, SQL, items, query, r6, table

# -- SQL of fits -----------------------------------------------------------------------------------------------------------


def descent(steps: int, big: float | str, small: str = "ridge") -> str:
    """CTE b (fit, w): minimisers of the objectives of t (fit, z, y, a, d: vector with a last coordinate of 1, or of 0 for differences; label;
    weight; whether a difference) with ridges of p (fit, ridge), by ``steps`` Nesterov steps for curvature from ``small`` (the intercept has no
    ridge) to ``big``."""
    zeros = "list_transform(z, lambda x: 0.0::DOUBLE)"
    return f"""g AS (SELECT 0 AS k, fit, {zeros} AS w, {zeros} AS v FROM (SELECT fit, any_value(z) AS z FROM t GROUP BY 1) UNION ALL
  SELECT k + 1, fit, nw, list_transform(generate_series(1, len(w)), lambda i: nw[i] + beta * (nw[i] - w[i])) FROM (
   SELECT k, fit, w, (sqrt({big} / {small}) - 1) / (sqrt({big} / {small}) + 1) AS beta, list_transform(generate_series(1, len(w)), lambda i: v[i] - (gr[i] + CASE WHEN i < len(w) THEN ridge * v[i] ELSE 0 END) / {big}) AS nw FROM (
    SELECT k, fit, any_value(w) AS w, any_value(v) AS v, list(gi ORDER BY i) AS gr FROM (
     SELECT k, fit, i, any_value(w) AS w, any_value(v) AS v, sum(r * zi) AS gi FROM (
      SELECT g.k, g.fit, g.w, g.v, t.a * CASE WHEN t.d THEN 2 * list_dot_product(t.z, g.v) ELSE 1 / (1 + exp(-list_dot_product(t.z, g.v))) - t.y END AS r, unnest(t.z) AS zi, generate_subscripts(t.z, 1) AS i FROM g JOIN t ON t.fit = g.fit WHERE g.k < {steps})
     GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN p USING (fit))), b AS (SELECT fit, w FROM g WHERE k = {steps})"""


def stats(rows: str, by: str) -> str:
    """Mean and deviation lists (m, s) by columns of rows with a list e of doubles."""
    return f"(SELECT {by}, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT {by}, i, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) + 1e-6 AS s FROM (SELECT {by}, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM {rows}) GROUP BY {by}, i) GROUP BY {by})"


MOVED = "list_transform(generate_series(1, len(e)), lambda i: (e[i] - m[i]) / s[i])"
AUC = "sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)"

BANK = """bank AS (SELECT vec_id, vec_id // 32 AS control_block_id, (vec_id // 2) % 2 = 0 AS fit_row, CASE WHEN vec_id % 2 = 0 THEN 'evaluation' ELSE 'deployment' END AS lexical_cue, CASE WHEN (vec_id // 4) % 2 = 0 THEN 'en' ELSE 'ja' END AS language,
 CASE WHEN (vec_id // 8) % 2 = 0 THEN 'evaluation' ELSE 'deployment' END AS intended_purpose, CASE WHEN (vec_id // 16) % 2 = 0 THEN 'noun' ELSE 'verb' END AS cue_family, CASE WHEN (vec_id // 32) % 2 = 0 THEN 'internal' ELSE 'external' END AS surface, label % 2 AS y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 st AS """ + stats("bank WHERE fit_row", "language") + f""", mv AS MATERIALIZED (SELECT bank.* EXCLUDE (e), {MOVED} AS e FROM bank JOIN st USING (language)),
 df AS MATERIALIZED (SELECT control_block_id, cue_family, language, intended_purpose, list_transform(generate_series(1, len(any_value(e))), lambda i: (max(e) FILTER (lexical_cue = 'evaluation'))[i] - (max(e) FILTER (lexical_cue = 'deployment'))[i]) AS e FROM mv WHERE NOT fit_row GROUP BY 1, 2, 3, 4 HAVING count(*) = 2 AND count(DISTINCT lexical_cue) = 2)"""  # fmt: skip


def bank(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fit rows and controls."""
    v = F.col("vec_id")
    bit = lambda k, a, b: F.when(F.floor(v / k) % 2 == 0, a).otherwise(b)
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.floor(v / 32).alias("control_block_id"), bit(2, True, False).alias("fit_row"), bit(1, "evaluation", "deployment").alias("lexical_cue"), bit(4, "en", "ja").alias("language"),
        bit(8, "evaluation", "deployment").alias("intended_purpose"), bit(16, "noun", "verb").alias("cue_family"), bit(32, "internal", "external").alias("surface"), (F.col("label") % 2).alias("y"), F.col("embedding").alias("features"),
    )
    return rows.where("fit_row").drop("fit_row"), rows.where("not fit_row").drop("fit_row", "y")


def training(fit: str, controls: str, differences: str, c: float, mass: str, penalty: str) -> str:
    """CTEs t and p from tables of (fit, y, e) and (fit, e), with weights as SQL."""
    one, zero = "list_append(e, 1.0)", "list_append(e, 0.0)"
    return f"""t AS MATERIALIZED (SELECT fit, {one} AS z, y::DOUBLE AS y, 1.0 / count(*) OVER (PARTITION BY fit) AS a, false AS d FROM {fit} UNION ALL SELECT fit, {one}, y::DOUBLE, {mass} / count(*) OVER (PARTITION BY fit), false FROM {controls}
  UNION ALL SELECT fit, {zero}, 0.0, {penalty} / count(*) OVER (PARTITION BY fit), true FROM {differences}), p AS (SELECT fit, 1.0 / ({c} * count(*)) AS ridge FROM {fit} GROUP BY 1)"""


# -- held-out families -------------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE " + ITEMS + """, f AS (SELECT DISTINCT family AS fit FROM items), r AS MATERIALIZED (SELECT fit, vec_id, family, language, y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM items, f), s AS """
       + stats("r WHERE family <> fit", "fit, language") + f""", z AS MATERIALIZED (SELECT fit, family, language, y, {MOVED} AS e FROM r JOIN s USING (fit, language)), {training("z WHERE family <> fit", "z WHERE false", "z WHERE false", 0.02, "0", "0")}, {descent(250, 16.5)}
 SELECT family, language, count(*) AS n, count(*) FILTER ((list_dot_product(list_append(e, 1.0), w) > 0) = (y = 1)) AS correct FROM z JOIN b USING (fit) WHERE family = fit GROUP BY 1, 2""")  # fmt: skip
def fold_scores(spark, d):
    """Each family scored by a fit of the others, standardised by language with their statistics."""
    scored = protocols.fold_scores(items(spark, d).drop("score", "pred"), 0.02)
    return scored.groupBy("family", "language").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("correct"))


# -- layers ------------------------------------------------------------------------------------------------------------------

_LAYERS = {0: "1, 64", 1: "33, 64"}


@query("WITH RECURSIVE " + ITEMS + """, a AS (SELECT 0 AS layer, * FROM items UNION ALL SELECT 1, * REPLACE (embedding[33:64] AS embedding) FROM items), f AS (SELECT DISTINCT family AS held FROM items),
 q AS (SELECT 'decorrelated' AS regime, true AS bench, true AS casual, true AS tb, true AS tc UNION ALL SELECT 'benchmark_to_casual', true, false, false, true),
 r AS MATERIALIZED (SELECT layer, regime, held, layer || '/' || regime || '/' || held AS fit, vec_id, block, family, purpose, format, (purpose = 'evaluation')::INT AS y, CASE WHEN format = 'benchmark' THEN bench ELSE casual END AND family <> held AS train, CASE WHEN format = 'benchmark' THEN tb ELSE tc END AND family = held AS test, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM a, f, q),
 s AS """ + stats("r WHERE train", "fit").replace(" + 1e-6", "") + f""", z AS MATERIALIZED (SELECT r.* EXCLUDE (e), {MOVED} AS e FROM r JOIN s USING (fit)), {training("z WHERE train", "z WHERE false", "z WHERE false", 0.02, "0", "0")}, {descent(250, 16.5)},
 o AS (SELECT layer, regime, block, purpose, format, y, list_dot_product(list_append(e, 1.0), w) AS score FROM z JOIN b USING (fit) WHERE test),
 u AS (SELECT a.layer, a.regime, {AUC} AS auc FROM o a JOIN o b ON a.layer = b.layer AND a.regime = b.regime AND a.y = 1 AND b.y = 0 GROUP BY 1, 2),
 w AS (SELECT layer, regime, block, format, max(score) FILTER (y = 1) - max(score) FILTER (y = 0) AS delta FROM o GROUP BY 1, 2, 3, 4 HAVING count(*) = 2 AND count(DISTINCT y) = 2),
 m AS (SELECT layer, regime, count(*) AS pairs, round(avg((delta > 0)::INT), 6) AS share_positive FROM w GROUP BY 1, 2)
 SELECT o.layer, o.regime, count(*) AS n, round((avg((score >= 0)::INT) FILTER (y = 1) + avg((score < 0)::INT) FILTER (y = 0)) / 2, 6) AS balanced_accuracy, round(any_value(auc), 4) AS auc, any_value(pairs) AS pairs, any_value(share_positive) AS share_positive,
 (SELECT round(count(DISTINCT embedding) / count(*), 6) FROM a WHERE a.layer = o.layer) AS distinct_fraction FROM o JOIN u ON u.layer = o.layer AND u.regime = o.regime JOIN m ON m.layer = o.layer AND m.regime = o.regime GROUP BY o.layer, o.regime""")  # fmt: skip
def layer_sweep(spark, d):
    """Two layers (all coordinates; the last 32) under two regimes, held out by family."""
    rows = items(spark, d).withColumn("item_id", F.col("vec_id")).withColumn("y", (F.col("purpose") == "evaluation").cast("int"))
    acts = rows.select("item_id", F.lit(0).alias("layer"), "features").unionByName(rows.select("item_id", F.lit(1).alias("layer"), F.slice("features", 33, 32).alias("features")))
    from .operators.probe import regime_rows

    regimes = {k: v for k, v in regime_rows(rows).items() if k in ("decorrelated", "benchmark_to_casual")}
    out = protocols.sweep(rows.drop("features", "score", "pred"), acts, regimes, 0.02)
    return out.select("layer", "regime", "n", r6("balanced_accuracy").alias("balanced_accuracy"), F.round("auc", 4).alias("auc"), "pairs", r6("share_positive").alias("share_positive"), r6("distinct_fraction").alias("distinct_fraction"))


# -- controls ----------------------------------------------------------------------------------------------------------------

_HELD = """k AS (SELECT DISTINCT control_block_id AS held FROM bank WHERE NOT fit_row), tf AS (SELECT held AS fit, y, e FROM mv, k WHERE fit_row),
 tc AS (SELECT held AS fit, (intended_purpose = 'evaluation')::INT AS y, e FROM mv, k WHERE NOT fit_row AND control_block_id <> held), td AS (SELECT held AS fit, e FROM df, k WHERE control_block_id <> held)"""


@query(f"""WITH RECURSIVE {BANK}, {_HELD}, {training("tf", "tc", "td", 0.005, "1.0", "0.25")}, {descent(200, 60)},
 o AS (SELECT fit, language, avg(list_dot_product(list_append(e, 1.0), w)) AS m, stddev_pop(list_dot_product(list_append(e, 1.0), w)) AS s FROM b JOIN mv ON fit_row GROUP BY 1, 2)
 SELECT control_block_id, count(*) AS n, count(*) FILTER ((list_dot_product(list_append(e, 1.0), w) > 0) = (intended_purpose = 'evaluation')) AS correct, round(avg((list_dot_product(list_append(e, 1.0), w) - m) / s), 2) AS mean_normalised, true AS converged
 FROM mv JOIN b ON b.fit = control_block_id JOIN o ON o.fit = b.fit AND o.language = mv.language WHERE NOT fit_row GROUP BY 1""")
def crossfit_controls(spark, d):
    """Every control scored by the fit whose controls and cue differences leave its block out."""
    fit, controls = bank(spark, d)
    scored = protocols.crossfit_controls(controls, fit, Recipe(1.0, 0.25), 0.005)
    correct = F.count_if((F.col("pred") == 1) == (F.col("intended_purpose") == "evaluation"))
    return scored.groupBy("control_block_id").agg(F.count("*").alias("n"), correct.alias("correct"), F.round(F.avg("normalised"), 2).alias("mean_normalised"), F.bool_and("converged").alias("converged"))


_RECORD = """u AS (SELECT a.wh, CASE j WHEN 0 THEN 'pooled' WHEN 1 THEN a.surface ELSE a.lexical_cue END AS slice, j, a.cue_family, a.language, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM o a JOIN o b ON a.wh = b.wh AND a.cue_family = b.cue_family AND a.language = b.language
  JOIN range(3) AS x(j) ON j = 0 OR j = 1 AND a.surface = b.surface OR j = 2 AND a.lexical_cue = b.lexical_cue WHERE a.intended_purpose = 'evaluation' AND b.intended_purpose = 'deployment' GROUP BY 1, 2, 3, 4, 5),
 e AS (SELECT o.wh, o.language, o.cue_family, abs(avg(score) FILTER (lexical_cue = 'evaluation') - avg(score) FILTER (lexical_cue = 'deployment')) / any_value(sp.sd) AS effect FROM o JOIN sp ON sp.wh = o.wh AND sp.language = o.language GROUP BY 1, 2, 3),
 rec AS (SELECT u.wh, min(auc) AS auc_floor, (SELECT max(effect) FROM e WHERE e.wh = u.wh) AS max_effect FROM u GROUP BY u.wh)"""


@query(f"""WITH RECURSIVE {BANK}, rc AS (SELECT 'plain' AS recipe, 0.0::DOUBLE AS mass, 0.0::DOUBLE AS penalty UNION ALL SELECT 'mass', 1.0, 0.0 UNION ALL SELECT 'penalty', 1.0, 18.0), k AS (SELECT recipe, mass, penalty, s.s AS source, recipe || '/' || s.s AS fit FROM rc, range(2) AS s(s)),
 tf AS (SELECT fit, y, e, mass, penalty FROM mv, k WHERE fit_row), tc AS (SELECT fit, (intended_purpose = 'evaluation')::INT AS y, e, mass FROM mv, k WHERE NOT fit_row AND control_block_id // 2 % 2 = source AND mass > 0), td AS (SELECT fit, e, penalty FROM df, k WHERE control_block_id // 2 % 2 = source AND penalty > 0),
 {training("tf", "tc", "td", 0.001, "mass", "penalty")}, {descent(600, "(CASE WHEN fit LIKE 'penalty%' THEN 420 ELSE 34 END)", "least(ridge, 0.3)")},
 sp AS (SELECT fit || '/' || (1 - source) AS wh, language, stddev_pop(list_dot_product(list_append(e, 1.0), w)) AS sd FROM b JOIN k USING (fit) JOIN mv ON fit_row GROUP BY 1, 2),
 o AS (SELECT fit || '/' || (1 - source) AS wh, mv.* EXCLUDE (fit_row), list_dot_product(list_append(e, 1.0), w) AS score FROM b JOIN k USING (fit) JOIN mv ON NOT fit_row AND control_block_id // 2 % 2 <> source), {_RECORD}
 SELECT split_part(wh, '/', 1) AS recipe, 'bank' || split_part(wh, '/', 2) AS source, 'bank' || split_part(wh, '/', 3) AS target, round(auc_floor, 3) AS auc_floor, round(max_effect, 2) AS max_effect, true AS eligible FROM rec""")
def reciprocal_banks(spark, d):
    """Three recipes by two banks of controls in one batch; each bank tests the fits of the other."""
    fit, controls = bank(spark, d)
    banks = {f"bank{k}": controls.where(F.floor(F.col("control_block_id") / 2) % 2 == k) for k in range(2)}
    out = protocols.reciprocal(banks, fit, {"plain": Recipe(), "mass": Recipe(1.0), "penalty": protocols.continued(1.0, 18.0)}, 0.001)
    return out.select("recipe", "source", "target", F.round("auc_floor", 3).alias("auc_floor"), F.round("max_effect", 2).alias("max_effect"), "eligible")


@query(f"""WITH RECURSIVE {BANK}, tf AS (SELECT 0 AS fit, y, e FROM mv WHERE fit_row), {training("tf", "tf WHERE false", "tf WHERE false", 0.005, "0", "0")}, {descent(200, 17)}
 SELECT language, cue_family, lexical_cue, count(*) AS n, count(*) FILTER (list_dot_product(list_append(e, 1.0), w) > 0) AS positive FROM mv, b WHERE NOT fit_row GROUP BY 1, 2, 3""")
def frozen_scores(spark, d):
    """Controls scored by the direction of all fit rows."""
    fit, controls = bank(spark, d)
    return protocols.score_frozen(fit, controls, 0.005).groupBy("language", "cue_family", "lexical_cue").agg(F.count("*").alias("n"), F.sum("pred").alias("positive"))


@query(f"""WITH RECURSIVE {BANK}, ax AS (SELECT language, list(v ORDER BY i) AS e FROM (SELECT language, i, avg(x) FILTER (lexical_cue = 'evaluation') - avg(x) FILTER (lexical_cue = 'deployment') AS v FROM (SELECT language, lexical_cue, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM mv WHERE NOT fit_row AND cue_family = 'noun') GROUP BY 1, 2) GROUP BY 1),
 q1 AS (SELECT list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS q FROM ax WHERE language = 'en'), h AS (SELECT list_transform(generate_series(1, len(e)), lambda i: e[i] - list_dot_product(e, q) * q[i]) AS e, q FROM ax, q1 WHERE language = 'ja'),
 q2 AS (SELECT q, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS q2 FROM h), fr AS MATERIALIZED (SELECT mv.* EXCLUDE (e), list_transform(generate_series(1, len(e)), lambda i: e[i] - list_dot_product(e, q) * q[i] - list_dot_product(e, q2) * q2[i]) AS e FROM mv, q2),
 tf AS (SELECT 0 AS fit, y, e FROM fr WHERE fit_row), {training("tf", "tf WHERE false", "tf WHERE false", 0.005, "0", "0")}, {descent(200, 17)}
 SELECT fit_row AS is_fit, language, count(*) AS n, count(*) FILTER (list_dot_product(list_append(e, 1.0), w) > 0) AS positive FROM fr, b WHERE fit_row OR cue_family = 'noun' GROUP BY 1, 2""")
def mean_axis_probe(spark, d):
    """A probe freed of the mean cue axes of one family (one a language), on fit rows and controls."""
    fit, controls = bank(spark, d)
    own, other = protocols.fit_probe(fit, controls.where("cue_family = 'noun'"), "mean", 0.005)
    both = own.select(F.lit(True).alias("is_fit"), "language", "pred").unionByName(other.select(F.lit(False).alias("is_fit"), "language", "pred"))
    return both.groupBy("is_fit", "language").agg(F.count("*").alias("n"), F.sum("pred").alias("positive"))


@query(f"""WITH {BANK}, n AS (SELECT control_block_id, count(*) AS own FROM df WHERE cue_family = 'noun' GROUP BY 1), b AS (SELECT DISTINCT control_block_id FROM bank WHERE NOT fit_row), a AS (SELECT sum(own) AS every FROM n)
 SELECT b.control_block_id, every - coalesce(own, 0) AS differences, least(every - coalesce(own, 0), 64) AS rank, true AS orthonormal, every - coalesce(own, 0) AS without_residual FROM b LEFT JOIN n USING (control_block_id), a""")
def rowspace_without_block(spark, d):
    """The row space of one family's cue differences without each block: its rank, whether its basis is orthonormal, and how many of the other
    blocks' differences it leaves nothing of."""
    fit, controls = bank(spark, d)
    blocks, at = fits.numbered(controls, "control_block_id")
    rows = fits.training_rows(fit, key="language").unionByName(protocols._difference_rows(cue_differences(controls.where("cue_family = 'noun'")).withColumn("_b", at), F.col("_b"))).cache()
    sd = protocols._deviations(rows)
    nameless = rows.where("role = 'difference' and block < 0").count()

    def judge(block, basis, triangle, others):
        n, zeros, low = others
        # all vectors of a whole space, and all rows that a triangle is of: what is left of it is more than what is left of each
        whole = len(basis) == basis.shape[1] and np.linalg.norm(np.eye(len(basis)) - basis.T @ basis, 2) < 1e-8
        known = whole or not nameless and (not n or np.linalg.norm(triangle - (triangle @ basis.T) @ basis, 2) < 1e-8 * low)
        flat = bool(np.allclose(basis @ basis.T, np.eye(len(basis)), atol=1e-9))
        return {"b": block, "rank": len(basis), "orthonormal": flat, "n": n, "gone": n - zeros if known and not nameless else None, "basis": None if known and not nameless else basis.ravel()}

    found = fits.held_out_spaces(rows, sd, len(blocks), None, judge, "b int, rank long, orthonormal boolean, n long, gone long, basis array<double>").cache()

    @F.pandas_udf("boolean")
    def left_nothing(x: pd.Series, key: pd.Series, basis: pd.Series) -> pd.Series:
        out = []
        for v, k, b in zip(x, key, basis, strict=True):
            v = np.array(v, float) / sd[k]
            b = np.array(b, float).reshape(-1, len(v))
            out.append(bool(np.linalg.norm(v - (v @ b.T) @ b) < 1e-8 * np.linalg.norm(v)))
        return pd.Series(out)

    # bases that don't say it of all rows at once are held against each row
    open_ = found.where("basis is not null").select("b", "basis").crossJoin(rows.where("role = 'difference'")).where("block <> b")
    each = open_.groupBy("b").agg(F.count_if(left_nothing("features", "key", "basis")).alias("_gone"))
    known = spark.createDataFrame([(k, int(v)) for k, v in enumerate(blocks)], "b int, control_block_id long")
    out = known.join(found.drop("basis"), "b").join(each, "b", "left")
    return out.select("control_block_id", (F.col("n") + nameless).alias("differences"), "rank", "orthonormal", F.coalesce("gone", "_gone", F.lit(0)).cast("long").alias("without_residual"))


@query(f"""WITH RECURSIVE {BANK}, k AS (SELECT 'narrow' AS fit, 32 AS w UNION ALL SELECT 'wide', 64), tf AS (SELECT fit, y, e[1:k.w] AS e FROM mv, k WHERE fit_row), tc AS (SELECT fit, (intended_purpose = 'evaluation')::INT AS y, e[1:k.w] AS e FROM mv, k WHERE NOT fit_row AND control_block_id % 2 = 0), td AS (SELECT fit, e[1:k.w] AS e FROM df, k WHERE control_block_id % 2 = 0),
 {training("tf", "tc", "td", 0.005, "1.0", "0.25")}, {descent(250, 60)}, sp AS (SELECT fit AS wh, language, stddev_pop(list_dot_product(list_append(e[1 : len(b.w) - 1], 1.0), b.w)) AS sd FROM b JOIN mv ON fit_row GROUP BY 1, 2),
 o AS (SELECT fit AS wh, mv.* EXCLUDE (fit_row), list_dot_product(list_append(e[1 : len(b.w) - 1], 1.0), b.w) AS score FROM b JOIN mv ON NOT fit_row AND control_block_id % 2 = 1), {_RECORD},
 gates AS (SELECT wh AS model, (auc_floor < 0.3)::INT + (max_effect > 0.25)::INT AS failed FROM rec) SELECT model, bool_and(failed = 0) AS passed, sum(failed)::BIGINT AS failed_gates FROM gates GROUP BY GROUPING SETS ((model), ())""")
def confirm_models(spark, d):
    """Two models (all coordinates; the first 32) in one batch: fitted on even control blocks, confirmed on odd ones."""
    fit, controls = bank(spark, d)
    narrow = lambda df: df.withColumn("features", F.slice("features", 1, 32))
    both = lambda df: {"wide": df, "narrow": narrow(df)}
    limits = spark.createDataFrame([("auc_floor", ">=", 0.3), ("max_effect", "abs<=", 0.25)], "metric string, op string, bound double")
    return protocols.confirm(both(fit), both(controls.where("control_block_id % 2 = 0")), both(controls.where("control_block_id % 2 = 1")), Recipe(1.0, 0.25), 0.005, limits)


# -- SQL of queries that stand in queries.py ---------------------------------------------------------------------------------


def out_of_fold_sql(regimes: dict[str, tuple[str, str]], label: str, steps: int = 400) -> str:
    """CTEs up to o (regime, the items' columns, y, score): every family scored by fits of the others, standardised by all rows of the fit."""
    cases = " UNION ALL ".join(f"SELECT '{r}' AS regime, items.* REPLACE ({label} AS y), {a} AS _train, {b} AS _test FROM items" for r, (a, b) in regimes.items())
    return "WITH RECURSIVE " + ITEMS + f""", q AS ({cases}), f AS (SELECT DISTINCT family AS held FROM items),
 r AS MATERIALIZED (SELECT q.* EXCLUDE (embedding, score, pred, _train, _test), regime || '/' || held AS fit, _train AND family <> held AS train, _test AND family = held AS test, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM q, f),
 s AS {stats("r WHERE train", "fit").replace(" + 1e-6", "")}, z AS MATERIALIZED (SELECT r.* EXCLUDE (e), {MOVED} AS e FROM r JOIN s USING (fit) WHERE train OR test), {training("z WHERE train", "z WHERE false", "z WHERE false", 0.1, "0", "0")}, {descent(steps, 16.5)},
 o AS (SELECT regime, language, purpose, format, y, list_dot_product(list_append(e, 1.0), w) AS score FROM z JOIN b USING (fit) WHERE test)"""


def slice_sql(slices: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS slice_kind, {key} AS slice_key, y, score FROM o" for k, key in slices.items())
    return f""", x AS ({each}), gs AS (SELECT slice_kind, slice_key, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM x GROUP BY 1, 2, 3), h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY slice_kind, slice_key ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs),
 u AS (SELECT slice_kind, slice_key, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM h GROUP BY 1, 2)
 SELECT slice_kind, slice_key, count(*) AS n, round(avg(((score >= 0)::INT = y)::INT), 6) AS accuracy, round((coalesce(avg((score >= 0)::INT) FILTER (y = 1), avg((score < 0)::INT) FILTER (y = 0)) + coalesce(avg((score < 0)::INT) FILTER (y = 0), avg((score >= 0)::INT) FILTER (y = 1))) / 2, 6) AS balanced_accuracy, round(any_value(auc), 3) AS auc FROM x JOIN u USING (slice_kind, slice_key) GROUP BY 1, 2"""


_E, _B = "purpose = 'evaluation'", "format = 'benchmark'"
SQL["format_probe"] = out_of_fold_sql({"format": ("true", "true")}, f"({_B})::INT") + slice_sql({"regime": "regime"})
SQL["probe_regimes"] = out_of_fold_sql({"standard_confounded": (f"({_E}) = ({_B})", "true"), "decorrelated": ("true", "true"), "benchmark_to_casual": (_B, f"NOT {_B}"), "casual_to_benchmark": (f"NOT {_B}", _B)}, f"({_E})::INT") + slice_sql({"regime": "regime", "cell": "regime || '/' || purpose || '/' || format"})
SQL["transfer_by_language"] = out_of_fold_sql({"en": ("language = 'en'", "true"), "ja": ("language = 'ja'", "true")}, "y") + """
 SELECT regime AS fit_on, language AS test_on, round((avg((score >= 0)::INT) FILTER (y = 1) + avg((score < 0)::INT) FILTER (y = 0)) / 2, 6) AS balanced_accuracy FROM o GROUP BY 1, 2"""
SQL["direction_cosines"] = "WITH RECURSIVE " + ITEMS + f""", r AS MATERIALIZED (SELECT format AS fit, y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM items), s AS {stats("r", "fit")}, z AS MATERIALIZED (SELECT fit, y, {MOVED} AS e FROM r JOIN s USING (fit)),
 {training("z", "z WHERE false", "z WHERE false", 0.1, "0", "0")}, {descent(500, 16.5)}, d AS (SELECT fit, w[1 : len(w) - 1] AS w FROM b) SELECT a.fit AS "left", c.fit AS "right", round(list_cosine_similarity(a.w, c.w), 3) AS cosine FROM d a, d c"""
