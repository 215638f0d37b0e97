"""Probes against an independent Newton solver, the shortcut test, subspaces, resampling, streams."""

import numpy as np
from pyspark.sql import functions as F

from twinfold.operators import fits, linalg, matching, metrics, probe, protocols, resample


def newton(x, y, c):
    n, d = x.shape
    a, theta = np.hstack([x, np.ones((n, 1))]), np.zeros(d + 1)
    ridge = np.diag([1 / c] * d + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ theta))
        theta -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ theta)
    return theta


def shortcut_items(spark, blocks=10):
    rng, rows = np.random.default_rng(0), []
    for b in range(blocks):
        for p, purpose in enumerate(("deployment", "evaluation")):
            for f, fmt in enumerate(("casual", "benchmark")):
                x = rng.normal(0, 0.05, 8)
                x[0] += 2 * p - 1
                x[1:4] += 3 * (2 * f - 1)
                rows.append((f"{b}-{p}-{f}", b, b % 5, purpose, fmt, p, [float(v) for v in x]))
    return spark.createDataFrame(rows, "item_id string, block int, family int, purpose string, format string, y int, features array<double>")


def test_fit_is_the_sklearn_objective(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    df = spark.createDataFrame([(list(map(float, a)), float(b), [0], "fit") for a, b in zip(x, y, strict=True)], "features array<double>, y double, fits array<int>, role string")
    fit = probe.fit_many(df, 1, [0.3], tolerance=1e-9)[0]
    z = (x - x.mean(0)) / x.std(0)
    assert fit.converged and np.allclose([*fit.weight, fit.intercept], newton(z, y, 0.3), atol=1e-5)


def test_shortcut(spark):
    items = shortcut_items(spark)
    scored = probe.out_of_fold(items, probe.regime_rows(items))
    got = {r.slice_key: r for r in metrics.slice_metrics(scored, {"regime": ["regime"]}).collect()}
    assert got["decorrelated"].balanced_accuracy > 0.95 and got["decorrelated"].auc > 0.95
    cells = metrics.cell_rates(scored.where("regime = 'standard_confounded'")).collect()
    rate = {(r.purpose, r.format): r.percent_predicted_evaluation for r in cells}
    assert rate["deployment", "benchmark"] > 50 > rate["evaluation", "casual"]


def test_auc_turns_with_the_sign(spark):
    rows = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 0.3), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 1.0)], "c string, y int, score double")
    up = {r.c: r.auc for r in metrics.auc(rows, ["c"]).collect()}
    down = {r.c: r.auc for r in metrics.auc(rows.withColumn("score", -F.col("score")), ["c"]).collect()}
    assert up == {"a": 0.875, "b": None} and down["a"] == 1 - up["a"]


def test_projection_takes_differences_off(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i int, difference array<double>").repartition(5)
    basis = linalg.rowspace_basis(df)
    assert basis.shape == (3, 12)
    left = np.array([r.difference for r in linalg.project_out(df, basis, "difference").collect()])
    assert np.abs(left).max() < 1e-9
    s = np.linalg.svd(linalg.triangle(df, "difference"))[1]
    assert np.allclose(s[:3], np.linalg.svd(x)[1][:3])


def controls(spark, blocks=4):
    rng, rows = np.random.default_rng(3), []
    for b in range(blocks):
        for p in ("evaluation", "deployment"):
            for cue in ("evaluation", "deployment"):
                x = rng.normal(0, 0.1, 6)
                x[0] += 1 if p == "evaluation" else -1
                x[1] += 2 if cue == "evaluation" else -2
                rows.append((f"b{b}", "verb", "en", p, cue, "external", [float(v) for v in x]))
    return spark.createDataFrame(rows, "control_block_id string, cue_family string, language string, intended_purpose string, lexical_cue string, surface string, features array<double>")


def test_penalty_shrinks_the_cue_effect(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (60, 6))
    y = (np.arange(60) % 2).astype(float)
    x[:, 0] += 2 * y - 1
    x[:, 1] += 2 * y - 1
    fit = spark.createDataFrame([("en", list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "language string, features array<double>, y double")
    bank = controls(spark)
    rows, diffs = bank.withColumn("y", (F.col("intended_purpose") == "evaluation").cast("double")), matching.cue_differences(bank)
    effect = {}
    for name, recipe in {"plain": probe.Recipe(), "penalty": probe.Recipe(1.0, 4.0, (1.0,))}.items():
        model = protocols.fit_penalised(fit, rows, diffs, recipe, 0.5)
        assert model.converged
        effect[name] = abs(metrics.cue_effect(fits.score_batch(bank, [model], F.lit(0)), fits.score_batch(fit, [model], F.lit(0))).first().effect)
    assert effect["penalty"] < effect["plain"] / 3


def test_projected_probes_and_folds(spark):
    items = shortcut_items(spark).withColumn("language", F.lit("en"))
    scored = protocols.fold_scores(items, 0.1)
    assert scored.count() == 40 and metrics.slice_metrics(scored, {"all": []}).first().auc > 0.95
    bank = controls(spark)
    fit = items.withColumn("features", F.slice("features", 1, 6))
    gap = {}
    for method in ("none", "svd", "mean"):
        own, other = protocols.fit_probe(fit, bank, method, 0.5)
        gap[method] = abs(metrics.cue_effect(other, own).first().effect)
    assert max(gap["svd"], gap["mean"]) <= gap["none"] + 1e-6
    limits = spark.createDataFrame([("auc_floor", ">=", 0.9), ("max_effect", "abs<=", 5.0)], "metric string, op string, bound double")
    got = {r.model: r.passed for r in protocols.confirm({"m": fit}, {"m": bank}, {"m": bank}, probe.Recipe(1.0, 1.0), 0.5, limits).collect()}
    assert got == {"m": True, None: True}


def test_split_weights_are_multinomial(spark):
    w = resample.cluster_weights(np.arange(300), 300, 4000, 1)
    assert (w.sum(0) == 300).all() and abs(w.mean() - 1) < 1e-9
    # variance 1 - 1/n of each cluster, covariance -1/n, and no order effect
    assert np.abs(w.var(1) - 1).max() < 0.15 and abs(np.corrcoef(w[:150].sum(0), w[150:].sum(0))[0, 1] + 1) < 1e-9
    assert abs(w[::2].sum(0).var() / 75 - 1) < 0.1 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    # any part of the clusters has the weights that it has in the whole
    some = np.array([0, 7, 149, 150, 299])
    assert (resample.cluster_weights(some, 300, 4000, 1) == w[some]).all()
    assert (resample.cluster_weights(some, 300, 4000, 2) != w[some]).any()


def test_intervals_are_those_of_copied_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "WEIGHED_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(int(c), int(y), float(np.round(s, 1)), int(s > 0), "ab"[c % 2]) for c, y, s in zip(rng.integers(0, 20, 200), rng.integers(0, 2, 200), rng.normal(size=200), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1, 9.0, 1, "a")], "c int, y int, score double, pred int, k string").repartition(6)
    cs, ys, ss, ps, ks = map(np.array, zip(*rows, strict=True))
    w = resample.cluster_weights(np.arange(20), 20, 300, 4)
    auc, bacc, mean = [], [], {"a": [], "b": []}
    for r in range(300):
        v = w[cs, r].astype(float)
        pos, neg = ys == 1, ys == 0
        win = (ss[pos][:, None] > ss[neg]) + 0.5 * (ss[pos][:, None] == ss[neg])
        auc.append(v[pos] @ win @ v[neg] / v[pos].sum() / v[neg].sum())
        bacc.append(np.mean([(v * (ps == k))[ys == k].sum() / v[ys == k].sum() for k in (0, 1)]))
        for k in mean:
            mean[k].append((v * ss)[ks == k].sum() / v[ks == k].sum())
    got = resample.cluster_auc_interval(df, "c", 300, 4).first()
    assert np.allclose([got.low, got.high], np.percentile(auc, [2.5, 97.5]))
    got = resample.cluster_recall_interval(df, "c", 300, 4).first()
    assert np.allclose([got.low, got.high], np.percentile(bacc, [2.5, 97.5]))
    for r in resample.cluster_interval(df, "c", {"_v": F.col("score"), "_n": F.lit(1)}, F.col("_v") / F.col("_n"), 300, 4, ["k"]).collect():
        assert np.allclose([r.low, r.high], np.percentile(mean[r.k], [2.5, 97.5]))


def test_gates_are_conjunctive(spark):
    rows = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.4)], "model string, metric string, value double")
    limits = spark.createDataFrame([("a", ">=", 0.5), ("b", ">=", 0.5)], "metric string, op string, bound double")
    assert metrics.verdicts(metrics.apply_gates(rows, limits, ["model"]), ["model"]).first().passed is False


def test_progress_stream(spark, tmp_path):
    """Changes of status add up to the counts, over a restart."""
    from pyspark.sql import types as T

    from twinfold.streaming import progress

    schema = T.StructType().add("job_id", "string").add("language", "string").add("status", "string").add("ts", "long").add("event_id", "long")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"job_id":"1","language":"en","status":"running","ts":1,"event_id":1}\n{"job_id":"2","language":"ja","status":"running","ts":1,"event_id":2}\n')
    ledger = lambda: progress.read_ledger(spark, str(src), schema)
    run = lambda: progress.progress_stream(ledger(), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    counts = lambda: {(r.language, r.status): r.jobs for r in progress.current_progress(spark.read.parquet(str(tmp_path / "out"))).collect()}
    run()
    assert counts() == {("en", "running"): 1, ("ja", "running"): 1}
    # after a restart: a newer status, an event that came late, one that came twice
    (src / "b.json").write_text('{"job_id":"1","language":"en","status":"accepted","ts":2,"event_id":3}\n{"job_id":"1","language":"en","status":"queued","ts":0,"event_id":0}\n{"job_id":"2","language":"ja","status":"running","ts":1,"event_id":2}\n')
    run()
    assert counts() == {("en", "accepted"): 1, ("ja", "running"): 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_redelivered_attempts_count_once(spark, tmp_path):
    from twinfold.streaming import progress

    rows = spark.range(40).selectExpr("concat('p', id % 5) AS payload_block_id", "id AS attempt", "if(id % 2 = 0, 'semantic_rejection', 'generator_output_rejection') AS status", "'bad' AS error", "timestamp_seconds(1000 + id) AS completed_at")
    for part in (rows.where("attempt < 30"), rows.where("attempt >= 20")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        progress.attempts_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour", available_now=True).awaitTermination()
    got = {r.payload_block_id: (r.generation, r.semantic) for r in progress.budgets(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {f"p{k}": (8, 4) for k in range(5)}


def test_archives_in_parts(spark, tmp_path):
    from twinfold.sources import tables

    x = np.arange(7 * 3 * 4, dtype="float64").reshape(7, 3, 4)
    np.savez(tmp_path / "a.npz", X=x, item_ids=np.array([f"a{i}" for i in range(7)]), layers=np.array([0, 4, 8]))
    np.savez_compressed(tmp_path / "b.npz", X=x[:5, 0], item_ids=np.array([f"b{i}" for i in range(5)]))
    np.savez(tmp_path / "c.npz", X=x[:0], item_ids=np.array([], "U1"), layers=np.array([0, 4, 8]))
    df = tables.read_activations(spark, str(tmp_path), rows=2)
    assert df.rdd.getNumPartitions() == 7
    got = {(r.item_id, r.layer): r.features for r in df.collect()}
    assert got == {(f"a{i}", 4 * k): x[i, k].tolist() for i in range(7) for k in range(3)} | {(f"b{i}", 0): x[i, 0].tolist() for i in range(5)}
    assert {(r.item_id, r.layer) for r in tables.read_activations(spark, str(tmp_path / "a.npz"), [8, 5], 3).collect()} == {(f"a{i}", 8) for i in range(7)}
    np.savez(tmp_path / "d.npz", X=x, item_ids=np.array(["only"]), layers=np.array([0, 4, 8]))
    try:
        tables.read_activations(spark, str(tmp_path / "d.npz")).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "has the shape" in str(e)


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    from twinfold.sources import tables

    (tmp_path / "a.jsonl").write_text('{"id":"x","n":1}\n\n[1]\n{"id":"y","n":2}\n')
    schema = T.StructType().add("id", "string").add("n", "integer")
    kept = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, bad="keep").cache()
    assert kept.where("_corrupt_record is null").count() == 2 and kept.where("_corrupt_record is not null").count() == 1
    np.savez(tmp_path / "acts.npz", X=np.arange(12.0).reshape(2, 3, 2), item_ids=np.array(["a", "b"]), layers=np.array([0, 4, 8]))
    acts = tables.read_activations(spark, str(tmp_path / "acts.npz"))
    assert acts.where("item_id = 'b' and layer = 4").first().features == [8.0, 9.0]
    df = spark.range(100).withColumn("t", F.lit("x"))
    done = tables.publish_dataset(str(tmp_path / "out"), t=df)
    assert tables.verify_manifest(done, tables.manifest(t=df.repartition(3))).count() == 0
    assert tables.verify_manifest(done, tables.manifest(t=df.where("id > 0"))).first().problem == "changed"


def test_sums_of_many_tasks_are_those_of_one(spark):
    import numpy as np
    import pandas as pd

    from twinfold.operators import linalg, probe

    def run(batches):
        yield pd.DataFrame({"fit": [0, 1], "v": [[float(sum(len(b) for b in batches)), 1.0], [2.0, 3.0]]})

    df = spark.range(1000).repartition(probe.FAN_IN * 4 + 5)
    assert probe._sums(df, run, 2, 2).tolist() == [[1000.0, probe.FAN_IN * 4 + 5], [2.0 * (probe.FAN_IN * 4 + 5), 3.0 * (probe.FAN_IN * 4 + 5)]]
    x = np.random.default_rng(0).normal(size=(300, 4))
    rows = spark.createDataFrame([(list(map(float, v)),) for v in x], "v array<double>").repartition(40)
    assert np.allclose(np.linalg.svd(linalg.triangle(rows, "v"))[1], np.linalg.svd(x)[1])


def test_sums_of_vectors_by_group(spark, monkeypatch):
    from twinfold.operators import linalg

    monkeypatch.setattr(linalg, "HELD_NUMBERS", 4)
    x = np.random.default_rng(7).normal(size=(60, 3))
    rows = [(None if i % 4 == 0 else f"k{i % 4}", i % 2, list(map(float, v))) for i, v in enumerate(x)] + [("k1", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, features array<double>").repartition(6)
    got = {(r.a, r.b): r for r in linalg.vector_sums(df, ["a", "b"]).collect()}
    assert set(got) == {(None, 0), ("k1", 1), ("k2", 0), ("k3", 1)}
    assert got[None, 0].n == 15 and np.allclose(got[None, 0].sums, x[::4].sum(0)) and np.allclose(got["k3", 1].squares, (x[3::4] ** 2).sum(0))
    assert np.allclose(linalg.vector_sums(df, []).first().sums, x.sum(0)) and linalg.vector_sums(df.where("false"), ["a"]).count() == 0
