"""Batches of fits against one solver call a fit, on moved copies of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import fits, protocols
from twinfold.operators.probe import Recipe

CUES = ("evaluation", "deployment")


def solved(x, y, c, xc=None, yc=None, mass=0.0, diff=None, penalty=0.0):
    """Newton steps on the stated objective."""
    n, d = x.shape
    theta, add = np.zeros(d + 1), lambda a: np.hstack([a, np.ones((len(a), 1))])
    parts = [(add(x), y, 1 / n)] + ([(add(xc), yc, mass / len(xc))] if mass else [])
    ridge = np.diag([1 / (c * n)] * d + [0.0])
    if penalty:
        ridge[:d, :d] += 2 * penalty * diff.T @ diff / len(diff)
    for _ in range(100):
        g, h = ridge @ theta, ridge.copy()
        for a, b, w in parts:
            p = 1 / (1 + np.exp(-a @ theta))
            g, h = g + w * a.T @ (p - b), h + w * a.T @ (a * (p * (1 - p))[:, None])
        theta = theta - np.linalg.solve(h, g)
    return theta[:-1], theta[-1]


def moved(x, languages, train_x, train_languages):
    out = x.astype(float).copy()
    for k in set(languages):
        own = train_x[train_languages == k]
        if len(own) >= 2:
            out[languages == k] = (x[languages == k] - own.mean(0)) / (own.std(0) + 1e-6)
    return out


@pytest.fixture(scope="module")
def world(spark):
    """Items in families of two languages, of which one is rare, and a bank of controls in blocks."""
    rng = np.random.default_rng(0)
    n, d = 90, 5
    y, family, language = rng.integers(0, 2, n), rng.integers(0, 4, n), np.where(rng.random(n) < 0.3, "ja", "en")
    language[0] = "xx"
    x = rng.normal(size=(n, d)) + np.outer(y, [1, 0.5, 0, 0, 0]) + np.where(language == "ja", 3, 0)[:, None]
    items = spark.createDataFrame([(f"i{i}", int(family[i]), str(language[i]), int(y[i]), i // 4, CUES[i % 2], ("benchmark", "casual")[i // 2 % 2], list(map(float, x[i]))) for i in range(n)], "item_id string, family int, language string, y int, block int, purpose string, format string, features array<double>")

    def bank(name, seed, blocks):
        rng, rows = np.random.default_rng(seed), []
        for b in range(blocks):
            for f in ("noun", "verb"):
                for k in ("en", "ja"):
                    for p in CUES:
                        for cue in CUES:
                            v = rng.normal(0, 0.5, d) + 0.8 * (p == CUES[0]) * np.array([1, 0, 0, 0, 0]) + (cue == CUES[0]) * np.array([0.5, 0, 1, 0, 0])
                            rows.append((f"{name}{b}", f, k, p, cue, "external" if b % 2 else "internal", list(map(float, v))))
        return rows, spark.createDataFrame(rows, "control_block_id string, cue_family string, language string, intended_purpose string, lexical_cue string, surface string, features array<double>").repartition(3)

    return {"x": x, "y": y, "family": family, "language": language, "items": items.repartition(5), "bank": bank}


def arrays(rows):
    block, family, language, purpose, cue, _, v = map(np.array, zip(*rows, strict=True))
    return block, family, language, purpose, cue, np.array(v)


def differences(rows, x):
    block, family, language, purpose, cue, _ = arrays(rows)
    out, of = [], []
    for key in sorted(set(zip(block, family, language, purpose, strict=True))):
        at = (block == key[0]) & (family == key[1]) & (language == key[2]) & (purpose == key[3])
        out.append(x[at & (cue == CUES[0])][0] - x[at & (cue == CUES[1])][0])
        of.append(key[0])
    return np.array(out), np.array(of)


@pytest.mark.parametrize("only", [None, "en"])
def test_fold_scores(world, only):
    x, y, family, language = (world[k] for k in ("x", "y", "family", "language"))
    got = {r.item_id: (r.score, r.pred) for r in protocols.fold_scores(world["items"], 0.3, fit_language=only).collect()}
    assert len(got) == len(x)
    for held in range(4):
        train = family != held
        z = moved(x, language, x[train], language[train])
        own = train & (language == only) if only else train
        w, b = solved(z[own], y[own], 0.3)
        for i in np.flatnonzero(~train):
            assert got[f"i{i}"][0] == pytest.approx(z[i] @ w + b, abs=2e-4) and got[f"i{i}"][1] == (got[f"i{i}"][0] > 0)


def test_fold_scores_leave_small_folds_out_and_pick_strengths(world):
    few = world["items"].where("family < 2 or family = 2 and y = 1")
    mask = F.col("family") == 1
    assert {r.family for r in protocols.fold_scores(few, 0.3, fit_mask=mask).select("family").distinct().collect()} == {0, 2}
    assert protocols.fold_scores(few, 0.3, least=10_000).collect() == []
    x, y, family, language = (world[k] for k in ("x", "y", "family", "language"))
    grid, want = (0.005, 0.5), {}
    for held in range(4):
        mean = []
        for c in grid:
            each = []
            for inner in set(range(4)) - {held}:
                train, test = (family != held) & (family != inner), family == inner
                z = moved(x, language, x[train], language[train])
                w, b = solved(z[train], y[train], c)
                hit = (z[test] @ w + b > 0) == y[test]
                each.append(np.mean([hit[y[test] == k].mean() for k in (0, 1) if (y[test] == k).any()]))
            mean.append(np.mean(each))
        want[held] = grid[int(np.argmax(mean))]
    assert {r.family: r.c for r in protocols.fold_scores(world["items"], grid).select("family", "c").distinct().collect()} == want


def test_sweep_over_layers_of_different_widths(spark, world):
    x, y, family = world["x"], world["y"], world["family"]
    acts = [(f"i{i}", layer, list(map(float, v[:k]))) for layer, k in ((3, 5), (7, 2)) for i, v in enumerate(x)]
    acts += [("nobody", 3, [0.0] * 5)]
    acts = spark.createDataFrame(acts, "item_id string, layer int, features array<double>").repartition(4)
    e, b = F.col("purpose") == "evaluation", F.col("format") == "benchmark"
    items = world["items"].drop("features").withColumn("f", b.cast("int"))
    got = {(r.layer, r.regime): r for r in protocols.sweep(items, acts, {"all": (F.lit(True), F.lit(True)), "b2c": (b, ~b), "format": (F.lit(True), e)}, labels={"format": "f"}).collect()}
    bench = np.arange(len(x)) // 2 % 2 == 0
    for layer, k in ((3, 5), (7, 2)):
        for regime, train, test, label in (("all", bench | True, bench | True, y), ("b2c", bench, ~bench, y), ("format", bench | True, np.arange(len(x)) % 2 == 0, bench.astype(int))):
            score = np.zeros(len(x))
            for held in range(4):
                own = train & (family != held)
                z = (x[:, :k] - x[own, :k].mean(0)) / x[own, :k].std(0)
                w, c = solved(z[own], label[own], 0.1)
                score[family == held] = (z @ w + c)[family == held]
            s, t = score[test], label[test]
            pairs = (s[t == 1][:, None] > s[t == 0]).mean()
            r = got[layer, regime]
            assert r.n == test.sum() and r.auc == pytest.approx(pairs, abs=0.01) and r.balanced_accuracy == pytest.approx(np.mean([((s >= 0) == j)[t == j].mean() for j in (0, 1)]), abs=0.03)
    assert got[3, "all"].distinct_fraction == 1 and got[3, "all"].pairs > 30 and got[3, "format"].pairs is None


@pytest.mark.parametrize("method", ["none", "svd", "rowspace", "mean"])
def test_crossfit_is_one_fit_a_block_without_it(world, method):
    rows, bank = world["bank"]("b", 1, 1 if method == "rowspace" else 3)
    if method == "rowspace":
        more, other = world["bank"]("c", 2, 1)
        rows, bank = rows + more, bank.unionByName(other)
    x, y, language = world["x"], world["y"], world["language"]
    recipe = Recipe(1.0, 2.0, (0.5,)) if method == "none" else Recipe()
    got = {(r.control_block_id, r.cue_family, r.language, r.intended_purpose, r.lexical_cue): r for r in protocols.crossfit_controls(bank, world["items"], recipe, 0.3, method).collect()}
    assert len(got) == len(rows)
    block, family, lang, purpose, cue, v = arrays(rows)
    z, zc = moved(x, language, x, language), moved(v, lang, x, language)
    diff, of = differences(rows, zc)
    for held in sorted(set(block)):
        keep = block != held
        d = diff[of != held]
        if method == "mean":
            axes = [zc[keep & (family == f) & (lang == k) & (cue == CUES[0])].mean(0) - zc[keep & (family == f) & (lang == k) & (cue == CUES[1])].mean(0) for f in ("noun", "verb") for k in ("en", "ja")]
            basis = np.linalg.qr(np.array(axes).T)[0].T
        elif method == "none":
            basis = np.zeros((0, 5))
        else:
            _, s, r = np.linalg.svd(d, full_matrices=False)
            basis = r[: int(np.searchsorted(np.cumsum(s * s) / (s * s).sum(), 0.9) + 1)] if method == "svd" else r[s > 1e-12 * s[0]]
        free = lambda a: a - a @ basis.T @ basis  # noqa: B023, E731
        w, b = solved(free(z), y, 0.3, free(zc)[keep], (purpose[keep] == CUES[0]).astype(float), recipe.control_mass, free(d), recipe.cue_penalty)
        own = free(z) @ w + b
        for i in np.flatnonzero(~keep):
            r = got[block[i], family[i], lang[i], purpose[i], cue[i]]
            score = free(zc[i : i + 1])[0] @ w + b
            mine = own[language == lang[i]]
            assert r.converged and r.score == pytest.approx(score, abs=5e-4) and r.normalised == pytest.approx((score - mine.mean()) / mine.std(), abs=5e-3) if mine.std() > 1e-9 else r.score == pytest.approx(score, abs=5e-4)


def test_the_plan_does_not_grow_with_blocks(world):
    """Rows carry the number of their block, not the fits that they train."""
    _, bank = world["bank"]("b", 1, 9)
    blocks, at = fits.numbered(bank, "control_block_id")
    rows = protocols._control_rows(bank.withColumn("_b", at), F.col("_b"))
    assert len(blocks) == 9 and rows.count() == bank.count() and {len(r.selections) for r in rows.collect()} == {1}


def test_reciprocal_banks_and_recipes_in_one_batch(spark, world):
    (one, a), (two, b) = world["bank"]("a", 3, 2), world["bank"]("b", 4, 2)
    recipes = {"plain": Recipe(), "mass": Recipe(1.0), "penalty": protocols.continued(1.0, 20.0)}
    assert recipes["penalty"].continuation == (16.0,) and protocols.continued(0, 256).continuation == (16.0, 64.0)
    got = {(r.recipe, r.source): r for r in protocols.reciprocal({"A": a, "B": b}, world["items"], recipes, 0.3).collect()}
    assert len(got) == 6 and all(r.eligible and r.target != r.source for r in got.values())
    x, y, language = world["x"], world["y"], world["language"]
    z = moved(x, language, x, language)
    for name, recipe in recipes.items():
        for source, rows, other in (("A", one, two), ("B", two, one)):
            *_, lang, purpose, _, v = arrays(rows)
            zc = moved(v, lang, x, language)
            w, c = solved(z, y, 0.3, zc, (purpose == CUES[0]).astype(float), recipe.control_mass, differences(rows, zc)[0], recipe.cue_penalty)
            _, family, lang, purpose, cue, v = arrays(other)
            s, own = moved(v, lang, x, language) @ w + c, z @ w + c
            effect = max(abs(s[(family == f) & (lang == k) & (cue == CUES[0])].mean() - s[(family == f) & (lang == k) & (cue == CUES[1])].mean()) / own[language == k].std() for f in ("noun", "verb") for k in ("en", "ja"))
            assert got[name, source].max_effect == pytest.approx(effect, abs=2e-3)
    stopped = fits.fit_batch(protocols.training_rows(world["items"], key="language"), [fits.Spec(0.3)], most_passes=2)
    assert not stopped[0].converged


def test_one_class_is_an_error(world):
    rows = fits.training_rows(world["items"].where("y = 1"))
    with pytest.raises(ValueError, match="one class"):
        fits.fit_batch(rows, [fits.Spec(1.0)])


def test_confirm_models_of_different_widths(spark, world):
    _, bank = world["bank"]("a", 3, 2)
    narrow = lambda df: df.withColumn("features", F.slice("features", 1, 3))
    limits = spark.createDataFrame([("auc_floor", ">=", 0.0), ("max_effect", "abs<=", 50.0)], "metric string, op string, bound double")
    fit = {"wide": world["items"], "narrow": narrow(world["items"])}
    banks = {"wide": bank, "narrow": narrow(bank)}
    got = {r.model: (r.passed, r.failed_gates) for r in protocols.confirm(fit, banks, banks, Recipe(1.0, 1.0), 0.5, limits).collect()}
    assert got == {"wide": (True, 0), "narrow": (True, 0), None: (True, 0)}


def test_penalised_fit_query(spark):
    """All items, scored by the minimum that Newton steps find on the Parquet table itself."""
    import pyarrow.parquet as pq

    from twinfold.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pandas().sort_values("vec_id")
    ids, x, label = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float), t["label"].to_numpy()
    y, fit, cue = label % 2, ids // 2 % 2 == 0, ids % 2 == 0
    z = (x - x[fit].mean(0)) / (x[fit].std(0) + 1e-6)
    at = {int(i): k for k, i in enumerate(ids)}
    pairs = [(at[i], at[i + 1]) for i in at if i % 4 == 2 and i + 1 in at and (label[at[i]] < 5) == (label[at[i + 1]] < 5)]
    assert pairs and cue[[a for a, _ in pairs]].all()
    w, b = solved(z[fit], y[fit], 0.1, z[~fit], y[~fit], 1.0, np.array([z[i] - z[j] for i, j in pairs]), 4.0)
    want = z @ w + b
    got = {r.vec_id: r for r in QUERIES["penalised_fit"](spark, sf).collect()}
    assert sorted(got) == sorted(at)
    for k, i in enumerate(ids):
        r = got[i]
        assert r.y == y[k] and r.score == pytest.approx(want[k], abs=1e-4) and r.pred == (r.score >= 0)
