"""Fits that each leave one of many blocks out start where one fit of all rows and its derivatives say they end."""

import numpy as np
import pytest

from twinfold.operators import fits
from twinfold.operators.fits import Spec, fit_batch, score_moments
from twinfold.operators.probe import Recipe


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(5), []
    for i in range(600):
        out.append(("fit", "en" if i % 3 else "ja", -1, float(i % 2), rng.normal(size=4) + 0.4 * (i % 2)))
    for b in range(300):
        for i in range(4):
            out.append(("control", "en" if i < 2 else "xx", b, float(i % 2), rng.normal(size=4) + 0.5 * (i % 2)))
        out.append(("difference", "en", b, 0.0, rng.normal(size=4)))
    df = spark.createDataFrame([("", r, k, b, [0], [y], v.tolist()) for r, k, b, y, v in out], "group string, role string, key string, block int, selections array<int>, y array<double>, features array<double>")
    return df.repartition(3).cache()


def test_fits_of_many_blocks(spark, rows, monkeypatch):
    specs, asked = [Spec(0.05, held=(k,), recipe=Recipe(1.0, 0.25)) for k in range(300)], []
    run = fits._gradients
    monkeypatch.setattr(fits, "_gradients", lambda r, models, *rest: asked.append(len(models)) or run(r, models, *rest))
    models = fit_batch(rows, specs)
    assert all(m.converged for m in models) and sum(asked) < 4 * len(specs)
    # as if each was fitted by itself
    monkeypatch.setattr(fits, "MANY", 1000)
    alone = fit_batch(rows, specs)
    assert max(np.abs(np.append(a.weight - b.weight, a.intercept - b.intercept)).max() for a, b in zip(models, alone, strict=True)) < 2e-8
    few = score_moments(rows, alone[:3])
    many = score_moments(rows, alone)
    assert few.fit.tolist() == many.fit[: len(few)].tolist() and few.key.tolist() == many.key[: len(few)].tolist()
    assert np.allclose(few[["n", "mean", "sd"]], many[["n", "mean", "sd"]][: len(few)], rtol=0, atol=1e-10)
