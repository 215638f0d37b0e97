"""Fits as near to their minimum as predictions of many rows need."""

import numpy as np
from test_protocols import moved, solved

from twinfold.operators import protocols


def test_fold_scores_to_many_digits(spark):
    """Of 100,000 rows some have scores within 1e-6 of 0."""
    rng = np.random.default_rng(3)
    n, d = 3000, 8
    y, family, language = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.choice(["en", "ja"], n)
    x = rng.normal(size=(n, d)) + 0.3 * y[:, None]
    items = spark.createDataFrame([(i, int(family[i]), str(language[i]), int(y[i]), list(map(float, x[i]))) for i in range(n)], "item_id int, family int, language string, y int, features array<double>").repartition(5)
    got = {r.item_id: r.score for r in protocols.fold_scores(items, 0.02).collect()}
    for f in range(4):
        train = family != f
        z = moved(x, language, x[train], language[train])
        w, b = solved(z[train], y[train], 0.02)
        assert max(abs(got[i] - (z[i] @ w + b)) for i in np.flatnonzero(~train)) < 3e-8
