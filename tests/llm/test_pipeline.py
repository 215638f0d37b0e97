"""The stages on a small table with planted documents, each against what brute force says of its own input."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, held_out int"


def prose(seed, n=120):
    import random

    rnd = random.Random(seed)
    common = "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they".split()
    return " ".join(rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(3)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(100, prose(3)), (101, prose(4) + " plus two"), (102, "12345 67890"), (103, None), (104, "the cat " * 60), (105, prose(50) + " Write to joe.doe12@mail.example.com now."), (106, "")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], SCHEMA)


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        rows = kept.collect()
        seen[name] = {r.doc_id: r for r in rows}
        if name != names[-1]:
            assert kept.columns == corpus_pipeline.COLUMNS
            kept = spark.createDataFrame(rows, kept.schema)
    every = {r.doc_id for r in docs.collect()}
    assert set(seen[names[0]]) == every - {102, 103, 106}
    assert set(seen[names[1]]) == set(seen[names[0]]) - {104}
    assert set(seen[names[2]]) == set(seen[names[1]]) - {100, 101}
    assert set(seen[names[3]]) == set(seen[names[2]])
    assert "joe.doe12" not in seen[names[3]][105].text and seen[names[3]][5].text == prose(5) and seen[names[3]][105].n_chars == len(seen[names[3]][105].text)
    assert set(seen[names[4]]) == set(seen[names[3]])


def test_empty_input(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
