"""What limits out of reach and caps would miss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from twinfold.llm import fingerprints, near_copies, quality, surrogates

SF = "/root/testdata/sf0.01"


def test_quality_rejects_long_texts_without_common_words(spark):
    common = {w for x in quality.COMMON_WORDS.values() for w in x.split()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    stripped = [(-r.doc_id - 1, " ".join(w for w in r.text.split() if w.strip(quality.MARKS).lower() not in common), r.lang) for r in good.where("n_chars > 800").limit(40).collect()]
    every = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(stripped, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality.quality(every).where("not base_failed").collect()}
    bare = [got[i] for i, *_ in stripped if i in got]
    assert len(bare) > 20 and not any(r.kept for r in bare if r.n_words >= 50)
    clean = [got[r.doc_id].kept for r in good.collect() if r.doc_id in got]
    assert np.mean(clean) > 0.99


def test_word_limit_follows_length_and_reference():
    reference, limits = np.array([20, 10, 70.0]), quality.Limits()
    most = quality.most_words_apart(np.array([50, 100, 5000]), reference, limits)
    assert quality.distance(np.array([[0, 0, 1]]), reference)[0] > most[0] > most[1] > most[2] > 0
    assert (quality.most_words_apart(np.array([50, 5000]), np.array([1, 1, 98.0]), limits) == 1).all()


def test_pipeline_drops_near_copies_from_80_percent(spark):
    words = [f"w{i}" for i in range(304)]
    other = [f"x{i}" if i in range(100, 100 + 26) else w for i, w in enumerate(words)]
    apart = [f"y{i}" if i in range(100, 100 + 40) else w for i, w in enumerate(words)]
    sets = [{tuple(x[k : k + 5]) for k in range(300)} for x in (words, other, apart)]
    alike = [len(sets[0] & x) / len(sets[0] | x) for x in sets[1:]]
    rows = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in ((1, words), (2, other), (3, apart))], "doc_id long, text string, lang string, source string, n_chars long")
    assert 0.8 < alike[0] < 0.85 and alike[1] < 0.8
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").orderBy("doc_id").collect()] == [1, 3]


def test_least_estimate_loses_no_pair_at_its_percent():
    assert 0.54 < near_copies.least_estimate(80) < 0.56 and 0.61 < near_copies.least_estimate(85) < 0.64


def test_surrogates_cover_whole_secrets():
    for n in (6, 128, 129, 201, 5000):
        value = "".join("aZ5-"[k % 4] for k in range(n))
        new, found = surrogates.replace(f"token={value} end", b"k")
        assert [x[:2] for x in found] == [("secret", value)] and new.endswith(" end") and len(new) == n + 10
        letters = [k for k in range(n) if k % 4 < 3]
        assert sum(value[k] == found[0][2][k] for k in letters) <= max(3, 0.2 * len(letters))
    long_key = "sk-" + "aB3" * 100
    assert long_key[200:] not in surrogates.replace(f"see {long_key}.", b"k")[0]
    assert surrogates.permuted_letters("a" * 300, ["ab"], b"k", "t") != surrogates.permuted_letters("b" + "a" * 299, ["ab"], b"k", "t")


def test_surrogates_of_long_and_recurring_names():
    text = "Herr Ludwig van Beethoven kam. Beethoven's Werk, Ludwig van Beethoven und Frau Ursula von der Leyen Maria Anna Xaver traf Herr Stein; Xaver ging. Dr Quorra Müller, Frau Quorra Müller, Mr Stone's dog and Stone"
    new, found = surrogates.replace(text, b"k")
    own = [x for _, x, _ in found]
    assert own == ["Ludwig van Beethoven", "Beethoven", "Ludwig van Beethoven", "Ursula von der Leyen Maria Anna Xaver", "Stein", "Xaver", "Quorra Müller", "Quorra Müller", "Stone", "Stone"]
    assert not any(x in new for x in ("Beethoven", "Ludwig", "Leyen", "Xaver", "Quorra", "Stone"))
    by = {x: y for _, x, y in found}
    assert by["Ludwig van Beethoven"].split()[-1] == by["Beethoven"] and by["Ursula von der Leyen Maria Anna Xaver"].split()[-1] == by["Xaver"]
    assert len({y for _, x, y in found if x == "Quorra Müller"}) == 1


def test_secret_types_do_not_share_surrogates():
    assert not any(surrogates._HEXADECIMAL.fullmatch(surrogates.secret(f"zz{k}", b"k")) for k in range(3000))


def test_fingerprints_cut_all_lines_alike(spark):
    lines = [[f"Sentence {k} of line {n} is here." for k in range(10)] for n in range(6)]
    changed = {n: [[x.replace("here", "there") if (m, k) == (n, 4) else x for k, x in enumerate(line)] for m, line in enumerate(lines)] for n in range(6)}
    joined = lambda x: "\n".join(map(" ".join, x))
    rows = spark.createDataFrame([(n, joined(lines), joined(x)) for n, x in changed.items()], "n int, one string, other string")
    got = rows.selectExpr("n", f"{fingerprints.digests('one')} as a", f"{fingerprints.digests('other')} as b").collect()
    assert {(len(r.a), len(set(r.a) & set(r.b))) for r in got} == {(60, 59)}


def test_registered_fingerprints_use_sentences_throughout(spark):
    import re

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = sorted(texts)
    cut = lambda t: {p for x in re.split(r"\n+", t) for p in re.split(r"(?<=[.!?])\s+", x) if p}
    for r in fingerprints.op1_fingerprints(spark, d).collect():
        own, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        a, b = cut(own), cut(own[: len(own) - len(own) // 2] + after[: len(own) // 2])
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9


def test_hot_keys_are_dealt_to_parts_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT_SHARES", 8)
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(-1)).otherwise(F.col("id")).alias("band"), F.col("id").alias("class_id"))
    own = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("class_id").alias("low"))
    found = near_copies.joined(rows, own, ["band"], "class_id")
    want = rows.join(own.drop("n"), "band")
    assert found.count() == 3000 and found.exceptAll(want.select(found.columns)).count() == 0
    none = near_copies.joined(rows.where("false"), own.where("false"), ["band"], "class_id")
    assert none.columns == found.columns and none.count() == 0
