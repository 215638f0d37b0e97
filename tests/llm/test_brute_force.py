"""Whole results of registered queries against plain re-computation, and what the earlier limits would have missed."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import fingerprints, language, near_copies, quality, surrogates, url_filter

SF = "/root/testdata/sf0.001"
KEY = b"k"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints_of_many_lines_and_their_differences(spark):
    lines = [f"line {k} of the text" for k in range(16_000)]
    other = [x + "!" if k % 1000 == 7 else x for k, x in enumerate(lines)]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")).collect()}
    assert rows[1].near_next == rows[2].near_next == pytest.approx((16_000 - 16) / (16_000 + 16))
    found = rows[1].next_difference
    assert len(found) == 32 and sum(x > 0 for x in found) == 16 and {-x for x in found} == set(rows[2].next_difference)


def test_larger_sketches_peel_what_the_first_does_not(spark):
    rows = spark.range(200).selectExpr("id", "transform(sequence(1, 40), i -> xxhash64(id, i) & 9223372036854710272L) AS h")
    made = rows.selectExpr("id", f"transform(h, h -> h | ({fingerprints._CHECK.format('h')})) AS d").selectExpr("id", "d", f"{fingerprints._items('d', 1, '0L')} AS w")
    sizes = ", ".join(map(str, fingerprints.LARGER_CELLS))
    got = made.selectExpr("d", f"{fingerprints.peeled(fingerprints._cells('w'))} AS small", *[fingerprints.let("m", f"array({sizes})[{k}]", fingerprints.let("salt", str(k + 1), fingerprints.peeled_larger("w"))) + f" AS large{k}" for k in range(2)]).collect()
    assert all(r.small is None for r in got) and sum(r.large0 is not None for r in got) > 150 and all(sorted(r.large1) == sorted(r.d) for r in got)


def test_texts_of_64000_lines_without_a_common_one(spark):
    rows = spark.createDataFrame([(k, "\n".join(f"line {i} of {k}" for i in range(64_000))) for k in (1, 2)], "doc_id long, text string")
    own = {r.doc_id: (r.a, r.next_difference, r.near_next) for r in fingerprints.fingerprints(rows).join(rows.selectExpr("doc_id", f"{fingerprints.digests('text')} AS a"), "doc_id").collect()}
    for k in (1, 2):
        a, found, near = own[k]
        assert near == 0 and len(found) == 128_000 and sorted(found) == sorted([*a, *(-x for x in own[3 - k][0])])


def _sketch_of(pairs):
    """Cells (count, XOR) of signed digests, by the places of the fingerprint."""
    cells = [[0, 0] for _ in range(3 * fingerprints.CELLS)]
    for d in pairs:
        for t in range(3):
            i = fingerprints.CELLS * t + (abs(d) >> (16 + 8 * t)) % fingerprints.CELLS
            cells[i][0] += 1 if d > 0 else -1
            cells[i][1] ^= abs(d)
    return "array(" + ", ".join(f"named_struct('c', {c}, 'k', {k}L)" for c, k in cells) + ")"


def test_cells_that_look_pure_but_are_not(spark):
    """A cell in which three digests make up a bogus one with right check bits: elsewhere it isn't taken, in its own place it is put back."""
    found = spark.range(3000).selectExpr("transform(sequence(1, 40), i -> xxhash64(id, i) & 9223372036854710272L) AS h").selectExpr(f"transform(h, h -> h | ({fingerprints._CHECK.format('h')})) AS d")
    known = [x for r in found.limit(2).collect() for x in r.d]
    a, b = known[0], known[1]
    bogus = next(x for x in known[2:] if x & 0xFFFF)
    third = a ^ -0 ^ b ^ bogus  # a ^ (-b) ^ third is the bogus digest, with its check bits
    got = spark.range(1).selectExpr(f"{fingerprints.peeled(_sketch_of([a, -b, third]))} AS p", f"{fingerprints.peeled(_sketch_of([a, -b]))} AS q").first()
    assert got.q is not None and sorted(got.q) == sorted([a, -b])
    assert got.p is None or sorted(got.p) == sorted([a, -b, third])  # third has no check bits of its own, so the sketch fails rather than lie
    # a digest put in and taken back is no difference
    rows = spark.createDataFrame([([a, b, -b],)], "got array<long>")
    assert rows.selectExpr("named_struct('got', got) AS st").selectExpr(f"{fingerprints._CANCELLED} AS g").first().g == [a]


# -- URL filter ----------------------------------------------------------------------------------------------------------


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def test_url_filter_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    own = {r.page_id: r.url for r in pages.collect()}
    more = [(-1, "http://user:pw@Example.NET:8080/en/x"), (-2, "http://example.net:80"), (-3, "x://" + "a" * 20_000 + ".net/"), (-4, "http://a.example.com/de"), (-5, "http://example.net/EN/"), (-5, "http://example.net/EN/"), (-6, "a://b://c.net/")]
    odd = spark.createDataFrame(more, "page_id long, url string")
    model = url_filter.train(url_filter.labelled_urls(spark))
    hashing, idf, _, regression = model.stages
    index_of = functools.cache(hashing.indexOf)
    weights, bias, idf = regression.coefficients.toArray(), regression.intercept, idf.idf.toArray()
    got = url_filter.op6_url_filter(spark, SF).collect() + url_filter.judge_urls(odd, url_filter.RULES, url_filter.labelled_urls(spark)).collect()
    assert Counter(r.page_id for r in got) == Counter([*own, *(i for i, _ in more)])
    for r in got:
        host, path = split_url(own.get(r.page_id) or dict(more).get(r.page_id))
        fits = [x for x in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        counts = Counter()
        for words, mark in ((host.rpartition(".")[0].split(".") if "." in host else [host], "h"), (re.split("[/._=-]+", path), "p")):
            for w in words:
                counts.update(index_of(f"{mark}{('^' + w + '$')[i : i + n]}") for n in url_filter.LENGTHS if w for i in range(max(1, len(w) + 3 - n)))
        norm = math.sqrt(sum((n * idf[k]) ** 2 for k, n in counts.items())) or 1
        score = 1 / (1 + math.exp(-bias - sum(weights[k] * n * idf[k] / norm for k, n in counts.items())))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score, abs=1e-9)
        assert r.verdict == (url_filter.RULES[rule] if rule else "block" if r.score >= url_filter.THRESHOLD else "allow")


def test_url_filter_on_hosts_judged_by_name(spark):
    """Recall and precision over pages without a rule."""
    got = url_filter.op6_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").collect()
    bad = [bool(re.search("casino|bets|ads-track|spam|pills|adult", r.host)) for r in got]
    blocked = [r.verdict == "block" for r in got]
    both = sum(a and b for a, b in zip(bad, blocked, strict=True))
    assert sum(bad) > 90 and both >= 0.95 * sum(bad) and both >= 0.95 * sum(blocked)


def test_url_filter_of_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES, url_filter.labelled_urls(spark)).collect() == []


def test_url_filter_uses_no_python(spark):
    plan = url_filter.op6_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_filter_on_held_out_urls(spark):
    """Four parts, each judged by what the other three teach."""
    rows = url_filter.labelled_urls(spark).withColumn("part", F.pmod(F.xxhash64("host", "path"), F.lit(4)))
    hit = bad = blocked = n = 0
    for k in range(4):
        held = rows.where(F.col("part") == k).select(F.concat(F.lit("http://"), "host", "path").alias("url"), F.monotonically_increasing_id().alias("page_id"), "label")
        got = url_filter.judge_urls(held.select("page_id", "url"), {"zz/": "block"}, rows.where(F.col("part") != k).drop("part")).join(held, "page_id").selectExpr("count(*) AS n", "count_if(verdict = 'block' and label = 1) AS hit", "sum(label) AS bad", "count_if(verdict = 'block') AS blocked").first()
        hit, bad, blocked, n = hit + got.hit, bad + got.bad, blocked + got.blocked, n + got.n
    assert n == rows.count() and hit / bad > 0.88 and hit / blocked > 0.95


# -- near copies and pipeline --------------------------------------------------------------------------------------------


def test_near_copies_refuse_what_the_bands_would_miss(spark, docs):
    with pytest.raises(ValueError):
        near_copies.near_copies(docs, percent=79)


def test_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red green blue white black grey brown pink violet")
    rows = [(0, a), (1, a), (1, b), (2, b + " ten"), (3, c), (3, c), (None, c), (None, "x y"), (None, "x y"), (4, None), (4, None), (5, ""), (6, "word " * 20_000)]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows += [(7, long), (8, long + " end")]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, _row string, component_id int")
    got = Counter((r.doc_id, r.text) for r in near_copies.without_near_copies(df, 80).collect())
    assert got == Counter({(0, a): 1, (1, b): 1, (3, c): 1, (None, "x y"): 1, (4, None): 2, (5, ""): 1, (6, "word " * 20_000): 1, (7, long): 1})
    assert near_copies.without_near_copies(df.limit(0)).count() == 0 and near_copies.without_near_copies(df).columns == df.columns


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    good = "The people of the town said that they would not have any more of it, and all of them went to the house by the river for the day. "
    rows = [(None, good * 2, None, None, None), (1, good, "en", "s", 1), (1, good, "en", "s", 1), (1, "", "en", "s", 0), (2, None, None, None, None), (3, " ".join(f"{good} {k}x" for k in range(3000)), "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, PII_FOUND string")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() >= 0 and (out.columns == corpus_pipeline.COLUMNS or "sequence_id" in out.columns)
    packed = corpus_pipeline.packing(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert packed.count() == 4


# -- surrogates ----------------------------------------------------------------------------------------------------------


def test_no_surrogate_is_its_entity():
    for pool in surrogates.GIVEN_NAMES.values():
        for word in pool.split():
            assert surrogates.given(word, KEY) != word and surrogates.name(word, KEY) != word
    for word in ("Wu", "Li", "Ng", "王", "李明", "Ö", "O’Neill", "Ким", "Παπ"):
        assert surrogates.name(word, KEY) != word
    for make, own in ((surrogates.phone, [f"555 010 {k:04d}" for k in range(300)]), (surrogates.ipv4, [f"10.0.{k}.7" for k in range(200)]), (surrogates.social, [f"219-09-{k:04d}" for k in range(1, 300)]), (surrogates.email, [f"a{k}@b.org" for k in range(300)]), (surrogates.ipv6, [f"fe80::{k:x}" for k in range(1, 300)])):
        new = [make(x, KEY) for x in own]
        assert len(set(new)) == len(own) and not any(x == y for x, y in zip(own, new, strict=True))
    assert {surrogates.permuted(n, 300, KEY, "t") for n in range(300)} == set(range(300)) and not any(surrogates.permuted(n, 300, KEY, "t") == n for n in range(300))


def test_nothing_long_is_left():
    for value in ("aB3-" * 2500, "f" * 9999):
        new, found = surrogates.replace(f"password={value}; end", KEY)
        assert found[0][1] == value and new.endswith("; end") and value[-40:] not in new
    local, labels = "x1." * 170 + "y", ".".join(f"d{k}" for k in range(40))
    new, found = surrogates.replace(f"to {local}@{labels}.example.com.", KEY)
    assert found[0][:2] == ("email", f"{local}@{labels}.example.com") and local[:20] not in new
    new, found = surrogates.replace("Señora Maria Carmen Garcia Lopez left. Maria said: Lopez, and Carmen Garcia Lopez.", KEY)
    assert [x[1] for x in found] == ["Maria Carmen Garcia Lopez", "Maria", "Lopez", "Carmen Garcia Lopez"] and not re.search("Maria|Carmen|Garcia|Lopez", new)
    new, found = surrogates.replace("Anna Schmidt lives here. Dr Anna Schmidt works.", KEY)
    assert len(found) == 2 and found[0][2] == found[1][2] and "Anna" not in new
    kinds = [k for k, *_ in surrogates.replace("2001:db8:0:0:1:0:0:1, fe80::1, 030 1234567, 01 23 45 67 89; not 12:30:45 or 1.234.567", KEY)[1]]
    assert kinds == ["ipv6", "ipv6", "phone", "phone"]


def test_surrogates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 5, "old", "a"), (1, 5, "old", "a"), (2, None, None, None)], "doc_id long, text int, PII_FOUND string, kept string")
    got = surrogates.surrogates(df, KEY)
    assert got.columns == ["doc_id", "text", "kept", "pii_found"] and Counter((r.doc_id, r.text, r.kept, tuple(r.pii_found)) for r in got.collect()) == Counter({(1, "5", "a", ()): 2, (2, None, None, ()): 1})


def test_surrogates_over_documents(spark):
    """Recall on the forms that the tables hold, by patterns of their own; one surrogate for each entity, and the reverse."""
    done = surrogates.surrogates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), KEY)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    left = {r.doc_id: r.text or "" for r in done.collect()}
    for pattern in (r"[\w.]+@[\w.]+\.(?:com|org|net)\b(?!\.example)", r"AKIA[0-9A-Z]{16}\b", r"password=\S+"):
        seen = [(i, x) for i, t in texts.items() for x in re.findall(pattern, t)]
        assert not seen or sum(x in left[i] for i, x in seen) <= 0.01 * len(seen)
    assert surrogates.collisions(done).count() == 0
    found = done.select(F.explode("pii_found").alias("x")).select("x.*")
    assert found.select("kind", "entity_digest").distinct().count() > 10
    assert surrogates.op8_surrogates(spark, SF).agg(F.max("collisions")).first()[0] == 0


# -- quality -------------------------------------------------------------------------------------------------------------


def test_quality_verdicts(spark, docs):
    common = {w: i for i, w in enumerate(sorted({w for x in quality.COMMON_WORDS.values() for w in x.split()}))}

    def classes(t):
        def one(c):
            if c in quality.MARKS:
                return 5
            if c in quality.SYMBOLS:
                return 6
            if c.isalpha():
                return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2
            return 4 if c.isspace() else 3 if c.isdigit() else 7

        return Counter(map(one, t))

    def words(t):
        return Counter(common.get(w.strip(quality.MARKS).lower(), -1) for w in re.findall(r"[^\x20\x09-\x0D]+", t))

    def apart(p, q):
        a, b = sum(p.values()), sum(q.values())
        if not a:
            return 0.0
        entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
        keys = {*p, *q}
        x, y = [p[k] / a for k in keys], [q[k] / b for k in keys]
        return math.sqrt(max(0, entropy([(u + v) / 2 for u, v in zip(x, y, strict=True)]) - (entropy(x) + entropy(y)) / 2))

    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in quality.op9_quality(spark, SF).collect()}
    reference = defaultdict(lambda: (Counter(), Counter()))
    for i, r in rows.items():
        if r.lang and not got[i].base_failed:
            reference[r.lang][0].update(classes(r.text or ""))
            reference[r.lang][1].update(words(r.text or ""))
    limits = quality.Limits()
    for i, r in rows.items():
        c, w = classes(r.text or ""), words(r.text or "")
        worst = []
        for rc, rw in reference.values():
            n = sum(w.values())
            most = apart(Counter({-1: 1}), rw) * (limits.long_words_share + (limits.short_words_share - limits.long_words_share) * math.sqrt(limits.least_words / max(n, limits.least_words)))
            if 100 * (sum(rw.values()) - rw[-1]) < limits.least_common_percent * sum(rw.values()):
                most = 1
            x = apart(c, rc) if sum(c.values()) >= limits.least_chars else 0
            y = apart(w, rw) if n >= limits.least_words else 0
            worst.append((round(max(x / limits.most_chars_apart, y / most), 9), x, y))
        least = min(worst)
        assert got[i].kept == (not got[i].base_failed and least[0] <= 1)
        assert got[i].chars_apart is None or got[i].chars_apart == pytest.approx(least[1], abs=1e-6)
        assert got[i].words_apart is None or got[i].words_apart == pytest.approx(least[2], abs=1e-6)


def test_quality_without_languages(spark):
    rows = quality.quality(spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "a b")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: True, 2: False}


# -- language ------------------------------------------------------------------------------------------------------------


def test_language_against_exact_sets(spark, docs):
    import pyarrow as pa

    rows = [r for r in docs.collect() if r.text]
    taught = [r for r in docs.where(F.col("lang").isNotNull() & ~language.held_out()).collect() if r.text]
    model = language.train(docs, sample_docs=10_000)
    counts = defaultdict(Counter)
    for r in taught:
        counts[r.lang].update(language.grams(pa.array([r.text]))[0].tolist())
    exact = {k: {g for g, n in c.items() if n >= 1e-4 * sum(c.values())} for k, c in counts.items()}
    assert model.languages == sorted(exact)
    predicted, score = language.identify(pa.array([r.text for r in rows]), model)
    for r, lang, s in zip(rows, predicted, score, strict=True):
        own = language.grams(pa.array([r.text]))[0].tolist()
        shares = {k: sum(g in x for g in own) / max(1, len(own)) for k, x in exact.items()}
        if lang != "und":
            assert abs(shares[lang] - s) < 0.05 + 2 / max(1, len(own)) ** 0.5 and max(shares.values()) - shares[lang] < 0.1
    fill = [((model.slots[0] >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(model.languages))]
    assert np.allclose(model.chance, np.array(fill) ** language.HASHES) and model.chance.max() < 0.05


def test_language_without_labels(spark, docs):
    assert language.train(docs.drop("lang")).languages == []


def test_shared_folder_needs_a_shared_setting(spark, monkeypatch):
    from twinfold.llm import shared

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared.shared_folder(Session(), "x")
