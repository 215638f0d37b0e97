"""Operators 11 to 13: whole results against plain re-computation, and odd tables."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from twinfold.llm import conversation_repair, simhash, source_divergence

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- source divergence ---------------------------------------------------------------------------------------------------


def plain_divergence(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        found = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for of, s, t in rows if of == lang]
        df = Counter(w for _, ws in found for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        by, v = defaultdict(Counter), len(kept)
        for s, ws in found:
            by[s].update(w for w in ws if w in kept)
        every = sum(by.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v)  # noqa: B023, E731
        for s in by:
            pairs = [(o, sum(abs(share(by[s], w) - share(by[o], w)) for w in kept)) for o in by if o != s]
            best = [(w, share(by[s], w) - share(every, w)) for w in kept if by[s][w] and share(by[s], w) > share(every, w)]
            for part, items, most in (("pair", pairs, None), ("term", best, 50)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def test_divergence_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = source_divergence.op11_source_divergence(spark, SF).collect()
    assert sorted(map(tuple, got)) == plain_divergence([(r.lang, r.source, r.text) for r in docs.collect()], 30) and len(got) > 500


def test_divergence_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "SOURCES_A_BLOCK", 2)
    monkeypatch.setattr(source_divergence, "TERMS_A_PART", 3)
    draw = random.Random(3)
    words = ["été", "Été", "a1b", "don't", "x" * 3000, "ß_ß", "Zz", "日本 語", "\x00q", ""]
    rows = [(draw.choice(["en", "de", None, ""]), draw.choice(["s", "t", None, "ü", "s,t"]), draw.choice([None, "", " ".join(draw.choices(words, k=9))])) for _ in range(60)]
    rows += [("lone", "only", "w"), ("none", "a", None), ("none", "b", "1 2 3")] + [rows[0]] * 3
    df = spark.createDataFrame([(1, *r, 5) for r in rows], "doc_id long, lang string, source string, text string, part int").repartition(5)
    assert sorted(map(tuple, source_divergence.source_divergence(df, 4).collect())) == plain_divergence(rows, 4)
    assert source_divergence.source_divergence(df.limit(0), 4).collect() == []


def test_stripes_that_spill_and_merge_are_the_same():
    draw, stripes, parts = random.Random(5), source_divergence.Stripes(), []
    docs = [("en", f"s{draw.randrange(3)}", " ".join(draw.choices([chr(97 + k) * 2 for k in range(20)], k=draw.randrange(30))).encode()) for _ in range(300)]
    for d in docs:
        stripes.add(*d)
        if stripes.cells > 25:
            parts += list(stripes.rows())
            stripes = source_divergence.Stripes()
    parts += list(stripes.rows())
    one = source_divergence.Stripes()
    for d in docs:
        one.add(*d)
    rows = pa.Table.from_batches(parts).sort_by([("lang", "ascending"), ("term", "ascending")])
    read = lambda batches: {(r["lang"], r["term"]): (r["df"], {s: n for s, n in zip(r["sources"], r["counts"], strict=True)}) for b in batches for r in b.to_pylist()}
    assert len(parts) > 20
    merged = read(source_divergence._merge(1)(iter(rows.combine_chunks().to_batches(max_chunksize=7))))
    assert merged == read(one.rows())


def test_shares_are_exact_at_any_count():
    for total in (7, 10**9 + 7, 8 * 10**15):
        count = np.array([0, 1, 5, total // 3, total - 1, total])
        assert source_divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]


# -- SimHash -------------------------------------------------------------------------------------------------------------


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Of (id, fingerprint): id -> smallest reachable id."""
    every = sorted({f for _, f in prints})
    array, root = np.array(every, np.uint64), {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = defaultdict(list)
    for i, f in prints:
        own[f].append(i)
    for f in every:
        for g in array[np.bitwise_count(array ^ np.uint64(f)) <= 3].tolist():
            a, b = find(own[f][0]), find(own[g][0])
            root[max(a, b)] = min(a, b)
        for i in own[f]:
            a, b = find(own[f][0]), find(i)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_simhash_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    root = plain_components(prints)
    got = simhash.op12_simhash(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", root[i]) for i, f in prints)
    assert any(r.component_id != r.doc_id for r in got)


def test_simhash_of_odd_rows(spark):
    texts = [None, "", " \t\n", "One", "one two", "One two THREE", "one\x0btwo three", "é È", "\x1cx y", "a b c " * 30_000, "x" * 100_000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(2, " \t\n", "x"), (3, "one two", "y"), (None, "one two", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    root = plain_components([(i, plain_print(t)) for i, t, _ in rows if i is not None])
    got = sorted((tuple(r) for r in simhash.simhash_links(df).collect()), key=repr)
    assert got == sorted(((i, f"{plain_print(t):016x}", root.get(i)) for i, t, _ in rows), key=repr)
    assert simhash.simhash_links(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [4096, 5])
def test_links_of_fingerprints_at_all_distances(spark, bucket):
    """Chains, balls and strangers; small buckets are split again and again."""
    draw = random.Random(bucket)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        f = draw.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            for b in draw.sample(range(64), draw.randrange(1, 6)):
                f ^= 1 << b
    prints = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in prints], "class_id long, fp long")
    from twinfold.llm.components import components

    own = {i: i for i, _ in prints} | {r.node: r.root for r in components(simhash.fingerprint_links(df, bucket)).collect()}
    assert own == plain_components(prints)


def test_planes_find_what_pairs_have():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    x[100:400] = x[100] ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 8, 300).astype(np.uint64))
    p = simhash.planes(x)
    for lag in (1, 2, 63, 64, 65, 130, 499):
        for radius in (1, 2, 3):
            near = np.bitwise_count(x[:-lag] ^ x[lag:]) <= radius
            wanted = draw.random(len(near)) < 0.9
            assert np.sort(simhash.near_at_lag(p, lag, wanted, radius)).tolist() == np.flatnonzero(near & wanted).tolist()


# -- conversations -------------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\f\r"


def plain_rows(rows):
    """conv_id -> rows after damage in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def plain_repair(rows):
    """Cheapest, then least edits by search over (cost, letters) in order: no costs to the end, no ranks."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, settled = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, due[0], (*out, f"{due}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = cost + (faults[i] == "truncated")
                if role[:1] == due[0] or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, due[0], (*out, f"{due}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check_repair(got, rows):
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *plain_repair(v)) for k, v in plain_rows(rows).items()), key=repr)


def test_repair_of_all_conversations(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = conversation_repair.op13_conversation_repair(spark, sf).collect()
    check_repair(got, rows)
    assert {c for r in got for c in r.audit} == set("DIKR")


def test_repair_of_odd_conversations(spark, monkeypatch):
    draw = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "sys", "User", "u"], ["Yes.", "No", "", None, " \n", "What? ", "Ü!\x0b", "a.b", "Yes."]
    rows = [(draw.choice([None, *range(80)]), draw.choice([None, *range(-2, 9)]), draw.choice(roles), draw.choice(texts)) for _ in range(900)]
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)] + [(101, 5, "user", "x" * 300_000)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    check_repair(conversation_repair.repair(df).collect(), rows)
    assert conversation_repair.repair(df.limit(0)).collect() == []


def test_ranks_over_many_small_conversations():
    """All codes of up to four rows, and texts that pass through the file."""
    every = [c for n in range(5) for c in itertools.product([1, 2, 3, 0, 4, 10], repeat=n)]
    codes = [np.array(c, np.int64) for c in every]
    target, on, cost, first = conversation_repair.optimal_arcs(codes)
    audits = conversation_repair.least_walks(target, on, first)
    letters = {1: "system", 2: "user", 3: "assistant", 0: "tool"}
    for k in range(0, len(every), 7):
        rows = [(0, letters[c & 3], "" if c & 4 else f"{n}{'' if c & 8 else '.'}") for n, c in enumerate(every[k])]
        assert (cost[first[k]], audits[k]) == plain_repair(rows)[5:7]


def test_equal_first_letters_are_told_apart_by_rank():
    """Two arcs of one letter: the walk goes where the rest is least, however far off that shows."""
    # node 0: K to 1 and I to 6 (not taken); 1..5 a chain K K K K R, 6..: a chain K K K K D
    n = 12
    target, on = np.tile(np.arange(n), (5, 1)), np.zeros((5, n), bool)
    for a, kind, b in [(0, 3, 1), *[(k, 3, k + 1) for k in range(1, 5)], (5, 4, 11)]:
        target[kind, a], on[kind, a] = b, True
    assert conversation_repair.least_walks(target, on, np.array([0, 3, 11])) == ["KKKKKR", "KKR", ""]


def test_seen_digests_beyond_the_hash(monkeypatch):
    monkeypatch.setattr(conversation_repair, "HASHED", 10)
    seen, digest = conversation_repair.Seen(), lambda k: hashlib.md5(str(k).encode()).digest()
    assert not any(seen.add(digest(k)) for k in range(95)) and all(seen.add(digest(k)) for k in range(95)) and len(seen.old) == 90
