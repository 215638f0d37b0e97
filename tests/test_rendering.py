"""Planning, rendering and validation: whole grids, and mutations that must be found."""

from pyspark.sql import functions as F

from twinfold.operators import checks, matching, render
from twinfold.plans import grids

FORMATS = {"benchmark": "{purpose}\n\n{body}\n\n{options}", "casual": "{purpose} {body}"}


def payloads(spark, n=10):
    rows = [(f"pb_t{i:03d}_01", f" context {i} {{x}} ", f"question {i}?\n", f"right {i}", [f"wrong {i} {k}" for k in range(3)]) for i in range(n)]
    return spark.createDataFrame(rows, "payload_block_id string, context string, question string, correct_answer string, distractors array<string>")


def pairs(spark):
    return spark.createDataFrame([("a", "ff01", "both", "Test:", "Live:"), ("b", "ff02", "both", "Exam:", "Users:")], "pair_id string, family_id string, cue_locus string, evaluation string, deployment string")


def rendered(spark, seeded=False):
    return render.render_blocks(payloads(spark), pairs(spark), FORMATS, seeded)


def test_grid_of_requests(spark):
    topics = spark.createDataFrame([(f"t{i:03d}", f"Topic {i}", "family") for i in range(16)], "topic_id string, display_name string, task_family string")
    rows = grids.request_grid(topics, 5, "{topic_display_name} {topic_id} {task_family} {sample_number}").collect()
    assert len(rows) == 80 == len({r.request_id for r in rows})
    assert rows[0].payload_block_id == "pb_t000_01" and rows[0].user == "Topic 0 t000 family 1"


def test_blocks_are_complete_and_repeatable(spark):
    a, b = rendered(spark), rendered(spark)
    assert a.count() == 40 and checks.block_checks(a).count() == 0
    assert render.reconstruct_diff(a, b, "item_id").count() == 0
    row = a.where("payload_block_id = 'pb_t001_01' and purpose = 'deployment' and format = 'casual'").first()
    assert row.text == "Users: context 1 {x}\n\nquestion 1?" and row.answer_key is None and row.label == 0


def test_mutations_are_found(spark):
    good = rendered(spark)
    bad = good.withColumn("text", F.when(F.col("item_id") == good.orderBy("item_id").first().item_id, "tampered").otherwise(F.col("text")))
    assert [r.problem for r in render.reconstruct_diff(bad, good, "item_id").collect()] == ["changed"]
    short = good.where("not (payload_block_id = 'pb_t002_01' and purpose = 'evaluation' and format = 'casual')")
    found = checks.block_checks(short).collect()
    assert [(r.payload_block_id, r.n, r.problems) for r in found] == [("pb_t002_01", 3, ["cells"])]
    assert [r.problem for r in matching.block_cover(good.where("payload_block_id <> 'pb_t003_01'"), payloads(spark)).collect()] == ["missing"]


def test_seeded_order_is_pythons(spark):
    import hashlib
    import random

    for r in rendered(spark, seeded=True).where("format = 'benchmark' and purpose = 'evaluation'").collect():
        i = int(r.payload_block_id[4:7])
        own = [f"right {i}", *[f"wrong {i} {k}" for k in range(3)]]
        random.Random(int(hashlib.sha256(r.payload_block_id.encode()).hexdigest()[:16], 16)).shuffle(own)
        assert r.answer_key == "ABCD"[own.index(f"right {i}")] and r.text.endswith("\n".join(f"{x}. {o}" for x, o in zip("ABCD", own, strict=True)))


def test_slots_and_overrides(spark):
    rows = spark.createDataFrame([(1, "{{a}} and {{b}}", {"a": "x", "b": "y"}), (2, "{{a}}", {}), (3, "-", {"a": "x"})], "id int, body string, slots map<string,string>")
    got = {r.id: (r.filled, r.slot_problem) for r in render.fill_slots(rows, "body", "slots").collect()}
    assert got == {1: ("x and y", None), 2: ("{{a}}", "missing"), 3: ("-", "unknown")}
    items = spark.createDataFrame([(1, "old\nrest"), (2, "other\nrest")], "k int, text string")
    new = spark.createDataFrame([(1, "new", "old"), (2, "new", "old")], "k int, frame string, old_frame string")
    assert {r.k: (r.text, r.override_problem) for r in render.apply_overrides(items, new, ["k"]).collect()} == {1: ("new\nrest", False), 2: ("other\nrest", True)}


def test_global_rank_of_text_and_numbers(spark):
    rows = spark.createDataFrame([(f"pb_{i:04d}", i * i) for i in range(500)], "k string, n long").repartition(7)
    assert all(r["rank"] == int(r.k[3:]) for r in grids.global_rank(rows, "k").collect())
    assert all(r["rank"] ** 2 == r.n for r in grids.global_rank(rows, "n").collect())
