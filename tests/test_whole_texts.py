"""What cuts of texts and small parameters would miss."""

from compare import same
from pyspark.sql import functions as F

from twinfold.operators import matching, probe, resample
from twinfold.queries import QUERIES, SQL, items


def test_spent_passages(spark):
    tail = "this passage stands whole in another text however late"
    new = spark.createDataFrame([(1, f"{'head ' * 30}{tail}"), (2, "same head of forty characters, and then " + "all of this differs from it"), (3, "two words"), (4, None), (5, " "), (6, "nothing of this one occurs anywhere else at all")], "item_id long, text string")
    spent = spark.createDataFrame([(f"{'other ' * 500}\n{tail.upper()} and more",), ("same head of forty characters, and then nothing alike",), ("here are two words\tmore",), (None,), ("",)], "text string")
    got = {r.item_id: (r.windows, r.shared) for r in matching.spent_passages(new, spent, "item_id").collect()}
    assert got == {1: (10, 2), 3: (1, 1)}
    assert matching.spent_passages(new.limit(0), spent, "item_id").count() == 0


def test_freshness_windows_finds_texts_inside_documents(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["freshness_windows"](spark, d)
    inside = spark.read.parquet(f"{d}/benchmark.parquet").alias("b").join(spark.read.parquet(f"{d}/documents.parquet").alias("d"), F.expr("contains(d.text, b.text)")).select("item_id").distinct()
    # a mark without a space may touch the first and the last word
    assert inside.count() > 0 and inside.join(got.where("windows - shared <= 2"), "item_id", "left_anti").count() == 0
    assert same(got, SQL["freshness_windows"], d) == ""


def test_rendering_holds_whole_texts(spark):
    d = "/root/testdata/sf0.001"
    rows, texts = QUERIES["render_blocks"](spark, d).collect(), {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    squeeze = lambda t: "".join(t.split())
    assert rows and all(squeeze(texts[int(r.payload_block_id[3:])]) in squeeze(r.text) for r in rows)


def test_nulls_and_strengths_of_the_reference(spark):
    d = "/root/testdata/sf0.001"
    null = {r.rep: r.paired_accuracy for r in QUERIES["orientation_null"](spark, d).collect()}
    assert set(null) == set(range(20))
    rows = items(spark, d).withColumn("y", (F.col("purpose") == "evaluation").cast("int")).drop("score", "pred")
    labelled = rows.withColumn("_label", resample.orientation_labels(rows, "block", 7))
    own = matching.twins(probe.out_of_fold(labelled, {"null": (F.lit(True), F.lit(True))}, y="_label"), ["block", "format"])
    assert abs(own.agg(F.avg((F.col("delta") > 0).cast("double"))).first()[0] - null[7]) < 1e-6
    assert {r.c for r in QUERIES["pick_c"](spark, d).select("c").distinct().collect()} == {0.005, 0.02, 0.05, 0.2, 0.5}
