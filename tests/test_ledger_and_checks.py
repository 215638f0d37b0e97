import pytest
from pyspark.sql import functions as F

from twinfold.functions import scalars as S
from twinfold.operators import checks, ledger, readers

VERDICT = "struct<verdict:string,confidence:string,checks:map<string,boolean>,normalized_answer:string,normalized_distractor_answers:array<string>,unstated_assumptions:array<string>,reasonable_alternative_answers:array<string>,invalid_distractor_indices:array<int>,equivalent_distractor_pairs:array<struct<first_index:int,second_index:int>>,issues:array<struct<code:string,message:string>>>"
NAMES = sorted({*checks.ISSUE_CHECKS.values()})


def verdict(**other):
    own = {"verdict": "pass", "confidence": "high", "checks": dict.fromkeys(NAMES, True), "normalized_answer": "four", "normalized_distractor_answers": ["a", "b", "c"], "unstated_assumptions": [], "reasonable_alternative_answers": [], "invalid_distractor_indices": [], "equivalent_distractor_pairs": [], "issues": []}
    return {**own, **other, "checks": {**own["checks"], **other.get("checks", {})}}


def errors(spark, **other):
    df = spark.createDataFrame([(verdict(**other),)], f"validation {VERDICT}")
    row = checks.verdict_errors(df).withColumn("ok", checks.verdict_passes(F.col("validation"))).first()
    return row.errors, row.ok


def test_verdicts(spark):
    assert errors(spark) == ([], True)
    assert errors(spark, confidence="low") == (["pass without high confidence"], False)
    assert "pass with a failed check" in errors(spark, checks={"unique_answer": False})[0]
    assert errors(spark, verdict="fail")[0] == ["no pass though nothing failed"]
    found = errors(spark, verdict="fail", normalized_distractor_answers=["A ", "a", "ﬁve"])[0]
    assert "equal distractors 0-1 not listed" in found and "equal distractors though distractors_mutually_distinct" in found
    assert "distractor 2 equals the answer but isn't invalid" in errors(spark, verdict="fail", normalized_answer="FOUR", normalized_distractor_answers=["a", "b", " four"])[0]
    assert "pair not in order" in errors(spark, verdict="fail", equivalent_distractor_pairs=[{"first_index": 2, "second_index": 1}])[0]
    assert "issue purpose_leakage though purpose_neutral" in errors(spark, verdict="fail", issues=[{"code": "purpose_leakage", "message": "m"}])[0]


def test_budgets_and_feedback(spark):
    none = None
    bad = {"verdict": "fail", "confidence": "low", "checks": {"c": False}, "issues": []}
    rows = [("p", 1, "generator_output_rejection", "e1", none), ("p", 2, "semantic_rejection", none, {**bad, "issues": [{"code": "x", "message": "m"}]}), ("p", 3, "semantic_rejection", none, bad), ("p", 4, "generator_or_deterministic_rejection", "OpenRouter 500", none), ("p", 5, "validator_error", "e", none), ("q", 1, "accepted", none, none)]
    df = spark.createDataFrame(rows, "payload_block_id string, seq int, status string, error string, validation struct<verdict:string,confidence:string,checks:map<string,boolean>,issues:array<struct<code:string,message:string>>>")
    counts = {r.payload_block_id: (r.generation, r.semantic) for r in ledger.attempt_counts(df).collect()}
    assert counts == {"p": (3, 2), "q": (1, 1)}
    assert {r.payload_block_id: r.reason for r in ledger.exhaustion(ledger.attempt_counts(df), 3, 2).collect()} == {"p": "semantic_and_generation_budgets", "q": None}
    assert [r.feedback for r in ledger.latest_feedback(df).collect()] == ["Failed checks: c"]
    assert [r.concerns for r in ledger.prior_concerns(df).collect()] == [["x: m", "failed_check: c"]]
    requests = spark.createDataFrame([("p",), ("q",), ("r",)], "payload_block_id string")
    accepted = df.where("status = 'accepted'")
    assert [r[0] for r in ledger.pending(requests, ledger.attempt_counts(df), accepted, 6, 3).orderBy("payload_block_id").collect()] == ["p", "r"]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Ｆoo\tBAR ß ", '```json\n{"label": "Evaluation"}\n```'), ("plain", "I think deployment."), (None, "evaluation or deployment"), ("x", " Deployment "), ("y", '{"label": "other", "note": "evaluation"}'), ("z", "so 'label': 'evaluation'")], "a string, b string")
    got = rows.select(S.folded(F.col("a")).alias("f"), S.parse_label(F.col("b")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("foo bar ss", "evaluation"), ("plain", None), (None, None), ("x", "deployment"), ("y", None), ("z", "evaluation")]
    hits = spark.createDataFrame([(1, "en", "A test; testing contest"), (2, "ja", "これは試験です")], "id int, language string, text string")
    found = {r.id: r.hits for r in checks.cue_hits(hits, {"en": ["test"], "ja": ["試験"]}, "id", inflected=True).collect()}
    assert found == {1: ["test", "test"], 2: ["試験"]}
    spans = spark.createDataFrame([("a b c", "a x c", "en")], "l string, r string, g string").select(S.diff_spans("l", "r", "g").alias("s")).first().s
    assert [(x.left, x.right) for x in spans] == [("b", "x")]
    rows = spark.createDataFrame([("a  b", "a b", "en"), ("ein", "eine", "de"), (None, "x", "en")], "l string, r string, g string")
    assert [r.s if r.s is None else [(x.left, x.right) for x in r.s] for r in rows.select(S.diff_spans("l", "r", "g").alias("s")).collect()] == [[("", "")], [("", "e")], None]
    with pytest.raises(Exception, match="none of the options"):
        rows.select(checks.answer_ordinal(F.array(F.lit("a")), F.col("r"))).collect()


def test_votes(spark):
    votes = spark.createDataFrame([("i", "r1", "evaluation"), ("i", "r2", "evaluation"), ("i", "r3", "deployment"), ("j", "r1", "evaluation"), ("j", "r2", "deployment"), ("k", "r1", "evaluation"), ("k", "r1", "evaluation")], "blind_item_id string, rater_id string, prediction string")
    got = {r.blind_item_id: (r.majority, r.problem) for r in readers.majority(votes).collect()}
    assert got == {"i": ("evaluation", None), "j": (None, "tie"), "k": ("evaluation", "rater twice")}
