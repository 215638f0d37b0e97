"""Further registered queries: checks of rows and sets, readers, controls, records. Their stand-ins are columns of the given
tables by expressions that Spark and SQL share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import checks, ledger, matching, metrics, readers, render, resample
from .plans import grids
from .sources import tables
from .queries import ITEMS, items, query, r6, split_draws, table


class Rows:
    """A stand-in: expressions over one table, the same in Spark and in SQL."""

    def __init__(self, source: str, /, **columns: str):
        self.source, self.columns = source, columns

    def __call__(self, spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, self.source).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def __str__(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.source})"


def joined(*names: str):
    """Arrays of messages as text, so that both engines give the same."""
    return lambda df: df.withColumns({c: F.array_join(c, ";") for c in names})


# -- text functions ------------------------------------------------------------------------------------------------------

REPLIES = Rows("documents", doc_id="doc_id", reply="""CASE WHEN doc_id % 6 = 0 THEN concat('{"label": "Evaluation", "n": ', doc_id, '}') WHEN doc_id % 6 = 1 THEN ' Deployment ' WHEN doc_id % 6 = 2 THEN concat('{"label": "', source, '", "note": "evaluation"}')
 WHEN doc_id % 6 = 3 THEN concat('I answer "label": "deployment" as ', lang) WHEN doc_id % 6 = 4 THEN 'I think this is evaluation' ELSE text END""")


@query(f"""SELECT doc_id, CASE WHEN json_valid(reply) THEN CASE WHEN lower(trim(reply->>'$.label')) IN ('evaluation', 'deployment') THEN lower(trim(reply->>'$.label')) END WHEN lower(trim(reply)) IN ('evaluation', 'deployment') THEN lower(trim(reply))
 WHEN instr(lower(reply), '"label": "evaluation"') > 0 AND instr(lower(reply), '"label": "deployment"') = 0 THEN 'evaluation' WHEN instr(lower(reply), '"label": "deployment"') > 0 AND instr(lower(reply), '"label": "evaluation"') = 0 THEN 'deployment' END AS label FROM {REPLIES}""")
def parse_labels(spark, d):
    return REPLIES(spark, d).select("doc_id", S.parse_label(F.col("reply")).alias("label"))


RESPONSES = Rows("events", event_id="event_id", response="""CASE WHEN event_type = 'click' THEN '{"choices": [{"finish_reason": "length"}]}' WHEN event_type = 'view' THEN '{"choices": [{"finish_reason": "max_tokens"}]}'
 WHEN event_type = 'purchase' THEN '{"choices": [{"finish_reason": "stop", "native_finish_reason": "max_output_tokens"}]}' ELSE concat('{"choices": [], "value": ', event_id, '}') END""")


@query(f"SELECT event_id, coalesce(response->>'$.choices[0].finish_reason' = 'length', false) OR coalesce(response->>'$.choices[0].native_finish_reason' = 'max_output_tokens', false) AS truncated FROM {RESPONSES}")
def truncated_responses(spark, d):
    return RESPONSES(spark, d).select("event_id", S.truncated(F.col("response")).alias("truncated"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def parse_objects(spark, d):
    return table(spark, d, "events").select("event_id", S.parse_object(F.col("props"), "k bigint").k.alias("k"))


@query("SELECT vec_id, round(ln(1 + exp(CAST(embedding[1] AS DOUBLE))), 6) AS softplus FROM embeddings")
def softplus(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(S.softplus(F.get("embedding", F.lit(0)).cast("double"))).alias("softplus"))


@query("SELECT o_orderkey, CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS BIGINT) AS ordinal FROM orders")
def answer_ordinals(spark, d):
    options = F.array(*map(F.lit, ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")))
    return table(spark, d, "orders").select("o_orderkey", checks.answer_ordinal(options, F.col("o_orderpriority")).alias("ordinal"))


@query("SELECT p_partkey, len(list_distinct(list_transform([p_name, p_brand, ' ' || upper(p_brand), p_type], lambda x: lower(trim(x))))) = 4 AS distinct_answers FROM part UNION ALL SELECT p_partkey, len(list_distinct([lower(p_name), lower(p_brand), lower(p_type), CAST(p_size AS VARCHAR)])) = 4 FROM part UNION ALL SELECT p_partkey, p_size <= 25 FROM part")
def distinct_answers(spark, d):
    part = table(spark, d, "part")
    one = part.select("p_partkey", checks.distinct_answers(F.col("p_name"), F.array(F.col("p_brand"), F.concat(F.lit(" "), F.upper("p_brand")), F.col("p_type"))).alias("distinct_answers"))
    two = part.select("p_partkey", checks.distinct_answers(F.col("p_name"), F.array(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"))).alias("distinct_answers"))
    # the large ones have the brand again: in other letters, a sharp s spelt out, with a tab and a no-break space around it
    sharp = F.array(F.concat("p_brand", F.lit(" Straße")), F.when(F.col("p_size") > 25, F.concat(F.lit("\t"), F.upper("p_brand"), F.lit(" STRASSE\u00a0"))).otherwise("-"), F.lit("="))
    return one.unionByName(two).unionByName(part.select("p_partkey", checks.distinct_answers(F.col("p_name"), sharp).alias("distinct_answers")))


# -- row rules -----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin letters' END, CASE WHEN regexp_matches(text, '[０-９]') THEN 'full-width digits' END) AS problems FROM documents""")
def script_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(checks.script_hits(F.col("text")), ";").alias("problems"))


@query("""WITH h AS (SELECT doc_id, lang AS language, CASE WHEN lang = 'en' THEN concat_ws(',', nullif(trim(repeat('license,', len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^a-z])', '\\1\\1', 'g') || ' ', '[^a-z]license(s|es|ed|ing|d)?[^a-z]'))::INT), ','), ''), nullif(trim(repeat('the,', len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^a-z])', '\\1\\1', 'g') || ' ', '[^a-z]the(s|es|ed|ing|d)?[^a-z]'))::INT), ','), ''))
 WHEN lang = 'de' THEN trim(repeat('en,', ((length(text) - length(replace(text, 'en', ''))) // 2)::INT), ',') ELSE '' END AS hits FROM documents) SELECT * FROM h WHERE hits <> ''""")
def cue_hits(spark, d):
    docs = table(spark, d, "documents").withColumn("language", F.col("lang"))
    return checks.cue_hits(docs, {"en": ["license", "the"], "de": ["en"]}, "doc_id", inflected=True).withColumn("hits", F.array_join("hits", ","))


@query("""SELECT doc_id, concat_ws(';', CASE WHEN instr(lower(text), lower(lang)) > 0 AND instr(lower(source), lower(lang)) = 0 THEN 'lang' END, CASE WHEN instr(lower(text), lower(source)) > 0 THEN 'source' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])' || lang || '([^a-z]|$)') THEN 'label' END) AS fields FROM documents
 WHERE (instr(lower(text), lower(lang)) > 0 AND instr(lower(source), lower(lang)) = 0) OR instr(lower(text), lower(source)) > 0 OR regexp_matches(lower(text), '(^|[^a-z])' || lang || '([^a-z]|$)')""")
def leakage_of_topics(spark, d):
    docs = table(spark, d, "documents").withColumn("label", F.col("lang"))
    return checks.leakage_hits(docs, "doc_id", "text", ["lang", "source"], "label", ["source"], ["lang"]).transform(joined("fields"))


CONTENT = Rows("documents", doc_id="doc_id", language="CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE 'en' END", text="""CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 7 = 1 THEN '{"context": "a"}' WHEN doc_id % 7 = 2 THEN concat('{"context": "試験 ', source, '", "question": "どれ"}') WHEN doc_id % 7 = 3 THEN '{"context": "これは文章です。", "question": "１番"}'
 WHEN doc_id % 7 = 4 THEN concat('{"context": "tested by ', source, '", "question": "', lang, '"}') WHEN doc_id % 7 = 5 THEN '{"context": " ", "question": "The correct answer is A"}' WHEN doc_id % 3 = 0 THEN concat('{"context": "plain", "question": ', doc_id, '}') WHEN doc_id % 3 = 1 THEN concat('```JSON ', '{"context": "plain ', source, '", "question": "test"}', ' ``` ') ELSE concat('{"context": {"a": "', lang, '"}, "question": "what"}') END""")


@query(f"""WITH p AS (SELECT *, trim(text) = '' AS empty, CASE WHEN trim(text) <> '' AND json_type(j, '$.context') = 'VARCHAR' AND json_type(j, '$.question') = 'VARCHAR' THEN j->>'$.context' END AS c, CASE WHEN trim(text) <> '' AND json_type(j, '$.context') = 'VARCHAR' AND json_type(j, '$.question') = 'VARCHAR' THEN j->>'$.question' END AS q FROM (SELECT *, CASE WHEN trim(text) <> '' THEN regexp_replace(regexp_replace(trim(text), '^```(json|JSON)? *', ''), ' *```$', '') END AS j FROM {CONTENT})), w AS (SELECT *, concat_ws(chr(10), c, q) AS t FROM p),
 x AS (SELECT *, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(t, '[^ぁ-んァ-ヶ一-龯]', '', 'g')) AS jp FROM w)
 SELECT doc_id, CASE WHEN empty THEN 'empty' WHEN c IS NULL OR q IS NULL THEN 'not the slots' ELSE concat_ws(';', CASE WHEN trim(c) = '' OR trim(q) = '' THEN 'empty slot' END,
 CASE WHEN language = 'en' AND regexp_matches(lower(t), '(^|[^a-z])test(s|es|ed|ing|d)?([^a-z]|$)') OR language = 'ja' AND instr(t, '試験') > 0 THEN 'cue' END, CASE WHEN language = 'ja' AND latin + jp > 0 AND latin / (latin + jp) > 0.3 THEN 'latin share' END,
 CASE WHEN language = 'ja' AND jp < 1 THEN 'japanese characters' END, CASE WHEN language = 'ja' AND regexp_matches(t, '[０-９]') THEN 'full-width digits' END, CASE WHEN language = 'en' AND instr(lower(t), 'correct answer') > 0 THEN 'phrase correct answer' END) END AS qc_problems FROM x""")
def content_qc(spark, d):
    out = checks.content_qc(CONTENT(spark, d), slots=["context", "question"], lexicon={"en": ["test"], "ja": ["試験"]}, phrases={"en": ["correct answer"]})
    return out.select("doc_id", F.array_join("qc_problems", ";").alias("qc_problems"))


@query("SELECT l_orderkey, l_linenumber, l_quantity IS NOT DISTINCT FROM l_linenumber AS quantity, l_returnflag IS NOT DISTINCT FROM l_linestatus AS status FROM lineitem")
def fields_agree(spark, d):
    return checks.fields_agree(table(spark, d, "lineitem"), {"quantity": ("l_quantity", "l_linenumber"), "status": ("l_returnflag", "l_linestatus")}).select("l_orderkey", "l_linenumber", "quantity", "status")


BODIES = Rows("pages", page_id="page_id", body="CASE WHEN page_id % 4 = 0 THEN concat('Item 3 of 9 ', url) WHEN page_id % 4 = 1 THEN concat(url, ' {{N}}') WHEN page_id % 4 = 2 THEN html ELSE url END", constraint_name="CASE WHEN page_id % 3 = 0 THEN 'unconstrained' ELSE 'short' END", kind="CASE WHEN page_id % 2 = 0 THEN 'none' ELSE 'length' END", scaffolding="CASE WHEN page_id % 5 = 0 THEN 'xml' ELSE 'plain' END")


@query(f"""SELECT page_id, concat_ws(';', CASE WHEN regexp_matches(body, '(?im)\\{{\\{{(?:N|番号)\\}}\\}}|\\bItem\\s+\\d+\\s+of\\s+\\d+\\b|^\\s*\\d+[.)]\\s') THEN 'numbered' END, CASE WHEN regexp_matches(body, '</?[A-Za-z][^>]*>') THEN 'markup' END,
 CASE WHEN (constraint_name = 'unconstrained') <> (kind = 'none') THEN 'constraint' END, CASE WHEN scaffolding <> 'plain' THEN 'scaffolding' END) AS problems FROM {BODIES}""")
def body_rules(spark, d):
    return BODIES(spark, d).select("page_id", F.array_join(checks.body_rules(F.col("body"), F.col("constraint_name"), F.col("kind"), F.col("scaffolding")), ";").alias("problems"))


FRAMES = Rows("conversations", conv_id="conv_id", turn="turn", text="concat(role, ' writes: ', text)", kind="role")


@query(f"""SELECT conv_id, turn, concat_ws(';', CASE WHEN instr(lower(text), CASE kind WHEN 'user' THEN 'user writes' WHEN 'assistant' THEN 'assistant says' END) = 0 THEN 'attribution' END, CASE WHEN len(regexp_extract_all(text, '[.!?。](?:\\s|$)')) <> 1 THEN 'sentences' END,
 CASE WHEN regexp_matches(text, '[<>*_#`]') THEN 'markup' END, CASE WHEN instr(text, '{{{{') > 0 THEN 'slot' END, CASE WHEN instr(lower(text), 'password') > 0 THEN 'directive password' END) AS problems FROM {FRAMES}""")
def frame_rules(spark, d):
    problems = checks.frame_rules(F.col("text"), {"user": "user writes", "assistant": "assistant says"}, F.col("kind"), ("password",))
    return FRAMES(spark, d).select("conv_id", "turn", F.array_join(problems, ";").alias("problems"))


CONTAINERS = Rows("orders", container_id="o_orderkey", body="concat('{{', lower(o_orderstatus), '}} and {{x}} {{x}}')", slots="CASE WHEN o_orderkey % 3 = 0 THEN array(lower(o_orderstatus), 'x') ELSE array('x') END", contract="CASE WHEN o_orderkey % 2 = 0 THEN 'multiple_choice' ELSE 'free' END")


@query("""WITH c AS (SELECT o_orderkey AS container_id, lower(o_orderstatus) AS s, CASE WHEN o_orderkey % 3 = 0 THEN [lower(o_orderstatus), 'x'] ELSE ['x'] END AS slots, o_orderkey % 2 = 0 AS mc FROM orders)
 SELECT container_id, concat_ws(';', CASE WHEN slots <> [s, 'x'] THEN 'slots' END, CASE WHEN mc THEN 'options' END, CASE WHEN mc THEN 'key' END) AS problems FROM c WHERE slots <> [s, 'x'] OR mc""")
def container_rules(spark, d):
    return checks.container_rules(CONTAINERS(spark, d)).transform(joined("problems"))


@query("""SELECT c_custkey, replace(replace('Dear {{name}} of {{seg}}', '{{name}}', c_name), '{{seg}}', c_mktsegment) AS filled, NULL::VARCHAR AS slot_problem FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, replace('Dear {{name}} of {{seg}}', '{{name}}', c_name), 'missing' FROM customer WHERE c_custkey % 2 = 1""")
def fill_slots(spark, d):
    name = F.map_from_arrays(F.array(F.lit("name")), F.array("c_name"))
    rows = table(spark, d, "customer").withColumn("body", F.lit("Dear {{name}} of {{seg}}")).withColumn("slots", F.when(F.col("c_custkey") % 2 == 0, F.map_concat(name, F.map_from_arrays(F.array(F.lit("seg")), F.array("c_mktsegment")))).otherwise(name))
    return render.fill_slots(rows, "body", "slots").select("c_custkey", "filled", "slot_problem")


REQUESTS = Rows("documents", doc_id="doc_id", text="text", language="CASE WHEN doc_id % 3 = 0 THEN 'ja' ELSE lang END", source="source", lang="lang")


@query(f"""WITH r AS (SELECT doc_id, concat_ws(';', CASE WHEN instr(lower(text), lower(source)) > 0 THEN 'leaks source' END, CASE WHEN language = 'ja' AND regexp_matches(text, '[A-Za-z０-９]') THEN 'script' END,
 CASE WHEN greatest(1, ceil(length(text) / CASE WHEN language = 'ja' THEN 1.8 ELSE 4.0 END)) > 500 THEN 'too long' END) AS problems FROM {REQUESTS}) SELECT * FROM r WHERE problems <> ''""")
def audit_requests(spark, d):
    return checks.audit_requests(REQUESTS(spark, d), "doc_id", "text", ["source"], 500).transform(joined("problems"))


# -- set rules -----------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey AS job_id, count(*) AS n_seeds, count(DISTINCT l_partkey % 500) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_partkey % 500)")
def seed_collisions(spark, d):
    return grids.seed_collisions(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("job_id"), (F.col("l_partkey") % 500).alias("seed")))


@query("""WITH u AS (SELECT lang, count(*) AS n, sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) AS i, sum(CAST(ceil(n_chars / 8.0) AS BIGINT)) AS o FROM documents GROUP BY 1), s AS (SELECT scenario, k, sum(n) * k AS calls, sum(i) * k AS i, sum(o) * k AS o, sum(i * 0.000002 + o * 0.000008) * k AS usd FROM u, (VALUES ('first_attempts', 1), ('all_attempts', 3)) AS t(scenario, k) GROUP BY 1, 2)
 SELECT scenario, CAST(calls AS BIGINT) AS calls, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, round(CAST(usd AS DOUBLE), 6) AS usd, CASE WHEN scenario = 'all_attempts' THEN usd <= 1.0 END AS within_budget FROM s""")
def plan_cost(spark, d):
    jobs = table(spark, d, "documents").select(F.col("lang").alias("profile"), F.ceil(F.col("n_chars") / 4.0).alias("input_tokens"), F.ceil(F.col("n_chars") / 8.0).alias("output_tokens"))
    prices = jobs.select("profile").distinct().select("profile", F.lit("0.000002").cast("decimal(18,12)").alias("usd_per_input"), F.lit("0.000008").cast("decimal(18,12)").alias("usd_per_output"))
    return grids.plan_cost(jobs, prices, 3, 1.0).withColumn("usd", r6(F.col("usd").cast("double")))


PAIRS = Rows("supplier", pair_id="s_suppkey", family_id="s_nationkey", cue_locus="CASE WHEN s_suppkey % 3 = 0 THEN 'noun_only' WHEN s_suppkey % 3 = 1 THEN 'verb_only' ELSE 'other' END")


@query(f"""WITH e AS (SELECT cue_locus, family_id, count(*) AS n FROM {PAIRS} GROUP BY 1, 2) SELECT cue_locus, CAST(sum(n) AS BIGINT) AS pairs, count(*) AS families, count(*) FILTER (WHERE n > 1) AS repeated, count(*) >= 3 AND cue_locus IN ('noun_only', 'verb_only', 'both') AS enough FROM e GROUP BY 1""")
def locus_balance(spark, d):
    return checks.locus_balance(PAIRS(spark, d))


@query("SELECT p_brand AS span, count(*) + count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT p_type || '!', count(*) FROM part GROUP BY 1 HAVING count(*) > 2")
def span_counts(spark, d):
    return checks.span_counts(table(spark, d, "part").select(F.array("p_brand", "p_brand", F.concat("p_type", F.lit("!"))).alias("spans")))


_ODD = "CAST((event_id % 24 - event_id % 2) / 2 + 1 AS INT)"
#: Banks of 48 events; what breaks rules comes with the types, users and values of the events.
CONTROLS = Rows(
    "events", bank="event_id - event_id % 48", control_id="CASE WHEN value > 99 THEN event_id - event_id % 2 ELSE event_id END", language="CASE WHEN event_id % 48 < 24 THEN 'en' ELSE 'de' END", control_pair_id=f"concat('lcp', lpad(CAST({_ODD} AS VARCHAR(9)), 2, '0'))",
    lexical_cue="CASE WHEN user_id % 29 = 0 THEN 'evaluation' WHEN event_id % 2 = 0 THEN 'evaluation' ELSE 'deployment' END", cue_family=f"CASE WHEN {_ODD} > 8 OR user_id % 31 = 0 THEN 'implicit_cue' ELSE 'explicit_lexeme' END",
    control_type=f"CASE WHEN event_type = 'click' AND value > 90 THEN 'other' WHEN {_ODD} IN (1, 2, 5, 6, 9) THEN 'mention_only' ELSE 'crossed_distractor' END", intended_purpose=f"CASE WHEN {_ODD} IN (1, 2, 5, 6, 9) THEN 'neutral' WHEN event_id % 2 = 1 OR user_id % 23 = 0 THEN 'evaluation' ELSE 'deployment' END",
    cue_term=f"CASE WHEN {_ODD} > 8 THEN concat('Term', CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END) WHEN user_id % 19 = 0 THEN 'Assessment' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 48 < 24 THEN 'Evaluation' ELSE 'Prüfung' END ELSE CASE WHEN event_id % 48 < 24 THEN 'deployment' ELSE 'EINSATZ' END END",
    text=f"CASE WHEN value < 1 THEN 'the same' ELSE concat('Text ', CAST(event_id AS VARCHAR(20)), CASE WHEN user_id % 13 = 0 THEN '' WHEN {_ODD} > 8 THEN CASE WHEN event_id % 2 = 0 THEN ' TERMA ' ELSE ' termB ' END WHEN user_id % 19 = 0 THEN ' assessment ' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 48 < 24 THEN ' evaluation ' ELSE ' PRÜFUNG ' END ELSE CASE WHEN event_id % 48 < 24 THEN ' Deployment ' ELSE ' Einsatz ' END END, CASE WHEN user_id % 17 = 0 THEN 'terma deployment' ELSE '' END, event_type) END",
)
_TERMS = {"en": {"evaluation": "evaluation", "deployment": "deployment"}, "de": {"evaluation": "Prüfung", "deployment": "Einsatz"}}


@query(f"""WITH c AS (SELECT *, lower(text) AS t, lower(cue_term) AS m FROM {CONTROLS}), x(language, ev, de) AS (VALUES ('en', 'evaluation', 'deployment'), ('de', 'prüfung', 'einsatz')),
 r AS (SELECT bank, language, CAST(control_id AS VARCHAR) AS key, unnest([CASE WHEN cue_family = 'explicit_lexeme' AND m <> CASE WHEN lexical_cue = 'evaluation' THEN ev ELSE de END THEN 'not the explicit term' END, CASE WHEN instr(t, m) = 0 THEN 'term not in text' END, CASE WHEN cue_family = 'implicit_cue' AND (instr(t, ev) > 0 OR instr(t, de) > 0) THEN 'explicit term in implicit text' END]) AS problem FROM c JOIN x USING (language)),
 o AS (SELECT a.bank, a.language, a.control_pair_id, a.control_id FROM c a JOIN c b ON a.bank = b.bank AND a.language = b.language AND a.control_pair_id = b.control_pair_id AND a.control_id <> b.control_id AND instr(a.t, b.m) > 0),
 d AS (SELECT bank, language, control_pair_id, control_id FROM (SELECT bank, language, control_pair_id, control_id, m, t, count(*) OVER (PARTITION BY bank, language, control_pair_id, m) AS n FROM c) WHERE n > 1 AND instr(t, m) > 0),
 w AS (SELECT bank, language, k, 'lcp' || printf('%02d', k) AS control_pair_id FROM (SELECT DISTINCT bank FROM c), (SELECT language FROM x), (SELECT CAST(k AS INT) AS k FROM range(1, 13) AS y(k))),
 g AS (SELECT bank, language, control_pair_id, count(*) AS n, count(*) FILTER (lexical_cue = 'evaluation') AS e, count(*) FILTER (lexical_cue = 'deployment') AS d, count(*) FILTER (control_type = 'mention_only' AND intended_purpose = 'neutral') AS mn, count(*) FILTER (control_type = 'crossed_distractor') AS cr, count(DISTINCT intended_purpose || '/' || lexical_cue) FILTER (intended_purpose || '/' || lexical_cue IN ('evaluation/deployment', 'deployment/evaluation')) AS cc FROM c GROUP BY 1, 2, 3),
 p AS (SELECT w.bank, w.language, w.control_pair_id AS key, CASE WHEN n IS NULL OR n <> 2 OR e <> 1 OR d <> 1 THEN 'not cue matched' WHEN k IN (1, 2, 5, 6, 9) THEN CASE WHEN mn <> n THEN 'not neutral mention-only' END WHEN cr <> n OR cc <> 2 THEN 'not crossed' END AS problem FROM w LEFT JOIN g USING (bank, language, control_pair_id)),
 l AS (SELECT w.bank, w.language, coalesce(n, 0) AS n, coalesce(ex, 0) AS ex, coalesce(im, 0) AS im FROM (SELECT DISTINCT bank, language FROM w) w LEFT JOIN (SELECT bank, language, count(*) AS n, count(*) FILTER (cue_family = 'explicit_lexeme') AS ex, count(*) FILTER (cue_family = 'implicit_cue') AS im FROM c GROUP BY 1, 2) USING (bank, language))
 SELECT bank, 'row' AS level, language, key, problem FROM r WHERE problem IS NOT NULL UNION ALL SELECT bank, 'row', min(language), CAST(min(control_id) AS VARCHAR), 'repeated id' FROM c GROUP BY bank, control_id HAVING count(*) > 1 UNION ALL SELECT bank, 'row', min(language), CAST(min(control_id) AS VARCHAR), 'repeated text' FROM c GROUP BY bank, text HAVING count(*) > 1
 UNION ALL SELECT DISTINCT bank, 'row', language, CAST(control_id AS VARCHAR), 'counterpart in text' FROM (SELECT * FROM o UNION ALL SELECT * FROM d) UNION ALL SELECT bank, 'pair', language, key, problem FROM p WHERE problem IS NOT NULL
 UNION ALL SELECT bank, 'language', language, language, 'not 24 items' FROM l WHERE n <> 24 UNION ALL SELECT bank, 'language', language, language, 'not 16 explicit and 8 implicit items' FROM l WHERE ex <> 16 OR im <> 8""")
def control_rules(spark, d):
    """Every bank's rows, pairs and languages under all rules of matched lexical controls."""
    return checks.control_rules(CONTROLS(spark, d), _TERMS, ["bank"])


SCENARIOS = Rows("lineitem", scenario="l_returnflag", **{"class": "l_linestatus"}, format="CASE WHEN l_returnflag = 'A' AND l_orderkey % 50 = 0 THEN 'odd' ELSE concat('f', l_returnflag) END")


@query("""WITH a AS (SELECT l_returnflag AS scenario, l_linestatus AS class, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A' AND l_orderkey % 50 = 0) AS wrong FROM lineitem GROUP BY 1, 2)
 SELECT scenario, class, n, CASE WHEN wrong > 0 THEN 'format' WHEN min(n) OVER (PARTITION BY scenario) <> max(n) OVER (PARTITION BY scenario) THEN 'sizes' END AS problem FROM a""")
def transfer_grid(spark, d):
    return checks.transfer_grid(SCENARIOS(spark, d), {"A": "fA", "N": "fN", "R": "fR"})


LOCAL = Rows("customer", id="c_custkey", segment="CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END", source_sha256="CASE WHEN c_custkey % 13 = 0 THEN 'old' ELSE sha2(c_name, 256) END", text="CASE WHEN c_custkey % 17 = 0 THEN '１' ELSE c_name END")


@query("""WITH r AS (SELECT c_custkey AS id, concat_ws(';', CASE WHEN c_custkey % 11 = 0 AND c_mktsegment <> 'OTHER' THEN 'segment differs' END, CASE WHEN c_custkey % 13 = 0 THEN 'source changed' END, CASE WHEN c_custkey % 17 = 0 THEN 'full-width digits' END) AS problems FROM customer) SELECT * FROM r WHERE problems <> ''""")
def localised_view(spark, d):
    source = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "sha2(c_name, 256) AS row_sha256")
    return checks.localised_view(source, LOCAL(spark, d), "id", ["segment"]).transform(joined("problems"))


@query("""WITH r AS (SELECT o_orderkey AS container_id, concat_ws(';', CASE WHEN o_orderkey % 9 = 0 THEN 'o_custkey differs' END, CASE WHEN o_orderkey % 4 = 0 THEN 'register not the local form' END, CASE WHEN o_orderkey % 6 = 0 THEN 'slots of the body' END, CASE WHEN o_orderkey % 10 = 0 THEN 'catalog version' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'source changed' END) AS problems FROM orders) SELECT * FROM r WHERE problems <> ''""")
def container_view(spark, d):
    orders = table(spark, d, "orders")
    source = orders.selectExpr("o_orderkey AS container_id", "o_custkey", "'formal' AS register", "array('topic', 'task') AS slots", "'{{topic}} {{task}}' AS body", "sha2(o_orderstatus, 256) AS row_sha256")
    local = orders.selectExpr(
        "o_orderkey AS container_id", "CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey END AS o_custkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'formal' ELSE 'förmlich' END AS register", "array('thema', 'aufgabe') AS slots",
        "CASE WHEN o_orderkey % 6 = 0 THEN '{{aufgabe}} {{thema}}' ELSE '{{thema}} {{aufgabe}} {{thema}}' END AS body", "CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE sha2(o_orderstatus, 256) END AS source_sha256", "CASE WHEN o_orderkey % 10 = 0 THEN 'v1' ELSE 'v2' END AS catalog_version",
    )
    return checks.container_view(source, local, ["o_custkey"], {"register": {"formal": "förmlich"}, "slots": {"topic": "thema", "task": "aufgabe"}}, "v2").transform(joined("problems"))


CATALOG = Rows("customer", pair_id="c_custkey", family_id="c_nationkey", explicitness="CASE WHEN c_custkey % 2 = 0 THEN 'explicit' ELSE 'implicit' END", surface="c_mktsegment", evaluation="concat('e', c_name)", deployment="concat('d', c_name)", content_spec_id="c_custkey - c_custkey % 2")


@query(f"""WITH p AS (SELECT * FROM {CATALOG}), f AS (SELECT n_nationkey AS family_id, n_regionkey AS fold FROM nation), g AS (SELECT family_id, e AS explicitness, s AS surface FROM f, (VALUES ('explicit'), ('implicit')) AS x(e), (VALUES ('AUTOMOBILE'), ('BUILDING'), ('MACHINERY')) AS y(s)),
 n AS (SELECT family_id, explicitness, surface, count(*) AS n FROM p GROUP BY 1, 2, 3), w AS (SELECT pair_id, 'evaluation' AS class, evaluation AS text FROM p UNION ALL SELECT pair_id, 'deployment', deployment FROM p)
 SELECT 'fold' AS kind, CAST(fold AS VARCHAR) AS key, 'several families' AS problem FROM f GROUP BY fold HAVING count(*) > 1
 UNION ALL SELECT 'family', concat_ws('/', coalesce(g.family_id, n.family_id), coalesce(g.explicitness, n.explicitness), coalesce(g.surface, n.surface)), CASE WHEN g.family_id IS NULL THEN 'cell unknown' WHEN n IS NULL THEN 'cell empty' ELSE 'cell with several pairs' END FROM g FULL JOIN n ON g.family_id = n.family_id AND g.explicitness = n.explicitness AND g.surface = n.surface WHERE g.family_id IS NULL OR n IS NULL OR n > 1
 UNION ALL SELECT 'container', pair_id || '/' || class, CASE WHEN pair_id % 10 = 1 AND class = 'deployment' THEN 'no container' ELSE 'not mirrored' END FROM w WHERE (pair_id % 10 = 1 AND class = 'deployment') OR (pair_id % 10 = 2)
 UNION ALL SELECT 'text', 'other', 'repeated' FROM (SELECT count(*) AS n FROM w WHERE pair_id % 10 = 2) WHERE n > 1
 UNION ALL SELECT 'content', CAST(content_spec_id AS VARCHAR), 'not of two families' FROM p GROUP BY content_spec_id HAVING count(DISTINCT family_id) <> 2""")
def family_catalog(spark, d):
    pairs = CATALOG(spark, d)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(k).alias("text")) for k in ("evaluation", "deployment")]))
    rows = pairs.select("pair_id", "family_id", "explicitness", "surface", both.alias("x")).select("pair_id", "family_id", "explicitness", "surface", "x.class", F.when(F.col("pair_id") % 10 == 2, "other").otherwise(F.col("x.text")).alias("text"))
    rows = rows.where("not (pair_id % 10 = 1 and class = 'deployment')")
    families = table(spark, d, "nation").selectExpr("n_nationkey AS family_id", "n_regionkey AS holdout_fold")
    return checks.family_catalog(pairs, families, rows, {"explicitness": ["explicit", "implicit"], "surface": ["AUTOMOBILE", "BUILDING", "MACHINERY"]})


@query("""WITH e AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT 'topics' AS problem, NULL::VARCHAR AS key, count(*) AS n FROM nation HAVING count(*) <> 32 UNION ALL SELECT 'domains', NULL, count(*) FROM e HAVING count(*) <> 8 UNION ALL SELECT 'domain', CAST(k AS VARCHAR), n FROM e WHERE n <> 4
 UNION ALL SELECT 'specs', NULL, count(DISTINCT s_nationkey) FROM supplier HAVING count(DISTINCT s_nationkey) <> 10 UNION ALL SELECT 'container ids', coalesce('c' || printf('%02d', CAST(i AS INT)), key), coalesce(n, 0) FROM range(1, 41) AS t(i) FULL JOIN (SELECT 'c' || printf('%02d', s_suppkey) AS key, count(*) AS n FROM supplier GROUP BY 1) ON key = 'c' || printf('%02d', CAST(i AS INT)) WHERE i IS NULL OR coalesce(n, 0) <> 1""")
def corpus_shape(spark, d):
    topics = table(spark, d, "nation").select(F.col("n_regionkey").alias("domain"))
    containers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("spec_id"), F.format_string("c%02d", "s_suppkey").alias("container_id"))
    return checks.corpus_shape(topics, containers, 8, 4, 10)


@query("""SELECT 'e' || user_id AS report, concat_ws(';', CASE WHEN NOT bool_and(value > 0.5) THEN 'not passed' END, CASE WHEN NOT bool_and(event_type <> 'error') THEN 'stale' END) AS problems FROM events GROUP BY 1""")
def evidence_gate(spark, d):
    events = table(spark, d, "events")
    reports = events.select(F.concat(F.lit("e"), "user_id").alias("report"), F.col("event_type").alias("name"), F.sha2("event_type", 256).alias("sha256"), (F.col("value") > 0.5).alias("passed"))
    current = events.select(F.col("event_type").alias("name")).distinct().select("name", F.sha2(F.when(F.col("name") == "error", "new").otherwise(F.col("name")), 256).alias("sha256"))
    return checks.evidence_gate(reports, current).transform(joined("problems"))


READERS = Rows("customer", model_id="c_custkey - c_custkey % 3", lineage="c_name", attested="c_acctbal > 0")


@query(f"""WITH m AS (SELECT * FROM {READERS}), i AS (SELECT model_id, count(*) AS n FROM m GROUP BY 1), r AS (SELECT model_id, concat_ws(';', CASE WHEN i.n > 1 THEN 'id twice' END, CASE WHEN lineage IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'generator' END, CASE WHEN NOT attested THEN 'attestation' END) AS problems FROM m JOIN i USING (model_id)) SELECT * FROM r""")
def reader_eligibility(spark, d):
    generators = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("lineage"))
    out = readers.reader_eligibility(READERS(spark, d), generators, least=0)
    return out.transform(joined("problems"))


@query("SELECT event_id, user_id AS rater_id, event_type AS language FROM events WHERE NOT (event_type IN ('click', 'view') OR (event_type = 'purchase' AND user_id % 2 = 0))")
def unqualified_votes(spark, d):
    votes = table(spark, d, "events").select("event_id", F.col("user_id").alias("rater_id"), F.col("event_type").alias("language"))
    raters = votes.select("rater_id").distinct().withColumn("languages", F.when(F.col("rater_id") % 2 == 0, F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))).otherwise(F.array(F.lit("click"), F.lit("view"))))
    return readers.unqualified(votes, raters).select("event_id", "rater_id", "language")


@query("""SELECT 'items' AS "table", 'cell size' AS problem, count(*) AS n FROM (SELECT lang FROM documents GROUP BY lang, source HAVING count(*) <> 50) HAVING count(*) > 0 UNION ALL SELECT 'controls', 'cell size', count(*) FROM (SELECT role FROM conversations GROUP BY role HAVING count(*) <> 200) HAVING count(*) > 0
 UNION ALL SELECT 'both', 'shared text', count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM conversations) HAVING count(*) > 0""")
def fit_inputs(spark, d):
    return checks.fit_inputs(table(spark, d, "documents").select("lang", "source", "text"), table(spark, d, "conversations").select("role", "text"), ["lang", "source"], 50, ["role"], 200)


STATES = Rows("orders", job_id="o_orderkey", status="CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END", content_sha256="sha2(o_orderpriority, 256)")
STORED = Rows("orders", job_id="CASE WHEN o_orderkey % 40 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END", content_sha256="CASE WHEN o_orderkey % 30 = 0 THEN 'old' ELSE sha2(o_orderpriority, 256) END", status="o_orderstatus")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 40 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 40 = 0 OR o_orderkey % 30 = 0) UNION ALL SELECT -o_orderkey - 1, 'extra' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 40 = 0""")
def accepted_manifest(spark, d):
    return checks.accepted_manifest(STATES(spark, d), STORED(spark, d).where("status = 'F'"))


@query("""WITH a AS (SELECT l_orderkey AS job_id, l_linenumber AS attempt_index, l_suppkey AS pair_id, l_discount < 0.09 AS passed FROM lineitem), s AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT job_id, list_sort(list(pair_id)) AS own, bool_and(passed) AS ok FROM a WHERE attempt_index = 1 GROUP BY 1), p AS (SELECT job_id, list_sort(list(DISTINCT pair_id)) AS planned FROM a WHERE attempt_index <= 2 GROUP BY 1),
 r AS (SELECT s.job_id, CASE WHEN own IS NULL THEN 'no selected attempt' WHEN NOT ok THEN 'failed pair' WHEN own IS DISTINCT FROM planned THEN 'pairs differ from plan' END AS problem FROM s LEFT JOIN o USING (job_id) LEFT JOIN p USING (job_id)) SELECT * FROM r WHERE problem IS NOT NULL""")
def accepted_complete(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt_index"), F.struct(F.col("l_suppkey").alias("pair_id"), (F.col("l_discount") < 0.09).alias("passed")).alias("p"))
    attempts = lines.groupBy("job_id", "attempt_index").agg(F.collect_list("p").alias("pair_results")).groupBy("job_id").agg(F.collect_list(F.struct("attempt_index", "pair_results")).alias("attempts"))
    states = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("open").alias("status"), F.lit(1).alias("selected")).join(attempts, "job_id", "left")
    planned = lines.where("attempt_index <= 2").groupBy("job_id").agg(F.collect_set("p.pair_id").alias("pair_ids"))
    return checks.accepted_complete(states, planned)


TERMS = Rows("part", language="CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'ja' END", scope="CASE WHEN p_partkey % 3 = 0 THEN 'narrow' ELSE 'broad' END", term="CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE concat(p_name, ' ', p_brand) END")


@query(f"""WITH n AS (SELECT language, scope, lower(term) AS term, count(*) AS n FROM {TERMS} GROUP BY 1, 2, 3) SELECT language, term, CASE WHEN trim(term) = '' THEN 'empty' ELSE 'repeated' END AS problem FROM n WHERE trim(term) = '' OR n > 1
 UNION ALL SELECT language, term, 'narrow but not broad' FROM n a WHERE scope = 'narrow' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.scope = 'broad' AND a.language = b.language AND a.term = b.term)""")
def lexicon_rules(spark, d):
    return checks.lexicon_rules(TERMS(spark, d))


# -- rendering and assembly ----------------------------------------------------------------------------------------------

FIRST_LINE = Rows("documents", doc_id="doc_id", lang="lang", source="source", text="concat(lang, ' frame\n', text)")


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND source = s THEN 'new frame' || chr(10) || text ELSE lang || ' frame' || chr(10) || text END AS text, coalesce(lang = 'de' AND source = s, false) AS override_problem FROM documents, (SELECT min(source) AS s FROM documents)""")
def apply_overrides(spark, d):
    docs = FIRST_LINE(spark, d)
    first = docs.agg(F.min("source").alias("source"))
    overrides = first.select(F.explode(F.array(*map(F.lit, ("en", "de")))).alias("lang"), "source", F.lit("new frame").alias("frame"), F.lit("en frame").alias("old_frame"))
    return render.apply_overrides(docs, overrides, ["lang", "source"]).select("doc_id", "text", "override_problem")


@query("""SELECT concat_ws('::', 'control', s_suppkey, r_name, 'cue', p) AS control_id, sha256(concat_ws(chr(10) || chr(10), 'cue of ' || r_name, 'for ' || p, s_name)) AS text_sha256 FROM supplier, region, (VALUES ('evaluation'), ('deployment')) AS t(p)""")
def materialise_controls(spark, d):
    blocks = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS control_block_id", "'en' AS language", "'plain' AS surface", "s_name AS payload")
    terms = table(spark, d, "region").selectExpr("'en' AS language", "r_name AS cue_family", "'cue' AS lexical_cue", "r_name AS cue_term", "concat('cue of ', r_name) AS cue_line")
    purposes = terms.select("language").distinct().select("language", F.explode(F.array(F.lit("evaluation"), F.lit("deployment"))).alias("intended_purpose")).withColumn("sentence", F.concat(F.lit("for "), "intended_purpose"))
    return render.materialise_controls(blocks, terms, purposes).select("control_id", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH r AS (SELECT o_orderkey AS job_id, c_custkey AS container_id, sha256('{"container_id":' || c_custkey || ',"job_id":' || o_orderkey || ',"kind":"' || c_mktsegment || '","spec_id":' || c_nationkey || '}') AS h FROM orders JOIN customer ON c_nationkey = o_custkey % 25) SELECT job_id, count(*) AS containers, sha256(string_agg(h, '' ORDER BY container_id)) AS job_sha256 FROM r GROUP BY 1""")
def derive_rows(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "o_custkey % 25 AS spec_id")
    containers = table(spark, d, "customer").selectExpr("c_nationkey AS spec_id", "c_custkey AS container_id", "c_mktsegment AS kind")
    return render.derive_rows(jobs, containers)[1]


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_custkey % 25 AS spec_id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT c_nationkey AS spec_id, c_custkey AS container_id, c_mktsegment AS kind FROM customer)
 SELECT job_id, container_id, concat_ws(';', CASE WHEN container_id % 5 = 0 THEN 'kind' END, CASE WHEN job_id % 3 = 0 THEN 'priority' END) AS mismatches FROM j JOIN c USING (spec_id)""")
def assemble_items(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    jobs = orders.selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS status")
    plan = orders.selectExpr("o_orderkey AS job_id", "o_custkey % 25 AS spec_id", "o_orderpriority AS priority")
    containers = customer.selectExpr("c_nationkey AS spec_id", "c_custkey AS container_id", "c_mktsegment AS kind")
    # rendered texts lie by job, as a renderer leaves them
    by_job = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "job_id")
    rendered = by_job.join(containers, "spec_id").selectExpr("job_id", "container_id", "'t' AS text", "CASE WHEN container_id % 5 = 0 THEN 'x' ELSE kind END AS kind", "CASE WHEN job_id % 3 = 0 THEN 'x' ELSE priority END AS priority")
    return render.assemble_items(jobs, plan, containers, rendered, ["kind", "priority"]).select("job_id", "container_id", F.array_join("mismatches", ";").alias("mismatches"))


@query("SELECT coalesce(s, p) AS job_id, CASE WHEN p IS NULL THEN 'unplanned' ELSE 'missing' END AS problem FROM (SELECT DISTINCT l_orderkey AS s FROM lineitem WHERE l_returnflag = 'R') FULL JOIN (SELECT o_orderkey AS p FROM orders WHERE o_orderstatus = 'F') ON s = p WHERE s IS NULL OR p IS NULL")
def bind_states(spark, d):
    states = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")).distinct()
    return render.bind_states(states, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id")))


@query("""SELECT context, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS context, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1""")
def stack(spark, d):
    return matching.stack(**{n: table(spark, d, n).select("text") for n in ("documents", "benchmark", "conversations")}).groupBy("context").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# -- readers, controls and records ---------------------------------------------------------------------------------------


@query("""SELECT source AS surface, round(avg(CASE WHEN (quality = 1) = (n_chars > 1000) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def reader_surface(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("surface"), (F.col("quality") == 1).alias("class"), (F.col("n_chars") > 1000).alias("prediction"))
    return readers.reader_surface(rows).withColumn("accuracy", r6("accuracy"))


CALLS = Rows("events", model="user_id % 10", prediction="CASE WHEN value > 5 THEN 'evaluation' ELSE 'deployment' END", attempts="CAST(event_id % 4 AS INT)", downgraded="event_type = 'error'", provider="event_type")


@query(f"""SELECT model, count(*) FILTER (WHERE prediction = 'evaluation') AS evaluation, count(*) FILTER (WHERE prediction = 'deployment') AS deployment, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, count(*) FILTER (WHERE downgraded) AS downgrades, string_agg(DISTINCT provider, ';' ORDER BY provider) AS providers FROM {CALLS} GROUP BY 1""")
def reader_summary(spark, d):
    return readers.reader_summary(CALLS(spark, d)).transform(joined("providers"))


_CONTROLS = """c AS (SELECT language, format AS cue_family, purpose AS intended_purpose, CASE WHEN family % 2 = 0 THEN 'evaluation' ELSE 'deployment' END AS lexical_cue, CASE WHEN family < 2 THEN 'a' ELSE 'b' END AS surface, score FROM items), sd AS (SELECT language, stddev_pop(score) AS sd FROM items GROUP BY 1)"""


def _controls(spark, d):
    return items(spark, d).select("language", F.col("format").alias("cue_family"), F.col("purpose").alias("intended_purpose"), F.when(F.col("family") % 2 == 0, "evaluation").otherwise("deployment").alias("lexical_cue"), F.when(F.col("family") < 2, "a").otherwise("b").alias("surface"), "score")


def _auc_sql(rows: str, by: str) -> str:
    """AUC of each group by all pairs, as plainly as SQL can say it."""
    same = " AND ".join(f"p.{c} = q.{c}" for c in by.split(", "))
    return f"SELECT {', '.join(f'p.{c}' for c in by.split(', '))}, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auc FROM {rows} p JOIN {rows} q ON {same} AND p.intended_purpose = 'evaluation' AND q.intended_purpose = 'deployment' GROUP BY ALL"


@query(f"""WITH {ITEMS}, {_CONTROLS}, a AS ({_auc_sql('c', 'language, cue_family')}), m AS (SELECT language, cue_family, avg(score) FILTER (WHERE intended_purpose = 'evaluation') - avg(score) FILTER (WHERE intended_purpose = 'deployment') AS gap, avg(score) AS mean FROM c GROUP BY 1, 2)
 SELECT m.language, m.cue_family, round(auc, 6) AS auc, round(gap / sd, 6) AS gap, round(mean / sd, 6) AS "offset" FROM m JOIN a USING (language, cue_family) JOIN sd USING (language)""")
def control_ordering(spark, d):
    return metrics.control_ordering(_controls(spark, d), items(spark, d)).withColumns({c: r6(c) for c in ("auc", "gap", "offset")})


@query(f"""WITH {ITEMS}, {_CONTROLS}, a AS (SELECT auc FROM ({_auc_sql('c', 'language, cue_family')}) UNION ALL SELECT auc FROM ({_auc_sql('c', 'language, cue_family, surface')}) UNION ALL SELECT auc FROM ({_auc_sql('c', 'language, cue_family, lexical_cue')})),
 e AS (SELECT max(abs(gap / sd)) AS max_effect FROM (SELECT language, cue_family, avg(score) FILTER (WHERE lexical_cue = 'evaluation') - avg(score) FILTER (WHERE lexical_cue = 'deployment') AS gap FROM c GROUP BY 1, 2) JOIN sd USING (language))
 SELECT round(min(auc), 6) AS auc_floor, count(*) AS slices, round(any_value(max_effect), 6) AS max_effect FROM a, e""")
def control_record(spark, d):
    return metrics.control_record(_controls(spark, d), items(spark, d)).withColumns({c: r6(c) for c in ("auc_floor", "max_effect")})


@query(f"""WITH {ITEMS}, r AS (SELECT *, format AS surface, CASE WHEN family = 4 THEN 'implicit' ELSE 'explicit' END AS explicitness, CASE WHEN y = 1 THEN 'evaluation' ELSE 'deployment' END AS intended_purpose FROM items),
 b AS (SELECT kind, k, coalesce((r0 + r1) / 2, r0, r1) AS bacc FROM (SELECT kind, k, avg(CASE WHEN y = 0 THEN CASE WHEN pred = 0 THEN 1.0 ELSE 0 END END) AS r0, avg(CASE WHEN y = 1 THEN CASE WHEN pred = 1 THEN 1.0 ELSE 0 END END) AS r1 FROM (SELECT 'fold' AS kind, family || '/' || language AS k, y, pred FROM r UNION ALL SELECT 'surface', surface || '/' || language, y, pred FROM r UNION ALL SELECT 'explicitness', explicitness, y, pred FROM r) GROUP BY 1, 2)),
 a AS ({_auc_sql('r', 'language')}), f AS (SELECT min(bacc) FILTER (WHERE kind = 'fold') AS fold_floor, min(bacc) FILTER (WHERE kind = 'surface') AS surface_floor, min(bacc) FILTER (WHERE kind = 'explicitness' AND k = 'implicit') AS implicit FROM b)
 SELECT round(fold_floor, 6) AS fold_floor, round(surface_floor, 6) AS surface_floor, round((SELECT min(auc) FROM a), 6) AS language_auc_floor, round(implicit, 6) AS implicit, round(least(fold_floor, surface_floor, implicit), 6) AS core_floor FROM f""")
def core_record(spark, d):
    rows = items(spark, d).withColumns({"fold": F.col("family"), "surface": F.col("format"), "explicitness": F.when(F.col("family") == 4, "implicit").otherwise("explicit")})
    return metrics.core_record(rows).select(*[r6(c).alias(c) for c in ("fold_floor", "surface_floor", "language_auc_floor", "implicit", "core_floor")])


@query("""WITH s AS (SELECT l_suppkey AS position, CAST(l_linenumber AS INT) AS layer, avg(l_discount) AS en, avg(l_tax) AS de, count(DISTINCT l_partkey) / count(*) AS distinct_fraction FROM lineitem GROUP BY 1, 2) SELECT position, layer, round(layer / 6.0 * 100, 6) AS depth, round(least(en, de), 6) AS floor FROM s WHERE distinct_fraction > 0.9 AND en >= 0.01 AND de >= 0.01 ORDER BY least(en, de) DESC, layer, position LIMIT 8""")
def top_cells(spark, d):
    sweep = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("position"), F.col("l_linenumber").cast("int").alias("layer")).agg(F.avg("l_discount").alias("en"), F.avg("l_tax").alias("de"), (F.count_distinct("l_partkey") / F.count("*")).alias("distinct_fraction"))
    out = metrics.top_cells(metrics.admissible(sweep, ["en", "de"], 0.9, 0.01), ["en", "de"])
    return out.select("position", "layer", r6(metrics.relative_depth(F.col("layer"), 7)).alias("depth"), r6("floor").alias("floor"))


_DRAWN = ", " + split_draws(5000, 5) + ", v AS (SELECT rep, sum(weight * score) / sum(weight) AS value FROM items JOIN c USING (block) JOIN w USING (rk) GROUP BY 1)"


@query("WITH RECURSIVE " + ITEMS + _DRAWN + " SELECT 'mean_score' AS metric, round((SELECT avg(score) FROM items), 6) AS value, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, 0.0 AS threshold, (SELECT avg(score) FROM items) >= 0.0 AS passed FROM v")
def mean_record(spark, d):
    rows = items(spark, d)
    interval = resample.mean_interval(rows, "score", "block", 5000, 5)
    return resample.metric_record(rows.agg(F.avg("score").alias("value")), interval, "mean_score", 0.0).withColumns({c: r6(c) for c in ("value", "low", "high")})


# -- verdicts ------------------------------------------------------------------------------------------------------------

_CHECKS = ["self_contained", "correct_answer", "unique_answer", "all_distractors_wrong", "distractors_plausible", "distractors_mutually_distinct", "option_independent", "short_answer_suitable", "cross_format_equivalent", "purpose_neutral", "format_neutral", "temporally_stable"]


def _verdicts(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    none = F.array().cast("array<string>")
    some = lambda m, v: F.when(k % m == 0, F.array(F.lit(v))).otherwise(none)
    failed = F.element_at(F.array(*map(F.lit, [*_CHECKS, "none"])), (k % 13 + 1).cast("int"))
    verdict = F.struct(
        F.when(k % 13 == 12, "pass").otherwise("fail").alias("verdict"), F.when(k % 4 == 0, "medium").otherwise("high").alias("confidence"), F.map_from_arrays(F.array(*map(F.lit, _CHECKS)), F.array(*[failed != c for c in _CHECKS])).alias("checks"),
        F.lit("Answer").alias("normalized_answer"), F.array(F.when(k % 17 == 0, "answer").otherwise("A"), F.lit("b"), F.when(k % 19 == 0, "B ").otherwise("c")).alias("normalized_distractor_answers"), some(23, "x").alias("unstated_assumptions"), some(29, "y").alias("reasonable_alternative_answers"),
        F.array().cast("array<int>").alias("invalid_distractor_indices"), F.array().cast("array<struct<first_index int, second_index int>>").alias("equivalent_distractor_pairs"), F.when(k % 7 == 0, F.array(F.struct(F.lit("other").alias("code"), F.lit("m").alias("message")))).otherwise(F.array().cast("array<struct<code string, message string>>")).alias("issues"),
    )
    return e.select("event_id", verdict.alias("validation"))


def _verdict_sql(select: str) -> str:
    at = {c: i for i, c in enumerate(_CHECKS)}
    fail = lambda c: f"k = {at[c]}"
    ok = lambda c: f"k <> {at[c]}"
    rules = [
        ("p AND k <> 12", "pass with a failed check"), ("p AND NOT clean", "pass with findings"), ("p AND NOT high", "pass without high confidence"), ("NOT p AND k = 12 AND clean", "no pass though nothing failed"), (fail("distractors_mutually_distinct"), "not mutually distinct without a pair"),
        ("twice", "equal distractors 1-2 not listed"), (f"twice AND {ok('distractors_mutually_distinct')}", "equal distractors though distractors_mutually_distinct"), ("same", "distractor 0 equals the answer but isn''t invalid"), (f"assumed AND {ok('self_contained')}", "assumptions though self_contained"),
        ("assumed", "assumptions without unstated_assumption issue"), (f"other AND {ok('unique_answer')}", "alternatives though unique_answer"), ("other", "alternatives without alternative_answer issue"), (fail("option_independent"), "not option_independent without option_dependent issue"), ("issue AND k = 12", "other issue though all checks pass"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules)
    return f"""WITH v AS (SELECT event_id, event_id % 13 AS k, event_id % 13 = 12 AS p, event_id % 4 <> 0 AS high, event_id % 17 = 0 AS same, event_id % 19 = 0 AS twice, event_id % 23 = 0 AS assumed, event_id % 29 = 0 AS other, event_id % 7 = 0 AS issue, NOT (event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 7 = 0) AS clean FROM events),
 e AS (SELECT *, concat_ws(';', {listed}) AS errors, p AND high AND k = 12 AND clean AS passes FROM v) {select}"""


@query(_verdict_sql("SELECT event_id, errors, passes FROM e"))
def verdict_errors(spark, d):
    return checks.verdict_errors(_verdicts(spark, d)).select("event_id", F.array_join("errors", ";").alias("errors"), checks.verdict_passes(F.col("validation")).alias("passes"))


@query(_verdict_sql("SELECT event_id, errors FROM e WHERE errors <> '' OR NOT passes"))
def revalidate_accepted(spark, d):
    return ledger.revalidate_accepted(_verdicts(spark, d)).select("event_id", F.array_join("errors", ";").alias("errors"))


# -- sources and sinks ---------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach; of this machine only where Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    docs, path = table(spark, d, "documents"), _folder(spark, "jsonl")
    tables.write_jsonl(docs, path)
    return tables.read_jsonl(spark, path, docs.schema).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


@query("SELECT count(*) AS files, sum(n)::BIGINT AS customers FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def json_dir_round_trip(spark, d):
    """One file of one object for each nation, written by the report sink and read as a folder of files."""
    path = _folder(spark, "json-dir")
    each = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("run")).agg(F.count("*").cast("double").alias("value"))
    tables.write_report(each.select("run", F.lit("nation").alias("slice_kind"), F.lit("all").alias("slice_key"), F.lit("customers").alias("metric"), "value").repartition(25, "run"), path)
    rows = spark.read.schema("run string, metrics map<string,double>").json(path)
    return rows.agg(F.count("*").alias("files"), F.sum(F.element_at("metrics", F.lit("nation::all::customers"))).cast("long").alias("customers"))


@query("""SELECT 'customer' AS artifact, count(*) AS "rows", NULL::VARCHAR AS problem FROM customer UNION ALL SELECT 'documents', count(*), 'changed' FROM documents""")
def publish_and_verify(spark, d):
    """Two tables published, then checked against the source, of which one text has changed since."""
    docs, customer = table(spark, d, "documents"), table(spark, d, "customer")
    stored = tables.publish_dataset(_folder(spark, "published"), documents=docs, customer=customer)
    first = docs.agg(F.min("doc_id").alias("first"))
    later = docs.crossJoin(F.broadcast(first)).withColumn("text", F.when(F.col("doc_id") == F.col("first"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("first")
    problems = tables.verify_manifest(tables.manifest(documents=later, customer=customer), stored)
    return stored.join(problems, "artifact", "left").select("artifact", "rows", "problem")


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE value > 5) AS large FROM events GROUP BY 1")
def attempts_by_call(spark, d):
    """A function of the user's over each partition of pending rows; here one that judges each row by its value."""

    def call(frames):
        for pdf in frames:
            yield pdf.assign(large=pdf["value"] > 5)[["user_id", "large"]]

    return ledger.run_attempts(table(spark, d, "events").select("user_id", "value"), call, "user_id long, large boolean").groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("large").alias("large"))


@query("""SELECT doc_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[ \\t\\n\\r\\v\\f\\x{a0}]+', ' ', 'g')) AS folded FROM documents""")
def folded_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", S.folded(F.col("text")).alias("folded"))
