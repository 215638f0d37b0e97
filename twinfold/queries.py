"""Registered queries over the driver's tables, each with the same question in SQL where SQL can ask it.

Stand-ins: a vector item is a row of embeddings in a complete block of four (purpose by vec_id, format by vec_id / 2); its
family is block % 5, its score the sum of its coordinates by 8. Attempts are events of a user in order of time. Readers are sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import checks, fits, ledger, linalg, matching, metrics, probe, protocols, readers, render, resample
from .plans import grids
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# -- stand-ins -----------------------------------------------------------------------------------------------------------

ITEMS = """items AS (SELECT vec_id, vec_id // 4 AS block, (vec_id // 4) % 5 AS family, CASE WHEN vec_id % 2 = 0 THEN 'evaluation' ELSE 'deployment' END AS purpose,
 CASE WHEN (vec_id // 2) % 2 = 0 THEN 'benchmark' ELSE 'casual' END AS format, CASE WHEN label < 5 THEN 'en' ELSE 'ja' END AS language, label % 2 AS y,
 embedding, total / 8 AS score, CASE WHEN total >= 0 THEN 1 ELSE 0 END AS pred FROM (SELECT *, list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) AS total FROM embeddings))"""


def items(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    score = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / 8
    block = F.floor(v / 4)
    return table(spark, d, "embeddings").select(
        "vec_id", block.alias("block"), (block % 5).alias("family"), F.when(v % 2 == 0, "evaluation").otherwise("deployment").alias("purpose"),
        F.when(F.floor(v / 2) % 2 == 0, "benchmark").otherwise("casual").alias("format"), F.when(F.col("label") < 5, "en").otherwise("ja").alias("language"),
        (F.col("label") % 2).alias("y"), F.col("embedding").alias("features"), score.alias("score"), (score >= 0).cast("int").alias("pred"),
    )


ATTEMPTS = """attempts AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'semantic_rejection' WHEN 'view' THEN 'generator_output_rejection' WHEN 'purchase' THEN 'accepted'
 ELSE 'validator_error' END AS status, CASE WHEN value > 50 THEN 'OpenRouter timeout' ELSE 'bad output' END AS error FROM events)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "click", "semantic_rejection").when(e == "view", "generator_output_rejection").when(e == "purchase", "accepted").otherwise("validator_error")
    return table(spark, d, "events").select("user_id", "event_id", "ts", status.alias("status"), F.when(F.col("value") > 50, "OpenRouter timeout").otherwise("bad output").alias("error"), "event_type", "value")


# -- planning ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'request::pb_t' || n_nationkey || '_' || printf('%02d', CAST(k AS INT)) AS request_id, 'pb_t' || n_nationkey || '_' || printf('%02d', CAST(k AS INT)) AS payload_block_id,
 't' || n_nationkey AS topic_id, r_name AS task_family, CAST(k AS INT) AS sample_number, 'Write about ' || n_name || ' (t' || n_nationkey || ', ' || r_name || ') no. ' || k AS "user", '{}' AS response_schema
 FROM nation JOIN region ON n_regionkey = r_regionkey, range(1, 4) AS t(k)""")
def request_grid(spark, d):
    topics = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    topics = topics.select(F.concat(F.lit("t"), "n_nationkey").alias("topic_id"), F.col("n_name").alias("display_name"), F.col("r_name").alias("task_family"))
    return grids.request_grid(topics, 3, "Write about {topic_display_name} ({topic_id}, {task_family}) no. {sample_number}")


@query("""WITH g AS (SELECT n_nationkey AS topic_id, r_regionkey AS spec_id, language, CAST(s AS INT) AS sample, CAST(a AS INT) AS attempt FROM nation, region, (VALUES ('en'), ('ja')) AS l(language), range(2) AS x(s), range(3) AS y(a))
 SELECT topic_id, spec_id, language, sample, attempt, 'job_' || substr(sha256(concat_ws(chr(31), topic_id, spec_id, language, sample)), 1, 20) AS job_id,
 CAST('0x' || substr(sha256(concat_ws(chr(31), '7', topic_id, spec_id, language, sample, attempt)), 1, 8) AS BIGINT) & 2147483647 AS seed FROM g""")
def job_grid(spark, d):
    topics, specs = table(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id")), table(spark, d, "region").select(F.col("r_regionkey").alias("spec_id"))
    return grids.job_grid(topics, specs, ["en", "ja"], 2, 2, 7)


@query("""SELECT doc_id, CAST('0x' || substr(sha256(concat_ws(chr(31), '11', doc_id, lang)), 1, 8) AS BIGINT) & 2147483647 AS seed,
 CAST(CAST(CAST('0x' || substr(sha256(concat_ws('|', '11', doc_id, lang)), 1, 16) AS UBIGINT) AS HUGEINT) % 1000003 AS BIGINT) AS seed64_rest, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) AS first_digit FROM documents""")
def stable_seed(spark, d):
    key = (F.col("doc_id"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", S.stable_seed(11, *key).alias("seed"), (S.stable_seed64(11, *key) % 1000003).cast("long").alias("seed64_rest"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1).alias("first_digit"))


@query("""WITH a AS (SELECT l_orderkey AS o, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT o_orderkey AS o, CAST(x AS INT) AS k FROM orders, range(1, 4) AS t(x))
 SELECT coalesce(a.o, e.o) AS o, coalesce(a.k, e.k) AS k, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.o IS NULL THEN 'extra' WHEN a.n > 1 THEN 'duplicate' END AS problem
 FROM a FULL JOIN e ON a.o = e.o AND a.k = e.k WHERE a.n IS NULL OR e.o IS NULL OR a.n > 1""")
def grid_diff(spark, d):
    actual = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("k"))
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return grids.grid_diff(actual, expected, ["o", "k"])


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN (s_suppkey + s_nationkey) % 2 = 0 THEN 'generator_a' ELSE 'generator_b' END AS author, CASE WHEN (s_suppkey + s_nationkey) % 2 = 0 THEN 'generator_b' ELSE 'generator_a' END AS verifier FROM supplier""")
def allocate_roles(spark, d):
    return grids.allocate_roles(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id % 7, lang, doc_id LIMIT 60")
def interleave(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return grids.interleave(docs, F.col("doc_id") % 7, [F.col("lang"), F.col("doc_id")], 60)


@query("""SELECT doc_id, lang, CAST(turn AS INT) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 40""")
def balanced_take(spark, d):
    return grids.balanced_take(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 40)


@query("""SELECT source, lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 2""")
def head_per_cell(spark, d):
    return grids.head_per_cell(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], 2)


@query("""SELECT 'all' AS dimension, 'all' AS value, count(DISTINCT o_orderkey) AS jobs, count(*) AS "rows" FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(DISTINCT o_orderkey), count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 2
 UNION ALL SELECT 'l_returnflag', l_returnflag, count(DISTINCT o_orderkey), count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 2""")
def grid_counts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_orderkey").alias("job_id"), "o_orderpriority", "l_returnflag")
    return grids.grid_counts(rows, ["o_orderpriority", "l_returnflag"])


@query("""SELECT a.c_custkey AS k, concat_ws(',', CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) AS differs
 FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1 WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment
 UNION ALL SELECT max(c_custkey) + 1, 'c_nationkey,c_mktsegment' FROM customer UNION ALL SELECT min(c_custkey), 'c_nationkey,c_mktsegment' FROM customer""")
def shape_parity(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    return grids.shape_parity(c, c.withColumn("k", F.col("k") + 1), "k", ["c_nationkey", "c_mktsegment"]).select("k", F.array_join("differs", ",").alias("differs"))


@query("""WITH jobs AS (SELECT lang AS profile, CAST(ceil(n_chars / 4.0) AS BIGINT) AS i, CAST(ceil(n_chars / 8.0) AS BIGINT) AS o FROM documents), u AS (SELECT profile, scenario, count(*) * any_value(k) AS n, sum(i) * any_value(k) AS i, sum(o) * any_value(k) AS o FROM jobs, (VALUES ('baseline', 1), ('maximum', 4)) AS s(scenario, k) GROUP BY 1, 2)
 SELECT scenario, profile, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(CAST(sum(i * 0.000002 + o * 0.000008) AS DOUBLE), 6) AS usd FROM u GROUP BY GROUPING SETS ((scenario, profile), (scenario))""")
def cost_scenarios(spark, d):
    jobs = table(spark, d, "documents").select(F.col("lang").alias("profile"), F.ceil(F.col("n_chars") / 4.0).alias("input_tokens"), F.ceil(F.col("n_chars") / 8.0).alias("output_tokens"))
    prices = jobs.select("profile").distinct().select("profile", F.lit("0.000002").cast("decimal(18,12)").alias("usd_per_input"), F.lit("0.000008").cast("decimal(18,12)").alias("usd_per_output"))
    return grids.cost_scenarios(jobs, prices, {"baseline": 1, "maximum": 4}).withColumn("usd", F.round(F.col("usd").cast("double"), 6))


@query("""SELECT kind, value, count(*) AS n FROM (SELECT 'supplier' AS kind, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY 1, 2 HAVING count(*) > 1""")
def plan_uniqueness(spark, d):
    return grids.plan_uniqueness(supplier=(table(spark, d, "supplier"), "s_nationkey"), customer=(table(spark, d, "customer"), "c_custkey"))


@query("""SELECT lang, sum(greatest(1, CAST(ceil(length(text) / CASE WHEN lang = 'ja' THEN 1.8 ELSE 4.0 END) AS BIGINT)))::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY 1""")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(S.token_estimate(F.col("text"), F.col("lang"))).alias("tokens"), F.count("*").alias("docs"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents")
def global_rank(spark, d):
    return grids.global_rank(table(spark, d, "documents").select("doc_id"), "doc_id")


# -- rendering and set checks --------------------------------------------------------------------------------------------

_PAIRS = [("p1", "ff01", "both", "In this test,", "In production,"), ("p2", "ff02", "noun_only", "For the exam,", "For the user,"), ("p3", "ff03", "verb_only", "We evaluate:", "We deploy:")]
_FORMATS = {"benchmark": "{purpose}\n{body}\n{options}", "casual": "{purpose} {body}"}
_RENDER = """pay AS (SELECT item_id, 'pb_' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS payload_block_id, substr(text, 1, length(text) // 2) AS context, substr(text, length(text) // 2 + 1) AS question, row_number() OVER (ORDER BY item_id) - 1 AS rk FROM benchmark),
 pairs AS (SELECT * FROM (VALUES (0, 'p1', 'ff01', 'In this test,', 'In production,'), (1, 'p2', 'ff02', 'For the exam,', 'For the user,'), (2, 'p3', 'ff03', 'We evaluate:', 'We deploy:')) AS t(place, pair_id, family_id, e, dp)),
 opt AS (SELECT payload_block_id, string_agg(chr(CAST(64 + k AS INT)) || '. ' || o, chr(10) ORDER BY k) AS options, max(CASE WHEN o = 'yes' THEN chr(CAST(64 + k AS INT)) END) AS letter FROM (SELECT payload_block_id, o, row_number() OVER (PARTITION BY payload_block_id ORDER BY sha256(payload_block_id || o), o) AS k FROM pay, (VALUES ('yes'), ('no'), ('maybe'), ('never')) AS v(o)) GROUP BY 1),
 rendered AS (SELECT 'item::' || payload_block_id || '::' || pair_id || CASE WHEN purpose = 'evaluation' THEN '::ev::' ELSE '::dp::' END || CASE WHEN format = 'benchmark' THEN 'bm' ELSE 'cs' END AS item_id, payload_block_id, purpose, format, pair_id AS purpose_pair_id, family_id AS purpose_family_id,
 trim(CASE WHEN purpose = 'evaluation' THEN e ELSE dp END || CASE WHEN format = 'benchmark' THEN chr(10) ELSE ' ' END || trim(context, ' ' || chr(10)) || chr(10) || chr(10) || trim(question, ' ' || chr(10)) || CASE WHEN format = 'benchmark' THEN chr(10) || options ELSE '' END, ' ' || chr(10)) AS text,
 CASE WHEN format = 'benchmark' THEN letter END AS answer_key FROM pay JOIN pairs ON rk % 3 = place JOIN opt USING (payload_block_id), (VALUES ('evaluation'), ('deployment')) AS a(purpose), (VALUES ('benchmark'), ('casual')) AS b(format))"""


#: Of each whole text the first half (rounded down) is the context, the rest the question.
def _payloads(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    context, question = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    b = table(spark, d, "benchmark")
    ident = F.concat(F.lit("pb_"), F.lpad(F.col("item_id").cast("string"), 6, "0"))
    return b.select(ident.alias("payload_block_id"), context.alias("context"), question.alias("question"), F.lit("yes").alias("correct_answer"), F.array(*map(F.lit, ("no", "maybe", "never"))).alias("distractors"))


def _rendered(spark, d):
    pairs = spark.createDataFrame(_PAIRS, "pair_id string, family_id string, cue_locus string, evaluation string, deployment string")
    return render.render_blocks(_payloads(spark, d), pairs, _FORMATS)


@query(f"WITH {_RENDER} SELECT item_id, payload_block_id, purpose, format, purpose_pair_id, purpose_family_id, text, answer_key, sha256(text) AS rendered_text_sha256 FROM rendered")
def render_blocks(spark, d):
    return _rendered(spark, d).select("item_id", "payload_block_id", "purpose", "format", "purpose_pair_id", "purpose_family_id", "text", "answer_key", "rendered_text_sha256")


@query(f"""WITH {_RENDER}, kept AS (SELECT * FROM rendered WHERE NOT (CAST(substr(payload_block_id, 4) AS INT) % 5 = 0 AND purpose = 'deployment' AND format = 'casual')) SELECT payload_block_id, count(*) AS n, 'cells' AS problem FROM kept GROUP BY 1 HAVING count(*) <> 4""")
def block_completeness(spark, d):
    rows = _rendered(spark, d).where(~((F.substring("payload_block_id", 4, 6).cast("int") % 5 == 0) & (F.col("purpose") == "deployment") & (F.col("format") == "casual")))
    return checks.block_checks(rows).select("payload_block_id", "n", F.array_join("problems", ",").alias("problem"))


@query(f"""WITH {_RENDER} SELECT item_id, CASE WHEN CAST(substr(payload_block_id, 4) AS INT) % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM rendered WHERE (CAST(substr(payload_block_id, 4) AS INT) % 7 = 0 OR CAST(substr(payload_block_id, 4) AS INT) % 7 = 3) AND format = 'casual'""")
def reconstruct_diff(spark, d):
    expected = _rendered(spark, d)
    k = F.substring("payload_block_id", 4, 6).cast("int") % 7
    casual = F.col("format") == "casual"
    actual = expected.where(~((k == 0) & casual)).withColumn("text", F.when((k == 3) & casual, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return render.reconstruct_diff(actual, expected, "item_id")


@query("WITH " + ITEMS + " SELECT purpose, format, count(*) AS n FROM items GROUP BY CUBE (purpose, format)")
def cell_counts_cube(spark, d):
    return checks.cell_counts(items(spark, d))


@query("WITH " + ITEMS + """, u AS (SELECT unnest([{'a': 'purpose', 'x': purpose, 'b': 'format', 'y': format}, {'a': 'purpose', 'x': purpose, 'b': 'language', 'y': language}, {'a': 'format', 'x': format, 'b': 'language', 'y': language}]) AS p FROM items)
 SELECT p.a AS factor_1, p.x AS value_1, p.b AS factor_2, p.y AS value_2, count(*) AS n FROM u GROUP BY ALL""")
def factor_balance(spark, d):
    return checks.factor_balance(items(spark, d), ["purpose", "format", "language"])


@query("""SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: enum' END, CASE WHEN n_chars < 100 THEN 'n_chars: minimum' END, CASE WHEN length(text) > 5000 THEN 'text: max_length' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source: pattern' END) AS v
 FROM documents WHERE lang NOT IN ('en', 'de') OR n_chars < 100 OR length(text) > 5000 OR NOT regexp_matches(source, '^src[0-9]$')""")
def schema_violations(spark, d):
    rules = {"doc_id": {"required": True}, "lang": {"enum": ["en", "de"]}, "n_chars": {"minimum": 100}, "text": {"max_length": 5000}, "source": {"pattern": "^src[0-9]$"}}
    return checks.violations(table(spark, d, "documents"), rules).where("size(violations) > 0").select("doc_id", F.array_join("violations", ",").alias("v"))


@query("""SELECT text, string_agg(DISTINCT corpus, ',' ORDER BY corpus) AS corpora FROM (SELECT text, CASE WHEN l.doc_id IS NULL THEN 'open' ELSE 'labelled' END AS corpus FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1 HAVING count(DISTINCT corpus) > 1""")
def disjoint_texts(spark, d):
    docs, labelled = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    found = checks.disjoint_texts(labelled=docs.join(labelled, "doc_id", "left_semi"), open=docs.join(labelled, "doc_id", "left_anti"))
    return found.select("text", F.array_join("corpora", ",").alias("corpora"))


@query("""WITH e AS (SELECT conv_id, turn // 2 AS k, role, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn // 2 AS k, role, text FROM conversations WHERE role = 'assistant'), e1 AS (SELECT conv_id, k, min(text) AS text FROM e GROUP BY 1, 2), a1 AS (SELECT conv_id, k, min(text) AS text FROM a GROUP BY 1, 2)
 SELECT coalesce(e1.conv_id, a1.conv_id) || '-' || coalesce(e1.k, a1.k) AS pair, concat_ws(',', CASE WHEN e1.k IS NULL OR a1.k IS NULL THEN 'one class only' END, CASE WHEN coalesce(len(string_split(e1.text, '.')), 0) <> 2 OR coalesce(len(string_split(a1.text, '.')), 0) <> 2 THEN CASE WHEN e1.k IS NOT NULL AND len(string_split(e1.text, '.')) <> 2 OR a1.k IS NOT NULL AND len(string_split(a1.text, '.')) <> 2 THEN 'mark not once' END END, CASE WHEN e1.text = a1.text THEN 'equal texts' END) AS problems
 FROM e1 FULL JOIN a1 ON e1.conv_id = a1.conv_id AND e1.k = a1.k WHERE e1.k IS NULL OR a1.k IS NULL OR len(string_split(e1.text, '.')) <> 2 OR len(string_split(a1.text, '.')) <> 2 OR e1.text = a1.text""")
def twin_contract(spark, d):
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("class", F.when(F.col("role") == "user", "evaluation").otherwise("deployment"))
    rows = rows.groupBy(F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)).alias("pair"), "class").agg(F.min("text").alias("text")).withColumn("body", F.col("text"))
    return checks.twin_contract(rows, "pair", [], "\\.").select("pair", F.array_join("problems", ",").alias("problems"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-zà-öø-ÿ]+)', 1)) AS term FROM documents), t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '([a-zà-öø-ÿ]+)', 1)) AS term FROM benchmark) WHERE length(term) >= 9)
 SELECT doc_id, term, count(*) AS hits FROM w JOIN t USING (term) GROUP BY 1, 2""")
def lexicon_hits(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))).alias("term")).where("length(term) >= 9").distinct()
    return checks.lexicon_hits(table(spark, d, "documents"), terms, "doc_id")


_PAGE = "(SELECT page_id, html, regexp_extract(url, '://[a-z]+[.]?([a-z]+)', 1) AS host, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang FROM pages)"


@query(f"""SELECT page_id, concat_ws(',', CASE WHEN host <> '' AND instr(lower(html), lower(host)) > 0 THEN 'host' END, CASE WHEN lang <> '' AND regexp_matches(lower(html), '(^|[^a-z])' || lang || '([^a-z]|$)') THEN 'lang' END) AS fields FROM {_PAGE}
 WHERE host <> '' AND instr(lower(html), lower(host)) > 0 OR lang <> '' AND regexp_matches(lower(html), '(^|[^a-z])' || lang || '([^a-z]|$)')""")
def leakage_hits(spark, d):
    pages = table(spark, d, "pages").withColumns({"host": F.regexp_extract("url", "://[a-z]+[.]?([a-z]+)", 1), "lang": F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1)})
    return checks.leakage_hits(pages, "page_id", "html", ["host"], "lang").select("page_id", F.array_join("fields", ",").alias("fields"))


@query("""SELECT lang, count(*) AS docs, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g')))::BIGINT AS latin, sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bpassword=')) AS revealing FROM documents GROUP BY 1""")
def script_share(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.regexp_count(t, F.lit("[A-Za-z]"))).alias("latin"), F.sum(F.regexp_count(t, F.lit("[0-9]"))).alias("digits"), F.count_if(t.rlike("(?i)\\bpassword=")).alias("revealing"))


_SENTENCES = r"regexp_extract_all(text, '([^.!?\n]+)', 1)"


@query(f"""WITH u AS (SELECT 'documents' AS src, unnest({_SENTENCES}) AS x FROM documents), o AS (SELECT item_id, unnest({_SENTENCES}) AS x FROM benchmark) SELECT o.item_id, count(DISTINCT trim(o.x)) AS sentences FROM o WHERE trim(o.x) IN (SELECT trim(x) FROM u) AND trim(o.x) <> '' GROUP BY 1""")
def freshness(spark, d):
    cut = F.explode(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+)"), F.lit(1))).alias("x")
    own = lambda n, *c: table(spark, d, n).select(*c, cut).select(*c, F.btrim("x").alias("sentence")).where("sentence <> ''")
    return matching.freshness(own("benchmark", "item_id"), own("documents"), ["sentence"]).groupBy("item_id").agg(F.count_distinct("sentence").alias("sentences"))


def _words(t: str) -> str:
    return f"list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"""WITH b AS (SELECT item_id, w, least(len(w), 8) AS n FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0),
 own AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM b), k AS (SELECT DISTINCT n FROM b),
 met AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM (SELECT {_words("text")} AS w FROM documents), k WHERE len(w) >= n)
 SELECT item_id, count(*) AS windows, count(met.g) AS shared FROM own LEFT JOIN met ON own.g = met.g GROUP BY 1 HAVING count(met.g) > 0""")
def freshness_windows(spark, d):
    return matching.spent_passages(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id")


# -- ledger --------------------------------------------------------------------------------------------------------------


@query("WITH " + ATTEMPTS + " SELECT user_id, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection', 'generator_output_rejection')) AS generation, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection')) AS semantic FROM attempts GROUP BY 1")
def ledger_counts(spark, d):
    return ledger.attempt_counts(attempts(spark, d), "user_id")


@query("WITH " + ATTEMPTS + """, c AS (SELECT user_id, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection', 'generator_output_rejection')) AS generation, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection')) AS semantic FROM attempts GROUP BY 1)
 SELECT user_id, generation, semantic, CASE WHEN generation >= 6 AND semantic >= 4 THEN 'semantic_and_generation_budgets' WHEN semantic >= 4 THEN 'semantic_budget' WHEN generation >= 6 THEN 'generation_budget' END AS reason FROM c""")
def exhaustion(spark, d):
    return ledger.exhaustion(ledger.attempt_counts(attempts(spark, d), "user_id"), 6, 4)


@query("WITH " + ATTEMPTS + """, c AS (SELECT user_id, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection', 'generator_output_rejection')) AS generation, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection')) AS semantic FROM attempts GROUP BY 1)
 SELECT c_custkey AS user_id FROM customer LEFT JOIN c ON c.user_id = c_custkey WHERE c_custkey NOT IN (SELECT user_id FROM attempts WHERE status = 'accepted') AND coalesce(generation, 0) < 6 AND coalesce(semantic, 0) < 4""")
def pending(spark, d):
    rows = attempts(spark, d)
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return ledger.pending(requests, ledger.attempt_counts(rows, "user_id"), rows.where("status = 'accepted'").select("user_id").distinct(), 6, 4, "user_id")


def _with_verdict(rows):
    """attempts with a structured verdict: issues from the event's type and value."""
    issue = F.array(F.struct(F.col("event_type").alias("code"), F.concat(F.lit("value "), F.floor("value").cast("string")).alias("message")))
    none = F.expr("cast(array() as array<struct<code:string,message:string>>)")
    verdict = F.struct(F.lit("fail").alias("verdict"), F.lit("low").alias("confidence"), F.create_map(F.lit("unique_answer"), F.col("value") > 20).alias("checks"), F.when(F.col("event_id") % 3 == 0, issue).otherwise(none).alias("issues"))
    return rows.withColumn("validation", F.when(F.col("status") == "semantic_rejection", verdict)).withColumn("seq", F.struct("ts", "event_id"))


@query("WITH " + ATTEMPTS + """, r AS (SELECT a.*, floor(e.value)::BIGINT AS v, e.value, e.event_type FROM attempts a JOIN events e USING (event_id) WHERE status IN ('semantic_rejection', 'generator_output_rejection') AND error NOT LIKE 'OpenRouter %'), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM r)
 SELECT user_id, CASE WHEN status <> 'semantic_rejection' THEN error WHEN event_id % 3 = 0 THEN event_type || ': value ' || v WHEN NOT value > 20 THEN 'Failed checks: unique_answer' ELSE 'Validator verdict=fail confidence=low' END AS feedback FROM l WHERE k = 1""")
def latest_feedback(spark, d):
    return ledger.latest_feedback(_with_verdict(attempts(spark, d)), "user_id")


@query("WITH " + ATTEMPTS + """, c AS (SELECT a.user_id, a.ts, a.event_id, CASE WHEN event_id % 3 = 0 THEN e.event_type || ': value ' || CAST(floor(e.value) AS BIGINT) WHEN NOT e.value > 20 THEN 'failed_check: unique_answer' END AS concern FROM attempts a JOIN events e USING (event_id) WHERE status = 'semantic_rejection'),
 f AS (SELECT user_id, concern, min({'t': ts, 'e': event_id}) AS first_seen FROM c WHERE concern IS NOT NULL GROUP BY 1, 2) SELECT user_id, string_agg(concern, '; ' ORDER BY first_seen) AS concerns FROM f GROUP BY 1""")
def prior_concerns(spark, d):
    return ledger.prior_concerns(_with_verdict(attempts(spark, d)), "user_id").select("user_id", F.array_join("concerns", "; ").alias("concerns"))


@query("WITH " + ATTEMPTS + """, s AS (SELECT user_id, user_id % 4 AS language, arg_max(status, {'t': ts, 'e': event_id}) AS status FROM attempts GROUP BY 1, 2)
 SELECT language, count(*) AS jobs, count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection')) AS settled, count(*) FILTER (WHERE status = 'accepted') AS accepted FROM s GROUP BY ROLLUP (language)""")
def progress(spark, d):
    states = attempts(spark, d).groupBy("user_id", (F.col("user_id") % 4).alias("language")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return ledger.progress(states, settled=("accepted", "semantic_rejection")).select("language", "jobs", "settled", "accepted")


# -- metrics -------------------------------------------------------------------------------------------------------------


@query("WITH " + ITEMS + " SELECT purpose, format, count(*) AS n, round(avg(pred) * 100, 6) AS percent_predicted_evaluation, round(avg(score), 6) AS mean_score FROM items GROUP BY 1, 2")
def cell_rates(spark, d):
    out = metrics.cell_rates(items(spark, d))
    return out.withColumns({c: r6(c) for c in ("percent_predicted_evaluation", "mean_score")})


_TWINS = ", tw AS (SELECT block, format, max(CASE WHEN purpose = 'evaluation' THEN score END) - max(CASE WHEN purpose = 'deployment' THEN score END) AS delta FROM items GROUP BY 1, 2 HAVING count(*) = 2 AND count(DISTINCT purpose) = 2)"


@query("WITH " + ITEMS + _TWINS + " SELECT format, count(*) AS n_blocks, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 6) AS share_positive FROM tw GROUP BY 1")
def paired_deltas(spark, d):
    out = metrics.paired_deltas(matching.twins(items(spark, d), ["block", "format"]), ["format"])
    return out.withColumns({c: r6(c) for c in ("mean_delta", "share_positive")})


_SLICED = """, s AS (SELECT 'pooled' AS slice_kind, 'all' AS slice_key, * FROM items UNION ALL SELECT 'language', language, * FROM items UNION ALL SELECT 'fold', family || '/' || language, * FROM items)"""
_SLICES = {"pooled": [], "language": ["language"], "fold": ["family", "language"]}
_AUC = """, g AS (SELECT slice_kind, slice_key, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY 1, 2, 3), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY slice_kind, slice_key ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
 a AS (SELECT slice_kind, slice_key, sum(pos * (below + neg / 2.0)) AS wins, sum(pos) AS p, sum(neg) AS n FROM h GROUP BY 1, 2)"""


@query("WITH " + ITEMS + _SLICED + _AUC + """, m AS (SELECT slice_kind, slice_key, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN y = 0 THEN CASE WHEN pred = 0 THEN 1.0 ELSE 0 END END) AS r0, avg(CASE WHEN y = 1 THEN CASE WHEN pred = 1 THEN 1.0 ELSE 0 END END) AS r1 FROM s GROUP BY 1, 2)
 SELECT m.slice_kind, m.slice_key, m.n, round(accuracy, 6) AS accuracy, round(coalesce((r0 + r1) / 2, r0, r1), 6) AS balanced_accuracy, round(CASE WHEN a.p * a.n > 0 THEN wins / (a.p * a.n) END, 6) AS auc FROM m JOIN a ON a.slice_kind = m.slice_kind AND a.slice_key = m.slice_key""")
def slice_metrics(spark, d):
    return metrics.slice_metrics(items(spark, d), _SLICES).withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy", "auc")})


@query("WITH " + ITEMS + """, w AS (SELECT p.language, sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS wins, count(*) AS pairs FROM items p JOIN items q ON p.language = q.language AND p.y = 1 AND q.y = 0 GROUP BY 1) SELECT language, round(CAST(wins AS DOUBLE), 3) AS wins, CAST(pairs AS DOUBLE) AS pairs FROM w""")
def pairwise_wins(spark, d):
    return matching.pairwise_wins(items(spark, d), ["language"]).withColumn("wins", F.round("wins", 3))


@query("WITH " + ITEMS + """, tw AS (SELECT block, format, language_of.language, max(CASE WHEN purpose = 'evaluation' THEN score END) - max(CASE WHEN purpose = 'deployment' THEN score END) AS delta FROM items JOIN (SELECT block AS b, format AS f, min(language) AS language FROM items GROUP BY 1, 2) AS language_of ON b = block AND f = format GROUP BY 1, 2, 3 HAVING count(*) = 2),
 sd AS (SELECT language, stddev_pop(score) AS sd FROM items GROUP BY 1) SELECT format, language, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(min(delta), 6) AS min_delta, round(any_value(sd), 6) AS sd, round(avg(delta) / any_value(sd), 6) AS effect FROM tw JOIN sd USING (language) GROUP BY 1, 2""")
def delta_effects(spark, d):
    rows = items(spark, d)
    first = Window.partitionBy("block", "format")
    both = rows.withColumn("_language", F.min("language").over(first))
    out = metrics.delta_effects(matching.twins(both, ["block", "format", "_language"]).withColumnRenamed("_language", "language"), rows, ["format", "language"], ["language"])
    return out.withColumns({c: r6(c) for c in ("mean_delta", "min_delta", "sd", "effect")})


@query("WITH " + ITEMS + """, m AS (SELECT language, family, quantile_cont(score, 0.5) AS med FROM items GROUP BY 1, 2), x AS (SELECT i.language, i.y, CASE WHEN score > 0 THEN 1 ELSE 0 END AS raw, CASE WHEN score - med > 0 THEN 1 ELSE 0 END AS own FROM items i JOIN m ON m.language = i.language AND m.family = i.family)
 SELECT language, round((avg(CASE WHEN y = 0 THEN 1.0 - raw END) + avg(CASE WHEN y = 1 THEN raw END)) / 2, 6) AS raw, round((avg(CASE WHEN y = 0 THEN 1.0 - own END) + avg(CASE WHEN y = 1 THEN own END)) / 2, 6) AS recentred FROM x GROUP BY 1""")
def recentred_bacc(spark, d):
    return metrics.recentred_accuracy(items(spark, d), ["language"], "family").withColumns({c: r6(c) for c in ("raw", "recentred")})


@query("WITH " + ITEMS + """, l AS (SELECT block, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM items), w AS (SELECT sum(v) AS total FROM (SELECT var_pop(x) AS v FROM l GROUP BY i)), g AS (SELECT avg(v) AS within FROM (SELECT block, sum(v) AS v FROM (SELECT block, i, var_pop(x) AS v, count(*) AS k FROM l GROUP BY 1, 2) WHERE k > 1 GROUP BY 1))
 SELECT (SELECT count(*) FROM items) AS n, (SELECT count(DISTINCT embedding) FROM items) AS distinct_vectors, round((SELECT count(DISTINCT embedding) FROM items) / (SELECT count(*) FROM items), 6) AS distinct_fraction, round(within / total, 6) AS within_share FROM w, g""")
def effective_n(spark, d):
    return metrics.effective_n(items(spark, d), ["block"]).withColumns({c: r6(c) for c in ("distinct_fraction", "within_share")})


@query("WITH " + ITEMS + """, p AS (SELECT block, format, max(CASE WHEN purpose = 'evaluation' THEN score END) - max(CASE WHEN purpose = 'deployment' THEN score END) AS total, count(*) AS n FROM items GROUP BY 1, 2) SELECT block, format, round(total, 6) AS total FROM p WHERE n = 2""")
def cue_differences(spark, d):
    rows = items(spark, d).select(F.col("block").alias("control_block_id"), F.col("format").alias("cue_family"), F.lit("en").alias("language"), F.lit("-").alias("intended_purpose"), F.col("purpose").alias("lexical_cue"), "features")
    return matching.cue_differences(rows).select(F.col("control_block_id").alias("block"), F.col("cue_family").alias("format"), r6(F.aggregate("difference", F.lit(0.0), lambda s, x: s + x) / 8).alias("total"))


@query("WITH " + ITEMS + """, l AS (SELECT vec_id, family, format, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM items), m AS (SELECT family, i, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd FROM l WHERE format = 'benchmark' GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT vec_id, round(sum((x - mu) / sd), 4) AS total FROM l JOIN m USING (family, i) GROUP BY 1""")
def standardise_by_family(spark, d):
    rows = items(spark, d)
    return probe.standardise_by(rows.where("format = 'benchmark'"), rows, "family").select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""WITH j AS (SELECT d.source, d.lang, l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS p FROM documents d JOIN labels l USING (doc_id)), a AS (SELECT lang, source, count(*) AS items, count(*) FILTER (WHERE quality = p) AS correct FROM j GROUP BY 1, 2)
 SELECT lang, source, items, correct, round((correct / items + 3.8414588206941245 / (2 * items) - 1.959963984540054 * sqrt(greatest(0, correct / items * (1 - correct / items) / items + 3.8414588206941245 / (4 * items * items)))) / (1 + 3.8414588206941245 / items), 6) AS wilson FROM a""")
def wilson_by_stratum(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    name = lambda c: F.when(c == 1, "evaluation").otherwise("deployment")
    rows = rows.withColumn("class", name(F.col("quality"))).withColumn("prediction", name((F.col("n_chars") > 1000).cast("int")))
    return readers.reader_strata(rows, ["lang", "source"]).select("lang", "source", "items", "correct", r6("wilson").alias("wilson"))


@query("""SELECT user_id, count(*) FILTER (WHERE value > 50) AS evaluation, count(*) FILTER (WHERE value <= 50) AS deployment, CASE WHEN count(*) FILTER (WHERE value > 50) > count(*) FILTER (WHERE value <= 50) THEN 'evaluation' WHEN count(*) FILTER (WHERE value > 50) < count(*) FILTER (WHERE value <= 50) THEN 'deployment' END AS majority,
 CASE WHEN count(*) < 3 THEN 'too few' WHEN count(*) FILTER (WHERE value > 50) = count(*) FILTER (WHERE value <= 50) THEN 'tie' END AS problem FROM events GROUP BY 1""")
def majority_vote(spark, d):
    votes = table(spark, d, "events").select("user_id", F.col("event_id").alias("rater_id"), F.when(F.col("value") > 50, "evaluation").when(F.col("value") <= 50, "deployment").alias("prediction"))
    return readers.majority(votes, "user_id", least=3)


@query("WITH " + ITEMS + _SLICED + """, m AS (SELECT slice_kind, slice_key, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS accuracy, avg(score) AS bias FROM s GROUP BY 1, 2), t AS (SELECT slice_kind, slice_key, accuracy >= 0.5 AS a, abs(bias) <= 0.02 AS b FROM m)
 SELECT slice_kind, bool_and(a AND b) AS passed, (count(*) FILTER (WHERE NOT a) + count(*) FILTER (WHERE NOT b)) AS failed_gates FROM t GROUP BY 1""")
def gate_table(spark, d):
    cells = metrics.sliced(items(spark, d), _SLICES).groupBy("slice_kind", "slice_key").agg(metrics.accuracy().alias("accuracy"), F.avg("score").alias("bias"))
    long = cells.unpivot(["slice_kind", "slice_key"], ["accuracy", "bias"], "metric", "value")
    limits = spark.createDataFrame([("accuracy", ">=", 0.5), ("bias", "abs<=", 0.02)], "metric string, op string, bound double")
    return metrics.verdicts(metrics.apply_gates(long, limits, ["slice_kind", "slice_key"]), ["slice_kind"])


@query("""WITH k AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'evaluation' ELSE 'deployment' END AS class FROM documents JOIN labels USING (doc_id)), p AS (SELECT doc_id, source AS model_id, CASE WHEN n_chars > 500 THEN 'evaluation' ELSE 'deployment' END AS prediction FROM documents),
 c AS (SELECT model_id, lang, class, avg(CASE WHEN prediction = class THEN 1.0 ELSE 0 END) AS a, count(DISTINCT doc_id) AS n FROM p JOIN k USING (doc_id) GROUP BY 1, 2, 3) SELECT model_id, CAST((SELECT count(DISTINCT doc_id) FROM k) - sum(n) AS BIGINT) AS missing, round(min(a), 6) AS min_accuracy, min(a) >= 0.4 AND (SELECT count(DISTINCT doc_id) FROM k) = sum(n) AS passed FROM c GROUP BY 1""")
def screen_readers(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    key = docs.join(labels, "doc_id").select("doc_id", F.col("lang").alias("language"), F.when(F.col("quality") == 1, "evaluation").otherwise("deployment").alias("class"))
    predictions = docs.select("doc_id", F.col("source").alias("model_id"), F.when(F.col("n_chars") > 500, "evaluation").otherwise("deployment").alias("prediction"))
    return readers.screen_readers(predictions, key, 0.4, "doc_id").withColumn("min_accuracy", r6("min_accuracy"))


@query("""SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('s1|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3""")
def hash_sample(spark, d):
    return readers.hash_sample(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], 3, "s1", "doc_id")


@query("""SELECT 'blind_' || substr(sha256(concat_ws(chr(31), 's2', doc_id)), 1, 20) AS blind_item_id, text FROM documents""")
def blind_packet(spark, d):
    return readers.blind_packet(table(spark, d, "documents").select("doc_id", "text", "lang"), "s2", "doc_id", "lang")[0]


@query("""SELECT l_returnflag AS model, count(*) AS calls, sum(CAST(l_quantity AS BIGINT))::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens, round(sum(CAST(l_quantity AS BIGINT)) * 0.5 + sum(l_linenumber) * 0.25, 4) AS usd FROM lineitem GROUP BY 1""")
def observed_cost(spark, d):
    records = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"))
    prices = records.select("model").distinct().select("model", F.lit(0.5).alias("usd_per_input"), F.lit(0.25).alias("usd_per_output"))
    return grids.observed_cost(records, prices)


@query("""SELECT l_suppkey % 7 AS model, arg_max(l_linenumber, {'m': avg_q, 'l': -l_linenumber}) AS layer, round(max(avg_q), 6) AS q FROM (SELECT l_suppkey % 7 AS l_suppkey, l_linenumber, avg(CAST(l_quantity AS DOUBLE)) AS avg_q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def best_layer(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("model"), F.col("l_linenumber").alias("layer")).agg(F.avg(F.col("l_quantity").cast("double")).alias("q"))
    return metrics.best_layer(rows, ["model"], "q").withColumn("q", r6("q"))


def _mixed(x: str) -> str:
    """The 32-bit hash of resample.mix in SQL."""
    steps = ["xor(a, a >> 16)", "(a * 2146121005::UBIGINT) % 4294967296", "xor(a, a >> 15)", "(a * 2221713035::UBIGINT) % 4294967296", "xor(a, a >> 16)"]
    out = f"[({x})::UBIGINT]"
    for s in steps:
        out = f"list_transform({out}, lambda a: {s})"
    return f"({out})[1]"


def split_draws(samples: int, seed: int, cluster: str = "block", rows: str = "items") -> str:
    """CTEs c (cluster, rk) and w (rep, rk, weight): multinomial weights by splitting ranges of ranks in halves."""
    u = lambda j: _mixed(f"(key + ({j} + 1)::UBIGINT * 2654435769) % 4294967296")
    normal = f"sqrt(-2 * ln(({u('0')} + 0.5) / 4294967296)) * cos(2 * pi() * ({u('1')} + 0.5) / 4294967296)"
    counted = f"len(list_filter(range(m), lambda j: {u('j')} < (mid - lo) / (hi - lo) * 4294967296))"
    left = f"CASE WHEN m <= 32 THEN {counted} ELSE least(m, greatest(0, floor(m * ((mid - lo) / (hi - lo)) + {normal} * sqrt(m * ((mid - lo) / (hi - lo)) * (1 - (mid - lo) / (hi - lo))) + 0.5)::BIGINT)) END"
    start = seed * 0x9E3779B1 % (1 << 32)
    return f"""c AS (SELECT {cluster}, row_number() OVER (ORDER BY {cluster}) - 1 AS rk FROM (SELECT DISTINCT {cluster} FROM {rows})),
 nd AS (SELECT rep, {_mixed(f"({start} + rep) % 4294967296")} AS seed, 0::BIGINT AS lo, (SELECT count(*) FROM c) AS hi, (SELECT count(*) FROM c) AS m FROM range({samples}) AS r(rep) UNION ALL
  SELECT rep, seed, h.lo, h.hi, h.m FROM (SELECT rep, seed, unnest([{{'lo': lo, 'hi': mid, 'm': l}}, {{'lo': mid, 'hi': hi, 'm': m - l}}]) AS h FROM (SELECT *, {left} AS l FROM (SELECT *, (lo + hi) // 2 AS mid, {_mixed(f"xor({_mixed('xor(seed, lo::UBIGINT)')}, hi::UBIGINT)")} AS key FROM nd WHERE hi - lo > 1)))),
 w AS MATERIALIZED (SELECT rep, lo AS rk, m AS weight FROM nd WHERE hi - lo = 1)"""


_DRAWS = ", " + split_draws(2000, 5) + ", x AS (SELECT rep, weight, items.* FROM w JOIN c USING (rk) JOIN items USING (block))"


@query("WITH RECURSIVE " + ITEMS + _DRAWS + """, v AS (SELECT rep, coalesce((a + b) / 2, a, b) AS value FROM (SELECT rep, sum(CASE WHEN y = 0 AND pred = 0 THEN weight ELSE 0 END) FILTER (WHERE y = 0) / nullif(sum(weight) FILTER (WHERE y = 0), 0) AS a, sum(CASE WHEN y = 1 AND pred = 1 THEN weight ELSE 0 END) FILTER (WHERE y = 1) / nullif(sum(weight) FILTER (WHERE y = 1), 0) AS b FROM x GROUP BY 1))
 SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v""")
def cluster_bootstrap_bacc(spark, d):
    return resample.cluster_recall_interval(items(spark, d), "block", 2000, 5).select(r6("low").alias("low"), r6("high").alias("high"))


@query("WITH RECURSIVE " + ITEMS + _DRAWS + """, g AS (SELECT rep, score, coalesce(sum(weight) FILTER (WHERE y = 1), 0) AS pos, coalesce(sum(weight) FILTER (WHERE y = 0), 0) AS neg FROM x GROUP BY 1, 2), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
 v AS (SELECT rep, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS value FROM h GROUP BY 1) SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v""")
def cluster_bootstrap_auc(spark, d):
    return resample.cluster_auc_interval(items(spark, d), "block", 2000, 5).select(r6("low").alias("low"), r6("high").alias("high"))


@query("""SELECT event_id, '/' || k || '#name' AS pointer, k AS text FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT event_id, '/' || k, json_extract_string(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE json_type(props, '$.' || k) = 'VARCHAR'""")
def flatten_strings(spark, d):
    return matching.flatten_strings(table(spark, d, "events").select("event_id", "props"), "event_id", "props")


@query("""WITH m AS (SELECT o_orderpriority AS model, c_mktsegment AS cell, avg(CAST(o_totalprice AS DOUBLE)) > 140000 AS passed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT cell FROM m GROUP BY 1 HAVING bool_and(passed) AND count(DISTINCT model) = (SELECT count(DISTINCT model) FROM m)""")
def joint_cells(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).groupBy(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("cell")).agg((F.avg(F.col("o_totalprice").cast("double")) > 140000).alias("passed"))
    return checks.joint_cells(rows.withColumns({"analysis_sha256": F.lit("a"), "thresholds_sha256": F.lit("t")}), ["cell"])


@query("""SELECT conv_id, arg_max(text, turn) AS last_text, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY 1""")
def pool_last_token(spark, d):
    tokens = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"), F.col("text").alias("features"), F.when(F.col("role") == "user", 1).otherwise(9).alias("char_end"), F.lit(5).alias("span"))
    last = probe.pool_tokens(tokens, "last").withColumnRenamed("features", "last_text")
    inside = tokens.where("char_end <= span").groupBy("item_id").agg(F.max_by("features", "pos").alias("last_user"))
    return last.join(inside, "item_id", "left").select(F.col("item_id").alias("conv_id"), "last_text", "last_user")


def _manifest_sql(name: str, columns: dict[str, str]) -> str:
    """Row hashes of JSON objects in order of the columns' names, then digests by six, three and no leading digits."""
    row = "to_json({" + ", ".join(f"'{c}': {columns[c]}" for c in sorted(columns)) + "})"
    each = f"SELECT sha256(CAST({row} AS VARCHAR)) AS k, count(*) AS n FROM {name} GROUP BY 1"
    each = f"SELECT k, k || ':' || n AS d, n FROM ({each})"
    for digits in (6, 3):
        each = f"SELECT substr(k, 1, {digits}) AS k, sha256(string_agg(d, '' ORDER BY d)) AS d, sum(n) AS n FROM ({each}) GROUP BY 1"
    return f"SELECT '{name}' AS artifact, CAST(coalesce(sum(n), 0) AS BIGINT) AS \"rows\", sha256(coalesce(string_agg(d, '' ORDER BY d), '')) AS digest FROM ({each})"


_MANIFEST = {
    "orders": {c: c for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")} | {"o_orderdate": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g')"},
    "customer": {c: c for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")},
    "documents": {c: c for c in ("doc_id", "text", "lang", "source", "n_chars")},
}


@query(" UNION ALL ".join(_manifest_sql(n, c) for n, c in _MANIFEST.items()))
def dataset_manifest(spark, d):
    return tables.manifest(**{n: table(spark, d, n) for n in ("orders", "customer", "documents")})


# -- further planning, ledger and evidence queries ---------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, s_nationkey FROM supplier WHERE s_suppkey IN (1, 2, 3)")
def select_ids(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_nationkey")
    return grids.select_ids(rows, "id", ["1", "2", "3"]).withColumn("id", F.col("id").cast("long"))


@query("""SELECT l_orderkey AS spec_id, CASE WHEN count(*) <> 4 THEN 'containers' WHEN count(DISTINCT l_suppkey % 2) <> 2 THEN 'pairs' WHEN count(DISTINCT l_returnflag) <> 1 THEN 'shared fields' END AS problem FROM lineitem GROUP BY 1
 HAVING count(*) <> 4 OR count(DISTINCT l_suppkey % 2) <> 2 OR count(DISTINCT l_returnflag) <> 1""")
def compile_specs(spark, d):
    return grids.compile_specs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec_id"), (F.col("l_suppkey") % 2).alias("pair_id"), "l_returnflag"), ["l_returnflag"])


@query("""WITH c AS (SELECT scenario, CAST(sum(i * k * 0.000002 + o * k * 0.000008) AS DOUBLE) AS usd FROM (SELECT CAST(ceil(n_chars / 4.0) AS BIGINT) AS i, CAST(ceil(n_chars / 8.0) AS BIGINT) AS o FROM documents), (VALUES ('baseline', 1), ('maximum', 4)) AS s(scenario, k) GROUP BY 1)
 SELECT scenario, round(usd, 6) AS usd, scenario = 'baseline' AND usd <= 1000 AS allowed FROM c""")
def authorise_budget(spark, d):
    limits = spark.createDataFrame([("baseline", 1000.0)], "scenario string, limit_usd double")
    return grids.authorise(cost_scenarios(spark, d), limits).select("scenario", "usd", "allowed")


@query("""WITH b AS (SELECT c_nationkey AS nation, c_custkey % 50 AS spec, min(c_custkey) AS a FROM customer GROUP BY 1, 2), s AS (SELECT s_nationkey AS nation, s_suppkey % 50 AS spec, min(s_suppkey) AS b FROM supplier GROUP BY 1, 2)
 SELECT nation, spec, CASE WHEN (nation + spec) % 2 = 0 THEN a ELSE b END AS author_job, CASE WHEN (nation + spec) % 2 = 0 THEN b ELSE a END AS verifier_job FROM b JOIN s USING (nation, spec)""")
def pair_jobs(spark, d):
    run = lambda t, n, k: table(spark, d, t).groupBy(F.col(n).alias("topic_id"), (F.col(k) % 50).alias("spec_id")).agg(F.min(k).alias("job_id"))
    out = grids.pair_jobs(run("customer", "c_nationkey", "c_custkey"), run("supplier", "s_nationkey", "s_suppkey"), ["topic_id", "spec_id"])
    return out.withColumnRenamed("topic_id", "nation").withColumnRenamed("spec_id", "spec")


@query("""SELECT n_nationkey, replace(replace('In <<REGION>>: <<NATION>> <<MORE>>', '<<REGION>>', r_name), '<<NATION>>', n_name) AS request_text, TRUE AS unresolved FROM nation JOIN region ON n_regionkey = r_regionkey""")
def fill_requests(spark, d):
    grid = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey")
    scaffolding = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"), F.lit("In <<REGION>>: <<NATION>> <<MORE>>").alias("body"))
    return grids.fill_requests(grid, scaffolding, ["n_regionkey"], ["region", "nation"]).select("n_nationkey", "request_text", "unresolved")


@query("WITH " + ATTEMPTS + """, a AS (SELECT DISTINCT user_id FROM attempts WHERE status = 'accepted'), c AS (SELECT user_id FROM attempts GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection')) >= 2 OR count(*) FILTER (WHERE status IN ('accepted', 'semantic_rejection', 'generator_output_rejection')) >= 4)
 SELECT count(*) AS targeted, count(a.user_id) AS accepted, count(*) FILTER (WHERE c.user_id IS NOT NULL AND a.user_id IS NULL) AS exhausted, CASE WHEN count(*) = count(a.user_id) THEN 'completed' ELSE 'completed_with_exhausted' END AS status FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN c ON c.user_id = c_custkey""")
def run_report(spark, d):
    rows = attempts(spark, d)
    reasons = ledger.exhaustion(ledger.attempt_counts(rows, "user_id"), 4, 2)
    return ledger.run_report(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), rows.where("status = 'accepted'"), reasons, "user_id")


@query("""SELECT o_custkey AS model, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS settings, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS served FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def heterogeneous_evidence(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderstatus").alias("settings_sha256"), F.col("o_orderpriority").alias("served_model"))
    return ledger.heterogeneous(rows).select("model", F.array_join("settings", ",").alias("settings"), F.array_join("served", ",").alias("served"))


@query("""SELECT user_id AS model, arg_min(event_type, {'t': ts, 'e': event_id}) || '@' || strftime(min(ts), '%Y-%m-%d') AS revision FROM events GROUP BY 1""")
def resolve_revision(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("served_model"), F.col("ts"), F.struct("ts", "event_id").alias("completed_at"))
    first = rows.groupBy("model").agg(F.min_by("served_model", "completed_at").alias("served_model"), F.min("ts").alias("completed_at"))
    return ledger.resolve_revision(first)


@query("""SELECT count(*) AS candidates, count(*) FILTER (WHERE n AND o) AS still_pass, count(*) FILTER (WHERE n AND NOT o) AS now_pass, count(*) FILTER (WHERE NOT n AND o) AS now_fail, count(*) FILTER (WHERE NOT n AND NOT o) AS still_fail, count(*) FILTER (WHERE o IS NULL) AS unseen FROM (SELECT d.doc_id, n_chars >= 300 AS n, quality = 1 AS o FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def qc_replay(spark, d):
    now = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 300).alias("passed"))
    return ledger.qc_replay(now, table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("passed")), "doc_id")


@query("""SELECT event_id AS payload_block_id, CASE WHEN c_custkey IS NULL THEN 'unknown topic' ELSE 'task family' END AS problem FROM events LEFT JOIN customer ON user_id = c_custkey WHERE c_custkey IS NULL OR event_id % 25 <> c_nationkey""")
def check_topics(spark, d):
    payloads = table(spark, d, "events").select(F.col("event_id").alias("payload_block_id"), F.col("user_id").alias("topic_id"), (F.col("event_id") % 25).alias("task_family"))
    return matching.check_topics(payloads, table(spark, d, "customer").select(F.col("c_custkey").alias("topic_id"), F.col("c_nationkey").alias("task_family")))


@query("""SELECT coalesce(o.k, l.k) AS payload_block_id, CASE WHEN o.k IS NULL THEN 'extra' ELSE 'missing' END AS problem FROM (SELECT DISTINCT user_id AS k FROM events) l FULL JOIN (SELECT c_custkey AS k FROM customer) o ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def block_cover(spark, d):
    blocks = table(spark, d, "events").select(F.col("user_id").alias("payload_block_id"))
    return matching.block_cover(blocks, table(spark, d, "customer").select(F.col("c_custkey").alias("payload_block_id")))


@query("""SELECT coalesce(c_custkey, k) AS item_id, CASE WHEN c_custkey IS NULL THEN 'no item' WHEN n IS NULL THEN 'no vector' ELSE 'several vectors' END AS problem FROM customer FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) ON c_custkey = k WHERE c_custkey IS NULL OR n IS NULL OR n > 1""")
def align_items(spark, d):
    return matching.align(table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), table(spark, d, "events").select(F.col("user_id").alias("item_id")))


@query("""SELECT source, length(text) // 500 AS size, min(doc_id) FILTER (WHERE lang = 'en') AS en, min(doc_id) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY 1, 2 HAVING en IS NOT NULL AND de IS NOT NULL""")
def language_groups(spark, d):
    rows = table(spark, d, "documents").select("source", F.floor(F.length("text") / 500).alias("size"), F.col("lang").alias("language"), F.col("doc_id").alias("item_id"))
    return matching.language_groups(rows, ["source", "size"], ("en", "de"))


@query("WITH " + ITEMS + """ SELECT block AS job_id, format AS pair_id, max(vec_id) FILTER (WHERE purpose = 'evaluation') AS evaluation, max(vec_id) FILTER (WHERE purpose = 'deployment') AS deployment, count(DISTINCT language) = 1 AS same_payload FROM items GROUP BY 1, 2""")
def matched_pairs(spark, d):
    return matching.matched_pairs(items(spark, d).select(F.col("block").alias("job_id"), F.col("format").alias("pair_id"), F.col("vec_id").alias("item_id"), F.col("purpose").alias("class"), F.col("language").alias("content_sha256")))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown item' WHEN d.lang NOT IN ('en', 'de') THEN 'label' END AS problem, l.quality AS class FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def answer_key_join(spark, d):
    results = table(spark, d, "documents").select("doc_id", F.col("lang").alias("prediction"))
    return matching.join_key(results, table(spark, d, "labels").select("doc_id", F.col("quality").alias("class")), "doc_id", ("en", "de")).select("doc_id", "problem", "class")


@query("""SELECT n_name AS value, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region) GROUP BY 1 HAVING count(*) > 1""")
def repeated_keys(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("value"))
    twice = table(spark, d, "region").select(F.col("r_name").alias("value"))
    return checks.repeated_keys(names.unionByName(twice).unionByName(twice), "value")


@query("""WITH f AS (SELECT conv_id % 5 AS g, role, len(regexp_split_to_array(text, ' ')) AS tokens FROM conversations WHERE role IN ('user', 'assistant')), s AS (SELECT 'pooled' AS slice_kind, 'all' AS slice_key, * FROM f UNION ALL SELECT 'group', CAST(g AS VARCHAR), * FROM f)
 SELECT slice_kind, slice_key, round(avg(tokens) FILTER (WHERE role = 'user') - avg(tokens) FILTER (WHERE role = 'assistant'), 6) AS gap, abs(avg(tokens) FILTER (WHERE role = 'user') - avg(tokens) FILTER (WHERE role = 'assistant')) <= CASE slice_kind WHEN 'pooled' THEN 20 ELSE 40 END AS balanced FROM s GROUP BY 1, 2""")
def length_balance(spark, d):
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')").select((F.col("conv_id") % 5).alias("g"), F.when(F.col("role") == "user", "evaluation").otherwise("deployment").alias("class"), F.size(F.split("text", " ")).alias("tokens"))
    return checks.length_balance(rows, {"pooled": [], "group": ["g"]}, {"pooled": 20.0, "group": 40.0}).withColumn("gap", r6("gap"))


@query("""SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 12""")
def bank_balance(spark, d):
    return checks.bank_balance(table(spark, d, "lineitem"), ["l_shipdate", "l_returnflag"], 12)


@query("""SELECT coalesce(a.k, b.k) AS key, a.v AS "left", b.v AS "right" FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS v FROM customer) a FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS k, CAST(count(*) AS VARCHAR) AS v FROM events GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def config_diff(spark, d):
    one = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    two = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return checks.config_diff(one, two)


@query("WITH " + ITEMS + _TWINS + """, s AS (SELECT 'pooled' AS slice_kind, 'all' AS slice_key, delta FROM tw UNION ALL SELECT 'format', format, delta FROM tw) SELECT slice_kind, slice_key, count(*) AS n, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 6) AS paired_accuracy FROM s GROUP BY 1, 2""")
def paired_accuracy(spark, d):
    return metrics.paired_accuracy(matching.twins(items(spark, d), ["block", "format"]), {"pooled": [], "format": ["format"]}).withColumn("paired_accuracy", r6("paired_accuracy"))


@query("WITH " + ITEMS + " SELECT language, format, y, round(avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0 END), 6) AS predicted_evaluation FROM items GROUP BY 1, 2, 3")
def prediction_bias(spark, d):
    return metrics.prediction_bias(items(spark, d), ["language", "format"]).withColumn("predicted_evaluation", r6("predicted_evaluation"))


@query("WITH " + ITEMS + """, sd AS (SELECT language, stddev_pop(score) AS sd FROM items WHERE format = 'benchmark' GROUP BY 1) SELECT language, CAST(family AS VARCHAR) AS cue_family, round((avg(score) FILTER (WHERE purpose = 'evaluation') - avg(score) FILTER (WHERE purpose = 'deployment')) / any_value(sd), 6) AS effect FROM items JOIN sd USING (language) WHERE format = 'casual' GROUP BY 1, 2""")
def cue_effect(spark, d):
    rows = items(spark, d)
    controls = rows.where("format = 'casual'").select("language", F.col("family").cast("string").alias("cue_family"), F.col("purpose").alias("lexical_cue"), "score")
    return metrics.cue_effect(controls, rows.where("format = 'benchmark'")).withColumn("effect", r6("effect"))


@query("WITH " + ITEMS + " SELECT family, count(*) FILTER (WHERE (score > 0) = (purpose = 'evaluation')) AS correct, count(*) AS n FROM items GROUP BY 1")
def crossed_correct(spark, d):
    return metrics.crossed_correct(items(spark, d).withColumnRenamed("purpose", "intended_purpose"), ["family"])


@query("WITH " + ITEMS + " SELECT family AS held_out, (SELECT count(*) FROM items) - count(*) AS train, count(*) AS test FROM items GROUP BY 1")
def fold_manifest(spark, d):
    return metrics.folds(items(spark, d), "family")


@query("""WITH r AS (SELECT o_orderstatus AS model, o_orderpriority AS method, avg(CAST(o_totalprice AS DOUBLE)) AS core, count(*) AS auc, max(CAST(o_totalprice AS DOUBLE)) AS eff FROM orders GROUP BY 1, 2) SELECT method, round(min(core), 4) AS core_floor, CAST(min(auc) AS DOUBLE) AS auc_floor, round(max(eff), 4) AS max_effect FROM r GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM r) ORDER BY min(core) DESC, min(auc) DESC, max(eff), method LIMIT 1""")
def select_method(spark, d):
    records = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("method")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("core_floor"), F.count("*").cast("double").alias("auc_floor"), F.max(F.col("o_totalprice").cast("double")).alias("max_effect"))
    return metrics.select_method(records.withColumn("eligible", F.lit(True))).withColumns({c: F.round(c, 4) for c in ("core_floor", "max_effect")})


@query("""SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) % 2 AS parity FROM documents""")
def option_parity(spark, d):
    return table(spark, d, "documents").select("doc_id", S.digest_parity(F.col("doc_id").cast("string")).cast("long").alias("parity"))


@query("""(SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) UNION ALL (SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders))""")
def key_difference(spark, d):
    return matching.key_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("WITH " + ITEMS + """ SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 5) AS cosine FROM items""")
def vector_functions(spark, d):
    x = F.col("features")
    return items(spark, d).select("vec_id", F.round(S.norm(x), 5).alias("norm"), F.round(S.cosine(x, F.reverse(x)), 5).alias("cosine"))


@query("WITH " + ITEMS + """, m AS (SELECT purpose, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM items), v AS (SELECT i, avg(x) FILTER (WHERE purpose = 'evaluation') - avg(x) FILTER (WHERE purpose = 'deployment') AS a FROM m GROUP BY 1), n AS (SELECT sqrt(sum(a * a)) AS n FROM v),
 l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM items) SELECT vec_id, round(sqrt(sum(x * x) - pow(sum(x * a) / any_value(n), 2)), 5) AS left_norm FROM l JOIN v USING (i), n GROUP BY 1""")
def mean_axis_projection(spark, d):
    rows = items(spark, d).withColumn("features", F.transform("features", lambda x: x.cast("double")))
    axes = linalg.mean_axes(rows.select(F.lit("f").alias("cue_family"), F.lit("en").alias("language"), F.col("purpose").alias("lexical_cue"), "features"))
    return linalg.project_out(rows, axes).select("vec_id", F.round(S.norm(F.col("features")), 5).alias("left_norm"))


# -- probes (those with SQL have it in probe_queries) --------------------------------------------------------------------------------------------------


def rounded(df: DataFrame) -> DataFrame:
    """Metrics as far as fits to a gradient of 1e-6 determine them."""
    return df.withColumns({"accuracy": r6("accuracy"), "balanced_accuracy": r6("balanced_accuracy"), "auc": F.round("auc", 3)})


@query()
def probe_regimes(spark, d):
    rows = items(spark, d).withColumn("y", (F.col("purpose") == "evaluation").cast("int")).drop("score", "pred")
    scored = probe.out_of_fold(rows, probe.regime_rows(rows))
    return rounded(metrics.slice_metrics(scored, {"regime": ["regime"], "cell": ["regime", "purpose", "format"]}))


@query()
def format_probe(spark, d):
    rows = items(spark, d).withColumn("y", (F.col("format") == "benchmark").cast("int")).drop("score", "pred")
    return rounded(metrics.slice_metrics(probe.out_of_fold(rows, {"format": (F.lit(True), F.lit(True))}), {"regime": ["regime"]}))


@query()
def pick_c(spark, d):
    return probe.pick_c(items(spark, d).drop("score", "pred"))


@query()
def svd_basis(spark, d):
    rows = items(spark, d).select(F.col("block").alias("control_block_id"), F.col("format").alias("cue_family"), F.lit("en").alias("language"), F.lit("-").alias("intended_purpose"), F.col("purpose").alias("lexical_cue"), "features")
    differences = matching.cue_differences(rows)
    basis = linalg.svd_basis(differences)
    return linalg.project_out(differences, basis, "difference").select("control_block_id", "cue_family", S.norm(F.col("difference")).alias("left_norm"))


@query()
def penalised_fit(spark, d):
    rows = items(spark, d)
    controls = rows.where("format = 'casual'").select(F.col("block").alias("control_block_id"), F.lit("f").alias("cue_family"), "language", F.lit("-").alias("intended_purpose"), F.col("purpose").alias("lexical_cue"), "features", "y")
    model = protocols.fit_penalised(rows.where("format = 'benchmark'"), controls, matching.cue_differences(controls), probe.Recipe(1.0, 4.0, (1.0,)), 0.1)
    return fits.score_batch(rows.drop("score", "pred"), [model], F.lit(0), tie=">=").select("vec_id", "y", "score", "pred")


@query()
def transfer_by_language(spark, d):
    return probe.transfer(items(spark, d).drop("score", "pred"), "language").withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query()
def direction_cosines(spark, d):
    rows = items(spark, d).drop("score", "pred")
    return probe.direction_cosines(rows, {"benchmark": F.col("format") == "benchmark", "casual": F.col("format") == "casual"}).withColumn("cosine", F.round("cosine", 3))


@query()
def random_direction_null(spark, d):
    both = items(spark, d).groupBy("block", "format").agg(F.first(F.when(F.col("purpose") == "evaluation", F.col("features")), True).alias("evaluation"), F.first(F.when(F.col("purpose") == "deployment", F.col("features")), True).alias("deployment"))
    return resample.random_direction_null(both.where("evaluation is not null and deployment is not null"), 200, 1)


@query()
def orientation_null(spark, d):
    rows = items(spark, d).withColumn("y", (F.col("purpose") == "evaluation").cast("int")).drop("score", "pred")
    return resample.orientation_null(rows, "block", 20)


#: Further names of queries.
SECOND_NAMES = {"render_whole_blocks": "render_blocks", "whole_block_completeness": "block_completeness", "reconstruct_whole_diff": "reconstruct_diff", "cluster_bootstrap_bacc_2000": "cluster_bootstrap_bacc", "cluster_bootstrap_auc_2000": "cluster_bootstrap_auc"}
for _name, _own in SECOND_NAMES.items():
    QUERIES[_name], SQL[_name] = QUERIES[_own], SQL[_own]

from . import probe_queries, set_queries, stream_queries  # noqa: E402, F401  (register further queries)
