"""Registered queries of streams and of sources that are files. The given tables are written to a shared folder in several files, and
read from there as a stream or by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import checks
from .queries import SQL, attempts, query, table
from .set_queries import _folder
from .sources import activations, tables
from .streaming import progress

FILES, FILES_A_BATCH = 6, 2


def _stream(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The rows as a stream of files, some of them a batch."""
    df.repartition(FILES, F.xxhash64(*df.columns)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path)


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1) SELECT CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language, status, count(*) AS jobs FROM l GROUP BY 1, 2""")
def progress_of_stream(spark, d):
    """Jobs in each status after a stream of changes in several batches, events out of order."""
    events = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("ja").alias("language"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    path = _folder(spark, "progress")
    ledger = _stream(spark, events, f"{path}/ledger")
    progress.progress_stream(ledger, f"{path}/changes", f"{path}/checkpoint", available_now=True).awaitTermination()
    return progress.current_progress(spark.read.parquet(f"{path}/changes"))


@query(SQL["ledger_counts"])
def budgets_of_stream(spark, d):
    """Budgets of a ledger of which half is delivered again after the stream has been stopped and started anew."""
    own = attempts(spark, d).select("user_id", F.col("event_id").alias("attempt"), "status", "error", F.col("ts").cast("timestamp").alias("completed_at"))
    path = _folder(spark, "budgets")
    for again in (own, own.where(F.xxhash64("attempt") % 2 == 0)):
        ledger = _stream(spark, again, f"{path}/ledger")
        progress.attempts_once(ledger, f"{path}/once", f"{path}/checkpoint", "4000 days", "user_id", available_now=True).awaitTermination()
    return progress.budgets(spark.read.parquet(f"{path}/once"), "user_id")


@query("SELECT 'n' || n_nationkey AS file_id, n_name AS name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def json_dir_of_nations(spark, d):
    """One file of one object a nation, read as a folder with the files' names."""
    path = _folder(spark, "nations")
    each = table(spark, d, "nation").join(table(spark, d, "customer"), F.expr("c_nationkey = n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("customers"))
    rows = each.select(F.concat(F.lit("n"), "n_nationkey").alias("file"), F.col("n_name").alias("name"), "customers")
    tables.write_json_dir(rows, "file", path)
    return tables.read_json_dir(spark, path, "name string, customers long").select("file_id", "name", "customers")


@query("""WITH x AS (SELECT vec_id, k AS layer, embedding[k * 16 + 1 : k * 16 + 16] AS v FROM embeddings, range(4) AS r(k)) SELECT vec_id::VARCHAR AS item_id, layer::INT AS layer, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM x WHERE layer >= 2""")
def activation_archives(spark, d):
    """Vectors written as archives of four layers and read in slices of the stored arrays, two layers only."""
    path = _folder(spark, "archives")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16)).alias("layers"))
    activations.write_archives(rows, path)
    got = tables.read_activations(spark, path, [2, 3], 100)
    return got.select("item_id", "layer", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("SELECT r_name AS family, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def catalog_of_families(spark, d):
    """Customers by a catalog of regions, checked for repeated keys and for its five families."""
    rows = [r.asDict() for r in table(spark, d, "region").select("r_regionkey", "r_name").collect()]
    catalog = tables.load_catalog(spark, rows, "r_regionkey long, r_name string", "r_regionkey", families=("r_name", {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}))
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(catalog, F.expr("n_regionkey = r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("family")).agg(F.count("*").alias("customers"))


_FRAMES = """SELECT p_partkey AS frame_id, 'en' AS language, concat('the ', p_brand, ' was ', replace(p_type, ' ', '_'), ' today') AS evaluation, concat('the ', replace(p_name, ' ', '_'), ' was ', CASE WHEN p_size % 2 = 0 THEN replace(p_type, ' ', '_') ELSE concat('of_', CAST(p_size AS VARCHAR(9))) END, ' today') AS deployment,
 CASE WHEN p_size % 3 = 0 THEN 'both' ELSE 'noun_only' END AS cue_locus, p_brand, replace(p_name, ' ', '_') AS name, replace(p_type, ' ', '_') AS type, p_size FROM part"""


@query(f"SELECT frame_id, CASE WHEN p_brand = name THEN '' ELSE p_brand || '>' || name END || CASE WHEN p_size % 2 = 0 THEN '' ELSE ';' || type || '>' || 'of_' || p_size END AS spans FROM ({_FRAMES})")
def differing_spans(spark, d):
    """Where two sentences of each part differ, in words."""
    table(spark, d, "part").createOrReplaceTempView("part")
    rows = spark.sql(_FRAMES)
    each = F.transform("s", lambda x: F.concat(x.left, F.lit(">"), x.right))
    return rows.select("frame_id", S.diff_spans("evaluation", "deployment", "language").alias("s")).select("frame_id", F.array_join(each, ";").alias("spans"))


@query(f"""WITH f AS ({_FRAMES}), s AS (SELECT frame_id, 'l' AS side, p_brand AS span FROM f UNION ALL SELECT frame_id, 'r', name FROM f UNION ALL SELECT frame_id, 'l', type FROM f WHERE p_size % 2 = 1 UNION ALL SELECT frame_id, 'r', 'of_' || p_size FROM f WHERE p_size % 2 = 1),
 n AS (SELECT frame_id, bool_or(c > 2) AS over, bool_or(c = 2) AS near FROM (SELECT *, count(*) OVER (PARTITION BY side, span) AS c FROM s) GROUP BY 1),
 r AS (SELECT frame_id, concat_ws(';', CASE WHEN cue_locus = 'both' AND p_size % 2 = 0 OR cue_locus <> 'both' AND p_size % 2 = 1 THEN 'locus' END, CASE WHEN over THEN 'span cap' END) AS problems, CASE WHEN near THEN 'span at the cap' ELSE '' END AS notes FROM f JOIN n USING (frame_id)) SELECT * FROM r WHERE problems <> '' OR notes <> ''""")
def variant_rules(spark, d):
    """Candidate frames whose spans contradict their locus or are used too often."""
    table(spark, d, "part").createOrReplaceTempView("part")
    return checks.variant_rules(spark.sql(_FRAMES)).withColumns({c: F.array_join(c, ";") for c in ("problems", "notes")})
