"""Planning: grids of work items, ids, seeds, allocation, selection, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fill_template, hash_id, stable_seed, stripped


def request_grid(topics: DataFrame, per_topic: int, template: str, schema_json: str = "{}") -> DataFrame:
    """One request for each topic and sample number from 1, with its id and prompt."""
    n = topics.sparkSession.range(1, per_topic + 1).select(F.col("id").cast("int").alias("sample_number"))
    grid = topics.crossJoin(F.broadcast(n)).withColumn("payload_block_id", F.format_string("pb_%s_%02d", "topic_id", "sample_number"))
    user = fill_template(template, topic_display_name=F.col("display_name"), topic_id=F.col("topic_id"), task_family=F.col("task_family"), sample_number=F.col("sample_number").cast("string"))
    return grid.select(F.concat(F.lit("request::"), "payload_block_id").alias("request_id"), "payload_block_id", "topic_id", "task_family", "sample_number", stripped(user).alias("user"), F.lit(schema_json).alias("response_schema"))


def job_grid(topics: DataFrame, specs: DataFrame, languages: list[str], samples: int, regenerations: int, base_seed: int) -> DataFrame:
    """topic x spec x language x sample, and for each the attempts from 0 to regenerations with their seeds."""
    spark = topics.sparkSession
    langs = spark.createDataFrame([(x,) for x in languages], "language string")
    grid = topics.select("topic_id").crossJoin(specs.select("spec_id")).crossJoin(F.broadcast(langs)).crossJoin(F.broadcast(spark.range(samples).select(F.col("id").cast("int").alias("sample"))))
    key = [F.col(c) for c in ("topic_id", "spec_id", "language", "sample")]
    jobs = grid.withColumn("job_id", hash_id("job_", *key))
    return jobs.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(regenerations)))).withColumn("seed", stable_seed(base_seed, *key, F.col("attempt")))


def select_ids(df: DataFrame, column: str, ids: list[str] | None) -> DataFrame:
    """The rows of the ids (None: all); an id without a row is an error when the result is computed."""
    if ids is None:
        return df
    wanted = df.sparkSession.createDataFrame([(x,) for x in sorted(set(ids))], f"{column} string")
    unknown = wanted.join(df, column, "left_anti").agg(F.array_sort(F.collect_list(column)).alias("unknown"))
    checked = df.join(wanted, column, "left_semi").crossJoin(F.broadcast(unknown))
    return checked.where(F.when(F.size("unknown") > 0, F.raise_error(F.concat(F.lit("unknown ids: "), F.array_join("unknown", ", "))).cast("boolean")).otherwise(True)).drop("unknown")


def grid_diff(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: ``missing``, ``extra`` or ``duplicate`` cells."""
    a = actual.groupBy(keys).agg(F.count("*").alias("n"))
    e = expected.select(keys).distinct().withColumn("wanted", F.lit(True))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return a.join(e, keys, "full_outer").select(*keys, problem.alias("problem")).where("problem is not null")


def allocate_roles(df: DataFrame, topic: str = "topic_id", spec: str = "spec_id") -> DataFrame:
    """author and verifier by the parity of topic number plus spec number."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    even = (number(topic) + number(spec)) % 2 == 0
    return df.withColumn("author", F.when(even, "generator_a").otherwise("generator_b")).withColumn("verifier", F.when(even, "generator_b").otherwise("generator_a"))


def seed_collisions(attempts: DataFrame, job: str = "job_id") -> DataFrame:
    return attempts.groupBy(job).agg(F.count("*").alias("n_seeds"), F.count_distinct("seed").alias("n_distinct")).where("n_seeds <> n_distinct")


def interleave(df: DataFrame, sample: Column, order: list[Column], limit: int) -> DataFrame:
    """The first rows when sample 1 of every topic comes before sample 2 of any. limit is the feature."""
    return df.orderBy(sample, *order).limit(limit)


def balanced_take(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows that take turns over the values of ``by``. A row past the n-th of its value can't be among them, so each
    value's rows are cut there before they meet."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", by).limit(n)


def head_per_cell(df: DataFrame, cell: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("rank") <= k)


def grid_counts(df: DataFrame, dimensions: list[str], job: str = "job_id") -> DataFrame:
    """dimension, value, jobs, rows: over all, and by each value of each dimension, in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])
    return df.select(job, F.explode(pairs).alias("d")).groupBy("d.dimension", "d.value").agg(F.count_distinct(job).alias("jobs"), F.count("*").alias("rows"))


def compile_specs(containers: DataFrame, shared: list[str]) -> DataFrame:
    """spec_id, problem: not four containers, not two pairs, or containers that differ in a shared field."""
    agg = containers.groupBy("spec_id").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"), F.count_distinct(F.struct(*shared)).alias("kinds"))
    problem = F.when(F.col("n") != 4, "containers").when(F.col("pairs") != 2, "pairs").when(F.col("kinds") != 1, "shared fields")
    return agg.select("spec_id", problem.alias("problem")).where("problem is not null")


def shape_parity(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, differs: the fields that aren't the same in two localised tables; a row on one side only differs in all."""
    both = left.select(key, F.struct(*fields).alias("l")).join(right.select(key, F.struct(*fields).alias("r")), key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) | F.col("l").isNull() | F.col("r").isNull(), c) for c in fields]))
    return both.select(key, differs.alias("differs")).where(F.size("differs") > 0)


def cost_scenarios(jobs: DataFrame, prices: DataFrame, scenarios: dict[str, int]) -> DataFrame:
    """scenario, profile, calls, input_tokens, output_tokens, usd; profile null is the sum. jobs: profile, input_tokens,
    output_tokens; prices: profile, usd_per_input, usd_per_output; scenarios: attempts of each job."""
    table = jobs.sparkSession.createDataFrame(list(scenarios.items()), "scenario string, attempts int")
    used = jobs.groupBy("profile").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")).join(prices, "profile").crossJoin(F.broadcast(table))
    each = used.select("scenario", "profile", *[(F.col(c) * F.col("attempts")).alias(c) for c in ("n", "i", "o")], "usd_per_input", "usd_per_output")
    usd = F.sum(F.col("i").cast("decimal(20,0)") * F.col("usd_per_input").cast("decimal(18,12)") + F.col("o").cast("decimal(20,0)") * F.col("usd_per_output").cast("decimal(18,12)")).cast("decimal(38,12)")
    return each.groupingSets([["scenario", "profile"], ["scenario"]], "scenario", "profile").agg(F.sum("n").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), usd.alias("usd"))


def authorise(costs: DataFrame, limits: DataFrame) -> DataFrame:
    """scenario, usd, limit_usd, allowed for the scenario sums; a scenario without a limit isn't allowed."""
    sums = costs.where("profile is null").select("scenario", "usd")
    return sums.join(limits, "scenario", "left").withColumn("allowed", F.coalesce(F.col("usd") <= F.col("limit_usd"), F.lit(False)))


def observed_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """model, calls, input_tokens, output_tokens, usd from the records' usage; missing usage counts 0."""
    used = records.groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
    return used.join(prices, "model", "left").select("model", "calls", "input_tokens", "output_tokens", F.round(F.col("input_tokens") * F.col("usd_per_input") + F.col("output_tokens") * F.col("usd_per_output"), 4).alias("usd"))


def plan_cost(jobs: DataFrame, prices: DataFrame, attempts: int, budget_usd: float, basis: str = "all_attempts") -> DataFrame:
    """Cost of first attempts and of all attempts, and whether the chosen one is within the budget."""
    costs = cost_scenarios(jobs, prices, {"first_attempts": 1, "all_attempts": attempts}).where("profile is null")
    return costs.select("scenario", "calls", "input_tokens", "output_tokens", "usd", F.when(F.col("scenario") == basis, F.col("usd") <= F.lit(budget_usd)).alias("within_budget"))


def plan_uniqueness(**kinds: tuple[DataFrame, str]) -> DataFrame:
    """kind, value, n of planned names that occur more than once; kinds: kind=(table, column)."""
    parts = [df.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, (df, c) in kinds.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")


def pair_jobs(run_a: DataFrame, run_b: DataFrame, identity: list[str]) -> DataFrame:
    """author_job and verifier_job of each identity that both runs have, by the allocation of allocate_roles."""
    both = run_a.select(*identity, F.col("job_id").alias("a")).join(run_b.select(*identity, F.col("job_id").alias("b")), identity)
    own = F.col("author") == "generator_a"
    return allocate_roles(both).select(*identity, F.when(own, F.col("a")).otherwise(F.col("b")).alias("author_job"), F.when(own, F.col("b")).otherwise(F.col("a")).alias("verifier_job"))


def fill_requests(grid: DataFrame, scaffolding: DataFrame, keys: list[str], placeholders: list[str], body: str = "body") -> DataFrame:
    """The body of each row's scaffolding with ``<<NAME>>`` replaced by the column of that name; ``unresolved`` says
    whether some ``<<`` is left."""
    rows = grid.join(scaffolding, keys)
    text = reduce(lambda t, p: F.replace(t, F.lit(f"<<{p.upper()}>>"), F.coalesce(F.col(p).cast("string"), F.lit(""))), placeholders, F.col(body))
    return rows.withColumn("request_text", text).withColumn("unresolved", F.contains(F.col("request_text"), F.lit("<<")))


def global_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Rank from 0 in ascending order of a unique key, without a sort in one task: the key's range is cut into as many
    parts as there are shuffle partitions (approximate percentiles of a number that keeps the key's order), a row is
    ranked within its part, and the rows of the parts before are added. Text keys are told apart by the 7 bytes after
    the prefix that all of them share."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    code = F.col(key)
    if dict(df.dtypes)[key] == "string":
        low, high = df.agg(F.min(key), F.max(key)).first()
        shared = next((i for i, (a, b) in enumerate(zip(low or "", high or "", strict=False)) if a != b), min(len(low or ""), len(high or "")))
        code = F.conv(F.rpad(F.substring(F.hex(F.substr(F.col(key), F.lit(shared + 1))), 1, 14), 14, "0"), 16, 10).cast("long")
    coded = df.withColumn("_code", code)
    bounds = sorted(set(coded.agg(F.percentile_approx("_code", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    dealt = coded.withColumn("_part", F.size(F.filter(F.array(*[F.lit(b) for b in bounds] or [F.lit(0)]), lambda b: b <= F.col("_code"))))
    # one row for each part
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before", "_code")
