"""Append-only ledgers as streams: live progress and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import uses_generation, uses_semantic


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(file_format).load(path)


DELTAS = "{by} string, status string, delta long"


def status_changes(ledger: DataFrame, key: str = "job_id", by: str = "language", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """by, status, delta as events arrive: -1 for the status that a job had and +1 for the one it has now, so that sums of deltas are the
    jobs in each status at any time. The state is one row a job: its latest event's order (two numbers), by and status. Events of a job
    may come late or twice: only a later one than the latest changes its status."""

    def change(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        new = max((tuple(r) for pdf in batches for r in pdf[["_first", "_second", by, "status"]].itertuples(index=False)), default=None)
        if new is None or old is not None and new[:2] <= tuple(old[:2]):
            return
        state.update(new)
        out = [(new[2], new[3], 1)] + ([(old[2], old[3], -1)] if old is not None else [])
        if not (old is not None and tuple(old[2:]) == new[2:]):
            yield pd.DataFrame(out, columns=[by, "status", "delta"])

    rows = ledger.select(key, by, "status", F.col(order[0]).cast("long").alias("_first"), F.col(order[1]).cast("long").alias("_second"))
    return rows.groupBy(key).applyInPandasWithState(change, DELTAS.format(by=by), f"first long, second long, {by} string, status string", "append", GroupStateTimeout.NoTimeout)


def current_progress(deltas: DataFrame, by: str = "language") -> DataFrame:
    """by, status, jobs: what the deltas so far add up to."""
    return deltas.groupBy(by, "status").agg(F.sum("delta").alias("jobs")).where("jobs <> 0")


def progress_stream(ledger: DataFrame, path: str, checkpoint: str, key: str = "job_id", by: str = "language", order: tuple[str, str] = ("ts", "event_id"), available_now: bool = False) -> StreamingQuery:
    """Writes status changes to a Parquet table, of which current_progress() gives the counts. Only jobs with new events are touched in a
    batch; started again with its checkpoint, the stream goes on where it was."""
    writer = status_changes(ledger, key, by, order).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def attempts_once(ledger: DataFrame, path: str, checkpoint: str, delay: str, key: str = "payload_block_id", available_now: bool = False) -> StreamingQuery:
    """Writes the ledger (key, attempt, status, error, completed_at) to a Parquet table without attempts that are delivered again within the
    delay, also across a restart; budgets() counts them."""
    once = ledger.withWatermark("completed_at", delay).dropDuplicatesWithinWatermark([key, "attempt"])
    writer = once.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def budgets(attempts: DataFrame, key: str = "payload_block_id") -> DataFrame:
    """key, generation, semantic: attempts that count for each budget."""
    return attempts.groupBy(key).agg(F.count_if(uses_generation(F.col("status"), F.col("error"))).alias("generation"), F.count_if(uses_semantic(F.col("status"))).alias("semantic"))
