"""Incremental jobs: traces that are appended once, and runs folded from events as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..common import remove
from ..operators.traces import append_missing
from ..schemas import TRACES

BUCKETS = 256


def read_trace_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRACES).json(path)


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a folder, or nothing while there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append rows whose key the target does not hold; no state bounds the time between repeated rows.

    Keys have a table of their own in the target (a folder that readers pass over), in buckets of their
    hash; a batch reads only the buckets that it has keys of. A batch that is repeated writes its own
    folders again and does not see the keys that it left before.
    """
    keys = f"{target}/_keys"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        try:
            done = _present(spark, keys)
            if done is not None:
                touched = [r.bucket for r in df.select("bucket").distinct().collect()]  # BUCKETS at most
                done = done.filter((F.col("batch") < number) & F.col("bucket").isin(touched))
                df = append_missing(df, done, key)
            df.drop("bucket").write.mode("overwrite").parquet(f"{target}/batch={number}")
            df.select(key, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- runs, without state: partial folds that merge --------------------------------------------------------------------


def fold_runs(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs folded as their events (run_id, seq, type, name, tokens_in, tokens_out, model) arrive.

    Every batch leaves its own partial fold in ``target``, with event numbers beside the calls so that
    late ones fall in place; ``folded`` merges them, ``compact`` makes one of all so far. No state is
    held, so a run may take any time; a batch that is repeated overwrites its own folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.groupBy("run_id").agg(*partial_fold())
        new.write.mode("overwrite").parquet(f"{target}/folds/kind=batch/number={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_fold() -> list:
    """Aggregates of events that can be merged: sums, and calls and models with their event numbers."""
    call = F.when(F.col("type") == "tool_call", F.struct("seq", "name"))
    named = F.when(F.col("model").isNotNull(), F.struct("seq", "model"))
    return [
        F.count_if(F.col("type") == "iteration_start").alias("iterations"), F.collect_list(call).alias("calls"), F.bool_or(F.col("type") == "max_iterations").alias("ran_out"),
        F.bool_or(F.col("type") == "final_text").alias("ended"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.min(named).alias("first_model"),
    ]


def _merged() -> list:
    sums = [F.sum(c).alias(c) for c in ("iterations", "tokens_in", "tokens_out")]
    return [*sums, F.flatten(F.collect_list("calls")).alias("calls"), F.bool_or("ran_out").alias("ran_out"), F.bool_or("ended").alias("ended"), F.min("first_model").alias("first_model")]


def _partials(spark: SparkSession, target: str) -> tuple[DataFrame, int]:
    """Partial folds that count: the last base that was committed, and the batches after it."""
    commits = _present(spark, f"{target}/commits")
    base = commits.agg(F.max("number")).first()[0] if commits is not None else -1
    rows = spark.read.parquet(f"{target}/folds")
    counts = ((F.col("kind") == "base") & (F.col("number") == base)) | ((F.col("kind") == "batch") & (F.col("number") > base))
    return rows.filter(counts), base


def compact(spark: SparkSession, target: str) -> int:
    """Merge all partial folds so far into one base; returns the number of its last batch.

    The base counts once its number is committed, so a compaction that fails changes nothing; folders that
    no longer count are removed after that.
    """
    rows, before = _partials(spark, target)
    numbers = [r.number for r in rows.filter("kind = 'batch'").select("number").distinct().collect()]  # one a batch since the last time
    if not numbers:
        return before
    last = max(numbers)
    rows.groupBy("run_id").agg(*_merged()).write.mode("overwrite").parquet(f"{target}/folds/kind=base/number={last}")
    spark.createDataFrame([(last,)], "number long").write.mode("append").parquet(f"{target}/commits")
    for name in [f"kind=batch/number={n}" for n in numbers] + ([f"kind=base/number={before}"] if before >= 0 else []):
        remove(spark, f"{target}/folds/{name}")
    return last


def folded(spark: SparkSession, target: str) -> DataFrame:
    """(run_id, iterations, tool_calls, stop_reason, tokens_in, tokens_out, model) of all runs so far."""
    rows = _partials(spark, target)[0].groupBy("run_id").agg(*_merged())
    stop = F.when(F.col("ran_out"), "max_iterations").when(F.col("ended"), "stop")
    calls = F.transform(F.array_sort("calls"), lambda c: c["name"])
    return rows.select("run_id", "iterations", calls.alias("tool_calls"), stop.alias("stop_reason"), "tokens_in", "tokens_out", F.col("first_model.model").alias("model"))


# --- runs, with state: each one goes out when it has ended ------------------------------------------------------------

RUNS = "run_id string, iterations long, tool_calls array<string>, stop_reason string, tokens_in long, tokens_out long, model string"
_EVENT = "seq long, type string, name string, tokens_in long, tokens_out long, model string"
_END = {"max_iterations": "max_iterations", "final_text": "stop"}


class _Run(StatefulProcessor):
    """State of a run: its events with their numbers, by which repeated ones count once. A timer ends it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)
        self.due = handle.getValueState("due", "at long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, ended = self.due.get() if self.due.exists() else (0, False)
        before = due
        for part in rows:
            part = part[["seq", "type", "name", "tokens_in", "tokens_out", "model", "ms"]].astype(object).where(part.notna(), None)
            new = []
            for seq, kind, name, tokens_in, tokens_out, model, when in part.itertuples(index=False):
                whole = (None if v is None else int(v) for v in (tokens_in, tokens_out))
                new.append((int(seq), kind, name, *whole, model))
                if kind in _END:  # events that are not later than the end may still come until the watermark is there
                    due, ended = (max(due, int(when)) if ended else int(when)), True
                elif not ended:
                    due = max(due, int(when) + self.idle_ms)
            self.events.appendList(new)
        if due != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due, ended))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = sorted({seq: event for seq, *event in map(tuple, self.events.get())}.items())
        kinds = [e[0] for _, e in events]
        total = lambda k: sum(e[k] for _, e in events if e[k] is not None) if any(e[k] is not None for _, e in events) else None
        row = {
            "run_id": key[0], "iterations": kinds.count("iteration_start"), "tool_calls": [e[1] for _, e in events if e[0] == "tool_call"],
            "stop_reason": next((v for k, v in _END.items() if k in kinds), None), "tokens_in": total(2), "tokens_out": total(3),
            "model": next((e[4] for _, e in events if e[4] is not None), None),
        }
        self.events.clear()
        self.due.clear()
        out = pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in row.items()})
        yield out

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and map states need, for queries that start inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def emit_runs(stream: DataFrame, target: str, checkpoint: str, late: str = "10 minutes", idle_ms: int = 3_600_000) -> StreamingQuery:
    """Append each run to ``target`` once, when it has ended: the columns of ``folded``.

    Events have an ``at`` timestamp beside what ``fold_runs`` takes, and may come out of order and again
    until the watermark, ``late`` behind the newest event, passes the run's end. A run without an end goes
    out, with no stop reason, when nothing came for ``idle_ms`` of event time. Only open runs have state.
    """
    spark = stream.sparkSession
    events = stream.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    runs = events.groupBy("run_id").transformWithStateInPandas(_Run(idle_ms), RUNS, "Append", "EventTime")
    with _rocksdb(spark):
        return runs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
