"""Rollout streams: bounded queues, count-triggered batches, staleness, replay buffers and token buckets.

The rules are given on tables (so they can be checked in SQL) and as Structured Streaming where they need state. Order
is the sequence number's. What depends on order is folded over sorted partitions row by row, with a state of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from millrace.operators.grouped import streamed_rows


def stream_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; ``files_per_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder and return the folder's rows."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> DataFrame:
    """Run a stream of updated aggregates over what is there now: each trigger's updates become a folder of their own, and
    the largest ``order`` of a key is its last state."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(path)
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def count_batches(rows: DataFrame, size: int, row_idx: str = "row_idx", total: int | None = None) -> DataFrame:
    """``batch`` of each row by count; the last, partial batch is dropped once ``total`` is known."""
    out = rows.withColumn("batch", F.floor(F.col(row_idx) / size))
    return out if total is None else out.where(F.col("batch") < total // size)


def count_batches_stream(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch, rows, first_seq, last_seq) of complete count-triggered batches per key, kept across triggers in state."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, n, first, last = state.get if state.exists else (0, 0, -1, -1)
        out = []
        for seq in sorted(s for pdf in pdfs for s in pdf["seq"]):
            first, n, last = (seq if n == 0 else first), n + 1, seq
            if n == size:
                out.append((k[0], batch, n, first, last))
                batch, n, first, last = batch + 1, 0, -1, -1
        state.update((batch, n, first, last))
        yield pd.DataFrame(out, columns=[key, "batch", "rows", "first_seq", "last_seq"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, "seq").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, batch long, rows long, first_seq long, last_seq long", "batch long, n long, first long, last long", "append", GroupStateTimeout.NoTimeout
    )


def bounded_queue(events: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """(queue, produced, consumed, dropped, left) of put and get events; a put into a full queue drops its oldest row.

    A queue's events stream past in order; its length and counts are all that is remembered.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        produced = got = dropped = held = 0
        for name, _, put in rows:
            if put:
                produced, dropped, held = produced + 1, dropped + (held == capacity), min(held + 1, capacity)
            else:
                got, held = got + (held > 0), max(held - 1, 0)
        yield name, produced, got, dropped, held

    plain = events.select(queue, order, (F.col("op") == "put").alias("put"))
    return streamed_rows(plain, queue, order, run, f"{queue} {dict(events.dtypes)[queue]}, produced long, consumed long, dropped long, left long")


def newest(rows: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """What a queue that only received holds: its last ``capacity`` rows. A cut by the count of later rows is a rank."""
    w = Window.partitionBy(queue).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def staleness_budget(required: int, threshold: float, sync_every: int) -> int:
    """Most samples of older versions that may be under way: required x (threshold + 1) x steps between syncs."""
    return int(required * (threshold + 1) * sync_every)


def must_pause(queued: Column, capacity: int, stale: Column, budget: int) -> Column:
    return (queued >= capacity) | (stale >= budget)


def stale_counts(rows: DataFrame, version: str, active: str, queued: str) -> DataFrame:
    """(version, stale): what is active or queued when a version begins counts as stale then."""
    return rows.groupBy(version).agg((F.sum(F.col(active).cast("long")) + F.sum(F.col(queued).cast("long"))).alias("stale"))


def replay_buffer(tags: DataFrame, step: int | None) -> DataFrame:
    """Keys (partition, key, global_steps, status) ready at a step: the last tag a key wins, and a partition is ready when
    none of its keys at the step is still running; successful keys are returned. A null step matches keys without one."""
    last = tags.groupBy("partition", "key").agg(F.max_by(F.struct("global_steps", "status"), "seq").alias("t")).select("partition", "key", "t.*")
    here = last.where(F.col("global_steps").eqNullSafe(F.lit(step).cast("long")))
    ready = here.groupBy("partition").agg(F.bool_and(F.col("status") != "running").alias("ready")).where("ready")
    return here.where("status = 'success'").join(ready.select("partition"), "partition", "left_semi")


def windowed_metrics(stream: DataFrame, width: str, late: str) -> DataFrame:
    """An extension: event-time tumbling windows with a watermark, (start, event_type, n, total)."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def token_bucket(requests: DataFrame, key: str, order: str, at: str, cost: str, rate: float, capacity: float) -> DataFrame:
    """(key, order, wait): seconds each request waits. The bucket refills up to ``capacity``; a request larger than it
    drives it below 0. A key's requests stream past in order."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        level, last = capacity, None
        for name, number, now, asked in rows:
            last = now if last is None else last
            level = min(capacity, level + max(now - last, 0.0) * rate)
            yield name, number, max(min(asked, capacity) - level, 0.0) / rate
            level, last = level - asked, max(now, last)

    plain = requests.select(key, order, F.col(at).cast("double").alias("at"), F.col(cost).cast("double").alias("cost"))
    return streamed_rows(plain, key, order, run, f"{key} {dict(requests.dtypes)[key]}, {order} {dict(requests.dtypes)[order]}, wait double")
