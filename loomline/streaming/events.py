"""Streaming operators over an event table (event time ``ts``)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.shared import shared_path


def read_stream(spark: SparkSession, pattern: str, schema, files_per_trigger: int | None = 1000) -> DataFrame:
    """Files as a stream; ``None`` takes all that are there in one micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(pattern)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there (availableNow) in append mode and return the sink as a table."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums per window and key; a window is emitted when the watermark passes its end."""
    agg = stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return agg.select(F.col("window.start").alias("start"), *by, "n", "value")


def sliding(stream: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    agg = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    agg = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def distinct_events(stream: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of each key; the state of a key lives as long as the watermark allows duplicates."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def bucket_step(tokens: float, last: float | None, now: float, rate: float, burst: float) -> tuple[float, bool, float]:
    """(tokens left, allowed, seconds to wait) of a token bucket; time never runs backwards."""
    if last is not None:
        tokens = min(burst, tokens + max(0.0, now - last) * rate)
    if tokens >= 1:
        return tokens - 1, True, 0.0
    return tokens, False, (1 - tokens) / rate


def in_time_order(frames: Iterator, held_rows: int) -> Iterator[list[int]]:
    """[us, event_id] of all frames in order; beyond ``held_rows`` rows sorted runs lie in a temporary file and are merged."""
    import heapq
    import os
    import tempfile
    from contextlib import ExitStack

    import numpy as np

    def ordered(parts: list) -> np.ndarray:
        rows = np.concatenate(parts)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def read(start: int, n: int) -> Iterator[list[int]]:
        for i in range(start, start + n, 2048):
            block = os.pread(file.fileno(), 16 * min(2048, start + n - i), 16 * i)
            yield from np.frombuffer(block, np.int64).reshape(-1, 2).tolist()

    parts, n, runs, end, file = [], 0, [], 0, None
    with ExitStack() as stack:
        for frame in frames:
            parts.append(frame[["us", "event_id"]].to_numpy(np.int64))
            n += len(frame)
            if n >= held_rows:
                file = file or stack.enter_context(tempfile.TemporaryFile())
                file.write(ordered(parts).tobytes())
                file.flush()
                runs.append((end, n))
                parts, n, end = [], 0, end + n
        rest = ordered(parts) if parts else np.empty((0, 2), np.int64)
        yield from heapq.merge(*(read(*r) for r in runs), (row for i in range(0, n, 2048) for row in rest[i : i + 2048].tolist()))


def rate_limited(stream: DataFrame, by: str, rate: float, burst: float, late: str = "1 hour", ttl_ms: int = 86_400_000, held_rows: int = 1 << 20) -> DataFrame:
    """(by, event_id, allowed, wait) by a token bucket for each key; a key's state is dropped when the
    watermark is ``ttl_ms`` past its last event. (A processing-time timeout would keep an availableNow run alive for ever.)

    A key's events of one micro-batch come in several frames in any order; they are decided in order of time and id.
    """
    from itertools import islice

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        events = in_time_order(frames, held_rows)
        while some := list(islice(events, 10_000)):
            rows = []
            for us, event_id in some:
                now = us / 1e6
                tokens, allowed, wait = bucket_step(tokens, last, now, rate, burst)
                last = now if last is None else max(last, now)
                rows.append((key[0], event_id, allowed, wait))
            yield pd.DataFrame(rows, columns=[by, "event_id", "allowed", "wait"])
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + ttl_ms)

    kind = dict(stream.dtypes)[by]
    return stream.select(by, "event_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late).groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, event_id long, allowed boolean, wait double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout
    )
