"""Calls to a remote scorer with a cache of answers, and a scorer that survives a lack of memory."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.scorer import Scorer

ATTEMPTS = 3
#: What a call gives back and the cache holds.
ANSWER = "key string, status int, body string, attempts int, error string"

#: (payload, number of the attempt) -> (HTTP status, body); a lost connection raises OSError.
Send = Callable[[str, int], tuple[int, str]]


def call(send: Send, payload: str, pause: float = 1.0) -> tuple[int | None, str | None, int, str | None]:
    """(status, body, attempts, error) of one request.

    429 and 5xx are tried again, three times in all, after ``pause`` and twice that. A lost connection is not: the request
    may have been done and paid for.
    """
    for attempt in range(1, ATTEMPTS + 1):
        try:
            status, body = send(payload, attempt)
        except (OSError, ValueError):
            return None, None, attempt, "transport_error"
        if status == 200:
            return status, body, attempt, None
        again = status == 429 or 500 <= status <= 599
        if not again or attempt == ATTEMPTS:
            return status, None, attempt, "authentication" if status in (401, 403) else "http_error"
        time.sleep(pause * attempt)
    raise AssertionError("unreachable")


def call_remote(df: DataFrame, cache: DataFrame, send: Send, payload: str = "payload", pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with key, status, body, attempts, error and ``cache_hit``; new answers for the cache).

    Equal payloads are one call (their key is the SHA-256). Keys in the cache are not sent again. Within a task a refused
    authentication ends the calls: later rows get ``authentication`` with no attempt. The new answers are written to the
    shared folder before anything reads them, so that reading twice does not send twice; append those without error to
    the cache. A task that is lost before it is committed sends its requests again. A null payload is not sent: all its columns are null.
    """
    from loomline.sources.shared import written

    keyed = df.withColumn("key", F.sha2(payload, 256))
    todo = keyed.where(F.col("key").isNotNull()).join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first(payload).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused = False
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append((None, None, 0, "authentication") if refused else call(send, text, pause))
                refused = refused or rows[-1][3] == "authentication"
            status, body, attempts, error = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.int32()), pa.array(body, pa.string()), pa.array(attempts, pa.int32()), pa.array(error, pa.string())], ["key", "status", "body", "attempts", "error"])

    fresh = written(todo.mapInArrow(run, ANSWER), "answers")
    answers = fresh.withColumn("cache_hit", F.lit(False)).unionByName(cache.select("key", "status", "body", "attempts", "error").withColumn("cache_hit", F.lit(True)))
    return keyed.join(answers, "key", "left"), fresh


class Resilient:
    """A scorer that frees memory and tries a batch once more when memory runs out, then takes its rows one at a time.

    A row that fails alone gets an empty distribution.
    """

    def __init__(self, scorer: Scorer) -> None:
        self.scorer = scorer

    def __call__(self, states, instructions, options):
        for _ in range(2):
            try:
                return self.scorer(states, instructions, options)
            except MemoryError:
                gc.collect()
        out = []
        for row in zip(states, instructions, options, strict=True):
            try:
                out += self.scorer(*([x] for x in row))
            except MemoryError:
                out.append([])
        return out
