"""Model inference as a plug-in: a scorer sees batches of requests and gives probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    def __call__(self, states: list[str], instructions: list[str], options: list[list[str]]) -> list[list[float]]:
        """One distribution for each row, in option order."""


def uniform(states, instructions, options):
    return [[1.0 / len(o)] * len(o) for o in options]


def lexical(states, instructions, options):
    """Options that share words with the state score higher: 1 + shared words, normalised."""
    words = re.compile(r"[a-z0-9]+").findall
    out = []
    for state, opts in zip(states, options, strict=True):
        own = set(words(state.lower()))
        raw = [1.0 + len(own.intersection(words(o.lower()))) for o in opts]
        out.append([r / sum(raw) for r in raw])
    return out


def score(df: DataFrame, scorer: Scorer, state: str = "state", instructions: str = "instructions", options: str = "options") -> DataFrame:
    """Add ``probabilities``. Each distinct (state, instructions, options) is scored once; equal rows share the result."""
    key = F.sha2(F.to_json(F.struct(state, instructions, options)), 256)
    keyed = df.withColumn("__key", key)
    todo = keyed.groupBy("__key").agg(F.first(state).alias("s"), F.first(instructions).alias("i"), F.first(options).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scorer(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.list_(pa.float64()))], ["__key", "probabilities"])

    return keyed.join(todo.mapInArrow(run, "__key string, probabilities array<double>"), "__key").drop("__key")


def score_cached(df: DataFrame, cache: DataFrame, scorer: Scorer, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answers, new rows for the cache): keys in the cache (key, probabilities) are looked up, only the rest is scored."""
    known = df.join(cache, key)
    work = df.join(cache.select(key), key, "left_anti")
    fresh = score(work, scorer)
    return known.unionByName(fresh), fresh.select(key, "probabilities").distinct()
