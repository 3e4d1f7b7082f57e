"""Operator 1, packing: concatenate all documents and cut the stream into fixed windows.

Pass one tokenizes each document once and writes its ids with the document's place inside its partition. One
prefix sum over the partitions' token totals (a row for each task) then gives each document its place in the
whole stream. Pass two cuts documents at window boundaries; a document that lies over a boundary gives one
boundary record for each window it touches. No document moves between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import Written, slices, tidy


def _tokenizer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loomline.llm.tokens import token_ids

        part, at, tokenizer = TaskContext.get().partitionId(), 0, token_ids(path)
        for batch in batches:
            for rows in slices(batch, 1):
                ids, lengths = tokenizer.encode(rows.column(1), end_id)
                stops = np.cumsum(lengths)
                offsets = np.append(0, 4 * stops).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4", copy=False))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(lengths), part, np.int32)), pa.array(at + stops - lengths), pa.array(lengths), packed],
                    ["doc_id", "part", "part_start", "doc_tokens", "ids"],
                )
                at += int(stops[-1])

    return tidy(run)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Pass one: (doc_id, part, part_start, doc_tokens, ids) of documents; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _tokenizer(tokenizer_path, end_id), "doc_id long, part int, part_start long, doc_tokens long, ids binary"
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack documents (doc_id, text, more) into sequences of ``window`` tokens; one row for each piece.

    A document's tokens are its ids and then ``end_id``. All sequences are full but the last. Columns: doc_id,
    start (the document's tokens before the piece), length, ids (little-endian 32-bit), doc_tokens, sequence_id,
    offset. Null and empty texts give a piece of one token; repeated rows are packed each; other columns are
    ignored; an empty table gives no rows. The stream's order is the scan's, so sequence ids are gapless.
    """
    tokens = Written(token_table(docs, tokenizer_path, end_id), "tokens").df
    spark = docs.sparkSession
    # One row for each task of pass one: the driver already tracks those tasks one by one.
    totals = sorted(tokens.groupBy("part").agg(F.sum("doc_tokens")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    placed = tokens.join(base, "part").withColumn("first", F.col("base") + F.col("part_start"))
    cut = f"""transform(sequence(first div {window}, (first + doc_tokens - 1) div {window}), w -> named_struct(
        'sequence_id', w,
        'start', greatest(w * {window} - first, 0L),
        'length', least((w + 1) * {window} - first, doc_tokens) - greatest(w * {window} - first, 0L)))"""
    cut = f"""transform({cut}, p -> named_struct('sequence_id', p.sequence_id, 'start', p.start, 'length', p.length,
        'offset', first + p.start - p.sequence_id * {window},
        'ids', substring(ids, cast(4 * p.start + 1 as int), cast(4 * p.length as int))))"""
    return placed.select("doc_id", "doc_tokens", F.inline(F.expr(cut))).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
