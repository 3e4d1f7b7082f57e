"""Operator 10, exact top-k search by the threshold algorithm over sorted per-dimension lists.

Rows and queries are dealt into blocks, one task for each pair of a row block and a query block. In a block of rows each
dimension has a list sorted by its component. A query reads its lists from the end that helps it, in growing
steps, scores the rows it meets in full, and stops when the sum of what stands at the current depth cannot beat its
kth score. The partial results are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import Written
from loomline.llm.forest import valid_vectors


def threshold_top_k(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, first_step: int = 8, together: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """(query's place, id, score) of the k best rows of each query without rows of its ``own`` id, and rows scored.

    x (ids ascending) and queries are integers. Ties go to the smaller id: a query stops only when the bound is below its
    kth score. Queries run ``together`` through the same depths; one that has stopped takes no further part.
    """
    n, dims = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, axis=0)
    low = np.empty_like(order)
    np.put_along_axis(low, order, np.arange(n)[:, None], axis=0)  # each row's place in each list, from the low end
    # Scores are whole numbers that a double holds exactly; a key is a score and, of equal ones, the earlier row.
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims < 2**52 / max(1, n)
    kind = np.float64 if exact else object
    rows, nothing = x.astype(kind), np.iinfo(np.int64).min if exact else -math.inf
    out, scored = [], 0
    for begin in range(0, len(queries), together):
        q, self_ids = queries[begin : begin + together], own[begin : begin + together]
        up, down, wide = (q > 0).astype(np.float32), (q < 0).astype(np.float32), q.astype(kind)
        best = np.full((len(q), k), nothing, np.int64 if exact else object)
        seen, active = np.zeros((len(q), n), bool), np.arange(len(q))
        depth, step = 0, first_step
        while len(active):
            to = min(n, depth + step)
            if to < n:
                met = up[active] @ (n - 1 - low < to).astype(np.float32).T + down[active] @ (low < to).astype(np.float32).T > 0
            else:
                met = np.ones((len(active), n), bool)
            new = met & ~seen[active] & (ids[None, :] != self_ids[active][:, None])
            seen[active] |= met
            scored += int(new.sum())
            at = np.flatnonzero(new.any(axis=0))
            if len(at):
                score = wide[active] @ rows[at].T
                keys = (score.astype(np.int64) if exact else score) * n + (n - 1 - at)
                keys[~new[:, at]] = nothing
                keys = np.concatenate([best[active], keys], axis=1)
                best[active] = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:] if exact else np.sort(keys, axis=1)[:, -k:]
            if to == n:
                break
            # No row that is not yet met scores more than this.
            edge = wide[active] * np.where(q[active] > 0, ranked[n - to], ranked[to - 1])
            bound, kth = edge.sum(axis=1), best[active].min(axis=1)
            active = active[(kth == nothing) | (bound >= kth // n)]
            if not len(active):
                break
            # Where most rows have been met, going deeper step by step costs more than scoring the rest.
            depth, step = to, 4 * step if 2 * seen[active].mean() < 1 else n
        for i, keys in enumerate(np.sort(best, axis=1)[:, ::-1]):
            out += [(begin + i, int(ids[n - 1 - int(key) % n]), int(key) // n) for key in keys if key != nothing]
    return out, scored


def _search(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids, is_query = group.column("id").to_numpy(), group.column("is_query").to_numpy().astype(bool)
        x = np.stack([np.asarray(v.values, np.int64) for v in group.column("vec")])
        q = np.flatnonzero(is_query)
        rows = np.flatnonzero(~is_query)
        if not len(q) or not len(rows):
            return out.empty_table()
        at = rows[np.argsort(ids[rows], kind="stable")]
        found, _ = threshold_top_k(x[at], ids[at], x[q], ids[q], k)
        return pa.table([[int(ids[q[f[0]]]) for f in found], [f[1] for f in found], [f[2] for f in found]], schema=out)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """The k best rows of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x) with x as double; the score is the integer inner product. Queries are the rows
    whose id is divisible by ``every``, candidates all rows with another id and a vector of the same length; ties go to the
    smaller id, and a query with fewer candidates returns them all. Vectors that are null, empty or hold null or
    non-finite components, and rows with a null id, take no part; a zero vector does. Equal repeated rows count once;
    an id with several vectors is a candidate (and a query) by its best score. Other columns are ignored.

    How many rows a query scores depends on the vectors: with few dimensions or uneven ones the bound stops it early; in many
    even dimensions no bound of this kind can, and all rows are scored. Results are exact either way.
    """
    fine = valid_vectors(vectors, id_col, vec_col, zero=True).select("id", F.transform("vec", lambda c: F.floor(c * scale)).alias("vec")).distinct()
    fine = Written(fine.withColumn("dim", F.size("vec")), "vectors").df
    counts = fine.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))
    at = F.xxhash64("id", "vec")
    rows = fine.select("id", "vec", "dim", F.lit(False).alias("is_query"), F.pmod(at, F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = fine.where(F.col("id") % every == 0)
    asked = asked.select("id", "vec", "dim", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(at, F.lit(query_blocks)).cast("int").alias("qb"))
    found = rows.unionByName(asked).groupBy("dim", "rb", "qb").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
