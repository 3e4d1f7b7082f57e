"""Shared helpers: tables written to the cluster's shared folder, size-checked broadcasts, hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:  # one JVM: its own temporary folder will do, and the session's settings stay as they are
        _local.append("file://" + tempfile.mkdtemp(prefix="loomline-"))
    return _local[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass


atexit.register(_delete_all)


class Written:
    """A table written to the shared folder, which cuts the lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/loomline-{uuid.uuid4().hex}/{name}"
        df.write.option("compression", "zstd").parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _written.remove((self.spark, self.path))
        delete(self.spark, self.path)


def quoted(name: str) -> Column:
    """The column of that very name, dots and signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns and all others as one column __rest, so that no name of an operator's own meets one of the input."""
    rest = [quoted(c) for c in df.columns if c not in own]
    return df.select(*own, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__rest"))


def unpacked(columns: list[str], own: list[str]) -> list[Column]:
    """The columns of a packed table, in their order and by their names."""
    return [F.col(c) if c in own else F.col("__rest").getField(c).alias(c) for c in columns]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and bytes of a string or binary column unless one row has more."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most_bytes, "right"))
        to = min(max(to, low + 1), low + most_rows, batch.num_rows)
        yield batch.slice(low, to - low)
        low = to


def give_back() -> None:
    """Return what this Python worker has freed to the system, so that idle workers hold only what they keep on purpose."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc alone has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow; at the end of each task the worker gives freed memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, extra=None) -> DataFrame:
    """``df`` with a broadcast hint if rows x row_bytes (+ the sum of ``extra``) fits ``limit``; else ``df``.

    Without the hint Spark takes a sort-merge join, whose skewed partitions adaptive execution splits.
    """
    more = F.coalesce(F.sum(extra), F.lit(0)) if extra is not None else F.lit(0)
    n, x = df.agg(F.count(F.lit(1)), more.cast("long")).first()
    return F.broadcast(df) if n * row_bytes + x <= limit else df.hint("merge")


def hashed_unit(seed: str, *cols):
    """A uniform number in [0, 1) from columns alone: the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
