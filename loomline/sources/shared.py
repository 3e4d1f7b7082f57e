"""A folder that all executors see, for tables and stream state of one run; what is written there is deleted at the end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 16 << 20

_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:  # one JVM: its own temporary folder will do, and the session's settings stay as they are
        _local.append("file://" + tempfile.mkdtemp(prefix="loomline-"))
    return _local[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path; it is deleted when the process ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts the lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, extra=None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if rows x row_bytes (+ the sum of ``extra``) fits; else a hint for a sort-merge join."""
    more = F.coalesce(F.sum(extra), F.lit(0)).cast("long") if extra is not None else F.lit(0)
    n, x = df.agg(F.count(F.lit(1)), more).first()
    return F.broadcast(df) if n * row_bytes + x <= limit else df.hint("merge")


def _delete_all() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:  # noqa: SLF001
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass


atexit.register(_delete_all)
