"""Ranks, order statistics and digests of whole groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.shared import broadcast_if_small, written

_PLACES = 33  # monotonically_increasing_id: the partition stands above these bits, the row's place below


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's number (from 1) in the order of columns, over all rows or inside each group ``by``.

    Rows are dealt into ranges of (by, order), sorted there and written once; prefix sums of the ranges' sizes and the
    first place of each group turn places into ranks. A group of any size is spread over as many tasks as it needs, but
    rows that are equal in all of (by, order) meet in one range: order by a unique column last. Nulls come first.
    """
    by = by or []
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("__part", F.shiftright("__at", _PLACES).cast("int")).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << _PLACES) - 1)))
    # One row for each task of the sort, which the driver tracks one by one as it is.
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, at = [], 0
    for part, n in sizes:
        bases.append((part, at))
        at += n
    bases = df.sparkSession.createDataFrame(bases, "__part int, __base long")
    told = placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at") + 1).drop("__part", "__base", "__at")
    if not by:
        return told
    first = written(told.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by))).agg(F.min(name).alias("__first")), "firsts")
    on = [told[c].eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    return told.join(broadcast_if_small(first, 64 * len(by)), on).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first", *(f"__g{i}" for i in range(len(by))))


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Column], buckets: int = 2048, small: int = 100_000) -> DataFrame:
    """(by, n, a column for each name): values at 0-based ranks, columns over n, of each group; nulls do not count.

    Each wanted rank keeps a range of values that holds it. A round counts the rows of each group in ``buckets`` equal parts
    of that range and goes on with the part that holds the rank, until it holds one value or at most ``small`` rows; only
    those are ordered. So every round is one partial aggregation, whatever the size or skew of a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("__k"), F.col(value).alias("__v"), F.col(value).cast("double").alias("__d"))
    group = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
    wanted = F.array(*(F.struct(F.lit(name).alias("__name"), r.cast("long").alias("__r")) for name, r in ranks.items()))
    now = written(group.select("__k", "n", "__lo", "__hi", F.inline(wanted)).withColumn("__m", F.col("n")), "statistics")
    inside = lambda now: rows.join(broadcast_if_small(now.withColumnRenamed("__k", "__g"), 96), F.col("__k").eqNullSafe(F.col("__g")) & (F.col("__d") >= F.col("__lo")) & (F.col("__d") <= F.col("__hi")))
    while not now.where((F.col("__lo") < F.col("__hi")) & (F.col("__m") > small)).isEmpty():
        part = F.when(F.col("__lo") == F.col("__hi"), 0).otherwise(F.least(F.floor((F.col("__d") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets - 1)))
        keys = ["__g", "__name", "n"]
        counts = inside(now).groupBy(*keys, "__r", part.alias("__b")).agg(F.count(F.lit(1)).alias("__m"), F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
        before = F.coalesce(F.sum("__m").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `buckets` rows
        counts = counts.withColumn("__before", before).where((F.col("__before") <= F.col("__r")) & (F.col("__r") < F.col("__before") + F.col("__m")))
        now = written(counts.select(F.col("__g").alias("__k"), "n", "__lo", "__hi", "__name", (F.col("__r") - F.col("__before")).alias("__r"), "__m"), "statistics")
    values = inside(now).groupBy("__g", "__name", "n", "__r", "__v").agg(F.count(F.lit(1)).alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy("__g", "__name").orderBy("__v"))  # at most `small` rows, or one value
    hit = values.withColumn("__upto", upto).where((F.col("__upto") - F.col("__m") <= F.col("__r")) & (F.col("__r") < F.col("__upto")))
    found = hit.groupBy("__g", "n").agg(*(F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))
    # A rank outside the group has no value; the group stays.
    every = written(group, "groups").select(F.col("__k").alias(by), "n")
    return every.join(found.drop("n"), F.col(by).eqNullSafe(F.col("__g")), "left").drop("__g")


def set_digest(df: DataFrame, by: str, hexes: str, digits: int = 4) -> DataFrame:
    """(by, digest): a digest of each group's set of hexadecimal hashes, whatever their order and repetitions.

    Hashes are dealt by their first ``digits`` digits; each deal's sorted hashes give a SHA-256, and these, in order, give
    the group's. So no row holds more than the 16**digits-th part of a group.
    """
    deals = df.select(by, F.col(hexes).alias("__h")).distinct().groupBy(by, F.substring("__h", 1, digits).alias("__deal"))
    parts = deals.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("__h")), "\n"), 256).alias("__part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__deal", "__part"))), lambda x: x["__part"]), "\n")
    return parts.groupBy(by).agg(F.sha2(whole, 256).alias("digest"))


def set_digest_sql(rows: str, by: str, hexes: str, digits: int = 4) -> str:
    """The same digest of a table expression in SQL."""
    return f"""SELECT {by}, sha256(string_agg(part, chr(10) ORDER BY deal)) AS digest FROM (
        SELECT {by}, substr({hexes}, 1, {digits}) AS deal, sha256(string_agg({hexes}, chr(10) ORDER BY {hexes})) AS part FROM (SELECT DISTINCT {by}, {hexes} FROM {rows}) GROUP BY 1, 2) GROUP BY {by}"""
