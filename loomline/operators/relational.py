"""Rules of the gold programs as relational plans: ranks, nearest values, as-of joins, pointer walks, folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.shared import broadcast_if_small, written


def kth(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The k-th row of each group; the first k are kept by a window group limit before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == k).drop("__r")


def nearest(df: DataFrame, by: str, value: str, key: str, reference: DataFrame, ref_value: str) -> DataFrame:
    """(by, key) of the row nearest to the group's reference value; a tie gives a null key."""
    ref = reference.select(F.col(by).alias("__g"), F.col(ref_value).alias("__v"), F.col(key).alias("__k"))
    told = df.join(ref, (F.col(by) == F.col("__g")) & (F.col(key) != F.col("__k")))
    per = told.groupBy(by, F.abs(F.col(value) - F.col("__v")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    best = per.groupBy(by).agg(F.min(F.struct("d", "n", "first")).alias("b"))
    return best.select(by, F.when(F.col("b.n") == 1, F.col("b.first")).alias(key))


def closest(left: DataFrame, right: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """``left``'s rows, each with ``closest``, its group's row of ``right`` with the smallest squared difference of ``value``.

    ``closest`` is (no, d, k): no difference, the difference, ``key``, and orders so. Differences are those of doubles;
    ties go to the smaller key, a NaN difference stands behind all others, a null one last.
    Only distinct values meet: on one line of a group's values each looks at the nearest of ``right`` below and above, as
    differences grow with distance. A group's line is sorted and read as a stream by one task. Where the next value
    beyond a neighbour gives the very same double, and for null, NaN and infinite values, all of the group's are tried.
    """
    kind = right.schema[key].dataType
    rows = left.select(by, F.col(value).cast("double").alias("__v"), F.lit(True).alias("__asked"), F.lit(None).cast(kind).alias("__k"))
    rows = rows.unionByName(right.select(by, F.col(value).cast("double").alias("__v"), F.lit(False).alias("__asked"), F.col(key).alias("__k")))
    line = rows.where(F.col(by).isNotNull()).groupBy(by, "__v").agg(F.max("__asked").alias("__asked"), F.min("__k").alias("__k"))
    line = line.withColumn("__plain", F.coalesce(F.abs("__v") < float("inf"), F.lit(False)))
    mark = F.col("__plain") & F.col("__k").isNotNull()
    for side, order in (("__below", F.col("__v").asc()), ("__above", F.col("__v").desc())):
        w = Window.partitionBy(by).orderBy(order)
        line = line.withColumn("__next", F.last(F.when(mark, F.col("__v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        point = F.when(mark, F.struct("__v", "__k", "__next"))
        line = line.withColumn(side, F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = written(line.drop("__next"), "line")

    off = lambda other: (F.col("__v") - other) * (F.col("__v") - other)
    rank = lambda other, k: F.struct(off(other).isNull().alias("no"), off(other).alias("d"), k.alias("k"))
    tied = F.lit(False)
    for side in ("__below", "__above"):
        tied = tied | F.coalesce(off(F.col(f"{side}.__next")) == off(F.col(f"{side}.__v")), F.lit(False))
    asked = line.where("__asked").withColumn("__all", tied | ~F.col("__plain"))
    near = asked.select(by, "__v", F.explode(F.array("__below", "__above")).alias("s")).where("s IS NOT NULL").select(by, "__v", rank(F.col("s.__v"), F.col("s.__k")).alias("__best"))
    told = line.where(F.col("__k").isNotNull()).select(F.col(by).alias("__g"), F.col("__v").alias("__o"), "__k", "__plain")
    pairs = lambda a, b: a.select(by, "__v").join(b, F.col(by) == F.col("__g")).select(by, "__v", rank(F.col("__o"), F.col("__k")).alias("__best"))
    every = near.unionByName(pairs(asked.where("__all"), told)).unionByName(pairs(asked.where("NOT __all"), told.where("NOT __plain")))
    best = every.groupBy(F.col(by).alias("__g"), "__v").agg(F.min("__best").alias("closest"))
    best = broadcast_if_small(written(best, "closest"), 48)
    return left.join(best, (F.col(by) == F.col("__g")) & F.col(value).cast("double").eqNullSafe(F.col("__v"))).select(*left.columns, "closest")


def shown_matches(left: DataFrame, right: DataFrame, on: list[str], value: str, key: str) -> DataFrame:
    """``left``'s rows with ``first`` and ``matches``, the smallest ``key`` and the number of ``right``'s rows that match.

    Rows match if they are equal in all of ``on`` and, where both show a ``value`` (not null), in that too. Rows without a
    match are left out. Only counts of ``right`` by (on, value) meet the rows of ``left``.
    """
    per = written(right.groupBy(*on, value).agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")), "shown")
    hides = F.col(value).isNull()
    groups = per.groupBy(*on).agg(F.min("__first").alias("__all_first"), F.sum("__n").alias("__all"), F.min(F.when(hides, F.col("__first"))).alias("__hidden_first"), F.coalesce(F.sum(F.when(hides, F.col("__n"))), F.lit(0)).alias("__hidden"))
    told = left.join(broadcast_if_small(groups, 128), on).join(broadcast_if_small(per.where(~hides), 128), [*on, value], "left")
    first = F.when(hides, F.col("__all_first")).otherwise(F.least("__first", "__hidden_first"))
    n = F.when(hides, F.col("__all")).otherwise(F.coalesce("__n", F.lit(0)) + F.col("__hidden"))
    return told.select(*(F.col(c) for c in left.columns), first.alias("first"), n.alias("matches")).where("matches > 0")


def lexicographic(df: DataFrame, by: str, constraint: Column, order: list[Column], key: str) -> DataFrame:
    """(by, key) of the best row that meets the constraint, by ordered priorities; a full tie gives a null key."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    per = df.where(constraint).groupBy(by, rank.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    best = per.groupBy(by).agg(F.min(F.struct("o", "n", "first")).alias("b"))
    return best.select(by, F.when(F.col("b.n") == 1, F.col("b.first")).alias(key))


def as_of(facts: DataFrame, at: Column, rates: DataFrame, effective: str, columns: list[str]) -> DataFrame:
    """The last rate effective at or before each fact's date, by one equi-join on the date; of equal dates any one.

    Only distinct dates meet the rates: on one line of dates, which the calendar bounds, each takes the last rate before it.
    """
    rate = F.struct(effective, *columns)
    line = facts.select(at.cast("date").alias("__at")).where("__at IS NOT NULL").distinct().withColumn("__rate", F.lit(None).cast(rates.select(rate.alias("r")).schema["r"].dataType))
    line = line.unionByName(rates.groupBy(F.col(effective).cast("date").alias("__at")).agg(F.max(rate).alias("__rate")))
    told = line.groupBy("__at").agg(F.max("__rate").alias("__rate")).withColumn("__rate", F.last("__rate", ignorenulls=True).over(Window.orderBy("__at")))
    told = broadcast_if_small(written(told, "dates"), 64)
    return facts.join(told, at.cast("date") == F.col("__at"), "left").select(*facts.columns, "__rate.*")


def walk(df: DataFrame, key: str, pointer: str, hops: int) -> DataFrame:
    """Follow pointers at most ``hops`` times: (key, final, hops). One equi-join a hop; ended rows ride along."""
    edges = df.select(F.col(key).alias("__from"), F.col(pointer).alias("__to")).where("__to IS NOT NULL")
    out = df.select(key, F.col(key).alias("final"), F.lit(0).alias("hops"))
    for _ in range(hops):
        out = out.join(edges, F.col("final") == F.col("__from"), "left").select(key, F.coalesce("__to", "final").alias("final"), (F.col("hops") + F.col("__to").isNotNull().cast("int")).alias("hops"))
    return out


def fold_by(df: DataFrame, by: str, order: list[str], step, schema: str, start) -> DataFrame:
    """A sequential fold over each key's ordered rows, streamed: ``step(state, row) -> (state, output tuple)``.

    Rows are dealt and sorted by key, and read as a stream of batches, so a key with very many rows is never held
    in memory. One key's fold is sequential by definition.
    """
    from pyspark.sql import types as T

    fields = [f for f in T._parse_datatype_string(schema).fields]  # noqa: SLF001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[by] != key:
                    key, state = row[by], start()
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist([dict(zip([f.name for f in fields], m, strict=True)) for m in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))
    return df.repartition(F.col(by)).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def posterior(df: DataFrame, cause: str, evidence: list[str]) -> DataFrame:
    """P(cause | evidence) by relative frequency: (evidence.., cause, n, p)."""
    n = df.groupBy(*evidence, cause).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*evidence)), 6))


def naive_bayes(df: DataFrame, cause: str, features: list[str]) -> DataFrame:
    """Posterior over causes for every combination of boolean features: prior times likelihoods, normalised."""
    stats = df.groupBy(cause).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f).cast("int")).alias(f"p_{f}") for f in features))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    combos = df.sparkSession.range(1 << len(features)).select(*((F.shiftright("id", i) % 2 == 1).alias(f) for i, f in enumerate(features)))
    like = F.col("n") / F.col("total")
    for f in features:
        like = like * F.when(F.col(f), F.col(f"p_{f}")).otherwise(1 - F.col(f"p_{f}"))
    joint = stats.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(combos)).withColumn("j", like)  # causes x combinations: both small
    return joint.select(*features, cause, F.round(F.col("j") / F.sum("j").over(Window.partitionBy(*features)), 6).alias("p"))


def reachable(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(node, distance) by breadth-first rounds over an edge table (a, b), until a round finds nothing new.

    Each round joins only the last frontier and writes the next one to the shared folder, which cuts the lineage.
    """
    from loomline.sources.shared import shared_path

    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "reachable")
    read = lambda: spark.read.schema(f"node {sources.schema['node'].dataType.simpleString()}, distance int").parquet(path)
    sources.select("node").distinct().write.parquet(f"{path}/distance=0")
    for d in range(1, max_hops + 1):
        new = read().where(F.col("distance") == d - 1).join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new.join(read().select("node"), "node", "left_anti").write.parquet(f"{path}/distance={d}")
        if read().where(F.col("distance") == d).isEmpty():
            break
    return read()
