"""Evaluation of predictions: facts, grouped metrics, reliability, calibration, paired comparison, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import dists as D

R = 6


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), R)


def with_scores(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Add confidence, correct, nll, brier, spherical and uniform_nll to rows with arrays p and y."""
    P, Y = F.col(p), F.col(y)
    return df.withColumns({
        "confidence": F.array_max(P), "correct": D.correct(P, Y), "nll": D.nll(P, Y), "brier": D.brier(P, Y),
        "spherical": D.spherical(P, Y), "uniform_nll": F.ln(F.size(P).cast("double")),
    })


METRICS = ("correct", "nll", "brier", "spherical", "uniform_nll")


def metrics(scored: DataFrame, *by: str | Column) -> DataFrame:
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(rounded(F.avg(m)).alias("accuracy" if m == "correct" else m) for m in METRICS))


def metrics_by_sets(scored: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Grouped metrics for several groupings in one aggregation (GROUPING SETS); a column outside a set is null."""
    agg = [F.count(F.lit(1)).alias("n"), rounded(F.avg("correct")).alias("accuracy"), rounded(F.avg("nll")).alias("nll")]
    return scored.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*agg)


def reliability(scored: DataFrame, bin_of=D.bin_floor, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence for every bin; empty bins have n 0 and nulls."""
    made = scored.withColumn("bin", bin_of(F.col("confidence"), bins)).where("bin IS NOT NULL").groupBy("bin")
    made = made.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("a"), F.avg("confidence").alias("c"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(made, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.col("a")).alias("accuracy"), rounded(F.col("c")).alias("confidence"))


def calibration_error(scored: DataFrame, bin_of=D.bin_floor, bins: int = 10) -> DataFrame:
    """Sum of n_bin / n * |accuracy - confidence|; n counts rows outside all bins too."""
    by_bin = scored.groupBy(bin_of(F.col("confidence"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("a"), F.sum("confidence").alias("c"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("a") - F.col("c"))).otherwise(0.0))
    return by_bin.agg(F.sum("n").cast("long").alias("n"), rounded(gap / F.sum("n")).alias("ece"))


def selective_risk(scored: DataFrame, key: str, fractions=(0.25, 0.5, 0.75, 1.0), buckets: int = 4096) -> DataFrame:
    """For each coverage the risk of the max(1, ceil(n f)) most confident rows; ties by key.

    The cut is found by counts per confidence bucket; only the bucket that holds a cut is ranked, so no task sorts all rows.
    """
    b = F.floor((1 - F.col("confidence")) * buckets).cast("int")
    told = scored.select("confidence", "correct", F.col(key).alias("__key"), b.alias("__b"))
    sums = told.groupBy("__b").agg(F.count(F.lit(1)).alias("m"), F.sum("correct").alias("s"))
    run = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` + 1 rows
    sums = sums.withColumns({"before": F.coalesce(F.sum("m").over(run), F.lit(0)), "sbefore": F.coalesce(F.sum("s").over(run), F.lit(0.0))})
    n = sums.agg(F.sum("m").alias("n"))
    want = n.select(F.explode(F.array(*map(F.lit, fractions))).alias("coverage"), "n").withColumn("take", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("coverage"))))
    cut = sums.join(F.broadcast(want), (F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("m")))
    ranked = told.join(F.broadcast(cut.select("__b").distinct()), "__b").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(F.desc("confidence"), "__key")))
    inside = ranked.join(F.broadcast(cut), "__b").where(F.col("__r") <= F.col("take") - F.col("before"))
    out = inside.groupBy("coverage", "take", "sbefore").agg(F.sum("correct").alias("part"))
    return out.select("coverage", F.col("take").cast("long").alias("n"), rounded(1 - (F.col("sbefore") + F.col("part")) / F.col("take")).alias("risk"))


def nll_floors(df: DataFrame, floors=(1e-12, 1e-9, 1e-6, 1e-4, 1e-2), p: str = "p", y: str = "y") -> DataFrame:
    P, Y = F.col(p), F.col(y)
    aggs = [rounded(F.avg(D.nll(P, Y, f))).alias(f"nll_floor_{i}") for i, f in enumerate(floors)]
    literal = F.when(F.count_if(D.nll_literal(P, Y).isNull()) == 0, rounded(F.avg(D.nll_literal(P, Y))))
    return df.agg(*aggs, literal.alias("nll_literal"), F.max(D.nll_literal(P, Y).isNull()).alias("infinite"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Inner join of two runs on equal key sets; raises (at run time) if a key is missing or a ``same`` column differs."""
    x = a.select(*keys, F.struct(*[c for c in a.columns if c not in keys]).alias("a"))
    y = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias("b"))
    both = x.join(y, keys, "full_outer")
    bad = F.col("a").isNull() | F.col("b").isNull()
    for c in same:
        bad |= ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.where(F.when(bad, F.raise_error(F.lit("the two runs do not hold the same decisions")).cast("boolean")).otherwise(True))


def coverage(a: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For each named run: decisions in common, missing from it, and extra in it."""
    out = None
    for name, b in others.items():
        x, y = a.select(*keys, F.lit(1).alias("__a")), b.select(*keys, F.lit(1).alias("__b"))
        told = x.join(y, keys, "full_outer").agg(
            F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"), F.count_if(F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a").isNull()).alias("extra")
        ).select(F.lit(name).alias("run"), "common", "missing", "extra")
        out = told if out is None else out.unionByName(told)
    return out


def bootstrap(df: DataFrame, group: str, value: str, draws: int = 1000, seed: str = "17") -> DataFrame:
    """Cluster percentile bootstrap: estimate = sum / count over groups; 95 % interval over Poisson-weighted resamples.

    Groups are summed first; each group's weight in each draw is a Poisson(1) number hashed from (seed, draw, group),
    made inside one array expression, so the draws need no cross join. A draw in which no group has weight is left out.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    edges, acc, p = [], 0.0, math.exp(-1)
    for k in range(1, 9):
        acc += p
        p /= k
        edges.append(acc)

    def weight(i: Column) -> Column:
        u = (F.xxhash64(F.lit(seed), i, F.col(group)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
        return sum((F.when(u >= e, 1).otherwise(0) for e in edges[1:]), F.when(u >= edges[0], 1).otherwise(0))

    drawn = sums.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.struct(i.alias("draw"), weight(i).alias("w")))).alias("x"), "s", "n")
    per = drawn.groupBy("x.draw").agg(F.try_divide(F.sum(F.col("x.w") * F.col("s")), F.sum(F.col("x.w") * F.col("n"))).alias("m"))
    ci = per.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"))
    est = sums.agg((F.sum("s") / F.sum("n")).alias("estimate"), F.count(F.lit(1)).alias("groups"))
    return est.crossJoin(ci)


def fit_temperature(df: DataFrame, z: str = "z", y: str = "y", by: list[str] | None = None, rounds: int = 3, points: int = 33) -> DataFrame:
    """(by.., temperature, nll, nll_before): the temperature of least mean NLL, ln T in [-4.6, 4.6].

    Each round scores a grid of points around the best so far: every row gives an array of losses, which is exploded
    into a pre-aggregated mean per point, so a round is one small shuffle. T = 1 stays if no point beats it.
    """
    keys = by or ["__all"]
    Z, Y = F.col(z), F.col(y)
    told = (df if by else df.withColumn("__all", F.lit(0))).select(*keys, Z.alias("__z"), F.array_max(Z).alias("__m"), D.total(Y).alias("__ty"), D.dot(Z, Y).alias("__zy"))

    def loss(t: Column) -> Column:  # sum y * (logsumexp(z / T) - z / T)
        lse = F.col("__m") / t + F.ln(F.aggregate("__z", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("__m")) / t)))
        return F.col("__ty") * lse - F.col("__zy") / t

    told = told.withColumn("__c", F.lit(0.0))
    width, best = 4.6, None
    for _ in range(rounds):
        grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.least(F.greatest(F.col("__c") + F.lit(width) * (i * (2.0 / (points - 1)) - 1), F.lit(-4.6)), F.lit(4.6)))
        losses = F.transform(grid, lambda g: F.struct(g.alias("ln"), loss(F.exp(g)).alias("loss")))
        means = told.select(*keys, F.inline(F.concat(losses, F.array(F.struct(F.lit(None).cast("double").alias("ln"), loss(F.lit(1.0)).alias("loss")))))).groupBy(*keys, "ln").agg(F.avg("loss").alias("nll"))
        found = means.groupBy(*keys).agg(F.min(F.when(F.col("ln").isNotNull(), F.struct("nll", "ln"))).alias("b"), F.max(F.when(F.col("ln").isNull(), F.col("nll"))).alias("one"))
        best = found
        width = 2 * width / (points - 1)
        told = told.drop("__c").join(found.select(*keys, F.col("b.ln").alias("__c")), keys)
    return best.select(*(by or []), F.when(F.col("b.nll") < F.col("one"), F.exp("b.ln")).otherwise(1.0).alias("temperature"), F.least("b.nll", "one").alias("nll"), F.col("one").alias("nll_before"))


def percentile_trunc(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p n))] of a sorted array."""
    return F.element_at(values, F.least(F.size(values) - 1, F.floor(F.lit(p) * F.size(values)).cast("int")) + 1)


def percentile_nm1(values: Column, p: float) -> Column:
    """sorted[floor(p (n - 1))]."""
    return F.element_at(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int") + 1)
