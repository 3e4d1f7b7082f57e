"""Rules that decide among candidates, and what an edited menu does to a distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import dists as D
from loomline.operators.scoring import rounded

#: Levels of risk in their order.
RISKS = ("low", "medium", "high")
#: Fixed value: an option is interior if both distributions give it at least this much.
INTERIOR = 0.02


def best_within(candidates: Column, max_risk: Column, budget: Column, criteria: list[str]) -> Column:
    """The key of the candidate that meets both limits and is least by the criteria in their order; null if none or two are.

    Candidates are array<struct<key, risk, cost, criteria..>>. An unknown risk or a null cost is beyond the limits; null criteria come first.
    """
    level = lambda r: F.array_position(F.array(*map(F.lit, RISKS)), r)
    fine = F.filter(candidates, lambda c: (level(c["risk"]) > 0) & (level(c["risk"]) <= level(max_risk)) & (c["cost"] <= budget))
    ranked = F.array_sort(F.transform(fine, lambda c: F.struct(*(c[n].alias(n) for n in criteria), c["key"].alias("key"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    tied = F.lit(True)
    for n in criteria:
        tied = tied & first[n].eqNullSafe(second[n])
    return F.when(~((F.size(ranked) > 1) & tied), first["key"])


def same_person(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether every identity field that both records give agrees, letter case and signs other than letters and digits aside. At least one must be given by both."""
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))
    told = [plain(a[f]) == plain(b[f]) for f in fields]
    return F.greatest(*(t.isNotNull() for t in told)) & F.least(*(F.coalesce(t, F.lit(True)) for t in told))


def matching_candidate(probe: Column, candidates: Column, fields: list[str]) -> Column:
    """The number (from 1) of the first candidate that is the probe's person, 0 if none is."""
    hits = F.transform(candidates, lambda c: same_person(probe, c, fields))
    return F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")


def menu_residual(base: Column, variant: Column) -> Column:
    """struct<residual_rms, rank_reversal> of two distributions over the same retained options, null with fewer than three interior ones.

    The centred log-probabilities of the variant are fitted by a multiple of the base's; the residual is what is left.
    A base without spread has no multiple: its residual is NaN. Options with equal probabilities rank by position.
    """
    pairs = F.filter(F.zip_with(base, variant, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda x: (x["p"] >= INTERIOR) & (x["q"] >= INTERIOR))

    def centred(x: Column, name: str) -> Column:
        logs = F.transform(x, lambda v: F.ln(v[name]))
        return D.let(logs, lambda a: F.transform(a, lambda v: v - D.total(a) / F.size(a)))

    def order(a: Column) -> Column:
        return F.transform(F.array_sort(F.transform(a, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"])

    def of(b: Column, v: Column) -> Column:
        spread = D.dot(b, b)
        scale = F.when(spread > 0, D.dot(v, b) / spread).otherwise(F.lit(float("nan")))
        rms = D.let(scale, lambda s: F.sqrt(D.total(F.zip_with(b, v, lambda x, y: (y - s * x) * (y - s * x))) / F.size(b)))
        return F.struct(rms.alias("residual_rms"), (order(b) != order(v)).alias("rank_reversal"))

    both = D.let(pairs, lambda x: F.struct(F.size(x).alias("n"), centred(x, "p").alias("b"), centred(x, "q").alias("v")))
    return D.let(both, lambda s: F.when(s["n"] >= 3, of(s["b"], s["v"])))


def menu_edits(pairs: DataFrame, by: str, base: str = "base", variant: str = "variant") -> DataFrame:
    """By edit: pairs, those with a residual, its mean, rank reversals, mean total variation and flips of the best option."""
    told = pairs.select(by, menu_residual(F.col(base), F.col(variant)).alias("r"), D.total_variation(F.col(base), F.col(variant)).alias("tv"), (D.argmax(F.col(base)) != D.argmax(F.col(variant))).alias("flip"))
    return told.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count("r").alias("defined"), rounded(F.avg(F.nanvl("r.residual_rms", F.lit(None).cast("double")))).alias("residual_rms"),
        F.count_if("r.rank_reversal").alias("reversals"), rounded(F.avg("tv")).alias("tv"), F.count_if("flip").alias("flips"),
    )
