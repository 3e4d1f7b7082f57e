"""Operator 7, mixing sources to target weights by iterative proportional fitting.

One aggregation gives the tokens of every (source, language, topic) cell. Raking scales the cells until their sums
meet each target marginal; the raked weights become probabilities that are calibrated to the token budget, and
documents are sampled by a hash of their id.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BROADCAST_BYTES, Written, hashed_unit, packed, quoted, unpacked

#: Cells are raked on the driver up to this number, and in a written table beyond it.
DRIVER_CELLS = 100_000
MARGINS = ("__source", "__lang", "__topic")
#: Raking stops after this many rounds, or when no factor of a round differs from 1 by more.
ROUNDS, TOLERANCE = 200, 1e-10
NO_CATEGORY = "the target shares name no category of the table"


def default_topic(text: Column) -> Column:
    """A coarse topic by the first rule that fits: licensing, contact, tabular, code, prose."""
    low = F.lower(text)
    return (
        F.when(low.contains("licens"), "licensing")
        .when(text.contains("@") | low.contains("http"), "contact")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("{") | text.contains(" = "), "code")
        .otherwise("prose")
    )


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Default target shares: the present shares raised to a power below 1, which lifts small categories."""
    raised = {k: max(v, 0.0) ** power if v > 0 else 0.0 for k, v in totals.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights with the marginal shares ``targets``; margins give each cell's category number, by dimension."""
    worst = 0.0
    mass = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(margins, targets, strict=True):
            now = np.bincount(at, mass, len(target)).astype(float)
            factor = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, np.abs(factor - 1).max(initial=0.0))
            mass = mass * factor[at]
        if worst < tolerance:
            return mass
    _missed(rounds, worst)
    return mass


def _missed(rounds: int, worst: float) -> None:
    warnings.warn(f"raking has not converged in {rounds} rounds: a factor still differs from 1 by {worst:.3g}, so target shares are missed", RuntimeWarning, stacklevel=3)


def calibrate(tokens: np.ndarray, ratio: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * ratio), with s such that the expected tokens are ``budget`` (or all there are)."""
    if budget >= tokens[ratio > 0].sum():
        return (ratio > 0).astype(float)
    low, high = 0.0, 1.0
    while (np.minimum(1, high * ratio) * tokens).sum() < budget:
        high *= 2
    for _ in range(200):
        s = (low + high) / 2
        if s in (low, high):
            break
        low, high = (s, high) if (np.minimum(1, s * ratio) * tokens).sum() < budget else (low, s)
    return np.minimum(1, high * ratio)


def _targets(totals: Mapping[str, float], given: Mapping[str, float] | None, power: float) -> dict[str, float]:
    if given is None:
        return tempered(totals, power)
    there = {k: float(given.get(k, 0.0)) for k in totals}
    total = sum(there.values())
    if total <= 0:
        raise ValueError(NO_CATEGORY)
    return {k: v / total for k, v in there.items()}


def _rake_on_driver(cells: list, given: list, powers: list, keep: float) -> list[tuple]:
    tokens = np.array([float(r["__tokens"]) for r in cells])
    margins, targets = [], []
    for name, g, power in zip(MARGINS, given, powers, strict=True):
        totals: dict[str, float] = {}
        for r, t in zip(cells, tokens, strict=True):
            totals[r[name]] = totals.get(r[name], 0.0) + t
        names, share = sorted(totals), _targets(totals, g, power)
        margins.append(np.array([names.index(r[name]) for r in cells] if len(names) < 50 else [{n: i for i, n in enumerate(names)}[r[name]] for r in cells], int))
        targets.append(np.array([share[n] for n in names]))
    weight = np.divide(rake(tokens, margins, targets) * tokens.sum(), tokens, out=np.zeros_like(tokens), where=tokens > 0)
    p = calibrate(tokens, weight, keep * tokens.sum())
    return [(*(r[n] for n in MARGINS), float(w), float(q)) for r, w, q in zip(cells, weight, p, strict=True)]


def _rake_in_tables(cells: DataFrame, given: list, powers: list, keep: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same raking, by the same rule, on a table of cells too large for the driver; factors are joined back."""
    total = cells.agg(F.sum("__tokens")).first()[0] or 1.0
    now = Written(cells.withColumn("__mass", F.col("__tokens") / total), "mass")
    shares = []
    for name, g, power in zip(MARGINS, given, powers, strict=True):
        sums = cells.groupBy(name).agg(F.sum("__tokens").alias("__t"))
        if g is None:
            sums = sums.withColumn("__t", F.when(F.col("__t") > 0, F.pow("__t", F.lit(power))).otherwise(0.0))
        else:
            named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in g.items()], f"{name} string, __g double")
            sums = sums.join(named, name, "left").select(name, F.coalesce("__g", F.lit(0.0)).alias("__t"))
        sums = Written(sums, "shares").df
        whole = sums.agg(F.sum("__t")).first()[0] or 0.0
        if g is not None and whole <= 0:
            raise ValueError(NO_CATEGORY)
        shares.append(sums.select(name, (F.col("__t") / (whole or 1.0)).alias("__share")))
    for _ in range(rounds):
        worst, mass, factors = 0.0, now.df, []
        for name, share in zip(MARGINS, shares, strict=True):
            factor = mass.groupBy(name).agg(F.sum("__mass").alias("__now")).join(share, name)
            factor = Written(factor.select(name, F.when(F.col("__now") > 0, F.col("__share") / F.col("__now")).otherwise(1.0).alias("__factor")), "factors")
            factors.append(factor)
            n, size, off = factor.df.agg(F.count(F.lit(1)), F.sum(F.octet_length(name) + 32), F.max(F.abs(F.col("__factor") - 1))).first()
            worst = max(worst, off or 0.0)
            side = F.broadcast(factor.df) if n and size <= BROADCAST_BYTES else factor.df.hint("merge")
            mass = mass.join(side, name).select(*MARGINS, "__tokens", (F.col("__mass") * F.col("__factor")).alias("__mass"))
        before, now = now, Written(mass, "mass")
        for done in (before, *factors):
            done.drop()
        if worst < tolerance:
            break
    else:
        _missed(rounds, worst)
    weighed = now.df.withColumn("__weight", F.when(F.col("__tokens") > 0, F.col("__mass") * total / F.col("__tokens")).otherwise(0.0))
    low, high, budget = 0.0, 1.0, keep * total
    expected = lambda s: weighed.agg(F.sum(F.least(F.lit(1.0), F.col("__weight") * s) * F.col("__tokens"))).first()[0] or 0.0
    if budget >= (weighed.agg(F.sum(F.when(F.col("__weight") > 0, F.col("__tokens")))).first()[0] or 0.0):
        return weighed.select(*MARGINS, "__weight", (F.col("__weight") > 0).cast("double").alias("__p"))
    while expected(high) < budget:
        high *= 2
    for _ in range(200):
        s = (low + high) / 2
        if s in (low, high):
            break
        low, high = (s, high) if expected(s) < budget else (low, s)
    return weighed.select(*MARGINS, "__weight", F.least(F.lit(1.0), F.col("__weight") * high).alias("__p"))


def mix(
    docs: DataFrame,
    source_shares: Mapping[str, float] | None = None,
    lang_shares: Mapping[str, float] | None = None,
    topic_shares: Mapping[str, float] | None = None,
    keep: float = 0.7,
    powers: tuple[float, float, float] = (0.5, 0.7, 0.8),
    topic: Column | None = None,
    seed: str = "mix-1",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, more) with n_tokens, topic, weight, probability and selected.

    n_tokens counts the runs of non-blank characters. Shares are targets of token mass for each marginal (default:
    the present ones, tempered by ``powers``); categories without a target get none. A cell's weight is its raked
    mass over its present mass (raking that does not converge warns); a document is selected with probability min(1, s * weight), s giving ``keep`` of
    all tokens in expectation, by a number hashed from seed and doc_id, so repeated ids share their fate. Null
    source, lang or topic is the category "". Empty texts have no tokens and take their cell's probability (0 in a
    cell without tokens). An empty table stays empty. Columns of the input with these names are replaced; others, whatever
    their names, stay. ``topic`` may read doc_id, text, lang and source.
    """
    own = [c for c in docs.columns if c.lower() in ("n_tokens", "topic", "weight", "probability", "selected")]
    columns, used = [c for c in docs.columns if c not in own], ["doc_id", "text", "lang", "source"]
    docs = packed(docs.select(*(quoted(c) for c in columns)), used)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__topic": F.coalesce(default_topic(text) if topic is None else topic, F.lit(""))}
    count = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    told = docs.select(*used, "__rest", count.alias("__n"), *(v.alias(k) for k, v in keys.items()))
    cells = told.groupBy(*MARGINS).agg(F.sum(F.col("__n").cast("double")).alias("__tokens"))
    given, spark = [source_shares, lang_shares, topic_shares], docs.sparkSession
    cells = Written(cells, "cells").df
    if cells.count() <= driver_cells:
        rows = _rake_on_driver(cells.orderBy(*MARGINS).collect(), given, list(powers), keep)
        table = F.broadcast(spark.createDataFrame(rows, "__source string, __lang string, __topic string, __weight double, __p double"))
    else:
        table = _rake_in_tables(cells, given, list(powers), keep)
    mixed = told.join(table, list(MARGINS), "left")
    p = F.coalesce("__p", F.lit(0.0))
    return mixed.select(
        *unpacked(columns, used), F.col("__n").alias("n_tokens"), F.col("__topic").alias("topic"), F.coalesce("__weight", F.lit(0.0)).alias("weight"), p.alias("probability"), (hashed_unit(seed, "doc_id") < p).alias("selected")
    )
