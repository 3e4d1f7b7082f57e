"""Deterministic prediction facts on the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import dists as D
from loomline.operators.scoring import with_scores
from loomline.plans.registry import table

KINDS = ("choice", "score", "noul")


def _fact(e: DataFrame, k: Column, first: int, target: Column) -> DataFrame:
    z = F.transform(F.slice("embedding", first, k), lambda x: x.cast("double") * 10)
    kind = F.when(F.col("vec_id") % 3 == 0, "choice").when(F.col("vec_id") % 3 == 1, "score").otherwise("noul")
    out = e.select(
        F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("grp"), F.concat(F.lit("f"), (F.col("label") % 3).cast("string")).alias("family"), kind.alias("kind"), k.cast("int").alias("k"),
        z.alias("z"), D.one_hot(target, k).alias("y"),
    )
    return out.withColumn("p", D.softmax(F.col("z")))


def predictions(spark: SparkSession, sf_dir: str, first: int = 1, scored: bool = True) -> DataFrame:
    """One decision per embedding: K = 2 + label options, logits 10 * embedding[first..], one-hot target vec_id mod K."""
    k = F.col("label") + 2
    fact = _fact(table(spark, sf_dir, "embeddings"), k, first, F.col("vec_id") % k)
    return with_scores(fact) if scored else fact


def pred_sql(name: str = "pred", first: int = 1, scored: bool = True) -> str:
    """The same fact as a chain of CTEs ending in ``name``."""
    kind = "CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END"
    chain = f"""{name}_0 AS (SELECT vec_id AS id, vec_id // 4 AS grp, 'f' || (label % 3) AS family, {kind} AS kind, 2 + label AS k, vec_id % (2 + label) AS t,
        list_transform(embedding[{first}:{first} + 1 + label], lambda x: 10 * x::DOUBLE) AS z FROM embeddings),
    {name}_1 AS (SELECT *, list_max(z) AS m, list_transform(range(0, k), lambda i: CASE WHEN i = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y FROM {name}_0),
    {name}_2 AS (SELECT *, list_transform(z, lambda x: exp(x - m)) AS e FROM {name}_1),
    {name}_3 AS (SELECT *, list_sum(e) AS se FROM {name}_2),
    {name}{'_4' if scored else ''} AS (SELECT id, grp, family, kind, k, t, z, y, list_transform(e, lambda x: x / se) AS p FROM {name}_3)"""
    if scored:
        chain += f""", {name} AS (SELECT *, list_max(p) AS confidence, CASE WHEN list_position(p, list_max(p)) - 1 = t THEN 1.0 ELSE 0.0 END::DOUBLE AS correct,
        -ln(greatest(p[t + 1], 1e-12)) AS nll, list_sum(list_transform(range(1, k + 1), lambda i: (p[i] - y[i]) ** 2)) AS brier,
        -p[t + 1] / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-12) AS spherical, ln(k) AS uniform_nll FROM {name}_4)"""
    return chain


def fit_sql(name: str, rows: str, by: tuple[str, ...] = (), rounds: int = 3, points: int = 33) -> str:
    """CTEs ending in ``name`` (by.., temperature, nll, nll_before): the grid search over ln T on ``rows`` (z, t), finer in each round."""
    keys = ", ".join(by) or "one"
    src = f"{name}_s AS (SELECT *, 1 AS one FROM {rows})"
    loss = lambda ln: f"avg(list_max(z) / exp({ln}) + ln(list_sum(list_transform(z, lambda x: exp((x - zm) / exp({ln}))))) - z[t + 1] / exp({ln}))"
    chain, width = [src, f"{name}_0 AS (SELECT {keys}, 0.0::DOUBLE AS ln FROM {name}_s GROUP BY {keys})"], 4.6
    for r in range(1, rounds + 1):
        at = f"least(greatest(b.ln + {width!r} * (i.i * {2 / (points - 1)!r} - 1), -4.6), 4.6)"
        chain.append(f"{name}_g{r} AS (SELECT s.*, list_max(z) AS zm, {at} AS ln FROM {name}_s s JOIN {name}_{r - 1} b USING ({keys}), range({points}) i(i))")
        chain.append(f"{name}_m{r} AS (SELECT {keys}, ln, {loss('ln')} AS nll FROM {name}_g{r} GROUP BY {keys}, ln)")
        chain.append(f"{name}_{r} AS (SELECT {keys}, first(ln ORDER BY nll, ln) AS ln, min(nll) AS nll FROM {name}_m{r} GROUP BY {keys})")
        width = 2 * width / (points - 1)
    chain.append(f"{name}_one AS (SELECT {keys}, {loss('0.0')} AS one_nll FROM (SELECT *, list_max(z) AS zm FROM {name}_s) GROUP BY {keys})")
    shown = ", ".join(by) + ", " if by else ""
    chain.append(f"{name} AS (SELECT {shown}CASE WHEN nll < one_nll THEN exp(ln) ELSE 1.0 END AS temperature, least(nll, one_nll) AS nll, one_nll AS nll_before FROM {name}_{rounds} JOIN {name}_one USING ({keys}))")
    return ", ".join(chain)
