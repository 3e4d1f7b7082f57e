"""Menus: options of a choice question, drawn for each row from the label pool of its task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import seeded_hash

#: A task's label pool is a vocabulary that people maintain; larger ones are refused, not cut.
MOST_LABELS = 10_000
NONE = "none of these"


def _near(labels: list[str], most: int) -> dict[str, list[str]]:
    """Of each label the other labels that share words with it, most words first, then in the order given."""
    words = {x: frozenset(re.findall("[a-z]+", x.lower())) for x in labels}
    holders: dict[str, list[str]] = {}
    for x in labels:
        for w in words[x]:
            holders.setdefault(w, []).append(x)
    place, out = {x: i for i, x in enumerate(labels)}, {}
    for x in labels:
        shared: dict[str, int] = {}
        for w in words[x]:
            for y in holders[w]:
                shared[y] = shared.get(y, 0) + 1
        shared.pop(x, None)
        out[x] = sorted(shared, key=lambda y: (-shared[y], place[y]))[:most]
    return out


def _number(h: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(h, start, digits), 16, 10).cast("long")


def with_menu(df: DataFrame, key: str, gold: str, seed: int | str, sizes: tuple[int, ...] = (2, 4, 8), omit: float = 0.2, pool: DataFrame | None = None) -> DataFrame:
    """``df`` with menu (array of labels, NONE among them) and target (0-based place of the right option).

    The SHA-256 of ``seed:key`` decides all: K of ``sizes``, whether the right label is left out (then NONE is right), and
    where the row begins in a seeded order of the pool. Of the wrong options, half (rounded down) are those that share
    most words with the right label, as far as any do; the others follow the row's beginning in the pool. The menu's
    order is that of the SHA-256 of ``seed:key:label``. The pool (default: the distinct labels of ``df``) must hold the
    right labels; a row without a label gets null. A row costs K steps, whatever the size of the pool.
    """
    labels = [r[0] for r in (df if pool is None else pool).select(F.col(gold if pool is None else pool.columns[0]).cast("string").alias("x")).where("x IS NOT NULL").distinct().limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"a label pool holds at most {MOST_LABELS} labels")
    import hashlib

    labels.sort(key=lambda x: (hashlib.sha256(f"{seed}:{x}".encode()).hexdigest(), x))
    if labels and max(sizes) > len(labels):
        raise ValueError("a menu asks for more options than the pool holds")
    near, spark = _near(labels, max(sizes) // 2), df.sparkSession
    # For each label its place in the pool and its near ones; the pool twice, so that every beginning has a run after it.
    side = spark.createDataFrame([(x, i, near[x]) for i, x in enumerate(labels)], "__label string, __place int, __near array<string>")
    round_ = spark.createDataFrame([(labels + labels[: 2 * max(sizes) + 2],)], "__round array<string>")
    told = df.join(F.broadcast(side), F.col(gold) == F.col("__label"), "left").crossJoin(F.broadcast(round_)).withColumn("__h", seeded_hash(seed, F.col(key)))
    k = F.element_at(F.array(*map(F.lit, sizes)), (_number(F.col("__h"), 1, 2) % len(sizes)).cast("int") + 1)
    out = _number(F.col("__h"), 3, 4) < int(omit * 65536)
    told = told.withColumn("__omit", out).withColumn("__wrong", k - F.when(out, 1).otherwise(2)).withColumn("__from", (_number(F.col("__h"), 7, 8) % max(1, len(labels))).cast("int"))
    told = told.withColumn("__hard", F.slice("__near", F.lit(1), F.floor(F.col("__wrong") / 2).cast("int")))
    run = F.slice("__round", F.col("__from") + 1, F.col("__wrong") + F.size("__hard") + 1)
    others = F.filter(F.array_distinct(run), lambda x: (x != F.col("__label")) & ~F.array_contains("__hard", x))
    wrong = F.concat("__hard", F.slice(others, F.lit(1), F.col("__wrong") - F.size("__hard")))
    told = told.withColumn("__all", F.concat(wrong, F.array(F.lit(NONE)), F.when(F.col("__omit"), F.array().cast("array<string>")).otherwise(F.array("__label"))))
    order = F.transform("__all", lambda x: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), x), 256).alias("h"), x.alias("x")))
    told = told.withColumn("menu", F.transform(F.array_sort(order), lambda o: o["x"]))
    right = F.when(F.col("__omit"), F.lit(NONE)).otherwise(F.col("__label"))
    return told.withColumn("target", (F.array_position("menu", right) - 1).cast("int")).drop("__label", "__place", "__near", "__round", "__h", "__omit", "__wrong", "__from", "__hard", "__all")
