"""Step environments, greedy hops over links, letter menus and rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def episode(state: Column, budget: Column, step: Callable[[Column], Column], done: Callable[[Column], Column]) -> Column:
    """(state, steps) after stepping until ``done`` or until the budget is used; no budget leaves the first state."""
    start = F.struct(state.alias("state"), F.lit(0).alias("steps"))
    move = lambda a: F.when(done(a["state"]), a).otherwise(F.struct(step(a["state"]).alias("state"), (a["steps"] + 1).alias("steps")))
    turns = F.when(budget > 0, F.sequence(F.lit(1), budget.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, lambda a, _: move(a))


def hop(links: DataFrame, by: str, title: str, target: str, score: str, choice_limit: int, shortlist: int) -> DataFrame:
    """One greedy hop for each ``by``: (by, title, stage, options).

    A link to the target is taken at once (``direct``). Up to ``choice_limit`` links are one menu (``choice``); of more
    the ``shortlist`` best by score are (``score_then_choice``). The best score of the menu wins, ties to the smaller title.
    Links are one row for each title; a null score counts as 0.
    """
    value = F.coalesce(F.col(score), F.lit(0.0))
    best = F.max_by(F.struct(value.alias("v"), F.col(title).alias("t")), F.struct(value, -F.col("__place")))
    placed = links.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(title)))  # a page's links are bounded
    one = placed.groupBy(by).agg(F.max(F.when(F.col(title) == F.col(target), F.col(title))).alias("direct"), best["t"].alias("best"), F.count(F.lit(1)).alias("n"))
    stage = F.when(F.col("direct").isNotNull(), "direct").when(F.col("n") <= choice_limit, "choice").otherwise("score_then_choice")
    options = F.when(F.col("direct").isNotNull(), 1).when(F.col("n") <= choice_limit, F.col("n")).otherwise(F.least(F.col("n"), F.lit(shortlist)))
    return one.select(by, F.coalesce("direct", "best").alias(title), stage.alias("stage"), options.cast("long").alias("options"))


def letter_prompt(state: Column, instructions: Column, options: Column) -> Column:
    """The prompt of the single-letter baseline: options as 'A. [key] description'. 1 to 26 options, else an error."""
    line = lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". ["), o["key"], F.lit("] "), o["description"])
    # The wording of the prompt.
    head = "Choose the best answer to the question using the state. Answer with only the option letter.\n\nState:\n"
    text = F.concat(F.lit(head), state, F.lit("\n\nQuestion:\n"), instructions, F.lit("\n\nOptions:\n"), F.array_join(F.transform(options, line), "\n"), F.lit("\n\nAnswer:"))
    return F.when(F.size(options).between(1, 26), text).otherwise(F.raise_error(F.lit("a letter menu has 1 to 26 options")).cast("string"))


def judged_rewrites(original: Column, rewrites: Column) -> Column:
    """array<struct<text, verdict>>: 'blank', 'duplicate' of the original or an earlier rewrite, 'numbers' if the number tokens differ, else 'accepted'.

    Rewrites are compared in lower case with single spaces; a null one is blank.
    """
    keys = F.transform(rewrites, lambda r: F.coalesce(T.normalised(r), F.lit("")))
    seen = F.concat(F.array(T.normalised(original)), keys)
    verdict = lambda r, i: (
        F.when(F.get(keys, i) == "", "blank").when(F.array_position(seen, F.get(keys, i)) != i + 2, "duplicate").when(~T.same_numbers(original, r), "numbers").otherwise("accepted")
    )
    return F.transform(rewrites, lambda r, i: F.struct(F.btrim(r).alias("text"), verdict(r, i).alias("verdict")))


def claim_verdict(claim: Column, records: Column) -> Column:
    """'supported', 'contradicted' or 'not_addressed' for a claim (kind, a, b, value) against records (id, value).

    'equals': record ``a`` has the value; 'greater': ``a`` has more than ``b``; 'total': all records together exceed the value.
    A record that is not there or has no value leaves the claim not addressed; so does another kind. Of records with the same id the least value counts.
    """
    of = lambda i: F.array_min(F.transform(F.filter(records, lambda r: r["id"] == i), lambda r: r["value"]))
    total = F.aggregate(records, F.lit(0.0), lambda s, r: s + r["value"])
    holds = F.when(claim["kind"] == "equals", of(claim["a"]) == claim["value"]).when(claim["kind"] == "greater", of(claim["a"]) > of(claim["b"])).when(claim["kind"] == "total", total > claim["value"])
    return F.when(holds.isNull(), "not_addressed").when(holds, "supported").otherwise("contradicted")
