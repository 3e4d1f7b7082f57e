"""The typed request model: schema, violations, construction of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import dists as D

OPTION = T.StructType([T.StructField("key", T.StringType()), T.StructField("description", T.StringType())])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("instructions", T.StringType()),
    T.StructField("options", T.ArrayType(OPTION)), T.StructField("target", T.ArrayType(T.DoubleType())),
])
REQUEST = T.StructType([T.StructField("state", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField("questions", T.ArrayType(QUESTION))])


def question_violation(q: Column, noul_keys: bool = True) -> Column:
    """The first rule that a question breaks, or null."""
    k, keys = F.size(q["options"]), F.transform(q["options"], lambda o: o["key"])
    rules = [
        (~F.coalesce(q["kind"].isin("choice", "score", "noul"), F.lit(False)), "kind"),
        (F.coalesce(F.trim(q["instructions"]), F.lit("")) == "", "instructions"),
        ((q["kind"] == "choice") & ~k.between(1, 255), "choice_cardinality"),
        ((q["kind"] == "score") & ~k.between(2, 10), "score_levels"),
        ((q["kind"] == "noul") & (k != 2), "noul_options"),
        (F.exists(keys, lambda x: x.isNull() | (x == "")), "empty_key"),
        (F.size(F.array_distinct(keys)) != k, "duplicate_key"),
        (q["target"].isNotNull() & ~D.valid_distribution(q["target"], k), "target"),
    ]
    if noul_keys:
        rules.append(((q["kind"] == "noul") & (F.array_join(keys, ",") != "false,true"), "noul_keys"))
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in rules))


def request_violation(requests: DataFrame) -> DataFrame:
    """Requests with a ``violation`` column: no question, or the first violation of a question."""
    broken = F.filter(F.transform("questions", lambda q: question_violation(q)), lambda v: v.isNotNull())
    none = F.coalesce(F.size("questions"), F.lit(0)) <= 0
    return requests.withColumn("violation", F.when(none, "no_questions").otherwise(F.get(broken, F.lit(0))))


def option_keys(kind: Column, keys: Column, n: Column) -> Column:
    """Keys by kind: the choice's own, "0".."n-1" of a score, false and true."""
    levels = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i.cast("string"))
    return F.when(kind == "choice", keys).when(kind == "score", levels).otherwise(F.array(F.lit("false"), F.lit("true")))


def question(ident: str, kind: str, instructions: str, options: list[tuple[str, str]], target: Column | None) -> Column:
    """A question with fixed options; the target is a probability array over them."""
    o = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in options))
    t = F.lit(None).cast("array<double>") if target is None else target
    return F.struct(F.lit(ident).alias("id"), F.lit(kind).alias("kind"), F.lit(instructions).alias("instructions"), o.alias("options"), t.alias("target"))


def noul(ident: str, instructions: str, p_true: Column) -> Column:
    return question(ident, "noul", instructions, [("false", "no"), ("true", "yes")], F.array(1 - p_true, p_true))


def shuffle_options(q_options: Column, target: Column, seed: Column) -> Column:
    """Options with their targets in the order of a hash of (seed, key): array<struct<key, description, target>>."""
    zipped = F.zip_with(q_options, target, lambda o, t: F.struct(F.sha2(F.concat(seed, F.lit(":"), o["key"]), 256).alias("o"), o["key"].alias("key"), o["description"].alias("description"), t.alias("target")))
    return F.transform(F.array_sort(zipped), lambda x: F.struct(x["key"].alias("key"), x["description"].alias("description"), x["target"].alias("target")))


def packed_lengths(state: Column, options: Column, instructions: Column) -> dict[str, Column]:
    """UTF-8 bytes of a tree-packed request: state, block header, one leaf for each option, and their sum."""
    leaves = F.transform(options, lambda o: F.octet_length(F.concat(o["key"], F.lit(": "), o["description"])) + 1)
    s, h, l = F.octet_length(state) + 1, F.octet_length(instructions) + 1, F.aggregate(leaves, F.lit(0), lambda a, x: a + x)
    return {"state_tokens": s, "header_tokens": h, "option_tokens": l, "tokens": s + h + l}
