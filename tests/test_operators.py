"""Hand-computed vectors, edge cases and invariants of the operators without an SQL twin."""

import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import dists as D
from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.operators import menus as M
from loomline.operators import ranks as N
from loomline.operators import relational as R
from loomline.operators import requests as Q
from loomline.operators import scorer as SC
from loomline.operators import scoring as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_scoring_rules(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1], [0.0, 1.0, 0.0]), ([0.6, 0.4], [1.0, 0.0])], "p array<double>, y array<double>")
    r = S.with_scores(df).agg(F.avg("nll"), F.avg("brier")).first()
    assert r[0] == pytest.approx((-math.log(0.2) - math.log(0.6)) / 2) and r[1] == pytest.approx((0.49 + 0.64 + 0.01 + 0.16 + 0.16) / 2)
    assert one(spark, D.nll(F.col("p"), F.col("y")), p=[0.8, 0.2], y=[0.4, 0.6]) == pytest.approx(-0.4 * math.log(0.8) - 0.6 * math.log(0.2))
    assert one(spark, D.brier(F.col("p"), F.col("y")), p=[0.8, 0.2], y=[0.4, 0.6]) == pytest.approx(0.32)
    assert one(spark, D.nll(F.col("p"), F.col("y"), 1e-3), p=[0.0, 0.3, 0.7], y=[1.0, 0.0, 0.0]) == pytest.approx(3 * math.log(10))
    assert one(spark, D.nll_literal(F.col("p"), F.col("y")), p=[0.0, 0.3, 0.7], y=[1.0, 0.0, 0.0]) is None
    assert one(spark, D.softmax(F.col("z")), z=[math.log(3), 0.0, math.log(6)]) == pytest.approx([0.3, 0.1, 0.6])
    assert one(spark, D.argmax(F.col("p")), p=[0.4, 0.4, 0.2]) == 0


def test_bins(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.05, 0.1, 0.95, 1.0)], "c double")
    rows = df.select(D.bin_floor(F.col("c")), D.bin_right_closed(F.col("c")), D.bin_left_closed(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (0, 0, 0), (1, 0, 1), (9, 9, 9), (9, 9, None)]


def test_cardinality_buckets(spark):
    df = spark.createDataFrame([(k,) for k in (2, 3, 4, 5, 8, 9, 16, 17, 64, 200)], "k int")
    assert [r[0] for r in df.select(D.cardinality_bucket(F.col("k"))).collect()] == [2, 4, 4, 8, 8, 16, 16, 32, 64, 256]


def test_hash_mod10(spark):
    import hashlib

    keys = [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = df.select("k", T.hex_mod10(F.sha2("k", 256)).alias("m"), T.hex_parity(F.sha2("k", 256)).alias("b")).collect()
    for r in got:
        n = int(hashlib.sha256(r["k"].encode()).hexdigest(), 16)
        assert (r["m"], r["b"]) == (n % 10, n % 2)


def fill(counts, size, cap):
    """Row by row: the next row goes to a source with the fewest that still has one, while every such source can get one."""
    given = dict.fromkeys(counts, 0)
    while True:
        least = [k for k in counts if given[k] < min(counts[k], cap)]
        low = min((given[k] for k in least), default=None)
        turn = [k for k in least if given[k] == low]
        if not turn or sum(given.values()) + len(turn) > size:
            return given
        for k in turn:
            given[k] += 1


@pytest.mark.parametrize(("numbers", "size", "cap"), [([7, 31, 31, 90], 95, 40), ([5, 5, 5], 100, 9), ([1, 2, 3, 50, 50], 20, 30), ([4, 4], 3, 9), ([12], 5, 50), ([6, 9, 14], 29, 14), ([3, 8], 0, 5)])
def test_water_level(spark, numbers, size, cap):
    counts = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(numbers)], "source string, n long")
    level = C.water_level(counts, "n", size, cap)
    assert {f"s{i}": min(n, level) for i, n in enumerate(numbers)} == fill({f"s{i}": n for i, n in enumerate(numbers)}, size, cap)
    assert C.water_level(counts.where("false"), "n", size, cap) == cap


def test_ranked(spark):
    import random

    rows = [(random.Random(i).choice(["x", "x", "x", "y", None]), i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, id long").repartition(7)
    every = {r["id"]: r["rank"] for r in N.ranked(df, ["o", "id"]).collect()}
    assert every == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    by_group = {r["id"]: r["rank"] for r in N.ranked(df, ["o", "id"], by=["g"]).collect()}
    for g in ("x", "y", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert {r[2]: by_group[r[2]] for r in own} == {r[2]: k for k, r in enumerate(own, 1)}
    assert N.ranked(df.where("false"), ["id"], by=["g"]).count() == 0


def test_order_statistics_narrow_down(spark):
    import random

    rng = random.Random(3)
    rows = [("a", rng.expovariate(1) ** 9) for _ in range(900)] + [("b", 5.0)] * 50 + [("b", -1e12), ("b", 1e12), ("b", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    ranks = {"median": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "low": F.floor(F.col("n") / 10), "none": F.col("n") + 3}
    for r in N.order_statistics(df, "g", "v", ranks, buckets=4, small=10).collect():
        own = sorted(v for g, v in rows if g == r["g"] and v is not None)
        n = len(own)
        assert (r["n"], r["median"], r["last"], r["low"], r["none"]) == (n, own[n // 2], own[-1], own[n // 10], None)


def test_set_digest(spark):
    rows = [(i % 2, f"{i % 40:04x}") for i in range(400)]
    a, b = spark.createDataFrame(rows, "g long, h string"), spark.createDataFrame(sorted(set(rows), reverse=True), "g long, h string")
    assert sorted(map(tuple, N.set_digest(a, "g", "h", 3).collect())) == sorted(map(tuple, N.set_digest(b, "g", "h", 3).collect()))
    assert N.set_digest(a.where("h <> '0001'"), "g", "h").where("g = 1").first() != N.set_digest(a, "g", "h").where("g = 1").first()


def test_menu(spark):
    labels = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("car", "boat", "house", "tree")]
    rows = spark.createDataFrame([(i, labels[i % 12]) for i in range(600)] + [(600, None)], "id long, label string")
    out = {r["id"]: r for r in M.with_menu(rows, "id", "label", 5).collect()}
    assert len(out) == 601 and out[600]["menu"] is None and out[600]["target"] is None
    left_out = 0
    for i in range(600):
        menu, gold = out[i]["menu"], labels[i % 12]
        right = menu[out[i]["target"]]
        assert len(menu) in (2, 4, 8) and len(set(menu)) == len(menu) and M.NONE in menu and right == (gold if gold in menu else M.NONE)
        left_out += gold not in menu
        near = [x for x in menu if x not in (gold, M.NONE) and set(x.split()) & set(gold.split())]
        assert len(near) >= (len(menu) - 1 - (gold in menu)) // 2
    assert 80 < left_out < 160 and {len(r["menu"]) for i, r in out.items() if i < 600} == {2, 4, 8}
    again = {r["id"]: r["menu"] for r in M.with_menu(rows.repartition(5), "id", "label", 5).collect()}
    assert again == {i: r["menu"] for i, r in out.items()} != {r["id"]: r["menu"] for r in M.with_menu(rows, "id", "label", 6).collect()}
    with pytest.raises(ValueError, match="more options"):
        M.with_menu(rows.where("id < 3"), "id", "label", 5)


def test_shingle_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words[:30])), (2, " ".join(words[20:50])), (3, "W40, " + " ".join(words[41:52]) + "!"), (4, None), (5, "w1 w2"), (6, " ".join(words[5:16] + ["x"] + words[17:27]))]
    got = C.shingle_leaks(spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame([(" ".join(words[3:17]),), (" ".join(words[38:52]),)], "t string"), "t").collect()
    assert {r["id"]: r["shingle"] for r in got} == {1: " ".join(words[3:15]), 3: " ".join(words[40:52]), 2: " ".join(words[38:50])}


def test_as_of(spark):
    import datetime as d

    day = lambda n: d.date(2020, 1, 1) + d.timedelta(n)
    facts = spark.createDataFrame([(i, day(i) if i < 30 else None) for i in range(31)], "id long, d date")
    rates = spark.createDataFrame([(day(5), 0.5), (day(20), 2.0)], "effective date, rate double")
    got = {r["id"]: r["rate"] for r in R.as_of(facts, F.col("d"), rates, "effective", ["rate"]).collect()}
    assert got == {i: None if i < 5 or i == 30 else 0.5 if i < 20 else 2.0 for i in range(31)}


def test_strict_pairing_raises(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, v double")
    assert S.paired(a, a, ["id"], ["v"]).count() == 2
    for b in (a.where("id = 1"), a.withColumn("v", F.col("v") + 1)):
        with pytest.raises(Exception, match="same decisions"):
            S.paired(a, b, ["id"], ["v"]).collect()


def test_bootstrap_weighs_decisions(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("b", -2.0)] * 2, "g string, v double")
    r = S.bootstrap(df, "g", "v", draws=200).first()
    assert r["estimate"] == pytest.approx(0.25) and r["lower"] <= 0.25 <= r["upper"] and r["groups"] == 2


def test_temperature_recovers(spark):
    rows = [([2.0 * (i % 3 == k) for k in range(3)], [1.0 if k == (i % 3 if i % 4 else (i + 1) % 3) else 0.0 for k in range(3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "z array<double>, y array<double>")
    r = S.fit_temperature(df).first()
    want = min((-(0.75 * (2 / t) + 0.25 * 0) + math.log(math.exp(2 / t) + 2), t) for t in [math.exp(x / 200) for x in range(-800, 800)])
    assert r["temperature"] == pytest.approx(want[1], rel=0.02) and r["nll"] <= r["nll_before"]


def test_percentiles(spark):
    a = F.array(*(F.lit(float(i)) for i in range(1, 11)))
    r = spark.range(1).select(S.percentile_trunc(a, 0.95), S.percentile_nm1(a, 0.95)).first()
    assert tuple(r) == (10.0, 9.0)
    df = spark.createDataFrame([("g", float(v)) for v in (1, 1, 2, 2, 2, 9)], "g string, v double")
    got = N.order_statistics(df, "g", "v", {"median": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).first()
    assert (got["median"], got["last"], got["n"]) == (2.0, 9.0, 6)


def test_question_violations(spark):
    options = [("a", "x"), ("b", "y")]
    good = Q.question("q", "choice", "ask", options, F.array(F.lit(0.5), F.lit(0.5)))
    cases = {
        None: good,
        "kind": Q.question("q", "other", "ask", options, None),
        "instructions": Q.question("q", "choice", " ", options, None),
        "duplicate_key": Q.question("q", "choice", "ask", [("a", "x"), ("a", "y")], None),
        "target": Q.question("q", "choice", "ask", options, F.array(F.lit(0.9), F.lit(0.5))),
        "noul_keys": Q.question("q", "noul", "ask", [("true", "x"), ("false", "y")], None),
        "score_levels": Q.question("q", "score", "ask", [("0", "x")], None),
    }
    row = spark.range(1).select(*(Q.question_violation(q).alias(str(k)) for k, q in cases.items())).first().asDict()
    assert row == {str(k): k for k in cases}


def test_fold_and_walk(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, o long")
    out = R.fold_by(df, "k", ["o"], lambda s, r: (s + r["o"], (r["k"], r["o"], s + r["o"])), "k long, o long, total long", lambda: 0).collect()
    for r in out:
        assert r["total"] == sum(i for i in range(30) if i % 3 == r["k"] and i <= r["o"])
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "k long, t long")
    assert sorted(tuple(r) for r in R.walk(chain, "k", "t", 5).collect()) == [(1, 3, 2), (2, 3, 1), (3, 3, 0)]


def test_scorer_and_cache(spark):
    df = spark.createDataFrame([(1, "the cat", ["cat", "dog"]), (2, "the cat", ["cat", "dog"]), (3, "", ["a", "b"])], "key long, state string, options array<string>").withColumn("instructions", F.lit("ask"))
    out = {r["key"]: r["probabilities"] for r in SC.score(df, SC.lexical).collect()}
    assert out[1] == out[2] and out[1][0] == pytest.approx(2 / 3) and out[3] == [0.5, 0.5]
    cache = spark.createDataFrame([(1, [0.9, 0.1])], "key long, probabilities array<double>")
    answers, fresh = SC.score_cached(df, cache, SC.uniform)
    assert {r["key"]: r["probabilities"][0] for r in answers.collect()} == {1: 0.9, 2: 0.5, 3: 0.5}
    assert {r["key"] for r in fresh.collect()} == {2, 3}


def test_conflicts_and_cyclic_swap(spark):
    df = spark.createDataFrame([(1, "h", "a"), (2, "h", "b"), (3, "g", "a"), (4, "g", "a")], "id long, h string, l string")
    assert {r["id"] for r in C.drop_conflicts(df, "h", "l").collect()} == {3, 4}
    hashed = spark.range(100).withColumn("o", F.sha2(F.col("id").cast("string"), 256))
    for many in ({"least_groups": 4}, {"least_groups": 1, "group_rows": 30}):
        swap = C.cyclic_swap(hashed, "o", ["id"], **many).collect()
        assert sorted(r["swapped_id"] for r in swap) == list(range(100)) and all(r["id"] != r["swapped_id"] for r in swap)
