"""Queries that must not grow with pairs, on small tables: against all pairs, with odd values, and with their work counted."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.plans import ORACLES, QUERIES, load
from loomline.streaming import events as E

load()


def sql_rows(folder, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(c.sql(ORACLES[name]).fetchall(), key=repr)


def most_rows(df):
    """The most rows that one operator of a finished plan put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_best_match(spark, tmp_path):
    r = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e200, -1e200, 1e-200, 1e16]
    money = lambda: round(r.uniform(-5, 5), 2)
    # nations 0 to 2: money; 3: differences that doubles cannot tell apart; 4: odd values on both sides; 5: odd suppliers only
    cust = [(k, k % 3, money()) for k in range(900)] + [(1000 + i, 3, v) for i, v in enumerate((1e9, -1e9, 0.0, 1e-9))] + [(2000 + 100 * n + i, n, v) for n in (4, 5, 6) for i, v in enumerate(odd)] + [(3000, None, 1.0), (7, 1, 4.0)]
    supp = [(500 - k, k % 3, money()) for k in range(90)] + [(900 - i, 3, i * 1e-9) for i in range(50)] + [(800 - i, 4, v) for i, v in enumerate(odd * 2)] + [(700 - i, 5, v) for i, v in enumerate(odd[:4])] + [(600, None, 1.0)]
    spark.createDataFrame(cust, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(supp, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["join_best_match"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sql_rows(tmp_path, "join_best_match", ["customer", "supplier"])


def test_best_match_makes_no_pairs(spark, tmp_path):
    a = spark.range(4000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), (F.col("id") * 37 % 4001 / 100).alias("c_acctbal"))
    a.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(500).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), (F.col("id") * 7 % 503 / 10).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["join_best_match"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sql_rows(tmp_path, "join_best_match", ["customer", "supplier"])
    assert most_rows(df) <= 3 * 4000  # all pairs: 2,000,000


@pytest.fixture
def small_frames(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("files", [1000, 1])
def test_rate_limit_of_keys_in_many_frames(spark, tmp_path, monkeypatch, small_frames, files):
    # three files that overlap in time, newest event first, with equal times; three users in frames of 50 rows
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.floor((2000 - F.col("id")) / 3) * 217_000_123)
    e = spark.range(2000).select((F.col("id") * 7 % 2000).alias("event_id"), ts.alias("ts"), (F.col("id") % 7 % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    e.repartition(3, "event_id").sortWithinPartitions("ts", ascending=False).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(E.read_stream, "__defaults__", (files,))
    got = QUERIES["st_rate_limit_stream"](spark, str(tmp_path)).select("user_id", "event_id", "allowed", "wait").collect()
    want = sql_rows(tmp_path, "st_rate_limit_stream", ["events"])
    assert len(got) == 2000 and {r["allowed"] for r in got} == {True, False}
    assert sorted((*r[:3], round(r[3], 6)) for r in got) == sorted((*r[:3], round(r[3], 6)) for r in want)


def test_rate_limit_merges_runs():
    r = random.Random(5)
    rows = [[r.randrange(300), i] for i in range(9001)]
    r.shuffle(rows)
    frames = [pd.DataFrame(rows[i : i + 97], columns=["us", "event_id"]) for i in range(0, 9001, 97)]
    for held in (1, 1000, 9001, 1 << 20):
        assert list(E.in_time_order(iter(frames), held)) == sorted(rows)
    assert list(E.in_time_order(iter([]), 10)) == []


def customers(spark, folder, n, nations):
    r = random.Random(n)
    rows = [(k, r.choice(nations), r.choice(["A", "B", None]), None if k % 17 == 0 else round(r.uniform(-60, 60), 2)) for k in range(n)]
    rows += [(4, 1, "A", 3.5), (6, 1, "B", 3.5)]  # a key twice counts all its matches
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")


@pytest.mark.parametrize(("n", "nations"), [(1500, [1, 2, None, *range(10, 60)]), (0, [1])])
def test_identity_match(spark, tmp_path, n, nations):
    customers(spark, tmp_path, n, nations)
    got = QUERIES["join_identity_match"](spark, str(tmp_path))
    assert got.columns == ["a", "b", "matches"] and dict(got.dtypes)["matches"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=repr) == sql_rows(tmp_path, "join_identity_match", ["customer"])


def test_identity_match_makes_no_pairs(spark, tmp_path):
    customers(spark, tmp_path, 4000, [1])
    df = QUERIES["join_identity_match"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sql_rows(tmp_path, "join_identity_match", ["customer"])
    assert most_rows(df) <= 3 * 4000  # pairs that match: more than 400,000
