"""Operators behind the queries of plans.actions, on cases worked out by hand or by plain Python."""

import difflib
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.functions import dates as DT
from loomline.functions import geometry as G
from loomline.functions import text as T
from loomline.operators import decisions as DE
from loomline.operators import episodes as E
from loomline.operators.remote import Resilient, call, call_remote
from loomline.operators.words import changed_words
from loomline.sources import requests as SRC


def test_working_days_against_a_walk(spark):
    rng, free = random.Random(3), [date(2026, 1, 1), date(2026, 4, 3), date(2026, 4, 6), date(2026, 4, 4)]
    rows = [(date(2025, 12, 20) + timedelta(days=rng.randrange(120)), rng.randrange(-1, 25), rng.random() < 0.5) for _ in range(80)]

    def walk(d, n, counts):
        works = lambda x: x.weekday() < 5 and x not in free
        left = n - (counts and works(d))
        while left > 0:
            d += timedelta(days=1)
            left -= works(d)
        return d

    df = spark.createDataFrame(rows, "d date, n int, c boolean").withColumn("due", DT.business_day_after(F.col("d"), F.col("n"), free, F.col("c")))
    assert all(r.due == walk(r.d, r.n, r.c) for r in df.collect())
    none = spark.range(1).select(DT.business_day_after(F.lit(date(2026, 1, 2)), F.lit(1), []).alias("d"), DT.iso_monday(F.lit(2026), F.lit(1)).alias("m"), DT.coverage_end(F.lit(date(2026, 8, 31)), F.lit(6), F.lit(0)).alias("c")).first()
    assert tuple(none) == (date(2026, 1, 5), date(2025, 12, 29), date(2027, 2, 28))


def test_bearings(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (-1.0, 0.0, 0.0), (1.0, 0.0, 350.0), (1.0, 1.0, 725.0)]
    df = spark.createDataFrame(rows, "x double, y double, f double").withColumn("b", G.bearing(F.col("x"), F.col("y"), F.col("f")))
    got = df.select("b", G.compass(F.col("b")).alias("c"), G.labelled_bearing(F.col("b")).alias("l")).collect()
    assert [r.b for r in got] == [0.0, 90.0, -90.0, 180.0, 10.0, 40.0]
    assert [r.c for r in got] == ["north", "west", "east", "south", "north", "northwest"]
    assert [r.l for r in got][1::4] == ["+90° (directly left)", "+40° (ahead left)"]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.other_units(F.lit("$5 for 3 km, 2.5 kg and 3 kmh")).alias("u"), T.other_punctuation(F.lit("A.b. C, d."), F.lit("no_periods")).alias("p"), T.other_punctuation(F.lit(None).cast("string"), F.lit("dashes")).alias("n"),
        T.article_title(F.lit("/wiki/A%zz_b")).alias("t"), T.article_title(F.lit("/wiki/")).alias("e"), T.question_key(F.lit("a:b:c:0123456789")).alias("q"), T.family_of(F.lit("none")).alias("f"),
    ).first()
    assert tuple(row) == ("5 USD for 3 kilometres, 2.5 kilograms and 3 kmh", "A.b C, d", None, "A%zz b", None, "a:b:c", "none")


def test_changed_words_against_opcodes():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        codes = difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes()
        assert changed_words(a, b) == sum(max(c[2] - c[1], c[4] - c[3]) for c in codes if c[0] != "equal")
    assert changed_words(None, "a") is None


def test_calls():
    sent = []

    def send(payload, attempt):
        sent.append(attempt)
        if payload == "off":
            raise TimeoutError
        return {"busy": 503, "once": 429 if attempt == 1 else 200, "no": 401, "bad": 404}.get(payload, 200), payload

    assert call(send, "busy", 0) == (503, None, 3, "http_error") and sent == [1, 2, 3]
    assert call(send, "off", 0) == (None, None, 1, "transport_error") and call(send, "once", 0) == (200, "once", 2, None)
    assert call(send, "no", 0)[3] == "authentication" and call(send, "bad", 0) == (404, None, 1, "http_error")


def test_cache_null_and_repeats(spark, tmp_path):
    log = tmp_path / "sent"

    def send(payload, attempt):
        with log.open("a") as f:
            f.write(payload + "\n")
        return 200, payload.upper()

    empty = spark.createDataFrame([], "key string, status int, body string, attempts int, error string")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, payload string")
    got, fresh = call_remote(rows, empty, send, pause=0)
    assert {r.id: (r.body, r.cache_hit) for r in got.collect()} == {1: ("A", False), 2: ("A", False), 3: ("B", False), 4: (None, None)}
    again, more = call_remote(rows, fresh, send, pause=0)
    assert {r.id: (r.body, r.cache_hit) for r in again.collect()} == {1: ("A", True), 2: ("A", True), 3: ("B", True), 4: (None, None)} and more.count() == 0
    assert sorted(log.read_text().split()) == ["a", "b"]


def test_resilient():
    calls = []

    def scorer(s, i, o):
        calls.append(len(s))
        if len(s) > 1 or s == ["bad"]:
            raise MemoryError
        return [[1.0]]

    assert Resilient(scorer)(["x", "bad"], ["", ""], [["a"], ["a"]]) == [[1.0], []] and calls == [2, 2, 1, 1]


def test_episode_and_hop(spark):
    df = spark.createDataFrame([(3, 10), (3, 2), (0, 5), (3, 0), (3, None)], "n int, budget int")
    ran = df.select(E.episode(F.col("n"), F.col("budget"), lambda s: s - 1, lambda s: s <= 0).alias("r")).select("r.*")
    assert [tuple(r) for r in ran.collect()] == [(0, 3), (1, 2), (0, 0), (3, 0), (3, 0)]
    links = [("p", "x", "t", 0.5), ("p", "y", "t", 0.5), ("p", "z", "t", None), ("q", "t", "t", 0.0), ("q", "u", "t", 9.0)] + [("r", f"l{i}", "t", float(i)) for i in range(5)]
    got = E.hop(spark.createDataFrame(links, "page string, title string, target string, score double"), "page", "title", "target", "score", 3, 2).collect()
    assert sorted(tuple(r) for r in got) == [("p", "x", "choice", 3), ("q", "t", "direct", 1), ("r", "l4", "score_then_choice", 2)]


def test_letter_menus_have_26_options_at_most(spark):
    menu = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("string").alias("key"), F.lit("d").alias("description")))
    assert "\nZ. [26] d\n" in spark.range(1).select(E.letter_prompt(F.lit("s"), F.lit("i"), menu(26))).first()[0]
    with pytest.raises(Exception, match="1 to 26"):
        spark.range(1).select(E.letter_prompt(F.lit("s"), F.lit("i"), menu(27))).collect()


def test_decisions(spark):
    c = "array<struct<key:string,risk:string,cost:double,impact:int>>"
    rows = [([("a", "low", 1.0, 3), ("b", "medium", 1.0, 2), ("c", "high", 1.0, 1)],), ([("a", "low", 1.0, 2), ("b", "low", 2.0, 2)],), ([("a", "odd", 1.0, 1), ("b", "low", None, 1)],), ([],), (None,)]
    got = spark.createDataFrame(rows, f"c {c}").select(DE.best_within(F.col("c"), F.lit("medium"), F.lit(5.0), ["impact"]).alias("g"))
    assert [r.g for r in got.collect()] == ["b", None, None, None, None]
    person = "struct<dob:string,mail:string>"
    pairs = [(("1990-1-1", None), ("199011", "x")), (("1990-1-1", "a"), ("1990-1-1", "b")), ((None, "a"), ("1", None)), ((None, None), (None, None))]
    got = spark.createDataFrame(pairs, f"a {person}, b {person}").select(DE.same_person(F.col("a"), F.col("b"), ["dob", "mail"]).alias("s"))
    assert [r.s for r in got.collect()] == [True, False, False, False]
    p = [[0.5, 0.3, 0.2], [0.5, 0.3, 0.2], [0.98, 0.015, 0.005]]
    q = [[x**2 / sum(y**2 for y in p[0]) for x in p[0]], [0.2, 0.3, 0.5], p[2]]
    got = [r.r for r in spark.createDataFrame(list(zip(p, q, strict=True)), "p array<double>, q array<double>").select(DE.menu_residual(F.col("p"), F.col("q")).alias("r")).collect()]
    assert math.isclose(got[0].residual_rms, 0, abs_tol=1e-9) and not got[0].rank_reversal and got[1].rank_reversal and got[2] is None


def test_empty_requests_are_an_error(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="no request"):
        SRC.read_requests(spark, str(tmp_path))
    assert SRC.read_requests(spark, str(tmp_path), strict=False).count() == 0
