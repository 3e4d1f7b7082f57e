"""Generated worlds with their gold answers, and the corpus builds made of them.

A world is a row of draws: hashes of (seed, world, place), so it does not depend on partitions and a build of any size
is a projection of ``range`` without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.operators import scoring as S
from loomline.plans.corpus import D, docs, m10
from loomline.plans.facts import fit_sql, pred_sql, predictions
from loomline.plans.pipelines import CLEAN, clean_docs
from loomline.plans.registry import query, table

WORLDS, ITEMS = 600, 5


def draw(seed: str, world: Column, place: Column | int, n: int) -> Column:
    """A whole number in [0, n) from the first 32 bits of an MD5."""
    key = F.concat_ws(":", F.lit(seed), world.cast("string"), F.lit(place).cast("string") if isinstance(place, int) else place.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def draw_sql(seed: str, world: str, place: str | int, n: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {world} || ':' || {place}), 1, 8))::BIGINT % {n})"


def items(spark: SparkSession, seed: str, n: int = WORLDS) -> DataFrame:
    """Worlds of ITEMS items (place, price, rating, distance) as an array; distinct prices by a place in the last digit."""
    w = F.col("id")
    item = lambda i: F.struct(
        i.cast("long").alias("i"), (draw(seed, w, i, 900) * 10 + i).alias("price"), (draw(f"{seed}r", w, i, 40) + 10).alias("rating"), (draw(f"{seed}d", w, i, 30) + 1).alias("distance")
    )
    return spark.range(n).select(w.alias("world"), F.transform(F.sequence(F.lit(0), F.lit(ITEMS - 1)), item).alias("items"))


def items_sql(seed: str, n: int = WORLDS) -> str:
    return f"""it AS (SELECT w.w AS world, i.i AS i, {draw_sql(seed, 'w.w', 'i.i', 900)} * 10 + i.i AS price, {draw_sql(seed + 'r', 'w.w', 'i.i', 40)} + 10 AS rating,
        {draw_sql(seed + 'd', 'w.w', 'i.i', 30)} + 1 AS distance FROM range({n}) w(w), range({ITEMS}) i(i))"""


@query("sort_shuffle_seeded", "SELECT doc_id, sha256('29:' || doc_id) AS place FROM documents")
def shuffle_seeded(spark, sf):
    """A seeded shuffle of a whole table: a range-partitioned sort by hash."""
    return table(spark, sf, "documents").select("doc_id", T.seeded_hash(29, F.col("doc_id")).alias("place")).orderBy("place", "doc_id")


@query("gen_relative_menu", f"""WITH {items_sql('menu')}, ref AS (SELECT world, price, rating, distance FROM it WHERE i = 0),
    o AS (SELECT it.*, ref.price AS rp, ref.rating AS rr, ref.distance AS rd FROM it JOIN ref ON it.world = ref.world WHERE it.i > 0),
    c AS (SELECT world, i, CASE world % 3 WHEN 0 THEN price WHEN 1 THEN abs(price - rp) ELSE price END AS v FROM o WHERE world % 3 <> 0 OR distance < rd),
    r AS (SELECT world, i, row_number() OVER (PARTITION BY world ORDER BY v, i) AS k FROM c)
    SELECT w.world, CASE w.world % 3 WHEN 0 THEN 'filtered_min' WHEN 1 THEN 'nearest' ELSE 'second' END AS kind, r.i AS gold
    FROM (SELECT DISTINCT world FROM it) w LEFT JOIN r ON w.world = r.world AND r.k = CASE WHEN w.world % 3 = 2 THEN 2 ELSE 1 END""")
def relative_menu(spark, sf):
    """Menus relative to a reference item: the cheapest that is nearer, the nearest price, the second cheapest."""
    ref, kind = F.get("items", F.lit(0)), F.col("world") % 3
    others = F.filter(F.slice("items", 2, ITEMS - 1), lambda x: (kind != 0) | (x["distance"] < ref["distance"]))
    ranked = F.array_sort(F.transform(others, lambda x: F.struct(F.when(kind == 1, F.abs(x["price"] - ref["price"])).otherwise(x["price"]).alias("v"), x["i"].alias("i"))))
    name = F.when(kind == 0, "filtered_min").when(kind == 1, "nearest").otherwise("second")
    return items(spark, "menu").select("world", name.alias("kind"), F.get(ranked, F.when(kind == 2, 1).otherwise(0))["i"].alias("gold"))


@query("gen_rank", f"""WITH {items_sql('rank')}, a AS (SELECT world, i, CASE world % 3 WHEN 0 THEN price WHEN 1 THEN rating * 10 + i ELSE distance * 10 + i END AS v FROM it),
    z AS (SELECT world, v AS v0 FROM a WHERE i = 0), r AS (SELECT a.world, i, v, v0, row_number() OVER (PARTITION BY a.world ORDER BY v) AS k FROM a JOIN z ON a.world = z.world)
    SELECT world, CASE world % 5 WHEN 0 THEN 'pair' WHEN 1 THEN 'count' WHEN 2 THEN 'kth' WHEN 3 THEN 'closest' ELSE 'median' END AS kind,
      CASE world % 5 WHEN 0 THEN arg_max(i, v) FILTER (WHERE i < 2) WHEN 1 THEN count(*) FILTER (WHERE v > v0) WHEN 2 THEN max(i) FILTER (WHERE k = 2)
        WHEN 3 THEN arg_min(i, abs(v - v0) * 10 + i) FILTER (WHERE i > 0) ELSE max(i) FILTER (WHERE k = 3) END AS gold FROM r GROUP BY world""")
def gen_rank(spark, sf):
    """Five kinds of rank questions over three attributes."""
    a, kind = F.col("world") % 3, F.col("world") % 5
    value = lambda x: F.when(a == 0, x["price"]).when(a == 1, x["rating"] * 10 + x["i"]).otherwise(x["distance"] * 10 + x["i"])
    w = items(spark, "rank").select("world", F.transform("items", lambda x: F.struct(value(x).alias("v"), x["i"].alias("i"))).alias("vs"))
    v0, ranked = F.get("vs", F.lit(0))["v"], F.array_sort("vs")
    near = F.array_min(F.transform(F.slice("vs", 2, ITEMS - 1), lambda x: F.struct(F.abs(x["v"] - v0).alias("d"), x["i"].alias("i"))))["i"]
    gold = (
        F.when(kind == 0, F.array_max(F.slice("vs", 1, 2))["i"]).when(kind == 1, F.size(F.filter("vs", lambda x: x["v"] > v0)).cast("long"))
        .when(kind == 2, F.get(ranked, F.lit(1))["i"]).when(kind == 3, near).otherwise(F.get(ranked, F.lit(ITEMS // 2))["i"])
    )
    name = F.when(kind == 0, "pair").when(kind == 1, "count").when(kind == 2, "kth").when(kind == 3, "closest").otherwise("median")
    return w.select("world", name.alias("kind"), gold.alias("gold"))


@query("gen_temporal", f"""WITH w AS (SELECT w, DATE '2023-12-15' + {draw_sql('day', 'w', 0, 500)}::INT AS d, {draw_sql('len', 'w', 1, 60)} AS n, {draw_sql('amt', 'w', 2, 100000)} AS amount FROM range({WORLDS}) r(w))
    SELECT w AS world, CASE w % 7
      WHEN 0 THEN CASE WHEN d + n::INT < DATE '2024-12-31' THEN 'in_time' ELSE 'late' END
      WHEN 1 THEN (d + to_months(n::INT))::DATE::VARCHAR
      WHEN 2 THEN 'week ' || weekofyear(d)
      WHEN 3 THEN CASE WHEN (year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0)) THEN 'leap' ELSE 'common' END
      WHEN 4 THEN CASE WHEN n <= 2 THEN 'letter' WHEN n <= 20 THEN 'parcel' ELSE 'freight' END
      WHEN 5 THEN (amount * greatest(0, 365 - n * 7) // 365)::VARCHAR
      ELSE (SELECT count(*) FROM generate_series(d, (d + n::INT)::DATE, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6)::VARCHAR END AS gold FROM w""")
def gen_temporal(spark, sf):
    """Deadlines, terms with a clamped end of month, ISO weeks, leap years, bands, prorated cents and business days."""
    w = F.col("world")
    t = spark.range(WORLDS).select(F.col("id").alias("world"))
    t = t.select("world", F.date_add(F.lit("2023-12-15").cast("date"), draw("day", w, 0, 500).cast("int")).alias("d"), draw("len", w, 1, 60).alias("n"), draw("amt", w, 2, 100000).alias("amount"))
    until, kind = F.date_add("d", F.col("n").cast("int")), w % 7
    leap = F.dayofmonth(F.last_day(F.make_date(F.year("d"), F.lit(2), F.lit(1)))) == 29
    working = F.size(F.filter(F.sequence(F.col("d"), until), lambda x: F.weekday(x) < 5))
    gold = (
        F.when(kind == 0, F.when(until < F.lit("2024-12-31").cast("date"), "in_time").otherwise("late"))
        .when(kind == 1, F.add_months("d", F.col("n").cast("int")).cast("string"))
        .when(kind == 2, F.concat(F.lit("week "), F.weekofyear("d").cast("string")))
        .when(kind == 3, F.when(leap, "leap").otherwise("common"))
        .when(kind == 4, F.when(F.col("n") <= 2, "letter").when(F.col("n") <= 20, "parcel").otherwise("freight"))
        .when(kind == 5, F.floor(F.col("amount") * F.greatest(F.lit(0), 365 - F.col("n") * 7) / 365).cast("string"))
        .otherwise(working.cast("string"))
    )
    return t.select("world", gold.alias("gold"))


@query("gen_probability", f"""WITH w AS (SELECT w, {draw_sql('a', 'w', 0, 20)} + 10 AS n, {draw_sql('b', 'w', 1, 9)} + 1 AS k, {draw_sql('c', 'w', 2, 5)} + 1 AS m, ({draw_sql('p', 'w', 3, 90)} + 5) / 100.0::DOUBLE AS p, ({draw_sql('q', 'w', 4, 90)} + 5) / 100.0::DOUBLE AS q FROM range({WORLDS}) r(w))
    SELECT w AS world, round(CASE w % 4
      WHEN 0 THEN 1 - list_product(list_transform(range(0, m), lambda j: greatest(0, n - k - j)::DOUBLE / (n - j)))
      WHEN 1 THEN p * q
      WHEN 2 THEN p * q / (p * q + (1 - p) * (1 - q))
      ELSE 1 - (1 - p) ** m END, 6)::DOUBLE AS gold FROM w""")
def gen_probability(spark, sf):
    """Draws without replacement, stages in a row, Bayes' rule and at least one success in m trials, in closed form."""
    w = F.col("world")
    t = spark.range(WORLDS).select(F.col("id").alias("world"))
    t = t.select("world", (draw("a", w, 0, 20) + 10).alias("n"), (draw("b", w, 1, 9) + 1).alias("k"), (draw("c", w, 2, 5) + 1).alias("m"), ((draw("p", w, 3, 90) + 5) / 100).alias("p"), ((draw("q", w, 4, 90) + 5) / 100).alias("q"))
    none = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), F.lit(1.0), lambda s, j: s * F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("k") - j) / (F.col("n") - j))
    p, q, kind = F.col("p"), F.col("q"), w % 4
    gold = F.when(kind == 0, 1 - none).when(kind == 1, p * q).when(kind == 2, p * q / (p * q + (1 - p) * (1 - q))).otherwise(1 - F.pow(1 - p, F.col("m")))
    return t.select("world", F.round(gold, 6).alias("gold"))


@query("gen_minimal_pair", f"""WITH w AS (SELECT w, {draw_sql('x', 'w', 0, 50)} AS a, {draw_sql('x', 'w', 1, 50)} AS b FROM range({WORLDS}) r(w))
    SELECT w AS world, CASE WHEN a > b THEN 'first' ELSE 'second' END AS gold, CASE WHEN a > 2 * a - b THEN 'first' ELSE 'second' END AS twin_gold, 1::BIGINT AS changed FROM w WHERE a <> b""")
def minimal_pair(spark, sf):
    """Twins of the same draws with one value flipped about the other: few words differ, options agree, gold does not."""
    w = F.col("world")
    t = spark.range(WORLDS).select(F.col("id").alias("world"))
    t = t.select("world", draw("x", w, 0, 50).alias("a"), draw("x", w, 1, 50).alias("b")).withColumn("c", 2 * F.col("a") - F.col("b"))
    state = lambda v: F.concat(F.lit("the first costs "), F.col("a").cast("string"), F.lit(" and the second "), v.cast("string"), F.lit(" per piece"))
    gold = lambda v: F.when(F.col("a") > v, "first").otherwise("second")
    changed = F.size(F.filter(F.zip_with(F.split(state(F.col("b")), " "), F.split(state(F.col("c")), " "), lambda x, y: x != y), lambda d: d)).cast("long")
    t = t.select("world", gold(F.col("b")).alias("gold"), gold(F.col("c")).alias("twin_gold"), changed.alias("changed"))
    return t.where("changed BETWEEN 1 AND 8 AND gold <> twin_gold")


@query("calibrate_remote", f"""WITH {pred_sql('base')}, s AS (SELECT id, grp, t, p, list_transform(p, lambda x: ln(greatest(x, 1e-12))) AS z FROM base), even AS (SELECT * FROM s WHERE grp % 2 = 0), {fit_sql('fit', 'even')},
    e AS (SELECT id, p, list_transform(z, lambda x: exp(x / temperature)) AS e FROM s, fit WHERE grp % 2 = 1)
    SELECT id, list_transform(p, lambda x: round(x, 6)) AS raw, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS calibrated FROM e""")
def calibrate_remote(spark, sf):
    """Raw probabilities stay; a temperature of ln max(p, 1e-12) is fitted on even groups, never on the panel (odd ones)."""
    s = predictions(spark, sf).withColumn("z", F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(1e-12)))))
    fitted = S.fit_temperature(s.where("grp % 2 = 0")).select("temperature")
    panel = s.where("grp % 2 = 1").crossJoin(F.broadcast(fitted))  # one row
    e = F.transform("z", lambda x: F.exp(x / F.col("temperature")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    r6 = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return panel.select("id", r6(F.col("p")).alias("raw"), r6(F.transform(e, lambda x: x / total)).alias("calibrated"))


@query("audit_stage", "SELECT * FROM (VALUES ('labels', true, true, 'complete'), ('nation', false, true, 'config'), ('region', true, false, 'hash'), ('lost', true, false, 'missing')) t(stage, config_ok, files_ok, verdict)")
def audit_stage(spark, sf):
    """Recorded stages against their files: a stage is complete if its config and the SHA-256 of its file still hold."""
    from loomline.sources.requests import file_manifest

    now = None
    for name in ("labels", "nation", "region"):
        one = file_manifest(spark, f"{sf}/{name}.parquet").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ","), 256).alias("now")).withColumn("stage", F.lit(name))
        now = one if now is None else now.unionByName(one)
    # The record: a changed config, a changed file and a lost stage beside a sound one.
    record = now.select("stage", F.when(F.col("stage") == "region", F.sha2("now", 256)).otherwise(F.col("now")).alias("hash"), F.when(F.col("stage") == "nation", "seed=18").otherwise("seed=17").alias("config"))
    record = record.unionByName(spark.range(1).select(F.lit("lost").alias("stage"), F.lit("").alias("hash"), F.lit("seed=17").alias("config")))
    told = record.join(F.broadcast(now), "stage", "left")  # one row for each stage
    told = told.select("stage", (F.col("config") == "seed=17").alias("config_ok"), F.coalesce(F.col("hash") == F.col("now"), F.lit(False)).alias("files_ok"), F.col("now").isNull().alias("lost"))
    return told.select("stage", "config_ok", "files_ok", F.when(F.col("lost"), "missing").when(~F.col("config_ok"), "config").when(~F.col("files_ok"), "hash").otherwise("complete").alias("verdict"))


@query("json_path_collect", "SELECT event_type AS arm, user_id % 3 AS seed, count(*) AS n, count(json_extract_string(props, '$.k')) AS found, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(json_extract_string(props, '$.no.such')) AS nested FROM events GROUP BY 1, 2")
def json_path_collect(spark, sf):
    """A metric by path out of nested JSON over arms and seeds; a missing path is null."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("seed"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.no.such").alias("x"))
    return e.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("found"), F.sum(F.col("k").cast("long")).alias("k"), F.count("x").alias("nested"))


@query("retry_once", f"""WITH a AS (SELECT event_type, value, {draw_sql('try', 'event_id', 0, 4)} = 0 AS f1, {draw_sql('try', 'event_id', 1, 4)} = 0 AS f2 FROM events)
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE f1) AS retried, count(*) FILTER (WHERE f1 AND f2) AS errors, round(sum(CASE WHEN f1 AND f2 THEN 0 ELSE value END) / count(*), 6) AS mean_value FROM a GROUP BY 1""")
def retry_once(spark, sf):
    """Two attempts each; a row that fails both is an error of value zero that still counts in n."""
    e = table(spark, sf, "events")
    e = e.select("event_type", "value", *((draw("try", F.col("event_id"), k, 4) == 0).alias(f"f{k}") for k in (0, 1)))
    failed = F.col("f0") & F.col("f1")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("f0").alias("retried"), F.count_if(failed).alias("errors"), F.round(F.sum(F.when(failed, 0.0).otherwise(F.col("value"))) / F.count(F.lit(1)), 6).alias("mean_value")
    )


SPLIT_SQL = f"CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE 'train' END"


@query("conv_study_split", f"""WITH {D}, l AS (SELECT d.doc_id, h, sha256('17:' || h) AS x, quality FROM d LEFT JOIN labels USING (doc_id)),
    q AS (SELECT h, count(DISTINCT quality) AS labels FROM l GROUP BY h)
    SELECT CASE WHEN quality IS NULL THEN 'drop:unlabelled' WHEN labels > 1 THEN 'drop:conflict' ELSE {SPLIT_SQL} END AS outcome, count(*) AS n FROM l JOIN q USING (h) GROUP BY 1""")
def study_split(spark, sf):
    """Labelled documents to splits, with a report of what was dropped and why."""
    l = docs(spark, sf).select("doc_id", "h").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = l.groupBy("h").agg((F.min("quality") != F.max("quality")).alias("conflict"))
    outcome = F.when(F.col("quality").isNull(), "drop:unlabelled").when(F.col("conflict"), "drop:conflict").otherwise(C.split10(F.col("h"), 17))
    return l.join(q, "h").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("pipe_study", f"""WITH {CLEAN}, t AS (SELECT doc_id, source, h FROM clean), x AS (SELECT source, doc_id, sha256('17:' || h) AS x FROM t)
    SELECT 'kept' AS step, source, {SPLIT_SQL} AS split, count(*) AS n FROM x GROUP BY 2, 3
    UNION ALL SELECT 'dropped', source, 'none', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t) GROUP BY 2""")
def pipe_study(spark, sf):
    """Dedup, leak removal, split and a drop report: the manifest of a study's data."""
    clean = clean_docs(spark, sf).select("doc_id", "source", "h")
    kept = clean.groupBy(F.lit("kept").alias("step"), "source", C.split10(F.col("h"), 17).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    every = table(spark, sf, "documents").select("doc_id", "source").join(clean.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(every.groupBy(F.lit("dropped").alias("step"), "source", F.lit("none").alias("split")).agg(F.count(F.lit(1)).alias("n")))


@query("pipe_multilingual", f"""WITH {D}, s AS (SELECT doc_id, lang, h, sha256('17:' || h) AS x FROM d), t AS (SELECT doc_id, lang, h, {SPLIT_SQL} AS split, doc_id % 10 = 0 AS test FROM s),
    barred AS (SELECT DISTINCT h FROM t WHERE test), one AS (SELECT min(doc_id) AS doc_id, lang, h, min(split) AS split FROM t WHERE h NOT IN (SELECT h FROM barred) GROUP BY lang, h),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || h), h) AS k FROM one)
    SELECT lang, split, count(*) AS n FROM r WHERE k <= 200 GROUP BY 1, 2 UNION ALL SELECT lang, 'test', count(DISTINCT h) FROM t WHERE test GROUP BY 1""")
def pipe_multilingual(spark, sf):
    """A bounded take for each language of states that no test row holds, split by hash, beside the test counts."""
    d = docs(spark, sf).select("doc_id", "lang", "h")
    test = d.where("doc_id % 10 = 0")
    one = C.drop_exact_leaks(d, "h", test, "h").groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    took = C.take_per(one, "lang", "h", 11, 200).groupBy("lang", C.split10(F.col("h"), 17).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return took.unionByName(test.select("lang", "h").distinct().groupBy("lang").agg(F.lit("test").alias("split"), F.count(F.lit(1)).alias("n")))


@query("pipe_gapcells", f"""WITH w AS (SELECT w, sha256('gap:' || w) AS x, {draw_sql('gap', 'w', 0, 4)} AS cell, {draw_sql('gap', 'w', 1, 3)} AS style FROM range(4000) r(w))
    SELECT 'cell' || cell AS cell, CASE {m10('x')} WHEN 7 THEN 'dev' WHEN 8 THEN 'calibration' WHEN 9 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT style) AS styles FROM w GROUP BY 1, 2""")
def pipe_gapcells(spark, sf):
    """Four cells of generated rows in four splits, with the styles each covers."""
    w = F.col("id")
    t = spark.range(4000).select(F.concat(F.lit("cell"), draw("gap", w, 0, 4).cast("string")).alias("cell"), T.hex_mod10(T.seeded_hash("gap", w)).alias("b"), draw("gap", w, 1, 3).alias("style"))
    split = F.when(F.col("b") == 7, "dev").when(F.col("b") == 8, "calibration").when(F.col("b") == 9, "test").otherwise("train")
    return t.groupBy("cell", split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("style").alias("styles"))


@query("pipe_longcontext", f"""WITH d AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, {draw_sql('depth', 'doc_id', 0, 5)} * 25 AS depth FROM documents)
    SELECT CASE WHEN w < 64 THEN 64 WHEN w < 256 THEN 256 WHEN w < 1024 THEN 1024 WHEN w < 4096 THEN 4096 ELSE 16384 END AS length, depth, count(*) AS n, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean,
      sum(w * depth // 100)::BIGINT AS words_before FROM d GROUP BY 1, 2""")
def pipe_longcontext(spark, sf):
    """The length by depth grid of a long-context build with statistics of its words."""
    d = table(spark, sf, "documents").select(F.size(T.words(F.col("text"))).cast("long").alias("w"), (draw("depth", F.col("doc_id"), 0, 5) * 25).alias("depth"))
    length = F.when(F.col("w") < 64, 64).when(F.col("w") < 256, 256).when(F.col("w") < 1024, 1024).when(F.col("w") < 4096, 4096).otherwise(16384)
    before = F.sum(F.floor(F.col("w") * F.col("depth") / 100))
    return d.groupBy(length.alias("length"), "depth").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 6).alias("mean"), before.alias("words_before"))


VARIANTS = ("upper", "spaces", "lines", "prefix", "suffix", "reverse")


@query("pipe_robustness", f"""WITH {D}, one AS (SELECT min(doc_id) AS doc_id, h FROM d GROUP BY h), t AS (SELECT d.doc_id, text, {draw_sql('variant', 'd.doc_id', 0, 6)} AS v FROM d JOIN one USING (doc_id)),
    p AS (SELECT doc_id, v, text, CASE v WHEN 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN replace(text, chr(10), ' ')
      WHEN 3 THEN 'Note: ' || text WHEN 4 THEN text || ' End.' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS changed FROM t)
    SELECT ['upper', 'spaces', 'lines', 'prefix', 'suffix', 'reverse'][v + 1] AS variant, count(*) AS pairs, count(*) FILTER (WHERE text <> changed) AS differ, sum(strlen(changed))::BIGINT AS bytes FROM p GROUP BY 1""")
def pipe_robustness(spark, sf):
    """Each distinct state with one of six variants; a variant stays with its clean twin, so groups never cross."""
    one = docs(spark, sf).groupBy("h").agg(F.min(F.struct("doc_id", "text")).alias("m")).select(F.col("m.doc_id").alias("doc_id"), F.col("m.text").alias("text"))
    v, t = draw("variant", F.col("doc_id"), 0, 6), F.col("text")
    lower = "abcdefghijklmnopqrstuvwxyz"
    changed = (
        F.when(F.col("v") == 0, F.translate(t, lower, lower.upper())).when(F.col("v") == 1, F.replace(t, F.lit(" "), F.lit("  "))).when(F.col("v") == 2, F.replace(t, F.lit("\n"), F.lit(" ")))
        .when(F.col("v") == 3, F.concat(F.lit("Note: "), t)).when(F.col("v") == 4, F.concat(t, F.lit(" End."))).otherwise(F.array_join(F.reverse(F.split(t, " ", -1)), " "))
    )
    p = one.withColumn("v", v).select(F.get(F.array(*map(F.lit, VARIANTS)), F.col("v").cast("int")).alias("variant"), "text", changed.alias("changed"))
    return p.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("text") != F.col("changed")).alias("differ"), F.sum(F.octet_length("changed").cast("long")).alias("bytes"))


@query("pipe_browser", """WITH t AS (SELECT conv_id, turn, text, CASE conv_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM conversations),
    clean AS (SELECT * FROM t WHERE split = 'train' OR text NOT IN (SELECT text FROM t WHERE split = 'train')),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('23:' || doc_id), doc_id) AS k FROM documents)
    SELECT split, 'task' AS origin, count(*) AS n FROM clean GROUP BY 1 UNION ALL SELECT 'train', 'replay', count(*) FROM r WHERE k <= 25""")
def pipe_browser(spark, sf):
    """Whole tasks go to one split, held-out turns that training holds are dropped, and replay rows join the training side."""
    b = F.col("conv_id") % 10
    t = table(spark, sf, "conversations").select("text", F.when(b == 8, "dev").when(b == 9, "test").otherwise("train").alias("split"))
    held = C.drop_exact_leaks(t.where("split <> 'train'"), "text", t.where("split = 'train'"), "text")
    rows = t.where("split = 'train'").unionByName(held).groupBy("split").agg(F.lit("task").alias("origin"), F.count(F.lit(1)).alias("n"))
    replay = C.take_per(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 23, 25)
    return rows.unionByName(replay.agg(F.lit("train").alias("split"), F.lit("replay").alias("origin"), F.count(F.lit(1)).alias("n")))


@query("pipe_workflows", f"""WITH w AS (SELECT w, w % 4 AS kind, {draw_sql('flow', 'w', 0, 40)} AS a, {draw_sql('flow', 'w', 1, 20)} AS b FROM range(3000) r(w)),
    one AS (SELECT min(w) AS w, kind, a, b FROM w GROUP BY kind, a, b), s AS (SELECT kind, sha256('31:' || (kind || '/' || a || '/' || b)) AS x FROM one)
    SELECT kind, CASE WHEN {m10('x')} >= 8 THEN 'heldout' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY 1, 2""")
def pipe_workflows(spark, sf):
    """Worlds dealt round-robin over four workflows, unique by state, held out by state hash."""
    w = F.col("id")
    t = spark.range(3000).select(w, (w % 4).alias("kind"), F.concat_ws("/", (w % 4).cast("string"), draw("flow", w, 0, 40).cast("string"), draw("flow", w, 1, 20).cast("string")).alias("state"))
    one = C.dedup_first(t, "state", "id")
    split = F.when(T.hex_mod10(T.seeded_hash(31, F.col("state"))) >= 8, "heldout").otherwise("train")
    return one.groupBy("kind", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("pipe_probes", f"""WITH p AS (SELECT c.conv_id, v.v AS variant, sha256('probe:' || (c.conv_id || '/' || v.v)) AS k FROM (SELECT DISTINCT conv_id FROM conversations) c, range(3) v(v)),
    t AS (SELECT *, {draw_sql('done', 'conv_id', 'variant', 3)} = 0 AS done FROM p), r AS (SELECT conv_id, variant FROM t WHERE NOT done ORDER BY k, conv_id, variant LIMIT 40)
    SELECT variant, count(*) AS planned, count(*) FILTER (WHERE done) AS done, count(r.conv_id) AS run, count(*) FILTER (WHERE NOT done) - count(r.conv_id) AS left_over
    FROM t LEFT JOIN r USING (conv_id, variant) GROUP BY variant""")
def pipe_probes(spark, sf):
    """Plan, resume (done jobs are not run again), run within a budget of 40 jobs by hashed order, and summarise."""
    plan = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("variant"))
    plan = plan.withColumn("done", draw("done", F.col("conv_id"), F.col("variant"), 3) == 0)
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("variant").cast("string"))
    run = plan.where("NOT done").orderBy(T.seeded_hash("probe", key), "conv_id", "variant").limit(40).select("conv_id", "variant", F.lit(1).alias("run"))
    told = plan.join(F.broadcast(run), ["conv_id", "variant"], "left")  # the budget bounds it
    return told.groupBy("variant").agg(F.count(F.lit(1)).alias("planned"), F.count_if("done").alias("done"), F.count("run").alias("run"), (F.count_if(~F.col("done")) - F.count("run")).alias("left_over"))


@query("src_csv", "SELECT n_nationkey::BIGINT AS k, n_name AS name, 'line one' || chr(10) || 'says \"' || n_name || '\"' AS note FROM nation")
def src_csv(spark, sf):
    """CSV with quoted line ends and quotes, written and read back."""
    from loomline.sources.requests import read_csv
    from loomline.sources.shared import shared_path

    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.concat(F.lit('line one\nsays "'), "n_name", F.lit('"')).alias("note"))
    path = shared_path(spark, "csv")
    n.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(spark, path, "k long, name string, note string")


@query("src_tsv_graph", "SELECT n_name AS source, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_tsv_graph(spark, sf):
    """A tab-separated edge list with comment lines."""
    from loomline.sources.requests import read_edges
    from loomline.sources.shared import shared_path

    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    edges = table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # a fixed table
    path = shared_path(spark, "edges")
    lines = edges.select(F.concat_ws("\t", "n_name", "r_name").alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("# a comment").alias("value"))).write.text(path)
    return read_edges(spark, path)


@query("src_jsonl_meta", "SELECT doc_id, quality::BIGINT AS quality, 'two' || chr(8232) || 'parts' AS note FROM labels")
def src_jsonl_meta(spark, sf):
    """Raw rows with all their keys; U+2028 inside a value does not end a line."""
    from loomline.sources.requests import read_raw
    from loomline.sources.shared import shared_path

    path = shared_path(spark, "raw")
    table(spark, sf, "labels").select(F.to_json(F.struct("doc_id", "quality", F.lit("two\u2028parts").alias("note"))).alias("value")).write.text(path)
    f = F.col("fields")
    return read_raw(spark, path).select(f["doc_id"].cast("long").alias("doc_id"), f["quality"].cast("long").alias("quality"), f["note"].alias("note"))


@query("src_multi_format", "SELECT CASE doc_id % 3 WHEN 0 THEN 'next_click' WHEN 1 THEN 'benchmark' ELSE 'request' END AS format, count(*) AS n FROM labels GROUP BY 1")
def src_multi_format(spark, sf):
    """Three formats told apart by their keys."""
    from loomline.sources.requests import read_mixed
    from loomline.sources.shared import shared_path

    path, k = shared_path(spark, "mixed"), F.col("doc_id") % 3
    row = F.when(k == 0, F.to_json(F.struct(F.lit("c").alias("context"), "doc_id"))).when(k == 1, F.to_json(F.struct(F.array(F.lit("a")).alias("labels"), "doc_id"))).otherwise(F.to_json(F.struct(F.lit("s").alias("state"), "doc_id")))
    table(spark, sf, "labels").select(row.alias("value")).write.text(path)
    return read_mixed(spark, path).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("src_glob", "SELECT 'nation.parquet' AS file UNION ALL SELECT 'region.parquet'")
def src_glob(spark, sf):
    """A pattern resolved to the files that exist, in order."""
    files = spark.read.format("binaryFile").load(f"{sf}/{{nation,region,no_such}}.parquet")
    return files.select(F.regexp_extract("path", r"([a-z_]+\.parquet)", 1).alias("file")).distinct().orderBy("file")


@query("src_image", "SELECT vec_id, 4::BIGINT AS bytes, substr(sha256('v' || lpad((vec_id % 1000)::VARCHAR, 3, '0')), 1, 16) AS digest FROM embeddings")
def src_image(spark, sf):
    """Images as base64, strictly decoded."""
    from loomline.sources.requests import read_images

    raw = F.concat(F.lit("v"), F.lpad((F.col("vec_id") % 1000).cast("string"), 3, "0"))
    i = table(spark, sf, "embeddings").select("vec_id", F.base64(raw.cast("binary")).alias("base64"), F.lit(None).cast("string").alias("path"))
    return read_images(i).select("vec_id", F.length("data").cast("long").alias("bytes"), F.substring(F.sha2("data", 256), 1, 16).alias("digest"))


@query("snk_jsonl", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def snk_jsonl(spark, sf):
    """Whole texts written as JSON lines in UTF-8 and read back unchanged."""
    from loomline.sources.shared import shared_path

    path = shared_path(spark, "jsonl")
    table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.mode("errorifexists").text(path)
    return spark.read.schema("doc_id long, text string").option("mode", "FAILFAST").json(path).where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
