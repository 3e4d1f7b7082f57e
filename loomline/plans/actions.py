"""Remote calls, episodes and hops, sinks, and column functions that no other plan uses."""

from __future__ import annotations

import io
import zipfile
from datetime import date

from pyspark.sql import functions as F

from loomline.functions import dates as DT
from loomline.functions import geometry as G
from loomline.functions import text as T
from loomline.operators import decisions as DE
from loomline.operators import episodes as E
from loomline.plans.facts import pred_sql, predictions
from loomline.plans.registry import query, table


@query("src_zip_member", "SELECT 'a/nations.jsonl' AS member, n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def src_zip_member(spark, sf):
    """JSON lines inside an archive with other members, which Hadoop's writer puts into the shared folder."""
    from loomline.sources.requests import read_zip_lines
    from loomline.sources.shared import shared_path

    rows = table(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")))).collect()  # a fixed table
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/nations.jsonl", "\n".join(r[0] for r in rows) + "\n\n")
        z.writestr("readme.txt", "not JSON\n")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "zip") + "/rows.zip")  # noqa: SLF001
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)  # noqa: SLF001
    out.write(bytearray(content.getvalue()))
    out.close()
    lines = read_zip_lines(spark, path.toString()).select("member", F.from_json("line", "k long, name string").alias("r"))
    return lines.select("member", "r.k", "r.name")


@query("snk_refuse_overwrite", "SELECT (SELECT count(*) FROM region) AS kept, true AS refused")
def snk_refuse_overwrite(spark, sf):
    """A second write to the same path fails and leaves the first as it is."""
    from pyspark.errors import AnalysisException

    from loomline.operators import requests as Q
    from loomline.sources.requests import read_requests, write_requests
    from loomline.sources.shared import shared_path

    path, k = shared_path(spark, "once"), F.col("r_regionkey")
    rows = table(spark, sf, "region").select(F.col("r_name").alias("state"), F.concat(F.lit("r:"), k.cast("string")).alias("group_id"), F.array(Q.noul("odd", "Is it odd?", (k % 2).cast("double"))).alias("questions"))
    write_requests(rows, path)
    try:
        write_requests(rows.limit(0), path)
        refused = False
    except AnalysisException as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return read_requests(spark, path).agg(F.count(F.lit(1)).alias("kept")).withColumn("refused", F.lit(refused))


@query("snk_markdown", "SELECT 0::BIGINT AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def snk_markdown(spark, sf):
    from loomline.sources.requests import markdown

    lines = markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


def transport(payload: str, attempt: int) -> tuple[int, str]:
    """A remote that answers, is busy, is busy once, breaks off or refuses, by the number in the payload."""
    n = int(payload.split(":")[1])
    if n % 7 == 2:
        raise ConnectionResetError
    status = 429 if n % 7 == 0 else 503 if n % 7 == 1 and attempt == 1 else 400 if n % 7 == 3 else 200
    return status, f"ok {payload}"


@query("src_http_cached", """WITH d AS (SELECT doc_id, doc_id % 500 AS n FROM documents)
    SELECT doc_id, n % 5 = 0 AS cache_hit, CASE WHEN n % 5 = 0 THEN 200 WHEN n % 7 = 0 THEN 429 WHEN n % 7 = 2 THEN NULL WHEN n % 7 = 3 THEN 400 ELSE 200 END AS status,
      CASE WHEN n % 5 = 0 THEN 'kept' WHEN n % 7 IN (0, 2, 3) THEN NULL ELSE 'ok n:' || n END AS body,
      CASE WHEN n % 5 = 0 THEN 1 WHEN n % 7 = 0 THEN 3 WHEN n % 7 = 1 THEN 2 ELSE 1 END AS attempts,
      CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 2 THEN 'transport_error' WHEN n % 7 IN (0, 3) THEN 'http_error' END AS error FROM d""")
def src_http_cached(spark, sf):
    """Distinct payloads that no cache holds are sent, with three attempts where the answer allows it."""
    from loomline.operators.remote import call_remote

    payload = lambda n: F.concat(F.lit("n:"), n.cast("string"))
    cache = spark.range(0, 500, 5).select(F.sha2(payload(F.col("id")), 256).alias("key"), F.lit(200).alias("status"), F.lit("kept").alias("body"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"))
    rows = table(spark, sf, "documents").select("doc_id", payload(F.col("doc_id") % 500).alias("payload"))
    return call_remote(rows, cache, transport, pause=0.0)[0].select("doc_id", "cache_hit", "status", "body", "attempts", "error")


def short_of_memory(states, instructions, options):
    """A scorer that takes one row at a time, and none of those that end in 7."""
    if len(states) > 1 or states[0].endswith("7"):
        raise MemoryError
    return [[1.0 / len(o)] * len(o) for o in options]


@query("st_retry_oom", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 7 THEN 0 ELSE 2 + c_custkey % 3 END::BIGINT AS k FROM customer")
def st_retry_oom(spark, sf):
    """Batches that do not fit are tried again, then row by row; a row that never fits has no distribution."""
    from loomline.operators.remote import Resilient
    from loomline.operators.scorer import score

    n = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(n, n.cast("string").alias("state"), F.lit("Which?").alias("instructions"), F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (2 + n % 3).cast("int")).alias("options"))
    return score(rows, Resilient(short_of_memory)).select("c_custkey", F.size("probabilities").cast("long").alias("k"))


@query("st_episode", """WITH RECURSIVE w AS (SELECT vec_id, vec_id % 6 AS x, vec_id // 6 % 6 AS y, vec_id // 36 % 6 AS gx, vec_id // 216 % 6 AS gy, label % 6 AS hx, 2 * label % 6 AS hy, vec_id % 11 AS budget FROM embeddings),
    s AS (SELECT *, 0::BIGINT AS steps FROM w UNION ALL
      SELECT vec_id, x + sign(gx - x)::BIGINT, CASE WHEN x = gx THEN y + sign(gy - y)::BIGINT ELSE y END, gx, gy, hx, hy, budget, steps + 1 FROM s
      WHERE steps < budget AND NOT (x = gx AND y = gy) AND NOT (x = hx AND y = hy))
    SELECT vec_id, max(steps) AS steps, arg_max(x = gx AND y = gy, steps) AS success FROM s GROUP BY vec_id""")
def st_episode(spark, sf):
    """A greedy walk to a goal, first along x, that ends in the goal, in a hazard or with its budget."""
    v, l = F.col("vec_id"), F.col("label")
    place = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    w = table(spark, sf, "embeddings").select(v, place(v % 6, F.floor(v / 6) % 6).alias("at"), place(F.floor(v / 36) % 6, F.floor(v / 216) % 6).alias("goal"), place(l % 6, 2 * l % 6).alias("hazard"), (v % 11).alias("budget"))
    goal, toward = F.col("goal"), lambda a, b: (a + F.signum(b - a)).cast("long")
    step = lambda s: place(toward(s["x"], goal["x"]), F.when(s["x"] == goal["x"], toward(s["y"], goal["y"])).otherwise(s["y"]))
    ran = w.withColumn("r", E.episode(F.col("at"), F.col("budget"), step, lambda s: (s == goal) | (s == F.col("hazard"))))
    return ran.select("vec_id", F.col("r.steps").cast("long").alias("steps"), (F.col("r.state") == goal).alias("success"))


@query("route_hop", """WITH l AS (SELECT l_orderkey AS page, l_partkey::VARCHAR AS title, max(l_extendedprice)::DOUBLE AS score, (l_orderkey % 50)::VARCHAR AS target FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY title = target DESC, score DESC, title) AS k, count(*) OVER (PARTITION BY page) AS n, bool_or(title = target) OVER (PARTITION BY page) AS direct FROM l)
    SELECT page, title, CASE WHEN direct THEN 'direct' WHEN n <= 3 THEN 'choice' ELSE 'score_then_choice' END AS stage, CASE WHEN direct THEN 1 WHEN n <= 3 THEN n ELSE 2 END::BIGINT AS options FROM r WHERE k = 1""")
def route_hop(spark, sf):
    """The link that a greedy traveller takes from each page."""
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").cast("string").alias("title")).agg(F.max("l_extendedprice").cast("double").alias("score"))
    return E.hop(p.withColumn("target", (F.col("page") % 50).cast("string")), "page", "title", "target", "score", choice_limit=3, shortlist=2)


@query("baseline_zero_shot", """SELECT conv_id, turn, sha256('Choose the best answer to the question using the state. Answer with only the option letter.' || chr(10) || chr(10) || 'State:' || chr(10) || text || chr(10) || chr(10) || 'Question:' || chr(10) || 'Who speaks?'
    || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. [user] the user' || chr(10) || 'B. [assistant] the model' || chr(10) || chr(10) || 'Answer:') AS h FROM conversations""")
def baseline_zero_shot(spark, sf):
    """Prompts of the single-letter baseline."""
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in (("user", "the user"), ("assistant", "the model"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(E.letter_prompt(F.col("text"), F.lit("Who speaks?"), options), 256).alias("h"))


@query("gen_paraphrase", r"""SELECT conv_id, turn, CASE WHEN coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') = '' THEN 'blank' ELSE 'duplicate' END AS same, 'blank' AS empty,
    CASE WHEN text IS NULL THEN 'blank' ELSE 'accepted' END AS polite, CASE WHEN text IS NULL THEN 'blank' WHEN list_contains(regexp_extract_all(text, '\d+(?:[.,:]\d+)*'), '98765') THEN 'accepted' ELSE 'numbers' END AS numbered,
    CASE WHEN text IS NULL THEN 'blank' ELSE 'duplicate' END AS again FROM conversations""")
def gen_paraphrase(spark, sf):
    """Which rewrites of a text are accepted."""
    t = F.col("text")
    made = F.array(F.lower(t), F.lit(" \t"), F.concat(t, F.lit(" please")), F.concat(t, F.lit(" 98765")), F.concat(t, F.lit("  Please ")))
    judged = table(spark, sf, "conversations").select("conv_id", "turn", E.judged_rewrites(t, made).alias("j"))
    return judged.select("conv_id", "turn", *(F.col("j")[i]["verdict"].alias(n) for i, n in enumerate(("same", "empty", "polite", "numbered", "again"))))


@query("gen_evidence", """WITH r AS (SELECT l_orderkey AS o, l_linenumber AS id, l_quantity::DOUBLE AS q FROM lineitem), m AS (SELECT o, id, min(q) AS q FROM r GROUP BY ALL), c AS (SELECT o_orderkey AS o, o_orderkey % 3 AS kind, 1 + o_orderkey % 5 AS a, 1 + o_orderkey // 5 % 5 AS b FROM orders),
    j AS (SELECT c.*, ra.q AS qa, rb.q AS qb, (SELECT coalesce(sum(q), 0) FROM r WHERE r.o = c.o) AS total FROM c LEFT JOIN m ra ON ra.o = c.o AND ra.id = a LEFT JOIN m rb ON rb.o = c.o AND rb.id = b),
    h AS (SELECT o, CASE kind WHEN 0 THEN qa = 25 WHEN 1 THEN qa > qb ELSE total > 100 END AS holds FROM j)
    SELECT o AS o_orderkey, CASE WHEN holds IS NULL THEN 'not_addressed' WHEN holds THEN 'supported' ELSE 'contradicted' END AS verdict FROM h""")
def gen_evidence(spark, sf):
    """Claims about an order's lines: supported, contradicted or not addressed."""
    k, no = F.col("o_orderkey"), F.lit(None)
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").cast("double").alias("value"))).alias("records"))
    kind = F.when(k % 3 == 0, "equals").when(k % 3 == 1, "greater").otherwise("total")
    value = F.when(k % 3 == 0, 25.0).when(k % 3 == 2, 100.0).otherwise(no)
    claim = F.struct(kind.alias("kind"), (1 + k % 5).cast("long").alias("a"), (1 + F.floor(k / 5) % 5).cast("long").alias("b"), value.alias("value"))
    orders = table(spark, sf, "orders").select(k, claim.alias("claim")).join(lines, "o_orderkey", "left")
    return orders.select("o_orderkey", E.claim_verdict(F.col("claim"), F.coalesce("records", F.array().cast("array<struct<id: bigint, value: double>>"))).alias("verdict"))


HOLIDAYS = [date(y, m, d) for y in range(1992, 2000) for m, d in ((1, 1), (5, 1), (12, 25), (12, 26))]
_FREE = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)


@query("fn_dates", f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders),
    b AS (SELECT *, isodow(d) < 6 AND d NOT IN ({_FREE}) AND k % 2 = 1 AS first, list_filter(list_transform(range(1, 60), lambda i: (d + i::INT)::DATE), lambda x: isodow(x) < 6 AND x NOT IN ({_FREE})) AS days FROM o)
    SELECT k, (date_trunc('week', make_date(year(d), 1, 4)) + to_days((7 * (k % 52))::INT))::DATE AS monday, (d + (90 - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::INT)::DATE AS last_day,
      ((d + to_months((k % 37)::INT))::DATE + (k % 40)::INT)::DATE AS covered, CASE WHEN k % 15 - first::INT <= 0 THEN d ELSE days[k % 15 - first::INT] END::DATE AS due,
      CASE k % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%-d %B %Y') ELSE strftime(d, '%m/%d/%Y') END AS shown FROM b""")
def fn_dates(spark, sf):
    """ISO weeks, periods across leap days, months that clamp, working days with holidays, three renderings."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    k, d = F.col("k"), F.col("d")
    style = F.when(k % 3 == 0, "iso").when(k % 3 == 1, "long").otherwise("us")
    return o.select(
        "k", DT.iso_monday(F.year(d), k % 52 + 1).alias("monday"), DT.period_end(d, F.lit(90), k % 2 == 0).alias("last_day"), DT.coverage_end(d, (k % 37).cast("int"), k % 40).alias("covered"),
        DT.business_day_after(d, k % 15, HOLIDAYS, k % 2 == 1).alias("due"), DT.render_date(d, style).alias("shown"),
    )


@query("fn_bearing", """WITH v AS (SELECT vec_id, 1000 * embedding[1]::DOUBLE AS dx, 1000 * embedding[2]::DOUBLE AS dy, vec_id % 360 AS f FROM embeddings), r AS (SELECT *, degrees(atan2(dy, dx)) - f AS raw, sqrt(dx * dx + dy * dy) * 4 AS dist FROM v),
    b AS (SELECT *, round_even(raw - 360 * round_even(raw / 360, 0), 1) AS bearing FROM r)
    SELECT vec_id, bearing, CASE WHEN abs(bearing) <= 22 THEN 'north' WHEN abs(bearing) >= 158 THEN 'south' ELSE CASE WHEN abs(bearing) < 67 THEN 'north' WHEN abs(bearing) < 112 THEN '' ELSE 'south' END || CASE WHEN bearing > 0 THEN 'west' ELSE 'east' END END AS compass,
      round_even(dist, 0)::BIGINT || ' (' || CASE WHEN dist < 64 THEN 'contact' WHEN dist < 256 THEN 'close' WHEN dist < 768 THEN 'medium' ELSE 'far' END || ')' AS distance,
      CASE WHEN abs(bearing) <= 8 THEN 'dead ahead' WHEN abs(bearing) >= 165 THEN 'behind' ELSE CASE WHEN abs(bearing) BETWEEN 80 AND 100 THEN 'directly ' WHEN abs(bearing) < 45 THEN 'ahead ' ELSE '' END || CASE WHEN bearing > 0 THEN 'left' ELSE 'right' END END AS phrase FROM b""")
def fn_bearing(spark, sf):
    """Bearings, compass points and distance bands of the first two components."""
    at = lambda i: 1000 * F.get("embedding", F.lit(i)).cast("double")
    v = table(spark, sf, "embeddings").select("vec_id", at(0).alias("dx"), at(1).alias("dy"), (F.col("vec_id") % 360).alias("f"))
    b = v.select("vec_id", G.bearing(F.col("dx"), F.col("dy"), F.col("f")).alias("bearing"), (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 4).alias("dist"))
    return b.select("vec_id", "bearing", G.compass(F.col("bearing")).alias("compass"), G.labelled_distance(F.col("dist")).alias("distance"), G.bearing_phrase(F.col("bearing")).alias("phrase"))


@query("fn_article_title", "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'A ' || doc_id WHEN 1 THEN 'B c d' WHEN 2 THEN 'X' || doc_id WHEN 8 THEN '1+1' END AS title FROM documents")
def fn_article_title(spark, sf):
    """Titles named by links of nine forms, five of which name none."""
    k = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit("/wiki/A_"), k), F.lit("./B_c%20d#"), F.concat(F.lit("https://en.wikipedia.org/wiki/X"), k), F.lit("//other.org/wiki/X"), F.lit("/wiki/Talk:X"), F.lit("/wiki/X#y"), F.lit("/wiki/X?y=1"), F.lit("/w/X"), F.lit("/wiki/1+1")]
    return table(spark, sf, "documents").select("doc_id", T.article_title(F.get(F.array(*forms), (F.col("doc_id") % 9).cast("int"))).alias("title"))


@query("fn_question_key", "SELECT doc_id, 'f' || (doc_id % 4) AS family, 'f' || (doc_id % 4) || CASE doc_id % 3 WHEN 0 THEN ':relation' WHEN 1 THEN ':0123abcd' ELSE ':a:0123abc' END AS question_key FROM documents")
def fn_question_key(spark, sf):
    """Families and question keys; a hash goes only as a third part or later, and only if it is long enough."""
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, F.concat(F.lit(":relation:"), F.substring(F.md5(k.cast("string")), 1, 8))).when(k % 3 == 1, ":0123abcd").otherwise(":a:0123abc")
    ids = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), (k % 4).cast("string"), tail).alias("q"))
    return ids.select("doc_id", T.family_of(F.col("q")).alias("family"), T.question_key(F.col("q")).alias("question_key"))


@query("fn_word_diff", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 9 END AS words, p_partkey % 5 IN (1, 2, 3) AS minimal FROM part")
def fn_word_diff(spark, sf):
    """Texts with known edits: none, a word for another, two words more, a word less, nine words for one."""
    from loomline.operators.words import minimal_pair, word_diff

    k = F.col("p_partkey")
    text = F.concat(F.lit("the part "), k.cast("string"), F.lit(" has type and brand"))
    edits = (text, F.replace(text, F.lit("brand"), F.lit("size")), F.replace(text, F.lit("has"), F.lit("always now has")), F.replace(text, F.lit("type "), F.lit("")), F.replace(text, F.lit("type"), F.lit("b c d e f g h i j")))
    pairs = table(spark, sf, "part").select(k, text.alias("a"), F.get(F.array(*edits), (k % 5).cast("int")).alias("b"))
    return pairs.select("p_partkey", word_diff(F.col("a"), F.col("b")).alias("words"), minimal_pair(F.col("a"), F.col("b")).alias("minimal"))


@query("perturb_format", r"""WITH u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\$(\d+)', '\1 USD', 'g'), '(\d+) km\b', '\1 kilometres', 'g'),
      '(\d+) minutes\b', '\1 min', 'g'), '(\d+(?:\.\d+)?) kg\b', '\1 kilograms', 'g'), '(\d+) units\b', '\1 pcs', 'g'), '(\d+) users\b', '\1 user accounts', 'g') AS t FROM documents)
    SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN regexp_replace(t, '\.(\s|$)', ';\1', 'g') WHEN 1 THEN regexp_replace(t, '\.(\s|$)', '\1', 'g') WHEN 2 THEN replace(t, ', ', ' , ') ELSE replace(t, ': ', ' - ') END) AS h FROM u""")
def perturb_format(spark, sf):
    """Whole texts with units spelt otherwise and one of four ways of punctuation."""
    mode = F.get(F.array(*map(F.lit, T.PUNCTUATION)), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.other_punctuation(T.other_units(F.col("text")), mode), 256).alias("h"))


@query("gen_tradeoff", """WITH c AS (SELECT l_orderkey AS o, CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, l_quantity::DOUBLE AS cost, l_discount::DOUBLE AS impact, l_tax::DOUBLE AS duration, l_linenumber AS key FROM lineitem),
    f AS (SELECT * FROM c WHERE cost <= 30 AND (risk = 'low' OR (risk = 'medium' AND o % 2 = 0))),
    r AS (SELECT o, key, rank() OVER (PARTITION BY o ORDER BY impact, duration) AS k FROM f), g AS (SELECT o, min(key) AS gold FROM r WHERE k = 1 GROUP BY o HAVING count(*) = 1)
    SELECT t.o AS l_orderkey, gold::BIGINT AS gold FROM (SELECT DISTINCT o FROM c) t LEFT JOIN g USING (o)""")
def gen_tradeoff(spark, sf):
    """An order's line of least discount, then tax, within limits of risk and quantity."""
    risk = F.get(F.array(*map(F.lit, DE.RISKS)), (F.col("l_linenumber") % 3).cast("int"))
    item = F.struct(F.col("l_linenumber").cast("long").alias("key"), risk.alias("risk"), F.col("l_quantity").cast("double").alias("cost"), F.col("l_discount").cast("double").alias("impact"), F.col("l_tax").cast("double").alias("duration"))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("c"))
    limit = F.when(F.col("l_orderkey") % 2 == 0, "medium").otherwise("low")
    return o.select("l_orderkey", DE.best_within(F.col("c"), limit, F.lit(30.0), ["impact", "duration"]).alias("gold"))


@query("gen_record_match", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 2 END AS gold FROM customer")
def gen_record_match(spark, sf):
    """Probes with three candidates each: other spellings, missing fields, one field that disagrees, nothing in common."""
    n = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    record = lambda dob, phone, mail: F.struct(*((F.lit(v) if isinstance(v, str) else F.lit(None).cast("string") if v is None else v).alias(k) for k, v in (("dob", dob), ("phone", phone), ("mail", mail))))
    probe = record("1980-02-03", text("555-", n), text("p", n, "@mail.org"))
    spelt, fewer = record("1980 02 03", text("(555) ", n), None), record(None, text("555", n), None)
    other, apart = record("1980-02-03", text("556-", n), text("P", n, "@MAIL.org")), record(None, None, None)
    menus = ((spelt, other, apart), (other, fewer, apart), (apart, other, spelt), (apart, other, other), (other, spelt, fewer))
    which = F.get(F.array(*(F.array(*m) for m in menus)), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", DE.matching_candidate(probe, which, ["dob", "phone", "mail"]).alias("gold"))


@query("probe_interior", f"""WITH {pred_sql('a')}, {pred_sql('b', 20)}, j AS (SELECT a.family, a.p AS p, b.p AS q, a.k AS k, list_filter(range(1, a.k + 1), lambda i: a.p[i] >= 0.02 AND b.p[i] >= 0.02) AS keep FROM a JOIN b USING (id)),
    l AS (SELECT *, list_transform(keep, lambda i: ln(p[i])) AS lp, list_transform(keep, lambda i: ln(q[i])) AS lq FROM j), c AS (SELECT *, list_transform(lp, lambda x: x - list_avg(lp)) AS x, list_transform(lq, lambda x: x - list_avg(lq)) AS y FROM l),
    s AS (SELECT *, list_dot_product(x::DOUBLE[], y::DOUBLE[]) / list_dot_product(x::DOUBLE[], x::DOUBLE[]) AS scale FROM c), r AS (SELECT *, CASE WHEN len(keep) >= 3 THEN sqrt(list_avg(list_transform(range(1, len(x) + 1), lambda i: (y[i] - scale * x[i]) ** 2))) END AS rms,
      len(keep) >= 3 AND list_grade_up(list_transform(x, lambda v: -v)) <> list_grade_up(list_transform(y, lambda v: -v)) AS reversed FROM s)
    SELECT family, count(*) AS n, count(rms) AS defined, round(avg(rms), 6) AS residual_rms, count(*) FILTER (WHERE reversed) AS reversals, round(avg(list_sum(list_transform(range(1, k + 1), lambda i: abs(p[i] - q[i]))) / 2), 6) AS tv,
      count(*) FILTER (WHERE list_position(p, list_max(p)) <> list_position(q, list_max(q))) AS flips FROM r GROUP BY family""")
def probe_interior(spark, sf):
    """What editing a menu does, by family: residuals beyond a change of scale, reversals, total variation, flips."""
    a, b = predictions(spark, sf).select("id", "family", F.col("p").alias("base")), predictions(spark, sf, first=20).select("id", F.col("p").alias("variant"))
    return DE.menu_edits(a.join(b, "id"), "family")
