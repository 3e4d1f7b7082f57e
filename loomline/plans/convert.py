"""Converters to typed requests, menus, perturbations, length accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import requests as Q
from loomline.operators.menus import with_menu
from loomline.operators.ranks import ranked
from loomline.plans.registry import query, table

#: A converted request as flat columns, which both engines can compare.
FLAT = ("group_id", "kind", "keys", "target")


def flat(df, question, group):
    q = df.select(group.alias("group_id"), question.alias("q")).where(Q.question_violation(F.col("q")).isNull())
    return q.select("group_id", "q.kind", F.array_join(F.transform("q.options", lambda o: o["key"]), ",").alias("keys"), F.array_join(F.transform("q.target", lambda t: F.format_number(t, 3)), ",").alias("target"))


@query("conv_toxic", "SELECT 'toxic:' || doc_id AS group_id, 'noul' AS kind, 'false,true' AS keys, CASE WHEN toxic = 1 THEN '0.000,1.000' ELSE '1.000,0.000' END AS target FROM labels")
def conv_toxic(spark, sf):
    return flat(table(spark, sf, "labels"), Q.noul("toxic", "Is the text toxic?", F.col("toxic").cast("double")), F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")))


@query("conv_harm", "SELECT 'harm:' || doc_id AS group_id, 'noul' AS kind, 'false,true' AS keys, CASE WHEN toxic = 1 AND quality = 0 THEN '0.000,1.000' WHEN toxic = 1 THEN '0.500,0.500' ELSE '1.000,0.000' END AS target FROM labels")
def conv_harm(spark, sf):
    p = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 1.0).when(F.col("toxic") == 1, 0.5).otherwise(0.0)
    return flat(table(spark, sf, "labels"), Q.noul("harm", "Is the text harmful?", p), F.concat(F.lit("harm:"), F.col("doc_id").cast("string")))


LANGS = [("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French")]


@query("conv_intent", "SELECT 'lang:' || doc_id AS group_id, 'choice' AS kind, 'de,en,es,fr' AS keys, array_to_string(list_transform(['de', 'en', 'es', 'fr'], lambda x: CASE WHEN x = lang THEN '1.000' ELSE '0.000' END), ',') AS target FROM documents")
def conv_intent(spark, sf):
    target = F.array(*(F.when(F.col("lang") == k, 1.0).otherwise(0.0) for k, _ in LANGS))
    return flat(table(spark, sf, "documents"), Q.question("lang", "choice", "Which language?", LANGS, target), F.concat(F.lit("lang:"), F.col("doc_id").cast("string")))


@query("conv_rating", "SELECT 'len:' || doc_id AS group_id, 'score' AS kind, '0,1,2,3,4' AS keys, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i = least(4, n_chars // 1000) THEN '1.000' ELSE '0.000' END), ',') AS target FROM documents")
def conv_rating(spark, sf):
    level = F.least(F.lit(4), F.floor(F.col("n_chars") / 1000))
    target = F.array(*(F.when(level == i, 1.0).otherwise(0.0) for i in range(5)))
    return flat(table(spark, sf, "documents"), Q.question("len", "score", "How long?", [(str(i), f"level {i}") for i in range(5)], target), F.concat(F.lit("len:"), F.col("doc_id").cast("string")))


@query("conv_sentiment", "SELECT event_id, least(4, greatest(0, floor(value / 20)))::INT AS level, CASE WHEN floor(value / 20) IN (3, 4) THEN true WHEN floor(value / 20) IN (0, 1) THEN false END AS positive FROM events")
def conv_sentiment(spark, sf):
    b = F.floor(F.col("value") / 20)
    return table(spark, sf, "events").select("event_id", F.least(F.lit(4), F.greatest(F.lit(0), b)).cast("int").alias("level"), F.when(b.isin(3, 4), True).when(b.isin(0, 1), False).alias("positive"))


@query("conv_nli", "WITH t AS (SELECT a.conv_id AS conv_id, a.turn AS turn, a.text AS premise, b.text AS hypothesis FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, sha256(premise) AS premise_group, CASE WHEN length(hypothesis) > length(premise) THEN 'entailment' WHEN length(hypothesis) * 2 < length(premise) THEN 'contradiction' ELSE 'neutral' END AS label FROM t")
def conv_nli(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("premise"), F.lead("text").over(w).alias("hypothesis"), F.lead("turn").over(w).alias("next"))
    p, h = F.length("premise"), F.length("hypothesis")
    return c.where(F.col("next") == F.col("turn") + 1).select("conv_id", "turn", F.sha2("premise", 256).alias("premise_group"), F.when(h > p, "entailment").when(h * 2 < p, "contradiction").otherwise("neutral").alias("label"))


@query("conv_preference", "WITH p AS (SELECT l.doc_id AS a, r.doc_id AS b, l.quality - l.toxic AS x, r.quality - r.toxic AS y FROM labels l JOIN labels r ON r.doc_id = l.doc_id + 1) SELECT a, b, CASE WHEN x > y THEN 'a' WHEN y > x THEN 'b' ELSE 'tie' END AS winner FROM p")
def conv_preference(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("x"))
    r = l.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("x").alias("y"))
    return l.join(r, l["doc_id"] == r["a"]).select("a", "b", F.when(F.col("x") > F.col("y"), "a").when(F.col("y") > F.col("x"), "b").otherwise("tie").alias("winner"))


@query("conv_mcq", "WITH o AS (SELECT p_partkey, [p_brand, p_type, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_mfgr END, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_container END] AS o FROM (SELECT p_partkey, p_brand, p_type, 'm' || (p_partkey % 5) AS p_mfgr, 'c' || (p_partkey % 3) AS p_container FROM part)) SELECT p_partkey, len(o) AS k, p_partkey % 4 AS answer FROM o WHERE NOT list_contains(o, '') AND len(list_distinct(o)) = len(o)")
def conv_mcq(spark, sf):
    k = F.col("p_partkey")
    o = F.array("p_brand", "p_type", F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("m"), (k % 5).cast("string"))), F.when(k % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("c"), (k % 3).cast("string"))))
    q = table(spark, sf, "part").select("p_partkey", o.alias("o")).where(~F.array_contains("o", "") & (F.size(F.array_distinct("o")) == F.size("o")))
    return q.select("p_partkey", F.size("o").cast("long").alias("k"), (F.col("p_partkey") % 4).alias("answer"))


@query("conv_table", "WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text LIKE '%|%'), t AS (SELECT doc_id, u.i AS i, string_split(ls[u.i], '|') AS cells FROM r, unnest(range(1, len(ls) + 1)) AS u(i)) SELECT doc_id, i - 1 AS line, len(cells) AS cells, trim(cells[1], ' ') AS first FROM t WHERE len(cells) > 1")
def conv_table(spark, sf):
    lines = table(spark, sf, "documents").where(F.col("text").contains("|")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    cells = F.split("l", r"\|", -1)
    return lines.where(F.size(cells) > 1).select("doc_id", F.col("line").cast("long").alias("line"), F.size(cells).cast("long").alias("cells"), F.btrim(cells[0], F.lit(" ")).alias("first"))


@query("conv_injection", "SELECT doc_id, regexp_matches(lower(text), 'ignore|instruction|password|token = ') AS injection FROM documents")
def conv_injection(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").rlike("ignore|instruction|password|token = ").alias("injection"))


@query("conv_tool", "SELECT event_id, event_type AS tool, json_extract_string(props, '$.' || json_keys(props)[1]) AS argument FROM events")
def conv_tool(spark, sf):
    first = F.get(F.json_object_keys("props"), F.lit(0))
    args = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("tool"), F.element_at(args, first).alias("argument"))


@query("conv_next_click", "WITH p AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, event_type AS context, nxt AS label FROM p WHERE nxt IS NOT NULL AND nxt <> event_type")
def conv_next_click(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("context"), F.lead("event_type").over(w).alias("label"))
    return e.where("label IS NOT NULL AND label <> context")


@query("conv_benchmark", r"SELECT item_id, 'bench:' || substr(sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 16) AS group_id, length(text) AS state_chars FROM benchmark WHERE text <> ''")
def conv_benchmark(spark, sf):
    b = table(spark, sf, "benchmark").where("text <> ''")
    return b.select("item_id", F.concat(F.lit("bench:"), F.substring(T.state_hash(F.col("text")), 1, 16)).alias("group_id"), F.length("text").cast("long").alias("state_chars"))


@query("soft_target_convert", "SELECT doc_id, [1 - t, t] AS toxicity, CASE WHEN votes = 1 THEN 'one_hot' ELSE 'dropped' END AS kind FROM (SELECT doc_id, (0.25 * toxic + 0.5 * (1 - quality))::DOUBLE AS t, toxic + quality AS votes FROM labels)")
def soft_target(spark, sf):
    t = 0.25 * F.col("toxic") + 0.5 * (1 - F.col("quality"))
    return table(spark, sf, "labels").select("doc_id", F.array(1 - t, t).alias("toxicity"), F.when(F.col("toxic") + F.col("quality") == 1, "one_hot").otherwise("dropped").alias("kind"))


@query("option_keys", "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN array_to_string(list_transform(range(0, label + 1), lambda i: 'k' || i), ',') WHEN 1 THEN array_to_string(list_transform(range(0, label + 1), lambda i: i::VARCHAR), ',') ELSE 'false,true' END AS keys FROM embeddings")
def option_keys(spark, sf):
    kind = F.when(F.col("vec_id") % 3 == 0, "choice").when(F.col("vec_id") % 3 == 1, "score").otherwise("noul")
    own = F.transform(F.sequence(F.lit(0), F.col("label")), lambda i: F.concat(F.lit("k"), i.cast("string")))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(Q.option_keys(kind, own, F.col("label") + 1), ",").alias("keys"))


@query("gen_to_request", "SELECT vec_id, CASE WHEN label = 9 THEN 'missing_gold' WHEN vec_id % 8 = 0 THEN 'duplicate_keys' WHEN vec_id % 13 = 0 THEN 'bad_state' END AS reason FROM embeddings")
def gen_to_request(spark, sf):
    v = F.col("vec_id")
    state = F.when(v % 13 == 0, F.lit("{broken")).otherwise(F.lit('{"a": 1}'))
    keys = F.when(v % 8 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    gold = F.when(F.col("label") != 9, F.lit("a"))
    bad_json = F.try_parse_json(state).isNull()
    reason = F.coalesce(F.when(gold.isNull(), "missing_gold"), F.when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_keys"), F.when(bad_json, "bad_state"))
    return table(spark, sf, "embeddings").select("vec_id", reason.alias("reason"))


def menu_sql(rows: str, key: str, gold: str, seed: str, sizes: str = "[2, 4, 8]", omit: int = 13107, more: str = "") -> str:
    """with_menu in SQL, on a table expression; the pool is the distinct labels."""
    hexed = lambda at, n: f"('0x' || substr(h, {at}, {n}))::BIGINT"
    return f"""pool AS (SELECT label, row_number() OVER (ORDER BY sha256({seed} || ':' || label), label) - 1 AS place, count(*) OVER () AS n, list_distinct(regexp_extract_all(lower(label), '[a-z]+')) AS w {more} FROM (SELECT DISTINCT {gold} AS label {more} FROM {rows})),
    row_ AS (SELECT *, sha256({seed} || ':' || {key}) AS h FROM {rows}),
    told AS (SELECT row_.*, {hexed(3, 4)} < {omit} AS out, {sizes}[{hexed(1, 2)} % 3 + 1] - CASE WHEN {hexed(3, 4)} < {omit} THEN 1 ELSE 2 END AS wrong, {hexed(7, 8)} % (SELECT count(DISTINCT label) FROM pool) AS start FROM row_),
    near AS (SELECT a.label AS label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY len(list_intersect(a.w, b.w)) DESC, b.place) AS r FROM pool a JOIN pool b ON a.label <> b.label AND len(list_intersect(a.w, b.w)) > 0),
    hard AS (SELECT t.{key}, other FROM told t JOIN near ON near.label = t.{gold} AND r <= t.wrong // 2),
    nh AS (SELECT {key}, count(*) AS k FROM hard GROUP BY 1),
    rest AS (SELECT t.{key}, p.label AS other, t.wrong - coalesce(k, 0) AS wanted, row_number() OVER (PARTITION BY t.{key} ORDER BY (p.place - t.start + p.n) % p.n) AS r
        FROM told t CROSS JOIN pool p LEFT JOIN nh ON nh.{key} = t.{key} WHERE p.label <> t.{gold} AND NOT EXISTS (SELECT 1 FROM hard WHERE hard.{key} = t.{key} AND hard.other = p.label)),
    every AS (SELECT {key}, other AS o FROM hard UNION ALL SELECT {key}, other FROM rest WHERE r <= wanted UNION ALL SELECT {key}, 'none of these' FROM told UNION ALL SELECT {key}, {gold} FROM told WHERE NOT out),
    menu AS (SELECT {key}, list(o ORDER BY sha256({seed} || ':' || {key} || ':' || o)) AS m FROM every GROUP BY {key})
    SELECT t.{key}, array_to_string(m, ',') AS menu, (list_position(m, CASE WHEN out THEN 'none of these' ELSE {gold} END) - 1)::INT AS target FROM told t JOIN menu USING ({key})"""


@query("aug_menu", f"WITH {menu_sql('part', 'p_partkey', 'p_name', '17')}")
def aug_menu(spark, sf):
    return with_menu(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 17).select("p_partkey", F.array_join("menu", ",").alias("menu"), "target")


@query("aug_epoch", " UNION ALL ".join(f"SELECT {e}::BIGINT AS epoch, * FROM (WITH {menu_sql('part', 'p_partkey', 'p_name', str(17 + 1000003 * e))})" for e in range(3)))
def aug_epoch(spark, sf):
    """Every row's menu again in each epoch, with the epoch's own seed."""
    out, p = None, table(spark, sf, "part").select("p_partkey", "p_name")
    for e in range(3):
        one = with_menu(p, "p_partkey", "p_name", 17 + 1000003 * e).select(F.lit(e).cast("long").alias("epoch"), "p_partkey", F.array_join("menu", ",").alias("menu"), "target")
        out = one if out is None else out.unionByName(one)
    return out


@query("aug_options_shuffle", "SELECT doc_id, string_agg(o, ',' ORDER BY sha256(doc_id || ':' || o)) AS keys FROM (SELECT doc_id, unnest(['de', 'en', 'es', 'fr']) AS o FROM documents) GROUP BY doc_id")
def options_shuffle(spark, sf):
    o = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in LANGS))
    target = F.array(*(F.when(F.col("lang") == k, 1.0).otherwise(0.0) for k, _ in LANGS))
    mixed = Q.shuffle_options(o, target, F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(mixed, lambda x: x["key"]), ",").alias("keys"))


@query("aug_negate", "SELECT doc_id, 'Is it false that the text is toxic?' AS instructions, toxic AS p_false, 1 - toxic AS p_true FROM labels")
def aug_negate(spark, sf):
    q = Q.noul("toxic", "Is it true that the text is toxic?", F.col("toxic").cast("double"))
    l = table(spark, sf, "labels").select("doc_id", q.alias("q"))
    turned = F.reverse("q.target")
    return l.select("doc_id", F.regexp_replace("q.instructions", "Is it true", "Is it false").alias("instructions"), turned[0].cast("int").alias("p_false"), turned[1].cast("int").alias("p_true"))


PREFIX, SUFFIX = "Note: the record follows. ", " End of record."


@query("perturb_text", f"SELECT doc_id || '#prefix' AS group_id, doc_id AS pair_id, sha256('{PREFIX}' || text) AS h FROM documents UNION ALL SELECT doc_id || '#suffix', doc_id, sha256(text || '{SUFFIX}') FROM documents UNION ALL SELECT doc_id || '#upper', doc_id, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) FROM documents UNION ALL SELECT doc_id || '#spaces', doc_id, sha256(replace(text, ' ', '  ')) FROM documents UNION ALL SELECT doc_id || '#lines', doc_id, sha256(replace(text, chr(10), ' ')) FROM documents")
def perturb_text(spark, sf):
    t = F.col("text")
    variants = {"prefix": F.concat(F.lit(PREFIX), t), "suffix": F.concat(t, F.lit(SUFFIX)), "upper": F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "spaces": F.replace(t, F.lit(" "), F.lit("  ")), "lines": F.replace(t, F.lit("\n"), F.lit(" "))}
    rows = F.array(*(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(f"#{n}")).alias("group_id"), F.sha2(v, 256).alias("h")) for n, v in variants.items()))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.inline(rows))


@query("perturb_missing", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id AS pair_id, len(ls) AS lines, sha256(array_to_string(list_concat(ls[1:len(ls) // 2], ls[len(ls) // 2 + 2:]), chr(10))) AS h FROM l WHERE len(ls) > 1")
def perturb_missing(spark, sf):
    l = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls")).where(F.size("ls") > 1)
    mid = F.floor(F.size("ls") / 2).cast("int")
    kept = F.concat(F.slice("ls", F.lit(1), mid), F.slice("ls", mid + 2, F.size("ls")))
    return l.select(F.col("doc_id").alias("pair_id"), F.size("ls").cast("long").alias("lines"), F.sha2(F.array_join(kept, "\n"), 256).alias("h"))


@query("perturb_distractors", "WITH o AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM documents) SELECT doc_id AS pair_id, sha256(text || chr(10) || other) AS h FROM o WHERE other IS NOT NULL")
def perturb_distractors(spark, sf):
    """Each document with the next one of its language behind it; ids are linked by rank, and texts join last."""
    d = table(spark, sf, "documents")
    ids = ranked(d.select("lang", "doc_id"), ["doc_id"], by=["lang"])
    pairs = ids.join(ids.select("lang", (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("other_id")), ["lang", "rank"]).select("doc_id", "other_id")
    own, other = d.select("doc_id", "text"), d.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other"))
    return pairs.join(own, "doc_id").join(other, "other_id").select(F.col("doc_id").alias("pair_id"), F.sha2(F.concat("text", F.lit("\n"), "other"), 256).alias("h"))


@query("join_robust_pairs", "WITH v AS (SELECT doc_id || '#' || (doc_id % 3) AS group_id, n_chars % 4 AS a FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, n_chars % 3 AS b FROM documents) SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS changed FROM v JOIN c ON split_part(group_id, '#', 1) = doc_id::VARCHAR")
def robust_pairs(spark, sf):
    d = table(spark, sf, "documents")
    v = d.where("doc_id % 5 <> 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), (F.col("doc_id") % 3).cast("string")).alias("group_id"), (F.col("n_chars") % 4).alias("a"))
    c = d.select(F.col("doc_id").cast("string").alias("clean"), (F.col("n_chars") % 3).alias("b"))
    j = v.join(c, F.split_part("group_id", F.lit("#"), F.lit(1)) == F.col("clean"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("join_sidecar", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sidecar(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 300, 1).otherwise(0)).alias("quality"))


@query("pack_lengths", "SELECT doc_id, strlen(text) + 1 AS state_tokens, 16 AS header_tokens, 11 + 12 + 12 + 11 AS option_tokens, strlen(text) + 1 + 16 + 46 AS tokens FROM documents")
def pack_lengths(spark, sf):
    o = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in LANGS))
    lengths = Q.packed_lengths(F.col("text"), o, F.lit("Which language?"))
    return table(spark, sf, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in lengths.items()))


@query("pack_budgets", "SELECT doc_id, CASE WHEN strlen(text) + 63 > 8192 THEN 'max_tokens' WHEN strlen(text) + 17 > 6144 THEN 'state_plus_question' END AS error FROM documents")
def pack_budgets(spark, sf):
    n = F.octet_length("text")
    return table(spark, sf, "documents").select("doc_id", F.when(n + 63 > 8192, "max_tokens").when(n + 17 > 6144, "state_plus_question").alias("error"))


@query("pack_visibility", "WITH s AS (SELECT vec_id, label, i, CASE WHEN i = 0 THEN -1 WHEN i = 1 THEN 0 ELSE 1 END AS parent FROM embeddings, range(4) r(i)) SELECT q.vec_id, q.i AS query, count(*) AS visible FROM s q JOIN s k ON q.vec_id = k.vec_id AND k.i <= q.i AND (k.i = 0 OR k.i = q.i OR k.i = q.parent) GROUP BY 1, 2")
def pack_visibility(spark, sf):
    """Key segments that each query segment sees: the state, itself and its parent, causally; segments of a request are an array."""
    seg = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(p).alias("parent")) for i, p in ((0, -1), (1, 0), (2, 1), (3, 1))))
    r = table(spark, sf, "embeddings").select("vec_id", seg.alias("s")).select("vec_id", "s", F.inline("s"))
    seen = F.filter("s", lambda k: (k["i"] <= F.col("i")) & ((k["i"] == 0) | (k["i"] == F.col("i")) | (k["i"] == F.col("parent"))))
    return r.select("vec_id", F.col("i").alias("query"), F.size(seen).cast("long").alias("visible"))


@query("pack_levels", "SELECT i, CASE WHEN i = 0 THEN 0 WHEN i < 3 THEN 1 WHEN i < 7 THEN 2 ELSE 3 END AS depth FROM range(15) r(i)")
def pack_levels(spark, sf):
    from loomline.operators.relational import walk

    nodes = spark.range(15).select(F.col("id").alias("i"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).alias("parent"))
    return walk(nodes, "i", "parent", 6).select("i", F.col("hops").alias("depth"))


@query("depth_place", "WITH l AS (SELECT doc_id, u.i AS i, string_split(text, chr(10))[u.i] AS s, len(string_split(text, chr(10))) AS n FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)), c AS (SELECT doc_id, i, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum(length(s) + 1) OVER (PARTITION BY doc_id) AS total FROM l) SELECT doc_id, arg_min(i, (abs(pos - 0.5 * total), i)) - 1 AS line FROM c GROUP BY doc_id")
def depth_place(spark, sf):
    """The line nearest to half of the text, by running sums inside the document's own array: no shuffle."""
    lines = F.split("text", "\n", -1)
    sums = F.aggregate(lines, F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + F.length(s) + 1)))
    d = table(spark, sf, "documents").select("doc_id", sums.alias("pos"))
    best = F.array_min(F.transform("pos", lambda p, i: F.struct(F.abs(p - 0.5 * F.element_at("pos", -1)).alias("d"), i.alias("i"))))
    return d.select("doc_id", best["i"].cast("long").alias("line"))


@query("shape_buckets", "SELECT doc_id, CASE WHEN strlen(text) <= 4 THEN 4 WHEN strlen(text) <= 8 THEN 8 WHEN strlen(text) <= 16 THEN 16 WHEN strlen(text) <= 64 THEN 64 ELSE 256 END AS bucket, (2 ** ceil(log2(greatest(1, strlen(text)))))::BIGINT AS capacity FROM documents")
def shape_buckets(spark, sf):
    n = F.octet_length("text")
    b = F.when(n <= 4, 4).when(n <= 8, 8).when(n <= 16, 16).when(n <= 64, 64).otherwise(256)
    return table(spark, sf, "documents").select("doc_id", b.alias("bucket"), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), n).cast("double")))).cast("long").alias("capacity"))


@query("src_html_links", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(DISTINCT href) AS links FROM a WHERE starts_with(href, '/') AND NOT contains(href, '#') AND NOT contains(href, '?') GROUP BY page_id""")
def html_links(spark, sf):
    from loomline.sources.links import page_links

    return page_links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
