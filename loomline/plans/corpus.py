"""Corpus preparation on documents, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.operators.ranks import ranked, set_digest, set_digest_sql
from loomline.plans.registry import query, table

H = r"sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
D = f"d AS (SELECT doc_id, text, lang, source, {H} AS h FROM documents)"


def m10(x: str) -> str:
    digit = f"strpos('0123456789abcdef', substr({x}, i, 1)) - 1"
    return f"(((strpos('0123456789abcdef', substr({x}, 64, 1)) - 1) + 6 * list_sum(list_transform(range(1, 64), lambda i: {digit}))) % 10)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", T.state_hash(F.col("text")).alias("h"))


@query("state_hash", f"WITH {D} SELECT doc_id, h AS state_hash FROM d")
def state_hash(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("h").alias("state_hash"))


@query("world_id", f"WITH {D} SELECT doc_id, source || ':' || substr(h, 1, 20) AS world_id FROM d")
def world_id(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat("source", F.lit(":"), F.substring("h", 1, 20)).alias("world_id"))


@query("input_signature", r"""SELECT vec_id, sha256('{"state":"' || vec_id || '","kind":"choice","options":[' || list_aggregate(list_transform(range(0, 2 + label), lambda i: '"' || i || '"'), 'string_agg', ',') || ']}') AS input_sha256 FROM embeddings""")
def input_signature(spark, sf):
    e = table(spark, sf, "embeddings")
    options = F.transform(F.sequence(F.lit(0), F.col("label") + 1), lambda i: i.cast("string"))
    return e.select("vec_id", F.sha2(F.to_json(F.struct(F.col("vec_id").cast("string").alias("state"), F.lit("choice").alias("kind"), options.alias("options"))), 256).alias("input_sha256"))


@query("win_dedup_first", f"WITH {D} SELECT min(doc_id) AS doc_id, h FROM d GROUP BY h")
def dedup_first(spark, sf):
    return C.dedup_first(docs(spark, sf), "h", "doc_id").select("doc_id", "h")


@query("win_dedup_last", f"WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id % 3 DESC, doc_id DESC) AS n FROM d) SELECT doc_id, h FROM r WHERE n = 1")
def dedup_last(spark, sf):
    return C.dedup_last(docs(spark, sf), "h", F.col("doc_id") % 3, "doc_id").select("doc_id", "h")


@query("win_conflict_drop", f"WITH {D}, l AS (SELECT d.*, coalesce(quality, 1) AS q FROM d LEFT JOIN labels USING (doc_id)) SELECT doc_id, q FROM l WHERE h NOT IN (SELECT h FROM l GROUP BY h HAVING count(DISTINCT q) > 1)")
def conflict_drop(spark, sf):
    told = docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "h", F.coalesce("quality", F.lit(1)).alias("q"))
    return C.drop_conflicts(told, "h", "q").select("doc_id", "q")


@query("win_cross_owner", f"WITH {D} SELECT doc_id, source FROM d WHERE h IN (SELECT h FROM d GROUP BY h HAVING count(DISTINCT source) = 1)")
def cross_owner(spark, sf):
    return C.drop_conflicts(docs(spark, sf), "h", "source").select("doc_id", "source")


ROLE = "CASE turn % 3 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END"


@query("win_group_priority", f"WITH c AS (SELECT *, {ROLE} AS p FROM conversations) SELECT conv_id, turn, p AS priority FROM (SELECT *, max(p) OVER (PARTITION BY conv_id) AS m FROM c) WHERE p = m")
def group_priority(spark, sf):
    p = F.when(F.col("turn") % 3 == 2, 3).when(F.col("turn") % 3 == 1, 2).otherwise(1)
    return C.highest_priority(table(spark, sf, "conversations"), "conv_id", p).select("conv_id", "turn", p.alias("priority"))


@query("join_eval_leak", rf"WITH {D}, b AS (SELECT DISTINCT {H} AS h FROM benchmark) SELECT doc_id, h IN (SELECT h FROM b) AS leaked FROM d")
def eval_leak(spark, sf):
    bad = table(spark, sf, "benchmark").select(T.state_hash(F.col("text")).alias("h")).distinct().withColumn("hit", F.lit(True))
    return docs(spark, sf).join(bad, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("leaked"))


SH = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"


@query("join_shingle", f"""WITH g(doc_id, w) AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents),
    b(w) AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') FROM benchmark), bs AS (SELECT DISTINCT unnest({SH}) AS s FROM b WHERE len(w) >= 12),
    gs AS (SELECT doc_id, unnest({SH}) AS s FROM g WHERE len(w) >= 12) SELECT doc_id, min(s) AS shingle FROM gs SEMI JOIN bs USING (s) GROUP BY doc_id""")
def join_shingle(spark, sf):
    return C.shingle_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "text", 12)


@query("anti_seen", f"WITH {D}, seen AS (SELECT doc_id, h FROM d WHERE doc_id % 4 = 0) SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM seen) AND h NOT IN (SELECT h FROM seen)")
def anti_seen(spark, sf):
    d = docs(spark, sf)
    seen = d.where("doc_id % 4 = 0")
    return d.join(seen.select("doc_id"), "doc_id", "left_anti").join(seen.select("h"), "h", "left_anti").select("doc_id")


@query("semi_panel", f"WITH {D} SELECT doc_id FROM d WHERE h IN (SELECT h FROM d WHERE source = 'src1')")
def semi_panel(spark, sf):
    d = docs(spark, sf)
    return d.join(d.where("source = 'src1'").select("h"), "h", "left_semi").select("doc_id")


@query("sort_hash_rank", "SELECT doc_id, sha256('17:' || doc_id) AS k, row_number() OVER (ORDER BY sha256('17:' || doc_id), doc_id) AS rank FROM documents")
def hash_rank(spark, sf):
    return ranked(table(spark, sf, "documents").select("doc_id", T.seeded_hash(17, F.col("doc_id")).alias("k")), ["k", "doc_id"])


@query("sample_limit", "SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id), doc_id LIMIT 100")
def sample_limit(spark, sf):
    return C.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 17)


@query("split_hash10", f"WITH {D}, s AS (SELECT doc_id, sha256('17:' || h) AS x FROM d) SELECT doc_id, CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE 'train' END AS split FROM s")
def split_hash10(spark, sf):
    return docs(spark, sf).select("doc_id", C.split10(F.col("h"), 17).alias("split"))


@query("split_hash2", f"WITH {D} SELECT doc_id, CASE WHEN (strpos('0123456789abcdef', substr(sha256('17:' || h), 64, 1)) - 1) % 2 = 0 THEN 'validation' ELSE 'calibration' END AS half FROM d")
def split_hash2(spark, sf):
    return docs(spark, sf).select("doc_id", C.split2(F.col("h"), 17).alias("half"))


@query("split_holdout_test", f"WITH {D}, s AS (SELECT doc_id, sha256('17:' || h) AS x, sha256('17:test:' || h) AS x2 FROM d) SELECT doc_id, CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE CASE WHEN {m10('x2')} < 2 THEN 'test' ELSE 'train' END END AS split FROM s")
def split_holdout_test(spark, sf):
    first, second = C.split10(F.col("h"), 17), T.hex_mod10(T.seeded_hash("17:test", F.col("h")))
    return docs(spark, sf).select("doc_id", F.when((first == "train") & (second < 2), "test").otherwise(first).alias("split"))


@query("split_heldout_class", f"WITH {D}, s AS (SELECT doc_id, source, sha256('17:' || h) AS x FROM d), held AS (SELECT source FROM (SELECT DISTINCT source FROM d) ORDER BY sha256('17:' || source) LIMIT 3), t AS (SELECT doc_id, source, CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM s) SELECT doc_id, CASE WHEN source IN (SELECT source FROM held) THEN 'test_unseen' ELSE split END AS split FROM t WHERE NOT (split = 'train' AND source IN (SELECT source FROM held))")
def split_heldout_class(spark, sf):
    d = docs(spark, sf)
    held = C.hash_sample(d.select("source").distinct(), "source", 3, 17).withColumn("held", F.lit(True))
    split = F.when(C.split10(F.col("h"), 17) == "calibration", "test").otherwise(C.split10(F.col("h"), 17))
    told = d.join(F.broadcast(held), "source", "left").select("doc_id", split.alias("split"), F.coalesce("held", F.lit(False)).alias("held"))
    return told.where("NOT (held AND split = 'train')").select("doc_id", F.when(F.col("held"), "test_unseen").otherwise(F.col("split")).alias("split"))


@query("split_whole_task", "WITH t AS (SELECT *, CASE conv_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM conversations) SELECT conv_id, turn, split FROM t WHERE split = 'train' OR text NOT IN (SELECT text FROM t WHERE split = 'train')")
def split_whole_task(spark, sf):
    b = F.col("conv_id") % 10
    t = table(spark, sf, "conversations").withColumn("split", F.when(b == 8, "dev").when(b == 9, "test").otherwise("train"))
    clean = t.where("split <> 'train'").join(t.where("split = 'train'").select("text").distinct(), "text", "left_anti")
    return t.where("split = 'train'").unionByName(clean).select("conv_id", "turn", "split")


@query("split_target_disjoint", f"WITH s AS (SELECT vec_id, label, sha256('7:' || label) AS x FROM embeddings) SELECT vec_id, CASE WHEN {m10('x')} < 2 THEN 'test' ELSE 'train' END AS split FROM s")
def split_target_disjoint(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.when(T.hex_mod10(T.seeded_hash(7, F.col("label"))) < 2, "test").otherwise("train").alias("split"))


@query("split_multilingual", f"WITH {D}, test AS (SELECT DISTINCT h FROM d WHERE doc_id % 5 = 0), pool AS (SELECT doc_id, lang, h FROM d WHERE h NOT IN (SELECT h FROM test)), one AS (SELECT min(doc_id) AS doc_id, lang, h FROM pool GROUP BY lang, h), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || h), h) AS rank FROM one) SELECT doc_id, lang, rank FROM r WHERE rank <= 40")
def split_multilingual(spark, sf):
    d = docs(spark, sf)
    pool = d.join(d.where("doc_id % 5 = 0").select("h").distinct(), "h", "left_anti")
    one = pool.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    return C.take_per(one, "lang", "h", 3, 40).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("split_calib_topup", f"WITH {D}, p AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 0 ELSE 1 END AS pool, sha256('5:' || doc_id) AS k FROM d WHERE source IN ('src1', 'src2')) SELECT doc_id, pool FROM p ORDER BY pool, k LIMIT 50")
def split_calib_topup(spark, sf):
    p = docs(spark, sf).where(F.col("source").isin("src1", "src2")).select("doc_id", F.when(F.col("source") == "src1", 0).otherwise(1).alias("pool"))
    return p.orderBy("pool", T.seeded_hash(5, F.col("doc_id"))).limit(50)


@query("win_per_source_take", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id), doc_id) AS rank FROM documents) SELECT doc_id, source, rank FROM r WHERE rank <= 10 + strlen(source) * 2")
def per_source_take(spark, sf):
    allocation = F.lit(10) + F.octet_length("source") * 2
    return C.take_per(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 17, allocation).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("win_per_cell_limit", "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents) SELECT doc_id, lang, source FROM r WHERE rank <= 3")
def per_cell_limit(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("win_prefix_take", "WITH p AS (SELECT doc_id, lang, n_chars, sha256('17:' || doc_id) AS k FROM documents), a AS (SELECT doc_id, 'small' AS arm FROM (SELECT * FROM p WHERE lang = 'en' ORDER BY k, doc_id LIMIT 50)), b AS (SELECT doc_id, 'large' AS arm FROM (SELECT * FROM p WHERE lang = 'en' ORDER BY k, doc_id LIMIT 200)) SELECT * FROM a UNION ALL SELECT * FROM b")
def prefix_take(spark, sf):
    en = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    arms = [C.hash_sample(en, "doc_id", n, 17).withColumn("arm", F.lit(arm)) for arm, n in (("small", 50), ("large", 200))]
    return arms[0].unionByName(arms[1])


@query("mix_arms", "WITH arms(arm, lang, size) AS (VALUES ('en_only', 'en', 100), ('de_only', 'de', 40), ('all', NULL, 150)), r AS (SELECT arm, size, doc_id, row_number() OVER (PARTITION BY arm ORDER BY sha256('17:' || doc_id), doc_id) AS rank FROM documents d JOIN arms ON arms.lang IS NULL OR arms.lang = d.lang) SELECT arm, doc_id FROM r WHERE rank <= size")
def mix_arms(spark, sf):
    base, out = table(spark, sf, "documents").select("doc_id", "lang"), None
    for arm, lang, size in (("en_only", "en", 100), ("de_only", "de", 40), ("all", None, 150)):
        own = base if lang is None else base.where(F.col("lang") == lang)
        one = C.hash_sample(own, "doc_id", size, 17).select(F.lit(arm).alias("arm"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("win_round_robin", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id), doc_id) AS rank FROM documents) SELECT doc_id, source, rank FROM r ORDER BY rank, sha256('17:' || source), source LIMIT 100")
def round_robin(spark, sf):
    return C.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 17, 100).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def level_sql(counts: str, size: int, cap: int) -> str:
    """The largest level whose fill, source by source, takes no more than size."""
    return f"(SELECT max(l) FROM range({cap + 1}) r(l) WHERE (SELECT sum(least(n, l)) FROM {counts}) <= {size})"


@query("mix_waterfill", f"WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, least(n, {level_sql('c', 400, 30)}) AS allocated FROM c")
def waterfill(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("allocated", F.least("n", F.lit(C.water_level(counts, "n", 400, 30)).cast("long")))


@query("mix_cap_share", "SELECT source, count(*) AS n, least(count(*), floor(500 * 0.06)::BIGINT) AS taken, round(least(count(*), floor(500 * 0.06)::BIGINT) / 500.0, 6)::DOUBLE AS share FROM documents GROUP BY source")
def cap_share(spark, sf):
    taken = F.least(F.count(F.lit(1)), F.lit(int(500 * 0.06)).cast("long"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), taken.alias("taken"), F.round(taken / 500, 6).alias("share"))


@query("mix_held_minus_train", f"WITH {D}, s AS (SELECT doc_id, h, CASE {m10('sha256(doc_id::VARCHAR)')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE 'train' END AS split FROM d) SELECT doc_id, split FROM s WHERE split <> 'train' AND doc_id NOT IN (SELECT doc_id FROM s WHERE split = 'train') AND h NOT IN (SELECT h FROM s WHERE split = 'train')")
def held_minus_train(spark, sf):
    """Held-out rows (split by id, so that states overlap) that share neither id nor state with any training row."""
    b = T.hex_mod10(F.sha2(F.col("doc_id").cast("string"), 256))
    s = docs(spark, sf).select("doc_id", "h", F.when(b == 8, "dev").when(b == 9, "calibration").otherwise("train").alias("split"))
    train = s.where("split = 'train'")
    return C.drop_exact_leaks(C.drop_exact_leaks(s.where("split <> 'train'"), "doc_id", train, "doc_id"), "h", train, "h").select("doc_id", "split")


@query("mix_repeat_replay", "WITH b AS (SELECT doc_id, k.i AS copy FROM documents, range(3) k(i) WHERE source = 'src1'), r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('17:' || doc_id), doc_id) AS rank, lang FROM documents WHERE source <> 'src1'), rr AS (SELECT doc_id FROM r ORDER BY rank, sha256('17:' || lang), lang LIMIT 60) SELECT doc_id, copy FROM b UNION ALL SELECT doc_id, -1 FROM rr")
def repeat_replay(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    copies = d.where("source = 'src1'").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("copy"))
    replay = C.round_robin(d.where("source <> 'src1'"), "lang", "doc_id", 17, 60).select("doc_id", F.lit(-1).cast("long").alias("copy"))
    return copies.unionByName(replay)


@query("win_balanced_take", "WITH l AS (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT least(count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1), 60) AS half FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM l) SELECT doc_id, toxic FROM r, n WHERE toxic IS NULL OR k <= half ORDER BY doc_id LIMIT 120")
def balanced_take(spark, sf):
    l = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return C.balanced_take(l, "toxic", "doc_id", 120).select("doc_id", "toxic")


@query("aug_state_swap", "WITH o AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS o, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(64, (count(*) + 9999) // 10000) FROM documents) AS g FROM documents) SELECT doc_id, coalesce(lead(doc_id) OVER (PARTITION BY g ORDER BY o), first_value(doc_id) OVER (PARTITION BY g ORDER BY o)) AS swapped_doc_id FROM o")
def state_swap(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("o"))
    return C.cyclic_swap(hashed, "o", ["doc_id"]).select("doc_id", "swapped_doc_id")


@query("audit_sample", "WITH t AS (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS tier FROM labels) SELECT doc_id, tier FROM t ORDER BY tier, sha256('9:' || doc_id) LIMIT 50")
def audit_sample(spark, sf):
    tier = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 0).when(F.col("quality") == 0, 1).otherwise(2)
    return table(spark, sf, "labels").select("doc_id", tier.alias("tier")).orderBy("tier", T.seeded_hash(9, F.col("doc_id"))).limit(50)


@query("set_union_pool", "SELECT 'documents' AS pool, doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT 'conversations', conv_id, NULL, turn FROM conversations")
def union_pool(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("documents").alias("pool"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf, "conversations").select(F.lit("conversations").alias("pool"), F.col("conv_id").alias("id"), "turn")
    return a.unionByName(b, allowMissingColumns=True)


SPLIT = f"s AS (SELECT doc_id, h, source, CASE {m10('sha256(doc_id::VARCHAR)')} WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM d)"


def split_docs(spark, sf):
    b = T.hex_mod10(F.sha2(F.col("doc_id").cast("string"), 256))
    return docs(spark, sf).select("doc_id", "h", "source", F.when(b == 8, "dev").when(b == 9, "test").otherwise("train").alias("split"))


@query("set_disjoint", f"WITH {D}, {SPLIT} SELECT h AS key, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY h HAVING count(DISTINCT split) > 1")
def set_disjoint(spark, sf):
    return split_docs(spark, sf).groupBy(F.col("h").alias("key")).agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


@query("set_disjoint_study", f"WITH {D} SELECT h AS key, count(*) AS n FROM d GROUP BY h HAVING count(*) > 1")
def set_disjoint_study(spark, sf):
    return docs(spark, sf).groupBy(F.col("h").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("set_overlap_matrix", f"WITH {D}, {SPLIT}, u AS (SELECT DISTINCT h, split FROM s) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM u a JOIN u b ON a.h = b.h AND a.split < b.split GROUP BY 1, 2")
def overlap_matrix(spark, sf):
    # Splits per key as one small set: pairs come from the set, not from a self-join.
    sets = split_docs(spark, sf).groupBy("h").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.where(F.size("s") > 1).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("set_minus", f"WITH {D}, {SPLIT} SELECT DISTINCT h FROM s WHERE split = 'dev' EXCEPT SELECT h FROM s WHERE split = 'test'")
def set_minus(spark, sf):
    s = split_docs(spark, sf)
    return s.where("split = 'dev'").select("h").subtract(s.where("split = 'test'").select("h"))


@query("set_exact_member", "SELECT text, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text, lang FROM documents WHERE doc_id % 2 = 1")
def exact_member(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("doc_id % 2 = 0").select("text", "lang").intersect(d.where("doc_id % 2 = 1").select("text", "lang"))


@query("set_used_check", f"WITH {D}, {SPLIT} SELECT doc_id FROM s WHERE split <> 'train' AND h IN (SELECT h FROM s WHERE split = 'train')")
def used_check(spark, sf):
    s = split_docs(spark, sf)
    return s.where("split <> 'train'").join(s.where("split = 'train'").select("h"), "h", "left_semi").select("doc_id")


@query("set_distinct_instr", "SELECT DISTINCT text FROM conversations WHERE role = 'user'")
def distinct_instr(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("text").distinct()


@query("set_duplicates", f"WITH {D}, {SPLIT}, c AS (SELECT split, h, count(*) AS n FROM s GROUP BY 1, 2) SELECT split, sum(n - 1)::BIGINT AS extra FROM c GROUP BY split")
def duplicates(spark, sf):
    c = split_docs(spark, sf).groupBy("split", "h").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("split").agg(F.sum(F.col("n") - 1).alias("extra"))


@query("set_seen_index", f"WITH {D} SELECT 'state' AS kind, h AS key FROM d UNION SELECT 'id', doc_id::VARCHAR FROM d UNION SELECT 'state', {H} FROM benchmark UNION SELECT 'id', item_id::VARCHAR FROM benchmark")
def seen_index(spark, sf):
    d = docs(spark, sf).select("h", "doc_id")
    b = table(spark, sf, "benchmark").select(T.state_hash(F.col("text")).alias("h"), F.col("item_id").alias("doc_id"))
    both = d.unionByName(b)
    keys = F.array(F.struct(F.lit("state").alias("kind"), F.col("h").alias("key")), F.struct(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("key")))
    return both.select(F.inline(keys)).distinct()


@query("agg_counts_by", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source")
def counts_by(spark, sf):
    return table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


@query("agg_distinct_digest", f"WITH {D} {set_digest_sql('d', 'lang', 'h')}")
def distinct_digest(spark, sf):
    return set_digest(docs(spark, sf), "lang", "h")


@query("agg_group_sizes", f"WITH {D}, c AS (SELECT h, count(*) AS size FROM d GROUP BY h) SELECT size, count(*) AS groups FROM c GROUP BY size")
def group_sizes(spark, sf):
    return docs(spark, sf).groupBy("h").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


@query("agg_polarity", "SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def polarity(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("agg_target_balance", "WITH q AS (SELECT lang, u.question, u.v FROM documents JOIN labels USING (doc_id), unnest([{'question': 'quality', 'v': quality}, {'question': 'toxic', 'v': toxic}]) AS t(u)) SELECT lang, question, v AS slot, count(*) AS n FROM q GROUP BY 1, 2, 3")
def target_balance(spark, sf):
    pairs = F.array(F.struct(F.lit("quality").alias("question"), F.col("quality").alias("slot")), F.struct(F.lit("toxic").alias("question"), F.col("toxic").alias("slot")))
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return l.select("lang", F.inline(pairs)).groupBy("lang", "question", "slot").agg(F.count(F.lit(1)).alias("n"))


@query("snk_manifest", f"WITH {D} SELECT source, count(*) AS n, count(DISTINCT h) AS states, sum(strlen(text))::BIGINT AS bytes FROM d GROUP BY source")
def manifest(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("states"), F.sum(F.octet_length("text")).alias("bytes"))


@query("src_parquet", "SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents")
def src_parquet(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))


NUM = r"\d+(?:[.,:]\d+)*"


@query("fn_number_tokens", rf"SELECT doc_id, len(regexp_extract_all(text, '{NUM}')) AS n, list_sort(list_distinct(regexp_extract_all(text, '{NUM}')))[1:5] AS first FROM documents")
def fn_number_tokens(spark, sf):
    n = T.number_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(n).cast("long").alias("n"), F.slice(F.array_sort(F.array_distinct(n)), 1, 5).alias("first"))


@query("fn_lexical_overlap", "WITH b AS (SELECT d.doc_id, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(c.text), '[a-z0-9]+') AS b FROM documents d JOIN documents c ON c.doc_id = d.doc_id + 1) SELECT doc_id, len(list_intersect(a, b)) AS overlap FROM b")
def fn_lexical_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(nxt, "doc_id").select("doc_id", T.lexical_overlap(F.col("text"), F.col("other")).cast("long").alias("overlap"))


RULES = [("licens", "license"), ("@", "contact"), (r"\|", "table"), ("###", "marks")]


@query("request_kind", "SELECT doc_id, CASE WHEN text LIKE '%licens%' THEN 'license' WHEN text LIKE '%@%' THEN 'contact' WHEN text LIKE '%|%' THEN 'table' WHEN text LIKE '%###%' THEN 'marks' ELSE 'other' END AS kind FROM documents")
def request_kind(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_match(RULES, F.col("text"), "other").alias("kind"))


@query("token_bucket_histogram", "WITH t AS (SELECT CASE WHEN n_chars <= 1024 THEN '<=1024' WHEN n_chars <= 2048 THEN '<=2048' WHEN n_chars <= 4096 THEN '<=4096' WHEN n_chars <= 6144 THEN '<=6144' ELSE '>6144' END AS bucket FROM documents) SELECT bucket, count(*) AS n FROM t GROUP BY bucket")
def token_buckets(spark, sf):
    b = None
    for edge in (1024, 2048, 4096, 6144):
        b = F.when(F.col("n_chars") <= edge, f"<={edge}") if b is None else b.when(F.col("n_chars") <= edge, f"<={edge}")
    return table(spark, sf, "documents").groupBy(b.otherwise(">6144").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("token_filter", "SELECT source, count(*) FILTER (WHERE strlen(text) > 6144) AS dropped, count(*) FILTER (WHERE strlen(text) <= 6144) AS kept FROM documents GROUP BY source")
def token_filter(spark, sf):
    long = F.octet_length("text") > 6144
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(long).alias("dropped"), F.count_if(~long).alias("kept"))


@query("keep_columns", "SELECT doc_id, lang, NULL::VARCHAR AS tier, NULL::VARCHAR AS cell FROM documents")
def keep_columns(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(*[F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "lang", "tier", "cell")])


@query("locale_of", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS locale FROM pages")
def locale_of(spark, sf):
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf, "pages").select("page_id", F.split_part(rest, F.lit("/"), F.lit(1)).alias("host"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("locale"))


@query("strat_label", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'all' WHEN doc_id % 3 = 1 THEN lang ELSE (n_chars % 5)::VARCHAR END AS stratum FROM documents")
def strat_label(spark, sf):
    m = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", F.when(m == 0, "all").when(m == 1, F.col("lang")).otherwise((F.col("n_chars") % 5).cast("string")).alias("stratum"))


@query("join_sources", f"WITH {D}, o AS (SELECT h, count(DISTINCT source) AS owners, min(source) AS owner FROM d GROUP BY h) SELECT doc_id, owners, owner = source AS same_group FROM d JOIN o USING (h)")
def join_sources(spark, sf):
    d = docs(spark, sf)
    o = d.groupBy("h").agg(F.count_distinct("source").alias("owners"), F.min("source").alias("owner"))
    return d.join(o, "h").select("doc_id", "owners", (F.col("owner") == F.col("source")).alias("same_group"))


@query("win_pair_cut", "WITH p AS (SELECT doc_id, doc_id // 2 AS pair_id FROM documents WHERE n_chars > 500) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY pair_id) = 2 THEN pair_id END AS pair_id FROM p")
def pair_cut(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "documents").where("n_chars > 500").select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair_id"))
    return p.select("doc_id", F.when(F.count(F.lit(1)).over(Window.partitionBy("pair_id")) == 2, F.col("pair_id")).alias("pair_id"))


@query("check_order", f"WITH {D}, o AS (SELECT doc_id, h, unnest(['a', 'b', 'c', 'd']) AS key FROM d) SELECT doc_id, string_agg(key, '' ORDER BY sha256(h || key)) AS keys FROM o GROUP BY doc_id")
def check_order(spark, sf):
    keys = F.array_sort(F.array(*(F.struct(F.sha2(F.concat("h", F.lit(k)), 256).alias("o"), F.lit(k).alias("key")) for k in "abcd")))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(keys, lambda x: x["key"]), "").alias("keys"))


@query("spec_sample", "SELECT i, CASE i % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind, (i // 3) % 2 = 0 AS polarity, (i % 7) + 2 AS k FROM range(210) r(i)")
def spec_sample(spark, sf):
    i = F.col("id")
    return spark.range(210).select(i.alias("i"), F.when(i % 3 == 0, "choice").when(i % 3 == 1, "score").otherwise("noul").alias("kind"), (F.floor(i / 3) % 2 == 0).alias("polarity"), (i % 7 + 2).alias("k"))
