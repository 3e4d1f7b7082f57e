"""Integrity audits, exposure replay and validation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.dists import total, valid_distribution
from loomline.operators.corpus import hash_sample
from loomline.operators.ranks import ranked, set_digest, set_digest_sql
from loomline.plans.corpus import SPLIT, D, H, docs, split_docs
from loomline.plans.registry import query, table


def violations(parts):
    """(check, violations, passed) rows from (name, one-column count DataFrame) pairs: no check stops another."""
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("violations") == 0)


@query("audit_study", f"""WITH {D}, {SPLIT},
    c AS (SELECT 'null_text' AS "check", count(*) FILTER (WHERE text IS NULL) AS violations FROM documents
    UNION ALL SELECT 'duplicate_id', count(*) - count(DISTINCT doc_id) FROM documents
    UNION ALL SELECT 'duplicate_state', count(*) - count(DISTINCT h) FROM d
    UNION ALL SELECT 'shared_state', count(*) FROM (SELECT h FROM s GROUP BY h HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'unknown_lang', count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) FROM d
    UNION ALL SELECT 'bad_label', count(*) FILTER (WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) FROM labels
    UNION ALL SELECT 'orphan_label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'benchmark_state', count(*) FROM d WHERE h IN (SELECT {H} FROM benchmark))
    SELECT *, violations = 0 AS passed FROM c""")
def audit_study(spark, sf):
    d, s, raw, labels = docs(spark, sf), split_docs(spark, sf), table(spark, sf, "documents"), table(spark, sf, "labels")
    bench = table(spark, sf, "benchmark").select(T.state_hash(F.col("text")).alias("h"))
    n = F.count(F.lit(1))
    bad = ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)
    return violations([
        ("null_text", raw.agg(F.count_if(F.col("text").isNull()))),
        ("duplicate_id", raw.agg(n - F.count_distinct("doc_id"))),
        ("duplicate_state", d.agg(n - F.count_distinct("h"))),
        ("shared_state", s.groupBy("h").agg(F.count_distinct("split").alias("n")).where("n > 1").agg(n)),
        ("unknown_lang", d.agg(F.count_if(~F.col("lang").isin("en", "de", "fr", "es")))),
        ("bad_label", labels.agg(F.count_if(bad))),
        ("orphan_label", labels.join(raw.select("doc_id"), "doc_id", "left_anti").agg(n)),
        ("benchmark_state", d.join(bench, "h", "left_semi").agg(n)),
    ])


@query("audit_partition", f"WITH {D}, m AS (SELECT doc_id, (doc_id % 2 = 0)::INT AS seen, (doc_id % 3 = 0)::INT AS unseen FROM d) SELECT CASE WHEN seen + unseen = 2 THEN 'both' WHEN seen = 1 THEN 'seen' WHEN unseen = 1 THEN 'unseen' ELSE 'unclassified' END AS membership, count(*) AS n FROM m GROUP BY 1")
def audit_partition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    seen = d.where("doc_id % 2 = 0").withColumn("seen", F.lit(1))
    unseen = d.where("doc_id % 3 = 0").withColumn("unseen", F.lit(1))
    j = d.join(seen, "doc_id", "left").join(unseen, "doc_id", "left")
    a, b = F.col("seen").isNotNull(), F.col("unseen").isNotNull()
    return j.groupBy(F.when(a & b, "both").when(a, "seen").when(b, "unseen").otherwise("unclassified").alias("membership")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_premise_group", "SELECT conv_id, turn, sha256(split_part(text, '. ', 1)) AS premise FROM conversations")
def premise_group(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.split_part("text", F.lit(". "), F.lit(1)), 256).alias("premise"))


EPOCH = "o AS (SELECT e.epoch AS epoch, doc_id, source, h, row_number() OVER (PARTITION BY e.epoch ORDER BY sha256(e.epoch || ':' || doc_id), doc_id) AS k FROM d, range(2) e(epoch))"


@query("win_epoch_order", f"WITH {D}, {EPOCH} SELECT epoch, doc_id, k AS presentation, ceil(k / 32)::BIGINT AS step FROM o")
def epoch_order(spark, sf):
    """A seeded order of all rows in each epoch: presentation k and its step of 32, the last step partial."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    d = d.withColumn("o", F.sha2(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col("doc_id").cast("string")), 256))
    return ranked(d, ["o", "doc_id"], by=["epoch"], name="presentation").select("epoch", "doc_id", "presentation", F.ceil(F.col("presentation") / 32).alias("step"))


@query("audit_exposure", f"WITH {D}, {EPOCH}, cut AS (SELECT * FROM o WHERE k <= 300) SELECT * FROM (SELECT source, count(*) AS presented, count(DISTINCT h) AS states FROM cut GROUP BY source) JOIN ({set_digest_sql('cut', 'source', 'h')}) USING (source)")
def exposure(spark, sf):
    """What the first 300 presentations of each epoch (the run's own budget) held, by source."""
    d, cut = docs(spark, sf).select("doc_id", "source", "h"), None
    for epoch in range(2):
        one = hash_sample(d, "doc_id", 300, epoch)
        cut = one if cut is None else cut.unionByName(one)
    told = cut.groupBy("source").agg(F.count(F.lit(1)).alias("presented"), F.count_distinct("h").alias("states"))
    return told.join(set_digest(cut, "source", "h"), "source")


@query("audit_stop_reason", "SELECT vec_id, CASE WHEN label * 100 >= 900 THEN 'max_steps' WHEN vec_id % 4 = 3 THEN 'epochs' WHEN vec_id % 7 = 0 THEN 'max_seconds' ELSE 'incomplete' END AS reason FROM embeddings")
def stop_reason(spark, sf):
    r = F.when(F.col("label") * 100 >= 900, "max_steps").when(F.col("vec_id") % 4 == 3, "epochs").when(F.col("vec_id") % 7 == 0, "max_seconds").otherwise("incomplete")
    return table(spark, sf, "embeddings").select("vec_id", r.alias("reason"))


@query("audit_panel", "SELECT count(*) FILTER (WHERE a IS NULL) AS extra, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS covered FROM (SELECT doc_id AS a FROM documents WHERE doc_id % 3 <> 0) x FULL JOIN (SELECT doc_id AS b FROM labels) y ON a = b")
def audit_panel(spark, sf):
    a = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("a"))
    b = table(spark, sf, "labels").select(F.col("doc_id").alias("b"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return j.agg(F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("covered"))


@query("validate_question", "WITH q AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind, label + vec_id % 4 AS k FROM embeddings) SELECT vec_id, CASE WHEN kind = 'choice' AND NOT k BETWEEN 1 AND 255 THEN 'choice_cardinality' WHEN kind = 'score' AND NOT k BETWEEN 2 AND 10 THEN 'score_levels' WHEN kind = 'noul' AND k <> 2 THEN 'noul_options' END AS violation FROM q")
def validate_question(spark, sf):
    from loomline.operators.requests import question_violation

    kind = F.when(F.col("vec_id") % 3 == 0, "choice").when(F.col("vec_id") % 3 == 1, "score").otherwise("noul")
    k = (F.col("label") + F.col("vec_id") % 4).cast("int")
    options = F.filter(F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.cast("string").alias("key"), F.lit("d").alias("description"))), lambda o: o["key"].cast("int") < k)
    q = table(spark, sf, "embeddings").select("vec_id", F.struct(kind.alias("kind"), F.lit("ask").alias("instructions"), options.alias("options"), F.lit(None).cast("array<double>").alias("target")).alias("q"))
    return q.select("vec_id", question_violation(F.col("q"), noul_keys=False).alias("violation"))


@query("validate_prediction", "WITH p AS (SELECT vec_id // 2 AS decision, label AS k, vec_id FROM embeddings) SELECT vec_id, CASE WHEN k < 1 THEN 'cardinality' WHEN count(*) OVER (PARTITION BY decision) > 1 AND vec_id % 10 < 2 THEN 'duplicate_decision' END AS violation FROM p")
def validate_prediction(spark, sf):
    p = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("decision"), "vec_id", F.col("label").alias("k"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("decision")) > 1
    return p.select("vec_id", F.when(F.col("k") < 1, "cardinality").when(twice & (F.col("vec_id") % 10 < 2), "duplicate_decision").alias("violation"))


@query("val_calibration", "WITH t AS (SELECT vec_id, embedding[1]::DOUBLE AS t, embedding[2]::DOUBLE AS h FROM embeddings) SELECT count(*) FILTER (WHERE NOT (isfinite(t) AND t > 0)) AS bad_temperature, count(*) FILTER (WHERE NOT (h >= 0 AND h <= 1)) AS bad_histogram FROM t")
def val_calibration(spark, sf):
    t, h = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf, "embeddings").agg(F.count_if(~((t > 0) & (t < float("inf")))).alias("bad_temperature"), F.count_if(~((h >= 0) & (h <= 1))).alias("bad_histogram"))


@query("val_calib_split", f"WITH {D}, {SPLIT} SELECT count(DISTINCT a.h) AS shared, (SELECT count(*) - count(DISTINCT h) FROM s WHERE split = 'dev') AS repeated FROM s a JOIN s b ON a.h = b.h AND a.split = 'dev' AND b.split = 'test'")
def val_calib_split(spark, sf):
    s = split_docs(spark, sf)
    dev, test = s.where("split = 'dev'"), s.where("split = 'test'")
    shared = dev.join(test.select("h"), "h", "left_semi").agg(F.count_distinct("h").alias("shared"))
    return shared.crossJoin(dev.agg((F.count(F.lit(1)) - F.count_distinct("h")).alias("repeated")))


@query("val_remote_rows", "WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: abs(x::DOUBLE)) AS a FROM embeddings), q AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN a ELSE list_transform(a, lambda x: x / list_sum(a)) END AS p FROM p) SELECT count(*) AS n, count(*) FILTER (WHERE abs(list_sum(p) - 1) > 1e-8) AS bad FROM q")
def val_remote_rows(spark, sf):
    a = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    e = table(spark, sf, "embeddings").select("vec_id", a.alias("a"))
    p = F.when(F.col("vec_id") % 9 == 0, F.col("a")).otherwise(F.transform("a", lambda x: x / total(F.col("a"))))
    return e.withColumn("p", p).agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid_distribution(F.col("p"), tolerance=1e-8)).alias("bad"))


@query("val_generated", "SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN n_chars > 20000 THEN 'too_long' WHEN n_chars < 200 THEN 'too_short' WHEN text LIKE '%###%' THEN 'marks' WHEN text LIKE '%!!%' THEN 'shouting' WHEN text LIKE '%@%' THEN 'personal' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN text LIKE '%| %' THEN 'table' WHEN n_chars <> length(text) THEN 'length' END AS reason FROM documents")
def val_generated(spark, sf):
    t, n = F.col("text"), F.col("n_chars")
    ordered = [("empty", t == ""), ("too_long", n > 20000), ("too_short", n < 200), ("marks", t.contains("###")), ("shouting", t.contains("!!")), ("personal", t.contains("@")), ("language", ~F.col("lang").isin("en", "de")), ("table", t.contains("| ")), ("length", n != F.length(t))]
    return table(spark, sf, "documents").select("doc_id", F.coalesce(*(F.when(c, F.lit(r)) for r, c in ordered)).alias("reason"))


@query("triage", "WITH c AS (SELECT vec_id, label AS gold, vec_id % 10 AS c1, CASE WHEN vec_id % 4 <> 0 THEN (vec_id // 2) % 10 END AS c2 FROM embeddings) SELECT vec_id, CASE WHEN c1 = gold THEN 'T3' WHEN c2 IS NULL THEN 'discard' WHEN c2 = gold THEN 'T3_second' WHEN c1 = c2 THEN 'T4' ELSE 'discard' END AS tier FROM c")
def triage(spark, sf):
    g, c1 = F.col("label"), F.col("vec_id") % 10
    c2 = F.when(F.col("vec_id") % 4 != 0, F.floor(F.col("vec_id") / 2) % 10)
    tier = F.when(c1 == g, "T3").when(c2.isNull(), "discard").when(c2 == g, "T3_second").when(c1 == c2, "T4").otherwise("discard")
    return table(spark, sf, "embeddings").select("vec_id", tier.alias("tier"))


@query("accept_rates", "WITH c AS (SELECT label AS cell, vec_id % 10 AS c1, vec_id % 7 = 0 AS invalid FROM embeddings) SELECT cell, count(*) AS requested, count(*) FILTER (WHERE invalid) AS invalid, count(*) FILTER (WHERE NOT invalid AND c1 = cell) AS accepted, round(count(*) FILTER (WHERE NOT invalid AND c1 = cell) / count(*), 6) AS acceptance FROM c GROUP BY cell")
def accept_rates(spark, sf):
    bad, hit = F.col("vec_id") % 7 == 0, F.col("vec_id") % 10 == F.col("label")
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("cell")).agg(F.count(F.lit(1)).alias("requested"), F.count_if(bad).alias("invalid"), F.count_if(~bad & hit).alias("accepted"), F.round(F.count_if(~bad & hit) / F.count(F.lit(1)), 6).alias("acceptance"))


@query("cost_cap", "WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cost FROM conversations) SELECT conv_id, turn, cost::BIGINT AS cost FROM r WHERE cost <= 1500")
def cost_cap(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text").cast("long")).over(w).alias("cost")).where("cost <= 1500")
