"""End-to-end compositions of the operators, the natural integration tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dists as DI
from loomline.functions import text as T
from loomline.operators import corpus as C
from loomline.operators import requests as Q
from loomline.operators import scorer as SC
from loomline.operators import scoring as S
from loomline.plans.corpus import D, H, SH, docs, level_sql, m10
from loomline.plans.facts import fit_sql, pred_sql, predictions
from loomline.plans.registry import query, table
from loomline.sources.shared import written

CLEAN = f"""{D}, one AS (SELECT min(doc_id) AS doc_id, h FROM d GROUP BY h), b AS (SELECT DISTINCT {H} AS h FROM benchmark),
    bs AS (SELECT DISTINCT unnest({SH}) AS s FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 12),
    gs AS (SELECT doc_id, unnest({SH}) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 12),
    leak AS (SELECT DISTINCT doc_id FROM gs SEMI JOIN bs USING (s)),
    clean AS (SELECT d.* FROM d JOIN one USING (doc_id) WHERE d.h NOT IN (SELECT h FROM b) AND doc_id NOT IN (SELECT doc_id FROM leak))"""


def clean_docs(spark, sf):
    """Documents without repeats and without leaks of the benchmark: by exact hash and by 12-word shingle."""
    d = C.dedup_first(docs(spark, sf), "h", "doc_id")
    bench = table(spark, sf, "benchmark")
    d = C.drop_exact_leaks(d, "h", bench.select(T.state_hash(F.col("text")).alias("h")), "h")
    d = written(d, "unique")
    return d.join(C.shingle_leaks(d, "doc_id", "text", bench, "text", 12).select("doc_id"), "doc_id", "left_anti")


@query("pipe_corpus_report", f"WITH {CLEAN}, s AS (SELECT source, CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE 'train' END AS split FROM (SELECT source, sha256('17:' || h) AS x FROM clean)) SELECT source, split, count(*) AS n FROM s GROUP BY 1, 2")
def corpus_report(spark, sf):
    s = clean_docs(spark, sf).select("source", C.split10(F.col("h"), 17).alias("split"))
    return s.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("pipe_mix", f"WITH {CLEAN}, k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id), doc_id) AS r FROM clean WHERE strlen(text) <= 6144) SELECT doc_id, source FROM k WHERE r <= 12")
def pipe_mix(spark, sf):
    short = clean_docs(spark, sf).where(F.octet_length("text") <= 6144).select("doc_id", "source")
    return C.take_per(short, "source", "doc_id", 17, 12).select("doc_id", "source")


@query("pipe_production", f"WITH {CLEAN}, s AS (SELECT doc_id, source FROM clean WHERE strlen(text) <= 6144), c AS (SELECT source, count(*) AS n FROM s GROUP BY source), k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id), doc_id) AS r FROM s) SELECT doc_id, source FROM k WHERE r <= {level_sql('c', 300, 25)}")
def pipe_production(spark, sf):
    """Leak-free, deduplicated, length-filtered documents, allocated over sources by water-filling."""
    short = written(clean_docs(spark, sf).where(F.octet_length("text") <= 6144).select("doc_id", "source"), "short")
    level = C.water_level(short.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "n", 300, 25)
    return C.take_per(short, "source", "doc_id", 17, level).select("doc_id", "source")


@query("pipe_banking", f"WITH {D}, o AS (SELECT doc_id, h, lang, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) AS k FROM d), u AS (SELECT * FROM o WHERE k = 1 AND h NOT IN (SELECT h FROM d GROUP BY h HAVING count(DISTINCT source) > 1)), s AS (SELECT lang, CASE {m10('x')} WHEN 8 THEN 'dev' WHEN 9 THEN 'calibration' ELSE 'train' END AS split FROM (SELECT lang, sha256('17:' || h) AS x FROM u)) SELECT split, lang, count(*) AS n FROM s GROUP BY 1, 2")
def pipe_banking(spark, sf):
    d = docs(spark, sf)
    u = C.dedup_last(C.drop_conflicts(d, "h", "source"), "h", F.lit(0), "doc_id")
    return u.groupBy(C.split10(F.col("h"), 17).alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("pipe_public", f"WITH {D}, t AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM d), u AS (SELECT t.* FROM t JOIN (SELECT h, max(split = 'test') AS tested, min(doc_id) AS first, min(CASE WHEN split = 'test' THEN doc_id END) AS first_test, count(DISTINCT source) AS owners FROM t GROUP BY h) m ON t.h = m.h AND doc_id = coalesce(first_test, first) WHERE owners = 1) SELECT split, source, count(*) AS n FROM u GROUP BY 1, 2")
def pipe_public(spark, sf):
    """Convert, drop states of several sources, dedup with the test row winning, count."""
    t = docs(spark, sf).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    own = C.drop_conflicts(t, "h", "source").withColumn("back", -F.col("doc_id"))
    u = C.dedup_last(own, "h", (F.col("split") == "test").cast("int"), "back")
    return u.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@query("pipe_distill", f"""WITH {pred_sql('a')}, {pred_sql('b', 20)}, t AS (SELECT a.id, a.grp, CASE WHEN a.grp % 5 = 0 OR a.id % 20 = 7 THEN 'dev' ELSE 'train' END AS split,
    round(list_max(list_transform(range(1, a.k + 1), lambda i: 0.7 * a.y[i] + 0.3 * b.p[i])), 6) AS top FROM a JOIN b ON a.id = b.id AND a.grp = b.grp AND a.k = b.k)
    SELECT id, split, top FROM t WHERE split = 'train' OR NOT EXISTS (SELECT 1 FROM t o WHERE o.split = 'train' AND o.grp = t.grp)""")
def pipe_distill(spark, sf):
    """Teacher blend of one-hot targets, then held-out rows without any group of the training rows."""
    a, b = predictions(spark, sf), predictions(spark, sf, first=20)
    blend = F.zip_with("a.y", "b.p", lambda g, t: 0.7 * g + 0.3 * t)
    both = S.paired(a.select("id", "grp", "k", "y"), b.select("id", "grp", "k", "p"), ["id", "grp"], ["k"]).select("id", "grp", blend.alias("y"))
    split = F.when((F.col("grp") % 5 == 0) | (F.col("id") % 20 == 7), "dev").otherwise("train")
    both = both.withColumn("split", split)
    held = C.drop_exact_leaks(both.where("split = 'dev'"), "grp", both.where("split = 'train'"), "grp")
    return both.where("split = 'train'").unionByName(held).select("id", "split", F.round(F.array_max("y"), 6).alias("top"))


@query("pipe_evaluate", f"""WITH {pred_sql()}, even AS (SELECT * FROM pred WHERE grp % 2 = 0), {fit_sql('fit', 'even')}, q AS (SELECT id, k, t, y, correct, uniform_nll, list_transform(z, lambda x: exp((x - list_max(z)) / temperature)) AS e FROM pred, fit WHERE grp % 2 = 1),
    n AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM q),
    m AS (SELECT 'calibrated' AS run, correct, uniform_nll, -ln(greatest(p[t + 1], 1e-12)) AS nll, list_sum(list_transform(range(1, k + 1), lambda i: (p[i] - y[i]) ** 2)) AS brier, -p[t + 1] / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-12) AS spherical FROM n
      UNION ALL SELECT 'raw', correct, uniform_nll, nll, brier, spherical FROM pred WHERE grp % 2 = 1)
    SELECT run, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier, round(avg(spherical), 6) AS spherical, round(avg(uniform_nll), 6) AS uniform_nll FROM m GROUP BY run""")
def pipe_evaluate(spark, sf):
    """Fit a temperature on even groups, apply it to odd groups, report before and after."""
    s = predictions(spark, sf)
    t = S.fit_temperature(s.where("grp % 2 = 0")).select("temperature")
    odd = s.where("grp % 2 = 1").crossJoin(F.broadcast(t))  # one row
    after = S.with_scores(odd.withColumn("p", DI.softmax(F.col("z"), F.col("temperature"))))
    one = lambda df, name: S.metrics(df.withColumn("run", F.lit(name)), "run")
    return one(odd, "raw").unionByName(one(after, "calibrated"))


@query("scorer_lexical", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), r AS (SELECT doc_id, list_transform([['the', 'and', 'of'], ['der', 'die', 'das'], ['que', 'los', 'el'], ['les', 'de', 'la']],
    lambda o: 1 + len(list_filter(o, lambda x: list_contains(w, x)))) AS r FROM w) SELECT doc_id, list_transform(r, lambda x: round(x / list_sum(r), 6)) AS p FROM r""")
def scorer_lexical(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("state"), F.lit("Which words occur?").alias("instructions"), F.array(*map(F.lit, ("the and of", "der die das", "que los el", "les de la"))).alias("options"))
    return SC.score(d, SC.lexical).select("doc_id", F.transform("probabilities", lambda x: F.round(x, 6)).alias("p"))


@query("src_jsonl", "SELECT 'toxic:' || doc_id AS group_id, 1::BIGINT AS questions, toxic::DOUBLE AS p_true FROM labels")
def src_jsonl(spark, sf):
    """Requests written as JSON lines and read back through the typed reader."""
    from loomline.sources.requests import read_requests, write_requests
    from loomline.sources.shared import shared_path

    q = F.array(Q.noul("toxic", "Is the text toxic?", F.col("toxic").cast("double")))
    r = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("state"), F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")).alias("group_id"), q.alias("questions"))
    path = shared_path(spark, "requests")
    write_requests(r, path)
    return read_requests(spark, path).select("group_id", F.size("questions").cast("long").alias("questions"), F.col("questions")[0]["target"][1].alias("p_true"))
