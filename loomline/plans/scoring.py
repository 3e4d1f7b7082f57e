"""Scoring rules, reliability, calibration, paired comparison and bootstrap on the prediction fact."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import dists as D
from loomline.operators import scoring as S
from loomline.operators.ranks import ranked
from loomline.plans.facts import fit_sql, pred_sql, predictions
from loomline.plans.registry import query, table

P = "WITH " + pred_sql()
PU = "WITH " + pred_sql(scored=False)
AGG = "count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier, round(avg(spherical), 6) AS spherical, round(avg(uniform_nll), 6) AS uniform_nll"
r6 = S.rounded


@query("agg_metrics", f"{P} SELECT family, {AGG} FROM pred GROUP BY family")
def agg_metrics(spark, sf):
    return S.metrics(predictions(spark, sf), "family")


@query("agg_losses", f"{P}, s AS (SELECT id, k, t, p, list_transform(y, lambda v: 0.9 * v + 0.1 / k) AS y, spherical FROM pred) SELECT count(*) AS n, round(avg(-list_sum(list_transform(range(1, k + 1), lambda i: y[i] * ln(greatest(p[i], 1e-12))))), 6) AS ce, round(avg(list_sum(list_transform(range(1, k + 1), lambda i: (p[i] - y[i]) ** 2))), 6) AS brier, round(avg(-list_sum(list_transform(range(1, k + 1), lambda i: p[i] * y[i])) / sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) AS spherical FROM s")
def agg_losses(spark, sf):
    s = predictions(spark, sf, scored=False).withColumn("y", D.smooth(F.col("y"), 0.1))
    p, y = F.col("p"), F.col("y")
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(D.nll(p, y))).alias("ce"), r6(F.avg(D.brier(p, y))).alias("brier"), r6(F.avg(D.spherical(p, y))).alias("spherical"))


def ece_sql(bin_: str, keep: str = "true") -> str:
    return f"{P}, b AS (SELECT {bin_} AS bin, count(*) AS n, sum(correct) AS a, sum(confidence) AS c FROM pred GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN {keep} THEN abs(a - c) ELSE 0 END) / sum(n), 6) AS ece FROM b"


@query("agg_ece_floor", ece_sql("least(floor(confidence * 10), 9)"))
def ece_floor(spark, sf):
    return S.calibration_error(predictions(spark, sf), D.bin_floor)


@query("agg_ece_right_closed", ece_sql("greatest(ceil(confidence * 10) - 1, 0)"))
def ece_right(spark, sf):
    return S.calibration_error(predictions(spark, sf), D.bin_right_closed)


@query("agg_ece_left_closed", ece_sql("CASE WHEN confidence < 1 THEN floor(confidence * 10) END", "bin IS NOT NULL"))
def ece_left(spark, sf):
    return S.calibration_error(predictions(spark, sf), D.bin_left_closed)


@query("agg_reliability", f"{P}, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM pred GROUP BY 1) SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, accuracy, confidence FROM range(10) r(bin) LEFT JOIN b ON r.bin = b.bin")
def reliability(spark, sf):
    return S.reliability(predictions(spark, sf))


@query("agg_selective_risk", f"{P}, r AS (SELECT correct, row_number() OVER (ORDER BY confidence DESC, id) AS k, count(*) OVER () AS n FROM pred), f AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS coverage) SELECT coverage, greatest(1, ceil(n * coverage))::BIGINT AS n, round(1 - avg(correct), 6) AS risk FROM r, f WHERE k <= greatest(1, ceil(n * coverage)) GROUP BY coverage, n")
def selective_risk(spark, sf):
    return S.selective_risk(predictions(spark, sf), "id")


@query("sort_confidence", f"{P} SELECT id, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY pred.confidence DESC, id) AS rank FROM pred")
def sort_confidence(spark, sf):
    told = predictions(spark, sf).select("id", "confidence", (-F.col("confidence")).alias("down"))
    return ranked(told, ["down", "id"]).select("id", r6(F.col("confidence")).alias("confidence"), "rank")


FLOORS = (1e-12, 1e-9, 1e-6, 1e-4, 1e-2)


@query("agg_nll_floors", f"{P} SELECT " + ", ".join(f"round(avg(-ln(greatest(p[t + 1], {f}))), 6) AS nll_floor_{i}" for i, f in enumerate(FLOORS)) + ", CASE WHEN bool_and(p[t + 1] > 0) THEN round(avg(-ln(p[t + 1])), 6) END AS nll_literal, bool_or(p[t + 1] <= 0) AS infinite FROM pred")
def nll_floors(spark, sf):
    return S.nll_floors(predictions(spark, sf), FLOORS)


@query("agg_score_mae", f"{P}, e AS (SELECT t, list_sum(list_transform(range(0, k), lambda i: i * p[i + 1])) AS level FROM pred WHERE kind = 'score') SELECT count(*) AS n, round(avg(abs(t - level)), 6) AS mae FROM e")
def score_mae(spark, sf):
    s = predictions(spark, sf).where("kind = 'score'").withColumn("level", D.expected_level(F.col("p")))
    mae = D.total(F.transform("y", lambda t, i: t * F.abs(i - F.col("level"))))
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(mae)).alias("mae"))


@query("agg_grouping", f"{P} SELECT kind, family, k, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll FROM pred GROUP BY GROUPING SETS ((), (kind), (family), (k), (kind, family))")
def grouping(spark, sf):
    return S.metrics_by_sets(predictions(spark, sf), [[], ["kind"], ["family"], ["k"], ["kind", "family"]], ["kind", "family", "k"])


@query("agg_macro", f"{P}, f AS (SELECT family, avg(correct) AS a, count(*) AS n, sum(correct) AS s FROM pred GROUP BY family) SELECT round(avg(a), 6) AS macro, round(sum(s) / sum(n), 6) AS weighted FROM f")
def macro(spark, sf):
    f = predictions(spark, sf).groupBy("family").agg(F.avg("correct").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("correct").alias("s"))
    return f.agg(r6(F.avg("a")).alias("macro"), r6(F.sum("s") / F.sum("n")).alias("weighted"))


@query("agg_uniform_baseline", f"{P} SELECT kind, round(avg(ln(k)), 6) AS uniform_nll FROM pred GROUP BY kind")
def uniform_baseline(spark, sf):
    return predictions(spark, sf).groupBy("kind").agg(r6(F.avg("uniform_nll")).alias("uniform_nll"))


@query("agg_topk_hit", f"{P}, t AS (SELECT kind, t, list_position(p, list_max(p)) - 1 AS best, list_transform(list_slice(list_sort(list_transform(range(0, k), lambda i: [-p[i + 1], i])), 1, 3), lambda x: x[2]) AS top FROM pred) SELECT kind, count(*) AS n, round(avg(CASE WHEN list_contains(top, t) THEN 1 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN abs(best - t) <= 1 THEN 1 ELSE 0 END), 6) AS near FROM t GROUP BY kind")
def topk_hit(spark, sf):
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda x: x["i"])
    t = D.argmax(F.col("y"))
    return predictions(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.array_contains(top, t).cast("int"))).alias("top3"), r6(F.avg((F.abs(D.argmax(F.col("p")) - t) <= 1).cast("int"))).alias("near"))


@query("agg_histogram_bin", f"{P} SELECT least(floor(confidence * 10), 9)::INT AS bin, round(avg(correct), 6) AS accuracy FROM pred GROUP BY 1")
def histogram_bin(spark, sf):
    return predictions(spark, sf).groupBy(D.bin_floor(F.col("confidence")).alias("bin")).agg(r6(F.avg("correct")).alias("accuracy"))


@query("apply_histogram", f"{P}, h AS (SELECT least(floor(confidence * 10), 9) AS bin, avg(correct) AS acc FROM pred GROUP BY 1), j AS (SELECT pred.*, acc, list_position(p, confidence) AS pos FROM pred JOIN h ON least(floor(confidence * 10), 9) = h.bin) SELECT id, list_transform(range(1, k + 1), lambda i: round(CASE WHEN i = pos THEN acc WHEN confidence < 1 THEN p[i] * (1 - acc) / (1 - confidence) ELSE (1 - acc) / (k - 1) END, 5)) AS p FROM j")
def apply_histogram(spark, sf):
    s = predictions(spark, sf).withColumn("bin", D.bin_floor(F.col("confidence")))
    h = s.groupBy("bin").agg(F.avg("correct").alias("acc"))  # ten rows
    out = s.join(F.broadcast(h), "bin").withColumn("q", D.apply_histogram(F.col("p"), F.col("acc")))
    return out.select("id", F.transform("q", lambda x: F.round(x, 5)).alias("p"))


@query("decode", f"{P} SELECT id, (list_position(p, confidence) - 1)::INT AS choice, round(list_sum(list_transform(range(0, k), lambda i: i * p[i + 1])), 6) AS level FROM pred")
def decode(spark, sf):
    return predictions(spark, sf).select("id", D.argmax(F.col("p")).alias("choice"), r6(D.expected_level(F.col("p"))).alias("level"))


@query("confidence", f"{P} SELECT id, round(confidence, 6) AS confidence FROM pred")
def confidence(spark, sf):
    return predictions(spark, sf).select("id", r6(F.col("confidence")).alias("confidence"))


@query("normalised_entropy", f"{P} SELECT id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(k), 6) AS h FROM pred")
def norm_entropy(spark, sf):
    return predictions(spark, sf).select("id", r6(D.normalised_entropy(F.col("p"))).alias("h"))


@query("softmax_temperature", f"{PU}, e AS (SELECT id, list_transform(z, lambda x: exp((x - list_max(z)) / 2.5)) AS e FROM pred), s AS (SELECT id, e, list_sum(e) AS t FROM e) SELECT id, list_transform(e, lambda x: round(x / t, 6)) AS p FROM s")
def softmax_t(spark, sf):
    return predictions(spark, sf, scored=False).select("id", F.transform(D.softmax(F.col("z"), 2.5), lambda x: F.round(x, 6)).alias("p"))


@query("label_smoothing", f"{PU} SELECT id, list_transform(y, lambda v: round(0.9 * v + 0.1 / k, 6)) AS y FROM pred")
def label_smoothing(spark, sf):
    return predictions(spark, sf, scored=False).select("id", F.transform(D.smooth(F.col("y"), 0.1), lambda x: F.round(x, 6)).alias("y"))


@query("cardinality_bucket", "SELECT vec_id, (2 ** greatest(1, ceil(log2(2 + label))))::INT AS bucket FROM embeddings")
def card_bucket(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", D.cardinality_bucket(F.col("label") + 2).alias("bucket"))


@query("validate_distribution", "WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: abs(x::DOUBLE)) AS a FROM embeddings), w AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(a, lambda x: x / list_sum(a)) ELSE a END AS p FROM v) SELECT vec_id, abs(list_sum(p) - 1) <= 1e-5 AND len(p) = 3 AS valid FROM w")
def validate_distribution(spark, sf):
    a = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    v = table(spark, sf, "embeddings").select("vec_id", a.alias("a"))
    p = F.when(F.col("vec_id") % 2 == 0, D.renormalise(F.col("a"))).otherwise(F.col("a"))
    return v.withColumn("p", p).select("vec_id", D.valid_distribution(F.col("p"), F.lit(3)).alias("valid"))


@query("val_pairs", f"{PU} SELECT count(*) AS n, count(*) FILTER (WHERE len(z) <> len(y)) AS bad_length, count(*) FILTER (WHERE abs(list_sum(y) - 1) > 1e-5) AS bad_sum FROM pred")
def val_pairs(spark, sf):
    return predictions(spark, sf, scored=False).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("z") != F.size("y")).alias("bad_length"), F.count_if(F.abs(D.total(F.col("y")) - 1) > 1e-5).alias("bad_sum"))


@query("agg_stats", f"{P} SELECT kind, round(avg(nll), 6) AS mean, round(min(nll), 6) AS low, round(max(nll), 6) AS high, round(median(nll), 6) AS median FROM pred GROUP BY kind")
def stats(spark, sf):
    return predictions(spark, sf).groupBy("kind").agg(r6(F.avg("nll")).alias("mean"), r6(F.min("nll")).alias("low"), r6(F.max("nll")).alias("high"), r6(F.percentile("nll", 0.5)).alias("median"))


@query("agg_sd", f"{P} SELECT family, round(stddev_pop(nll), 6) AS population, round(coalesce(stddev_samp(nll), 0), 6) AS sample FROM pred GROUP BY family")
def sd(spark, sf):
    return predictions(spark, sf).groupBy("family").agg(r6(F.stddev_pop("nll")).alias("population"), r6(F.coalesce(F.stddev_samp("nll"), F.lit(0.0))).alias("sample"))


@query("agg_none_rate", f"{P} SELECT kind, round(avg(p[k]), 6) AS none_mass, round(avg(CASE WHEN t = k - 1 THEN 1 ELSE 0 END), 6) AS none_rate, round(avg(nll) FILTER (WHERE t = k - 1), 6) AS nll_none, round(avg(nll) FILTER (WHERE t <> k - 1), 6) AS nll_other FROM pred GROUP BY kind")
def none_rate(spark, sf):
    none = F.element_at("y", -1) == 1
    return predictions(spark, sf).groupBy("kind").agg(r6(F.avg(F.element_at("p", -1))).alias("none_mass"), r6(F.avg(none.cast("int"))).alias("none_rate"), r6(F.avg(F.when(none, F.col("nll")))).alias("nll_none"), r6(F.avg(F.when(~none, F.col("nll")))).alias("nll_other"))


@query("agg_coverage_views", f"{P} SELECT 'answered' AS view, count(*) AS n, round(avg(nll), 6) AS nll FROM pred WHERE id % 7 <> 0 UNION ALL SELECT 'all', count(*), round(avg(CASE WHEN id % 7 = 0 THEN ln(k) ELSE nll END), 6) FROM pred")
def coverage_views(spark, sf):
    p = predictions(spark, sf)
    refused = F.col("id") % 7 == 0
    uniform = F.transform("p", lambda x: F.lit(1.0) / F.size("p"))
    everything = p.withColumn("q", F.when(refused, uniform).otherwise(F.col("p"))).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(D.nll(F.col("q"), F.col("y")))).alias("nll"))
    answered = p.where(~refused).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("nll")).alias("nll"))
    return answered.select(F.lit("answered").alias("view"), "n", "nll").unionByName(everything.select(F.lit("all").alias("view"), "n", "nll"))


A2, B2 = pred_sql("a"), pred_sql("b", first=20)


def runs(spark, sf):
    a, b = predictions(spark, sf), predictions(spark, sf, first=20)
    keep = ["id", "grp", "family", "k", "y", "p", "z", "correct", "nll", "confidence"]
    return a.select(*keep), b.select(*keep)


@query("join_paired_runs", f"WITH {A2}, {B2} SELECT a.family AS family, count(*) AS n, round(avg(b.correct - a.correct), 6) AS accuracy_delta, round(avg(b.nll - a.nll), 6) AS nll_delta FROM a JOIN b USING (id) GROUP BY a.family")
def paired_runs(spark, sf):
    a, b = runs(spark, sf)
    both = S.paired(a, b, ["id"], ["k", "y", "family"])
    return both.groupBy("a.family").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("b.correct") - F.col("a.correct"))).alias("accuracy_delta"), r6(F.avg(F.col("b.nll") - F.col("a.nll"))).alias("nll_delta"))


@query("join_strict_multi", "SELECT 'odd' AS run, count(*) FILTER (WHERE vec_id % 5 <> 0) AS common, count(*) FILTER (WHERE vec_id % 5 = 0) AS missing, 0::BIGINT AS extra FROM embeddings UNION ALL SELECT 'same', count(*), 0, 0 FROM embeddings")
def strict_multi(spark, sf):
    a, b = runs(spark, sf)
    return S.coverage(a.select("id"), {"odd": b.where("id % 5 <> 0").select("id"), "same": b.select("id")}, ["id"])


@query("join_lenient_twin", f"WITH {A2}, {B2} SELECT count(*) AS n, round(avg(a.correct), 6) AS a, round(avg(b.correct), 6) AS b FROM a JOIN b USING (id) WHERE b.id % 3 <> 0")
def lenient_twin(spark, sf):
    a, b = runs(spark, sf)
    j = a.select("id", F.col("correct").alias("ca")).join(b.where("id % 3 <> 0").select("id", F.col("correct").alias("cb")), "id")
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ca")).alias("a"), r6(F.avg("cb")).alias("b"))


@query("agg_broken_fixed", f"WITH {A2}, {B2} SELECT round(avg(CASE WHEN a.correct = 1 AND b.correct = 0 THEN 1 ELSE 0 END), 6) AS broken, round(avg(CASE WHEN a.correct = 0 AND b.correct = 1 THEN 1 ELSE 0 END), 6) AS fixed FROM a JOIN b USING (id)")
def broken_fixed(spark, sf):
    both = S.paired(*runs(spark, sf), ["id"], ["y"])
    ca, cb = F.col("a.correct") == 1, F.col("b.correct") == 1
    return both.agg(r6(F.avg((ca & ~cb).cast("int"))).alias("broken"), r6(F.avg((~ca & cb).cast("int"))).alias("fixed"))


@query("join_blind_reference", f"WITH {A2}, {B2}, d AS (SELECT list_max(list_transform(range(1, a.k + 1), lambda i: abs(a.z[i] - b.z[i]))) AS delta, CASE WHEN list_position(a.p, a.confidence) <> list_position(b.p, b.confidence) THEN 1 ELSE 0 END AS flip FROM a JOIN b USING (id)) SELECT round(max(delta), 6) AS max_delta, sum(flip)::BIGINT AS flips FROM d")
def blind_reference(spark, sf):
    both = S.paired(*runs(spark, sf), ["id"], ["k"])
    delta = F.array_max(F.zip_with("a.z", "b.z", lambda x, y: F.abs(x - y)))
    flip = (D.argmax(F.col("a.p")) != D.argmax(F.col("b.p"))).cast("long")
    return both.agg(r6(F.max(delta)).alias("max_delta"), F.sum(flip).alias("flips"))


@query("eq_two_paths", f"WITH {A2}, {B2} SELECT round(max(list_max(list_transform(range(1, a.k + 1), lambda i: abs(a.p[i] - b.p[i])))), 6) AS max_dp, count(*) FILTER (WHERE list_position(a.p, a.confidence) <> list_position(b.p, b.confidence)) AS flips FROM a JOIN b USING (id)")
def two_paths(spark, sf):
    both = S.paired(*runs(spark, sf), ["id"], ["k"])
    return both.agg(r6(F.max(F.array_max(F.zip_with("a.p", "b.p", lambda x, y: F.abs(x - y))))).alias("max_dp"), F.count_if(D.argmax(F.col("a.p")) != D.argmax(F.col("b.p"))).alias("flips"))


@query("order_control", f"{P}, r AS (SELECT id, p, k, list_transform(range(1, k + 1), lambda i: CASE WHEN id % 2 = 0 THEN p[i] ELSE (p[i] + p[(i % k) + 1]) / 2 END) AS q FROM pred) SELECT id, round(list_sum(list_transform(range(1, k + 1), lambda i: abs(p[i] - q[i]))) / 2, 6) AS tv, list_position(p, list_max(p)) <> list_position(q, list_max(q)) AS flip FROM r")
def order_control(spark, sf):
    s = predictions(spark, sf)
    nxt = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    q = F.when(F.col("id") % 2 == 0, F.col("p")).otherwise(F.zip_with("p", nxt, lambda a, b: (a + b) / 2))
    s = s.withColumn("q", q)
    return s.select("id", r6(D.total_variation(F.col("p"), F.col("q"))).alias("tv"), (D.argmax(F.col("p")) != D.argmax(F.col("q"))).alias("flip"))


@query("sym_kl", f"WITH {A2}, {B2}, j AS (SELECT a.k AS k, a.p AS p, b.p AS q FROM a JOIN b USING (id)) SELECT round(avg(list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN p[i] > 0 THEN p[i] * (ln(p[i]) - ln(greatest(q[i], 1e-12))) ELSE 0 END)) / 2 + list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN q[i] > 0 THEN q[i] * (ln(q[i]) - ln(greatest(p[i], 1e-12))) ELSE 0 END)) / 2), 5) AS kl FROM j")
def sym_kl(spark, sf):
    both = S.paired(*runs(spark, sf), ["id"], ["k"])
    return both.agg(F.round(F.avg(D.symmetric_kl(F.col("a.p"), F.col("b.p"))), 5).alias("kl"))


@query("reread_average", f"{P}, h AS (SELECT id, k, p, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(k) AS h FROM pred) SELECT id, list_transform(range(1, k + 1), lambda i: round(CASE WHEN h > 0.8 THEN (p[i] + p[k + 1 - i]) / 2 ELSE p[i] END, 6)) AS p FROM h")
def reread_average(spark, sf):
    s = predictions(spark, sf)
    twin = D.renormalise(F.zip_with("p", F.reverse("p"), lambda a, b: (a + b) / 2))
    out = F.when(D.normalised_entropy(F.col("p")) > 0.8, twin).otherwise(F.col("p"))
    return s.select("id", F.transform(out, lambda x: F.round(x, 6)).alias("p"))


@query("mix_distill", f"WITH {A2}, {B2} SELECT id, list_transform(range(1, a.k + 1), lambda i: round(CASE WHEN id % 5 = 0 THEN a.y[i] ELSE 0.7 * a.y[i] + 0.3 * b.p[i] END, 6)) AS y FROM a JOIN b USING (id)")
def mix_distill(spark, sf):
    both = S.paired(*runs(spark, sf), ["id"], ["k"])
    blend = F.zip_with("a.y", "b.p", lambda g, t: 0.7 * g + 0.3 * t)
    return both.select("id", F.transform(F.when(F.col("id") % 5 == 0, F.col("a.y")).otherwise(blend), lambda x: F.round(x, 6)).alias("y"))


@query("agg_gate", f"WITH {A2}, {B2} SELECT avg(b.nll) <= avg(a.uniform_nll) AND avg(b.correct - a.correct) >= -0.05 AS passed FROM a JOIN b USING (id)")
def gate(spark, sf):
    a, b = runs(spark, sf)
    both = S.paired(a, b, ["id"], ["k"])
    return both.agg(((F.avg("b.nll") <= F.avg(F.ln(F.col("a.k").cast("double")))) & (F.avg(F.col("b.correct") - F.col("a.correct")) >= -0.05)).alias("passed"))


@query("agg_bootstrap")
def agg_bootstrap(spark, sf):
    both = S.paired(*runs(spark, sf), ["id", "grp"], ["y"]).select("grp", (F.col("b.nll") - F.col("a.nll")).alias("delta"))
    return S.bootstrap(both, "grp", "delta")


@query("agg_bootstrap_estimate", f"WITH {A2}, {B2} SELECT round(avg(b.nll - a.nll), 6) AS estimate, count(DISTINCT a.grp) AS groups FROM a JOIN b USING (id)")
def bootstrap_estimate(spark, sf):
    both = S.paired(*runs(spark, sf), ["id", "grp"], ["y"]).select("grp", (F.col("b.nll") - F.col("a.nll")).alias("delta"))
    return S.bootstrap(both, "grp", "delta", draws=2).select(r6(F.col("estimate")).alias("estimate"), "groups")


@query("agg_accuracy_bootstrap")
def accuracy_bootstrap(spark, sf):
    return S.bootstrap(predictions(spark, sf), "grp", "correct")


@query("ci_flag")
def ci_flag(spark, sf):
    return accuracy_bootstrap(spark, sf).select("estimate", "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"))


@query("fit_temperature", f"{P}, {fit_sql('fit', 'pred')} SELECT round(temperature, 6) AS temperature, round(nll, 6) AS nll, round(nll_before, 6) AS nll_before FROM fit")
def fit_temperature(spark, sf):
    return S.fit_temperature(predictions(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("temperature", "nll", "nll_before")))


@query("fit_by_cardinality", f"{P}, {fit_sql('own', 'pred', ('k',))}, {fit_sql('every', 'pred')}, c AS (SELECT k, count(*) AS n FROM pred GROUP BY k) SELECT k, n, round(CASE WHEN n >= 20 THEN own.temperature ELSE every.temperature END, 6) AS temperature FROM c JOIN own USING (k), every")
def fit_by_cardinality(spark, sf):
    s = predictions(spark, sf)
    own = S.fit_temperature(s, by=["k"]).join(s.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    return own.crossJoin(F.broadcast(S.fit_temperature(s).select(F.col("temperature").alias("t")))).select("k", "n", F.round(F.when(F.col("n") >= 20, F.col("temperature")).otherwise(F.col("t")), 6).alias("temperature"))


@query("fit_by_family", f"{P}, b AS (SELECT *, (2 ** greatest(1, ceil(log2(k))))::INT AS bucket FROM pred), {fit_sql('cell', 'b', ('family', 'bucket'))}, {fit_sql('fam', 'b', ('family',))}, c AS (SELECT family, bucket, count(*) AS n FROM b GROUP BY ALL) SELECT family, bucket, n, round(CASE WHEN n >= 20 THEN cell.temperature ELSE fam.temperature END, 6) AS temperature FROM c JOIN cell USING (family, bucket) JOIN fam USING (family)")
def fit_by_family(spark, sf):
    s = predictions(spark, sf).withColumn("bucket", D.cardinality_bucket(F.col("k")))
    cells = S.fit_temperature(s, by=["family", "bucket"]).join(s.groupBy("family", "bucket").agg(F.count(F.lit(1)).alias("n")), ["family", "bucket"])
    fam = S.fit_temperature(s, by=["family"]).select("family", F.col("temperature").alias("t"))
    return cells.join(fam, "family").select("family", "bucket", "n", F.round(F.when(F.col("n") >= 20, F.col("temperature")).otherwise(F.col("t")), 6).alias("temperature"))


TEMPS = "fam(family, t) AS (VALUES ('f0', 1.5), ('f1', 0.8)), cell(family, bucket, t) AS (VALUES ('f0', 4, 2.0), ('f1', 8, 0.5)), kinds(kind, t) AS (VALUES ('score', 3.0))"


@query("lookup_temperature", f"WITH {TEMPS}, e AS (SELECT vec_id, 'f' || (label % 3) AS family, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind, (2 ** greatest(1, ceil(log2(2 + label))))::INT AS bucket FROM embeddings) SELECT vec_id, coalesce(c.t, f.t, k.t, 1.0)::DOUBLE AS temperature FROM e LEFT JOIN cell c ON e.family = c.family AND e.bucket = c.bucket LEFT JOIN fam f ON e.family = f.family LEFT JOIN kinds k ON e.kind = k.kind")
def lookup_temperature(spark, sf):
    fam = spark.createDataFrame([("f0", 1.5), ("f1", 0.8)], "family string, tf double")
    cell = spark.createDataFrame([("f0", 4, 2.0), ("f1", 8, 0.5)], "family string, bucket int, tc double")
    kinds = spark.createDataFrame([("score", 3.0)], "kind string, tk double")
    s = predictions(spark, sf, scored=False).select("id", "family", "kind", D.cardinality_bucket(F.col("k")).alias("bucket"))
    j = s.join(F.broadcast(cell), ["family", "bucket"], "left").join(F.broadcast(fam), "family", "left").join(F.broadcast(kinds), "kind", "left")
    return j.select(F.col("id").alias("vec_id"), F.coalesce("tc", "tf", "tk", F.lit(1.0)).alias("temperature"))


@query("posthoc_variants", f"{PU}, v AS (SELECT variant, temp, id, y, z FROM pred, (VALUES ('raw', 1.0), ('global', 2.5), ('sharp', 0.5)) x(variant, temp)), e AS (SELECT variant, y, list_transform(z, lambda q: exp((q - list_max(z)) / temp)) AS e FROM v) SELECT variant, round(avg(-ln(greatest(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * y[i])) / list_sum(e), 1e-12))), 6) AS nll FROM e GROUP BY variant")
def posthoc_variants(spark, sf):
    s = predictions(spark, sf, scored=False)
    variants = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(t).alias("t")) for n, t in (("raw", 1.0), ("global", 2.5), ("sharp", 0.5))))
    v = s.select("z", "y", F.inline(variants))
    return v.groupBy("variant").agg(r6(F.avg(D.nll(D.softmax(F.col("z"), F.col("t")), F.col("y")))).alias("nll"))


@query("renormalise_remote", f"{P}, q AS (SELECT id, list_transform(p, lambda x: x * (1 + (id % 5) * 0.006)) AS q FROM pred) SELECT id, round(list_sum(q), 6) AS original_sum, abs(list_sum(q) - 1) <= 0.01 AS accepted, CASE WHEN abs(list_sum(q) - 1) <= 0.01 THEN list_transform(q, lambda x: round(x / list_sum(q), 6)) END AS p FROM q")
def renormalise_remote(spark, sf):
    s = predictions(spark, sf).select("id", F.transform("p", lambda x: x * (1 + (F.col("id") % 5) * 0.006)).alias("q"))
    total = D.total(F.col("q"))
    fine = F.abs(total - 1) <= 0.01
    return s.select("id", r6(total).alias("original_sum"), fine.alias("accepted"), F.when(fine, F.transform(D.renormalise(F.col("q")), lambda x: F.round(x, 6))).alias("p"))


@query("rl_advantages", f"{P}, w AS (SELECT id, correct AS r, count(*) OVER g AS n, sum(correct) OVER g AS s, avg(correct) OVER g AS m, stddev_pop(correct) OVER g AS sd FROM pred WINDOW g AS (PARTITION BY grp)) SELECT id, round(CASE WHEN n > 1 THEN r - (s - r) / (n - 1) ELSE 0 END, 6) AS rloo, round((r - m) / (sd + 1e-8), 4) AS grpo FROM w")
def rl_advantages(spark, sf):
    w = Window.partitionBy("grp")
    r, n = F.col("correct"), F.count(F.lit(1)).over(w)
    rloo = F.when(n > 1, r - (F.sum("correct").over(w) - r) / (n - 1)).otherwise(0.0)
    grpo = (r - F.avg("correct").over(w)) / (F.stddev_pop("correct").over(w) + 1e-8)
    return predictions(spark, sf).select("id", r6(rloo).alias("rloo"), F.round(grpo, 4).alias("grpo"))


@query("report_moments", f"{P}, m AS (SELECT id, correct AS eta, list_sum(list_transform(range(0, k), lambda i: i / (k - 1) * p[i + 1])) AS mu, list_sum(list_transform(range(0, k), lambda i: (i / (k - 1)) ** 2 * p[i + 1])) AS m2 FROM pred) SELECT id, round(mu, 6) AS mu, round(m2 - mu * mu, 6) AS var, round((mu - eta) ** 2 + m2 - mu * mu + eta * (1 - eta), 6) AS brier FROM m")
def report_moments(spark, sf):
    s = predictions(spark, sf)
    grid = lambda i: i / (F.size("p") - 1)
    mu = D.total(F.transform("p", lambda x, i: x * grid(i)))
    m2 = D.total(F.transform("p", lambda x, i: x * grid(i) * grid(i)))
    s = s.withColumn("mu", mu).withColumn("v", m2 - mu * mu)
    return s.select("id", r6(F.col("mu")).alias("mu"), r6(F.col("v")).alias("var"), r6((F.col("mu") - F.col("correct")) * (F.col("mu") - F.col("correct")) + F.col("v") + F.col("correct") * (1 - F.col("correct"))).alias("brier"))


@query("pattern_composite", f"{P}, l AS (SELECT grp, id, k, list_sum(list_transform(range(0, k), lambda i: i * p[i + 1])) / (k - 1) AS s FROM pred) SELECT grp, round(sum((1 + id % 3) * s) / sum(1 + id % 3), 6) AS composite FROM l GROUP BY grp")
def pattern_composite(spark, sf):
    s = predictions(spark, sf).withColumn("s", D.expected_level(F.col("p")) / (F.size("p") - 1))
    w = 1 + F.col("id") % 3
    return s.groupBy("grp").agg(r6(F.sum(w * F.col("s")) / F.sum(w)).alias("composite"))


@query("pattern_gate", f"{P} SELECT id, CASE WHEN confidence >= 0.5 THEN (list_position(p, confidence) - 1)::INT ELSE -1 END AS answer FROM pred")
def pattern_gate(spark, sf):
    return predictions(spark, sf).select("id", F.when(F.col("confidence") >= 0.5, D.argmax(F.col("p"))).otherwise(-1).alias("answer"))


@query("pattern_intent", f"{P} SELECT id, CASE WHEN list_position(p, confidence) <> k THEN list_position(p, confidence) - 1 END::INT AS intent FROM pred")
def pattern_intent(spark, sf):
    at = D.argmax(F.col("p"))
    return predictions(spark, sf).select("id", F.when(at != F.col("k") - 1, at).alias("intent"))


@query("pattern_args", f"{P} SELECT grp, round(min(confidence), 6) AS confidence, string_agg((list_position(p, confidence) - 1)::VARCHAR, ',' ORDER BY id) AS args FROM pred GROUP BY grp")
def pattern_args(spark, sf):
    s = predictions(spark, sf).select("grp", "confidence", F.struct("id", D.argmax(F.col("p")).alias("a")).alias("x"))
    args = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["a"].cast("string")), ",")
    return s.groupBy("grp").agg(r6(F.min("confidence")).alias("confidence"), args.alias("args"))


@query("pattern_fanout", f"{P} SELECT grp, count(*) AS questions, round(max(confidence), 6) AS best, arg_min(id, (-confidence, id)) AS id FROM pred GROUP BY grp")
def pattern_fanout(spark, sf):
    s = predictions(spark, sf)
    return s.groupBy("grp").agg(F.count(F.lit(1)).alias("questions"), r6(F.max("confidence")).alias("best"), F.min(F.struct((-F.col("confidence")).alias("c"), "id"))["id"].alias("id"))


@query("select_checkpoint", f"{P}, s AS (SELECT grp AS step, avg(nll) FILTER (WHERE kind = 'choice') AS dev, avg(nll - uniform_nll) FILTER (WHERE kind <> 'choice') AS gap FROM pred GROUP BY grp) SELECT step, round(dev + 0.5 * greatest(0, gap), 6) AS score FROM s WHERE dev IS NOT NULL AND gap IS NOT NULL ORDER BY dev + 0.5 * greatest(0, gap), step LIMIT 1")
def select_checkpoint(spark, sf):
    s = predictions(spark, sf).groupBy(F.col("grp").alias("step")).agg(F.avg(F.when(F.col("kind") == "choice", F.col("nll"))).alias("dev"), F.avg(F.when(F.col("kind") != "choice", F.col("nll") - F.col("uniform_nll"))).alias("gap"))
    s = s.where("dev IS NOT NULL AND gap IS NOT NULL").withColumn("score", F.col("dev") + 0.5 * F.greatest(F.lit(0.0), F.col("gap")))
    best = s.agg(F.min(F.struct("score", "step")).alias("b"))
    return best.select("b.step", r6(F.col("b.score")).alias("score"))


@query("win_paired_seed_delta", f"{P}, s AS (SELECT grp % 5 AS seed, CASE WHEN id % 2 = 0 THEN 'arm' ELSE 'base' END AS arm, avg(correct) AS a FROM pred GROUP BY 1, 2) SELECT x.seed, round(x.a - y.a, 6) AS delta FROM s x JOIN s y ON x.seed = y.seed AND x.arm = 'arm' AND y.arm = 'base'")
def paired_seed_delta(spark, sf):
    p = predictions(spark, sf).withColumn("seed", F.col("grp") % 5).withColumn("arm", F.when(F.col("id") % 2 == 0, "arm").otherwise("base"))
    wide = p.groupBy("seed").pivot("arm", ["arm", "base"]).agg(F.avg("correct"))
    return wide.where("arm IS NOT NULL AND base IS NOT NULL").select("seed", r6(F.col("arm") - F.col("base")).alias("delta"))


@query("agg_tail_share", f"WITH {A2}, {B2}, d AS (SELECT a.confidence + b.confidence - 1 AS g FROM a JOIN b USING (id)) SELECT round(avg(CASE WHEN abs(g) > 0.1 THEN 1 ELSE 0 END), 6) AS tail, round(quantile_cont(g, 0.05), 6) AS q05, round(quantile_cont(g, 0.5), 6) AS q50, round(quantile_cont(g, 0.95), 6) AS q95 FROM d")
def tail_share(spark, sf):
    g = S.paired(*runs(spark, sf), ["id"], ["k"]).select((F.col("a.confidence") + F.col("b.confidence") - 1).alias("g"))
    q = F.percentile("g", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = g.agg(r6(F.avg((F.abs("g") > 0.1).cast("int"))).alias("tail"), q.alias("q"))
    return out.select("tail", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query("topk_shortlist", f"{P} SELECT grp, id, rank FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, id) AS rank FROM pred) WHERE rank <= 2")
def topk_shortlist(spark, sf):
    w = Window.partitionBy("grp").orderBy(F.desc("confidence"), "id")
    return predictions(spark, sf).select("grp", "id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 2")


@query("topk_retained_menu", f"{P}, o AS (SELECT id, u.i AS option, p[u.i + 1] AS x FROM pred, unnest(range(0, k)) AS u(i) WHERE k >= 5 AND p[u.i + 1] BETWEEN 0.0001 AND 0.9999), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, option) AS rank FROM o) SELECT id, option, rank, rank = 5 AS extra FROM r WHERE rank <= 5")
def topk_retained(spark, sf):
    ranked = F.array_sort(F.transform(F.filter(F.transform("p", lambda x, i: F.struct((-x).alias("s"), i.cast("long").alias("option"))), lambda o: (o["s"] <= -0.0001) & (o["s"] >= -0.9999)), lambda o: o))
    top = F.transform(F.slice(ranked, 1, 5), lambda o, i: F.struct(o["option"].alias("option"), (i + 1).cast("long").alias("rank"), (i == 4).alias("extra")))
    return predictions(spark, sf).where("k >= 5").select("id", F.inline(top))
