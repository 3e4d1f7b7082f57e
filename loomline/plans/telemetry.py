"""Latency, cost and load telemetry, probe statistics, report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import dists as D
from loomline.operators import scoring as S
from loomline.operators.ranks import order_statistics
from loomline.plans.facts import pred_sql, predictions
from loomline.plans.registry import query, table

P = "WITH " + pred_sql()
r6 = S.rounded


@query("agg_percentile_linear", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_linear(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.95)).alias("p95"))


RANK = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "


def _ranked(spark, sf, rank):
    return order_statistics(table(spark, sf, "events").select("event_type", "value"), "event_type", "value", {"p95": rank}).select("event_type", r6(F.col("p95")).alias("p95"))


@query("agg_percentile_trunc", RANK + "SELECT event_type, round(max(value), 6) AS p95 FROM r WHERE k = least(n - 1, floor(0.95 * n)) GROUP BY event_type")
def percentile_trunc(spark, sf):
    return _ranked(spark, sf, F.least(F.col("n") - 1, F.floor(0.95 * F.col("n"))))


@query("agg_percentile_ceil", RANK + "SELECT event_type, round(max(value), 6) AS p95 FROM r WHERE k = ceil(95 * n / 100.0) - 1 GROUP BY event_type")
def percentile_ceil(spark, sf):
    return _ranked(spark, sf, F.ceil(95 * F.col("n") / 100) - 1)


@query("agg_percentile_nm1", RANK + "SELECT event_type, round(max(value), 6) AS p95 FROM r WHERE k = floor(0.95 * (n - 1)) GROUP BY event_type")
def percentile_nm1(spark, sf):
    return _ranked(spark, sf, F.floor(0.95 * (F.col("n") - 1)))


@query("agg_cost", "SELECT event_type, count(*) AS n, round(sum(value) * 3 / 1e6, 9) AS dollars, round(count(*) / date_diff('second', min(ts), max(ts)), 9) AS qps FROM events GROUP BY event_type")
def cost(spark, sf):
    e = table(spark, sf, "events")
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") * 3 / 1e6, 9).alias("dollars"), F.round(F.try_divide(F.count(F.lit(1)), seconds), 9).alias("qps"))


PRICES = [("purchase", 3.0), ("click", 0.5)]


@query("price_lookup", "WITH p(event_type, price) AS (VALUES ('purchase', 3.0), ('click', 0.5)) SELECT event_id, coalesce(price, 1.0)::DOUBLE AS price FROM events LEFT JOIN p USING (event_type)")
def price_lookup(spark, sf):
    prices = spark.createDataFrame(PRICES, "event_type string, price double")
    return table(spark, sf, "events").join(F.broadcast(prices), "event_type", "left").select("event_id", F.coalesce("price", F.lit(1.0)).alias("price"))


@query("lat_per_request", "WITH l AS (SELECT user_id, arg_max(value, event_id) AS ms FROM events GROUP BY user_id) SELECT count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50 FROM l")
def lat_per_request(spark, sf):
    l = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("ms"))
    return l.agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("ms", 0.5)).alias("p50"))


@query("lat_steady_state", "SELECT event_type, round(coalesce(median(value) FILTER (WHERE event_id % 5 <> 0), median(value)), 6) AS steady, round(median(value), 6) AS everything FROM events GROUP BY event_type")
def lat_steady(spark, sf):
    steady = F.percentile(F.when(F.col("event_id") % 5 != 0, F.col("value")), 0.5)
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.coalesce(steady, F.percentile("value", 0.5))).alias("steady"), r6(F.percentile("value", 0.5)).alias("everything"))


@query("lat_by_cell", "SELECT event_type, user_id % 4 AS depth, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS peak, count(*) FILTER (WHERE value < 1) AS skipped FROM events GROUP BY 1, 2")
def lat_by_cell(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("depth"))
    return e.agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.95)).alias("p95"), r6(F.max("value")).alias("peak"), F.count_if(F.col("value") < 1).alias("skipped"))


@query("lat_kernel_class", "WITH k AS (SELECT CASE WHEN contains(p_type, 'BRASS') THEN 'matmul' WHEN contains(p_type, 'STEEL') THEN 'attention' WHEN contains(p_type, 'COPPER') THEN 'norm' ELSE 'other' END AS class, p_retailprice::DOUBLE AS t FROM part) SELECT class, round(sum(t) / (SELECT sum(t) FROM k), 6) AS share FROM k GROUP BY class")
def kernel_class(spark, sf):
    t = F.col("p_type")
    c = F.when(t.contains("BRASS"), "matmul").when(t.contains("STEEL"), "attention").when(t.contains("COPPER"), "norm").otherwise("other")
    k = table(spark, sf, "part").groupBy(c.alias("class")).agg(F.sum(F.col("p_retailprice").cast("double")).alias("t"))
    return k.select("class", r6(F.col("t") / F.sum("t").over(Window.partitionBy())).alias("share"))  # four classes


@query("eval_parsed_text", "WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'token = ') THEN 'tag' WHEN contains(text, '|') THEN 'bar' WHEN contains(text, '@') THEN 'last' ELSE 'none' END AS method, n_chars FROM documents) SELECT method, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM a GROUP BY method")
def parsed_text(spark, sf):
    t = F.col("text")
    m = F.when(t.contains("token = "), "tag").when(t.contains("|"), "bar").when(t.contains("@"), "last").otherwise("none")
    return table(spark, sf, "documents").groupBy(m.alias("method")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars"))


@query("eval_refusals", f"{P} SELECT kind, count(*) FILTER (WHERE id % 11 = 0) AS refused, count(*) FILTER (WHERE id % 11 <> 0 AND id % 13 = 0) AS invalid, count(*) FILTER (WHERE id % 11 <> 0 AND id % 13 <> 0) AS answered FROM pred GROUP BY kind")
def eval_refusals(spark, sf):
    p = F.when(F.col("id") % 13 == 0, F.transform("p", lambda x: x * 2)).otherwise(F.col("p"))
    s = predictions(spark, sf).withColumn("q", F.when(F.col("id") % 11 != 0, p))
    outcome = F.when(F.col("q").isNull(), "refused").when(~D.valid_distribution(F.col("q"), tolerance=1e-3), "invalid").otherwise("answered")
    return s.groupBy("kind").agg(*(F.count_if(outcome == o).alias(o) for o in ("refused", "invalid", "answered")))


@query("remote_summary", "SELECT split_part(event_type, '_', 1) AS domain, count(*) AS attempted, count(*) FILTER (WHERE value >= 10) AS succeeded, count(*) FILTER (WHERE value < 10) AS failed, sum(floor(value))::BIGINT AS usage FROM events GROUP BY 1")
def remote_summary(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy(F.split_part("event_type", F.lit("_"), F.lit(1)).alias("domain")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(v >= 10).alias("succeeded"), F.count_if(v < 10).alias("failed"), F.sum(F.floor(v)).alias("usage"))


@query("prefix_counts", "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, unnest(list_sort(list_distinct(list_transform([1, 2, 4, 8, n], lambda x: least(x, n))))) AS prefix FROM c")
def prefix_counts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", F.explode(F.array_distinct(F.array(*(F.least(F.lit(x).cast("long"), F.col("n")) for x in (1, 2, 4, 8)), "n"))).alias("prefix"))


A = pred_sql("a")


@query("probe_isolation", f"WITH {A}, v AS (SELECT id, family, k, p, list_transform(range(1, k + 1), lambda i: (p[i] + p[(i % k) + 1]) / 2) AS q FROM a) SELECT family, round(avg(list_sum(list_transform(range(1, k + 1), lambda i: abs(p[i] - q[i]))) / 2), 6) AS tv, round(max(list_max(list_transform(range(1, k + 1), lambda i: abs(p[i] - q[i])))), 6) AS max_delta, count(*) FILTER (WHERE list_position(p, list_max(p)) <> list_position(q, list_max(q))) AS flips FROM v GROUP BY family")
def probe_isolation(spark, sf):
    s = _twin(spark, sf)
    delta = F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b)))
    return s.groupBy("family").agg(r6(F.avg(D.total_variation(F.col("p"), F.col("q")))).alias("tv"), r6(F.max(delta)).alias("max_delta"), F.count_if(D.argmax(F.col("p")) != D.argmax(F.col("q"))).alias("flips"))


def _twin(spark, sf):
    nxt = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    return predictions(spark, sf).withColumn("q", F.zip_with("p", nxt, lambda a, b: (a + b) / 2))


@query("probe_repeat_null", f"{P}, r AS (SELECT id, grp, id % 2 AS block, confidence FROM pred), j AS (SELECT abs(x.confidence - y.confidence) AS d, x.block = y.block AS same FROM r x JOIN r y ON x.grp = y.grp AND x.id < y.id) SELECT same, count(*) AS n, round(avg(d), 6) AS mean, round(avg(CASE WHEN d < 0.05 THEN 1 ELSE 0 END), 6) AS small FROM j GROUP BY same")
def probe_repeat(spark, sf):
    """Repeats of a case (at most four to a group) compared inside the group's array."""
    g = predictions(spark, sf).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("id", "confidence"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y["id"] > x["id"]), lambda y: F.struct(F.abs(x["confidence"] - y["confidence"]).alias("d"), (x["id"] % 2 == y["id"] % 2).alias("same")))))
    return g.select(F.inline(pairs)).groupBy("same").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("d")).alias("mean"), r6(F.avg((F.col("d") < 0.05).cast("int"))).alias("small"))


@query("probe_complement", f"{P} SELECT family, round(avg(p[1] + p[2] - 1), 6) AS gap, round(stddev_pop(p[1] + p[2] - 1), 6) AS noise FROM pred GROUP BY family")
def probe_complement(spark, sf):
    s = predictions(spark, sf)
    variants = s.select("id", "family", F.inline(F.array(F.struct(F.lit("x").alias("variant"), F.col("p")[0].alias("v")), F.struct(F.lit("not_x").alias("variant"), F.col("p")[1].alias("v")))))
    wide = variants.groupBy("id", "family").pivot("variant", ["x", "not_x"]).agg(F.first("v"))
    g = F.col("x") + F.col("not_x") - 1
    return wide.groupBy("family").agg(r6(F.avg(g)).alias("gap"), r6(F.stddev_pop(g)).alias("noise"))


@query("probe_floor", f"{P}, o AS (SELECT kind, unnest(p) AS x FROM pred) SELECT kind, round(min(x) FILTER (WHERE x > 0) * 1e6, 3) AS smallest_e6, round(avg(CASE WHEN x = 0 THEN 1 ELSE 0 END), 6) AS zero_share FROM o GROUP BY kind")
def probe_floor(spark, sf):
    o = predictions(spark, sf).select("kind", F.explode("p").alias("x"))
    return o.groupBy("kind").agg(F.round(F.min(F.when(F.col("x") > 0, F.col("x"))) * 1e6, 3).alias("smallest_e6"), r6(F.avg((F.col("x") == 0).cast("int"))).alias("zero_share"))


@query("probe_controls", f"{P} SELECT id % 5 AS placement, round(avg(p[2]), 6) AS mean, round(min(p[2]), 6) AS low, round(max(p[2]), 6) AS high FROM pred GROUP BY 1")
def probe_controls(spark, sf):
    return predictions(spark, sf).groupBy((F.col("id") % 5).alias("placement")).agg(r6(F.avg(F.col("p")[1])).alias("mean"), r6(F.min(F.col("p")[1])).alias("low"), r6(F.max(F.col("p")[1])).alias("high"))


@query("probe_reference", f"{P} SELECT kind, round(avg(correct), 6) AS accuracy, round(avg(p[t + 1]), 6) AS target_mass, round(avg(p[1]), 6) AS reference_mass FROM pred GROUP BY kind")
def probe_reference(spark, sf):
    return predictions(spark, sf).groupBy("kind").agg(r6(F.avg("correct")).alias("accuracy"), r6(F.avg(D.dot(F.col("p"), F.col("y")))).alias("target_mass"), r6(F.avg(F.col("p")[0])).alias("reference_mass"))


@query("probe_amortise", "SELECT round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS ms_per_unit, round(regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 2) AS fixed, count(*) AS n FROM lineitem")
def probe_amortise(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x"))
    return l.agg(F.round(F.regr_slope("y", "x"), 4).alias("ms_per_unit"), F.round(F.regr_intercept("y", "x"), 2).alias("fixed"), F.count(F.lit(1)).alias("n"))


@query("agg_regression", "WITH s AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS sxx, var_pop(z) AS szz, covar_pop(x, z) AS sxz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy FROM (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem)) SELECT round((sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz), 3) AS a, round((szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz), 3) AS b FROM s")
def regression(spark, sf):
    """Two-variable least squares by normal equations: one pre-aggregated pass."""
    l = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("z"), F.col("l_extendedprice").cast("double").alias("y"))
    s = l.agg(F.var_pop("x").alias("sxx"), F.var_pop("z").alias("szz"), F.covar_pop("x", "z").alias("sxz"), F.covar_pop("x", "y").alias("sxy"), F.covar_pop("z", "y").alias("szy"))
    det = F.col("sxx") * F.col("szz") - F.col("sxz") * F.col("sxz")
    return s.select(F.round((F.col("sxy") * F.col("szz") - F.col("szy") * F.col("sxz")) / det, 3).alias("a"), F.round((F.col("szy") * F.col("sxx") - F.col("sxy") * F.col("sxz")) / det, 3).alias("b"))


@query("probe_option_cost", f"{P}, m AS (SELECT k, median(nll) AS ms FROM pred GROUP BY k) SELECT round(regr_slope(ms, k), 6) AS slope FROM m")
def option_cost(spark, sf):
    m = predictions(spark, sf).groupBy("k").agg(F.percentile("nll", 0.5).alias("ms"))
    return m.agg(r6(F.regr_slope("ms", "k")).alias("slope"))


@query("probe_rendering", f"{P}, w AS (SELECT grp, avg(nll) FILTER (WHERE id % 2 = 0) AS j, avg(nll) FILTER (WHERE id % 2 = 1) AS q FROM pred GROUP BY grp) SELECT count(*) AS n, count(*) FILTER (WHERE j < q) AS json_wins, round(avg(j - q), 6) AS delta FROM w WHERE j IS NOT NULL AND q IS NOT NULL")
def rendering(spark, sf):
    style = F.when(F.col("id") % 2 == 0, "json").otherwise("prose")
    w = predictions(spark, sf).withColumn("style", style).groupBy("grp").pivot("style", ["json", "prose"]).agg(F.avg("nll")).where("json IS NOT NULL AND prose IS NOT NULL")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("json") < F.col("prose")).alias("json_wins"), r6(F.avg(F.col("json") - F.col("prose"))).alias("delta"))


@query("agg_interaction", f"WITH {A}, v AS (SELECT id, k, list_transform(range(1, k + 1), lambda i: ln(greatest(p[i], 1e-12))) AS x FROM a), c AS (SELECT id, k, list_transform(x, lambda w: w - list_avg(x)) AS c FROM v WHERE k >= 3) SELECT count(*) AS n, round(avg(sqrt(list_avg(list_transform(c, lambda w: w * w)))), 6) AS rms FROM c")
def interaction(spark, sf):
    """Centred log-ratios and their root mean square, for decisions with at least three options."""
    x = F.transform("p", lambda v: F.ln(F.greatest(v, F.lit(1e-12))))
    s = predictions(spark, sf).where("k >= 3").withColumn("x", x).withColumn("m", D.total(F.col("x")) / F.size("x"))
    rms = F.sqrt(D.total(F.transform("x", lambda w: (w - F.col("m")) * (w - F.col("m")))) / F.size("x"))
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(rms)).alias("rms"))


@query("probe_plan", "WITH c AS (SELECT conv_id, turn FROM conversations WHERE turn = 0 ORDER BY sha256('4:' || conv_id), conv_id LIMIT 20), p AS (SELECT b.block AS block, conv_id, v.variant AS variant FROM c, (VALUES (0), (1), (2)) b(block), (VALUES ('alone'), ('rotate'), ('reverse'), ('add')) v(variant)) SELECT block, conv_id, variant, row_number() OVER (PARTITION BY block ORDER BY sha256(block || ':' || conv_id || ':' || variant)) AS place FROM p")
def probe_plan(spark, sf):
    from loomline.operators.corpus import hash_sample

    c = hash_sample(table(spark, sf, "conversations").where("turn = 0").select("conv_id"), "conv_id", 20, 4)
    p = c.select("conv_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block")).select("block", "conv_id", F.explode(F.array(*map(F.lit, ("alone", "rotate", "reverse", "add")))).alias("variant"))
    w = Window.partitionBy("block").orderBy(F.sha2(F.concat_ws(":", F.col("block").cast("string"), F.col("conv_id").cast("string"), "variant"), 256))
    return p.withColumn("place", F.row_number().over(w).cast("long"))


@query("cheapest_confusion", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part), t AS (SELECT p_brand, min(p_partkey) FILTER (WHERE k = 1) AS cheapest, min(p_partkey) AS answer FROM r GROUP BY p_brand) SELECT round(avg(CASE WHEN answer = cheapest THEN 1 ELSE 0 END), 6) AS share FROM t")
def confusion(spark, sf):
    t = table(spark, sf, "part").groupBy("p_brand").agg(F.min(F.struct("p_retailprice", "p_partkey"))["p_partkey"].alias("cheapest"), F.min("p_partkey").alias("answer"))
    return t.agg(r6(F.avg((F.col("answer") == F.col("cheapest")).cast("int"))).alias("share"))


@query("locale_table", f"{P} SELECT kind, family AS locale, count(*) AS n, round(avg(correct), 6) AS accuracy, CASE WHEN count(nll) = count(*) THEN round(avg(nll), 6) END AS nll FROM pred GROUP BY CUBE (kind, family)")
def locale_table(spark, sf):
    c = predictions(spark, sf).cube("kind", F.col("family").alias("locale"))
    return c.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("accuracy"), F.when(F.count("nll") == F.count(F.lit(1)), r6(F.avg("nll"))).alias("nll"))


@query("rep_phase", f"{P} SELECT family, round(avg(correct) FILTER (WHERE kind = 'choice'), 6) AS choice, round(avg(correct) FILTER (WHERE kind = 'score'), 6) AS score, round(avg(correct) FILTER (WHERE kind = 'noul'), 6) AS noul FROM pred GROUP BY family")
def rep_phase(spark, sf):
    wide = predictions(spark, sf).groupBy("family").pivot("kind", ["choice", "score", "noul"]).agg(F.avg("correct"))
    return wide.select("family", *(r6(F.col(k)).alias(k) for k in ("choice", "score", "noul")))


@query("rep_partition", f"{P} SELECT id % 3 = 0 AS seen, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll FROM pred GROUP BY 1")
def rep_partition(spark, sf):
    part = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3 == 0).alias("seen"))
    return predictions(spark, sf).join(part, "id").groupBy("seen").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("accuracy"), r6(F.avg("nll")).alias("nll"))


B2 = pred_sql("b", first=20)


@query("family_pair", f"WITH {A}, {B2} SELECT count(*) AS n, round(avg(b.correct - a.correct), 6) AS delta FROM a JOIN b USING (id) WHERE a.family = 'f1'")
def family_pair(spark, sf):
    a, b = (predictions(spark, sf, first=f).where("family = 'f1'").select("id", "y", "correct") for f in (1, 20))
    return S.paired(a, b, ["id"], ["y"]).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("b.correct") - F.col("a.correct"))).alias("delta"))


@query("eval_workflows", f"{P} SELECT kind AS workflow, count(*) AS n, round(avg(1 - abs(list_position(p, confidence) - 1 - t) / (k - 1)), 6) AS reward, round(avg(brier), 6) AS brier FROM pred GROUP BY ROLLUP (kind)")
def eval_workflows(spark, sf):
    s = predictions(spark, sf)
    reward = 1 - F.abs(D.argmax(F.col("p")) - D.argmax(F.col("y"))) / (F.col("k") - 1)
    return s.withColumn("reward", reward).rollup(F.col("kind").alias("workflow")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("reward")).alias("reward"), r6(F.avg("brier")).alias("brier"))


@query("eval_episodes", "WITH e AS (SELECT user_id, count(*) AS steps, max((event_type = 'purchase')::INT) AS success, sum(value) AS ret FROM events GROUP BY user_id) SELECT count(*) AS n, round(avg(success), 6) AS success, round(avg(steps), 6) AS steps, round(avg(ret), 4) AS mean_return FROM e")
def eval_episodes(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.max((F.col("event_type") == "purchase").cast("int")).alias("success"), F.sum("value").alias("ret"))
    return e.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("success")).alias("success"), r6(F.avg("steps")).alias("steps"), F.round(F.avg("ret"), 4).alias("mean_return"))


@query("choose_cascade", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'target' WHEN p_brand = 'Brand#11' THEN 'exact' WHEN lower(p_brand) = 'brand#12' THEN 'folded' WHEN p_retailprice > 1500 THEN 'score' ELSE 'first' END AS how FROM part")
def cascade(spark, sf):
    rules = [(F.col("p_size") == 1, "target"), (F.col("p_brand") == "Brand#11", "exact"), (F.lower("p_brand") == "brand#12", "folded"), (F.col("p_retailprice") > 1500, "score")]
    return table(spark, sf, "part").select("p_partkey", F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules), F.lit("first")).alias("how"))


@query("study_grid", "WITH g AS (SELECT rate, est, seed FROM (VALUES (0.1), (0.3)) r(rate), (VALUES ('a'), ('b')) e(est), range(5) s(seed)), v AS (SELECT rate, est, rate * (seed + 1) AS x FROM g) SELECT rate::DOUBLE AS rate, est, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM v GROUP BY 1, 2")
def study_grid(spark, sf):
    g = spark.range(5).select("id", F.explode(F.array(F.lit(0.1), F.lit(0.3))).alias("rate")).select("id", "rate", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("est"))
    x = F.col("rate") * (F.col("id") + 1)
    return g.groupBy("rate", "est").agg(r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("sd"))


@query("st_loadtest", "SELECT CASE WHEN value < 20 THEN 529 ELSE 200 END AS status, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def loadtest(spark, sf):
    s = F.when(F.col("value") < 20, 529).otherwise(200)
    return table(spark, sf, "events").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.99)).alias("p99"))


@query("explore_targets", "WITH v AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 50 = 0), u AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM v)) SELECT n_nationkey FROM u ORDER BY n_regionkey, n_nationkey LIMIT 8")
def explore_targets(spark, sf):
    v = table(spark, sf, "customer").where("c_custkey % 50 = 0").select("c_nationkey").distinct()
    n = table(spark, sf, "nation")
    return n.join(v, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").orderBy("n_regionkey", "n_nationkey").limit(8).select("n_nationkey")


@query("greedy_set_cover")
def set_cover(spark, sf):
    """Event types picked greedily until 99.8 % of users are covered: few candidate keys, one small aggregation each."""
    sets = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("need")).groupBy("need").agg(F.count(F.lit(1)).alias("n")).collect()  # distinct key sets, not users
    total, chosen, rows = sum(r["n"] for r in sets), set(), []
    keys = sorted({k for r in sets for k in r["need"]})
    while keys and sum(r["n"] for r in sets if set(r["need"]) <= chosen) < 0.998 * total:
        best = max(keys, key=lambda k: (sum(r["n"] for r in sets if set(r["need"]) <= chosen | {k}), sum(r["n"] for r in sets if k in r["need"])))
        keys.remove(best)
        chosen.add(best)
        rows.append((len(rows), best, sum(r["n"] for r in sets if set(r["need"]) <= chosen)))
    return spark.createDataFrame(rows, "step int, key string, covered long")
