"""Gold programs on the star schema: ranks, trade-offs, policy years, lookups, posteriors, probabilities, dates, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import relational as R
from loomline.plans.registry import query, table


@query("win_rank_kth", "WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, round(p_retailprice, 2)::DOUBLE AS price FROM r WHERE k = 2")
def rank_kth(spark, sf):
    return R.kth(table(spark, sf, "part"), "p_brand", ["p_retailprice", "p_partkey"], 2).select("p_brand", "p_partkey", F.round(F.col("p_retailprice").cast("double"), 2).alias("price"))


@query("win_rank_median", "WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_size AS median, n FROM r WHERE k = n // 2")
def rank_median(spark, sf):
    from loomline.operators.ranks import order_statistics

    return order_statistics(table(spark, sf, "part"), "p_brand", "p_size", {"median": F.floor(F.col("n") / 2)}).select("p_brand", "median", "n")


@query("win_rank_count", "WITH m AS (SELECT p_brand, avg(p_retailprice::DOUBLE) AS a FROM part GROUP BY p_brand) SELECT part.p_brand, count(*) AS better FROM part JOIN m ON part.p_brand = m.p_brand AND p_retailprice::DOUBLE > a GROUP BY part.p_brand")
def rank_count(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_retailprice").cast("double").alias("x"))
    m = p.groupBy("p_brand").agg(F.avg("x").alias("a"))
    return p.join(m, "p_brand").where("x > a").groupBy("p_brand").agg(F.count(F.lit(1)).alias("better"))


@query("win_nearest", "WITH ref AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand), v AS (SELECT ref.p_brand, ref.k, p_retailprice::DOUBLE AS v FROM ref JOIN part ON p_partkey = k), d AS (SELECT part.p_brand, p_partkey, abs(p_retailprice::DOUBLE - v) AS d FROM part JOIN v ON part.p_brand = v.p_brand AND p_partkey <> k), m AS (SELECT p_brand, min(d) AS m FROM d GROUP BY p_brand) SELECT d.p_brand, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM d JOIN m ON d.p_brand = m.p_brand AND d.d = m.m GROUP BY d.p_brand")
def nearest(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    first = p.groupBy("p_brand").agg(F.min(F.struct("p_partkey", "price")).alias("m")).select("p_brand", F.col("m.p_partkey").alias("p_partkey"), F.col("m.price").alias("price"))
    return R.nearest(p, "p_brand", "price", "p_partkey", first, "price")


@query("join_best_match", "WITH s AS (SELECT s_suppkey, s_acctbal::DOUBLE AS b, s_nationkey FROM supplier), c AS (SELECT c_custkey, c_acctbal::DOUBLE AS b, c_nationkey FROM customer), r AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY (c.b - s.b) ** 2, s_suppkey) AS k FROM c JOIN s ON c_nationkey = s_nationkey) SELECT c_custkey, s_suppkey FROM r WHERE k = 1")
def best_match(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("b"), F.col("s_nationkey").alias("n"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b"), F.col("c_nationkey").alias("n"))
    return R.closest(c, s, "n", "b", "s_suppkey").groupBy("c_custkey").agg(F.min("closest")["k"].alias("s_suppkey"))


@query("win_filtered_min", "WITH ref AS (SELECT p_brand, avg(p_size) AS a FROM part GROUP BY p_brand), r AS (SELECT part.p_brand, p_partkey, row_number() OVER (PARTITION BY part.p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part JOIN ref ON part.p_brand = ref.p_brand AND p_size > a) SELECT p_brand, p_partkey FROM r WHERE k = 1")
def filtered_min(spark, sf):
    p = table(spark, sf, "part")
    ref = p.groupBy("p_brand").agg(F.avg("p_size").alias("a"))
    return p.join(ref, "p_brand").where("p_size > a").groupBy("p_brand").agg(F.min(F.struct("p_retailprice", "p_partkey"))["p_partkey"].alias("p_partkey"))


@query("win_lexicographic", "WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 1000), r AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS k FROM e GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus) AS x FROM r) SELECT o_custkey, CASE WHEN n = 1 THEN k END AS o_orderkey FROM q WHERE x = 1")
def lexicographic(spark, sf):
    return R.lexicographic(table(spark, sf, "orders"), "o_custkey", F.col("o_totalprice") > 1000, [F.col("o_orderpriority"), F.col("o_orderstatus")], "o_orderkey")


@query("win_policy_year", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS x, o_orderdate::DATE AS d FROM orders), s AS (SELECT *, sum(x) OVER (PARTITION BY o_custkey, year(d) ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o) SELECT o_orderkey, round(coalesce(before, 0), 2) AS before, coalesce(before, 0) + x > 300000 AS over_strict, coalesce(before, 0) + x >= 300000 AS over_inclusive FROM s")
def policy_year(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("x"), F.to_date("o_orderdate").alias("d"))
    w = Window.partitionBy("o_custkey", F.year("d")).orderBy("d", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    b = F.coalesce(F.sum("x").over(w), F.lit(0.0))
    o = o.withColumn("b", b)
    return o.select("o_orderkey", F.round("b", 2).alias("before"), (F.col("b") + F.col("x") > 300000).alias("over_strict"), (F.col("b") + F.col("x") >= 300000).alias("over_inclusive"))


@query("join_lookup_chain", "SELECT l_orderkey, l_linenumber, CASE WHEN c_custkey IS NULL THEN 'no_customer' WHEN r_name IS NULL THEN 'no_region' WHEN l_quantity > 40 THEN 'escalate' WHEN r_name IN ('ASIA', 'EUROPE') THEN 'approve' ELSE 'review' END AS decision FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 10 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3 LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_chain(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_nationkey")
    places = table(spark, sf, "nation").where("n_nationkey <> 3").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    decision = F.when(F.col("c_custkey").isNull(), "no_customer").when(F.col("r_name").isNull(), "no_region").when(F.col("l_quantity") > 40, "escalate").when(F.col("r_name").isin("ASIA", "EUROPE"), "approve").otherwise("review")
    return j.select("l_orderkey", "l_linenumber", decision.alias("decision"))


@query("join_pointer_walk", "WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_partkey // 2 END AS t FROM part), w(k, final, hops) AS (SELECT k, k, 0 FROM p UNION ALL SELECT w.k, p.t, hops + 1 FROM w JOIN p ON w.final = p.k AND p.t IS NOT NULL WHERE hops < 5) SELECT k AS p_partkey, arg_max(final, hops) AS final, max(hops)::INT AS hops FROM w GROUP BY k")
def pointer_walk(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.floor(F.col("p_partkey") / 2)).alias("t"))
    return R.walk(p, "p_partkey", "t", 5)


RATES = [("1992-01-01", 0.01), ("1994-06-15", 0.02), ("1996-03-01", 0.035), ("1997-11-20", 0.015)]
RATES_SQL = "rates(effective, rate) AS (VALUES " + ", ".join(f"(DATE '{d}', {r})" for d, r in RATES) + ")"


@query("join_effective_date", f"WITH {RATES_SQL} SELECT o_orderkey, (SELECT arg_max(rate, effective) FROM rates WHERE effective <= o_orderdate::DATE)::DOUBLE AS rate FROM orders")
def effective_date(spark, sf):
    rates = spark.createDataFrame(RATES, "effective string, rate double").select(F.to_date("effective").alias("effective"), "rate")
    return R.as_of(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")), F.col("d"), rates, "effective", ["rate"]).select("o_orderkey", "rate")


@query("win_accrual", f"WITH {RATES_SQL}, s AS (SELECT effective, rate, lead(effective, 1, DATE '1999-01-01') OVER (ORDER BY effective) AS until FROM rates), o AS (SELECT o_orderkey, o_totalprice::DOUBLE AS x, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, round(sum(x * rate * greatest(0, date_diff('day', greatest(d, effective), until)) / 365), 2) AS interest FROM o, s GROUP BY o_orderkey")
def accrual(spark, sf):
    rates = spark.createDataFrame(RATES, "effective string, rate double").select(F.to_date("effective").alias("effective"), "rate")
    until = F.lead("effective", 1).over(Window.orderBy("effective"))  # a handful of rate changes
    spans = rates.withColumn("until", F.coalesce(until, F.to_date(F.lit("1999-01-01")))).agg(F.collect_list(F.struct("effective", "until", "rate")).alias("spans"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"), F.to_date("o_orderdate").alias("d")).crossJoin(F.broadcast(spans))  # one row
    days = lambda s: F.greatest(F.lit(0), F.date_diff(s["until"], F.greatest(F.col("d"), s["effective"])))
    return o.select("o_orderkey", F.round(F.aggregate("spans", F.lit(0.0), lambda a, s: a + F.col("x") * s["rate"] * days(s) / 365), 2).alias("interest"))


@query("win_running_balance", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, abs(coalesce(value, 0)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    h AS (SELECT e.event_id, coalesce(sum(o.v), 0) AS held FROM e LEFT JOIN e o ON o.user_id = e.user_id AND o.k < e.k AND o.event_type = 'error' AND o.ts > e.ts - INTERVAL 3 DAY GROUP BY e.event_id),
    x AS (SELECT e.*, h.held FROM e JOIN h USING (event_id)),
    f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, true AS accepted, 0.0::DOUBLE AS posted FROM x GROUP BY user_id UNION ALL
      SELECT x.user_id, x.k, x.event_id, x.event_type <> 'purchase' OR x.v <= 500 - f.posted - x.held,
        f.posted + CASE WHEN x.event_type = 'signup' THEN -x.v WHEN x.event_type = 'purchase' AND x.v <= 500 - f.posted - x.held THEN x.v ELSE 0 END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
    SELECT event_id, user_id, accepted, round(posted, 6) AS posted FROM f WHERE k > 0""")
def running_balance(spark, sf):
    def step(state, row):
        posted, holds = state
        holds = [(t, v) for t, v in holds if (row["ts"] - t).total_seconds() < 3 * 86400]
        amount, ok = abs(row["value"] or 0.0), True
        if row["event_type"] == "purchase":
            ok = amount <= 500 - posted - sum(v for _, v in holds)
            posted += amount if ok else 0
        elif row["event_type"] == "signup":
            posted -= amount
        elif row["event_type"] == "error":
            holds.append((row["ts"], amount))
        return (posted, holds), (row["event_id"], row["user_id"], ok, round(posted, 6))

    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.fold_by(e, "user_id", ["ts", "event_id"], step, "event_id long, user_id long, accepted boolean, posted double", lambda: (0.0, []))


@query("win_token_groups", """WITH RECURSIVE d AS (SELECT doc_id, doc_id // 256 AS shard, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS k FROM documents),
    g AS (SELECT shard, k, doc_id, 0::BIGINT AS grp, 1 AS held, size FROM d WHERE k = 1 UNION ALL
      SELECT d.shard, d.k, d.doc_id, g.grp + w.cut, CASE WHEN w.cut = 1 THEN 1 ELSE g.held + 1 END, CASE WHEN w.cut = 1 THEN d.size ELSE g.size + d.size END
      FROM g JOIN d ON d.shard = g.shard AND d.k = g.k + 1, LATERAL (SELECT CASE WHEN g.held >= 16 OR g.size + d.size > 8192 THEN 1 ELSE 0 END AS cut) w)
    SELECT doc_id, shard, grp AS "group" FROM g""")
def token_groups(spark, sf):
    """Greedy grouping of consecutive documents of a source: at most 16 rows and 8192 bytes; an oversize row rides alone."""

    def step(state, row):
        group, rows, size = state
        if rows and (rows >= 16 or size + row["size"] > 8192):
            group, rows, size = group + 1, 0, 0
        return (group, rows + 1, size + row["size"]), (row["doc_id"], row["shard"], group)

    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 256).alias("shard"), F.octet_length("text").alias("size"))
    return R.fold_by(d, "shard", ["doc_id"], step, "doc_id long, shard long, group long", lambda: (0, 0, 0))


@query("agg_posterior", "SELECT l_linestatus, l_quantity > 25 AS large, l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus, l_quantity > 25), 6) AS p FROM lineitem GROUP BY 1, 2, 3")
def posterior(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).alias("large"), "l_returnflag")
    return R.posterior(l, "l_returnflag", ["l_linestatus", "large"]).select("l_linestatus", "large", "l_returnflag", "n", "p")


@query("gen_posterior", "WITH s AS (SELECT l_returnflag, count(*) AS n, avg((l_quantity > 25)::INT) AS pa, avg((l_discount > 0.05)::INT) AS pb FROM lineitem GROUP BY 1), c AS (SELECT a, b FROM (VALUES (false), (true)) x(a), (VALUES (false), (true)) y(b)), j AS (SELECT a, b, l_returnflag, n * CASE WHEN a THEN pa ELSE 1 - pa END * CASE WHEN b THEN pb ELSE 1 - pb END AS j FROM s, c) SELECT a AS large, b AS cheap, l_returnflag, round(j / sum(j) OVER (PARTITION BY a, b), 6) AS p FROM j")
def gen_posterior(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("large"), (F.col("l_discount") > 0.05).alias("cheap"))
    return R.naive_bayes(l, "l_returnflag", ["large", "cheap"])


@query("agg_closed_form_pmf", "SELECT p_partkey, round(list_aggregate(list_transform(range(0, 5), lambda i: greatest(0, greatest(p_size, 5) - p_partkey % 7 - i)::DOUBLE / (greatest(p_size, 5) - i)), 'product'), 6) AS p_clean FROM part")
def pmf(spark, sf):
    """Hypergeometric P(no defect in a sample of 5) for lots of p_size items with p_partkey mod 7 defects, as a running product."""
    p = table(spark, sf, "part").select("p_partkey", F.greatest(F.col("p_size"), F.lit(5)).alias("n"), (F.col("p_partkey") % 7).alias("bad"))
    prob = F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (F.col("n") - F.col("bad") - i).cast("double")) / (F.col("n") - i))
    return p.select("p_partkey", F.round(prob, 6).alias("p_clean"))


@query("pmf_binomial", "SELECT p_partkey, round(list_sum(list_transform(range(0, 3), lambda i: factorial(10::INT) / factorial(i::INT) / factorial((10 - i)::INT) * ((p_size % 10) / 10) ** i * (1 - (p_size % 10) / 10) ** (10 - i))), 6) AS p_at_most_2 FROM part")
def pmf_binomial(spark, sf):
    q = (F.col("p_size") % 10) / 10
    terms = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda a, i: a + F.factorial(F.lit(10)) / F.factorial(i) / F.factorial(10 - i) * F.pow(q, i) * F.pow(1 - q, 10 - i))
    return table(spark, sf, "part").select("p_partkey", F.round(terms, 6).alias("p_at_most_2"))


@query("join_theta_claims", "WITH t AS (SELECT o_orderkey, count(l_orderkey) AS n, sum(l_quantity)::DOUBLE AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 11 <> 0 GROUP BY 1) SELECT o_orderkey, CASE WHEN n = 0 THEN 'not_addressed' WHEN q > 100 THEN 'supported' ELSE 'contradicted' END AS verdict FROM t")
def theta_claims(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("q")).where("l_orderkey % 11 <> 0")
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("n").isNull(), "not_addressed").when(F.col("q") > 100, "supported").otherwise("contradicted").alias("verdict"))


@query("join_identity_match", "WITH a AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CASE WHEN c_custkey % 3 <> 0 THEN floor(c_acctbal)::BIGINT % 50 END AS b FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CASE WHEN c_custkey % 5 <> 0 THEN floor(c_acctbal)::BIGINT % 50 END AS b FROM customer WHERE c_custkey % 2 = 1) SELECT a.k AS a, min(c.k) AS b, count(*) AS matches FROM a JOIN c ON a.n = c.n AND a.m = c.m WHERE a.b IS NULL OR c.b IS NULL OR a.b = c.b GROUP BY a.k")
def identity_match(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), (F.floor("c_acctbal").cast("long") % 50).alias("b"))
    a = c.where("k % 2 = 0").select(F.col("k").alias("a"), "n", "m", F.when(F.col("k") % 3 != 0, F.col("b")).alias("b"))
    b = c.where("k % 2 = 1").select("k", "n", "m", F.when(F.col("k") % 5 != 0, F.col("b")).alias("b"))
    # two fields always visible and equal: the rule's "at least two"; the third must agree where both show it
    return R.shown_matches(a, b, ["n", "m"], "b", "k").groupBy("a").agg(F.min("first").alias("b"), F.sum("matches").alias("matches"))


@query("level_of_value", "SELECT o_orderkey, ((o_totalprice > 50000)::INT + (CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice >= 150000 ELSE o_totalprice > 150000 END)::INT + (o_totalprice > 300000)::INT)::INT AS level FROM orders")
def level_of_value(spark, sf):
    x = F.col("o_totalprice")
    mid = F.when(F.col("o_orderkey") % 2 == 0, x >= 150000).otherwise(x > 150000)
    return table(spark, sf, "orders").select("o_orderkey", ((x > 50000).cast("int") + mid.cast("int") + (x > 300000).cast("int")).alias("level"))


@query("gen_ordinal", "SELECT event_id, greatest(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END, CASE WHEN value > 80 THEN 4 WHEN value > 40 THEN 2 ELSE 0 END)::INT AS severity FROM events")
def gen_ordinal(spark, sf):
    kind = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 1).otherwise(0)
    size = F.when(F.col("value") > 80, 4).when(F.col("value") > 40, 2).otherwise(0)
    return table(spark, sf, "events").select("event_id", F.greatest(kind, size).alias("severity"))


@query("gen_routing", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'security' WHEN c_mktsegment = 'BUILDING' THEN 'facilities' WHEN c_nationkey < 5 THEN 'americas' ELSE 'general' END AS team FROM customer")
def gen_routing(spark, sf):
    t = F.when(F.col("c_acctbal") < 0, "security").when(F.col("c_mktsegment") == "BUILDING", "facilities").when(F.col("c_nationkey") < 5, "americas").otherwise("general")
    return table(spark, sf, "customer").select("c_custkey", t.alias("team"))


@query("gen_nested_bucket", "WITH t AS (SELECT o_custkey, sum(o_totalprice::DOUBLE) FILTER (WHERE o_orderstatus = 'O') AS s, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN s IS NULL THEN 'none' WHEN s < 100000 THEN 'low' WHEN s < 500000 THEN 'mid' ELSE 'high' END AS bucket, first, last, top FROM t")
def gen_nested(spark, sf):
    o = table(spark, sf, "orders")
    t = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("double"))).alias("s"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"), F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("top"))
    return t.select("o_custkey", F.when(F.col("s").isNull(), "none").when(F.col("s") < 100000, "low").when(F.col("s") < 500000, "mid").otherwise("high").alias("bucket"), "first", "last", "top")


@query("gen_dates", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE AS term_end, isoyear(o_orderdate::DATE) * 100 + week(o_orderdate::DATE) AS iso_week, (o_orderdate::DATE - (isodow(o_orderdate::DATE) - 1)::INT)::DATE AS monday, (o_orderdate::DATE + CASE isodow(o_orderdate::DATE) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT)::DATE AS next_business_day FROM orders")
def gen_dates(spark, sf):
    d = F.to_date("o_orderdate")
    dow = F.weekday(d)  # Monday is 0
    iso = F.extract(F.lit("YEAROFWEEK"), d).cast("long") * 100 + F.weekofyear(d)
    return table(spark, sf, "orders").select("o_orderkey", F.add_months(d, 6).alias("term_end"), iso.alias("iso_week"), F.date_sub(d, dow).alias("monday"), F.date_add(d, F.when(dow == 4, 3).when(dow == 5, 2).otherwise(1)).alias("next_business_day"))


@query("gen_temporal_bands", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 2 WHEN l_quantity <= 30 THEN 4 ELSE 7 END AS days, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) <= CASE WHEN l_quantity <= 10 THEN 30 WHEN l_quantity <= 30 THEN 60 ELSE 90 END AS in_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def temporal_bands(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    q = F.col("l_quantity")
    band = lambda a, b, c: F.when(q <= 10, a).when(q <= 30, b).otherwise(c)
    late = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) <= band(30, 60, 90)
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", band(2, 4, 7).alias("days"), late.alias("in_time"))


@query("gen_prorated_refund", "SELECT o_orderkey, round(o_totalprice::DOUBLE * greatest(0, 365 - date_diff('day', o_orderdate::DATE, DATE '1998-12-31')) / 365, 2) AS refund FROM orders")
def prorated(spark, sf):
    left = F.greatest(F.lit(0), 365 - F.date_diff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("double") * left / 365, 2).alias("refund"))


@query("gen_retrieval", "WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), m AS (SELECT item_id, conv_id, turn, len(list_intersect(q.w, d.w)) AS o FROM q, d) SELECT item_id, count(*) FILTER (WHERE o >= 3) AS relevant, count(*) FILTER (WHERE o BETWEEN 1 AND 2) AS partial FROM m GROUP BY item_id")
def gen_retrieval(spark, sf):
    from loomline.functions.text import words

    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    o = d.join(q, "w").groupBy("item_id", "conv_id", "turn").agg(F.count(F.lit(1)).alias("o"))
    told = o.groupBy("item_id").agg(F.count_if(F.col("o") >= 3).alias("relevant"), F.count_if(F.col("o") <= 2).alias("partial"))
    return q.select("item_id").distinct().join(told, "item_id", "left").na.fill(0)


@query("gen_gridworld", "WITH RECURSIVE cell AS (SELECT i // 12 AS x, i % 12 AS y FROM range(144) r(i) WHERE (i // 12 * 7 + i % 12 * 5) % 6 <> 0 OR i = 0), d(x, y, n) AS (SELECT 0::BIGINT, 0::BIGINT, 0 UNION SELECT c.x, c.y, n + 1 FROM d JOIN cell c ON abs(c.x - d.x) + abs(c.y - d.y) = 1 WHERE n < 30) SELECT x, y, min(n) AS distance FROM d GROUP BY x, y")
def gridworld(spark, sf):
    i = F.col("id")
    cell = spark.range(144).select(F.floor(i / 12).alias("x"), (i % 12).alias("y")).where("(x * 7 + y * 5) % 6 <> 0 OR (x = 0 AND y = 0)")
    return _grid(spark, cell)


def _grid(spark, cell):
    c = cell.select(F.struct("x", "y").alias("a"), "x", "y")
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    edges = c.select("a", F.explode(steps).alias("b")).join(c.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    start = spark.range(1).select(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")).alias("node"))
    return R.reachable(edges, start, 30).select("node.x", "node.y", "distance")


@query("gen_cardinality", "SELECT i, floor(2 * 64 ** ((i % 100) / 100.0))::BIGINT AS k FROM range(300) r(i)")
def gen_cardinality(spark, sf):
    return spark.range(300).select(F.col("id").alias("i"), F.floor(2 * F.pow(F.lit(64.0), (F.col("id") % 100) / 100)).alias("k"))


@query("gen_longcontext", "SELECT l AS length, d AS depth, (l * d)::BIGINT AS place FROM (VALUES (512), (1024), (2048), (4096), (8192), (16384)) a(l), (VALUES (0.1), (0.5), (0.9)) b(d)")
def gen_longcontext(spark, sf):
    lengths = F.explode(F.array(*map(F.lit, (512, 1024, 2048, 4096, 8192, 16384))))
    grid = spark.range(1).select(lengths.alias("length")).select("length", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("depth"))
    return grid.select("length", "depth", F.round(F.col("length") * F.col("depth")).cast("long").alias("place"))


@query("gen_synthetic", "SELECT i, ['red', 'green', 'blue'][i % 3 + 1] AS colour, i % 5 AS level FROM range(100) r(i)")
def gen_synthetic(spark, sf):
    colours = F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    return spark.range(100).select(F.col("id").alias("i"), F.element_at(colours, (F.col("id") % 3 + 1).cast("int")).alias("colour"), (F.col("id") % 5).alias("level"))


@query("gen_workflows", "WITH c AS (SELECT l_orderkey, l_returnflag, sum(l_extendedprice::DOUBLE) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_returnflag) AS k FROM c) SELECT l_orderkey, l_returnflag, round(1 - abs((l_orderkey % 4) - (length(l_returnflag) % 4)) / 3.0, 6)::DOUBLE AS credit FROM r WHERE k = 1")
def gen_workflows(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("double")).alias("s"))
    best = c.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("s")).alias("s"), "l_returnflag"))["l_returnflag"].alias("l_returnflag"))
    return best.select("l_orderkey", "l_returnflag", F.round(1 - F.abs(F.col("l_orderkey") % 4 - F.length("l_returnflag") % 4) / 3, 6).alias("credit"))


@query("verify_outcome", "SELECT vec_id, round(0.5 * (vec_id % 2) + 0.5 * (1 - abs(label - (vec_id % 10)) / 9.0), 6)::DOUBLE AS credit FROM embeddings")
def verify_outcome(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(0.5 * (F.col("vec_id") % 2) + 0.5 * (1 - F.abs(F.col("label") - F.col("vec_id") % 10) / 9), 6).alias("credit"))


@query("set_component", """WITH RECURSIVE p AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY ALL), e AS (SELECT a.p_brand, a.p_size AS a, b.p_size AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 2),
    r AS (SELECT p_brand, p_size AS a, p_size AS node FROM p UNION SELECT r.p_brand, r.a, e.b FROM r JOIN e ON e.p_brand = r.p_brand AND e.a = r.node),
    c AS (SELECT p_brand, node AS p_size, min(a) AS root FROM r GROUP BY ALL), n AS (SELECT c.p_brand, root, count(*) AS sectors, min(k) AS first FROM c JOIN p USING (p_brand, p_size) GROUP BY ALL)
    SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY root) AS room, sectors, first FROM n""")
def component(spark, sf):
    """Sectors (parts) that share a passable edge (same brand, neighbouring sizes at most 2 apart), by label rounds in the plan."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    gap = F.coalesce(F.col("p_size") - F.lag("p_size").over(w) > 2, F.lit(True)).cast("int")
    room = p.withColumn("g", gap).withColumn("room", F.sum("g").over(w))
    return room.groupBy("p_brand", "room").agg(F.count(F.lit(1)).alias("sectors"), F.min("k").alias("first"))
