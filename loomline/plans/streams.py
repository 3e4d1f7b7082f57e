"""Server behaviour as streams and folds over events; event-time windows are extras beyond the decision server."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators.relational import fold_by
from loomline.operators.ranks import ranked
from loomline.plans.registry import query, table
from loomline.streaming import events as E


def stream(spark, sf, **options):
    schema = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    raw = E.read_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema, **options)
    return raw.select(*(F.col(c).cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in schema.columns))


def closed(width_us: int, late: str = "10 MINUTE") -> str:
    return f"epoch_us(start) + {width_us} <= epoch_us((SELECT max(ts) FROM events) - INTERVAL {late})"


HOUR = 3_600_000_000


@query("win_stream_tumbling", f"WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2) SELECT epoch_us(start) AS start_us, event_type, n, value FROM w WHERE {closed(HOUR)}")
def stream_tumbling(spark, sf):
    out = E.run_to_table(E.tumbling(stream(spark, sf), "1 hour", "10 minutes", "event_type"), "tumbling")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("value", 6).alias("value"))


@query("win_stream_sliding", f"WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k.i * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM events, range(2) k(i) GROUP BY 1, 2) SELECT epoch_us(start) AS start_us, event_type, n FROM w WHERE {closed(HOUR)}")
def stream_sliding(spark, sf):
    out = E.run_to_table(E.sliding(stream(spark, sf), "1 hour", "30 minutes", "10 minutes", "event_type"), "sliding")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("win_stream_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l), g AS (SELECT user_id, s, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, epoch_us(start) AS start_us, n FROM g WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sessions(spark, sf):
    out = E.run_to_table(E.sessions(stream(spark, sf), "30 minutes", "10 minutes", "user_id"), "sessions")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("st_dedup_state", "SELECT count(DISTINCT user_id) AS passes, count(*) AS requests FROM events")
def st_dedup(spark, sf):
    e = table(spark, sf, "events")
    return e.dropDuplicates(["user_id"]).agg(F.count(F.lit(1)).alias("passes")).crossJoin(e.agg(F.count(F.lit(1)).alias("requests")))


@query("st_dedup_stream", "SELECT DISTINCT event_id, user_id FROM events")
def st_dedup_stream(spark, sf):
    return E.run_to_table(E.distinct_events(stream(spark, sf), "event_id", "1 hour").select("event_id", "user_id"), "distinct")


#: A token bucket for each user, one recursion a rank.
BUCKETS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT user_id, k, event_id, now, 2.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.k, e.event_id, e.now, CASE WHEN f.had >= 1 THEN f.had - 1 ELSE f.had END, f.had >= 1, CASE WHEN f.had >= 1 THEN 0.0 ELSE (1 - f.had) / 0.001 END
      FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1, LATERAL (SELECT least(3.0, b.tokens + (e.now - b.now) * 0.001)::DOUBLE AS had) f)
    SELECT user_id, event_id, allowed, round(wait, 6) AS wait FROM b"""


@query("st_rate_limit", BUCKETS)
def rate_limit(spark, sf):
    """The batch form of the token bucket: 30 a minute, burst 3, folded over each user's ordered events."""

    def step(state, row):
        tokens, last = state
        now = row["ts"].timestamp()
        tokens, ok, wait = E.bucket_step(tokens, last, now, 0.001, 3.0)
        return (tokens, now if last is None else max(last, now)), (row["user_id"], row["event_id"], ok, round(wait, 6))

    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return fold_by(e, "user_id", ["ts", "event_id"], step, "user_id long, event_id long, allowed boolean, wait double", lambda: (3.0, None))


@query("st_rate_limit_stream", BUCKETS)
def rate_limit_stream(spark, sf):
    """What is there is one micro-batch: files overlap in time, and what a later batch brings is decided, or late, after the first."""
    out = E.run_to_table(E.rate_limited(stream(spark, sf, files_per_trigger=None), "user_id", 0.001, 3.0), "limited")
    return out.select("user_id", "event_id", "allowed", F.round("wait", 6).alias("wait"))


@query("st_prefix_cache")
def prefix_cache(spark, sf):
    """LRU of 40 length units for each scope (event type), keyed by user: hits and what is resident after each event."""
    from collections import OrderedDict

    def step(state, row):
        cache, held = state
        hit = row["user_id"] in cache
        if hit:
            cache.move_to_end(row["user_id"])
        else:
            cache[row["user_id"]] = own = 1 + row["user_id"] % 5
            held += own
            while held > 40:
                held -= cache.popitem(last=False)[1]
        return (cache, held), (row["event_id"], row["event_type"], hit, held)

    e = table(spark, sf, "events").select("event_type", "ts", "event_id", "user_id")
    return fold_by(e, "event_type", ["ts", "event_id"], step, "event_id long, event_type string, hit boolean, resident long", lambda: (OrderedDict(), 0))


@query("st_microbatch", "WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, sum(ceil(n / 8))::BIGINT AS batches, max(least(n, 8))::BIGINT AS largest FROM w GROUP BY event_type")
def microbatch(spark, sf):
    w = table(spark, sf, "events").groupBy("event_type", F.date_trunc("minute", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("event_type").agg(F.sum(F.ceil(F.col("n") / 8)).alias("batches"), F.max(F.least("n", F.lit(8).cast("long"))).alias("largest"))


@query("st_counters", "WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) SELECT n AS batch_size, count(*) AS batches FROM w GROUP BY n")
def counters(spark, sf):
    w = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy(F.col("n").alias("batch_size")).agg(F.count(F.lit(1)).alias("batches"))


@query("st_backpressure", "WITH w AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) SELECT event_id, CASE WHEN k > 12 THEN 529 ELSE 200 END AS status FROM w")
def backpressure(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.when(F.row_number().over(w) > 12, 529).otherwise(200).alias("status"))


@query("st_roster", "SELECT event_type, event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY f, user_id) AS name FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type, user_id) AS f FROM events)")
def roster(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "user_id")
    first = e.groupBy("event_type", "user_id").agg(F.min("event_id").alias("f"))
    names = ranked(first, ["f", "user_id"], by=["event_type"], name="name").drop("f")
    return e.join(names, ["event_type", "user_id"]).select("event_type", "event_id", "name")
