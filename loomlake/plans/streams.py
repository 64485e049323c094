"""Streaming queries over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.plans.registry import query
from loomlake.streaming import operators as so

NTZ = "timestamp_ntz"


def _source(spark, d):
    return so.events(spark, f"{d}/events*.parquet")


#: The watermark at the end: a row is given out once no event can change it any more.
PASSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' FROM events)"


@query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING begin + INTERVAL '1 hour' <= {PASSED}")
def stream_eval_rollup(spark, d):
    return so.run(so.rollup(_source(spark, d)), "rollup").withColumn("begin", F.col("begin").cast(NTZ))


@query(f"""WITH x AS (SELECT *, unnest([0, 15, 30, 45]) AS back FROM events) SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(back) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2
 HAVING begin + INTERVAL '1 hour' <= {PASSED}""")
def stream_sliding(spark, d):
    return so.run(so.rollup(_source(spark, d), slide="15 minutes"), "sliding").withColumn("begin", F.col("begin").cast(NTZ))


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begin, count(*) AS n FROM r GROUP BY user_id, s HAVING max(ts) + INTERVAL '30 minutes' <= {PASSED}""")
def stream_session_window(spark, d):
    return so.run(so.sessions(_source(spark, d)), "sessions").withColumn("begin", F.col("begin").cast(NTZ))


@query("SELECT user_id, event_type, props, CAST(1 AS BIGINT) AS kept FROM events GROUP BY 1, 2, 3")
def stream_dup_guard(spark, d):
    """Users, types and arguments, and how many of their events the guard let through."""
    s = so.run(so.once(_source(spark, d), ["user_id", "event_type", "props"]), "once")
    return s.groupBy("user_id", "event_type", "props").agg(F.count("*").alias("kept"))


BUDGET = "turns >= 20 OR calls >= 6 OR elapsed > INTERVAL '10 days'"


@query(f"""WITH w AS (SELECT user_id, row_number() OVER o AS turns, count(*) FILTER (event_type = 'purchase') OVER o AS calls, ts - first_value(ts) OVER o AS elapsed, count(*) OVER (PARTITION BY user_id) AS events FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, CASE WHEN turns >= 20 THEN 'turns' WHEN calls >= 6 THEN 'tool_calls' WHEN elapsed > INTERVAL '10 days' THEN 'wall_time' END AS reason FROM w WHERE {BUDGET} OR turns = events)
 SELECT user_id, turns, calls, reason FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turns) = 1""")
def stream_session_budget(spark, d):
    """A session is a user here, a purchase a tool call; all three limits occur."""
    s = so.run(so.budget(_source(spark, d), 20, 6, 864_000.0, "event_type = 'purchase'"), "budget", "update")
    last = s.groupBy("user_id").agg(F.max_by(F.struct("turns", "calls", "reason"), "batch").alias("x"))
    return last.select("user_id", "x.turns", "x.calls", "x.reason")
