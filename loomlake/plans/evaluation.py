"""Queries over trial results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import evaluation as ev
from loomlake.operators import series
from loomlake.plans.registry import query
from loomlake.workspace import table

R = "WITH r AS (SELECT * FROM task_results QUALIFY row_number() OVER (PARTITION BY run_id, task_id, trial ORDER BY saved_at DESC) = 1)"
FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY trial, saved_at) AS pos FROM r)"
PASSK = "pk AS (SELECT run_id, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS pass_k FROM (SELECT run_id, task_id, coalesce(count(*) = 3 AND bool_and(success), false) AS ok FROM f WHERE pos <= 3 GROUP BY 1, 2) GROUP BY 1)"
RATE = "rate AS (SELECT run_id, task_id, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS rate FROM r GROUP BY 1, 2)"
PAIRED = """runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS n FROM (SELECT DISTINCT run_id FROM rate)),
pairs AS (SELECT a.run_id AS run_a, b.run_id AS run_b, x.task_id, x.rate AS rate_a, y.rate AS rate_b, x.rate - y.rate AS delta
  FROM runs a JOIN runs b ON b.n = a.n + 1 JOIN rate x ON x.run_id = a.run_id JOIN rate y ON y.run_id = b.run_id AND y.task_id = x.task_id)"""


def _boot(source: str, by: str, value: str) -> str:
    return f"""g AS (SELECT {by} AS k, list(struct_pack(id := task_id, v := {value}) ORDER BY task_id) AS a FROM {source} GROUP BY 1),
draws AS (SELECT k, b, round(list_sum([a[1 + CAST((('0x' || substr(md5('42|' || b || '|' || (i // 4)), 8 * (i % 4) + 1, 8))::BIGINT % len(a)) AS INT)].v FOR i IN range(0, len(a))]) / len(a), 9) AS mean
  FROM g, range(0, 10000) AS t(b)),
ranked AS (SELECT k, mean, row_number() OVER (PARTITION BY k ORDER BY mean, b) - 1 AS n FROM draws),
ci AS (SELECT k, max(mean) FILTER (n = 250) AS low, max(mean) FILTER (n = 9749) AS high FROM ranked GROUP BY 1)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    return ev.trials(table(spark, d, "task_results"))


@query(R + """ SELECT run_id, count(*) AS total, count(error) AS failed, count(*) - count(error) AS completed, count(*) FILTER (success) AS succeeded,
 count(*) FILTER (error_type = 'timeout') AS timed_out, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(reward), 6) AS mean_reward,
 round(avg(turns), 6) AS mean_turns, round(avg(total_tokens), 6) AS mean_tokens, round(avg(model_latency_ms), 6) AS mean_model_latency_ms FROM r GROUP BY run_id""")
def diag_metrics(spark, d):
    return ev.attempt_metrics(results(spark, d))


@query(R + f", {FIRST}, {PASSK}" + """ SELECT r.run_id, count(DISTINCT task_id) AS tasks, count(*) AS attempts, count(error) AS failed, count(*) FILTER (error_type = 'budget_exceeded') AS budget_exceeded,
 round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(turns), 6) AS mean_turns, round(avg(tool_calls), 6) AS mean_tool_calls, round(avg(wall_time_seconds), 6) AS mean_wall_seconds,
 round(avg(retrieval_latency_ms), 6) AS mean_retrieval_latency_ms, any_value(pass_k) AS pass_k FROM r JOIN pk ON pk.run_id = r.run_id GROUP BY 1""")
def episode_metrics(spark, d):
    return ev.episode_metrics(results(spark, d))


@query(R + " SELECT run_id, error_type, count(*) AS n FROM r WHERE error_type <> '' GROUP BY 1, 2")
def error_counts(spark, d):
    return ev.error_counts(results(spark, d))


@query(R + f", {FIRST}, {PASSK} SELECT run_id, pass_k FROM pk")
def pass_hat_k(spark, d):
    return ev.pass_hat_k(results(spark, d))


@query(R + """, p AS (SELECT run_id, task_id, count(*) AS n, count(*) FILTER (success) AS c FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT run_id, round(avg(greatest(c, 0)::DOUBLE / n * (greatest(c - 1, 0)::DOUBLE / (n - 1))), 6) AS pass_k, count(*) AS tasks FROM p GROUP BY 1""")
def pass_k_unbiased(spark, d):
    return ev.pass_k_unbiased(results(spark, d))


@query(R + f", {FIRST} SELECT run_id, task_id, trial, pos AS position FROM f WHERE pos <= 3")
def first_k_trials(spark, d):
    return ev.first_trials(results(spark, d)).select("run_id", "task_id", "trial", F.col("position").cast("long").alias("position"))


@query(R + f", {RATE} SELECT run_id, task_id, round(rate, 6) AS rate FROM rate")
def task_rate(spark, d):
    return ev.task_rate(results(spark, d)).withColumn("rate", F.round("rate", 6))


@query(R + f", {RATE}, {PAIRED} SELECT run_a, run_b, task_id, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, round(delta, 6) AS delta FROM pairs")
def paired_task_join(spark, d):
    return ev.paired_rates(results(spark, d)).select("run_a", "run_b", "task_id", *[F.round(c, 6).alias(c) for c in ("rate_a", "rate_b", "delta")])


@query(R + f", {RATE}, {PAIRED}" + """ SELECT run_a, run_b, round(avg(rate_a), 6) AS mean_a, round(avg(rate_b), 6) AS mean_b, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0.01e0) AS wins,
 count(*) FILTER (abs(delta) <= 0.01e0) AS ties, count(*) FILTER (delta < -0.01e0) AS losses FROM pairs GROUP BY 1, 2""")
def paired_mean_delta(spark, d):
    return ev.win_loss(ev.paired_rates(results(spark, d)))


@query(R + f", {RATE}, {PAIRED} SELECT task_id, run_a, run_b, CASE WHEN delta > 0.01e0 THEN 'win' WHEN delta >= -0.01e0 THEN 'tie' ELSE 'loss' END AS verdict FROM pairs")
def winloss_zip(spark, d):
    verdict = F.when(F.col("delta") > 0.01, "win").when(F.col("delta") >= -0.01, "tie").otherwise("loss")
    return ev.paired_rates(results(spark, d)).select("task_id", "run_a", "run_b", verdict.alias("verdict"))


@query(R + f", {RATE}, {_boot('rate', 'run_id', 'rate')} SELECT ci.k AS run_id, round(avg(rate), 6) AS point, any_value(low) AS low, any_value(high) AS high FROM rate JOIN ci ON ci.k = run_id GROUP BY 1")
def bootstrap_ci(spark, d):
    return ev.bootstrap_interval(results(spark, d))


@query(R + f", {RATE}, {PAIRED}, q AS (SELECT *, run_a || '~' || run_b AS pair FROM pairs), {_boot('q', 'pair', 'delta')} SELECT ci.k AS pair, round(avg(delta), 6) AS point, any_value(low) AS low, any_value(high) AS high FROM q JOIN ci ON ci.k = pair GROUP BY 1")
def paired_bootstrap_ci(spark, d):
    return ev.paired_interval(results(spark, d))


@query(R + """, a AS (SELECT run_id, count(*) AS n, round(avg(CASE WHEN coalesce(substr(upper(trim(actions[1])), 1, 1) = substr(upper(expected_actions[1]), 1, 1), false) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM r GROUP BY 1)
 SELECT run_id, n, accuracy, round(100 * (accuracy - (SELECT arg_min(accuracy, run_id) FROM a)), 4) AS delta_pp FROM a""")
def retention(spark, d):
    return ev.choice_accuracy(results(spark, d))


@query(R + """, s AS (SELECT run_id, list_distinct(expected_actions) AS w, actions FROM r WHERE expected_actions IS NOT NULL)
 SELECT run_id, round(avg(CASE WHEN len(w) = 0 THEN 1e0 ELSE len(list_intersect(w, actions))::DOUBLE / len(w) END), 6) AS action_recall, count(*) AS n FROM s GROUP BY 1""")
def action_recall(spark, d):
    return ev.action_recall(results(spark, d))


@query(R + """ SELECT run_id, round(avg(model_latency_ms), 6) AS mean_ms, round(quantile_cont(model_latency_ms, 0.5), 6) AS median_ms, min(model_latency_ms) AS min_ms, max(model_latency_ms) AS max_ms,
 round(avg(total_tokens), 6) AS mean_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens, count(error) AS failures FROM r GROUP BY 1""")
def latency_summary(spark, d):
    return ev.latency_summary(results(spark, d))


@query(R + """, v AS (SELECT unnest(['00000', '00001', '00002', 'absent']) AS variant), g AS (SELECT run_id, max(saved_at) AS saved_at FROM r GROUP BY 1)
 SELECT variant, run_id, saved_at FROM v LEFT JOIN g ON contains(run_id, variant) QUALIFY row_number() OVER (PARTITION BY variant ORDER BY saved_at DESC NULLS LAST, run_id) = 1""")
def variant_lookup(spark, d):
    return ev.variant_lookup(results(spark, d), spark.createDataFrame([(v,) for v in ("00000", "00001", "00002", "absent")], "variant string"))


@query(R + """, s AS (SELECT run_id, task_id, trial, saved_at, sum(turns) OVER w AS t, sum(tool_calls) OVER w AS c, sum(wall_time_seconds) OVER w AS e FROM r WINDOW w AS (PARTITION BY run_id, task_id ORDER BY trial, saved_at ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT *, CASE WHEN t >= 20 THEN 'turns' WHEN c >= 15 THEN 'tool_calls' WHEN e > 300 THEN 'wall_time' END AS reason FROM s)
 SELECT run_id, task_id, trial, reason FROM h WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, task_id ORDER BY trial, saved_at) = 1""")
def budget_cutoff(spark, d):
    return ev.cumulative_budget(results(spark, d))


@query(R + " SELECT run_id, task_id, trial, round(reward - avg(reward) OVER (PARTITION BY run_id, task_id), 6) AS advantage FROM r")
def group_relative_advantage(spark, d):
    return ev.group_advantage(results(spark, d))


@query(R + """ SELECT run_id, kind, count(*) AS n, round(count(*) FILTER (success) / count(*), 6) AS success_rate, CAST(grouping_id(run_id, kind) AS BIGINT) AS level
 FROM (SELECT *, coalesce(error_type, 'none') AS kind FROM r) GROUP BY CUBE (run_id, kind)""")
def metrics_cube(spark, d):
    return ev.metrics_cube(results(spark, d))


@query(R + f", {FIRST}, {PASSK}, {RATE}, {_boot('rate', 'run_id', 'rate')}" + """ SELECT r.run_id, count(DISTINCT task_id) AS tasks, count(*) AS attempts, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
 any_value(pass_k) AS pass_k, any_value(low) AS low, any_value(high) AS high FROM r JOIN pk ON pk.run_id = r.run_id JOIN ci ON ci.k = r.run_id GROUP BY 1""")
def run_summary(spark, d):
    rows = results(spark, d)
    base = ev.episode_metrics(rows).select("run_id", "tasks", "attempts", "success_rate", "pass_k")
    return base.join(ev.bootstrap_interval(rows).select("run_id", "low", "high"), "run_id")


COMPARE = """, a AS (SELECT run_id, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM r GROUP BY 1),
 acc AS (SELECT run_id, round(avg(CASE WHEN coalesce(substr(upper(trim(actions[1])), 1, 1) = substr(upper(expected_actions[1]), 1, 1), false) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM r GROUP BY 1)
 SELECT 'episodes' AS track, a.run_id, success_rate, round(100 * (accuracy - (SELECT arg_min(accuracy, run_id) FROM acc)), 4) AS delta_pp FROM a LEFT JOIN acc ON acc.run_id = a.run_id
 UNION ALL SELECT 'diagnostics', run_id, round(avg(reward), 6), NULL FROM r GROUP BY run_id"""


@query(R + COMPARE)
def comparison_join(spark, d):
    rows = results(spark, d)
    left = rows.groupBy("run_id").agg(F.round(ev.share("success"), 6).alias("success_rate"))
    kept = ev.choice_accuracy(rows).select("run_id", "delta_pp")
    episodes = left.join(kept, "run_id", "left").select(F.lit("episodes").alias("track"), "run_id", "success_rate", "delta_pp")
    diagnostics = rows.groupBy("run_id").agg(F.round(F.avg("reward"), 6).alias("success_rate"))
    return episodes.unionByName(diagnostics.withColumn("track", F.lit("diagnostics")), allowMissingColumns=True)


@query(R + """, g AS (SELECT DISTINCT run_id, task_id FROM r), t AS (SELECT run_id, task_id, trial FROM g, range(0, 3) AS x(trial))
 SELECT t.run_id, t.task_id, t.trial FROM t ANTI JOIN r ON r.run_id = t.run_id AND r.task_id = t.task_id AND r.trial = t.trial""")
def resume_anti_join(spark, d):
    return series.missing_trials(results(spark, d), 3)


@query("SELECT task_id, trial FROM (SELECT DISTINCT task_id FROM task_results), range(0, 3) AS x(trial)")
def trial_grid(spark, d):
    return series.trial_grid(table(spark, d, "task_results"), 3)


# Loss-like series: the values of each user's events in time order stand for a training log.
L = "WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value FROM events)"


def log(spark, d):
    return series.steps(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query(L + """, s AS (SELECT user_id, arg_min(value, step) AS first, arg_max(value, step) AS last, min(value) AS least, arg_min(step, value * 1e6 + step * 1e-3) AS best FROM l GROUP BY 1)
 SELECT user_id, first, last, least, round(100 * (first - last) / nullif(first, 0), 6) AS reduction_percent, last > 1.05e0 * least AS overfit FROM s""")
def loss_summary(spark, d):
    return series.loss_summary(log(spark, d), "user_id")


@query(L + " SELECT user_id, arg_min(value, step) AS initial, arg_max(value, step) AS final, max(value) AS best, round(arg_max(value, step) - arg_min(value, step), 6) AS improvement FROM l GROUP BY 1")
def first_last_metric(spark, d):
    return series.first_last(log(spark, d), "user_id")


@query(L + """, g AS (SELECT user_id, list(value ORDER BY step) AS v FROM l GROUP BY 1 HAVING count(*) > 5)
 SELECT user_id, round(list_reduce(v, lambda a, x: 0.1e0 * x + 0.9e0 * a), 6) AS ema FROM g""")
def ema(spark, d):
    return series.ema(log(spark, d), "user_id")


@query(L + """, e AS (SELECT user_id, step, CASE WHEN step % 5 <> 2 THEN value END AS train, CASE WHEN step % 5 = 2 THEN value END AS eval FROM l),
 n AS (SELECT *, last_value(CASE WHEN train IS NOT NULL THEN step END IGNORE NULLS) OVER p AS s0, last_value(train IGNORE NULLS) OVER p AS t0,
   first_value(CASE WHEN train IS NOT NULL THEN step END IGNORE NULLS) OVER q AS s1, first_value(train IGNORE NULLS) OVER q AS t1 FROM e
   WINDOW p AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT user_id, step, round(eval - CASE WHEN s0 IS NULL THEN t1 WHEN s1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * (step - s0) / (s1 - s0) END, 6) AS gap FROM n WHERE eval IS NOT NULL""")
def train_at_eval_interp(spark, d):
    return series.train_at_eval(log(spark, d), "user_id")
