"""Roll-ups of trial results: success, consistency, errors, intervals, comparisons.

A result row is one trial of one task in one run.  Means skip null values and are null over no
rows; consistency and intervals are 0 over no tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the largest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def trials(results: DataFrame) -> DataFrame:
    """Results without redelivered rows: one row per run, task and trial, the last saved one."""
    return latest(results, ["run_id", "task_id", "trial"], "saved_at")


def share(condition: str | Column) -> Column:
    """Share of all rows that meet a condition; failures stay in the denominator."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return F.count_if(c) / F.count("*")


def mean(column: str, digits: int = 6) -> Column:
    return F.round(F.avg(column), digits)


def attempt_metrics(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts, success rate over all rows, and means of the scored or measured rows."""
    return results.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count("error").alias("failed"),
        (F.count("*") - F.count("error")).alias("completed"),
        F.count_if("success").alias("succeeded"),
        F.count_if(F.col("error_type") == "timeout").alias("timed_out"),
        F.round(share("success"), 6).alias("success_rate"),
        mean("reward").alias("mean_reward"),
        mean("turns").alias("mean_turns"),
        mean("total_tokens").alias("mean_tokens"),
        mean("model_latency_ms").alias("mean_model_latency_ms"),
    )


def episode_metrics(results: DataFrame, by: str = "run_id", k: int = 3) -> DataFrame:
    """Attempt counts with distinct tasks, budget overruns, latencies and pass^k."""
    base = results.groupBy(by).agg(
        F.count_distinct("task_id").alias("tasks"),
        F.count("*").alias("attempts"),
        F.count("error").alias("failed"),
        F.count_if(F.col("error_type") == "budget_exceeded").alias("budget_exceeded"),
        F.round(share("success"), 6).alias("success_rate"),
        mean("turns").alias("mean_turns"),
        mean("tool_calls").alias("mean_tool_calls"),
        mean("wall_time_seconds").alias("mean_wall_seconds"),
        mean("retrieval_latency_ms").alias("mean_retrieval_latency_ms"),
    )
    return base.join(pass_hat_k(results, by, k).withColumnRenamed("pass_k", "pass_k"), by, "left").withColumn("pass_k", F.coalesce("pass_k", F.lit(0.0)))


def first_trials(results: DataFrame, by: str = "run_id", k: int = 3) -> DataFrame:
    """The first ``k`` trials of each task, in trial order."""
    w = Window.partitionBy(by, "task_id").orderBy("trial", "saved_at")
    return results.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def pass_hat_k(results: DataFrame, by: str = "run_id", k: int = 3) -> DataFrame:
    """Share of tasks whose first ``k`` trials all succeed; a task with fewer trials counts as failed."""
    per_task = first_trials(results, by, k).groupBy(by, "task_id").agg(((F.count("*") == k) & F.bool_and("success")).alias("all_k"))
    return per_task.groupBy(by).agg(F.round(F.avg(F.coalesce(F.col("all_k"), F.lit(False)).cast("double")), 6).alias("pass_k"))


def pass_k_unbiased(results: DataFrame, by: str = "run_id", k: int = 2) -> DataFrame:
    """Mean over tasks of C(c, k) / C(n, k); tasks with fewer than ``k`` trials are left out."""
    per = results.groupBy(by, "task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c")).where(F.col("n") >= k)
    ratio = F.lit(1.0)
    for i in range(k):
        ratio = ratio * (F.greatest(F.col("c") - i, F.lit(0)) / (F.col("n") - i))
    return per.groupBy(by).agg(F.round(F.avg(ratio), 6).alias("pass_k"), F.count("*").alias("tasks"))


def task_rate(results: DataFrame, by: str = "run_id") -> DataFrame:
    return results.groupBy(by, "task_id").agg(F.avg(F.col("success").cast("double")).alias("rate"))


def error_counts(results: DataFrame, by: str = "run_id") -> DataFrame:
    return results.where("error_type <> ''").groupBy(by, "error_type").agg(F.count("*").alias("n"))


#: Replicates of an interval, and replicates that one row of the first step stands for.
REPLICATES, TOGETHER = 10_000, 100


def replicate_means(values: DataFrame, by: str, id_column: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Means of ``replicates`` resamples with replacement: (by, replicate, mean).

    Draws are parts of a hash of seed, replicate and position, four of one hash, so results repeat
    and any engine can compute them.  A group's values travel as one array (tasks of a run:
    hundreds), once per ``TOGETHER`` replicates, which are spread over all tasks before any draw.
    """
    parts = values.sparkSession.sparkContext.defaultParallelism
    ordered = values.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(id_column).alias("id"), F.col(value).cast("double").alias("v")))).alias("a"))
    ordered = ordered.select(by, F.transform("a", lambda x: x["v"]).alias("a"), F.size("a").alias("n"))
    blocks = ordered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // TOGETHER)))).repartition(parts, by, "block")
    first = F.col("block") * TOGETHER
    grid = blocks.withColumn("replicate", F.explode(F.sequence(first, F.least(first + TOGETHER, F.lit(replicates)) - 1)))
    hashed = lambda j: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), j.cast("string")))
    draw = lambda h, c: F.get("a", F.pmod(F.conv(F.substring(h, 8 * c + 1, 8), 16, 10).cast("bigint"), F.col("n")).cast("int"))

    def four(j):
        added = lambda h, c: F.when(4 * j + c < F.col("n"), draw(h, c)).otherwise(F.lit(0.0))
        return F.transform(F.array(hashed(j)), lambda h: added(h, 0) + added(h, 1) + added(h, 2) + added(h, 3))[0]

    total = F.aggregate(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int")), F.lit(0.0), lambda s, j: s + four(j))
    return grid.select(by, "replicate", F.round(total / F.col("n"), 9).alias("mean"))


def interval(means: DataFrame, by: str, replicates: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of replicate means: ranks max(0, floor(a/2 B)) and min(B-1, ceil((1-a/2) B) - 1)."""
    low = max(0, int(alpha / 2 * replicates))
    high = min(replicates - 1, -int(-(1 - alpha / 2) * replicates // 1) - 1)
    w = Window.partitionBy(by).orderBy("mean", "replicate")
    ranked = means.withColumn("r", F.row_number().over(w) - 1)
    return ranked.groupBy(by).agg(F.max(F.when(F.col("r") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("mean"))).alias("high"))


def bootstrap_interval(results: DataFrame, by: str = "run_id", replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Interval of the mean per-task success rate, resampling tasks."""
    rates = task_rate(results, by)
    point = rates.groupBy(by).agg(F.round(F.avg("rate"), 6).alias("point"))
    return point.join(interval(replicate_means(rates, by, "task_id", "rate", replicates, seed), by, replicates), by)


def paired_rates(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Per-task rates of two runs, tasks present in both: (pair, task_id, rate_a, rate_b, delta);
    a run is paired with the next one in name order."""
    rates = task_rate(results, by)
    runs = rates.select(by).distinct().withColumn("n", F.row_number().over(Window.orderBy(by)))  # one row per run
    nxt = runs.select(F.col(by).alias("run_b"), (F.col("n") - 1).alias("n"))
    pairs = runs.join(nxt, "n").select(F.col(by).alias("run_a"), "run_b")
    a = rates.select(F.col(by).alias("run_a"), "task_id", F.col("rate").alias("rate_a"))
    b = rates.select(F.col(by).alias("run_b"), "task_id", F.col("rate").alias("rate_b"))
    joined = pairs.join(a, "run_a").join(b, ["run_b", "task_id"])
    return joined.select("run_a", "run_b", "task_id", "rate_a", "rate_b", (F.col("rate_a") - F.col("rate_b")).alias("delta"))


def paired_interval(results: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    pairs = paired_rates(results).withColumn("pair", F.concat_ws("~", "run_a", "run_b"))
    point = pairs.groupBy("pair").agg(F.round(F.avg("delta"), 6).alias("point"))
    return point.join(interval(replicate_means(pairs, "pair", "task_id", "delta", replicates, seed), "pair", replicates), "pair")


def win_loss(pairs: DataFrame, margin: float = 0.01) -> DataFrame:
    """Means and wins, ties and losses of paired scores; a difference within ``margin`` is a tie."""
    return pairs.groupBy("run_a", "run_b").agg(
        mean("rate_a").alias("mean_a"),
        mean("rate_b").alias("mean_b"),
        mean("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > margin).alias("wins"),
        F.count_if(F.abs("delta") <= margin).alias("ties"),
        F.count_if(F.col("delta") < -margin).alias("losses"),
    )


def choice_accuracy(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Accuracy by the first letter of the trimmed upper-cased answer, and its difference to the
    first run's in percentage points; rows without an answer stay in the denominator."""
    right = F.coalesce(F.substring(F.upper(F.trim(F.get("actions", F.lit(0)))), 1, 1) == F.substring(F.upper(F.get("expected_actions", F.lit(0))), 1, 1), F.lit(False))
    acc = results.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
    base = acc.agg(F.min_by("accuracy", by).alias("base"))
    return acc.crossJoin(F.broadcast(base)).select(by, "n", "accuracy", F.round(100 * (F.col("accuracy") - F.coalesce("base", F.col("accuracy"))), 4).alias("delta_pp"))  # one row broadcast


def action_recall(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Mean share of distinct expected actions that were taken; 1 where none is expected, null
    where expectations are unknown."""
    want = F.array_distinct("expected_actions")
    recall = F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, "actions")) / F.size(want))
    return results.where("expected_actions IS NOT NULL").groupBy(by).agg(F.round(F.avg(recall), 6).alias("action_recall"), F.count("*").alias("n"))


def latency_summary(results: DataFrame, by: str = "run_id") -> DataFrame:
    return results.groupBy(by).agg(
        mean("model_latency_ms").alias("mean_ms"),
        F.round(F.percentile("model_latency_ms", 0.5), 6).alias("median_ms"),
        F.min("model_latency_ms").alias("min_ms"),
        F.max("model_latency_ms").alias("max_ms"),
        mean("total_tokens").alias("mean_tokens"),
        F.sum("total_tokens").alias("sum_tokens"),
        F.count("error").alias("failures"),
    )


def variant_lookup(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected variants with their newest matching run, or none: (variant, run_id, saved_at)."""
    runs = results.groupBy("run_id").agg(F.max("saved_at").alias("saved_at"))
    found = F.broadcast(expected).join(runs, F.col("run_id").contains(F.col("variant")), "left")  # expected: a short fixed list
    w = Window.partitionBy("variant").orderBy(F.col("saved_at").desc_nulls_last(), "run_id")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("variant", "run_id", "saved_at")


def cumulative_budget(results: DataFrame, turns: int = 20, calls: int = 15, seconds: float = 300.0) -> DataFrame:
    """First trial of each task, in trial order, whose running sums reach a limit: (run_id,
    task_id, trial, reason); turns are tested before calls, calls before time."""
    w = Window.partitionBy("run_id", "task_id").orderBy("trial", "saved_at").rowsBetween(Window.unboundedPreceding, 0)
    reason = (
        F.when(F.sum("turns").over(w) >= turns, "turns")
        .when(F.sum("tool_calls").over(w) >= calls, "tool_calls")
        .when(F.sum("wall_time_seconds").over(w) > seconds, "wall_time")
    )
    hit = results.withColumn("reason", reason).where("reason IS NOT NULL")
    first = Window.partitionBy("run_id", "task_id").orderBy("trial", "saved_at")
    return hit.withColumn("n", F.row_number().over(first)).where("n = 1").select("run_id", "task_id", "trial", "reason")


def group_advantage(results: DataFrame) -> DataFrame:
    """Reward minus the mean reward of the task's trials."""
    w = Window.partitionBy("run_id", "task_id")
    return results.select("run_id", "task_id", "trial", F.round(F.col("reward") - F.avg("reward").over(w), 6).alias("advantage"))


def metrics_cube(results: DataFrame) -> DataFrame:
    """Attempts and success rate by run and error type, with all subtotals."""
    kind = F.coalesce("error_type", F.lit("none"))
    return (
        results.withColumn("kind", kind)
        .cube("run_id", "kind")
        .agg(F.count("*").alias("n"), F.round(share("success"), 6).alias("success_rate"), F.grouping_id().cast("long").alias("level"))
    )
