"""Ordered series: training logs, trial grids, smoothing and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trial_grid(results: DataFrame, trials: int) -> DataFrame:
    """Every task with every trial number."""
    return results.select("task_id").distinct().select("task_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial"))


def missing_trials(results: DataFrame, trials: int) -> DataFrame:
    """(run_id, task_id, trial) still to be run: the grid of each run's tasks without what exists."""
    grid = results.select("run_id", "task_id").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    return grid.join(results.select("run_id", "task_id", "trial"), ["run_id", "task_id", "trial"], "left_anti")


def steps(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, step, value): values numbered from 0 in order."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(by, (F.row_number().over(w) - 1).cast("long").alias("step"), F.col(value).alias("value"))


def loss_summary(log: DataFrame, by: str) -> DataFrame:
    """First, last and least value, reduction in percent, and whether the last is over 1.05 times the least."""
    s = log.groupBy(by).agg(F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"), F.min("value").alias("least"))
    percent = F.round(100 * (F.col("first") - F.col("last")) / F.nullif("first", F.lit(0.0)), 6)
    return s.select(by, "first", "last", "least", percent.alias("reduction_percent"), (F.col("last") > 1.05 * F.col("least")).alias("overfit"))


def first_last(log: DataFrame, by: str) -> DataFrame:
    first, last = F.min_by("value", "step"), F.max_by("value", "step")
    return log.groupBy(by).agg(first.alias("initial"), last.alias("final"), F.max("value").alias("best"), F.round(last - first, 6).alias("improvement"))


def ema(log: DataFrame, by: str, weight: float = 0.1, least: int = 6) -> DataFrame:
    """Exponential moving average at the end of series of at least ``least`` values; a series is one array."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"])
    g = log.groupBy(by).agg(v.alias("v")).where(F.size("v") >= least)
    folded = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda a, x: weight * x + (1 - weight) * a)
    return g.select(by, F.round(folded, 6).alias("ema"))


def train_at_eval(log: DataFrame, by: str) -> DataFrame:
    """Gap between evaluation values (every fifth step) and training values interpolated there;
    flat beyond the ends."""
    at = F.col("step") % 5 == 2
    e = log.select(by, "step", F.when(~at, F.col("value")).alias("train"), F.when(at, F.col("value")).alias("eval"))
    w = Window.partitionBy(by).orderBy("step")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("train").isNotNull(), F.col("step"))
    n = e.select(
        by, "step", "eval", F.last(mark, True).over(before).alias("s0"), F.last("train", True).over(before).alias("t0"), F.first(mark, True).over(after).alias("s1"), F.first("train", True).over(after).alias("t1")
    )
    line = F.col("t0") + (F.col("t1") - F.col("t0")) * (F.col("step") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    there = F.when(F.col("s0").isNull(), F.col("t1")).when(F.col("s1").isNull(), F.col("t0")).otherwise(line)
    return n.where("eval IS NOT NULL").select(by, "step", F.round(F.col("eval") - there, 6).alias("gap"))
