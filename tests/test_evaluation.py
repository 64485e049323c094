"""Cases of trial roll-ups that the reference's tests pin."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomlake.operators import evaluation as ev

SCHEMA = """run_id string, task_id string, trial long, success boolean, reward double, actions array<string>, expected_actions array<string>, turns long, tool_calls long, total_tokens long,
 wall_time_seconds double, retrieval_latency_ms double, model_latency_ms double, error string, error_type string, saved_at timestamp"""


def results(spark, tasks: dict[str, list[bool]], errors: dict | None = None, run: str = "r"):
    at = datetime.datetime(2025, 1, 1)
    rows = [
        (run, t, n, ok, float(ok), ["a"], ["a"], 5, 2, 10, 1.0, 1.0, 1.0, (errors or {}).get((t, n)), (errors or {}).get((t, n)), at)
        for t, trials in tasks.items()
        for n, ok in enumerate(trials)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("tasks", "k", "want"),
    [
        ({"a": [True] * 3, "b": [True] * 3}, 3, 1.0),
        ({"a": [True, True, False], "b": [False, True, True]}, 3, 0.0),
        ({"a": [True] * 3, "b": [True, False, True]}, 3, 0.5),
        ({"a": [True], "b": [True], "c": [False]}, 1, 0.666667),
        ({"a": [True, True]}, 3, 0.0),
    ],
)
def test_pass_hat_k(spark, tasks, k, want):
    assert ev.pass_hat_k(results(spark, tasks), k=k).first().pass_k == want


def test_empty(spark):
    none = results(spark, {"a": [True]}).limit(0)
    assert ev.pass_hat_k(none).count() == 0
    assert ev.bootstrap_interval(none).count() == 0
    assert ev.attempt_metrics(none).count() == 0


def test_failures_stay_in_the_denominator(spark):
    r = results(spark, {"a": [True], "b": [False], "c": [False]}, {("b", 0): "timeout", ("c", 0): "api_error"})
    row = ev.attempt_metrics(r).first()
    assert (row.total, row.failed, row.timed_out, row.success_rate) == (3, 2, 1, 0.333333)


@pytest.mark.parametrize(("ok", "want"), [(True, 1.0), (False, 0.0)])
def test_interval_of_equal_tasks(spark, ok, want):
    row = ev.bootstrap_interval(results(spark, {t: [ok] * 3 for t in "abcde"}), replicates=50).first()
    assert (row.point, row.low, row.high) == (want, want, want)


def test_interval_holds_the_point_and_repeats(spark):
    r = results(spark, {"a": [True] * 3, "b": [True] * 3, "c": [True] * 3, "d": [False] * 3, "e": [False] * 3})
    one, two = (ev.bootstrap_interval(r, replicates=200).first() for _ in range(2))
    assert one == two and one.low <= one.point == 0.6 <= one.high


def test_pairs_need_both_runs(spark):
    r = results(spark, {"a": [True], "b": [False]}, run="x").union(results(spark, {"b": [True], "c": [True]}, run="y"))
    rows = ev.paired_rates(r).collect()
    assert [(x.task_id, x.delta) for x in rows] == [("b", -1.0)]


def test_redelivered_trial_counts_once(spark):
    r = results(spark, {"a": [True]})
    again = r.withColumn("saved_at", F.expr("saved_at + interval 1 day")).withColumn("success", F.lit(False))
    assert ev.trials(r.union(again)).first().success is False
