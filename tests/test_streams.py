"""Streams over files that arrive one by one: late events, repeats, budgets over batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlake.streaming import operators as so

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def arrive(spark, folder, *batches):
    """Each batch of (minute, user, type, props) is a file, in order of arrival."""
    import os
    import shutil

    n = 0
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        made = [(n + j, T0 + timedelta(minutes=m), u, k, 1.0, p) for j, (m, u, k, p) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
        (name,) = [f for f in os.listdir(f"{folder}/in") if f.endswith(".parquet")]
        os.rename(f"{folder}/in/{name}", f"{folder}/{i:03d}.parquet")
        os.utime(f"{folder}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        shutil.rmtree(f"{folder}/in")
    return so.events(spark, f"{folder}/*.parquet")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "events")


def test_rollup_gives_out_closed_windows_and_drops_late_events(spark, folder):
    stream = arrive(spark, folder, [(5, 1, "a", "x")], [(300, 1, "a", "x")], [(301, 1, "a", "x")], [(10, 1, "a", "late")], [(900, 1, "a", "x")])
    out = {(r.begin.hour, r.n) for r in so.run(so.rollup(stream), "t").collect()}
    assert out == {(0, 1), (5, 2)}  # the late event of hour 0 is not counted, the last window is still open


def test_sessions_close_behind_the_watermark(spark, folder):
    stream = arrive(spark, folder, [(0, 1, "a", "x"), (20, 1, "a", "x"), (70, 1, "a", "x")], [(500, 2, "a", "x")], [(1000, 2, "a", "x")])
    assert {(r.user_id, r.n) for r in so.run(so.sessions(stream), "t").collect()} == {(1, 2), (1, 1), (2, 1)}


def test_guard_drops_repeats_inside_the_watermark_only(spark, folder):
    stream = arrive(spark, folder, [(0, 1, "a", "x"), (1, 1, "a", "x"), (1, 1, "a", "y")], [(30, 1, "a", "x")], [(300, 9, "z", "z")], [(301, 9, "z", "v")], [(302, 1, "a", "x")])
    kept = so.run(so.once(stream, ["user_id", "event_type", "props"]), "t")
    assert {(r.props, r.n) for r in kept.where("user_id = 1").groupBy("props").agg(F.count("*").alias("n")).collect()} == {("x", 2), ("y", 1)}


def test_budgets_stop_at_each_limit_and_over_batches(spark, folder):
    first = [(0, 1, "say", ""), (1, 1, "say", ""), (0, 2, "tool", ""), (0, 3, "say", ""), (0, 4, "say", "")]
    second = [(2, 1, "say", ""), (3, 1, "tool", ""), (1, 2, "tool", ""), (2, 2, "tool", ""), (9, 3, "say", ""), (10, 3, "say", "")]
    stream = arrive(spark, folder, first, second)
    out = so.run(so.budget(stream, turns=3, calls=2, seconds=300.0, call="event_type = 'tool'"), "t", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("turns", "calls", "reason"), "batch").alias("x")).collect()
    assert {(r.user_id, *r.x) for r in last} == {(1, 3, 0, "turns"), (2, 2, 2, "tool_calls"), (3, 2, 0, "wall_time"), (4, 1, 0, None)}


def test_a_budget_is_forgotten_behind_the_watermark(spark, folder):
    stream = arrive(spark, folder, [(0, 1, "say", "")], [(600, 2, "say", "")], [(601, 2, "say", "")], [(602, 1, "say", "")])
    out = so.run(so.budget(stream, turns=5), "t", "update").where("user_id = 1")
    assert {r.turns for r in out.collect()} == {1}


def test_streams_of_nothing(spark, folder):
    stream = arrive(spark, folder, [])
    assert so.run(so.rollup(stream), "t").count() == so.run(so.once(stream, ["user_id"]), "t").count() == 0
