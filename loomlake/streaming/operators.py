"""Structured Streaming: roll-ups, session windows, duplicate guards and session budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlake.sources.sinks import folder


def events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream; ``ts`` becomes a zoned timestamp, which watermarks need."""
    shape = spark.read.parquet(path).schema
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and give the result as a table.

    Append mode writes each row once, when the watermark has passed it, and its state is dropped;
    update mode writes the rows that a batch changed, with the batch's number.
    """
    spark = stream.sparkSession
    out, log = folder(spark, name), folder(spark, f"{name}-log")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out))
    query = writer.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def rollup(stream: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and value by tumbling or sliding window and type, with a watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        stream.withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("begin"), "n")
    )


def once(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of a key inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: What a session's budget keeps between batches.
STATE = "turns long, calls long, begin double, reason string"


def budget(stream: DataFrame, turns: int = 20, calls: int = 15, seconds: float = 300.0, call: str = "event_type = 'tool'", late: str = "1 hour", idle: float = 3600.0) -> DataFrame:
    """(user_id, turns, calls, reason): a session's turns and tool calls up to its stop, and the limit
    that stopped it: turns are tested before calls, calls before the time since its first event.

    A stopped session ignores what comes after, over all batches.  Events count in time order
    inside a batch: of each session only the earliest ``turns`` events of a batch can matter and are
    held.  State goes when the watermark passes the session's last event by ``idle`` seconds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, called, begin, reason = state.get if state.exists else (0, 0, None, None)
        first, last = None, 0.0
        for rows in batches:
            last = max(last, rows["at"].max())
            if reason is None:
                first = (rows if first is None else pd.concat([first, rows])).nsmallest(turns, ["at", "event_id"])
        for at, called_now in zip(first["at"], first["called"], strict=True) if first is not None else ():
            begin = at if begin is None else begin
            seen, called = seen + 1, called + int(called_now)
            reason = "turns" if seen >= turns else "tool_calls" if called >= calls else "wall_time" if at - begin > seconds else None
            if reason:
                break
        state.update((seen, called, begin, reason))
        state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "turns": [seen], "calls": [called], "reason": [reason]})

    marked = stream.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").cast("double").alias("micros"), F.expr(call).alias("called"))
    marked = marked.select("user_id", "event_id", "ts", (F.col("micros") / 1e6).alias("at"), "called")
    return marked.groupBy("user_id").applyInPandasWithState(step, "user_id long, turns long, calls long, reason string", STATE, "update", GroupStateTimeout.EventTimeTimeout)
