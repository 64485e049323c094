"""Checks on canonical samples and their tool calls.

Checks add boolean or message columns and never drop rows; a sample is an ordered array of
messages.  Null messages count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles, sample types, statuses and reserved terms of the sample format (fixed values).
ROLES = ("system", "user", "assistant", "tool")
TYPES = ("policy_qa", "policy_application", "tool_selection", "trajectory", "clarification", "exception")
STATUSES = ("accepted", "rejected", "pending", "review_required")
RESERVED_TERMS = ("expected_actions", "reward_criteria", "golden_retrieval", "task_success", "grader_notes", "hidden_goal")
POLICY_WORDS = ("policy", "rule", "requirement", "must", "shall", "prohibited", "allowed")
#: Names of evaluator-only fields, matched anywhere in a key without case (fixed values).
PRIVATE_FIELDS = (
    "expected_action", "hidden_goal", "target_reward", "evaluator_state", "private_instructions?",
    "golden_doc", "reward_criteria", "success_condition", "grading_rubric", "expected_tool_calls?",
)


def schema_ok(messages: str = "messages") -> Column:
    """Non-empty, and every role known."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))), F.lit(False))


def schema_errors(messages: str = "messages", most: int = 3) -> Column:
    """The first ``most`` message errors, joined; null for none."""

    def error(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("message "), i.cast("string"))
        return (
            F.when(m["role"].isNull(), F.concat(at, F.lit(": no role")))
            .when(~m["role"].isin(*ROLES), F.concat(at, F.lit(": bad role")))
            .when(m["content"].isNull() & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) < 1), F.concat(at, F.lit(": no content")))
        )

    every = F.filter(F.transform(messages, error), lambda e: e.isNotNull())
    return F.when(F.size(every) > 0, F.array_join(F.slice(every, 1, most), "; "))


def order_ok(messages: str = "messages") -> Column:
    """Starts with system or user; a tool message follows an assistant with calls or a tool message."""
    m = F.col(messages)

    def fine(x: Column, i: Column) -> Column:
        before = F.get(m, i - 1)
        called = (before["role"] == "assistant") & (F.coalesce(F.size(before["tool_calls"]), F.lit(0)) > 0)
        return (x["role"] != "tool") | ((i > 0) & (called | (before["role"] == "tool")))

    rest = F.transform(m, lambda x, i: F.coalesce(fine(x, i), F.lit(False)))
    return F.coalesce(F.get(m, F.lit(0))["role"].isin("system", "user") & F.forall(rest, lambda x: x), F.lit(False))


def calls(samples: DataFrame) -> DataFrame:
    """One row per tool call: (sample_id, message, call, name, arguments)."""
    m = samples.select("sample_id", F.posexplode("messages").alias("message", "m"))
    c = m.select("sample_id", "message", F.posexplode("m.tool_calls").alias("call", "c"))
    return c.select("sample_id", "message", "call", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def tool_definitions(samples: DataFrame) -> DataFrame:
    """(name, parameters): one definition per tool, the smallest text where they differ; tools without a name are skipped."""
    t = samples.select(F.explode("tools").alias("t")).where("t.function.name IS NOT NULL")
    return t.groupBy(F.col("t.function.name").alias("name")).agg(F.min("t.function.parameters").alias("parameters"))


def calls_ok(samples: DataFrame) -> DataFrame:
    """(sample_id, ok): every call names a known tool and has arguments that parse as JSON; samples
    without calls pass."""
    known = tool_definitions(samples).select("name", F.lit(True).alias("known"))  # sort-merge or broadcast as the planner's sizes tell
    bad = calls(samples).join(known, "name", "left").where("known IS NULL OR try_parse_json(arguments) IS NULL").select("sample_id").distinct()
    return samples.select("sample_id").distinct().join(bad.withColumn("bad", F.lit(True)), "sample_id", "left").select("sample_id", F.col("bad").isNull().alias("ok"))


def grounded(samples: DataFrame, known_ids: DataFrame) -> DataFrame:
    """(sample_id, ok): at least one source document is known."""
    ids = samples.select("sample_id", F.explode("source_doc_ids").alias("id")).join(known_ids, "id", "left_semi").select("sample_id").distinct()
    return samples.select("sample_id").distinct().join(ids.withColumn("ok", F.lit(True)), "sample_id", "left").select("sample_id", F.coalesce("ok", F.lit(False)).alias("ok"))


def reserved(samples: DataFrame, ids: DataFrame, families: DataFrame) -> DataFrame:
    """Samples whose id, or non-empty family, is reserved for evaluation."""
    by_id = samples.join(ids.select("sample_id"), "sample_id", "left_semi")
    by_family = samples.where("scenario_family <> ''").join(families.select("scenario_family"), "scenario_family", "left_semi")
    return by_id.select("sample_id").union(by_family.select("sample_id")).distinct()


def reserved_terms(samples: DataFrame) -> DataFrame:
    """(sample_id, message, term): at most one term per message, the first of the list."""
    m = samples.select("sample_id", F.posexplode("messages").alias("message", "m"))
    low = F.lower("m.content")
    term = F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in RESERVED_TERMS])
    return m.select("sample_id", F.col("message").cast("long").alias("message"), term.alias("term")).where("term IS NOT NULL")


def content_key(messages: str = "messages", sep: str = " ") -> Column:
    """md5 of the non-empty contents, joined."""
    text = F.transform(F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != ""), lambda m: m["content"])
    return F.md5(F.array_join(text, sep))


def first_of(samples: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Every row with the id of the first row of its key: (.., key, first_id, duplicate).

    A hot key (a third of all rows) is not sorted in one task: the first row is an aggregate,
    joined back.
    """
    keyed = samples.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min_by("sample_id", F.struct(*order)).alias("first_id"), F.min(F.struct(*order)).alias("first_order"))
    return keyed.join(first, "key").withColumn("duplicate", F.struct(*order) != F.col("first_order")).drop("first_order")


def status(samples: DataFrame, known_ids: DataFrame) -> DataFrame:
    """(sample_id, verdict): the first failing check in order schema, order, tools, grounding,
    duplicate; else accepted.  The first sample of a content, in ingestion order, is kept."""
    one = samples
    dup = first_of(one, content_key(), ["ingested_at", "sample_id"]).select("sample_id", "duplicate")
    joined = (
        one.select("sample_id", schema_ok().alias("schema"), order_ok().alias("order"))
        .join(calls_ok(one).withColumnRenamed("ok", "tools_ok"), "sample_id")
        .join(grounded(one, known_ids).withColumnRenamed("ok", "grounded"), "sample_id")
        .join(dup, "sample_id")
    )
    verdict = (
        F.when(~F.col("schema"), "schema")
        .when(~F.col("order"), "order")
        .when(~F.col("tools_ok"), "tool_schema")
        .when(~F.col("grounded"), "grounding")
        .when(F.col("duplicate"), "duplicate")
        .otherwise("accepted")
    )
    return joined.select("sample_id", verdict.alias("verdict"))


def check_calls(samples: DataFrame) -> DataFrame:
    """(sample_id, message, call, known, missing, unknown, mistyped): every call against its tool's
    JSON schema; counts of required parameters that are missing, of arguments the schema does not
    name, and of arguments of another type.  JSON true is a boolean, never a number."""
    spark = samples.sparkSession
    shape = "struct<properties:map<string,struct<type:string>>,required:array<string>>"
    defs = tool_definitions(samples).select("name", F.from_json("parameters", shape).alias("schema"))
    joined = calls(samples).join(defs, "name", "left").withColumn("args", F.expr("try_parse_json(arguments)"))
    joined.createOrReplaceTempView("loomlake_calls")
    typed = spark.sql(
        """SELECT sample_id, message, call, count_if(schema.properties IS NOT NULL AND NOT array_contains(map_keys(schema.properties), key)) AS unknown,
             count_if(CASE schema.properties[key].type WHEN 'string' THEN kind <> 'STRING' WHEN 'integer' THEN kind <> 'BIGINT' WHEN 'boolean' THEN kind <> 'BOOLEAN' ELSE false END) AS mistyped,
             collect_set(key) AS given
           FROM (SELECT c.*, e.key, schema_of_variant(e.value) AS kind FROM loomlake_calls c, LATERAL variant_explode(c.args) AS e) GROUP BY sample_id, message, call"""
    )
    spark.catalog.dropTempView("loomlake_calls")
    all_calls = joined.select("sample_id", "message", "call", F.col("schema").isNotNull().alias("known"), F.coalesce("schema.required", F.array()).alias("required"))
    out = all_calls.join(typed, ["sample_id", "message", "call"], "left")
    missing = F.size(F.array_except("required", F.coalesce("given", F.array())))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "sample_id", F.col("message").cast("long").alias("message"), F.col("call").cast("long").alias("call"), "known", missing.cast("long").alias("missing"), zero("unknown"), zero("mistyped")
    )


def private_key(key: Column) -> Column:
    return key.rlike("(?i)" + "|".join(PRIVATE_FIELDS))


def strip_map(column: str) -> Column:
    """A map without private keys."""
    return F.map_filter(column, lambda k, _: ~private_key(k))


def strip_json(texts):
    """JSON texts without private keys at any depth; unparsable ones become null (pandas UDF body)."""
    import json
    import re

    import pandas as pd

    private = re.compile("|".join(PRIVATE_FIELDS), re.IGNORECASE)

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if not private.search(k)}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(text):
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return pd.Series([one(t) for t in texts], dtype="object")


def previous_roles(samples: DataFrame) -> DataFrame:
    """(sample_id, message, role, previous): each message with the role before it."""
    m = samples.select("sample_id", "ingested_at", F.posexplode("messages").alias("message", "m"))
    w = Window.partitionBy("sample_id", "ingested_at").orderBy("message")
    return m.select("sample_id", "ingested_at", F.col("message").cast("long").alias("message"), F.col("m.role").alias("role"), F.lag("m.role").over(w).alias("previous"))
