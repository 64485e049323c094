"""Queries over canonical samples: validation, deduplication, contamination, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import validation as v
from loomlake.operators.evaluation import latest
from loomlake.plans.registry import query
from loomlake.workspace import table

ONE = "WITH s AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC) = 1)"
ROLES = "('system', 'user', 'assistant', 'tool')"
SCHEMA_OK = f"coalesce(len(messages) > 0 AND list_bool_and([coalesce(m.role IN {ROLES}, false) FOR m IN messages]), false)"
ORDER_OK = """coalesce(messages[1].role IN ('system', 'user') AND list_bool_and([coalesce(messages[i].role <> 'tool' OR (i > 1 AND ((messages[i - 1].role = 'assistant' AND coalesce(len(messages[i - 1].tool_calls), 0) > 0)
 OR messages[i - 1].role = 'tool')), false) FOR i IN range(1, len(messages) + 1)]), false)"""
CALLS = """c AS (SELECT sample_id, message, unnest(range(0, len(tc))) AS call, unnest(tc) AS t FROM (SELECT sample_id, i AS message, messages[i + 1].tool_calls AS tc FROM (SELECT *, unnest(range(0, len(messages))) AS i FROM s)))
, calls AS (SELECT sample_id, message, call, t.function.name AS name, t.function.arguments AS arguments FROM c)
, defs AS (SELECT t.function.name AS name, min(t.function.parameters) AS parameters FROM (SELECT unnest(tools) AS t FROM s) WHERE t.function.name IS NOT NULL GROUP BY 1)"""
CALLS_OK = "bad AS (SELECT DISTINCT sample_id FROM calls LEFT JOIN defs USING (name) WHERE defs.name IS NULL OR arguments IS NULL OR NOT json_valid(arguments))"
GROUND = "g AS (SELECT DISTINCT sample_id FROM (SELECT sample_id, unnest(source_doc_ids) AS id FROM s) WHERE id IN (SELECT kb_id FROM documents))"
KEY = "md5(array_to_string([m.content FOR m IN messages IF coalesce(m.content, '') <> ''], ' '))"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "samples"), ["sample_id"], "ingested_at")


def kb_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("kb_id").alias("id")).where("id IS NOT NULL").distinct()


@query(f"{ONE} SELECT sample_id, {SCHEMA_OK} AS ok FROM s")
def schema_check(spark, d):
    return rows(spark, d).select("sample_id", v.schema_ok().alias("ok"))


@query(f"""{ONE}, e AS (SELECT sample_id, [CASE WHEN messages[i + 1].role IS NULL THEN 'message ' || i || ': no role' WHEN messages[i + 1].role NOT IN {ROLES} THEN 'message ' || i || ': bad role'
 WHEN messages[i + 1].content IS NULL AND coalesce(len(messages[i + 1].tool_calls), 0) < 1 THEN 'message ' || i || ': no content' END FOR i IN range(0, len(messages))] AS e FROM s),
 f AS (SELECT sample_id, [x FOR x IN e IF x IS NOT NULL] AS e FROM e) SELECT sample_id, CASE WHEN len(e) > 0 THEN array_to_string(e[1:3], '; ') END AS errors FROM f""")
def schema_check_raw(spark, d):
    return rows(spark, d).select("sample_id", v.schema_errors().alias("errors"))


@query(f"{ONE} SELECT sample_id, {ORDER_OK} AS ok FROM s")
def turn_order_check(spark, d):
    return rows(spark, d).select("sample_id", v.order_ok().alias("ok"))


@query("SELECT sample_id, ingested_at, i AS message, messages[i + 1].role AS role, CASE WHEN i > 0 THEN messages[i].role END AS previous FROM (SELECT *, unnest(range(0, len(messages))) AS i FROM samples)")
def previous_role(spark, d):
    return v.previous_roles(table(spark, d, "samples"))


@query(f"{ONE}, {CALLS}, {CALLS_OK} SELECT sample_id, sample_id NOT IN (SELECT sample_id FROM bad) AS ok FROM s")
def tool_schema_check(spark, d):
    return v.calls_ok(rows(spark, d))


@query(f"{ONE}, {GROUND} SELECT sample_id, sample_id IN (SELECT sample_id FROM g) AS ok FROM s")
def grounding_check(spark, d):
    return v.grounded(rows(spark, d), kb_ids(spark, d))


@query("SELECT count(*) FILTER (coalesce(len(source_doc_ids), 0) > 0) AS passed, count(*) FILTER (coalesce(len(source_doc_ids), 0) = 0) AS failed FROM samples")
def grounding_count(spark, d):
    n = F.coalesce(F.size("source_doc_ids"), F.lit(0))
    return table(spark, d, "samples").agg(F.count_if(n > 0).alias("passed"), F.count_if(n <= 0).alias("failed"))


HELD = "held AS (SELECT DISTINCT sample_id FROM split_rows WHERE lower(trim(split_name)) = 'holdout')"


@query(f"""{ONE}, {HELD}, fam AS (SELECT DISTINCT scenario_family FROM provenance WHERE rejection_reason = 'grounding' AND scenario_family <> '')
 SELECT sample_id FROM s WHERE sample_id IN (SELECT sample_id FROM held) OR (scenario_family <> '' AND scenario_family IN (SELECT scenario_family FROM fam))""")
def contamination_id_check(spark, d):
    held = table(spark, d, "split_rows").where("lower(trim(split_name)) = 'holdout'")
    families = table(spark, d, "provenance").where("rejection_reason = 'grounding' AND scenario_family <> ''").select("scenario_family").distinct()
    return v.reserved(rows(spark, d), held, families)


@query("""SELECT sample_id, i AS message, CASE WHEN contains(c, 'expected_actions') THEN 'expected_actions' WHEN contains(c, 'reward_criteria') THEN 'reward_criteria' WHEN contains(c, 'golden_retrieval') THEN 'golden_retrieval'
 WHEN contains(c, 'task_success') THEN 'task_success' WHEN contains(c, 'grader_notes') THEN 'grader_notes' WHEN contains(c, 'hidden_goal') THEN 'hidden_goal' END AS term
 FROM (SELECT sample_id, i, lower(messages[i + 1].content) AS c FROM (SELECT *, unnest(range(0, len(messages))) AS i FROM samples)) WHERE term IS NOT NULL""")
def contamination_term_check(spark, d):
    return v.reserved_terms(table(spark, d, "samples"))


FIRST = f"k AS (SELECT sample_id, ingested_at, {KEY} AS key FROM s), first AS (SELECT *, first_value(sample_id) OVER w AS first_id, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY key ORDER BY ingested_at, sample_id))"


@query(f"""{ONE}, {CALLS}, {CALLS_OK}, {GROUND}, {FIRST} SELECT s.sample_id, CASE WHEN NOT {SCHEMA_OK} THEN 'schema' WHEN NOT {ORDER_OK} THEN 'order' WHEN s.sample_id IN (SELECT sample_id FROM bad) THEN 'tool_schema'
 WHEN s.sample_id NOT IN (SELECT sample_id FROM g) THEN 'grounding' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM s JOIN first ON first.sample_id = s.sample_id""")
def validate_status(spark, d):
    return v.status(rows(spark, d), kb_ids(spark, d))


@query(f"{ONE}, {FIRST} SELECT sample_id, first_id, n > 1 AS duplicate FROM first")
def exact_dedup_first(spark, d):
    return v.first_of(rows(spark, d), v.content_key(), ["ingested_at", "sample_id"]).select("sample_id", "first_id", "duplicate")


@query(f"{ONE} SELECT sample_id, {KEY} AS hash FROM s")
def content_hash_text(spark, d):
    return rows(spark, d).select("sample_id", v.content_key().alias("hash"))


@query(f"""{ONE} SELECT count(*) AS samples, count(DISTINCT [(m.role, m.content) FOR m IN messages]) AS different FROM s""")
def content_hash_model(spark, d):
    key = F.sha2(F.to_json(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))), 256)
    return rows(spark, d).select(key.alias("k")).agg(F.count("*").alias("samples"), F.count_distinct("k").alias("different"))


@query(f"""{ONE} SELECT sample_id, sha256(array_to_string([coalesce(m.role, '~') || ':' || coalesce(m.content, '~') FOR m IN messages], '|')) AS hash FROM s""")
def content_hash_raw(spark, d):
    part = F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("~")), F.lit(":"), F.coalesce(m["content"], F.lit("~"))))
    return rows(spark, d).select("sample_id", F.sha2(F.array_join(part, "|"), 256).alias("hash"))


@query("""SELECT sample_id, sample_type FROM (SELECT sample_id, sample_type, ingested_at FROM samples ORDER BY sample_id, ingested_at LIMIT 200) WHERE sample_type IN ('policy_qa', 'trajectory')""")
def filter_types(spark, d):
    """The types are filtered after the limit, as in a smoke run."""
    cut = table(spark, d, "samples").select("sample_id", "sample_type", "ingested_at").orderBy("sample_id", "ingested_at").limit(200)
    return cut.where(F.col("sample_type").isin("policy_qa", "trajectory")).select("sample_id", "sample_type")


@query("""SELECT run_id, task_id, trial, saved_at, array_to_string(list_sort([k FOR k IN ['Expected_Actions_list', 'golden_doc_ids', 'task', 'turns', 'x_hidden_goal'] IF NOT regexp_matches(k,
 '(?i)expected_action|hidden_goal|target_reward|evaluator_state|private_instructions?|golden_doc|reward_criteria|success_condition|grading_rubric|expected_tool_calls?')]), ',') AS kept FROM task_results""")
def private_field_strip(spark, d):
    fields = F.create_map(
        F.lit("Expected_Actions_list"), F.array_join("expected_actions", ","), F.lit("golden_doc_ids"), F.lit(""), F.lit("task"), F.col("task_id"), F.lit("turns"), F.col("turns").cast("string"), F.lit("x_hidden_goal"), F.lit("")
    )
    kept = F.array_join(F.array_sort(F.map_keys(v.strip_map("m"))), ",")
    return table(spark, d, "task_results").withColumn("m", fields).select("run_id", "task_id", "trial", "saved_at", kept.alias("kept"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def private_field_strip_json(spark, d):
    from pyspark.sql.functions import pandas_udf

    clean = pandas_udf(v.strip_json, "string")
    with_private = F.concat(F.lit('{"a": [{"hidden_goal": 1, "in": '), "props", F.lit('}], "grading_rubric": {}}'))
    return table(spark, d, "events").select("event_id", F.get_json_object(clean(with_private), "$.a[0].in.k").cast("long").alias("k"))


@query(f"""{ONE}, {CALLS}, a AS (SELECT calls.*, defs.parameters AS p, defs.name IS NOT NULL AS known FROM calls LEFT JOIN defs ON defs.name = calls.name),
 x AS (SELECT sample_id, message, call, known, p, arguments, CASE WHEN json_valid(arguments) AND json_type(arguments) = 'OBJECT' THEN json_keys(arguments) ELSE [] END AS given,
  coalesce(CAST(json_extract(p, '$.required') AS VARCHAR[]), []) AS required FROM a)
 SELECT sample_id, message, call, known, len([r FOR r IN required IF NOT list_contains(given, r)]) AS missing, len([k FOR k IN given IF known AND json_extract(p, '$.properties') IS NOT NULL AND json_extract(p, '$.properties.' || k) IS NULL]) AS unknown,
  len([k FOR k IN given IF known AND CASE json_extract_string(p, '$.properties.' || k || '.type') WHEN 'string' THEN json_type(arguments, '$.' || k) <> 'VARCHAR' WHEN 'integer' THEN json_type(arguments, '$.' || k) NOT IN ('BIGINT', 'UBIGINT')
   WHEN 'boolean' THEN json_type(arguments, '$.' || k) <> 'BOOLEAN' ELSE false END]) AS mistyped FROM x""")
def tool_call_validate(spark, d):
    return v.check_calls(rows(spark, d))


@query(f"{ONE}, {CALLS} SELECT calls.sample_id, message, call, calls.name, len(names) > 0 AND NOT list_contains(names, calls.name) AS blocked FROM calls JOIN (SELECT sample_id, [t.function.name FOR t IN coalesce(tools, [])] AS names FROM s) n ON n.sample_id = calls.sample_id")
def policy_block(spark, d):
    one = rows(spark, d)
    allow = one.select("sample_id", F.coalesce(F.transform("tools", lambda t: t["function"]["name"]), F.array()).alias("names"))
    blocked = (F.size("names") > 0) & ~F.coalesce(F.array_contains("names", F.col("name")), F.lit(False))
    return v.calls(one).join(allow, "sample_id").select("sample_id", F.col("message").cast("long").alias("message"), F.col("call").cast("long").alias("call"), "name", blocked.alias("blocked"))


@query("SELECT event_id, array_to_string([k FOR k IN ['k', 'v'] IF NOT list_contains(json_keys(props), k)], ',') AS missing FROM events")
def required_keys(spark, d):
    lack = F.array_except(F.array(F.lit("k"), F.lit("v")), F.json_object_keys("props"))
    return table(spark, d, "events").select("event_id", F.array_join(lack, ",").alias("missing"))


@query(f"{ONE} SELECT DISTINCT t.function.name AS name FROM (SELECT unnest(tools) AS t FROM s) WHERE t.function.name IS NOT NULL")
def tool_names(spark, d):
    return v.tool_definitions(rows(spark, d)).select("name")


@query(f"{ONE} SELECT sample_id, t.function.name AS name, json_extract_string(t.function.parameters, '$.type') AS kind FROM (SELECT sample_id, unnest(tools) AS t FROM s) WHERE t.function.name IS NOT NULL")
def tool_definition_parse(spark, d):
    t = rows(spark, d).select("sample_id", F.explode("tools").alias("t")).where("t.function.name IS NOT NULL")
    return t.select("sample_id", F.col("t.function.name").alias("name"), F.get_json_object("t.function.parameters", "$.type").alias("kind"))


LAST = "SELECT sample_id, {agg}(m.content, i) AS content FROM (SELECT sample_id, unnest(range(0, len(messages))) AS i, unnest(messages) AS m FROM s) WHERE m.role = 'user' AND m.content <> '' GROUP BY 1"


def _user(spark, d):
    m = rows(spark, d).select("sample_id", F.posexplode("messages").alias("i", "m"))
    return m.where("m.role = 'user' AND m.content <> ''")


@query(f"{ONE} {LAST.format(agg='arg_max')}")
def last_user_message(spark, d):
    return _user(spark, d).groupBy("sample_id").agg(F.max_by("m.content", "i").alias("content"))


@query(f"{ONE} {LAST.format(agg='arg_min')}")
def first_user_message(spark, d):
    return _user(spark, d).groupBy("sample_id").agg(F.min_by("m.content", "i").alias("content"))


@query(f"{ONE}, f AS ({LAST.format(agg='arg_min')}) SELECT sample_id, content, scenario_family AS family FROM f JOIN s USING (sample_id)")
def index_examples(spark, d):
    first = _user(spark, d).groupBy("sample_id").agg(F.min_by("m.content", "i").alias("content"))
    meta = rows(spark, d).select("sample_id", F.to_json(F.struct("sample_id", "scenario_family", "sample_type")).alias("example"))
    return first.join(meta, "sample_id").select("sample_id", "content", F.get_json_object("example", "$.scenario_family").alias("family"))


@query("""SELECT item_id, 'kf-' || task_id || '-' || substr(md5(question || answer), 1, 8) AS sample_id, regexp_replace(item_id, '-[^-]*$', '') AS family FROM eval_items WHERE question <> '' AND answer <> ''""")
def qa_convert(spark, d):
    i = table(spark, d, "eval_items").where("question <> '' AND answer <> ''")
    made = F.concat(F.lit("kf-"), "task_id", F.lit("-"), F.substring(F.md5(F.concat("question", "answer")), 1, 8))
    return i.select("item_id", made.alias("sample_id"), F.regexp_replace("item_id", "-[^-]*$", "").alias("family"))


@query(f"""{ONE} SELECT sample_id, len(messages) + CASE WHEN len(source_doc_ids) > 0 THEN 1 ELSE 0 END AS messages, CASE WHEN len(source_doc_ids) > 0 THEN coalesce(array_to_string(source_doc_ids, chr(10) || chr(10)), '') ELSE messages[1].content END AS head FROM s""")
def matched_context(spark, d):
    """A system message with the retrieved documents is put before the messages, if there are any."""
    some = F.coalesce(F.size("source_doc_ids"), F.lit(0)) > 0
    short = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    system = F.array(F.struct(F.lit("system").alias("role"), F.array_join("source_doc_ids", "\n\n").alias("content")))
    made = F.when(some, F.concat(system, short)).otherwise(short)
    return rows(spark, d).withColumn("made", made).select("sample_id", F.size("made").cast("long").alias("messages"), F.get("made", F.lit(0))["content"].alias("head"))


@query("""SELECT run_id, task_id, trial, saved_at, array_to_string([substr('ABCDEFGH', i, 1) || '. ' || actions[i] FOR i IN range(1, least(len(actions), 8) + 1)], chr(10)) AS prompt FROM task_results""")
def format_choices(spark, d):
    labels = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    few = F.least(F.size("actions"), F.lit(8))
    lines = F.zip_with(F.slice(labels, F.lit(1), few), F.slice("actions", F.lit(1), few), lambda a, t: F.concat(a, F.lit(". "), t))
    return table(spark, d, "task_results").select("run_id", "task_id", "trial", "saved_at", F.array_join(lines, "\n").alias("prompt"))


@query("""SELECT coalesce(sample_type, 'unknown') AS sample_type, count(*) AS n FROM samples GROUP BY 1""")
def type_distribution(spark, d):
    return table(spark, d, "samples").groupBy(F.coalesce("sample_type", F.lit("unknown")).alias("sample_type")).agg(F.count("*").alias("n"))


TYPES = "kinds AS (SELECT unnest(['policy_qa', 'policy_application', 'tool_selection', 'trajectory', 'clarification', 'exception']) AS sample_type)"


@query(f"""{ONE}, {TYPES} SELECT k.sample_type, count(sample_id) AS generated, count(*) FILTER (validation_status = 'accepted') AS accepted, count(*) FILTER (validation_status = 'rejected') AS rejected,
 round(count(*) FILTER (validation_status = 'accepted') / greatest(count(sample_id), 1), 6) AS rate FROM kinds k LEFT JOIN s ON s.sample_type = k.sample_type GROUP BY 1""")
def quality_report(spark, d):
    kinds = spark.createDataFrame([(t,) for t in v.TYPES], "sample_type string")
    n = rows(spark, d).groupBy("sample_type").agg(
        F.count("*").alias("g"), F.count_if(F.col("validation_status") == "accepted").alias("a"), F.count_if(F.col("validation_status") == "rejected").alias("r")
    )
    z = lambda c: F.coalesce(c, F.lit(0))
    return kinds.join(n, "sample_type", "left").select(
        "sample_type", z("g").alias("generated"), z("a").alias("accepted"), z("r").alias("rejected"), F.round(z("a") / F.greatest(z("g"), F.lit(1)), 6).alias("rate")
    )


SPLIT = "sp AS (SELECT sample_id, min(lower(trim(split_name))) AS split FROM split_rows GROUP BY 1)"


def split_one(spark, d):
    return table(spark, d, "split_rows").groupBy("sample_id").agg(F.min(F.lower(F.trim("split_name"))).alias("split"))


@query(f"{ONE}, {SPLIT} SELECT split, coalesce(sample_type, 'unknown') AS sample_type, count(*) AS accepted FROM s JOIN sp USING (sample_id) WHERE validation_status = 'accepted' AND split IN ('train', 'validation') GROUP BY 1, 2")
def quality_report_bundle(spark, d):
    kept = rows(spark, d).where("validation_status = 'accepted'").join(split_one(spark, d).where("split IN ('train', 'validation')"), "sample_id")
    return kept.groupBy("split", F.coalesce("sample_type", F.lit("unknown")).alias("sample_type")).agg(F.count("*").alias("accepted"))


@query(f"""{ONE}, {TYPES}, n AS (SELECT sample_type, count(*) AS n FROM s GROUP BY 1), a AS (SELECT count(*) FILTER (validation_status = 'accepted') / greatest(count(*), 1) AS rate FROM s)
 SELECT 'type ' || k.sample_type AS gate, CASE WHEN n.n > 0 THEN 'ok' ELSE 'error' END AS severity FROM kinds k LEFT JOIN n ON n.sample_type = k.sample_type
 UNION ALL SELECT 'tool examples', CASE WHEN coalesce((SELECT n FROM n WHERE sample_type = 'tool_selection'), 0) >= 50 THEN 'ok' ELSE 'warning' END
 UNION ALL SELECT 'acceptance', CASE WHEN rate >= 0.7e0 THEN 'ok' ELSE 'error' END FROM a""")
def quality_gates(spark, d):
    one = rows(spark, d)
    n = one.groupBy("sample_type").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(t,) for t in v.TYPES], "sample_type string")
    types = kinds.join(n, "sample_type", "left").select(F.concat(F.lit("type "), "sample_type").alias("gate"), F.when(F.col("n") > 0, "ok").otherwise("error").alias("severity"))
    tools = one.agg(F.when(F.count_if(F.col("sample_type") == "tool_selection") >= 50, "ok").otherwise("warning").alias("severity")).select(F.lit("tool examples").alias("gate"), "severity")
    rate = F.count_if(F.col("validation_status") == "accepted") / F.greatest(F.count("*"), F.lit(1))
    return types.union(tools).union(one.agg(F.when(rate >= 0.7, "ok").otherwise("error").alias("severity")).select(F.lit("acceptance"), "severity"))


@query("SELECT count(*) FILTER (validation_outcome = 'accepted') AS accepted, count(*) AS total, round(100e0 * count(*) FILTER (validation_outcome = 'accepted') / greatest(count(*), 1), 6) AS percent FROM provenance")
def batch_acceptance(spark, d):
    a = F.count_if(F.col("validation_outcome") == "accepted")
    return table(spark, d, "provenance").agg(a.alias("accepted"), F.count("*").alias("total"), F.round(100.0 * a / F.greatest(F.count("*"), F.lit(1)), 6).alias("percent"))


@query(f"{ONE}, p AS (SELECT sample_id, min(rejection_reason) AS reason FROM provenance WHERE validation_outcome = 'rejected' GROUP BY 1) SELECT coalesce(sample_type, 'unknown') AS sample_type, coalesce(reason, 'unstated') AS reason, count(*) AS n FROM s JOIN p USING (sample_id) GROUP BY 1, 2")
def rejection_reasons(spark, d):
    p = table(spark, d, "provenance").where("validation_outcome = 'rejected'").groupBy("sample_id").agg(F.min("rejection_reason").alias("reason"))
    j = rows(spark, d).join(p, "sample_id")
    return j.groupBy(F.coalesce("sample_type", F.lit("unknown")).alias("sample_type"), F.coalesce("reason", F.lit("unstated")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT scenario_family, count(DISTINCT sample_id) AS size, count(*) - count(DISTINCT sample_id) AS duplicates FROM samples GROUP BY 1""")
def family_sizes(spark, d):
    return table(spark, d, "samples").groupBy("scenario_family").agg(F.count_distinct("sample_id").alias("size"), (F.count("*") - F.count_distinct("sample_id")).alias("duplicates"))


@query("""WITH t AS (SELECT len(messages) AS turns, list_sum([coalesce(length(m.content), 0) FOR m IN messages]) AS chars, list_bool_or([coalesce(len(m.tool_calls), 0) > 0 FOR m IN messages]) AS tools FROM samples)
 SELECT round(avg(turns), 6) AS mean_turns, min(turns) AS min_turns, max(turns) AS max_turns, (SELECT turns FROM (SELECT turns, row_number() OVER (ORDER BY turns) AS n FROM t) WHERE n = (SELECT count(*) // 2 + 1 FROM t)) AS upper_median_turns,
 round(avg(chars), 6) AS mean_chars, round(avg(chars / 3.5e0), 4) AS mean_tokens, round(count(*) FILTER (tools) / count(*), 6) AS tool_share FROM t""")
def eda_summary(spark, d):
    s = table(spark, d, "samples").select(
        F.size("messages").cast("long").alias("turns"),
        F.aggregate(F.transform("messages", lambda m: F.coalesce(F.length(m["content"]), F.lit(0))), F.lit(0), lambda a, x: a + x).cast("long").alias("chars"),
        F.exists("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0).alias("tools"),
    )
    # upper median from a histogram of the few different turn counts instead of a sort of all rows
    spread = s.groupBy("turns").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    run = spread.withColumn("upto", F.sum("n").over(Window.orderBy("turns"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    median = run.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).agg(F.min("turns").alias("upper_median_turns"))
    rest = s.agg(
        F.round(F.avg("turns"), 6).alias("mean_turns"), F.min("turns").alias("min_turns"), F.max("turns").alias("max_turns"), F.round(F.avg("chars"), 6).alias("mean_chars"),
        F.round(F.avg(F.col("chars") / 3.5), 4).alias("mean_tokens"), F.round(F.count_if("tools") / F.count("*"), 6).alias("tool_share"),
    )
    return rest.crossJoin(median)  # two single rows


@query("SELECT role, count(*) AS n FROM (SELECT unnest(messages).role AS role FROM samples) GROUP BY 1")
def role_histogram(spark, d):
    return table(spark, d, "samples").select(F.explode("messages").alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n"))


@query("SELECT len(messages) // 3 AS bin, count(*) AS n FROM samples WHERE messages IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return table(spark, d, "samples").where("messages IS NOT NULL").groupBy(F.floor(F.size("messages") / 3).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT scenario_family, count(*) AS n FROM samples WHERE scenario_family <> '' GROUP BY 1 ORDER BY n DESC, scenario_family LIMIT 10")
def most_common(spark, d):
    return table(spark, d, "samples").where("scenario_family <> ''").groupBy("scenario_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scenario_family").limit(10)


@query("SELECT sample_id FROM samples GROUP BY sample_id ORDER BY sample_id LIMIT 100")
def limit_prefix(spark, d):
    return table(spark, d, "samples").select("sample_id").distinct().orderBy("sample_id").limit(100)


@query("SELECT DISTINCT sample_id, md5('42' || sample_id) AS draw FROM samples ORDER BY draw, sample_id LIMIT 100")
def sample_seeded(spark, d):
    """The first hundred samples in the order of a seeded hash."""
    return table(spark, d, "samples").select("sample_id", F.md5(F.concat(F.lit("42"), "sample_id")).alias("draw")).distinct().orderBy("draw", "sample_id").limit(100)


@query("SELECT item_id, md5('7' || item_id) AS draw FROM eval_items ORDER BY draw, item_id LIMIT 50")
def scan_arc(spark, d):
    """Benchmark questions: seeded shuffle, then a number of them."""
    return table(spark, d, "eval_items").select("item_id", F.md5(F.concat(F.lit("7"), "item_id")).alias("draw")).orderBy("draw", "item_id").limit(50)


@query("SELECT sample_type, min(sample_id) AS sample_id FROM samples WHERE sample_type IS NOT NULL GROUP BY 1")
def one_per_type(spark, d):
    return table(spark, d, "samples").where("sample_type IS NOT NULL").groupBy("sample_type").agg(F.min("sample_id").alias("sample_id"))


@query(f"{ONE}, have AS (SELECT sample_type, count(*) AS n FROM s WHERE validation_status = 'accepted' GROUP BY 1), want AS (SELECT sample_type, max(min_rows + draw_percent * 5) AS target FROM sample_plan GROUP BY 1) SELECT want.sample_type, target - coalesce(n, 0) AS remaining FROM want LEFT JOIN have USING (sample_type) WHERE target - coalesce(n, 0) > 0")
def type_satisfied_join(spark, d):
    have = rows(spark, d).where("validation_status = 'accepted'").groupBy("sample_type").agg(F.count("*").alias("n"))
    want = table(spark, d, "sample_plan").groupBy("sample_type").agg(F.max(F.col("min_rows") + F.col("draw_percent") * 5).alias("target"))
    left = want.join(have, "sample_type", "left").select("sample_type", (F.col("target") - F.coalesce("n", F.lit(0))).alias("remaining"))
    return left.where("remaining > 0")


@query("SELECT generator_id, generator_model, count(*) AS n, generator_model IS NOT NULL AND generator_model = 'teacher-a' AND count(*) > 0 AS compatible FROM provenance GROUP BY 1, 2")
def manifest_compat(spark, d):
    same = F.coalesce(F.col("generator_model") == "teacher-a", F.lit(False))
    return table(spark, d, "provenance").groupBy("generator_id", "generator_model").agg(F.count("*").alias("n")).select("generator_id", "generator_model", "n", (same & (F.col("n") > 0)).alias("compatible"))


@query(f"""{ONE}, c AS (SELECT sample_id, list_filter([CASE WHEN len(m.tool_calls) > 0 THEN m.tool_calls[1] END FOR m IN messages], lambda x: x IS NOT NULL)[1] AS t FROM s)
 SELECT sample_id, t.function.name AS name, CASE WHEN json_valid(t.function.arguments) THEN json_extract_string(t.function.arguments, '$.account') END AS account FROM c""")
def first_tool_call(spark, d):
    """The first call of a conversation; arguments that do not parse count as none."""
    called = F.filter("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)
    t = F.get(F.get(called, F.lit(0))["tool_calls"], F.lit(0))["function"]
    good = F.expr("try_parse_json(t.arguments) IS NOT NULL")
    return rows(spark, d).select("sample_id", t.alias("t")).select("sample_id", F.col("t.name").alias("name"), F.when(good, F.get_json_object("t.arguments", "$.account")).alias("account"))


@query(f"{ONE} SELECT '# Bundle' || chr(10) || '- samples: ' || count(*) || chr(10) || '- types: ' || count(DISTINCT sample_type) AS card FROM s")
def render_card_md(spark, d):
    n = rows(spark, d).agg(F.count("*").alias("n"), F.count_distinct("sample_type").alias("k"))
    return n.select(F.concat(F.lit("# Bundle\n- samples: "), F.col("n").cast("string"), F.lit("\n- types: "), F.col("k").cast("string")).alias("card"))
