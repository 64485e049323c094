"""Queries over bundles, splits, fingerprints, logs and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import bundles as bd
from loomlake.operators import integrity as it
from loomlake.operators.evaluation import latest
from loomlake.plans.registry import query
from loomlake.plans.samples import ONE, SPLIT, rows, split_one
from loomlake.sources import sinks
from loomlake.workspace import table

FP = "substr(sha256(task_id || '|' || trial || '|' || run_id), 1, 24)"


@query(f"SELECT run_id, task_id, trial, saved_at, {FP} AS fingerprint FROM task_results")
def fingerprint_task(spark, d):
    return table(spark, d, "task_results").select("run_id", "task_id", "trial", "saved_at", tx.fingerprint("task_id", "trial", "run_id").alias("fingerprint"))


@query("SELECT DISTINCT run_id, substr(sha256('episodes:' || run_id || ':' || 'm'), 1, 24) AS fingerprint FROM task_results")
def fingerprint_run(spark, d):
    return table(spark, d, "task_results").select("run_id").distinct().select("run_id", tx.fingerprint(F.lit("episodes"), "run_id", F.lit("m"), sep=":").alias("fingerprint"))


@query("""SELECT event_id, substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 24) AS fingerprint FROM events""")
def fingerprint_record(spark, d):
    record = F.to_json(F.struct("event_type", "user_id"))  # fields in name order
    return table(spark, d, "events").select("event_id", F.substring(F.sha2(record, 256), 1, 24).alias("fingerprint"))


@query(f"SELECT DISTINCT {FP} AS fingerprint FROM task_results WHERE success")
def fingerprint_set(spark, d):
    return table(spark, d, "task_results").where("success").select(tx.fingerprint("task_id", "trial", "run_id").alias("fingerprint")).distinct()


@query(f"SELECT run_id, task_id, trial FROM (SELECT DISTINCT run_id, task_id, trial, {FP} AS fp FROM task_results) WHERE fp NOT IN (SELECT {FP} FROM task_results WHERE success)")
def upload_anti_join(spark, d):
    fp = tx.fingerprint("task_id", "trial", "run_id").alias("fp")
    t = table(spark, d, "task_results")
    return t.select("run_id", "task_id", "trial", fp).distinct().join(t.where("success").select(fp).distinct(), "fp", "left_anti").drop("fp")


LOG = f"lg AS (SELECT {FP} AS fingerprint, CASE WHEN success THEN run_id END AS upload_id FROM task_results)"


@query(f"WITH {LOG} SELECT fingerprint, max(upload_id) IS NOT NULL AS uploaded FROM lg GROUP BY 1")
def latest_upload_state(spark, d):
    log = table(spark, d, "task_results").select(tx.fingerprint("task_id", "trial", "run_id").alias("fingerprint"), F.when(F.col("success"), F.col("run_id")).alias("upload_id"))
    return it.upload_state(log)


@query(f"WITH {LOG}, p AS (SELECT fingerprint FROM lg GROUP BY 1 HAVING max(upload_id) IS NULL) SELECT fingerprint, 2 * count(*) AS rows_after FROM lg WHERE fingerprint IN (SELECT fingerprint FROM p) GROUP BY 1")
def reupload_pending(spark, d):
    """Logging a pending record again appends rows with the same fingerprint."""
    log = table(spark, d, "task_results").select(tx.fingerprint("task_id", "trial", "run_id").alias("fingerprint"), F.when(F.col("success"), F.col("run_id")).alias("upload_id"))
    pending = it.upload_state(log).where("NOT uploaded").select("fingerprint")
    again = log.join(pending, "fingerprint", "left_semi")
    return again.union(again).groupBy("fingerprint").agg(F.count("*").alias("rows_after"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS duplicate FROM events")
def duplicate_mutation(spark, d):
    return it.duplicate_actions(table(spark, d, "events"), "user_id", "event_type", "props", ["ts", "event_id"]).select("event_id", "duplicate")


SPENT = "b AS (SELECT sample_type, count(*) AS cost FROM samples WHERE sample_type IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY sample_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)"


@query(f"WITH {SPENT} SELECT sample_type, cost, CAST(before AS BIGINT) AS spent_before FROM r WHERE before < 500")
def budget_spend(spark, d):
    batches = table(spark, d, "samples").where("sample_type IS NOT NULL").groupBy("sample_type").agg(F.count("*").alias("cost"))
    return it.budget_spend(batches, "sample_type", "cost", 500)


@query("""WITH h AS (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL), l AS (SELECT h, count(*) AS n FROM h GROUP BY 1),
 p AS (SELECT substr(h, 1, 2) AS b, substr(h, 3, 1) AS c, sha256(array_to_string(list(h || ':' || n ORDER BY h || ':' || n), '')) AS p FROM l GROUP BY 1, 2) SELECT substr(sha256(array_to_string(list(p ORDER BY b, c), '')), 1, 16) AS corpus_hash FROM p""")
def corpus_hash(spark, d):
    return it.corpus_hash(table(spark, d, "documents"))


@query("""WITH h AS (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL), l AS (SELECT h, count(*) AS n FROM h GROUP BY 1),
 p AS (SELECT substr(h, 1, 2) AS b, substr(h, 3, 1) AS c, sha256(array_to_string(list(h || ':' || n ORDER BY h || ':' || n), '')) AS p FROM l GROUP BY 1, 2) SELECT substr(sha256(array_to_string(list(p ORDER BY b, c), '')), 1, 16) AS corpus_hash, 'main' AS embedding_revision, '1' AS chunking_version FROM p""")
def index_fingerprint(spark, d):
    return it.corpus_hash(table(spark, d, "documents")).withColumn("embedding_revision", F.lit("main")).withColumn("chunking_version", F.lit("1"))


def _split_sql(missing: str | None, least: int) -> str:
    other = f"'{missing}'" if missing else "'~' || sample_id"
    return f"""WITH f AS (SELECT sample_id, min(CASE WHEN trim(coalesce(scenario_family, ''), ' ') <> '' THEN lower(trim(scenario_family, ' ')) ELSE {other} END) AS family FROM samples GROUP BY 1),
 k AS (SELECT family, single, row_number() OVER (PARTITION BY single ORDER BY md5('13' || family), family) AS r, count(*) OVER (PARTITION BY single) AS n FROM (SELECT DISTINCT family, starts_with(family, '~') AS single FROM f))
 SELECT sample_id, f.family, CASE WHEN r <= greatest({least}, floor(n * 0.85e0 + 1e-9)) THEN 'train' ELSE 'validation' END AS split FROM f JOIN k USING (family)"""


@query(_split_sql(None, 1))
def family_split(spark, d):
    return it.family_split(table(spark, d, "samples"), 0.85, 13)


@query(_split_sql("default", 1))
def family_split_default(spark, d):
    return it.family_split(table(spark, d, "samples"), 0.85, 13, missing="default")


@query(_split_sql("unknown", 0))
def family_split_ratio(spark, d):
    return it.family_split(table(spark, d, "samples"), 0.85, 13, least=0, missing="unknown")


@query("SELECT count(DISTINCT task_id) AS reserved, 0 AS train_eligible FROM eval_items")
def reserve_tasks(spark, d):
    return table(spark, d, "eval_items").agg(F.count_distinct("task_id").alias("reserved"), F.lit(0).alias("train_eligible"))


PAIRS = "(('train', 'validation'), ('train', 'holdout'), ('validation', 'holdout'))"
DISJOINT = f"""{ONE}, {SPLIT}, j AS (SELECT split, sample_id, scenario_family FROM s JOIN sp USING (sample_id))"""


@query(f"{DISJOINT} SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.scenario_family) AS families FROM j a JOIN j b ON a.scenario_family = b.scenario_family AND a.split < b.split WHERE a.scenario_family <> '' GROUP BY 1, 2")
def split_disjoint(spark, d):
    j = rows(spark, d).join(split_one(spark, d), "sample_id").where("scenario_family <> ''").select("split", "scenario_family").distinct()
    a, b = j.select(F.col("split").alias("split_a"), "scenario_family"), j.select(F.col("split").alias("split_b"), "scenario_family")
    return a.join(b, "scenario_family").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("families"))


@query("SELECT sample_id FROM split_rows WHERE lower(trim(split_name)) = 'train' INTERSECT SELECT sample_id FROM split_rows WHERE lower(trim(split_name)) = 'holdout'")
def holdout_intersect(spark, d):
    s = table(spark, d, "split_rows").withColumn("split", F.lower(F.trim("split_name")))
    return s.where("split = 'train'").select("sample_id").intersect(s.where("split = 'holdout'").select("sample_id"))


@query("SELECT sample_id FROM split_rows WHERE lower(trim(split_name)) = 'train' UNION ALL SELECT sample_id FROM split_rows WHERE lower(trim(split_name)) = 'validation'")
def split_union_all(spark, d):
    s = table(spark, d, "split_rows").withColumn("split", F.lower(F.trim("split_name")))
    return s.where("split = 'train'").select("sample_id").unionAll(s.where("split = 'validation'").select("sample_id"))


@query("SELECT DISTINCT kb_id FROM documents WHERE kb_id IS NOT NULL")
def known_ids(spark, d):
    return table(spark, d, "documents").where("kb_id IS NOT NULL").select("kb_id").distinct()


COUNTS = f"{ONE}, {SPLIT} SELECT split, count(*) AS canonical, count(*) FILTER (validation_status <> 'rejected') AS lora, count(*) FILTER (validation_status IN ('accepted', 'pending', 'review_required')) AS osft FROM s JOIN sp USING (sample_id) GROUP BY 1"


@query(f"SELECT split, CASE WHEN lora <> osft THEN 'error' WHEN lora <> canonical THEN 'warning' ELSE 'ok' END AS severity FROM ({COUNTS})")
def backend_parity(spark, d):
    j = rows(spark, d).join(split_one(spark, d), "sample_id")
    kept = F.col("validation_status") != "rejected"
    counts = j.groupBy("split").agg(F.count("*").alias("canonical"), F.count_if(kept).alias("lora"), F.count_if(F.col("validation_status").isin("accepted", "pending", "review_required")).alias("osft"))
    return it.backend_parity(counts)


@query(f"{ONE}, {SPLIT} SELECT split, sample_type, count(*) AS n, count(DISTINCT scenario_family) AS families FROM s JOIN sp USING (sample_id) GROUP BY 1, 2")
def manifest_counts(spark, d):
    j = rows(spark, d).join(split_one(spark, d), "sample_id")
    return j.groupBy("split", "sample_type").agg(F.count("*").alias("n"), F.count_distinct("scenario_family").alias("families"))


@query("SELECT source, 's-' || coalesce(category, 'none') AS flow, count(*) AS n FROM documents GROUP BY 1, 2")
def usage_accounting(spark, d):
    return table(spark, d, "documents").groupBy("source", F.concat(F.lit("s-"), F.coalesce("category", F.lit("none"))).alias("flow")).agg(F.count("*").alias("n"))


TOKENS = """t AS (SELECT sample_id, ingested_at, [struct_pack(role := m.role, n := CASE WHEN trim(coalesce(m.content, ''), ' ') = '' THEN 0 ELSE len(string_split(regexp_replace(trim(m.content, ' '), ' +', ' ', 'g'), ' ')) END) FOR m IN messages] AS p FROM samples)"""


@query(f"WITH {TOKENS} SELECT sample_id, ingested_at, CAST(list_sum([x.n FOR x IN p]) AS BIGINT) AS labels, CAST(coalesce(list_sum([x.n FOR x IN p IF x.role = 'assistant']), 0) AS BIGINT) AS kept FROM t")
def loss_mask(spark, d):
    """Labels of every sample with blanks between tokens: -100 outside of assistant messages."""
    return _masked(spark, d).select("sample_id", "ingested_at", F.size("labels").cast("long").alias("labels"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("kept"))


def _masked(spark, d):
    text = lambda m: F.trim(F.regexp_replace(F.coalesce(m["content"], F.lit("")), " +", " "))
    ids = lambda m: F.when(text(m) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text(m), " "), lambda w: F.abs(F.xxhash64(w)) % 50_000))
    spans = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), ids(m).alias("tokens")))
    return table(spark, d, "samples").select("sample_id", "ingested_at", spans.alias("spans")).withColumn("labels", it.mask_labels())


@query(f"WITH {TOKENS}, c AS (SELECT list_sum([x.n FOR x IN p]) AS a, coalesce(list_sum([x.n FOR x IN p IF x.role = 'assistant']), 0) AS k FROM t) SELECT count(*) FILTER (a = 0) AS empty, count(*) FILTER (a > 0 AND k = 0) AS all_masked, 0 AS too_large FROM c")
def loss_mask_verify(spark, d):
    n, kept = F.size("labels"), F.size(F.filter("labels", lambda x: x != -100))
    big = F.exists("labels", lambda x: x >= 50_000)
    return _masked(spark, d).agg(F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (kept == 0)).alias("all_masked"), F.count_if(big).cast("int").alias("too_large"))


CODED = """e AS (SELECT sample_id, ingested_at, flatten([[CASE m.role WHEN 'system' THEN 1 WHEN 'user' THEN 3 WHEN 'assistant' THEN 4 ELSE 5 END] || CASE WHEN m.content IS NULL THEN [0] ELSE list_transform(string_split(m.content, ' '), lambda w: 6 + length(w) % 500) END
 || CASE WHEN m.role = 'assistant' THEN [2] ELSE [] END FOR m IN messages]) AS ids FROM samples)"""


def _coded(messages):
    """Ids of a conversation by a small stand-in of a tokenizer: system opens with the begin mark, answers close with
    the end mark, a null content is padding, and a word's id is its length."""
    mark = lambda m: F.when(m["role"] == "system", 1).when(m["role"] == "user", 3).when(m["role"] == "assistant", 4).otherwise(5)
    own = lambda m: F.when(m["content"].isNull(), F.array(F.lit(0))).otherwise(F.transform(F.split(m["content"], " "), lambda w: 6 + F.length(w) % 500))
    end = lambda m: F.when(m["role"] == "assistant", F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(messages, lambda m: F.concat(F.array(mark(m)), own(m), end(m))))


@query(f"""WITH {CODED} SELECT sample_id, ingested_at, coalesce(len(ids), 0) = 0 AS empty, coalesce(ids[1] <> 1, false) AS no_begin, coalesce(ids[len(ids)] <> 2, false) AS no_end,
 coalesce(list_position(ids, 0) > 0 AND len(list_filter(ids[list_position(ids, 0):], lambda x: x <> 0)) > 0, false) AS padding FROM e""")
def special_token_check(spark, d):
    """Begin mark in front, end mark at the end, no padding between tokens, over all samples."""
    issues = bd.special_tokens(_coded(F.col("messages")), 1, 2, 0)
    kinds = {"empty": "empty", "begin": "no_begin", "end": "no_end", "padding": "padding"}
    return table(spark, d, "samples").select("sample_id", "ingested_at", issues.alias("issues")).select("sample_id", "ingested_at", *(F.array_contains("issues", k).alias(n) for k, n in kinds.items()))


@query(f"""{ONE}, {SPLIT}, c AS (SELECT split, count(*) FILTER (len(messages) > 0) AS n FROM s JOIN sp USING (sample_id) GROUP BY 1)
 SELECT b AS backend, 'loader ' || split AS "check", true AS ok FROM c, (VALUES ('lora'), ('osft')) AS t(b) WHERE split IN ('train', 'validation') UNION ALL SELECT b, 'rows', n > 0 FROM c, (VALUES ('lora'), ('osft')) AS t(b) WHERE split = 'train'
 UNION ALL SELECT b, 'length', (SELECT max(len(messages)) <= 100000 FROM s) FROM (VALUES ('lora'), ('osft')) AS t(b)""")
def training_ready(spark, d):
    """May training start from a written bundle?  Marks and labels of its first ten rows depend on how files are
    cut, so only the checks that hold for any ten rows are given out here."""
    kept = rows(spark, d).join(split_one(spark, d), "sample_id").withColumn("sample_type", F.lit("any"))
    path = sinks.bundle(kept, table(spark, d, "documents").select("kb_id", "text"), sinks.folder(spark, "ready"))
    labels = lambda m: F.flatten(F.transform(m, lambda x: F.transform(F.split(F.coalesce(x["content"], F.lit("")), " "), lambda w: F.when(x["role"] == "assistant", F.length(w)).otherwise(-100))))
    out = None
    for backend in sinks.BACKENDS:
        r = bd.training_ready(spark, path, backend, _coded, labels, 1, 2, 0, 100_000).where("check NOT IN ('marks', 'labels')").select(F.lit(backend).alias("backend"), "check", "ok")
        out = r if out is None else out.union(r)
    return out


@query(f"{ONE} SELECT sample_id, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN coalesce(json_extract_string(c, '$.ref'), '') ELSE u END AS query FROM (SELECT sample_id, max(CASE WHEN m.role = 'tool' THEN m.content END) AS c, max(CASE WHEN m.role = 'user' THEN m.content END) AS u FROM (SELECT sample_id, unnest(messages) AS m FROM s) GROUP BY 1)")
def plan_queries(spark, d):
    """A plan is JSON; where it does not parse, the user's message stands in. Tool output plays the plan."""
    m = rows(spark, d).select("sample_id", F.explode("messages").alias("m"))
    g = m.groupBy("sample_id").agg(F.max(F.when(F.col("m.role") == "tool", F.col("m.content"))).alias("c"), F.max(F.when(F.col("m.role") == "user", F.col("m.content"))).alias("u"))
    parsed = F.expr("try_parse_json(c)")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return g.select("sample_id", F.when(is_object, F.coalesce(F.get_json_object("c", "$.ref"), F.lit(""))).otherwise(F.col("u")).alias("query"))


@query("SELECT run_id, task_id, trial, saved_at, CASE WHEN error IS NOT NULL THEN false ELSE coalesce(success, true) END AS verified FROM task_results")
def verify_status(spark, d):
    return table(spark, d, "task_results").select("run_id", "task_id", "trial", "saved_at", F.when(F.col("error").isNotNull(), False).otherwise(F.coalesce("success", F.lit(True))).alias("verified"))


@query(f"{ONE} SELECT sample_id, i AS message, m.content AS result, true AS executed, false AS verified, '{{}}' AS args FROM (SELECT sample_id, unnest(range(0, len(messages))) AS i, unnest(messages) AS m FROM s) WHERE m.role = 'tool'")
def observation_ingest(spark, d):
    m = rows(spark, d).select("sample_id", F.posexplode("messages").alias("i", "m")).where("m.role = 'tool'")
    return m.select("sample_id", F.col("i").cast("long").alias("message"), F.col("m.content").alias("result"), F.lit(True).alias("executed"), F.lit(False).alias("verified"), F.lit("{}").alias("args"))


@query("SELECT doc_id, 'policy-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS policy_id FROM documents WHERE regexp_matches(lower(text), 'policy|rule|requirement|must|shall|prohibited|allowed')")
def policy_keyword_filter(spark, d):
    """Documents with a policy word, numbered in id order; positions come from per-partition counts
    of a range partitioning, not from one global sort task."""
    from loomlake.operators.validation import POLICY_WORDS

    kept = table(spark, d, "documents").where(F.lower("text").rlike("|".join(POLICY_WORDS))).select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    from loomlake.workspace import stored

    numbered = stored(kept.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "policy")
    from pyspark.sql import Window

    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))  # one row per partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("before") + F.col("at") - F.col("low")
    return numbered.join(F.broadcast(before), "part").select("doc_id", F.concat(F.lit("policy-"), F.lpad(place.cast("string"), 6, "0")).alias("policy_id"))


@query("SELECT doc_id, text, n_chars FROM documents")
def kb_snapshot(spark, d):
    """Documents of any shape as JSON lines, read back."""
    line = F.to_json(F.struct("*"))
    back = table(spark, d, "documents").select(F.from_json(line, "doc_id long, text string, n_chars long").alias("r"))
    return back.select("r.*")


@query("SELECT doc_id, (SELECT arg_min(title, doc_id) FROM documents WHERE title IS NOT NULL) AS icl_document, 'What applies?' AS icl_query_1, 'Who decides?' AS icl_query_2, 'By when?' AS icl_query_3 FROM documents")
def icl_columns(spark, d):
    docs = table(spark, d, "documents")
    first = docs.where("title IS NOT NULL").agg(F.min_by("title", "doc_id").alias("icl_document"))
    return docs.select("doc_id").crossJoin(F.broadcast(first)).select(  # one row
        "doc_id", "icl_document", F.lit("What applies?").alias("icl_query_1"), F.lit("Who decides?").alias("icl_query_2"), F.lit("By when?").alias("icl_query_3")
    )


@query("SELECT kb_id, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY doc_id DESC) = 1")
def scan_kb(spark, d):
    return latest(table(spark, d, "documents"), ["kb_id"], "doc_id").select("kb_id", "doc_id", "text")


@query("SELECT doc_id, text AS document, title AS document_outline, 'banking' AS domain FROM documents")
def scan_kb_pandas(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("title").alias("document_outline"), F.lit("banking").alias("domain"))
