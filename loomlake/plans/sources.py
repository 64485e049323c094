"""Queries that write tables in the bundle's formats and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import bundles as bd
from loomlake.operators import integrity as it
from loomlake.plans.registry import query
from loomlake.plans.samples import ONE, SPLIT, rows, split_one
from loomlake.sources import files, sinks
from loomlake.workspace import table

ITEM = "item_id string, task_id string, question string, answer string"


def _lines(spark, d, name: str, broken: bool = False) -> str:
    """The evaluation items as JSON lines; with ``broken``, every tenth followed by a bad line."""
    i = table(spark, d, "eval_items")
    line = F.to_json(F.struct("*"))
    bad = F.when(F.substring("item_id", -1, 1) == "0", F.array(line, F.lit('{"item_id": "broken'), F.lit("  "))).otherwise(F.array(line))
    path = sinks.folder(spark, name)
    i.select(F.explode(bad if broken else F.array(line)).alias("value")).write.text(path)
    return path


@query("SELECT item_id, task_id, question, answer FROM eval_items")
def scan_jsonl_strict(spark, d):
    return files.jsonl_strict(spark, _lines(spark, d, "strict"), ITEM)


@query("SELECT item_id, task_id, question, answer FROM eval_items")
def scan_jsonl_lenient(spark, d):
    return files.jsonl_lenient(spark, _lines(spark, d, "lenient", broken=True), ITEM)


@query("SELECT count(*) + count(*) FILTER (item_id LIKE '%0') AS lines, count(*) AS good, count(*) FILTER (item_id LIKE '%0') AS bad FROM eval_items")
def scan_jsonl_tagged(spark, d):
    t = files.jsonl_tagged(spark, _lines(spark, d, "tagged", broken=True))
    return t.agg(F.count("*").alias("lines"), F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("SELECT count(*) AS n FROM eval_items")
def count_jsonl(spark, d):
    return files.count_jsonl(spark, _lines(spark, d, "count", broken=True))


@query("SELECT run_id, task_id, trial, success, error FROM task_results")
def sink_jsonl(spark, d):
    path = sinks.jsonl(table(spark, d, "task_results").select("run_id", "task_id", "trial", "success", "error"), sinks.folder(spark, "jsonl"))
    return files.jsonl_strict(spark, path, "run_id string, task_id string, trial long, success boolean, error string")


IN = f"{ONE}, {SPLIT} SELECT sample_id, sample_type FROM s JOIN sp USING (sample_id) WHERE split = 'train'"


def _split(spark, d):
    return rows(spark, d).join(split_one(spark, d), "sample_id")


@query(IN)
def scan_sample_split(spark, d):
    path = sinks.partitioned(_split(spark, d).select("sample_id", "sample_type", "split"), sinks.folder(spark, "splits"), "split")
    return files.split_rows(spark, path, "train", "sample_id string, sample_type string, split string").drop("split")


@query(f"{ONE}, {SPLIT} SELECT 'lora' AS backend, count(*) AS n FROM s JOIN sp USING (sample_id) WHERE split = 'validation'")
def scan_backend_split(spark, d):
    j = _split(spark, d).select("split", "messages")
    both = j.withColumn("backend", F.explode(F.array(F.lit("lora"), F.lit("osft"))))
    path = sinks.partitioned(both, sinks.folder(spark, "backends"), "backend", "split")
    return spark.read.schema(both.schema).parquet(path).where("backend = 'lora' AND split = 'validation'").groupBy("backend").agg(F.count("*").alias("n"))


@query(f"{ONE}, {SPLIT} SELECT split, count(*) AS n, CAST(sum(len(messages)) AS BIGINT) AS messages FROM s JOIN sp USING (sample_id) GROUP BY 1")
def sink_backend_export(spark, d):
    kept = _split(spark, d).select("split", "messages")
    path = sinks.partitioned(kept, sinks.folder(spark, "export"), "split")
    return spark.read.schema(kept.schema).parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("messages").cast("long")).alias("messages"))


@query("SELECT run_id, count(*) AS n FROM task_results GROUP BY 1")
def sink_eval_result(spark, d):
    tracked = table(spark, d, "task_results").withColumn("track", F.lit("episodes"))
    path = sinks.partitioned(tracked, sinks.folder(spark, "results"), "track", "run_id")
    return spark.read.schema(tracked.schema).parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT run_id, 2 * count(*) AS n FROM task_results GROUP BY 1")
def sink_append_log(spark, d):
    t, path = table(spark, d, "task_results").select("run_id", "task_id"), sinks.folder(spark, "log")
    for _ in range(2):
        sinks.append_log(t, path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT task_id, success_any AS uploaded FROM (SELECT task_id, bool_or(success) AS success_any FROM task_results GROUP BY 1)")
def sink_mark_uploaded(spark, d):
    """Uploads are appended as events and resolved on reading; nothing is rewritten."""
    t, path = table(spark, d, "task_results"), sinks.folder(spark, "marks")
    sinks.append_log(t.select(F.col("task_id").alias("fingerprint"), F.lit(None).cast("string").alias("upload_id")), path)
    sinks.append_log(t.where("success").select(F.col("task_id").alias("fingerprint"), F.col("run_id").alias("upload_id")), path)
    return it.upload_state(spark.read.parquet(path)).withColumnRenamed("fingerprint", "task_id")


RUN = f"""{ONE}, p AS (SELECT sample_id, bool_or(validation_outcome = 'accepted') AS good, bool_or(validation_outcome = 'rejected') AS bad FROM provenance WHERE sample_id IS NOT NULL GROUP BY 1)"""


@query(f"""{RUN} SELECT s.sample_id, round((SELECT count(*) FROM p WHERE good) * 0.01e0, 6) AS cost FROM s LEFT JOIN p USING (sample_id) WHERE NOT coalesce(good OR bad, false)""")
def sink_checkpoint(spark, d):
    """A run is stopped with accepted and rejected rows behind it, and goes on with the rest and its cost."""
    p = table(spark, d, "provenance").where("sample_id IS NOT NULL")
    good, bad = (p.where(F.col("validation_outcome") == x).select("sample_id").distinct() for x in ("accepted", "rejected"))
    path = sinks.checkpoint(sinks.folder(spark, "state"), good, bad, p.select("sample_id", "generator_id", "validator_id"), round(good.count() * 0.01, 6))
    left, cost = sinks.resumed(spark, path, rows(spark, d).select("sample_id"), "sample_id")
    return left.withColumn("cost", F.lit(cost))


@query("SELECT run_id, count(*) AS n, round(count(*) FILTER (success) / count(*), 6) AS rate FROM task_results GROUP BY 1")
def sink_csv_table(spark, d):
    t = table(spark, d, "task_results").groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.count_if("success") / F.count("*"), 6).alias("rate"))
    path = sinks.csv_table(t, sinks.folder(spark, "table"))
    return spark.read.schema("run_id string, n long, rate double").option("header", True).csv(path)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def sink_vector_batch(spark, d):
    path = sinks.vectors(table(spark, d, "embeddings").withColumn("id", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id").cast("string"))), sinks.folder(spark, "vectors"))
    return spark.read.parquet(path).where("id IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


def _bundle(spark, d) -> str:
    documents = table(spark, d, "documents").select("kb_id", "text")
    return sinks.bundle(_split(spark, d), documents, sinks.folder(spark, "bundle"), table(spark, d, "provenance"), "samples", "v1", "none")


@query(f"""{ONE}, {SPLIT}, c AS (SELECT split, count(*) AS n FROM s JOIN sp USING (sample_id) GROUP BY 1), q AS (SELECT count(DISTINCT (split, coalesce(sample_type, 'unknown'))) AS n FROM s JOIN sp USING (sample_id))
 SELECT 'canonical' AS part, split, n FROM c UNION ALL SELECT 'lora', split, n FROM c UNION ALL SELECT 'osft', split, n FROM c UNION ALL SELECT 'kb', NULL, count(*) FROM documents UNION ALL SELECT 'provenance', NULL, count(*) FROM provenance
 UNION ALL SELECT 'quality', NULL, n FROM q UNION ALL SELECT 'card', NULL, 4 + n FROM q UNION ALL SELECT 'manifest ' || split, NULL, n FROM c WHERE split IN ('train', 'validation') UNION ALL SELECT 'splits ' || split, NULL, n FROM c""")
def sink_bundle(spark, d):
    """Rows of every part of a written bundle, read back."""
    path = _bundle(spark, d)
    parts = [("canonical", f"{path}/canonical"), *((b, f"{path}/training/{b}") for b in sinks.BACKENDS)]
    out = spark.createDataFrame([], "part string, split string, n long")
    for name, p in parts:
        out = out.union(spark.read.schema("split string").json(p).groupBy("split").agg(F.count("*").alias("n")).select(F.lit(name), "split", "n"))
    for name, p in (("kb", "kb"), ("provenance", "metadata/provenance"), ("quality", "reports/quality"), ("card", "card")):
        out = out.union(spark.read.text(f"{path}/{p}").agg(F.lit(name), F.lit(None).cast("string"), F.count("*")))
    for name, p, key in (("manifest ", "manifest", r"^canonical_(\w+)_count$"), ("splits ", "metadata/splits", r"^(\w+)_count$")):
        fields = spark.read.text(f"{path}/{p}").select(F.explode(F.from_json("value", "map<string, string>")).alias("k", "v")).where(F.col("k").rlike(key))
        out = out.union(fields.select(F.concat(F.lit(name), F.regexp_extract("k", key, 1)), F.lit(None).cast("string"), F.col("v").cast("long")))
    return out


SIZES = f"""{ONE}, {SPLIT}, c AS (SELECT split, count(*) AS n FROM s JOIN sp USING (sample_id) GROUP BY 1), raw AS (SELECT split, count(*) AS n FROM samples JOIN sp USING (sample_id) GROUP BY 1),
 n AS (SELECT split AS name, c.n AS expected, raw.n AS actual FROM c JOIN raw USING (split) WHERE split IN ('train', 'validation')),
 r AS (SELECT 'size' AS "check", name, CASE WHEN expected = actual THEN 'ok' ELSE 'error' END AS severity, expected, actual FROM n"""
_entries = lambda x, strict: " UNION ALL ".join(
    f"SELECT 'entry', '{e}', '{'ok' if e not in ('reports/quality_table', 'reports/backend_validation', 'examples', 'configs/lora', 'configs/osft') else x}', NULL, NULL"
    for e in ([*bd.REQUIRED[strict], *bd.OPTIONAL[strict]])
)


def _spoilt(spark, d) -> str:
    """A bundle to whose canonical rows all rows are added that redelivery repeats, and whose split sizes count them."""
    path = _bundle(spark, d)
    raw = table(spark, d, "samples").join(split_one(spark, d), "sample_id")
    window = Window.partitionBy("sample_id").orderBy(F.desc("ingested_at"))
    raw.withColumn("nth", F.row_number().over(window)).where("nth > 1").drop("nth").write.mode("append").partitionBy("split").json(f"{path}/canonical")
    sizes = {f"{r.split}_count": r.n for r in raw.groupBy("split").agg(F.count("*").alias("n")).toLocalIterator()}
    sinks.one_object(spark, f"{path}/metadata/splits", sizes)
    return path


@query(f"""{SIZES} UNION ALL SELECT 'split metadata', name, CASE WHEN expected = actual THEN 'ok' ELSE 'error' END, expected, actual FROM n UNION ALL SELECT 'checksum', 'missing', 'error', 0, 1 UNION ALL {_entries('warning', False)}) SELECT * FROM r""")
def bundle_validate(spark, d):
    return bd.validate(spark, _spoilt(spark, d))


@query(f"""{SIZES} UNION ALL SELECT 'fields', split, CASE WHEN bad = 0 THEN 'ok' ELSE 'error' END, 0, bad FROM (SELECT split, count(*) FILTER (messages IS NULL) AS bad FROM samples JOIN sp USING (sample_id) WHERE split IN ('train', 'validation') GROUP BY 1)
 UNION ALL SELECT 'fields', 'kb', CASE WHEN bad = 0 THEN 'ok' ELSE 'warning' END, 0, bad FROM (SELECT count(*) FILTER (text IS NULL) AS bad FROM documents) UNION ALL SELECT 'parity', name, 'ok', expected, expected FROM n
 UNION ALL SELECT 'canonical and ' || b, name, CASE WHEN expected = actual THEN 'ok' ELSE 'warning' END, actual, expected FROM n, (VALUES ('lora'), ('osft')) AS t(b) UNION ALL SELECT 'checksum', 'missing', 'error', 0, 1 UNION ALL {_entries('warning', True)}
 UNION ALL SELECT 'manifest', k, 'ok', NULL, NULL FROM (VALUES ('bundle_name'), ('bundle_version'), ('model_id'), ('canonical_train_count'), ('canonical_validation_count')) AS t(k))
 SELECT (SELECT count(*) = 0 FROM r WHERE severity <> 'ok') AS valid, (SELECT count(*) FROM r WHERE severity = 'error') AS errors, (SELECT count(*) FROM r WHERE severity = 'warning') AS warnings""")
def bundle_validate_strict(spark, d):
    """The verdict of the strict checks, under which warnings fail too."""
    return bd.verdict(bd.validate(spark, _spoilt(spark, d), strict=True), strict=True)


def _files(spark, d, keep="true") -> str:
    """A folder with a file per evaluation item, its question the only line."""
    path = sinks.folder(spark, "files")
    items = table(spark, d, "eval_items").where("question IS NOT NULL").where(keep).select("item_id", F.col("question").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    return path


def _digests(spark, path):
    f = files.file_digests(spark, path).where("name LIKE 'part-%'")
    return f.select(F.regexp_extract("tail", "item_id=([^/]+)", 1).alias("path"), "bytes", "sha256")


HASH = "sha256(question || chr(10))"


@query(f"""SELECT item_id AS path, CASE WHEN item_id LIKE '%7' THEN 'missing' WHEN answer IS NULL THEN 'mismatch' ELSE 'ok' END AS state FROM eval_items WHERE question IS NOT NULL""")
def checksum_join(spark, d):
    """Files of items ending in 7 are missing, and those of items without an answer have another hash than expected."""
    actual = _digests(spark, _files(spark, d, "item_id NOT LIKE '%7'")).select("path", "sha256")
    hashed = F.sha2(F.concat("question", F.lit("\n")), 256)
    expected = table(spark, d, "eval_items").where("question IS NOT NULL").select(F.col("item_id").alias("path"), F.when(F.col("answer").isNull(), F.reverse(hashed)).otherwise(hashed).alias("sha256"))
    return it.checksum_report(expected, actual)


@query(f"SELECT item_id AS name, strlen(question) + 1 AS bytes, {HASH} AS sha256 FROM eval_items WHERE question IS NOT NULL")
def file_checksum(spark, d):
    return _digests(spark, _files(spark, d)).withColumnRenamed("path", "name")


@query(f"""SELECT '{{' || string_agg('"' || item_id || '":"' || {HASH} || '"', ',' ORDER BY item_id) || '}}' AS manifest FROM eval_items WHERE question IS NOT NULL""")
def upload_checksum_manifest(spark, d):
    f = _digests(spark, _files(spark, d))
    return f.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))).alias("manifest"))  # the files of one upload


@query(f"SELECT substr(sha256(string_agg({HASH}, '' ORDER BY {HASH})), 1, 16) AS weights_hash FROM eval_items WHERE question IS NOT NULL")
def weights_hash(spark, d):
    return it.weights_hash(_digests(spark, _files(spark, d)))


@query("SELECT sha256(item_id) AS sha256, item_id AS path, true AS ok FROM eval_items")
def scan_checksum_file(spark, d):
    path = sinks.folder(spark, "sums")
    i = table(spark, d, "eval_items").select(F.concat_ws("  ", F.sha2("item_id", 256), "item_id").alias("value"))
    i.union(spark.createDataFrame([("# comment",), ("",)], "value string")).write.text(path)
    return files.checksum_lines(spark, path)


@query("SELECT count(DISTINCT run_id) AS runs, count(*) AS trials FROM task_results")
def scan_local_results(spark, d):
    """Result files of all runs below one folder, each row with its file's name."""
    path = sinks.folder(spark, "local")
    table(spark, d, "task_results").select("run_id", "task_id").write.json(path)
    r = spark.read.schema("run_id string, task_id string").option("recursiveFileLookup", True).json(path).withColumn("source_file", F.col("_metadata.file_name"))
    return r.where("source_file IS NOT NULL").agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("trials"))


@query("SELECT run_id, max(saved_at) AS saved_at, count(*) AS n FROM task_results GROUP BY 1 ORDER BY 2 DESC")
def scan_runs(spark, d):
    return table(spark, d, "task_results").groupBy("run_id").agg(F.max("saved_at").alias("saved_at"), F.count("*").alias("n")).orderBy(F.desc("saved_at"), "run_id")


@query("SELECT 'bundle' AS name, count(*) AS samples FROM samples")
def scan_manifest(spark, d):
    """A manifest is one JSON object over several lines."""
    n, path = table(spark, d, "samples").count(), sinks.folder(spark, "manifest")
    spark.createDataFrame([('{\n  "name": "bundle",\n  "samples": ' + str(n) + "\n}",)], "value string").coalesce(1).write.text(path)
    return spark.read.schema("name string, samples long").option("multiLine", True).json(path)


@query("SELECT 'shared' AS source, count(*) AS n FROM documents")
def fetch_first_available(spark, d):
    """Sources are tried in order; the local one is absent, and the one behind the shared copy is not asked."""
    copy = sinks.folder(spark, "copy")
    table(spark, d, "documents").write.parquet(copy)
    source, path = files.fetch(spark, {"local": f"{d}/absent.parquet", "shared": copy, "remote": f"{d}/documents.parquet"})
    return spark.read.parquet(path).agg(F.lit(source).alias("source"), F.count("*").alias("n"))


PARTS = "t AS (SELECT DISTINCT run_id, right(task_id, 1) AS shard, bool_or(success) OVER (PARTITION BY run_id, right(task_id, 1)) AS there FROM task_results WHERE run_id IS NOT NULL AND task_id IS NOT NULL)"


@query(f"""WITH {PARTS}, g AS (SELECT run_id, count(*) AS shards, count(*) FILTER (there) AS found FROM t GROUP BY 1) SELECT run_id, true AS config, false AS tokenizer, shards, found, found = shards AS weights, false AS complete FROM g""")
def exported_model_check(spark, d):
    """A model is exported per run: settings, an index of its shards, and those shards (last signs of task
    ids) that had a success; none has a tokenizer."""
    path = sinks.folder(spark, "models")
    t = table(spark, d, "task_results").where("run_id IS NOT NULL AND task_id IS NOT NULL").select("run_id", F.expr("right(task_id, 1)").alias("shard"), "success")
    index = t.groupBy("run_id").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    index.select("run_id", F.lit("config").alias("part"), F.lit("{}").alias("value")).union(index.select("run_id", F.lit("index"), F.to_json("shards"))).write.partitionBy("run_id", "part").text(path)
    there = t.where("success").select("run_id", F.concat(F.lit("shard-"), "shard").alias("part"), F.lit("w").alias("value")).distinct()
    there.write.mode("append").partitionBy("run_id", "part").text(path)
    return it.exported_models(spark, path)


@query(f"{ONE}, {SPLIT} SELECT split, count(*) AS n, count(*) FILTER (coalesce(len(messages), 0) = 0) AS without_messages FROM s JOIN sp USING (sample_id) GROUP BY 1")
def backend_loader_check(spark, d):
    return _split(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("messages"), F.lit(0)) <= 0).alias("without_messages"))


@query("SELECT plan_id || '.' || sample_type || '.rows' AS key, CAST(min_rows AS VARCHAR) AS value FROM sample_plan UNION ALL SELECT plan_id || '.' || sample_type || '.folder', '/data/' || plan_id FROM sample_plan UNION ALL SELECT plan_id || '.' || sample_type || '.absent', '' FROM sample_plan")
def scan_yaml_config(spark, d):
    """A settings file with a section per plan, its variables expanded; read on the driver."""
    path = sinks.folder(spark, "settings")
    row = F.concat(F.lit("  "), "sample_type", F.lit(":\n    rows: "), "min_rows", F.lit("  # floor\n    folder: \"${ROOT}/"), "plan_id", F.lit("\"\n    absent: ${NOWHERE}"))
    plan = table(spark, d, "sample_plan").select("plan_id", row.alias("row"))
    one = plan.groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("rows"))  # a plan has a row per type
    text = one.select(F.concat("plan_id", F.lit(":\n"), "rows").alias("value")).coalesce(1)
    text.write.option("lineSep", "\n").text(path)
    made = files.flat(files.settings_of(spark, path, {"ROOT": "/data"}))
    return spark.createDataFrame(sorted(made.items()), "key string, value string")


@query("""SELECT plan_id, sample_type, substr(sha256('{"draw_percent": ' || draw_percent || ', "min_rows": ' || min_rows || ', "plan_id": "' || plan_id || '", "target_bp": ' || target_bp || '}'), 1, 16) AS config_hash FROM sample_plan""")
def config_hash(spark, d):
    return table(spark, d, "sample_plan").select("plan_id", "sample_type", tx.config_hash("target_bp", "plan_id", "min_rows", "draw_percent").alias("config_hash"))


NEEDED = {"samples": "sample_id", "documents": "doc_id", "chunks": "source_doc_id", "provenance": "sample_id", "eval_items": "item_id", "task_results": "task_id"}


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS name, CASE WHEN count(*) = 0 OR count({k}) < count(*) THEN 'warn' ELSE 'pass' END AS status, count(*) AS rows FROM {t}" for t, k in NEEDED.items())
    + " UNION ALL SELECT 'absent', 'fail', NULL UNION ALL SELECT 'keyless', 'fail', NULL"
)
def health_preflight(spark, d):
    """Tables before a run; one that does not exist and one without the named key are asked for besides."""
    needed = {t: (f"{d}/{t}.parquet", k) for t, k in NEEDED.items()} | {"absent": (f"{d}/absent.parquet", "id"), "keyless": (f"{d}/region.parquet", "no_such_key")}
    return bd.preflight(spark, needed)
