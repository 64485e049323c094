"""Bundles, fingerprints, result logs, session guards and encoded examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.workspace import stored


def corpus_hash(documents: DataFrame, text: str = "text", buckets: int = 256) -> DataFrame:
    """One row: sha256 over the sorted hashes of all texts, 16 hex digits.

    Text hashes are combined in two levels, by leading byte, so that no task holds all texts;
    the result depends on the multiset of texts only.
    """
    h = documents.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("h"))
    level = h.groupBy(F.substring("h", 1, 2).alias("b"), "h").agg(F.count("*").alias("n"))
    part = level.groupBy("b", F.substring("h", 3, 1).alias("c")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ""), 256).alias("p"))
    return part.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "c", "p"))), lambda x: x["p"]), ""), 256), 1, 16).alias("corpus_hash"))


def family_split(samples: DataFrame, share: float, seed: int, least: int = 1, missing: str | None = None) -> DataFrame:
    """(sample_id, family, split): whole families in the order of a seeded hash, the first
    ``max(least, floor(share n))`` go to train; samples without a family are split on their own
    unless ``missing`` names one for them."""
    fam = F.when(F.trim(F.coalesce("scenario_family", F.lit(""))) != "", F.lower(F.trim("scenario_family")))
    named = samples.select("sample_id", F.coalesce(fam, F.lit(missing) if missing else F.concat(F.lit("~"), "sample_id")).alias("family")).distinct()
    one = named.groupBy("sample_id").agg(F.min("family").alias("family"))
    kinds = one.select("family").distinct().withColumn("single", F.col("family").startswith("~"))
    draw = F.md5(F.concat(F.lit(str(seed)), "family"))
    # a rank in hash order over all families, in two levels: totals per leading digits, then inside
    keyed = kinds.withColumn("draw", draw).withColumn("slice", F.substring("draw", 1, 3))
    sizes = keyed.groupBy("single", "slice").agg(F.count("*").alias("n"))  # at most 8192 rows
    upto = Window.partitionBy("single").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("single"))).drop("n")
    inside = F.row_number().over(Window.partitionBy("single", "slice").orderBy("draw", "family"))
    ranked = keyed.join(F.broadcast(offsets), ["single", "slice"]).withColumn("rank", F.col("offset") + inside)
    train = F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("total") * share + 1e-9))
    sided = ranked.select("family", F.when(train, "train").otherwise("validation").alias("split"))
    return one.join(sided, "family").select("sample_id", "family", "split")


def upload_state(log: DataFrame) -> DataFrame:
    """(fingerprint, uploaded): a record is pending if none of its events has a run id."""
    return log.groupBy("fingerprint").agg(F.max("upload_id").alias("upload_id")).select("fingerprint", F.col("upload_id").isNotNull().alias("uploaded"))


def budget_spend(batches: DataFrame, order: str, cost: str, limit: float, slices: int = 4096) -> DataFrame:
    """Batches run while the cost before them is under the limit: it stops after the batch that reaches it.

    The running sum works in two levels: rows are ranged by the order into slices, whose totals (a row
    each) give every slice its offset, and only rows of one slice are sorted together.
    """
    ranged = stored(batches.repartitionByRange(slices, order).withColumn("slice", F.spark_partition_id()), "spend")
    totals = ranged.groupBy("slice").agg(F.sum(cost).alias("total"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slice", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("offset"))  # at most ``slices`` rows
    inside = F.coalesce(F.sum(cost).over(Window.partitionBy("slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(offsets), "slice").withColumn("spent_before", F.col("offset") + inside)
    return placed.where(F.col("spent_before") < limit).drop("slice", "offset")


def duplicate_actions(events: DataFrame, session: str, name: str, arguments: str, order: list[str]) -> DataFrame:
    """Every event with whether the same action of the session came before.

    The first event of an action is an aggregate that is joined back, so a session with most of
    the events is never sorted in one task.
    """
    first = events.groupBy(session, name, arguments).agg(F.min(F.struct(*order)).alias("first"))
    same = [events[c].eqNullSafe(first[c]) for c in (session, name, arguments)]
    cond = same[0] & same[1] & same[2]
    return events.join(first, cond).select(events["*"], (F.struct(*[events[o] for o in order]) != F.col("first")).alias("duplicate"))


def mask_labels(spans: str = "spans") -> Column:
    """Labels of an encoded conversation: -100 except inside assistant spans; a span's tokens are
    its message's own."""
    label = lambda s: F.transform(F.sequence(F.lit(1), F.size(s["tokens"])), lambda i: F.when(s["role"] == "assistant", F.get(s["tokens"], i - 1)).otherwise(F.lit(-100).cast("bigint")))
    some = F.filter(spans, lambda s: F.size(s["tokens"]) > 0)
    return F.flatten(F.transform(some, label))


def checksum_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): missing, mismatch or ok for every expected file."""
    joined = expected.join(actual.withColumnRenamed("sha256", "found"), "path", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch").otherwise("ok")
    return joined.select("path", state.alias("state"))


def backend_parity(counts: DataFrame) -> DataFrame:
    """(split, severity): counts (split, lora, osft, canonical); unequal backends are an error, a
    difference to the canonical count a warning; -1 is absent and skipped."""
    lora, osft, whole = F.col("lora"), F.col("osft"), F.col("canonical")
    bad = (lora >= 0) & (osft >= 0) & (lora != osft)
    near = (lora >= 0) & (whole >= 0) & (lora != whole)
    return counts.select("split", F.when(bad, "error").when(near, "warning").otherwise("ok").alias("severity"))


def weights_hash(digests: DataFrame) -> DataFrame:
    """(weights_hash): the hash over the sorted hex digests of one model's files, first 16 signs."""
    joined = F.array_join(F.array_sort(F.collect_list("sha256")), "")  # one digest a file of one model
    return digests.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("weights_hash"))


def exported_models(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, config, tokenizer, shards, found, weights, complete) of exported models below a folder:
    parts that exist, shards that the index names and those of them that are there."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    at = parts.select(F.regexp_extract("path", "run_id=([^/]+)", 1).alias("run_id"), F.regexp_extract("path", "part=([^/]+)", 1).alias("part")).where("part <> ''").distinct()
    inner = lambda name: F.regexp_extract("_metadata.file_path", f"{name}=([^/]+)", 1).alias(name)
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", inner("run_id"), inner("part")).where("part = 'index'")
    named = lines.select("run_id", F.explode(F.from_json("value", "array<string>")).alias("shard"))
    have = at.where("startswith(part, 'shard-')").select("run_id", F.substring("part", 7, 100).alias("shard"), F.lit(1).alias("here"))
    shards = named.join(have, ["run_id", "shard"], "left").groupBy("run_id").agg(F.count("*").alias("shards"), F.count("here").alias("found"))
    single = at.groupBy("run_id").agg(*(F.max(F.col("part") == p).alias(p) for p in ("config", "tokenizer")))
    weights = F.coalesce(F.col("found") == F.col("shards"), F.lit(False))
    return single.join(shards, "run_id", "left").select("run_id", "config", "tokenizer", "shards", "found", weights.alias("weights"), (F.col("config") & F.col("tokenizer") & weights).alias("complete"))
