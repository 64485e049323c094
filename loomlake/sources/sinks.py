"""Writers: JSON lines, partitioned exports, append-only logs, bundles with checksums."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.files import checksum_lines, exists, file_digests
from loomlake.workspace import application_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared workspace."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def jsonl(df: DataFrame, path: str) -> str:
    """One JSON object a line, null fields left out."""
    df.write.json(path)
    return path


def partitioned(df: DataFrame, path: str, *by: str) -> str:
    df.write.partitionBy(*by).parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> str:
    """Appends; a log is never deduplicated on writing, readers resolve it."""
    df.write.mode("append").parquet(path)
    return path


def csv_table(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def vectors(df: DataFrame, path: str) -> str:
    """Adds vectors to a collection; rows without an id get one."""
    df.withColumn("id", F.coalesce(F.col("id"), F.expr("uuid()"))).write.mode("append").parquet(path)
    return path


def resume(done: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates that an earlier run has not finished."""
    return candidates.join(done.select(key), key, "left_anti")


BACKENDS = ("lora", "osft")


def one_object(spark: SparkSession, path: str, values: dict) -> str:
    """One JSON object as the only line below ``path``."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def bundle(samples: DataFrame, documents: DataFrame, path: str, provenance: DataFrame | None = None, name: str = "bundle", version: str = "v1", model: str = "") -> str:
    """canonical/ by split, training/ with messages only by backend and split, kb/, metadata/ with
    provenance and split sizes, reports/quality, card, then checksums over all of it, and last the
    manifest with the sizes and a hash of the checksums.  An entry is a folder of part files."""
    spark = samples.sparkSession
    samples.write.partitionBy("split").json(f"{path}/canonical")
    for backend in BACKENDS:
        samples.select("split", "messages").write.partitionBy("split").json(f"{path}/training/{backend}")
    documents.write.json(f"{path}/kb")
    if provenance is not None:
        provenance.write.json(f"{path}/metadata/provenance")
    sizes = {f"{r.split}_count": r.n for r in samples.groupBy("split").agg(F.count("*").alias("n")).toLocalIterator()}  # one row per split
    one_object(spark, f"{path}/metadata/splits", sizes)
    kind = F.coalesce("sample_type", F.lit("unknown")) if "sample_type" in samples.columns else F.lit("unknown")
    quality = samples.groupBy("split", kind.alias("sample_type")).agg(F.count("*").alias("n"))
    quality.coalesce(1).write.json(f"{path}/reports/quality")
    title = spark.createDataFrame([(i, "", "", x) for i, x in enumerate((f"# {name} {version}", "", "| split | type | samples |", "|-|-|-|"))], "at int, split string, sample_type string, value string")
    lines = quality.select(F.lit(9).alias("at"), "split", "sample_type", F.format_string("| %s | %s | %d |", "split", "sample_type", "n").alias("value"))
    title.union(lines).coalesce(1).sortWithinPartitions("at", "split", "sample_type").select("value").write.text(f"{path}/card")  # a line per split and type
    digests = file_digests(spark, path).where("bytes > 0 AND name LIKE 'part-%'")
    digests.select(F.concat_ws("  ", "sha256", "tail")).write.text(f"{path}/checksums")
    ordered = spark.read.text(f"{path}/checksums").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), "\n"), 256)).first()[0]  # one line a file
    keys = {"bundle_name": name, "bundle_version": version, "model_id": model, "bundle_hash": ordered}
    one_object(spark, f"{path}/manifest", keys | {f"canonical_{x}_count": sizes.get(f"{x}_count", 0) for x in ("train", "validation")})
    return path


def checkpoint(path: str, accepted: DataFrame, rejected: DataFrame, provenance: DataFrame, cost: float) -> str:
    """The state of a run: accepted and rejected rows, provenance and cost; written anew each time,
    the cost last, so that a checkpoint without one is unfinished."""
    for part, rows in (("accepted", accepted), ("rejected", rejected), ("provenance", provenance)):
        rows.write.mode("overwrite").parquet(f"{path}/{part}")
    one_object(accepted.sparkSession, f"{path}/cost", {"cost_usd": cost})
    return path


def resumed(spark: SparkSession, path: str, candidates: DataFrame, key: str) -> tuple[DataFrame, float]:
    """(candidates that the checkpoint has neither accepted nor rejected, cost so far); all of them
    and no cost where there is no finished checkpoint."""
    if not exists(spark, f"{path}/cost"):
        return candidates, 0.0
    done = spark.read.parquet(f"{path}/accepted").select(key).union(spark.read.parquet(f"{path}/rejected").select(key)).distinct()
    cost = spark.read.schema("cost_usd double").json(f"{path}/cost").first().cost_usd
    return candidates.join(done, key, "left_anti"), cost


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, state) of every file that the checksums name."""
    want = checksum_lines(spark, f"{path}/checksums").select("sha256", F.col("path").alias("name"))
    have = file_digests(spark, path).select(F.col("tail").alias("name"), F.col("sha256").alias("found"))
    joined = want.join(have, "name", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch").otherwise("ok")
    return joined.select("name", state.alias("state"))
