"""The queries of this subpackage: name -> (session, data directory) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import answers, leakage, neardup, overlap, packing, pieces, residue, sampling, splits, tokens
from loomlake.llm.sql import SQL  # noqa: F401
from loomlake.workspace import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "samples"), table(spark, d, "sample_plan")).where("short").select("plan_id", "sample_type")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "samples"), table(spark, d, "sample_plan")).select("plan_id", "sample_type", "draw", "needed", "available", "short")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "samples"), table(spark, d, "sample_plan"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(table(spark, d, "samples"), table(spark, d, "split_rows"))
    return pairs.select(F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "samples"), table(spark, d, "split_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "samples"))[0].select("sample_id", "group_key")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "samples"), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).where("exact").select("item_id", "sample_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "samples"), table(spark, d, "eval_items"), table(spark, d, "split_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_answers(table(spark, d, "samples"))


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    return answers.judged_answers(table(spark, d, "samples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "samples")).select("sample_id", "group_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("piece = 0").select("chunk_id", "kind")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    encoder = tokens.Encoder(spark).learn(documents)
    sized = documents.select("doc_id", F.size(encoder.encode("text")).alias("tokens"))
    return packing.packed(sized, "doc_id", "tokens").withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_containers(spark, d).where("piece > 0").select("doc_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p2_found, p2_report, p3_found, p3_splits, p4_found, p4_report, p5_found, p5_steps, p6_found, p7_found, p7_pieces, p8_ids, p9_containers, p9_found, p10_found, p10_residue)}
