"""Checks of written bundles: entries, manifest, checksums, sizes, schema, parity, training readiness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.files import exists
from loomlake.sources.sinks import BACKENDS, verify

SPLITS = ("train", "validation")
_CANONICAL = [f"canonical/split={s}" for s in SPLITS]
_TRAINING = [f"training/{b}/split={s}" for b in BACKENDS for s in SPLITS]
#: Entries of a bundle that have to exist, and those that should (fixed values), by strictness.
REQUIRED = {False: [*_CANONICAL, "kb", "metadata/provenance", "metadata/splits", "checksums"], True: ["manifest", "checksums", *_CANONICAL, *_TRAINING, "kb"]}
OPTIONAL = {
    False: ["reports/quality", "reports/quality_table", "reports/backend_validation", "card", *_TRAINING],
    True: ["examples", "metadata/provenance", "metadata/splits", "reports/quality", "reports/quality_table", "reports/backend_validation", "card", "configs/lora", "configs/osft"],
}
MANIFEST = "bundle_name string, bundle_version string, model_id string, canonical_train_count long, canonical_validation_count long"
REPORT = "check string, name string, severity string, expected long, actual long"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(entry, bytes) of the part files below a bundle; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    inner = F.regexp_extract("path", f"{path.rsplit('/', 1)[1]}/(.+)/[^/]+$", 1)
    return files.where(F.col("path").rlike("/part-[^/]*$")).select(inner.alias("entry"), F.col("length").alias("bytes"))


def entries(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """A row per entry of the lists: ok, or an error or warning for a missing one, and, if strict, for an empty one."""
    want = spark.createDataFrame([(e, "error") for e in REQUIRED[strict]] + [(e, "warning") for e in OPTIONAL[strict]], "entry string, level string")
    have = listing(spark, path)
    found = F.broadcast(want).join(have.withColumnRenamed("entry", "at"), F.col("at").startswith(F.col("entry")), "left")  # two fixed lists
    sums = found.groupBy("entry", "level").agg(F.count("at").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    good = (F.col("files") > 0) & (F.lit(not strict) | (F.col("level") == "warning") | (F.col("bytes") > 0))
    return sums.select(F.lit("entry").alias("check"), F.col("entry").alias("name"), F.when(good, "ok").otherwise(F.col("level")).alias("severity"), F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("actual"))


def _sizes(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Lines that parse, by split; splits without a folder are absent."""
    if not exists(spark, f"{path}/{folder}"):
        return {}
    lines = spark.read.option("recursiveFileLookup", True).text(f"{path}/{folder}").select("value", F.regexp_extract("_metadata.file_path", "split=([^/]+)", 1).alias("split"))
    rows = lines.where("try_parse_json(value) IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).toLocalIterator()  # one row per split
    return {r.split: r.n for r in rows}


def _lacking(spark: SparkSession, path: str, folder: str, needed: tuple[str, ...], split: str | None = None) -> int:
    """Lines without one of the needed fields, those that do not parse included."""
    if not exists(spark, f"{path}/{folder}"):
        return 0
    rows = spark.read.schema(", ".join(f"{c} string" for c in (*needed, *(["split"] if split else [])))).json(f"{path}/{folder}")
    rows = rows.where(F.col("split") == split) if split else rows
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    return rows.agg(F.count_if(missing)).first()[0]


def validate(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(check, name, severity, expected, actual): every check of a bundle; severity is ok, warning or error.

    Entries of the fixed lists; checksums that fail; sizes of the manifest, of the split metadata
    and of the files; if strict also empty entries, the manifest's keys, fields of the lines, and
    the backends' sizes against each other and the canonical ones, while a size of 0 in the
    manifest is not checked.  Without a manifest nothing else is looked at.
    """
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([("entry", "manifest", "error", None, None)], REPORT)
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first().asDict()
    rows: list[tuple] = []

    def add(check: str, name: str, bad: str, expected: int | None, actual: int | None, ok: bool | None = None):
        rows.append((check, name, "ok" if (expected == actual if ok is None else ok) else bad, expected, actual))

    wanted = {s: manifest[f"canonical_{s}_count"] for s in SPLITS}
    sizes = _sizes(spark, path, "canonical")
    for s in SPLITS:
        if s in sizes and not (strict and not wanted[s]):
            add("size", s, "error", wanted[s], sizes[s])
    if strict:
        for key, value in manifest.items():
            add("manifest", key, "error", None, None, value is not None)
        for s in SPLITS:
            lacking = _lacking(spark, path, "canonical", ("sample_id", "messages"), s)
            add("fields", s, "error", 0, lacking)
        add("fields", "kb", "warning", 0, _lacking(spark, path, "kb", ("text",)))
        both = {b: _sizes(spark, path, f"training/{b}") for b in BACKENDS}
        for s in SPLITS:
            one, two = (both[b].get(s) for b in BACKENDS)
            if one is not None and two is not None:
                add("parity", s, "error", one, two)
            for b in BACKENDS:
                if s in sizes and both[b].get(s) is not None:
                    add(f"canonical and {b}", s, "warning", sizes[s], both[b][s])
    elif exists(spark, f"{path}/metadata/splits"):
        split = spark.read.schema("train_count long, validation_count long").json(f"{path}/metadata/splits").first()
        for s in SPLITS:
            add("split metadata", s, "error", wanted[s], split[f"{s}_count"])
    report = spark.createDataFrame(rows, REPORT).union(entries(spark, path, strict))
    if exists(spark, f"{path}/checksums"):
        failed = verify(spark, path).where("state <> 'ok'").groupBy("state").agg(F.count("*").alias("n"))
        report = report.union(failed.select(F.lit("checksum"), "state", F.lit("error"), F.lit(0).cast("long"), "n"))
    return report


def verdict(report: DataFrame, strict: bool = False) -> DataFrame:
    """(valid, errors, warnings): no errors, and under ``strict`` no warnings either."""
    n = report.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.select(((F.col("errors") == 0) & (F.lit(not strict) | (F.col("warnings") == 0))).alias("valid"), "errors", "warnings")


def special_tokens(ids: str | Column, begin: int | None, end: int | None, pad: int | None) -> Column:
    """Issues of encoded ids, as an array: empty, begin, end, padding; marks that are None are not checked."""
    c = F.col(ids) if isinstance(ids, str) else ids
    issue = lambda bad, name: F.when(bad, F.lit(name))
    found = []
    if begin is not None:
        found.append(issue(F.get(c, F.lit(0)) != begin, "begin"))
    if end is not None:
        found.append(issue(F.element_at(c, -1) != end, "end"))
    if pad is not None:
        first = F.array_position(c, pad)
        behind = F.exists(F.slice(c, F.greatest(first, F.lit(1)).cast("int"), F.size(c)), lambda x: x != pad)
        found.append(issue((first > 0) & behind, "padding"))
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def training_ready(spark: SparkSession, path: str, backend: str, encode: Callable[[Column], Column], labels: Callable[[Column], Column], begin: int, end: int, pad: int, longest: int, rows: int = 10) -> DataFrame:
    """(check, ok): may training of a backend start from this bundle?

    Both splits exist; the training split has rows; and of its first ``rows`` rows, a spot check by
    its nature, none is without a label, breaks off the marks, or is longer than ``longest``.
    ``encode`` and ``labels`` turn the messages into ids and labels; a tokenizer is injected there.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")
    there = {s: exists(spark, f"{path}/training/{backend}/split={s}") for s in SPLITS}
    made = [("loader " + s, ok) for s, ok in there.items()]
    out = spark.createDataFrame(made, "check string, ok boolean")
    if not there["train"]:
        return out
    message = "array<struct<role:string,content:string>>"
    train = spark.read.schema(f"messages {message}").json(f"{path}/training/{backend}/split=train")
    first = train.where("size(messages) > 0").limit(rows).select(encode(F.col("messages")).alias("ids"), labels(F.col("messages")).alias("labels"))
    none = lambda bad: F.count_if(bad) == 0
    checks = first.agg(
        (F.count("*") > 0).alias("rows"),
        none(~F.exists("labels", lambda x: x != -100)).alias("labels"),
        none(F.size(special_tokens("ids", begin, end, pad)) > 0).alias("marks"),
        none(F.size("ids") > longest).alias("length"),
    )
    return out.union(checks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in checks.columns))).alias("x")).select("x.*"))


def preflight(spark: SparkSession, needed: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, status, rows) of the tables that a run needs, given as name -> (path, key column): fail for
    one that is absent or lacks its key, warn for one without rows or with rows without a key, else pass."""
    out = spark.createDataFrame([], "name string, status string, rows long")
    for name, (path, key) in needed.items():
        df = spark.read.parquet(path) if exists(spark, path) else None
        if df is None or key not in df.columns:
            out = out.union(spark.createDataFrame([(name, "fail", None)], out.schema))
            continue
        n = df.agg(F.count("*").alias("rows"), F.count(key).alias("keys"))
        out = out.union(n.select(F.lit(name), F.when((F.col("rows") == 0) | (F.col("keys") < F.col("rows")), "warn").otherwise("pass"), "rows"))
    return out
