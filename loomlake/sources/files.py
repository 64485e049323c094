"""Readers: JSON lines under three policies for bad lines, split folders, checksums, YAML settings."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The first line that does not parse ends the read with an error; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line, value, ok): every non-blank line of all files below ``path``.

    Lines are numbered from 1 inside their file: each file is read whole by one task, so files
    should be of ordinary size; larger inputs are written in parts.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    lines = files.select(F.col("_metadata.file_name").alias("source_file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    kept = lines.where(F.trim("value") != "")
    return kept.select("source_file", (F.col("n") + 1).cast("long").alias("source_line"), "value", F.expr("try_parse_json(value) IS NOT NULL").alias("ok"))


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(n): lines that parse; 0 for a missing path."""
    if not exists(spark, path):
        return spark.createDataFrame([(0,)], "n long")
    return spark.read.text(path).where("trim(value) <> '' AND try_parse_json(value) IS NOT NULL").agg(F.count("*").alias("n"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_available(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, local or remote; data is never made."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def split_rows(spark: SparkSession, path: str, split: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of one split of a folder partitioned by ``split``: other partitions are not read."""
    if split not in ("train", "validation"):
        raise ValueError(f"unknown split {split!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where(F.col("split") == split)


def checksum_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path, ok) of ``hash path`` lines; blank lines and comments are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    m = lambda g: F.regexp_extract("value", r"^\s*(\S+)\s+(.+?)\s*$", g)
    return lines.select(m(1).alias("sha256"), m(2).alias("path"), F.col("value").rlike(r"^\s*\S+\s+\S").alias("ok"))


def file_digests(spark: SparkSession, path: str, bits: int = 256) -> DataFrame:
    """(name, tail, bytes, sha256) of the files below a folder; ``tail`` keeps the last three folders.

    A file is one row, at most 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.regexp_extract("path", r"(?:[^/]+/){0,3}[^/]+$", 0).alias("tail"), F.col("length").alias("bytes"), F.sha2("content", bits).alias("sha256"))


def expand_variables(value, variables: dict[str, str]):
    """``${NAME}`` in strings, lists and dicts; a missing variable becomes an empty text."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: variables.get(m.group(1), ""), value)
    if isinstance(value, dict):
        return {k: expand_variables(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_variables(v, variables) for v in value]
    return value


def fetch(spark: SparkSession, sources: dict[str, str]) -> tuple[str, str]:
    """(name, path) of the first source, in order, that exists; later ones are not asked and nothing is made."""
    for name, path in sources.items():
        if exists(spark, path):
            return name, path
    raise FileNotFoundError(", ".join(sources.values()))


def _scalar(text: str):
    """A YAML scalar: quoted and plain text, numbers, booleans, null, flow lists and an empty mapping."""
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text == "{}":
        return {}
    if text[0] == "[" and text[-1] == "]":
        inner = text[1:-1].strip()
        return [_scalar(x.strip()) for x in inner.split(",")] if inner else []
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def parse_yaml(text: str):
    """The part of YAML that settings files use: nested mappings and lists by indentation, scalars,
    flow lists, comments.  Anchors, tags and block texts are refused."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (_without_comment(raw).rstrip() for raw in text.split("\n")) if x.strip() and x.strip() != "---"]

    def block(at: int, indent: int):
        listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
        out: list | dict = [] if listed else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if listed:
                rest = line[1:].strip()
                if rest and re.match(r"[^\s\"'\[]+:(?:\s|$)", rest):  # a mapping begins in the item's line
                    lines[at] = (indent + len(line) - len(rest), rest)
                    value, at = block(at, lines[at][0])
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
                continue
            m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:]+):(?:\s+(.*))?$", line)
            if not m or (m.group(2) or "")[:1] in ("&", "*", "!", "|", ">"):
                raise ValueError(f"not supported in settings: {line}")
            key, rest = str(_scalar(m.group(1).strip())), (m.group(2) or "").strip()
            at += 1
            if rest:
                out[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"wrong indentation: {lines[at][1]}")
        return out, at

    if not lines:
        return {}
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"wrong indentation: {lines[at][1]}")
    return value


def settings_of(spark: SparkSession, path: str, variables: dict[str, str] | None = None):
    """A YAML or JSON settings file, local or remote, with its variables expanded."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).toLocalIterator())
    raw = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)
    return expand_variables(raw, dict(os.environ) if variables is None else variables)


def flat(value, prefix: str = "") -> dict[str, str]:
    """Nested settings as dotted keys and texts."""
    if isinstance(value, dict | list):
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        return {k: v for key, inner in pairs for k, v in flat(inner, f"{prefix}{key}.").items()}
    return {prefix[:-1]: "" if value is None else str(value)}
