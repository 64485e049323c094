"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

Texts are cut into words by the tokenizer's pattern; a word's bytes are merged by a fold of
higher-order functions that looks merges up in a literal rank map.  The most frequent words are
folded once and become a literal dictionary (a cache: it changes no result); all other words are
folded where they stand.  Everything runs in the JVM.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizers' files are.
FOLDER = os.environ.get("LOOMLAKE_TOKENIZERS", "/opt/tokenizers")
#: White space of Unicode (fixed values).
SPACE = r"\t-\r \x85\xA0  -     　"
#: The tokenizer's pattern (public; fixed value), its \s written out because Java's is ASCII only.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words of the dictionary: a bound on what is collected and sent to the tasks.
DICTIONARY = 1 << 17


def vocabulary(path: str) -> dict[bytes, int]:
    """token -> rank of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


class HashMap:
    """A literal map from byte strings to values: open addressing over two flat arrays, held by
    session variables that the planner folds into literals."""

    def __init__(self, spark: SparkSession, name: str, keys: list[bytes], values: list, kind: T.DataType):
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.size = 1 << bits
        self.slots, self.values = f"{name}_slots_{uuid.uuid4().hex[:8]}", f"{name}_values_{uuid.uuid4().hex[:8]}"
        slots, held = np.zeros(self.size, np.int64), [None] * self.size
        self.depth = 1
        for key, value in zip(keys, values, strict=True):
            h = xxhash.xxh64_intdigest(key, seed=42)
            signed = h - (1 << 64) if h >> 63 else h
            at, steps = h & (self.size - 1), 1
            while slots[at]:
                if slots[at] == signed:
                    raise ValueError("two keys have one hash")
                at, steps = (at + 1) & (self.size - 1), steps + 1
            slots[at], held[at] = signed, value
            self.depth = max(self.depth, steps)
        element = pa.int32() if isinstance(kind, T.IntegerType) else pa.list_(pa.int32())
        one_row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        both = pa.table({"slots": one_row(pa.array(slots)), "held": one_row(pa.array(held, element))})
        view = f"loomlake_{uuid.uuid4().hex}"
        spark.createDataFrame(both).createOrReplaceTempView(view)
        for variable, column, element in ((self.slots, "slots", "bigint"), (self.values, "held", kind.simpleString())):
            spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} array<{element}>")
            spark.sql(f"SET VAR {variable} = (SELECT {column} FROM {view})")
        spark.catalog.dropTempView(view)

    def get(self, key: Column) -> Column:
        """The value of a binary or string key, or null."""
        slots, values = F.expr(self.slots), F.expr(self.values)

        def probe(h: Column, step: int) -> Column:
            at = (h + F.lit(step)).bitwiseAND(F.lit(self.size - 1)).cast("int")
            there = F.get(slots, at)
            hit = F.when(there == h, F.get(values, at))
            if step + 1 < self.depth:
                hit = hit.when(there != 0, probe(h, step + 1))
            return hit

        return _let(F.xxhash64(key), lambda h: probe(h, 0))


def fold(word: Column, ranks: HashMap) -> Column:
    """Token ids of one word (binary): the pair with the lowest rank, leftmost first, is merged
    until no pair is a token."""
    pair = lambda p, i: F.concat(F.get(p, i), F.get(p, i + 1))

    def step(state: Column, _: Column) -> Column:
        p = state["p"]
        found = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: ranks.get(pair(p, i)))

        def merge(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            merged = _let(
                at, lambda n: F.concat(F.slice(p, F.lit(1), n - 1), F.array(pair(p, n - 1)), F.slice(p, n + 2, F.size(p)))
            )
            return F.when(F.array_min(r).isNull(), F.struct(F.lit(True).alias("done"), p.alias("p"))).otherwise(
                F.struct(F.lit(False).alias("done"), merged.alias("p"))
            )

        return F.when(state["done"] | (F.size(p) < 2), state).otherwise(_let(found, merge))

    def pieces(w: Column) -> Column:
        n = F.octet_length(w)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(1)))
        start = F.struct(F.lit(False).alias("done"), single.alias("p"))
        return F.transform(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["p"]), ranks.get)

    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(
        _let(word, lambda w: F.coalesce(F.when(ranks.get(w).isNotNull(), F.array(ranks.get(w))), pieces(w)))
    )


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


class Encoder:
    """Encodes string columns; made once for a corpus."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.vocabulary = vocabulary(path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken"))
        self.ranks = HashMap(spark, "ranks", list(self.vocabulary), list(self.vocabulary.values()), T.IntegerType())
        self.known: HashMap | None = None

    def learn(self, df: DataFrame, column: str = "text", size: int = DICTIONARY) -> Encoder:
        """Fold the corpus's most frequent words, counted over all rows, into the dictionary."""
        counted = df.select(F.explode(words_of(column)).alias("word")).groupBy("word").count()
        often = counted.where("count > 1").orderBy(F.desc("count"), "word").limit(size).select("word")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few small words are not put into one task
        folded = often.repartition(parts, "word").select("word", fold(F.col("word").cast("binary"), self.ranks).alias("ids"))
        rows = folded.collect()  # at most ``size`` words
        self.known = HashMap(self.spark, "words", [r.word.encode() for r in rows], [r.ids for r in rows], T.ArrayType(T.IntegerType()))
        return self

    def encode(self, text: Column | str) -> Column:
        """Token ids without special tokens; null and empty texts give an empty list."""
        own = lambda w: fold(w.cast("binary"), self.ranks)
        each = own if self.known is None else (lambda w: F.coalesce(self.known.get(w), own(w)))
        return F.coalesce(F.flatten(F.transform(words_of(text), each)), F.array().cast("array<int>"))

    def decode(self, ids: Column | str) -> Column:
        """The bytes of token ids, as a string: binary pieces in a row; invalid UTF-8 is replaced."""
        tokens = [b""] * (max(self.vocabulary.values()) + 1)
        for token, rank in self.vocabulary.items():
            tokens[rank] = token
        name = f"tokens_{uuid.uuid4().hex[:8]}"
        view = f"loomlake_{uuid.uuid4().hex}"
        self.spark.createDataFrame([([bytearray(t) for t in tokens],)], "held array<binary>").createOrReplaceTempView(view)
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} array<binary>")
        self.spark.sql(f"SET VAR {name} = (SELECT held FROM {view})")
        joined = F.aggregate(ids, F.lit(b"").cast("binary"), lambda a, i: F.concat(a, F.get(F.expr(name), i)))
        return F.decode(joined, "UTF-8")


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every document by byte_bpe_50k.

    Strings that look like special tokens are ordinary text; null and empty texts give an empty
    list; every row keeps its own result, repeated ids included; no rows give none.
    """
    encoder = Encoder(documents.sparkSession, path).learn(documents, text)
    return documents.select(key, encoder.encode(text).alias("ids"))
