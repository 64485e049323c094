"""Groups of samples that differ by small edits (problem 6).

MinHash values of the three-word sequences form band keys (candidates) and, folded by parity into
an odd sketch, a bitmap whose XOR population count estimates the share of different sequences;
candidates whose sketches are too far apart are dropped, the rest are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import pairing
from loomlake.llm.contraction import spanning_forest
from loomlake.llm.texts import U64, distinct_grams, hashed, mix
from loomlake.workspace import Scope, small, stored

#: Words of a sequence and the least similarity, as TESTDATA.md gives them for this problem.
SEQUENCE, SIMILARITY = 3, 0.6
#: A pair at the threshold shares a band with probability 1 - (1 - 0.6 ** ROWS) ** BANDS = 0.989, one at 0.7 with 0.99997.
BANDS, ROWS = 56, 5
#: Bits of the odd sketch, in 64-bit words.
WORDS = 8
#: Texts handled at once by a worker.
STEP = 1000


def odd_limit(threshold: float, samples: int = BANDS * ROWS, bits: int = WORDS * 64, deviations: float = 3.5) -> int:
    """The XOR population count that a pair at ``threshold`` stays under, but for a chance of that
    many standard deviations (2e-4)."""
    m = 2 * samples * (1 - threshold)
    decay = (1 - 2 / bits) ** m
    spread = bits / 4 * (1 - decay**2) + decay**2 * 4 * samples * threshold * (1 - threshold)
    return math.ceil(bits / 2 * (1 - decay) + deviations * math.sqrt(spread))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, 2 * n + 1, dtype=U64))
    return (x[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> U64(32)).astype(np.uint32)


def sketches(x: np.ndarray, starts: np.ndarray, bands: int, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x words) of sequence sets."""
    n, low = len(starts), (x >> U64(32)).astype(np.uint32)
    mul, add = _permutations(bands * rows)
    keys, bits = np.empty((n, bands), np.int64), np.zeros((n, words * 64), bool)
    every = np.arange(n)
    key = np.zeros(n, U64)
    for i in range(bands * rows):
        h = low * mul[i] + add[i]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        least = np.minimum.reduceat(h, starts).astype(U64)
        tagged = mix(least + (U64(i + 1) << U64(32)))
        at = (tagged % U64(words * 64)).astype(np.int64)
        bits[every, at] ^= True
        key = mix(key + tagged)
        if i % rows == rows - 1:
            keys[:, i // rows] = key.view(np.int64)
            key = np.zeros(n, U64)
    return keys, np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            with np.errstate(over="ignore"):
                flat, counts = hashed(part.column(1).to_pylist())
                owner, x = distinct_grams(flat, counts, SEQUENCE)
                if not len(x):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                fp = pairing.set_print(owner, x, starts)
                if len(seen) > 1 << 20:  # only spares work
                    seen.clear()
                lead = np.fromiter((f not in seen and not seen.add(f) for f in fp.tolist()), bool, len(fp))
                size = np.diff(np.r_[starts, len(x)])
                pick = np.flatnonzero(lead)
                keys = np.empty((len(fp), BANDS), np.int64)
                marks = np.zeros((len(fp), WORDS), np.int64)
                if len(pick):  # a set that this task has had needs no keys again
                    inside = np.repeat(lead, size)
                    cut = np.r_[0, np.cumsum(size[pick])[:-1]]
                    keys[pick], marks[pick] = sketches(x[inside], cut, BANDS, ROWS, WORDS)
            offsets = np.r_[0, np.cumsum(lead * BANDS)].astype(np.int32)
            columns = [part.column(0).take(pa.array(owner[starts])), pa.array(fp), pa.array(lead), pa.array(size.astype(np.int32))]
            columns.append(pa.ListArray.from_arrays(offsets, keys[pick].ravel()))
            columns += [pa.array(np.ascontiguousarray(marks[:, i])) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "fp", "lead", "n", "bands", *(f"s{i}" for i in range(WORDS))])


SIGNATURE = "sample_id string, fp long, lead boolean, n int, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def _far(limit: int):
    def differ(wa, wb, na, nb):
        total = np.zeros((len(wa[0]), len(wb[0])), np.int16)
        for x, y in zip(wa, wb, strict=True):
            total += np.bitwise_count(x[:, None] ^ y[None, :])
        return total <= limit

    return differ


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        keep = [i for i in range(len(a)) if pairing.similarity(ta[i], tb[i], SEQUENCE) >= SIMILARITY]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["u", "v"])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    sketch = [f"s{i}" for i in range(WORDS)]
    side = lambda x: nodes.select(F.col("fp").alias(x), F.struct(*sketch).alias(f"k{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(pairing.popcount(WORDS, "ka", "kb") <= limit).select("a", "b")
    near = stored(near, "near")
    return stored(pairing.with_texts(near, nodes, texts, "near").select("a", "b", "ta", "tb").mapInArrow(_exact, "u long, v long"), "links")


def near_duplicate_groups(samples: DataFrame, cap: int = pairing.CAP) -> DataFrame:
    """(sample_id, group_id, links): every sample of a group of two or more.

    Samples are joined by pairs with similarity >= 0.6, directly or through others; ``group_id``
    is the group's smallest ``sample_id``; ``links`` counts the verified links of the sample's
    text that were used to join the group, which in buckets above ``cap`` are fewer than its similar
    texts.  Copies share a node.  Redelivered rows count once; samples with a
    null id or fewer than three words belong to no group; no rows give no groups; other columns
    are ignored.  Buckets above ``cap`` are compared by blocks.
    """
    with Scope(samples.sparkSession) as scope:
        return scope.keep(stored(_groups(samples, cap), "groups"))


def _groups(samples: DataFrame, cap: int) -> DataFrame:
    texts = pairing.texts_of(samples)
    sig = stored(texts.mapInArrow(_scan, SIGNATURE), "signatures")
    lead = sig.where("lead")
    sketch = [f"s{i}" for i in range(WORDS)]
    nodes = stored(lead.select("fp", F.col("sample_id").alias("rep"), "n", *sketch).dropDuplicates(["fp"]), "nodes")
    limit = odd_limit(SIMILARITY)
    keyed = lead.select(F.explode("bands").alias("key"), "fp")
    pairs, hot = pairing.keyed_pairs(keyed, "pairs", cap)
    links = _verified(pairs, nodes, texts, limit)
    labels, _ = spanning_forest(links)
    if not hot.isEmpty():  # nodes of large buckets outside the bucket's main component, against the whole bucket
        at = keyed.join(small(hot.select("key").distinct(), 64), "key").distinct()
        marked = at.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
        marked = stored(marked.join(nodes.drop("rep"), "fp"), "large")
        main = marked.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        rest = marked.join(main, "key").where("label <> main").drop("main")
        more = _verified(pairing.block_pairs(marked, rest, WORDS, _far(limit)), nodes, texts, limit)
        links = links.union(more)
        labels, _ = spanning_forest(links)
    degree = links.select(F.col("u").alias("fp")).union(links.select("v")).groupBy("fp").agg(F.count("*").alias("links"))
    known = small(stored(labels.withColumnRenamed("node", "fp").join(degree, "fp"), "known"), 96)
    member = sig.select("sample_id", "fp").distinct().join(known, "fp", "left")
    member = stored(member.select("sample_id", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "members")
    named = member.groupBy("root").agg(F.min("sample_id").alias("group_id"), F.max("sample_id").alias("last")).where("group_id <> last").drop("last")
    named = small(stored(named, "named"), 192)
    return member.join(named, "root").groupBy("sample_id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
