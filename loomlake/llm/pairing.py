"""Candidate pairs from shared keys without cross joins, and their exact verification.

Records with the same set of word sequences are one node (``fp``), so groups of copies cost one
row per scanning task.  A key's bucket of at most ``CAP`` nodes gives all its pairs; a larger one
is named and compared block by block on bit sketches, so nothing is dropped to escape skew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.texts import sample_text, shingles
from loomlake.workspace import small, stored

#: Nodes of one bucket whose pairs are all given directly.
CAP = 48
#: Rows of one side of a block of a larger bucket.
BLOCK = 1024


def texts_of(samples: DataFrame) -> DataFrame:
    """(sample_id, text): every row with an id; redelivered rows repeat."""
    return samples.where("sample_id IS NOT NULL").select("sample_id", sample_text().alias("text"))


def set_print(owner: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """An order-free 64-bit print of each text's set of sequences."""
    from loomlake.llm.texts import U64, mix

    size = np.diff(np.r_[starts, len(x)]).astype(U64)
    return mix(np.add.reduceat(mix(x), starts) + mix(size)).view(np.int64)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def bucket_pairs(batches: Iterator[pa.RecordBatch], cap: int = CAP, star: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both -> pairs (a, b, false); for a bucket of more than ``cap``
    nodes a row (key, size, true) and, with ``star``, each node's pair with the first one.

    Holds at most ``cap`` nodes of the bucket at hand.
    """
    carry_key, carry, first, size, last = None, np.empty(0, np.int64), 0, 0, 0

    def batch(a, b, hot):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot))], schema=PAIRS)

    def flush():
        if carry_key is None:
            return
        if size > cap:
            yield batch(np.array([carry_key]), np.array([size]), True)
        elif size > 1:
            i, j = np.triu_indices(size, 1)
            yield batch(carry[i], carry[j], False)

    for rows in batches:
        key, fp = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        if carry_key is not None and key[0] == carry_key and fp[0] == last:
            new[0] = False
        key, fp = key[new], fp[new]
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        last = fp[-1]
        begin = 0
        if key[0] == carry_key:  # the bucket of the last batch goes on
            more = fp[: ends[0]]
            if size + len(more) > cap:
                if star:
                    part = more if size > cap else np.r_[carry[1:], more]
                    yield batch(np.full(len(part), first), part, False)
            else:
                carry = np.r_[carry, more]
            size += len(more)
            begin = 1
        if begin == len(starts):
            continue
        yield from flush()
        lengths = ends - starts
        done = np.arange(begin, len(starts) - 1)
        for lag in range(1, min(cap, int(lengths[done].max(initial=1)))):
            run = np.zeros(len(key), bool)
            for s in done[(lengths[done] > lag) & (lengths[done] <= cap)] if lag > 3 else ():
                run[starts[s] : ends[s] - lag] = True
            if lag <= 3:
                size_at = np.repeat(lengths, lengths)
                run[:-lag] = (key[lag:] == key[:-lag]) & (size_at[:-lag] <= cap)
                run[: starts[begin]] = False
                run[starts[-1] :] = False
            at = np.flatnonzero(run)
            if len(at):
                yield batch(fp[at], fp[at + lag], False)
        for s in done[lengths[done] > cap]:
            part = fp[starts[s] : ends[s]]
            yield batch(np.array([key[starts[s]]]), np.array([len(part)]), True)
            if star:
                yield batch(np.full(len(part) - 1, part[0]), part[1:], False)
        tail = fp[starts[-1] :]
        carry_key, first, size = key[-1], tail[0], len(tail)
        carry = tail[:cap]
        if size > cap and star:
            yield batch(np.full(size - 1, first), tail[1:], False)
    yield from flush()


def keyed_pairs(keyed: DataFrame, name: str, cap: int = CAP, star: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key long, fp long) -> stored distinct pairs (a < b), and the (key, size) of larger buckets."""
    rows = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(rows.mapInArrow(lambda it: bucket_pairs(it, cap, star), "a long, b long, hot boolean"), name)
    pairs = found.where("NOT hot").select("a", "b").distinct()
    return pairs, found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("size"))


CROSS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def cross_pairs(batches: Iterator[pa.RecordBatch], least: float = 0.0, limit: int = CAP * CAP) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, fp, n) sorted by the first three -> different pairs (a < b, false) of a node of
    either side of a key, whose sizes ``n`` differ by no more than the factor ``least``; for a key
    with more than ``limit`` of them, whatever their sizes, a row (key, number, true) instead.

    Repeated rows count once.  Holds a batch, and of a key that goes on behind it as many rows as can
    still give pairs.
    """
    held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int32)]
    more = np.zeros(2, np.int64)  # rows of the held key that are only counted, by side
    last: list = []

    def give(key, side, fp, n, extra):
        """Pairs of whole keys, from different rows; ``extra`` counts further rows of the last one."""
        n = n.astype(np.float64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        right = np.add.reduceat(side.astype(np.int64), start)
        left = size - right
        total = left * right
        total[-1] = (left[-1] + extra[0]) * (right[-1] + extra[1])
        hot = total > limit
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[start[hot]]), pa.array(total[hot]), pa.array(np.ones(hot.sum(), bool))], schema=CROSS)
        use = np.flatnonzero(~hot & (total > 0))
        at = 0
        while at < len(use):  # so many keys that their pairs fit
            upto = at + max(1, int(np.searchsorted(np.cumsum(total[use[at:]]), 1 << 20)))
            part = use[at:upto]
            at = upto
            many = total[part]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            s, l, r = (np.repeat(x[part], many) for x in (start, left, right))
            x, y = s + nth // r, s + l + nth % r
            near = (fp[x] != fp[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9)
            x, y = fp[x[near]], fp[y[near]]
            two = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
            order = np.lexsort((two[:, 1], two[:, 0]))
            two = two[order]
            two = two[np.r_[True, (two[1:] != two[:-1]).any(axis=1)][: len(two)]]
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(np.zeros(len(two), bool))], schema=CROSS)

    for rows in batches:
        if not rows.num_rows:
            continue
        now = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        new = np.r_[[x[0] for x in now[:3]] != last, np.any([x[1:] != x[:-1] for x in now[:3]], axis=0)]
        last = [x[-1] for x in now[:3]]
        now = [x[new] for x in now]
        if not len(now[0]):
            continue
        own = int((now[0] == held[0][0]).sum()) if len(held[0]) else 0
        if len(held[0]) and own < len(now[0]):  # the held key ends in this batch
            yield from give(*(np.r_[x, y[:own]] for x, y in zip(held, now, strict=True)), more)
            held, more, now = [x[:0] for x in held], np.zeros(2, np.int64), [x[own:] for x in now]
        both = [np.r_[x, y] for x, y in zip(held, now, strict=True)]
        cut = len(both[0]) - int((both[0] == both[0][-1]).sum())
        if cut:
            yield from give(*(x[:cut] for x in both), np.zeros(2, np.int64))
        held = [x[cut:] for x in both]
        for s in (0, 1):  # of either side no more rows than a key below the limit can have
            of = np.flatnonzero(held[1] == bool(s))
            if len(of) > limit + 1:
                gone = of[limit + 1 :]
                more[s] += len(gone)
                held = [np.delete(x, gone) for x in held]
    if len(held[0]):
        yield from give(*held, more)


def sided_pairs(keyed: DataFrame, name: str, least: float, limit: int = CAP * CAP) -> tuple[DataFrame, DataFrame]:
    """(key long, side boolean, fp long, n int) -> stored pairs (a < b) of a node of either side, which
    may repeat, and the keys (key, size) with more than ``limit`` of them."""
    rows = keyed.select("key", "side", "fp", "n").repartition("key").sortWithinPartitions("key", "side", "fp")
    found = stored(rows.mapInArrow(lambda it: cross_pairs(it, least, limit), "a long, b long, hot boolean"), name)
    return found.where("NOT hot").select("a", "b"), found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("size"))


def _blocks(word_count: int, differ):
    """The rows of one block pair -> pairs that the sketch lets through."""

    def compare(rows: pa.Table) -> pa.Table:
        of = rows.column("left").to_numpy()
        left, right = (rows.filter(pa.array(m)) for m in (of, ~of))
        a, b = (t.column("fp").to_numpy() for t in (left, right))
        ca, cb = (t.column("label").to_numpy() for t in (left, right))
        na, nb = (t.column("n").to_numpy() for t in (left, right))
        wa, wb = ([t.column(f"s{i}").to_numpy().view(np.uint64) for i in range(word_count)] for t in (left, right))
        keep = (ca[:, None] != cb[None, :]) & (a[:, None] != b[None, :])
        i, j = np.nonzero(keep & differ(wa, wb, na, nb))
        return pa.table({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    return compare


def block_pairs(members: DataFrame, left: DataFrame, word_count: int, differ) -> DataFrame:
    """Pairs between ``left`` and ``members`` (key, fp, label, n, s0..) of one key, by blocks.

    A pair needs different labels; ``differ(wa, wb, na, nb)`` gives the matrix of pairs to keep.
    """
    blocks = lambda name: F.ceil(F.count("*") / BLOCK).cast("int").alias(name)
    counts = members.groupBy("key").agg(blocks("nm")).join(left.groupBy("key").agg(blocks("nl")), "key")
    counts = small(stored(counts, "blocks"), 96)
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "mb", "lb", "left", "fp", "label", "n", *(f"s{i}" for i in range(word_count))]
    m = members.join(counts, "key").withColumn("mb", at("nm")).withColumn("lb", each("nl")).withColumn("left", F.lit(False))
    x = left.join(counts, "key").withColumn("lb", at("nl")).withColumn("mb", each("nm")).withColumn("left", F.lit(True))
    rows = m.select(columns).union(x.select(columns))
    return rows.groupBy("key", "mb", "lb").applyInArrow(_blocks(word_count, differ), "a long, b long").distinct()


def popcount(words: int, left: str = "a", right: str = "b", op=lambda x, y: x.bitwiseXOR(y)) -> Column:
    """Number of set bits of ``op`` over the sketch columns s0.. of two sides."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(op(F.col(f"{left}.s{i}"), F.col(f"{right}.s{i}")))
    return total


def with_texts(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """pairs (a, b, ...) of fps -> the same with ``ta`` and ``tb``, the texts of a record of each.

    ``nodes`` has (fp, rep): the record that stands for a node.
    """
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.select("fp", "rep").join(ends, "fp"), f"{name}-ends")
    got = texts.join(small(wanted.withColumnRenamed("rep", "sample_id"), 160), "sample_id").select("fp", "text")
    got = stored(got.dropDuplicates(["fp"]), f"{name}-texts")
    return pairs.join(got.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(
        got.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b"
    )


#: A worker's memory of sequence sets: a text of many pairs is cut once.
_cut = lru_cache(4096)(shingles)


def similarity(a: str, b: str, k: int) -> float:
    """Sequences in both texts divided by sequences in either; 0 where neither has one."""
    x, y = _cut(a, k), _cut(b, k)
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared) if x or y else 0.0
