"""Evaluation items inside training messages (problem 4).

Items and messages meet over a table of seeds: pairs of neighbouring words of an item, which a
message may hold with one word between them, and whole runs of ``RUN`` words.  The messages of train
are read once for them; a field of an item is then sought by its rarer seeds, as the messages' own
counts tell, and Smith-Waterman scores every pair that shares enough of them.  No alignment that
reaches ``SHARE`` can share fewer, so all edited copies are found, and an exact test of ``RUN``
consecutive words follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.texts import MIX, U64, grams, hashed, mix, split_of, words
from loomlake.workspace import BROADCAST_LIMIT, small, stored

#: Consecutive words that make a leak, as TESTDATA.md gives them for this problem.
RUN = 13
#: Smith-Waterman scores: equal words, different words, a gap; least share of a perfect score.
EQUAL, DIFFERENT, GAP, SHARE = 2, -1, -1, 0.5
STEP = 2000
#: Cells of alignments that are held at a time.
CELLS, TOGETHER = 500_000, 50_000


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of two word arrays, and where it ends in ``a``.  One row at a time; gaps
    along a row come from a running maximum."""
    slope = np.arange(len(b) + 1) * GAP
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for i, w in enumerate(a):
        fresh = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(b == w, EQUAL, DIFFERENT), row[1:] + GAP, out=fresh[1:])
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh - slope) + slope
        top = int(row.max())
        if top > best:
            best, end = top, i
    return best, end


def common_run(a: list[str], b: list[str], n: int) -> bool:
    """Do both hold the same ``n`` consecutive words?"""
    there = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in there for i in range(len(a) - n + 1))


def local_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best score of ``smith_waterman`` for each pair (message, field), many pairs at a time."""
    scores = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    begin = 0
    while begin < len(order):
        wide, long, part = len(pairs[order[begin]][1]), 0, []
        for i in order[begin : begin + max(1, TOGETHER // wide)]:
            long = max(long, len(pairs[i][0]))
            if part and (len(pairs[i][1]) > 1.25 * wide or (len(part) + 1) * long > CELLS):
                break
            part.append(i)
        begin += len(part)
        n, wide, long = len(part), max(len(pairs[i][1]) for i in part), max(len(pairs[i][0]) for i in part)
        a, b = np.full((long, n), -1, np.int32), np.full((n, wide), -2, np.int32)  # the fillings equal nothing
        for k, i in enumerate(part):
            a[: len(pairs[i][0]), k], b[k, : len(pairs[i][1])] = pairs[i]
        slope = np.arange(wide + 1, dtype=np.int32) * np.int32(GAP)
        row, best = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
        for w in a:
            fresh = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(b == w[:, None], np.int32(EQUAL), np.int32(DIFFERENT)), row[:, 1:] + np.int32(GAP), out=fresh[:, 1:])
            np.maximum(fresh, 0, out=fresh)
            row = np.maximum.accumulate(fresh - slope, axis=1) + slope
            np.maximum(best, row, out=best)
        scores[part] = best.max(axis=1)
    return scores


FIELDS = "item_id string, field string, text string, seeds array<long>, runs array<long>"


def shared_pairs(n: int) -> int:
    """Neighbouring words of a field of ``n`` words that an alignment reaching SHARE keeps at least,
    next to each other or with one word between them.

    With d words of the field unmatched and g gaps of two or more words the score is at most
    2 (n - d) - d - 2 g, which is at least n only if d <= n / 3 and g <= (n - 3 d) / 2; and at most
    2 d + g <= 2 n / 3 of the n - 1 pairs are broken.  (For the scores and the share fixed here.)
    """
    return max(1, -(-n // 3) - 1)


def _pairs(flat: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the words ``step`` places apart in one text."""
    n = max(len(flat) - step, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[:n] == owner[step:]
    x = mix(mix(flat[:n] + U64(1)) * U64(MIX[0]) + flat[step:])
    return x[inside].view(np.int64), owner[:n][inside]


def _lists(x: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32), pa.array(x))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields with at least one run, with the hashes of their pairs of words and of their runs."""
    for batch in batches:
        batch = batch.filter(pa.array([len(words(t)) >= RUN for t in batch.column(2).to_pylist()], pa.bool_()))
        flat, counts = hashed(batch.column(2).to_pylist())
        with np.errstate(over="ignore"):
            near, (x, owner, _) = _pairs(flat, counts, 1), grams(flat, counts, RUN)
        lists = [_lists(*near, batch.num_rows), _lists(x.view(np.int64), owner, batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], names=["item_id", "field", "text", "seeds", "runs"])


HITS = "sample_id string, msg_index long, text string, seeds array<long>"


def _meet(wanted: np.ndarray | None):
    """Messages that hold a wanted seed, and their different wanted seeds; all seeds if none are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                flat, counts = hashed(part.column(2).to_pylist())
                with np.errstate(over="ignore"):
                    near, apart, (x, owner, _) = _pairs(flat, counts, 1), _pairs(flat, counts, 2), grams(flat, counts, RUN)
                x, owner = np.r_[near[0], apart[0], x.view(np.int64)], np.r_[near[1], apart[1], owner]
                if wanted is not None:
                    place = np.searchsorted(wanted, x)
                    place[place == len(wanted)] = 0
                    hit = wanted[place] == x
                    x, owner = x[hit], owner[hit]
                order = np.lexsort((x, owner))
                x, owner = x[order], owner[order]
                if not len(x):
                    continue
                fresh = np.r_[True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])]
                x, owner = x[fresh], owner[fresh]
                rows, owner = np.unique(owner, return_inverse=True)
                held = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(held.column(i) for i in range(3)), _lists(x, owner, len(rows))], names=["sample_id", "msg_index", "text", "seeds"])

    return run


LEAKS = "item_id string, field string, sample_id string, msg_index long, score long, share double, exact boolean"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, field, sample_id, msg_index, asked, text) -> the alignments that count."""
    names = [f.split()[0] for f in LEAKS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            ids: dict[str, int] = {}
            cut = {t: words(t) for i in (4, 5) for t in part.column(i).unique().to_pylist()}
            coded = {t: np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)) for t, ws in cut.items()}
            asked, texts = part.column(4).to_pylist(), part.column(5).to_pylist()
            scores = local_scores([(coded[t], coded[q]) for q, t in zip(asked, texts, strict=True)])
            share = scores / np.fromiter((EQUAL * len(cut[q]) for q in asked), np.int64, len(asked))
            exact = np.fromiter((s >= EQUAL * RUN and common_run(cut[t], cut[q], RUN) for q, t, s in zip(asked, texts, scores.tolist(), strict=True)), bool, len(asked))
            keep = pa.array(exact | (share >= SHARE))
            columns = [part.column(i) for i in range(4)] + [pa.array(scores), pa.array(share), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)


def sought(fields: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, field, seed, weight, least): the seeds by which each field is sought, by the number
    of messages that hold them, and the least sum of weights that makes a message a candidate.

    A field's most frequent pairs, half as many as an alignment must keep, are left out, and the rest
    of those kept is asked for; a run of RUN words suffices by itself.
    """
    near = fields.select("item_id", "field", F.size("seeds").alias("pairs"), F.posexplode("seeds").alias("at", "seed"))
    least = F.greatest(F.lit(1), F.ceil((F.col("pairs") + 1) / 3) - 1)  # as ``shared_pairs`` has it
    ranked = near.join(small(counts, 64), "seed", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "field").orderBy(F.desc_nulls_last("n"), "at")))
    left = F.floor(least / 2)
    kept = ranked.where((F.col("rank") > left) & F.col("n").isNotNull()).groupBy("item_id", "field", "seed", (least - left).alias("least")).agg(F.count("*").alias("weight"))
    runs = fields.select("item_id", "field", F.explode(F.array_distinct("runs")).alias("seed")).select("item_id", "field", "seed", F.lit(1 << 30).alias("weight"), F.lit(1).alias("least"))
    return kept.select("item_id", "field", "seed", "weight", "least").union(runs)


def leaks(samples: DataFrame, items: DataFrame, split_rows: DataFrame) -> DataFrame:
    """(item_id, field, sample_id, msg_index, score, share, exact): alignments of items with
    messages, of any role, of samples in train.

    ``exact`` marks RUN consecutive words in common.  Other rows reach ``SHARE`` of the best possible
    score: edited copies.  All of both are found.  Items with fewer than RUN words in a field, null ids and null contents give
    none; redelivered rows count once; empty tables give no rows; other columns are ignored.
    """
    asked = items.where("item_id IS NOT NULL").select("item_id", F.explode(F.create_map(F.lit("question"), F.col("question"), F.lit("answer"), F.col("answer"))).alias("field", "text"))
    fields = stored(asked.where("text IS NOT NULL").distinct().mapInArrow(_cut, FIELDS), "fields")
    wanted = fields.select(F.explode(F.concat("seeds", "runs")).alias("seed")).distinct()
    most = BROADCAST_LIMIT // 8
    some = wanted.limit(most + 1).toPandas()["seed"].to_numpy()  # a filter of bounded size, used only if it holds all seeds
    if not len(some):
        return samples.sparkSession.createDataFrame([], LEAKS)
    train = small(stored(split_of(split_rows).where("split = 'train'").select("sample_id"), "train"), 120)
    at = samples.where("sample_id IS NOT NULL").select("sample_id", "messages").join(train, "sample_id", "left_semi").select("sample_id", F.posexplode("messages").alias("i", "m"))
    messages = at.where("m.content IS NOT NULL").select("sample_id", F.col("i").cast("long").alias("msg_index"), F.col("m.content").alias("text"))
    hits = stored(messages.mapInArrow(_meet(np.sort(some) if len(some) <= most else None), HITS), "hits")
    met = hits.select("sample_id", "msg_index", F.explode("seeds").alias("seed"))
    counts = stored(met.groupBy("seed").agg(F.count("*").alias("n")).join(small(stored(wanted, "wanted"), 64), "seed", "left_semi"), "counts")
    chosen = small(stored(sought(fields, counts), "sought"), 160)
    shared = met.join(chosen, "seed").groupBy("item_id", "field", "sample_id", "msg_index").agg(F.sum("weight").alias("weight"), F.max("least").alias("least"))
    pairs = stored(shared.where(F.col("weight") >= F.col("least")).drop("weight", "least"), "candidates")
    both = pairs.join(small(fields.select("item_id", "field", F.col("text").alias("asked")), 2000), ["item_id", "field"]).join(
        hits.select("sample_id", "msg_index", "text"), ["sample_id", "msg_index"]
    )
    scored = both.select("item_id", "field", "sample_id", "msg_index", "asked", "text").mapInArrow(_score, LEAKS)
    return scored.dropDuplicates(["item_id", "field", "sample_id", "msg_index"])
