"""Packing texts into containers of a fixed number of tokens (problem 9).

Texts over the capacity are cut into full containers and a rest.  The rest of the items is spread
over blocks of bounded size by a hash of their id, so that no task holds more than a block; a
block is packed best fit first and then improved by local search: items are moved, exchanged one
for one or two for one between underfull containers while that raises the sum of squared fills, so
that the emptier ones run empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.workspace import stored

#: Tokens of a container, as TESTDATA.md gives them for this problem.
CAPACITY = 2048
#: Items that are packed together; loss at a block's end is at most one underfull container.
BLOCK = 8192


def best_fit(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Containers of item indices: largest items first, each into the fullest container with room."""
    sizes = np.asarray(sizes, np.int64)
    room: list[tuple[int, int]] = []  # (free, container), sorted
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            insort(room, (free - size, b))
    return bins


def exchange(sizes: np.ndarray, place: np.ndarray, fill: np.ndarray, source: int, mine: np.ndarray, capacity: int) -> tuple[int, np.ndarray, int, int] | None:
    """The move between ``source`` and a container at least as full that raises the sum of squared
    fills most: (load, items out of source, container, item coming back or -1); None if none does.

    One or two items leave, and none or one comes back.  For every item of every container the
    largest sum of one or two of the source's items that its place and the gap hold is looked up.
    """
    own = sizes[mine]
    first, second = np.triu_indices(len(mine), 1)
    sums = np.r_[own, own[first] + own[second]]
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    open_to = (fill >= fill[source]) & (fill < capacity)
    open_to[source] = False
    bins = np.flatnonzero(open_to)
    theirs = np.flatnonzero(open_to[place])
    at = np.r_[place[theirs], bins]
    back = np.r_[sizes[theirs], np.zeros(len(bins), np.int64)]
    pick = np.searchsorted(sums, back + capacity - fill[at], side="right") - 1
    load = np.where(pick >= 0, sums[pick], 0) - back
    raised = np.where(load > 0, load * (load + fill[at] - fill[source]), 0)
    if not len(raised) or not raised.max():
        return None
    best = int(np.argmax(raised))
    chosen = int(order[pick[best]])
    out = mine[[chosen]] if chosen < len(mine) else mine[[first[chosen - len(mine)], second[chosen - len(mine)]]]
    return int(load[best]), out, int(at[best]), int(theirs[best]) if best < len(theirs) else -1


def improve(bins: list[list[int]], sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Local search between underfull containers.

    Each step moves load from a container to a fuller one, which raises the sum of squared fills, so
    it ends: when no exchange of any container raises it, or no packing has fewer containers.
    """
    sizes = np.asarray(sizes if isinstance(sizes, np.ndarray) else list(sizes), np.int64)
    least = -(-int(sizes.sum()) // capacity)
    place = np.empty(len(sizes), np.int64)
    for n, b in enumerate(bins):
        place[b] = n
    fill = np.bincount(place, sizes, len(bins)).astype(np.int64) if len(sizes) else np.zeros(len(bins), np.int64)
    held = [set(b) for b in bins]
    left, moved = int(np.count_nonzero(fill)), True
    while moved and left > least:
        moved = False
        for source in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[source] < capacity and left > least:
                step = exchange(sizes, place, fill, source, np.fromiter(sorted(held[source]), np.int64), capacity)
                if step is None:
                    break
                load, out, target, back = step
                for i in out.tolist():
                    held[source].remove(i)
                    held[target].add(i)
                place[out] = target
                if back >= 0:
                    held[target].remove(back)
                    held[source].add(back)
                    place[back] = source
                fill[source] -= load
                fill[target] += load
                moved = True
                left -= not fill[source]
    kept = [sorted(b) for b, f in zip(held, fill.tolist(), strict=True) if f]
    none = [i for b, f in zip(held, fill.tolist(), strict=True) if not f for i in b]  # items without any size
    if none and not kept:
        kept.append([])
    if none:
        kept[-1] += none
    return kept


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("key", "ascending"), ("piece", "ascending")])
        sizes = rows.column("size").to_numpy()
        at = np.empty(len(sizes), np.int64)
        for n, b in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
            at[b] = n
        return pa.table({"key": rows.column("key"), "piece": rows.column("piece"), "size": rows.column("size"), "block": rows.column("block"), "slot": at})

    return run


def packed(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(key, piece, start, size, container): the container of every item or piece.

    Only items above ``capacity`` are cut, into full containers and a rest; no container holds
    more than ``capacity``; items of size 0, or null as 0, get a container too.  Repeated keys are
    separate items; an empty table gives no rows; other columns are ignored.
    """
    whole = stored(items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("total")), "sizes")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / capacity).cast("int") - 1))))
    pieces = pieces.select("key", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long").alias("size"))
    full = pieces.where(F.col("size") == capacity)
    rest = pieces.where(F.col("size") < capacity)
    blocks = max(1, -(-rest.count() // block))
    spread = rest.withColumn("block", F.pmod(F.xxhash64("key", "piece", "size"), F.lit(blocks)))
    kind = items.schema[key].dataType.simpleString()
    done = spread.groupBy("block").applyInArrow(_pack(capacity), f"key {kind}, piece int, size long, block long, slot long")
    alone = full.select("key", "piece", "size", F.concat_ws("-", F.lit("full"), F.col("key").cast("string"), "piece").alias("container"))
    together = done.select("key", "piece", "size", F.concat_ws("-", F.lit("block"), "block", "slot").alias("container"))
    return alone.union(together).select("key", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), "size", "container")
