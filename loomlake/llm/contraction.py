"""Connected components by Boruvka-style contraction of minimum edges.

Every round each component picks its smallest edge under one total order of all edges, so the
picked edges form a forest whose only cycles are pairs picking the same edge.  Pointer jumping
finds the roots, components and edges are renamed, and edges inside a component fall away.  At
least half of the components with edges vanish per round.  Each round ends in stored tables, so
the plan does not grow and a lost executor costs one stage.  Once at most ``SMALL`` edges between
components are left, counted, the same rounds go on over arrays in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.workspace import Scope, small, stored

#: Edges that one task contracts (some 100 MB of arrays); their number is counted before.
SMALL = 1 << 19


def rounds(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(root of each of ``n`` components, picked edges) of edges a-b given in their total order: the
    rounds of the contraction over arrays."""
    root, picked = np.arange(n), np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        x, y = root[a[live]], root[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return root, picked
        first = np.full(n, len(live))
        np.minimum.at(first, x, np.arange(len(live)))
        np.minimum.at(first, y, np.arange(len(live)))
        some = np.flatnonzero(first < len(live))
        edge = first[some]
        picked[live[edge]] = True
        up = np.arange(n)
        up[some] = np.where(x[edge] == some, y[edge], x[edge])
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)  # two that picked each other: the smaller one is the root
        up[both] = np.flatnonzero(both)
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b, h, u, v) -> rows (c, root, null, null) of components and (null, null, u, v) of picked edges."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    names, code = np.unique(np.concatenate([t.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
    ends = np.unique(np.concatenate([t.column(i).to_numpy() for i in (3, 4)]), return_inverse=True)[1].reshape(2, -1)
    a, b = code.reshape(2, -1)
    order = np.lexsort((ends[1], ends[0], t.column(2).to_numpy()))
    root, picked = rounds(a[order], b[order], len(names))
    kind = t.schema.field(0).type
    tree = t.take(pa.array(order[picked]))
    yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[root], kind), pa.nulls(len(names), kind), pa.nulls(len(names), kind)], names=["c", "p", "u", "v"])
    yield pa.RecordBatch.from_arrays([pa.nulls(tree.num_rows, kind)] * 2 + [tree.column(i).combine_chunks() for i in (3, 4)], names=["c", "p", "u", "v"])


def _roots(parents: DataFrame) -> DataFrame:
    """(c, p) -> (c, root) by repeated halving of the paths."""
    up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    # two components that picked each other: the smaller one becomes the root
    now = stored(
        parents.join(up, "p").select("c", F.when(F.col("pp") == F.col("c"), F.least("c", "p")).otherwise(F.col("p")).alias("p")),
        "parents",
    )
    while True:
        up = now.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        after = stored(now.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def spanning_forest(edges: DataFrame, most: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(u, v) -> labels (node, root) of all nodes with an edge, and the forest's edges (u, v).

    Loops, repeated and reversed edges are allowed; an edge with a null end is ignored.  Both
    results are stored tables; an empty input gives empty tables.
    """
    with Scope(edges.sparkSession) as scope:
        labels, forest = _spanning_forest(edges, most)
        return scope.keep(labels), scope.keep(stored(forest, "forest"))


def _spanning_forest(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    pair = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    live = stored(
        pair.distinct().select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.xxhash64("u", "v").alias("h"), "u", "v").alias("w")),
        "edges",
    )
    ends = [live.select(F.col(x).alias("node")) for x in ("a", "b")]
    labels = ends[0].union(ends[1]).distinct().select("node", F.col("node").alias("root"))
    labels = stored(labels, "labels")
    forest = spark.createDataFrame([], live.select("w.u", "w.v").schema)
    while not live.isEmpty():
        if live.limit(most + 1).count() <= most:
            name = kind.simpleString()
            rows = live.select("a", "b", "w.h", "w.u", "w.v").coalesce(1).mapInArrow(_contract, f"c {name}, p {name}, u {name}, v {name}")
            made = stored(rows, "contracted")
            forest = forest.union(made.where("u IS NOT NULL").select("u", "v"))
            named = small(made.where("c IS NOT NULL").select(F.col("c").alias("root"), "p"), 192)
            labels = stored(labels.join(named, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
            break
        both = live.select(F.col("a").alias("c"), F.col("b").alias("other"), "w").union(live.select("b", "a", "w"))
        picked = stored(both.groupBy("c").agg(F.min(F.struct("w", "other")).alias("m")).select("c", F.col("m.other").alias("p"), "m.w"), "picked")
        forest = forest.union(picked.select("w.u", "w.v"))
        roots = _roots(picked.select("c", "p"))
        named = small(roots, 192)
        labels = stored(
            labels.join(named.select(F.col("c").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels"
        )
        live = stored(
            live.join(named.select(F.col("c").alias("a"), F.col("p").alias("ra")), "a")
            .join(named.select(F.col("c").alias("b"), F.col("p").alias("rb")), "b")
            .where("ra <> rb")
            .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .agg(F.min("w").alias("w")),
            "edges",
        )
    assert labels.schema["node"].dataType == kind
    return labels, forest.distinct()
