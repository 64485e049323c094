"""Train, validation and test splits that keep related records together (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.contraction import spanning_forest
from loomlake.llm.texts import compared
from loomlake.workspace import small, stored

#: Groups of a size band are dealt in this many slices by a hash of their root, so that the
#: running sums that deal them stay distributed.
SLICES = 1024
#: Families that tie nothing, in compared form (fixed value).
NO_FAMILY = ("", "unknown")


def ties(samples: DataFrame, sample_id: str = "sample_id", family: str = "scenario_family", doc_ids: str = "source_doc_ids") -> DataFrame:
    """(sample_id, family, doc): one row per sample and document id, or one without a document.

    Null, empty and placeholder families and null or blank ids come out as null.
    """
    fam = compared(family)
    docs = F.filter(doc_ids, lambda d: d.isNotNull() & (F.trim(d) != ""))
    return samples.where(F.col(sample_id).isNotNull()).select(
        F.col(sample_id).alias("sample_id"), F.when(~fam.isin(*NO_FAMILY), fam).alias("family"), F.explode_outer(F.array_distinct(docs)).alias("doc")
    )


def related_groups(samples: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Groups of samples tied by a family or a document id, directly or through others.

    Returns (sample_id, group_key) for every sample of a group of two or more, and the spanning
    forest (u, v) that ties them.  ``group_key`` is the group's smallest family in compared form,
    or its smallest document id where it has none.  Redelivered rows of a sample add their ties
    to it; rows with a null id are left out; no rows give no groups.  Other columns are ignored.
    """
    tied = stored(ties(samples, **columns).distinct(), "ties")
    keys = tied.select("sample_id", F.concat(F.lit("f:"), "family").alias("key")).where("key IS NOT NULL")
    keys = stored(keys.union(tied.select("sample_id", F.concat(F.lit("d:"), "doc")).where("doc IS NOT NULL")).distinct(), "keys")
    # the smallest sample of a key stands for the key: a star instead of all pairs
    centre = keys.groupBy("key").agg(F.min("sample_id").alias("centre"), F.max("sample_id").alias("last")).where("centre <> last").drop("last")
    edges = keys.join(centre, "key").select(F.col("sample_id").alias("u"), F.col("centre").alias("v"))
    labels, forest = spanning_forest(edges)
    named = (
        tied.join(labels.withColumnRenamed("node", "sample_id"), "sample_id")
        .groupBy("root")
        .agg(F.coalesce(F.min("family"), F.min("doc")).alias("group_key"))
    )
    named = small(stored(named, "groups"), 256)
    return labels.join(named, "root").select(F.col("node").alias("sample_id"), "group_key", "root"), forest


def _fraction(column: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(SLICES)).cast("int")


def assign_splits(samples: DataFrame, targets: DataFrame, seed: int = 7, **columns: str) -> DataFrame:
    """(sample_id, group_id, split_name): every sample once, whole groups in one split.

    Samples without ties are groups of their own.  Groups are stratified by size band (powers of
    two) and handled from the largest band down; in a band the groups, in hash order, are dealt
    systematically: the middle of a group on the running sum of sizes decides its split, with the
    band cut in proportion to what each split still lacks.  ``targets`` (split_name, share) is a
    fixed, small table; shares that are null or negative count as 0.
    """
    groups, _ = related_groups(samples, **columns)
    ids = samples.where("sample_id IS NOT NULL").select("sample_id").distinct()
    member = stored(
        ids.join(groups.select("sample_id", "root"), "sample_id", "left").select("sample_id", F.coalesce("root", "sample_id").alias("group_id")), "member"
    )
    sized = member.groupBy("group_id").agg(F.count("*").alias("size"))
    sized = stored(
        sized.select("group_id", "size", F.floor(F.log2("size") + 1e-9).cast("int").alias("band"), _fraction("group_id", seed).alias("slice")), "sizes"
    )
    slices = sized.groupBy("band", "slice").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("band").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = slices.select("band", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))  # bounded: bands x slices
    inside = Window.partitionBy("band", "slice").orderBy(F.xxhash64(F.lit(seed + 1), "group_id"), "group_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(F.broadcast(offset), ["band", "slice"]).select(
        "group_id", "size", "band", (F.col("offset") + F.sum("size").over(inside) - F.col("size") / 2).alias("middle")
    )
    bands = {r.band: r.total for r in slices.groupBy("band").agg(F.sum("total").alias("total")).collect()}  # at most 63 rows
    wanted = [(r.split_name, max(float(r.share or 0), 0.0)) for r in targets.where("split_name IS NOT NULL").orderBy("split_name").collect()]
    whole, parts = sum(bands.values()), sum(s for _, s in wanted) or 1.0
    lack = {name: share / parts * whole for name, share in wanted}
    cuts: list[tuple[int, str, float, float]] = []
    for band in sorted(bands, reverse=True):
        need = {n: max(x, 0.0) for n, x in lack.items()}
        total = sum(need.values())
        at = 0.0
        for i, name in enumerate(sorted(need, key=lambda n: -need[n])):
            size = bands[band] * (need[name] / total if total else 1.0 / len(need))
            end = at + size if i + 1 < len(need) else float("inf")
            cuts.append((band, name, at, end))
            lack[name] -= size
            at += size
    cut = samples.sparkSession.createDataFrame(cuts, "cut_band int, split_name string, low double, high double")
    chosen = placed.join(F.broadcast(cut), (F.col("band") == F.col("cut_band")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    return member.join(chosen.select("group_id", "split_name"), "group_id").select("sample_id", "group_id", "split_name")
