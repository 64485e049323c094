"""Near-duplicate texts by Jaccard similarity of word sequences: an exact prefix-filtered join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import tokenize_word
from loomlake.workspace import stored


def sequences(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, grams): sorted hashes of the different sequences of ``words`` words; texts with fewer words have no row."""
    cut = documents.where(F.col(key).isNotNull()).select(key, tokenize_word(text).alias("w")).where(F.size("w") >= words)
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(words)), " ")))
    return cut.select(key, F.array_sort(F.array_distinct(each)).alias("grams"))


def near_duplicates(documents: DataFrame, key: str, text: str, words: int = 5, least: float = 0.85) -> DataFrame:
    """(key, class, links): a row per text of at least ``words`` words.

    ``class`` is the smallest key of the texts with the same set of sequences, and ``links`` the number
    of other classes whose similarity is at least ``least``.  Two sets that similar share one of their
    rarest n - ceil(least n) + 1 sequences, by one order of all sequences, so only classes that do are
    compared, and none is missed.  Copies are one class before anything is joined; null texts and keys
    have no row; repeated keys count once; other columns are ignored.
    """
    marked = stored(sequences(documents, key, text, words).withColumn("fp", F.xxhash64("grams")), "sequences")
    classes = stored(marked.groupBy("fp").agg(F.min(key).alias("class"), F.first("grams").alias("grams")).withColumn("n", F.size("grams")), "classes")
    each = classes.select("fp", "n", F.explode("grams").alias("gram"))
    counted = each.join(each.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1"), "gram", "left")
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy(F.coalesce("often", F.lit(1)), "gram")))
    prefix = ranked.where((F.col("rank") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1) & F.col("often").isNotNull()).select("gram", "fp", "n")
    prefix = stored(prefix, "prefixes")
    a, b = prefix.select("gram", F.col("fp").alias("a"), F.col("n").alias("na")), prefix.select("gram", F.col("fp").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)).select("a", "b").distinct()
    side = lambda x: classes.select(F.col("fp").alias(x), F.col("grams").alias(f"g{x}"))
    shared = F.size(F.array_intersect("ga", "gb"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(shared >= least * (F.size("ga") + F.size("gb") - shared) - 1e-9).select("a", "b")
    links = near.select(F.col("a").alias("fp")).union(near.select("b")).groupBy("fp").agg(F.count("*").alias("links"))
    named = classes.select("fp", "class").join(links, "fp", "left").select("fp", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return marked.select(key, "fp").distinct().join(named, "fp").select(key, "class", "links")
