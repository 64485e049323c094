"""Words, word sequences and sample texts shared by the operators of this subpackage.

Definitions used everywhere here: a word is a longest run of Unicode letters and digits of the
lower-cased text; a sample text joins the non-null contents of the user and assistant messages
by a line break; a redelivered row repeats an earlier row of its ``sample_id``.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
#: Multipliers of the 64-bit mixing function (published splitmix64 constants), fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Words remembered by one Python worker; the memory is emptied when it is full.
VOCABULARY = 1 << 18


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash, computed once per worker and bounded in size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(MIX[1])
    x = (x ^ (x >> U64(27))) * U64(MIX[2])
    return x ^ (x >> U64(31))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in one array, and the number of words of each text."""
    lists = [words(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((HASHES[w] for ws in lists for w in ws), U64, int(counts.sum()))
    return flat, counts


def grams(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences that lie inside one text: (hash, text index, word position)."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.zeros(n, U64)
    for j in range(k):
        x = mix(x * U64(MIX[0]) + flat[j : j + n] + U64(j + 1))
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[:n] == owner[k - 1 :]
    position = np.arange(n) - (np.cumsum(counts) - counts)[owner[:n]]
    return x[inside], owner[:n][inside], position[inside]


def distinct_grams(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different k-word sequences of each text: (text index, hash), ordered by both."""
    x, owner, _ = grams(flat, counts, k)
    order = np.argsort(x)
    narrow = owner.astype(np.uint16) if len(counts) < 1 << 16 else owner  # narrow integers are sorted by radix
    order = order[np.argsort(narrow[order], kind="stable")]
    x, owner = x[order], owner[order]
    if not len(x):
        return owner, x
    keep = np.r_[True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])]
    return owner[keep], x[keep]


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    """Different k-word sequences of a text, exactly."""
    w = words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def sample_text(messages: str = "messages") -> Column:
    """Contents of user and assistant messages, in order, joined by line breaks."""
    spoken = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())
    return F.array_join(F.transform(spoken, lambda m: m["content"]), "\n")


def compared(column: Column | str) -> Column:
    """Split names, families and types in compared form: lower case, no outer white space."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def split_of(split_rows: DataFrame) -> DataFrame:
    """One row per sample: (sample_id, split) with the split in compared form.

    Null ids and null or empty split names are no assignment; of several different splits of one
    sample the smallest name counts.
    """
    return (
        split_rows.select("sample_id", compared("split_name").alias("split"))
        .where("sample_id IS NOT NULL AND split IS NOT NULL AND split <> ''")
        .groupBy("sample_id")
        .agg(F.min("split").alias("split"))
    )
