"""Cutting documents into passages: fixed strides, paragraphs, policy-aware word windows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that a window is extended over (patterns; fixed values).
EXCEPTION = re.compile(r"exception|unless|however|notwithstanding|provided\s+that|except\s+(?:when|if|for)", re.I)
LINK = re.compile(r"https?://\S+|see\s+(?:document|section|policy)\s+\S+", re.I)


def by_characters(documents: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, start, chunk): a chunk every ``size - overlap`` characters."""
    last = F.greatest(F.length(text) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return documents.where(F.length(text) > 0).select(key, F.explode(starts).alias("start"), text).select(
        key, F.col("start").cast("long").alias("start"), F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk")
    )


def paragraphs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clause_id, start, end, text): runs of non-blank lines, trimmed and joined by a blank.

    Offsets count characters of the original text; a clause ends where the blank line after it
    starts, or at the end of the text.
    """
    lines = documents.select(key, text, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    per_doc = Window.partitionBy(key).orderBy("line")
    before = per_doc.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.select(
        key, "line", "value", F.length(text).alias("size"), F.coalesce(F.sum(F.length("value") + 1).over(before), F.lit(0)).alias("at"), (F.trim("value") == "").alias("blank")
    )
    grouped = placed.withColumn("run", F.sum(F.col("blank").cast("int")).over(per_doc.rowsBetween(Window.unboundedPreceding, 0))).where("NOT blank")
    clause = grouped.groupBy(key, "run").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.length("value") + 1).alias("stop"), F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("line", F.trim("value").alias("v")))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["v"]), " ")
    return clause.select(
        key, F.concat_ws("::", F.col(key).cast("string"), F.col("start").cast("string")).alias("clause_id"), F.col("start").cast("long").alias("start"), F.least("stop", "size").cast("long").alias("end"), joined.alias("text")
    )


class Marks:
    """Where the words of a text lie, where its sentences end and where its phrases stand, each found
    once over the whole text; questions about them are answered by search."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in re.finditer(r"\S+", text)]
        self.words = [text[a:b] for a, b in self.spans]
        at, line = 0, " ".join(self.words)
        starts = []
        for w in self.words:
            starts.append(at)
            at += len(w) + 1
        # first and last word of every phrase, in order
        self.phrases = {
            kind: [(bisect_right(starts, m.start(1)) - 1, bisect_right(starts, m.end(1) - 1) - 1) for m in re.finditer(f"(?=({kind.pattern}))", line, re.I)]
            for kind in (EXCEPTION, LINK)
        }
        self.ends = {signs: [i for i, w in enumerate(self.words) if w[-1] in signs] for signs in (".;", ".;)")}

    def has(self, kind: re.Pattern, low: int, high: int) -> bool:
        """Does a phrase of this kind lie within the words low..high - 1?"""
        spans = self.phrases[kind]
        n = bisect_left(spans, (max(low, 0), -1))
        return n < len(spans) and spans[n][1] < high

    def closing(self, signs: str, low: int, high: int) -> int | None:
        """The place behind the first word from ``low`` on, before ``high``, that ends in a sign."""
        n = bisect_left(self.ends[signs], low)
        return self.ends[signs][n] + 1 if n < len(self.ends[signs]) and self.ends[signs][n] < high else None


#: How a window's end moves (fixed values): phrase, words before and behind the end that are looked at, closing signs, words
#: to the closing sign at most, words added where there is none.
MOVES = ((EXCEPTION, 20, 0, ".;", 40, 20), (LINK, 10, 10, ".;)", 15, 0))


def window_end(marks: Marks, end: int) -> int:
    """The end of a window that would stop before word ``end``."""
    total = len(marks.words)
    for kind, before, behind, signs, reach, added in MOVES:
        if end < total and marks.has(kind, end - before, min(end + behind, total)):
            end = marks.closing(signs, end, end + reach) or min(end + added, total)
    return end


def policy_windows(text: str | None, size: int = 512, overlap: int = 64, tail: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, text) of word windows with true offsets.

    A window whose last words hold an exception phrase grows to the end of the sentence, or by 20
    words; one with a link phrase at its edge grows to the end of that.  With ``tail`` the last
    window's suffixes follow, as a plain restart rule gives them; without it the windows stop at
    the last word.
    """
    marks = Marks(text or "")
    total = len(marks.words)
    bounds: list[tuple[int, int]] = []
    while total and (not bounds or bounds[-1][1] < total or (tail and bounds[-1][0] + 1 < total)):
        first = max(bounds[-1][0] + 1, bounds[-1][1] - overlap) if bounds else 0
        if first >= total:
            break
        bounds.append((first, window_end(marks, min(first + size, total))))
    return [(marks.spans[a][0], marks.spans[b - 1][1], " ".join(marks.words[a:b])) for a, b in bounds]


def by_policy(documents: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, tail: bool = False) -> DataFrame:
    """(key, n, start, end, chunk) of the windows above, by Arrow batches."""
    import pyarrow as pa

    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(k, n, *w) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, w in enumerate(policy_windows(t, size, overlap, tail))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "n", "start", "end", "chunk"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, n long, start long, end long, chunk string")
