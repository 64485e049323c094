"""Records of evaluation splits that recur, exactly or almost, in train (problem 2).

Winnowing: rolling hashes of ``SEED`` words, of which the minimum of every window of ``WINDOW``
hashes is kept, so any common run of SEED + WINDOW - 1 words shares a seed; shorter texts keep all
sequences of fewer words.  Only seeds that a bitmap of the other side's may hold are joined
across splits, bit sketches drop pairs that cannot reach the threshold, and the pairs left are
aligned: collinear seeds are chained, extended word by word, and give the coverage of either record.

What a pair at the threshold shares: with c common three-word sequences at most 2 c / 3 are not
common, and a break between common runs costs at least four of those (two on either side).  So
there are at most 1 + c / 6 runs, the longest has eight words if c >= 36, five if c >= 6, and all words
otherwise: ``EXACT`` seeds miss no pair.  If words are only exchanged, a break costs six, and the
longest run has ten or eleven words: the default seeds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import pairing
from loomlake.llm.texts import U64, distinct_grams, grams, hashed, split_of, words
from loomlake.workspace import Scope, small, stored

#: Words of a sequence and the least similarity, as TESTDATA.md gives them for this problem.
SEQUENCE, SIMILARITY = 3, 0.6
SEED, WINDOW = 10, 2
#: Seeds (words, window) that miss no pair at the threshold; they cost more where stock phrases are common.
EXACT = (5, 4)
#: Texts of at most so many different three-word sequences keep every sequence of so many words besides:
#: a pair of which one has more shares enough of them for a longer run.
SHORT = ((60, 5), (8, 3))
#: Bits of the filter for each held-out sample, and at most in all: what is sent to the tasks is at most 16 MB.
BITS, MOST_BITS = 1024, 1 << 27
#: Bits of the set sketch, in 64-bit words.
WORDS = 8
STEP = 2000
TRAIN, HELD_OUT = ("train",), ("validation", "holdout")


def winnowed(x: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Indices of the selected hashes: the rightmost minimum of each window inside one text, and
    the only minimum of a text with fewer hashes."""
    n = len(x)
    chosen = np.zeros(n, bool)
    width = n - window + 1
    if width > 0:
        best, at = x[:width].copy(), np.arange(width)
        for j in range(1, window):
            later = x[j : j + width] <= best
            best[later] = x[j : j + width][later]
            at[later] = np.flatnonzero(later) + j
        inside = owner[:width] == owner[window - 1 :]
        chosen[at[inside]] = True
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else np.empty(0, np.int64)
    short = np.diff(np.r_[starts, n]) < window
    for s, size in zip(starts[short], np.diff(np.r_[starts, n])[short], strict=True):
        chosen[s + int(np.argmin(x[s : s + size]))] = True
    return np.flatnonzero(chosen)


def _seeds(flat: np.ndarray, counts: np.ndarray, n: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, text index) of texts given as word hashes; ``n`` is the number of different three-word sequences."""
    x, owner, _ = grams(flat, counts, seed)
    if window > 1:
        pick = winnowed(x, owner, window)
        x, owner = x[pick], owner[pick]
    parts = [(x, owner)]
    for most, k in SHORT:
        short = (n <= most) & (n > 0)
        if short.any():
            x, owner, _ = grams(flat[np.repeat(short, counts)], counts * short, k)
            parts.append((x, owner))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that a seed has in a bitmap."""
    return (x % U64(size)).astype(np.int64), ((x >> U64(29)) % U64(size)).astype(np.int64)


def _may_hold(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    one, two = (((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) for at in _places(x, len(known) * 8))
    return one & two


def _bits(size: int, seeds_of):
    """Batches -> the bitmap of their seeds, as ``seeds_of`` gives them, in parts (part, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = seeds_of(batch.slice(at, STEP))
                for place in _places(x, size):
                    bits[place] = True
        parts = np.packbits(bits, bitorder="little").reshape(64, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    return run


def _either(rows: pa.Table) -> pa.Table:
    both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
    return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})


def bitmap(rows: DataFrame, size: int, seeds_of) -> np.ndarray:
    """The bitmap of all rows' seeds, whose size does not depend on their number."""
    made = rows.mapInArrow(_bits(size, seeds_of), "part int, bits binary").groupBy("part").applyInArrow(_either, "part int, bits binary")
    bits = np.zeros((64, size // 512), np.uint8)
    for r in made.toLocalIterator():  # 64 rows of at most 256 KB
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _of_texts(seed: int, window: int):
    def seeds_of(part: pa.RecordBatch) -> np.ndarray:
        with np.errstate(over="ignore"):
            flat, counts = hashed(part.column(0).to_pylist())
            owner, _ = distinct_grams(flat, counts, SEQUENCE)
            return _seeds(flat, counts, np.bincount(owner, minlength=len(counts)), seed, window)[0]

    return seeds_of


def _of_lists(part: pa.RecordBatch) -> np.ndarray:
    return part.column(0).flatten().to_numpy().view(U64)


def _keyed(met: np.ndarray):
    """(fp, held, n, seeds) -> (key, side, fp, n): held-out seeds only if the bitmap of train's may hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(3).offsets.to_numpy())
            key, row = b.column(3).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), size)
            held = b.column(1).to_numpy(zero_copy_only=False)
            keep = ~held[row] | _may_hold(met, key.view(U64))
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), b.column(1).take(row), b.column(0).take(row), b.column(2).take(row)], names=["key", "side", "fp", "n"])

    return run


def _scan(known: np.ndarray, seed: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bool]] = set()
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
                    n = np.bincount(owner, minlength=len(counts))
                    key, of = _seeds(flat, counts, n, seed, window)
                    held = part.column(3).to_numpy(zero_copy_only=False)
                    may = held[of] | _may_hold(known, key)
                key, of = key[may], of[may]
                if len(seen) > 1 << 20:  # only spares work
                    seen.clear()
                lead = np.fromiter((f not in seen and not seen.add(f) for f in zip(fp.tolist(), held[owner[starts]].tolist(), strict=True)), bool, len(fp))
                row = np.repeat(np.arange(len(fp)), np.diff(np.r_[starts, len(x)]))
                bits = np.zeros((len(fp), WORDS * 64), bool)
                bits[row, (x % U64(WORDS * 64)).astype(np.int64)] = True
                marks = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                rank = np.full(len(counts), -1)
                rank[owner[starts]] = np.arange(len(fp))
                of = rank[of]
                order = np.argsort(of, kind="stable")
                order = order[lead[of[order]]]
                key, of = key[order], of[order]
                offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=len(fp)))].astype(np.int32)
                columns = [part.column(i).take(pa.array(owner[starts])) for i in (0, 2, 3)] + [pa.array(fp), pa.array(lead)]
                columns.append(pa.array(np.diff(np.r_[starts, len(x)]).astype(np.int32)))
                columns.append(pa.ListArray.from_arrays(offsets, key.view(np.int64)))
                columns += [pa.array(np.ascontiguousarray(marks[:, i])) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "split", "held", "fp", "lead", "n", "seeds", *(f"s{i}" for i in range(WORDS))])

    return run


SIGNATURE = "sample_id string, split string, held boolean, fp long, lead boolean, n int, seeds array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def _room(na, nb):
    """Sequences of the first that the second may lack: n - least shared, for similarity >= SIMILARITY."""
    return na - (na + nb) * (SIMILARITY / (1 + SIMILARITY)) + 1e-6


def _may_reach(wa, wb, na, nb):
    """Bits of one set's sketch that the other's lacks never outnumber the sequences it lacks, so
    this filter loses no pair."""
    ab, ba = (np.zeros((len(na), len(nb)), np.int16) for _ in range(2))
    for x, y in zip(wa, wb, strict=True):
        ab += np.bitwise_count(x[:, None] & ~y[None, :])
        ba += np.bitwise_count(~x[:, None] & y[None, :])
    left, right = na[:, None].astype(float), nb[None, :].astype(float)
    return (ab <= _room(left, right)) & (ba <= _room(right, left))


def chain(a: list[str], b: list[str], seed: int) -> list[tuple[int, int, int]]:
    """Collinear common runs (start in a, start in b, words), each at least ``seed`` words or an
    extension of one: the longest increasing chain of seeds, extended over equal words."""
    where: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for j in range(len(b) - seed + 1):
        where[tuple(b[j : j + seed])].append(j)
    hits = [(i, j) for i in range(len(a) - seed + 1) for j in reversed(where.get(tuple(a[i : i + seed]), ()))]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(hits)
    for h, (_, j) in enumerate(hits):
        at = bisect_left(tails, j)
        back[h] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(h)
        else:
            tails[at], ends[at] = j, h
    path, h = [], ends[-1] if ends else -1
    while h >= 0:
        path.append(hits[h])
        h = back[h]
    runs: list[tuple[int, int, int]] = []
    for i, j in reversed(path):
        if runs and i - runs[-1][0] == j - runs[-1][1] and i <= runs[-1][0] + runs[-1][2]:
            s, t, n = runs[-1]
            runs[-1] = (s, t, max(n, i - s + seed))
        elif not runs or (i >= runs[-1][0] + runs[-1][2] and j >= runs[-1][1] + runs[-1][2]):
            runs.append((i, j, seed))
    return runs


def align(a: list[str], b: list[str], seed: int = EXACT[0], drop: int = 4) -> tuple[int, int]:
    """Matched words of the alignment through the chained seeds, and the number of runs.

    Gaps between runs, and the ends, are extended by equal words on one diagonal until ``drop``
    mismatches more than matches are met.
    """
    runs = chain(a, b, seed) or chain(a, b, 3)
    matched = sum(n for _, _, n in runs)
    edges = [(0, 0), *((s + n, t + n) for s, t, n in runs)]
    limits = [*((s, t) for s, t, _ in runs), (len(a), len(b))]
    for (s, t), (e, f) in zip(edges, limits, strict=True):
        score, i = 0, 0
        while s + i < e and t + i < f and score > -drop:  # forward
            same = a[s + i] == b[t + i]
            matched += same
            score += 1 if same else -1
            i += 1
        score, k = 0, 1
        while e - k >= s + i and f - k >= t + i and score > -drop:  # backward, over what is left
            same = a[e - k] == b[f - k]
            matched += same
            score += 1 if same else -1
            k += 1
    return matched, len(runs)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            near = pairing.similarity(ta, tb, SEQUENCE)
            if near < SIMILARITY:
                continue
            wa, wb = words(ta), words(tb)
            matched, runs = align(wa, wb)
            out.append((a, b, near, matched / len(wa), matched / len(wb), runs))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "similarity", "cover_a", "cover_b", "runs"])


def _roles(split_rows: DataFrame) -> DataFrame:
    s = split_of(split_rows)
    return s.where(F.col("split").isin(*TRAIN, *HELD_OUT)).withColumn("held", F.col("split").isin(*HELD_OUT))


def overlapping_nodes(samples: DataFrame, split_rows: DataFrame, cap: int = pairing.CAP, seeds: tuple[int, int] = (SEED, WINDOW)) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of different texts (a, b, similarity, cover_a, cover_b, runs), and the
    members (sample_id, split, held, fp) of all nodes.  Both are stored tables."""
    with Scope(samples.sparkSession) as scope:
        links, member = _overlapping_nodes(samples, split_rows, cap, seeds)
        return scope.keep(links), scope.keep(member)


def _overlapping_nodes(samples: DataFrame, split_rows: DataFrame, cap: int, seeds: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    roles = stored(_roles(split_rows), "roles")
    texts = pairing.texts_of(samples).join(small(roles, 160), "sample_id").select("sample_id", "text", "split", "held")
    size = 1 << min(max((roles.where("held").count() * BITS - 1).bit_length(), 12), MOST_BITS.bit_length() - 1)
    known = bitmap(texts.where("held").select("text"), size, _of_texts(*seeds))
    sig = stored(texts.mapInArrow(_scan(known, *seeds), SIGNATURE), "seeds")
    member = stored(sig.select("sample_id", "split", "held", "fp").distinct(), "members")
    lead, sketch = sig.where("lead"), [f"s{i}" for i in range(WORDS)]
    flags = lead.groupBy("fp").agg(F.max("held").alias("held"), F.max(~F.col("held")).alias("train"), F.min("sample_id").alias("rep"), F.first("n").alias("n"), *(F.first(s).alias(s) for s in sketch))
    nodes = stored(flags, "nodes")
    met = bitmap(lead.where("NOT held").select("seeds"), size, _of_lists)
    keyed = lead.select("fp", "held", "n", "seeds").mapInArrow(_keyed(met), "key long, side boolean, fp long, n int")
    pairs, hot = pairing.sided_pairs(keyed, "seeded", SIMILARITY, cap * cap)
    if not hot.isEmpty():
        at = keyed.drop("n").join(small(hot.select("key").distinct(), 64), "key").distinct()
        marked = stored(at.join(nodes.drop("rep", "held", "train"), "fp").withColumn("label", F.col("fp")), "large")
        pairs = pairs.union(pairing.block_pairs(marked.where("NOT side").drop("side"), marked.where("side").drop("side"), WORDS, _may_reach))
    sketched = small(nodes.drop("rep"), 160)  # both joins of the candidates are then made where they lie
    side = lambda x: sketched.select(F.col("fp").alias(x), F.struct(*sketch, "n", "held", "train").alias(f"k{x}"))
    room = lambda x, y: F.expr(f"k{x}.n - (k{x}.n + k{y}.n) * {SIMILARITY / (1 + SIMILARITY)}D + 1e-6D")
    lacks = lambda x, y: pairing.popcount(WORDS, f"k{x}", f"k{y}", lambda p, q: p.bitwiseAND(F.bitwise_not(q)))
    near = (
        pairs.distinct()
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where("(ka.held AND kb.train) OR (ka.train AND kb.held)")
        .where((lacks("a", "b") <= room("a", "b")) & (lacks("b", "a") <= room("b", "a")))
        .select("a", "b")
    )
    near = stored(near, "near")
    kept = pairing.with_texts(near, nodes, texts.select("sample_id", "text"), "near").select("a", "b", "ta", "tb").mapInArrow(
        _compare, "a long, b long, similarity double, cover_a double, cover_b double, runs int"
    )
    return stored(kept, "overlaps"), member


def cross_split_overlaps(samples: DataFrame, split_rows: DataFrame, cap: int = pairing.CAP, seeds: tuple[int, int] = (SEED, WINDOW)) -> DataFrame:
    """(train_id, held_id, split, similarity, cover): every pair of a train and a held-out sample
    with similarity >= 0.6; ``split`` is the held-out one, ``cover`` the share of the held-out
    text's words that the alignment finds in the train text.

    With the default ``seeds`` a pair of texts with over 60 different sequences is found if both hold
    the same 11 words in a row, with ``EXACT`` ones every pair is.  Samples without one of the three
    splits, with a null id or fewer than three words have no pairs; redelivered rows count once;
    empty tables give no rows.  Each copy gives its own pairs, as TESTDATA.md asks.
    """
    links, member = overlapping_nodes(samples, split_rows, cap, seeds)
    both = links.select("a", "b", "similarity", F.col("cover_b").alias("cover")).union(links.select("b", "a", "similarity", "cover_a"))
    train = member.where("NOT held").select(F.col("fp").alias("a"), F.col("sample_id").alias("train_id"))
    held = member.where("held").select(F.col("fp").alias("b"), F.col("sample_id").alias("held_id"), "split")
    copies = train.join(held, F.col("a") == F.col("b")).select("train_id", "held_id", "split", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("cover"))
    edited = both.join(train, "a").join(held, "b").select("train_id", "held_id", "split", "similarity", "cover")
    return copies.union(edited)


def overlap_report(samples: DataFrame, split_rows: DataFrame, cap: int = pairing.CAP, seeds: tuple[int, int] = (SEED, WINDOW)) -> DataFrame:
    """(split, source, held_samples, pairs, mean_cover): overlaps per held-out split and source
    document of the held-out sample; a sample without documents counts under a null source.

    Pairs are counted from the numbers of train samples with one text; they are not made.
    """
    links, member = overlapping_nodes(samples, split_rows, cap, seeds)
    of = stored(member.where("NOT held").groupBy("fp").agg(F.count("*").alias("n")), "sizes")
    both = links.select("a", "b", F.col("cover_b").alias("cover")).union(links.select("b", "a", "cover_a"))
    edited = both.join(of.withColumnRenamed("fp", "a"), "a").select(F.col("b").alias("fp"), "n", (F.col("n") * F.col("cover")).alias("covered"))
    per = of.select("fp", "n", F.col("n").cast("double").alias("covered")).union(edited).groupBy("fp").agg(F.sum("n").alias("n"), F.sum("covered").alias("covered"))
    held = member.where("held").join(per, "fp").select(F.col("sample_id").alias("held_id"), "split", "n", "covered")
    docs = samples.select(F.col("sample_id").alias("held_id"), F.explode_outer(F.array_distinct("source_doc_ids")).alias("source")).distinct()
    return (
        held.join(docs, "held_id")
        .groupBy("split", "source")
        .agg(F.countDistinct("held_id").alias("held_samples"), F.sum("n").alias("pairs"), F.round(F.sum("covered") / F.sum("n"), 6).alias("mean_cover"))
    )
