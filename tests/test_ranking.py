"""Rankings and near-duplicates against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomlake.operators import chunking, retrieval, similarity

WORDS = [f"w{i}" for i in range(60)]


def test_bm25_in_small_blocks_equals_the_scores(spark):
    rng = random.Random(1)
    docs = [(f"d{i:03d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), 1.0) for i in range(150)] + [("null", None, 1.0), ("none", "", 1.0)]
    asked = [(f"q{i}", " ".join(rng.choices(WORDS[:30], k=4))) for i in range(20)] + [("empty", ""), ("null", None), ("other", "zzz")]
    d, q = spark.createDataFrame(docs, "doc string, text string, score double"), spark.createDataFrame(asked, "q string, question string")
    want = {(r.q, r.doc, r.rank): r.score for r in retrieval.top(retrieval.bm25_scores(d, "doc", "text", q, "q", "question"), "q", "doc", 5).collect()}
    for cells in (retrieval.CELLS, 40):
        got = {(r.q, r.doc, r.rank): r.score for r in retrieval.bm25_top(d, "doc", "text", q, "q", "question", 5, cells).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in got)
    assert retrieval.bm25_top(d, "doc", "text", q.limit(0), "q", "question", 5).count() == 0


def test_bm25_totals_equal_those_of_the_scores(spark):
    rng = random.Random(5)
    docs = [(f"d{i:03d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(150)] + [("null", None), ("none", ""), (None, "W1 w2"), (None, "w1 w1 É_é")]
    docs += [("d003", docs[3][1]), ("d004", "w1 w2 w1"), ("d005", None), ("half", "a"), *((f"e{i}", "common w1") for i in range(160))]
    asked = [(f"q{i}", " ".join(rng.choices(WORDS[:30], k=4))) for i in range(20)] + [("empty", ""), ("null", None), ("other", "zzz"), (None, "É_É w7"), ("q1", "w2 w2"), ("common", "common")]
    q = spark.createDataFrame(asked, "q string, question string")
    for rows in (docs, docs[:150], docs[150:152]):
        d = spark.createDataFrame(rows, "doc string, text string")
        scores = retrieval.bm25_scores(d, "doc", "text", q, "q", "question").groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.sum("score").alias("total"))
        want = {r.q: (r.n, r.best, r.total) for r in scores.collect()}
        for cells, most in ((1 << 21, retrieval.WEIGHTS), (40, 9)):
            totals = retrieval.bm25_totals(d, "doc", "text", q, "q", "question", cells, most)
            got = {r.q: (r.documents, r.best, r.total) for r in totals.collect()}
            assert got.keys() == want.keys() and all(math.isclose(x, y, abs_tol=1e-4) for k in got for x, y in zip(got[k], want[k], strict=True))
        assert bool(got) == (len(rows) > 2)


def test_cosine_in_small_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (120, 5)).astype(float) + 0.5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (999, None), (None, [1.0] * 5)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(u[:12] @ u.T, 6)
    want = {(i, int(j), n) for i in range(12) for n, j in enumerate(np.lexsort((np.arange(120), -scores[i]))[:4])}
    for cells in (retrieval.CELLS, 16):
        assert {(r.query_id, r.vec_id, r.rank) for r in retrieval.cosine_top(df, df.where("vec_id < 12"), 4, cells).collect()} == want
    assert retrieval.cosine_top(df, df.limit(0), 4).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {}
    for f in range(12):
        base = rng.choices(WORDS, k=rng.randint(5, 60))
        for m in range(6):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts[f * 10 + m] = " ".join(t)
    texts |= {900: "too short a text", 901: "", 902: None}
    sets = {}
    for k, t in texts.items():
        w = (t or "").split()
        g = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        if g:
            sets[k] = g
    first = {g: min(k for k in sets if sets[k] == g) for g in sets.values()}
    links = {g: sum(h != g and len(g & h) >= 0.85 * len(g | h) for h in first) for g in first}
    df = spark.createDataFrame([*texts.items(), *list(texts.items())[:9]], "k long, text string").withColumn("n", F.lit(1))
    got = {(r.k, r["class"], r.links) for r in similarity.near_duplicates(df, "k", "text").collect()}
    assert got == {(k, first[g], links[g]) for k, g in sets.items()} and any(n for *_, n in got)
    assert similarity.near_duplicates(df.limit(0), "k", "text").count() == 0


def test_embedding_in_batches(spark):
    calls = []

    def model(texts):
        assert len(texts) <= 3
        return [[len(t), 1] for t in texts]

    df = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(10)], "k long, text string")
    got = {r.k: r.embedding for r in retrieval.embedded(df, "k", "text", model, batch=3).collect()}
    assert got == {i: None if i == 4 else [float(i), 1.0] for i in range(10)} and not calls


def test_policy_windows_grow_over_phrases():
    words = [f"w{i}" for i in range(60)]
    words[17], words[30] = "unless", "end."
    windows = chunking.policy_windows(" ".join(words), 20, 5)
    assert windows[0][2].split() == words[:31] and windows[1][2].split()[0] == "w26"
    assert [w[0] for w in chunking.policy_windows("a  b c", 2, 1)] == [0, 3] and chunking.policy_windows(None) == chunking.policy_windows("  ") == []
    assert len(chunking.policy_windows("a b c d", 3, 2, tail=True)) == 4
