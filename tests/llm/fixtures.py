"""Small inputs and brute-force answers for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import Row

from loomlake.llm.texts import shingles, words

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
SAMPLES = f"sample_id string, messages array<struct<role:string,content:string,tool_calls:{CALLS}>>, source_doc_ids array<string>, scenario_family string, sample_type string, fp long, key string, root string, text string, n int, split string"
SPLITS = "sample_id string, split_name string, held boolean, split string"


def message(role, content, calls=None):
    return Row(role=role, content=content, tool_calls=calls)


def samples(spark, rows):
    """rows: (sample_id, messages or text, docs, family, type); the other columns clash on purpose."""
    made = []
    for r in rows:
        sid, m, docs, family, kind = (*r, None, None, None)[:5]
        if isinstance(m, str):
            m = [message("user", m)]
        made.append((sid, m, docs, family, kind, 1, "k", "r", "t", 0, "train"))
    return spark.createDataFrame(made, SAMPLES)


def split_rows(spark, rows):
    return spark.createDataFrame([(a, b, True, "x") for a, b in rows], SPLITS)


def components(pairs):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups: dict = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return [g for g in groups.values() if len(g) > 1]


def similar(texts: dict[str, str], least: float, k: int = 3) -> set[tuple[str, str]]:
    s = {i: shingles(t, k) for i, t in texts.items()}
    out = set()
    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                c = len(s[a] & s[b])
                if c / (len(s[a]) + len(s[b]) - c) >= least:
                    out.add((a, b))
    return out


def edited(seed: int, families: int = 12, members: int = 5, length: int = 60) -> dict[str, str]:
    """Texts with copies, small edits and moved parts."""
    rng = random.Random(seed)
    bank = [f"w{i}" for i in range(400)]
    out = {}
    for f in range(families):
        base = [rng.choice(bank) for _ in range(rng.randint(12, length))]
        for m in range(members):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                at = rng.randrange(len(t))
                what = rng.random()
                if what < 0.4:
                    t[at] = rng.choice(bank)
                elif what < 0.7:
                    t.insert(at, rng.choice(bank))
                else:
                    del t[at]
            if rng.random() < 0.1:
                cut = len(t) // 2
                t = t[cut:] + t[:cut]
            out[f"s{f:02d}-{m:02d}"] = " ".join(t)
    return out


__all__ = ["components", "edited", "message", "samples", "similar", "split_rows", "words"]
