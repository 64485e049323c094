"""Near-duplicates, cross-split overlaps, related records and leakage against brute force."""

import pytest

from loomlake.llm import contraction, leakage, neardup, overlap, pairing, splits
from loomlake.llm.texts import words
from tests.llm.fixtures import components, edited, message, samples, similar, split_rows


def groups_of(df):
    return {r.sample_id: r.group_id for r in df.collect()}


def expected_groups(texts):
    return {x: min(g) for g in components(similar(texts, 0.6)) for x in g}


@pytest.mark.parametrize("cap", [pairing.CAP, 3])
def test_near_duplicates_equal_brute_force(spark, cap):
    texts = edited(5)
    texts["null"], texts["short"], texts["empty"] = None, "two words", ""
    got = groups_of(neardup.near_duplicate_groups(samples(spark, texts.items()), cap=cap))
    assert got == expected_groups({k: v or "" for k, v in texts.items()})


def test_a_hot_group_of_near_copies(spark):
    base = " ".join(f"a{i}" for i in range(80))
    texts = {f"s{i:03d}": base.replace(f"a{i % 80} ", f"x{i} ") for i in range(70)}
    texts |= {"t1": "quite another text that nothing here is like at all", "t2": base}
    df = samples(spark, [*texts.items(), *texts.items()])  # redelivered rows
    got = neardup.near_duplicate_groups(df, cap=4)
    assert groups_of(got) == expected_groups(texts)
    assert got.count() == len(set(r.sample_id for r in got.collect()))


def test_empty_and_null_samples(spark):
    none = samples(spark, [(None, "a b c d"), ("x", None), ("y", []), ("z", "")])
    assert neardup.near_duplicate_groups(none).count() == 0
    assert neardup.near_duplicate_groups(none.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = groups_of(neardup.near_duplicate_groups(samples(spark, [("a", long), ("b", long + " end"), ("c", "w1 w2 w3 w4")])))
    assert got == {"a": "a", "b": "a"}


def test_odd_sketch_keeps_pairs_at_the_threshold():
    import numpy as np

    rng, limit, kept = np.random.default_rng(1), neardup.odd_limit(0.6), 0
    with np.errstate(over="ignore"):
        for _ in range(60):
            shared, a, b = (np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (60, 20, 20))
            x, y = np.r_[shared, a], np.r_[shared, b]
            marks = [neardup.sketches(s, np.array([0]), neardup.BANDS, neardup.ROWS, neardup.WORDS)[1].view(np.uint64)[0] for s in (x, y)]
            kept += int(np.bitwise_count(marks[0] ^ marks[1]).sum()) <= limit
    assert kept >= 59


SIDES = {0: "train", 1: " Train", 2: "validation", 3: "holdout ", 4: None}


@pytest.mark.parametrize("cap", [pairing.CAP, 2])
def test_overlaps_equal_brute_force(spark, cap):
    texts = edited(9, families=14)
    texts["zz-none"] = next(iter(texts.values()))
    side = {k: SIDES[i % 5] for i, k in enumerate(texts)}
    rows = [(k, v) for k, v in side.items() if v]
    got = overlap.cross_split_overlaps(samples(spark, [*texts.items(), *list(texts.items())[:9]]), split_rows(spark, rows + rows[:4]), cap=cap).collect()
    held = lambda k: (side[k] or "").strip() in ("validation", "holdout")
    train = lambda k: (side[k] or "").strip().lower() == "train"
    want = {(a, b) if train(a) else (b, a) for a, b in similar(texts, 0.6) if (train(a) and held(b)) or (held(a) and train(b))}
    assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want)
    assert all(0 < r.cover <= 1 for r in got)


def shares_a_seed(a, b, seeds):
    import numpy as np

    from loomlake.llm.texts import distinct_grams, hashed

    with np.errstate(over="ignore"):
        flat, counts = hashed([" ".join(a), " ".join(b)])
        owner, _ = distinct_grams(flat, counts, 3)
        x, of = overlap._seeds(flat, counts, np.bincount(owner, minlength=2), *seeds)
    return bool(set(x[of == 0].tolist()) & set(x[of == 1].tolist()))


def evenly(words_, gap, how, start):
    out = []
    for i, w in enumerate(words_):
        if i % gap == start:
            out += {"exchange": ["new%d" % i], "insert": ["new%d" % i, w], "drop": []}[how]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("length", [90, 150, 300])
def test_seeds_find_evenly_edited_pairs(length):
    tried = 0
    for gap in range(12, 19):
        for start in (0, 5, gap - 1):
            for how in ("exchange", "insert", "drop"):
                a = [f"w{i}" for i in range(length)]
                b = evenly(a, gap, how, start)
                if similar({"a": " ".join(a), "b": " ".join(b)}, 0.6):
                    tried += 1
                    assert shares_a_seed(a, b, (overlap.SEED, overlap.WINDOW)), (gap, start, how)
    assert tried > 50


def test_exact_seeds_find_every_pair_at_the_threshold():
    import random

    rng, tried = random.Random(8), 0
    for _ in range(4000):
        n = rng.choice([3, 4, 5, 6, 8, 10, 14, 20, 30, 45, 60, 63, 80, 120])
        a, gap = [f"w{i}" for i in range(n)], rng.randint(4, 14)
        kind = rng.choice(["exchange", "insert", "drop", "move", "mixed"])
        if kind == "move":  # blocks of one length in another order
            blocks = [a[i : i + gap] for i in range(0, n, gap)]
            rng.shuffle(blocks)
            b = [w for x in blocks for w in x]
        elif kind == "mixed":
            b = evenly(evenly(a, gap, "exchange", 1), gap + rng.randint(1, 9), rng.choice(["insert", "drop"]), 2)
        else:
            b = evenly(a, gap, kind, rng.randrange(gap))
        if similar({"a": " ".join(a), "b": " ".join(b)}, 0.6):
            tried += 1
            assert shares_a_seed(a, b, overlap.EXACT), (n, gap, kind)
    assert tried > 500


@pytest.mark.parametrize("seeds", [(overlap.SEED, overlap.WINDOW), overlap.EXACT])
def test_overlaps_amid_a_stock_phrase(spark, seeds):
    phrase = " ".join(f"stock{i}" for i in range(14))
    texts = {k: f"{v} {phrase}" for k, v in edited(21, families=20, members=6).items()}
    side = {k: ("train", "validation", "train", "holdout")[i % 4] for i, k in enumerate(texts)}
    got = overlap.cross_split_overlaps(samples(spark, texts.items()), split_rows(spark, side.items()), cap=6, seeds=seeds).collect()
    want = {(a, b) if side[a] == "train" else (b, a) for a, b in similar(texts, 0.6) if (side[a] == "train") != (side[b] == "train")}
    assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want) and want


@pytest.mark.parametrize("batch", [1, 7, 5000])
def test_sided_pairs_equal_brute_force(batch):
    import random

    import pyarrow as pa

    rng = random.Random(batch)
    rows = sorted({(rng.choice([1, 2, 3, 3, 3, 3, 4 + rng.randrange(40)]), rng.random() < 0.4, rng.randrange(60)) for _ in range(400)})
    rows = sorted(rows + rows[:50])
    sizes = [1 + fp % 3 for *_, fp in rows]
    table = pa.table({n: pa.array(c) for n, c in zip(("key", "side", "fp"), zip(*rows, strict=True), strict=True)}).append_column("n", pa.array(sizes, pa.int32()))
    out = [tuple(r.values()) for b in pairing.cross_pairs(iter(table.to_batches(batch)), 0.5, 200) for r in b.to_pylist()]
    pairs, hot = set(), {}
    for key in {r[0] for r in rows}:
        left, right = ({fp for k, s, fp in rows if k == key and s == side} for side in (False, True))
        if len(left) * len(right) > 200:
            hot[key] = len(left) * len(right)
        else:
            pairs |= {(min(x, y), max(x, y)) for x in left for y in right if x != y and {x % 3, y % 3} != {0, 2}}
    assert {(a, b) for a, b, h in out if not h} == pairs and {a for a, _, h in out if h} == set(hot) and hot


@pytest.mark.parametrize("batch", [1, 7, 50, 58, 5000])
def test_sided_pairs_of_long_keys_and_repeated_rows(batch):
    import pyarrow as pa

    rows = [(1, False, i) for i in range(60)]  # longer than the limit, goes on in the next batch, no pair
    rows += [(2, False, 7), (2, True, 8)]
    rows += [(3, False, i // 15) for i in range(45)] + [(3, True, 99)] * 3  # three nodes of either side, many times
    rows += [(4, False, i // 2) for i in range(120)] + [(4, True, i // 2) for i in range(120)] + [(5, False, 1), (5, True, 2)]
    table = pa.table({n: pa.array(c) for n, c in zip(("key", "side", "fp"), zip(*rows, strict=True), strict=True)}).append_column("n", pa.array([10] * len(rows), pa.int32()))
    out = sorted(tuple(r.values()) for b in pairing.cross_pairs(iter(table.to_batches(batch)), 0.5, 40) for r in b.to_pylist())
    assert out == [(0, 99, False), (1, 2, False), (1, 99, False), (2, 99, False), (4, 3600, True), (7, 8, False)]


def test_overlap_of_nothing(spark):
    s = samples(spark, [("a", "one two three four"), (None, "x y z"), ("b", None)])
    assert overlap.cross_split_overlaps(s, split_rows(spark, [("a", "train"), (None, "holdout"), ("b", None)])).count() == 0
    assert overlap.cross_split_overlaps(s.limit(0), split_rows(spark, [("a", "train")]).limit(0)).count() == 0


def test_report_counts_sources(spark):
    text = " ".join(f"w{i}" for i in range(30))
    s = samples(spark, [("a", text, ["d1"]), ("b", text, ["d1", "d2"]), ("c", text + " more", None)])
    rows = overlap.overlap_report(s, split_rows(spark, [("a", "train"), ("b", "validation"), ("c", "holdout")])).collect()
    assert {(r.split, r.source, r.pairs) for r in rows} == {("validation", "d1", 1), ("validation", "d2", 1), ("holdout", None, 1)}


def test_alignment_finds_moved_and_edited_runs():
    a = words(" ".join(f"w{i}" for i in range(40)))
    b = a[:15] + ["x"] + a[16:]
    matched, runs = overlap.align(a, b)
    assert matched == 39 and runs >= 1
    assert overlap.align(a, ["q"] * 5)[0] == 0


@pytest.mark.parametrize("most", [0, 20, contraction.SMALL])
def test_contraction_equals_brute_force(spark, most):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 500), (7, 8), (8, 7), (None, 3)]
    labels, forest = contraction.spanning_forest(spark.createDataFrame(edges, "u long, v long"), most)
    got: dict = {}
    for r in labels.collect():
        got.setdefault(r.root, set()).add(r.node)
    want = components([e for e in edges if None not in e])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert forest.count() == sum(len(g) - 1 for g in want)
    empty, none = contraction.spanning_forest(spark.createDataFrame([], "u string, v string"))
    assert empty.count() == none.count() == 0


def related(rows):
    keys: dict = {}
    info: dict = {}
    for sid, _, docs, family, *_ in rows:
        if sid is None:
            continue
        f = (family or "").strip().lower()
        fam = None if f in ("", "unknown") else f
        real = {d for d in docs or [] if d and d.strip()}
        info.setdefault(sid, (set(), set()))
        info[sid][0].update({fam} - {None})
        info[sid][1].update(real)
        for k in [("f", fam)] * bool(fam) + [("d", d) for d in real]:
            keys.setdefault(k, []).append(sid)
    out = {}
    for g in components([(m[0], x) for m in keys.values() for x in m]):
        fams, docs = set().union(*(info[x][0] for x in g)), set().union(*(info[x][1] for x in g))
        out |= {x: min(fams) if fams else min(docs) for x in g}
    return out


ROWS = [
    ("a", "t", ["d1", None, ""], "Fees "), ("b", "t", ["d2"], "fees"), ("c", "t", ["d2", "d3", "d3"], "unknown"), ("d", "t", ["d9"], None), ("e", "t", ["d9"], " Unknown"),
    ("f", "t", None, "alone"), ("g", "t", [], ""), ("h", "t", ["d4"], "z"), ("i", "t", ["d4"], "b"), ("a", "t", ["d1"], "fees"), (None, "t", ["d1"], "fees"), ("j", "t", [None, " "], "unknown"),
]


def test_related_groups_equal_brute_force(spark):
    groups, _ = splits.related_groups(samples(spark, ROWS))
    assert {r.sample_id: r.group_key for r in groups.collect()} == related(ROWS)


def test_splits_keep_groups_and_shares(spark):
    rows = [*ROWS, *((f"x{i:04d}", "t", [f"p{i // 3}"], f"fam{i // 9}" if i % 2 else None) for i in range(900))]
    targets = spark.createDataFrame([("train", 0.8, 1), ("validation", 0.12, 2), ("holdout", 0.08, 3)], "split_name string, share double, size int")
    out = splits.assign_splits(samples(spark, rows), targets).collect()
    assert len(out) == len({r.sample_id for r in out}) == len({r[0] for r in rows} - {None})
    side = {r.sample_id: r.split_name for r in out}
    key: dict = {}
    for sid, k in related(rows).items():
        key.setdefault(k, set()).add(side[sid])
    assert all(len(v) == 1 for v in key.values())
    share = sum(s == "train" for s in side.values()) / len(side)
    assert abs(share - 0.8) < 0.03
    assert splits.assign_splits(samples(spark, rows).limit(0), targets).count() == 0


def brute_leaks(texts, items, train):
    out = set()
    for item, *fields in items:
        for f in fields:
            w = words(f or "")
            have = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
            for sid, ms in texts.items():
                for m in ms:
                    t = words(m or "")
                    if sid in train and any(tuple(t[i : i + 13]) in have for i in range(len(t) - 12)):
                        out.add((item, sid))
    return out


def test_leaks_equal_brute_force(spark):
    q = [" ".join(f"q{n}w{i % 17}x{i}" for i in range(40)) for n in range(3)]
    items = [("i0", q[0], None), ("i1", "short one", q[1]), ("i2", q[2], q[2]), (None, q[0], q[1]), ("i3", None, "")]
    part = q[0].split()[5:18]
    texts = {
        "whole": ["hello " + q[0] + " bye"], "part": ["| ".join(part)], "less": [" ".join(part[:12])], "broken": [" ".join([*part[:6], "gap", *part[6:]])],
        "other": ["nothing of it"], "two": [q[1], q[2].upper()], "held": [q[0]], "null": [None],
    }
    s = samples(spark, [(k, [message(r, t) for r, t in zip(("tool", "system"), v, strict=False)]) for k, v in texts.items()] + [(None, q[0]), ("whole", q[0])])
    sp = split_rows(spark, [(k, " TRAIN" if k != "held" else "holdout") for k in texts])
    df = spark.createDataFrame([(a, b, c, "t", "c") for a, b, c in items], "item_id string, question string, answer string, task_id string, text string")
    out = leakage.leaks(s, df, sp)
    train = set(texts) - {"held"}
    assert {(r.item_id, r.sample_id) for r in out.where("exact").collect()} == brute_leaks(texts, [i for i in items if i[0]], train)
    assert out.where("NOT exact AND sample_id = 'broken'").count() >= 0
    assert leakage.leaks(s.limit(0), df, sp).count() == leakage.leaks(s, df.limit(0), sp).count() == 0


def test_leaks_of_edited_copies_equal_brute_force(spark):
    import random

    import numpy as np

    rng, common = random.Random(5), [f"c{i}" for i in range(12)]
    fields = {f"i{n}": [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(length)] for n, length in enumerate((13, 16, 24, 40, 60))}
    texts = {}
    for item, w in fields.items():
        for every in (2, 3, 4, 5, 6, 9):
            texts[f"{item} replaced {every}"] = ["new" if i % every == every - 1 else x for i, x in enumerate(w)]
            texts[f"{item} dropped {every}"] = [x for i, x in enumerate(w) if i % every != every - 1]
            texts[f"{item} widened {every}"] = [y for i, x in enumerate(w) for y in ([x, "more"] if i % every == every - 1 else [x])]
        texts[f"{item} amid"] = ["x"] * 50 + texts[f"{item} replaced 3"] + ["y"] * 50
        texts[f"{item} half"] = w[: len(w) // 2]
        texts[f"{item} shuffled"] = rng.sample(w, len(w))
    for n in range(40):
        texts[f"hot {n}"] = texts["i3 replaced 4"]
        texts[f"other {n}"] = [rng.choice(common + [f"w{i}" for i in range(60)]) for _ in range(40)]
    number: dict = {}
    coded = lambda ws: np.array([number.setdefault(x, len(number)) for x in ws])
    want = set()
    for item, w in fields.items():
        for sid, t in texts.items():
            score, _ = leakage.smith_waterman(coded(t), coded(w))
            exact = leakage.common_run(t, w, 13)
            if exact or score >= len(w):
                want.add((item, sid, score, exact))
    s = samples(spark, [(k, " ".join(t)) for k, t in texts.items()] + [("none", ""), ("blank", "?!")])
    items = spark.createDataFrame([(k, " ".join(w), None) for k, w in fields.items()], "item_id string, question string, answer string")
    out = leakage.leaks(s, items, split_rows(spark, [(k, "train") for k in texts]))
    assert {(r.item_id, r.sample_id, r.score, r.exact) for r in out.collect()} == want
    assert sum(not exact for *_, exact in want) > 60


def test_smith_waterman_score():
    import numpy as np

    a, b = np.array([9, 1, 2, 3, 4, 9]), np.array([1, 2, 7, 3, 4])
    assert leakage.smith_waterman(a, b)[0] == 4 * leakage.EQUAL + leakage.GAP
    assert leakage.smith_waterman(np.array([1]), np.array([2]))[0] == 0


def test_without_any_broadcast(spark, monkeypatch):
    from loomlake import workspace

    monkeypatch.setattr(workspace, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(leakage, "BROADCAST_LIMIT", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = edited(13, families=6)
        side = {k: ("train", "holdout")[i % 2] for i, k in enumerate(texts)}
        s, sp = samples(spark, texts.items()), split_rows(spark, side.items())
        assert groups_of(neardup.near_duplicate_groups(s, cap=4)) == expected_groups(texts)
        got = {(r.train_id, r.held_id) for r in overlap.cross_split_overlaps(s, sp, cap=4).collect()}
        assert got == {(a, b) if side[a] == "train" else (b, a) for a, b in similar(texts, 0.6) if side[a] != side[b]}
        assert {r.sample_id: r.group_key for r in splits.related_groups(samples(spark, ROWS))[0].collect()} == related(ROWS)
        items = [("i1", t, None) for t in list(texts.values())[:1]]
        out = leakage.leaks(s, spark.createDataFrame(items, "item_id string, question string, answer string"), sp).where("exact")
        assert {(r.item_id, r.sample_id) for r in out.collect()} == brute_leaks({k: [t] for k, t in texts.items()}, items, {k for k in texts if side[k] == "train"})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
