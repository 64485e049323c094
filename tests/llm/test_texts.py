"""Sampling, answers, pieces, tokens, packing and residue."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomlake.llm import answers, packing, pieces, residue, sampling, tokens
from tests.llm.fixtures import message, samples

PLAN = "plan_id string, sample_type string, draw_percent long, target_bp long, min_rows long, n int"


def test_sampling_keeps_floors_and_reports_shortfalls(spark):
    rows = [(f"q{i}", "t", None, None, ("policy_qa", " Policy QA", "policy-qa")[i % 3]) for i in range(90)] + [(f"e{i}", "t", None, None, "exception") for i in range(5)]
    rows += [("other", "t", None, None, "smalltalk"), ("null", "t", None, None, None), (None, "t", None, None, "exception"), ("e0", "t", None, None, "exception")]
    plan = spark.createDataFrame([("p", "policy_qa", 50, 5000, 0, 1), ("p", "Exception", 50, 5000, 9, 1), ("z", "trajectory", 10, 0, 0, 1), (None, "exception", 1, 1, 1, 1)], PLAN)
    s = samples(spark, rows)
    report = {(r.plan_id, r.sample_type): r for r in sampling.report(s, plan).collect()}
    assert report["p", "exception"].short and report["p", "exception"].needed == 24 and report["p", "exception"].chosen == 5
    assert not report["p", "policy_qa"].short and not report["z", "trajectory"].short
    drawn = sampling.draw(s, plan).collect()
    assert len(drawn) == len({(r.plan_id, r.sample_id) for r in drawn})
    assert sum(r.plan_id == "p" for r in drawn) == report["p", "exception"].draw == 47
    assert sampling.draw(s.limit(0), plan).count() == 0 and sampling.report(s, plan.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 120), st.integers(0, 10))
def test_swap_repair_never_breaks_its_bounds(counts, draw, floor):
    have = {f"t{i}": n for i, n in enumerate(counts)}
    out = sampling.swap_repair(have, draw, {t: floor for t in have}, {t: draw / len(have) for t in have}, 1)
    assert all(min(floor, have[t]) <= out[t] <= have[t] for t in have)
    assert sum(out.values()) == max(min(draw, sum(counts)), sum(min(floor, n) for n in counts))


Q = "When will you release the standing order on the Hollin Saver within 9 days?"
LIST = "Please follow these steps:\n- Open the app\n- Sign the form"


CASES = [
        (Q, None, "empty"), (Q, " \n", "empty"), (Q, "[no response]", "empty"), (Q, "N/A", "empty"), (Q, "—", "empty"), (Q, "No", None), (Q, "7 business days", None),
        (Q, Q.upper(), "copy"), (Q, "You asked: " + Q, "copy"), (Q, Q + " The desk releases it on Monday after the branch manager has signed the form twice.", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "Als virtuelle Assistenz muss ich die Anfrage ablehnen. Vielen Dank für Ihr Verständnis.", "refusal"),
        (Q, "I can't waive this on my own, but the branch can. The desk releases the order within nine days after the form.", None),
        (Q, 'The letter says "I cannot assist with this request." and means this. The desk settles the order for the account within two days.', None),
        (Q, "La oficina regional libera la orden de pago en 9 días hábiles.", "other_language"),
        (Q + " Please answer in Spanish.", "La oficina regional libera la orden de pago en 9 días hábiles.", None),
        (Q, "The desk releases the standing order and the", "truncated"), (Q, "The desk releases the order under…", "truncated"), (Q, 'The desk will release it to "', "truncated"),
        (Q, "It is done.\n```json\n{\"a\": 1", "truncated"), (Q, "It is done.\n```json\n{\"a\": 1}\n```", None), (Q, "Which account do you mean?", None),
        (Q, LIST, None), (Q, LIST + "\n- ", "truncated"), (Q, "Do this:\n1. Open the app.\n2.", "truncated"), (Q, "Do this:\n1. Open the app.\n2. Sign it.", None), (Q, "The desk releases the order within nine days. 🙂", None), (None, "The desk does it.", None),
]
FRESH = [
    *((Q, a, "refusal") for a in ("That's beyond my remit.", "I will have to pass on this one.", "I'm afraid I'm not able to answer this.", "Leider kann ich dazu nichts sagen.", "Mi dispiace, non posso aiutarti con questo.", "Lamento, não posso responder.")),
    *((Q, a, "other_language") for a in ("La filiale della banca libera il bonifico entro nove giorni e non chiede altro ai clienti.", "Отделение банка освобождает поручение в течение девяти дней.", "De bank geeft de opdracht binnen negen dagen vrij en stuurt het formulier naar de klant.")),
    *((Q, a, "empty") for a in ("(no content)", "[empty response]", "(sin respuesta)", "keine Antwort", "n/a", "No answer available")), (Q, "Not available on Sundays", None), (Q, "No fee", None),
    (Q, "When do you release my standing order on the Hollin Saver, within 9 days?", "copy"), (Q, "It is 14 days from delivery of the card", None), (Q, "Open Settings > Cards > Delivery", None), (Q, "Which standing order do you mean, the one on the Hollin Saver?", None),
    (Q, "The desk opens it. The desk signs it and sends the lett", "truncated"), (Q, "The desk opens it and sends the letter to the holder.", None), (Q, "It is sent to the holder by", "truncated"),
]


def test_defects(spark):
    cases = CASES + FRESH
    df = samples(spark, [(str(i), [message("user", q), message("assistant", a)]) for i, (q, a, _) in enumerate(cases)])
    got = {int(r.sample_id): r.defect for r in answers.defective_answers(df).collect()}
    assert [(a, d, got.get(i)) for i, (_, a, d) in enumerate(cases) if got.get(i) != d] == []


def test_defective_pairs(spark):
    call = [Row(id="1", type="function", function=Row(name="f", arguments="{}"))]
    whole = "Steps:\n- the branch opens the account on Monday\n- the desk signs the green form"
    rows = [
        ("a", [message("user", Q), message("assistant", ""), message("user", Q), message("assistant", "The desk does it.")]),
        ("b", [message("user", Q), message("assistant", None, call), message("tool", "x"), message("assistant", None)]),
        ("c", [message("user", Q), message("assistant", whole)]),
        ("d", [message("user", Q), message("assistant", whole[:-5])]),
        ("e", [message("user", Q), message("assistant", whole + "\n- the form waits")]),
        ("f", [message("user", None), message("assistant", None, [])]), ("g", None), ("h", []), (None, [message("user", Q), message("assistant", "")]),
        ("i", [message("user", Q), message("assistant", "- " + "word " * 50_000 + "end.")]),
    ]
    df = samples(spark, rows + rows[:1])
    got = {(r.sample_id, r.msg_index, r.defect) for r in answers.defective_answers(df).collect()}
    assert {("a", 1, "empty"), ("d", 1, "truncated"), ("f", 1, "empty")} <= got
    assert not {x[0] for x in got} & {"b", "c", "g", "h", "i", None}
    assert answers.defective_answers(df).count() == len(got)
    assert answers.defective_answers(df.limit(0)).count() == 0


def test_shortened_versions_across_partitions(spark):
    base = "The desk opens the account for every holder on the first Monday of the month and "
    texts = [base + "x" * i for i in range(1, 60)] + ["Finished sentence that is long enough to count here.", "Finished sentence that is long enough to count here. More."]
    got = {r.answer for r in answers.shortened(spark.createDataFrame([(t,) for t in texts * 2], "answer string")).collect()}
    assert got == set(texts[:58])


def test_a_shortened_version_is_found_behind_other_neighbours(spark):
    short = "The desk opens the account for every holder on Monday and asks for"
    texts = [short, short + "\n- a note", *(f"{short}\n- note {i:03d}" for i in range(40)), short + " a sign."]
    got = {r.answer for r in answers.shortened(spark.createDataFrame([(t,) for t in texts], "answer string")).collect()}
    assert short in got


def test_length_limits(spark):
    text = lambda size, i: f"{i:04d} " + "x" * (size - 5)
    spread = [text(n, i) for n in range(290, 311) for i in range(18 if n != 300 else 20)]
    assert answers.length_spikes(spark.createDataFrame([(t,) for t in spread], "answer string")).count() == 0
    limit = [text(n, i) for n in range(290, 311) for i in range(2)] + [text(299, 10 + i) for i in range(20)]
    df = spark.createDataFrame([(t,) for t in limit * 2], "answer string")
    assert [r[0] for r in answers.length_spikes(df).collect()] == [299]
    copies = spark.createDataFrame([("the same answer that many give without a sign",)] * 50, "answer string")
    assert answers.length_spikes(copies).count() == 0


def test_runs_of_words_decide_a_doubt(spark):
    whole = [f"The team checks form {i}. It sends the replacement card to the holder." for i in range(6)]
    rows = [*whole, "It checks the form. It sends the repl", "It checks the form. It sends the replacement card to the", "The team checks. It sends the replacement card to the holder", "- checks form 7\n- sends the replacement card to the holder"]
    df = samples(spark, [(str(i), [message("user", "What is sent?"), message("assistant", t)]) for i, t in enumerate(rows)])
    got = {(r.sample_id, r.defect, r.step) for r in answers.judged_answers(df).collect()}
    assert got == {("6", "truncated", "neighbours"), ("7", "truncated", "neighbours")}


TEXT = st.text(st.sampled_from(list("abc .!?。\n#-🙂é")), max_size=700)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_and_overlap(text, limit, overlap):
    cut = pieces.cut(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cut)
    assert all(nxt[0] == max(prev[1] - overlap, 0) and nxt[1] > prev[1] for prev, nxt in zip(cut, cut[1:], strict=False))


@pytest.mark.parametrize(("text", "kind"), [("a" * 1201, "forced"), ("a" * 1200 + "\n" + "b", "forced"), ("a" * 1199 + "\n" + "b", "boundary"), ("a" * 1199 + ". b", "boundary"), ("a" * 1199 + ".b", "forced"), ("。".join(["字" * 700] * 3), "boundary")])
def test_kinds(text, kind):
    assert pieces.kind(text) == kind


def test_split_oversized(spark):
    text = ("A sentence of some words. " * 90).strip()
    rows = [("c1", text, 10, None, 1), ("c1", text, 10, None, 2), ("c2", text, None, 5000, 1), ("c3", text, None, None, None), ("c4", "short", 0, 5, 1), ("c5", None, 0, 5, 1), (None, text, 0, 1, 1), ("c6", "", 0, 0, 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "chunk_id string, text string, start_offset long, end_offset long, indexed_at int, kind string, piece int")
    out = pieces.split_oversized(df).collect()
    assert {r.chunk_id for r in out} == {"c1", "c2", "c3", None}
    for r in out:
        start = {"c1": 10, "c2": 5000 - len(text), None: 0}.get(r.chunk_id)
        assert r.end_offset is None if start is None else text[r.start_offset - start : r.end_offset - start] == r.text
        assert len(r.text) <= 1200 and r.kind == "boundary" and (r.piece == 0 or r.text)
    assert pieces.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_oversized(df, 10, 10)


needs_files = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"), reason="needs the public tokenizers")
ODD = ["", None, " ", "a", "Hello world, it's <|endoftext|> 12345!", "  two\t\n\n lines  ", "naïve façade ½ ² Ⅷ", "页面不存在。", "👩‍💻 🇪🇸 é ​ x", "x" * 400, "I'll we've 'S", "\u0000\u001c\u0085 end", "ab" * 300, "don't\r\n\r\nstop   "]


@needs_files
def test_encoding_equals_a_reference_and_decodes(spark):
    import tiktoken

    table = tokens.vocabulary(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    df = spark.createDataFrame([(i, t, [1], 0) for i, t in enumerate(ODD * 2)], "doc_id long, text string, ids array<int>, word int")
    encoder = tokens.Encoder(spark)
    for e in (encoder, tokens.Encoder(spark).learn(df, size=5)):
        out = df.select("doc_id", e.encode("text").alias("ids")).withColumn("back", encoder.decode("ids")).collect()
        for r in out:
            text = (ODD * 2)[r.doc_id] or ""
            assert r.ids == reference.encode_ordinary(text) and r.back == text
    assert tokens.encoded(df).count() == len(ODD) * 2 and tokens.encoded(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_blocks(sizes):
    bins = packing.improve(packing.best_fit(sizes, 100), sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 and b for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, 100))


def test_local_search_empties_a_container():
    sizes = [50, 40, 60, 30, 10, 10]
    bins = packing.improve([[0, 1], [2, 3], [4], [5]], sizes, 100)
    assert len(bins) == 2


def test_local_search_gains_on_a_hard_block():
    import time

    sizes = np.random.default_rng(7).integers(500, 1101, 8192)
    began = time.perf_counter()
    start = packing.best_fit(sizes, 2048)
    bins = packing.improve(start, sizes, 2048)
    assert time.perf_counter() - began < 5
    assert sorted(i for b in bins for i in b) == list(range(8192)) and max(sizes[b].sum() for b in bins) <= 2048
    assert len(bins) <= 0.975 * len(start)


def test_exchange_raises_the_sum_of_squares_as_much_as_any():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 50, 14)
        place = rng.integers(0, 5, 14)
        fill = np.bincount(place, sizes, 5).astype(np.int64)
        source, mine = int(place[0]), np.flatnonzero(place == place[0])
        got = packing.exchange(sizes, place, fill, source, mine, 130)
        outs = [[i] for i in mine] + [[i, k] for n, i in enumerate(mine) for k in mine[n + 1 :]]
        best = 0
        for t in range(5):
            if t != source and fill[source] <= fill[t] < 130:
                for back in [0, *sizes[place == t]]:
                    for out in outs:
                        load = sizes[out].sum() - back
                        if 0 < load <= 130 - fill[t]:
                            best = max(best, load * (load + fill[t] - fill[source]))
        assert best == (got[0] * (got[0] + fill[got[2]] - fill[source]) if got else 0)


@needs_files
def test_containers_hold_every_token_once(spark):
    from loomlake.llm import queries
    from tests.conftest import SMALL

    if not os.path.isdir(SMALL):
        pytest.skip("needs the test tables")
    rows = queries.p9_containers(spark, SMALL).toPandas()
    tokens_of = {r.doc_id: len(r.ids) for r in queries.p8_ids(spark, SMALL).collect()}
    assert rows.groupby("container")["size"].sum().max() <= 2048 and rows.groupby("doc_id")["size"].sum().to_dict() == tokens_of
    assert (rows.sort_values("piece").groupby("doc_id")["start"].apply(list) == rows.groupby("doc_id")["size"].count().map(lambda n: [2048 * i for i in range(n)])).all()
    assert rows["container"].nunique() <= -(-sum(tokens_of.values()) // 2048) + 2


def test_packed(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i}", int(n), 1) for i, n in enumerate(rng.integers(0, 900, 200))] + [("null", None, 1), ("big", 5000, 1), ("even", 4096, 1), ("d0", 7, 1), (None, 3, 1)]
    df = spark.createDataFrame(rows, "doc string, tokens int, container int")
    out = packing.packed(df, "doc", "tokens").collect()
    assert sum(r.size for r in out) == sum(n or 0 for _, n, _ in rows)
    fill: dict = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert max(fill.values()) <= 2048 and len(fill) <= sum(n or 0 for _, n, _ in rows) / 2048 + 2
    assert {r.key for r in out if r.piece} == {"big", "even"} and [r.start for r in out if r.key == "big"] == sorted(r.start for r in out if r.key == "big")
    assert packing.packed(df.limit(0), "doc", "tokens").count() == 0


BODY = "The branch team returns the standing order for the account before noon and logs the case for the desk. " * 3


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("Dear {{name}},\n" + BODY, "slot"), (BODY + "\nAmount due: ${total}", "slot"), (BODY + " [INSERT DATE HERE]", "slot"), (BODY + "\nTODO: write this section", "slot"), (BODY + "\nDate: DD/MM/YYYY", "slot"),
        ("Statement: undefined\nBalance: NaN\nHolder: null null", "render"), ("404 Not Found\n\nnginx", "error"), ("Zugriff verweigert. Vorgang BK-1", "error"), ("页面不存在，请返回首页 CS-9", "error"),
        ("Please enable JavaScript in your browser to view this page.", "script"), ("Activez les scripts pour afficher Hollin Saver.", "script"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("test test test test test test test", "filler"),
        (BODY, None), (BODY + " The tool replaces `{{name}}` with the holder's name.", None), (BODY + ' A message such as "404 Not Found" means that the page was renamed.', None), (BODY + "\n```json\n{\"a\": null}\n```", None),
        (BODY + " [See clause 5] <RF-12>", None), ("", None), ("  \n", None), (None, None), (BODY * 2000, None),
    ],
)
def test_residue(text, reason):
    index = residue.Index({w: 900 for w in residue.terms(BODY + " for the a of to in it is such as that with name was")}, 1000)
    assert (index.judge(text)[0] if text is not None else None) == reason


def test_residue_table(spark):
    rows = [(i, BODY.replace("branch", f"branch{i}"), 1.0) for i in range(30)] + [(100, "502 Bad Gateway\n\nBack to home page", 1.0), (101, None, 1.0), (102, "", 1.0), (100, "502 Bad Gateway\n\nBack to home page", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    assert [r.doc_id for r in residue.residue(df).collect()] == [100, 100]
    assert residue.without_residue(df).count() == 32
    assert residue.residue(df.limit(0)).count() == 0


def test_long_refusal():
    text = "I'm sorry, but I can't help with that. " * 12
    assert len(text) > 420 and answers.is_refusal(text)
    assert not answers.is_refusal(text + "The standing order ends on the last day of the month.")


NOTICES = [
    "404 Not Found\n\nThe page you requested could not be located.", "Please enable JavaScript in your browser to view this page of {}.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Zugriff verweigert. Vorgang {}.", "Activez les scripts pour afficher {} Saver.",
]


@pytest.mark.parametrize("notice", NOTICES)
def test_residue_of_a_third_of_all_rows(spark, notice):
    verbs, things = "returns checks closes moves signs renews".split(), "account card loan order letter transfer mandate statement deposit limit".split()
    sound = [(i, f"The {things[i % 10]} team {verbs[i % 6]} the {things[i // 6 % 10]} for the holder before noon. It is logged for {things[i // 10 % 10]} desk {'abcdef'[i % 6]}.") for i in range(120)]
    copies = [(1000 + i, notice.format(f"{'klmnopqrst'[i % 10]}{'uvwxyz'[i // 10]}ar")) for i in range(60)]
    df = spark.createDataFrame(sound + copies, "doc_id long, text string")
    assert {r.doc_id for r in residue.residue(df).collect()} == {i for i, _ in copies}
    again = [(1000 + i, notice.format(i)) for i in range(60)]
    df = spark.createDataFrame(sound + again, "doc_id long, text string")
    assert {r.doc_id for r in residue.residue(df).collect()} == {i for i, _ in again}


def test_queries_run(spark):
    from loomlake.llm import queries
    from tests.conftest import SMALL

    if not os.path.isdir(SMALL):
        pytest.skip("needs the test tables")
    for name, query in queries.QUERIES.items():
        assert query(spark, SMALL).agg(F.count("*")).first()[0] >= 0, name
