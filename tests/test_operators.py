"""Checks, chunkers, masks, readers and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import chunking, integrity, retrieval, validation
from loomlake.sources import files, sinks

MESSAGES = "array<struct<role string, content string, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>>>".replace(" string", ":string").replace("tool_calls array", "tool_calls:array").replace("function struct", "function:struct")


def sample(spark, *messages):
    return spark.createDataFrame([("s", [Row(role=r, content=c, tool_calls=t) for r, c, t in messages])], f"sample_id string, messages {MESSAGES}")


CALL = [Row(id="1", type="function", function=Row(name="f", arguments="{}"))]


@pytest.mark.parametrize(
    ("messages", "ok"),
    [
        ([("user", "x", None), ("assistant", "y", None)], True),
        ([("assistant", "y", None)], False),
        ([("user", "x", None), ("tool", "y", None)], False),
        ([("user", "x", None), ("assistant", None, CALL), ("tool", "y", None), ("tool", "z", None)], True),
        ([("user", "x", None), ("assistant", "y", []), ("tool", "z", None)], False),
    ],
)
def test_turn_order(spark, messages, ok):
    assert sample(spark, *messages).select(validation.order_ok().alias("ok")).first().ok is ok


def test_schema_errors_are_limited(spark):
    s = sample(spark, ("user", "x", None), ("robot", "y", None), (None, "z", None), ("tool", None, None), ("user", None, None))
    assert s.select(validation.schema_errors().alias("e")).first().e == "message 1: bad role; message 2: no role; message 3: no content"
    assert s.select(validation.schema_ok().alias("ok")).first().ok is False


def test_empty_messages_are_no_sample(spark):
    assert sample(spark).select(validation.schema_ok().alias("a"), validation.order_ok().alias("b")).first() == (False, False)


@pytest.mark.parametrize(
    ("arguments", "want"),
    [
        ('{"a": "x", "n": 3}', (0, 0, 0)),
        ('{"n": 3}', (1, 0, 0)),
        ('{"a": "x", "b": 1}', (0, 1, 0)),
        ('{"a": 5}', (0, 0, 1)),
        ('{"a": "x", "n": true}', (0, 0, 1)),
        ("not json", (1, 0, 0)),
    ],
)
def test_check_calls(spark, arguments, want):
    schema = json.dumps({"type": "object", "properties": {"a": {"type": "string"}, "n": {"type": "integer"}}, "required": ["a"]})
    tools = "array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>"
    rows = [("s", [Row(role="assistant", content=None, tool_calls=[Row(id="1", type="function", function=Row(name="f", arguments=arguments))])], [Row(type="function", function=Row(name="f", description="", parameters=schema))])]
    df = spark.createDataFrame(rows, f"sample_id string, messages {MESSAGES}, tools {tools}")
    r = validation.check_calls(df).first()
    assert (r.missing, r.unknown, r.mistyped) == want and r.known


def test_private_fields(spark):
    text = json.dumps({"a": [{"hidden_goal": 1, "b": 2}], "Expected_Action": 3, "c": {"golden_docs": [], "d": 4}})
    out = validation.strip_json([text, "broken", None])
    assert json.loads(out[0]) == {"a": [{"b": 2}], "c": {"d": 4}} and out[1] is None and out[2] is None


def test_policy_windows():
    text = " ".join(f"w{i}" for i in range(100))
    plain = chunking.policy_windows(text, 40, 8)
    assert [w[2].split()[0] for w in plain] == ["w0", "w32", "w64"] and all(text[a:b] == t for a, b, t in plain)
    assert len(chunking.policy_windows(text, 40, 8, tail=True)) > len(plain)
    assert chunking.policy_windows("", 40, 8) == [] and chunking.policy_windows(None) == []
    kept = chunking.policy_windows("a " * 38 + "unless b c d e f. " + "g " * 60, 40, 8)
    assert kept[0][2].endswith("f.")


def test_paragraphs_keep_offsets(spark):
    text = "one\ntwo\n\n  \nthree\n"
    rows = sorted(chunking.paragraphs(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect(), key=lambda r: r.start)
    assert [(r.start, r.text) for r in rows] == [(0, "one two"), (12, "three")]
    assert text[rows[1].start : rows[1].end].strip() == "three"


def test_mask(spark):
    spans = "array<struct<role:string,tokens:array<bigint>>>"
    df = spark.createDataFrame([([Row(role="user", tokens=[1, 2]), Row(role="assistant", tokens=[3]), Row(role="assistant", tokens=[])],), ([],)], f"spans {spans}")
    assert [r.x for r in df.select(integrity.mask_labels().alias("x")).collect()] == [[-100, -100, 3], []]


@pytest.mark.parametrize(("e", "p", "want"), [("", "", 1.0), ("", "x", 0.0), ("Yes", " yes ", 1.0), ("yes", "oh yes indeed", 0.8), ("yes", "no", 0.0), (None, None, 1.0)])
def test_score_answer(spark, e, p, want):
    assert spark.createDataFrame([(e, p)], "e string, p string").select(tx.score_answer(F.col("e"), F.col("p")).alias("s")).first().s == want


def test_bm25_matches_the_join(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "e f"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "a d d"), ("r", "zzz")], "item_id string, question string")
    slow = {(r.item_id, r.doc_id): r.score for r in retrieval.bm25_scores(docs, "doc_id", "text", asked, "item_id", "question").collect() if r.score > 0}
    fast = {(r.item_id, r.doc_id): r.score for r in retrieval.bm25_top(docs, "doc_id", "text", asked, "item_id", "question", 5).collect()}
    assert slow == fast and len(fast) >= 1


def test_cosine_top_beyond_the_table(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = retrieval.cosine_top(v, v.where("vec_id = 1"), 10).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in rows] == [(1, 0), (3, 1), (2, 2)]


def test_readers_and_bad_lines(spark):
    path = sinks.folder(spark, "test")
    spark.createDataFrame([('{"a": 1}',), ("{bad",), ("",), ('{"a": 2}',)], "value string").coalesce(1).write.text(path)
    assert files.jsonl_lenient(spark, path, "a int").count() == 2
    assert files.count_jsonl(spark, path).first().n == 2
    assert files.count_jsonl(spark, path + "-absent").first().n == 0
    with pytest.raises(Exception, match="MALFORMED"):
        files.jsonl_strict(spark, path, "a int").collect()
    tagged = files.jsonl_tagged(spark, path).orderBy("source_line").collect()
    assert [(r.source_line, r.ok) for r in tagged] == [(1, True), (2, False), (4, True)]


def test_first_available(spark):
    path = sinks.folder(spark, "there")
    spark.range(1).write.parquet(path)
    assert files.first_available(spark, [path + "-absent", path]) == path
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [path + "-absent"])


def test_expand_variables():
    assert files.expand_variables({"a": ["${X}-${Y}", 1]}, {"X": "x"}) == {"a": ["x-", 1]}


def test_bundle_finds_a_changed_file(spark):
    s = spark.createDataFrame([("s1", "train", "x"), ("s2", "validation", "y")], "sample_id string, split string, messages string")
    d = spark.createDataFrame([("k", "t")], "kb_id string, text string")
    path = sinks.bundle(s, d, sinks.folder(spark, "bundle"))
    assert {r.state for r in sinks.verify(spark, path).collect()} == {"ok"}
    d.limit(1).write.mode("overwrite").json(f"{path}/kb")
    assert "missing" in {r.state for r in sinks.verify(spark, path).collect()}


def test_family_split_is_disjoint(spark):
    s = spark.createDataFrame([(f"s{i}", f"f{i % 7}" if i % 3 else None) for i in range(60)], "sample_id string, scenario_family string")
    out = integrity.family_split(s, 0.85, 1)
    assert out.count() == 60
    assert out.groupBy("family").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert integrity.family_split(s.limit(0), 0.85, 1).count() == 0
