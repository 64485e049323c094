"""Bundles and their checks, settings files, hashes of exports."""

import json

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import bundles as bd
from loomlake.operators import integrity as it
from loomlake.sources import files, sinks

MESSAGES = "array<struct<role:string,content:string>>"


def whole(spark, rows=None):
    rows = rows or [(f"s{i}", [("user", "q"), ("assistant", "an answer")], "policy_qa", "train" if i % 3 else "validation") for i in range(9)]
    samples = spark.createDataFrame(rows, f"sample_id string, messages {MESSAGES}, sample_type string, split string")
    return sinks.bundle(samples, spark.createDataFrame([("k", "t")], "kb_id string, text string"), sinks.folder(spark, "b"), spark.createDataFrame([("s1",)], "sample_id string"))


def issues(report):
    return {(r.check, r.name, r.severity) for r in report.where("severity <> 'ok'").collect()}


def test_a_sound_bundle_has_warnings_only(spark):
    path = whole(spark)
    assert {s for *_, s in issues(bd.validate(spark, path))} == {"warning"}
    assert bd.verdict(bd.validate(spark, path)).first().valid
    strict = bd.validate(spark, path, strict=True)
    assert {s for *_, s in issues(strict)} == {"warning"} and not bd.verdict(strict, strict=True).first().valid
    card = [r.value for r in spark.read.text(f"{path}/card").collect()]
    assert card[0] == "# bundle v1" and "| train | policy_qa | 6 |" in card
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    assert manifest["canonical_train_count"] == 6 and len(manifest["bundle_hash"]) == 64


def test_spoilt_bundles_are_found_out(spark):
    path = whole(spark)
    spark.createDataFrame([("s99", "train")], "sample_id string, split string").write.mode("append").partitionBy("split").json(f"{path}/canonical")
    spark.createDataFrame([("x", "validation")], "y string, split string").write.mode("append").partitionBy("split").json(f"{path}/training/osft")
    spark.createDataFrame([(None,)], "text string").write.mode("overwrite").json(f"{path}/kb")
    assert {("size", "train", "error"), ("checksum", "missing", "error")} <= issues(bd.validate(spark, path))
    strict = issues(bd.validate(spark, path, strict=True))
    assert {("fields", "train", "error"), ("fields", "kb", "warning"), ("parity", "validation", "error"), ("canonical and lora", "train", "warning")} <= strict
    assert issues(bd.validate(spark, sinks.folder(spark, "none"))) == {("entry", "manifest", "error")}


def test_an_empty_entry_is_an_error_under_strict_checks_only(spark):
    path = whole(spark)
    spark.createDataFrame([("",)], "value string").limit(0).coalesce(1).write.mode("overwrite").text(f"{path}/kb")
    assert ("entry", "kb", "error") in issues(bd.validate(spark, path, strict=True))


def test_a_size_of_zero_is_not_checked_under_strict_checks(spark):
    path = whole(spark)
    sinks.one_object(spark, f"{path}/manifest", {"bundle_name": "b", "canonical_train_count": 0, "canonical_validation_count": 3})
    strict = issues(bd.validate(spark, path, strict=True))
    assert ("size", "train", "error") not in strict and {("manifest", "model_id", "error"), ("manifest", "bundle_version", "error")} <= strict
    assert ("size", "train", "error") in issues(bd.validate(spark, path))


def test_special_tokens(spark):
    rows = [([1, 5, 2],), ([5, 2],), ([1, 5],), ([1, 5, 2, 0, 0],), ([1, 0, 5, 2],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "ids array<int>").select(bd.special_tokens("ids", 1, 2, 0)).collect()]
    assert got == [[], ["begin"], ["end"], ["end"], ["padding"], ["empty"], ["empty"]]
    assert spark.createDataFrame([([7],)], "ids array<int>").select(bd.special_tokens("ids", None, None, None)).first()[0] == []


def test_training_readiness(spark):
    path = whole(spark)
    encode = lambda m: F.concat(F.array(F.lit(1)), F.transform(m, lambda x: F.length(x["content"]) + 9), F.array(F.lit(2)))
    labels = lambda m: F.transform(m, lambda x: F.when(x["role"] == "assistant", 1).otherwise(-100))
    ready = lambda p, e=encode, n=9: {r.check: r.ok for r in bd.training_ready(spark, p, "lora", e, labels, 1, 2, 0, n).collect()}
    assert set(ready(path).values()) == {True} and not ready(path, n=3)["length"]
    assert not ready(path, lambda m: F.slice(encode(m), 1, 3))["marks"]
    mute = whole(spark, [("a", [("user", "q")], None, "train")])
    assert ready(mute) == {"loader train": True, "loader validation": False, "rows": True, "labels": False, "marks": True, "length": True}
    with pytest.raises(ValueError, match="unknown backend"):
        bd.training_ready(spark, path, "other", encode, labels, 1, 2, 0, 9)


def test_a_run_goes_on_from_its_checkpoint(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    path = sinks.folder(spark, "state")
    left, cost = sinks.resumed(spark, path, ids("a", "b"), "sample_id")
    assert left.count() == 2 and cost == 0
    for done in (("a",), ("a", "b")):
        sinks.checkpoint(path, ids(*done), ids("z"), ids("a"), 0.5 * len(done))
    left, cost = sinks.resumed(spark, path, ids("a", "b", "c", "z"), "sample_id")
    assert [r.sample_id for r in left.collect()] == ["c"] and cost == 1.0


YAML = """
# settings
name: "a: b"   # quoted
rate: 0.5
on: true
none:
list:
  - one
  - two: 2
    three: [1, x, "y"]
  -
    deep: ${ROOT}/x
nested:
  empty: {}
  more:
    text: it's # here
same:
- 1
- 2
"""


def test_settings():
    made = files.expand_variables(files.parse_yaml(YAML), {"ROOT": "/r"})
    assert made == {
        "name": "a: b", "rate": 0.5, "on": True, "none": None, "list": ["one", {"two": 2, "three": [1, "x", "y"]}, {"deep": "/r/x"}], "nested": {"empty": {}, "more": {"text": "it's # here"}}, "same": [1, 2],
    }
    assert files.parse_yaml("") == {} and files.flat({"a": [1, {"b": None}]}) == {"a.0": "1", "a.1.b": ""}
    for bad in ("a: &x 1", "a: |\n  text", "a: 1\n   b: 2", "just text"):
        with pytest.raises(ValueError, match="settings|indentation"):
            files.parse_yaml(bad)


def test_hashes_and_first_source(spark):
    import hashlib

    df = spark.createDataFrame([(3, "epi\"sodes", None)], "k int, track string, x string")
    text = json.dumps({"k": 3, "track": 'epi"sodes', "x": None}, sort_keys=True)
    assert df.select(tx.config_hash("track", "x", "k")).first()[0] == hashlib.sha256(text.encode()).hexdigest()[:16]
    d = spark.createDataFrame([("b", "02"), ("a", "01")], "path string, sha256 string")
    assert it.weights_hash(d).first()[0] == hashlib.sha256(b"0102").hexdigest()[:16]
    path = sinks.one_object(spark, sinks.folder(spark, "one"), {"a": 1})
    assert files.fetch(spark, {"local": "/nowhere/x", "shared": path, "remote": "/no"}) == ("shared", path)
    with pytest.raises(FileNotFoundError):
        files.fetch(spark, {"local": "/nowhere/x"})


def test_running_cost_in_slices(spark):
    rows = [(i, i % 7) for i in range(300)] + [(None, 2)]
    got = {r.n: r.spent_before for r in it.budget_spend(spark.createDataFrame(rows, "n int, cost int"), "n", "cost", 200, slices=9).collect()}
    want, spent = {}, 0
    for n, cost in [(None, 2), *rows[:-1]]:
        if spent < 200:
            want[n] = spent
        spent += cost
    assert got == want
