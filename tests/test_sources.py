"""Readers and sinks, by round trips through files."""

import json

from pyspark.sql import functions as F

from quillspark.operators.session import OTHER_TOOL, PROFILES
from quillspark.sources import readers


def test_prompts_and_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert readers.read_prompts(spark, str(tmp_path / "a.txt")).first().text == "one\n\ntwo"
    readers.write_texts(spark.createDataFrame([("x",)], "text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "x"


def test_conversations(spark, tmp_path):
    turns = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "url": "u"}, {"type": "text", "text": "b"}]}, {"role": "user"}]
    (tmp_path / "c.json").write_text(json.dumps(turns))
    rows = readers.read_conversations(spark, str(tmp_path / "c.json")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in rows] == [(0, "user", "hi"), (1, "assistant", "a b"), (2, "user", None)]
    assert [b.type for b in rows[1].blocks] == ["text", "image_url", "text"] and rows[0].blocks is None


def test_tool_events(spark):
    raw = spark.createDataFrame([('{"tool_name": "Bash", "output": "o", "tool_input": {"command": "ls"}, "session_id": "s"}',), ("not json",)], "value string")
    assert [tuple(r) for r in readers.read_tool_events(raw).collect()] == [("Bash", "ls", None, "o", "s")]


def test_prices(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"models": {"m": {"input_per_mtok": 1.5, "output_per_mtok": 2}}}')
    (tmp_path / "bad.json").write_text("{")
    assert [tuple(r) for r in readers.read_prices(spark, str(tmp_path / "p.json")).collect()] == [("m", 1.5, 2.0)]
    assert readers.read_prices(spark, str(tmp_path / "bad.json")).count() == 0


def test_results_and_chunks(spark, tmp_path):
    done = spark.createDataFrame([(1, "c", 10, 4, 60.04)], "doc_id long, compressed string, original_tokens long, compressed_tokens long, reduction_pct double")
    readers.write_results(done, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).select("compressed_text", "reduction_pct").first() == ("c", 60.0)
    picked = spark.createDataFrame([(1, 2, "b"), (1, 0, "a")], "query_id long, pos long, text string")
    assert readers.join_chunks(picked).first().text == "a\n---\nb"


def test_sessions(spark, tmp_path):
    d = spark.range(2).select(F.concat(F.lit("k"), "id").alias("session_key"), *[(F.col("id") + 5).alias(c) for c in ("output_tokens", "input_tokens", "turns")], F.lit(0.5).alias("fill_fraction"), F.lit(1).cast("long").alias("turn_number"))
    readers.write_sessions(d, str(tmp_path / "s"))
    with open(tmp_path / "s" / "more.json", "w") as f:
        f.write('{"session_key": "k9", "turns": 3}\nnot json\n')
    got = {r.session_key: r for r in readers.read_sessions(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {"k0", "k1", "k9"} and got["k1"].turns == 6 and (got["k9"].turns, got["k9"].output_tokens, got["k9"].fill_fraction) == (3, 0, 0.0)


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Bash": {"techniques": ["whitespace"], "min_tokens": 9}, "New": {}}')
    (tmp_path / "bad.json").write_text("[")
    got = readers.read_profiles(spark, str(tmp_path / "p.json"))
    assert got["Bash"] == (["whitespace"], 9, OTHER_TOOL[2]) and got["New"] == OTHER_TOOL and got["Read"] == PROFILES["Read"]
    for path in (None, str(tmp_path / "none.json"), str(tmp_path / "bad.json")):
        assert readers.read_profiles(spark, path) == PROFILES
