"""The plain forms of the stages against their Column forms, and near duplicates against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrow, plain, text as T
from quillspark.plans import pipeline
from quillspark.plans.engine import Engine
from quillspark.plans.pipeline import Config


def _odd_texts(n=400):
    draw = random.Random(4)
    bits = ["word", "two words here and more", "five words are in this", " ", "  ", "\n", "\n\n", "\n\n\n\n", "\t", "\r\n", "\r", "```", "```py\n", "---\n", "----\n", "====\n", "=-=-\n", "<document id=1>", "</document>", "<source>s</source>", "<content> ", " </content>",
            "<chunk>\n", "</chunk>\n", "<Item a=b> \n", "&amp;", "&lt;", "&#65;", '{"a": 1}', "A sentence ends. Another begins! And?"]
    return ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(n)]


def test_plain_forms_say_the_same(spark):
    texts = _odd_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    rows = d.select("i", T.normalize_whitespace(t).alias("w"), T.deduplicate_blocks(t).alias("b"), T.strip_markup(F.replace(t, F.lit("&#65;"), F.lit(""))).alias("m"), T.truncate_code_blocks(t, 1).alias("c")).collect()
    for r in rows:
        x = texts[r.i]
        assert r.w == plain.normalize_whitespace(x)
        assert r.b == plain.deduplicate_blocks(x)
        assert r.m == plain.strip_markup(x.replace("&#65;", ""))
        assert r.c == plain.truncate_code_blocks(x, 1)


def test_kept_units_are_found_as_by_brute_force():
    draw = random.Random(7)
    base = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(5, 14))) for _ in range(40)]
    for threshold in (0.85, 0.5):
        kept, sets = arrow.Kept(threshold), []
        for _ in range(500):
            words = draw.choice(base).split()
            for _ in range(draw.randrange(3)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(60)}"
            unit = " ".join(words)
            own = arrow.shingle_set(unit)
            expected = any(len(own & s) >= threshold * len(own | s) for s in sets)
            assert kept.alike(own) == expected
            if not expected:
                sets.append(own)
                kept.add(unit, own)
        assert 10 < len(sets) < 450


def test_kept_units_may_be_bounded():
    kept = arrow.Kept(0.85, remember=2)
    for unit in ("first sentence", "second sentence here", "third one"):
        kept.add(unit, arrow.shingle_set(unit))
    alike = lambda u: kept.alike(arrow.shingle_set(u))
    assert list(kept.units) == ["second sentence here", "third one"] and alike("third one") and not alike("first sentence")


def test_tokens_of_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Some words here.", "", "größe"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    full = Tokenizer.from_file(path)
    assert [r.n for r in d.select(T.token_count(F.col("t"), f"bpe:{path}").alias("n")).collect()] == [len(full.encode(t, add_special_tokens=False).ids) for t in texts]


#: Texts of the shapes for which least reductions are asserted: by technique, in percent.
_ERROR = "ERROR [10:42] no answer from the service at 10.0.0.5\n  Trying again in 5 seconds, attempt 1 of 3\n  Look at the two settings of the service."
_LIST = "A list comprehension in Python has brackets around an expression. It is short and clear. One can also put a condition behind it."
_CASES = {
    "json": ("format", 20, json.dumps({"status": "fine", "users": [{"id": i, "name": f"User {i}", "more": {"made": "2024-01-15", "likes": {"theme": "dark", "mail": True}}} for i in range(11)]}, indent=2)),
    "test log": ("deduplication", 5, "\n\n".join([*(f"tests/test_{i}.py::test_it PASSED [{i * 5}%]\n\nDeprecationWarning: that call is old, use the other\n  warnings.warn('that call is old')" for i in range(20)), "=== 1 failed, 20 passed in 0.85s ==="])),
    "repeated talk": ("semantic_dedup", 10, "\n\n".join(f"[user] Question {i}: what are comprehensions? {_LIST}\n\n[assistant] Answer {i}: {_LIST} Here is one: x = [y for y in range(10)]. {_LIST}" for i in range(7))),
    "repeated errors": ("deduplication", 30, "\n\n".join(["INFO starting up with pid 12", *[x for i in range(4) for x in (_ERROR, f"INFO trying the service again, time {i}")], "CRITICAL giving up."])),
    "markup": ("format", 15, "<document>\n<content>\nFirst\n=====\n\nSome words.\n\n" + "\n".join(f"Part {i}\n======\n\n<chunk>\nWords of part {i} here.\n</chunk>\n" for i in range(4)) + "</content>\n</document>\n"),
    "repeated chunks": ("deduplication", 50, "\n\n---\n".join(["Retrieved text says the same thing over and over again, in the same words as before."] * 6 + ["One chunk says something else."])),
}


@pytest.mark.parametrize("name", _CASES)
def test_least_reductions(spark, name):
    technique, least, text = _CASES[name]
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pipeline.compress_documents(d, Config(techniques=(technique,))).first()
    assert row.reduction_pct >= least and row.quality_score >= 0.5
    whole = pipeline.compress_documents(d).first()
    assert whole.compressed_tokens <= row.compressed_tokens and whole.quality_score >= 0.5
    if name == "json":
        assert json.loads(row.compressed) == json.loads(text)


def test_engine(spark):
    e = Engine(Config(keep_recent=1, rag_max_tokens=10))
    said = "The quick brown fox jumps over lazy dogs today."
    turns = spark.createDataFrame([(1, i, "user", f"{said} Turn {i}.") for i in range(3)], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.text for r in e.compress_conversations(turns).collect()} == {0: f"{said} Turn 0.", 1: "Turn 1.", 2: f"{said} Turn 2."}
    chunks = spark.createDataFrame([(1, 0, "foxes and dogs"), (1, 1, "nothing of the kind is said in this long chunk of words"), (1, 2, "a fox")], "set_id long, pos long, text string")
    asked = spark.createDataFrame([(7, 1, "fox dogs"), (8, 1, " ")], "query_id long, set_id long, query string")
    picked = {}
    for r in e.select_context(chunks, asked).collect():
        picked.setdefault(r.query_id, set()).add(r.pos)
    assert picked == {7: {0, 2}, 8: {0, 1, 2}}
    cost = e.estimate_cost(spark.createDataFrame([(1, f"{said} {said}", "gpt-4o")], "doc_id long, text string, model string")).first()
    assert cost.input_cost > cost.compressed_cost > 0


def test_empty_tables(spark):
    e = Engine()
    assert e.compress_prompts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert e.compress_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
