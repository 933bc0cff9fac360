from pyspark.sql import functions as F

from quillspark.functions import arrow, plain, text as T
from quillspark.operators import logs, session
from quillspark.plans import pipeline
from quillspark.streaming.compress import StreamState


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("out")).first().out


def test_whitespace(spark):
    assert one(spark, "a  b \r\n\n\n\n\t\tc", T.normalize_whitespace) == "a b\n\n    c"
    assert one(spark, "A\n```\nx  y\n```\nB", T.normalize_whitespace) == "A```\nx  y\n```B"
    assert one(spark, None, T.normalize_whitespace) == ""


def test_block_dedup(spark):
    block = "one two three four five"
    assert one(spark, f"{block}\n\nx\n\n{block}\n\nx", T.deduplicate_blocks) == f"{block}\n\nx\n\nx"


def test_markup(spark):
    wrapped = '<document index="1">\n<source>a</source>\n<content>\nT &amp;lt;\n</content>\n</document>'
    assert one(spark, wrapped, T.strip_markup) == "---\n\n[a] T <\n"


def test_semantic_dedup_keeps_the_first():
    s = "The quick brown fox jumps over lazy dogs today."
    assert arrow.leader_fold(f"{s} {s} Short one.") == f"{s} Short one."


def test_json_keeps_order_and_escapes():
    assert plain.compact_json('{"b": 1.0, "a": "é"}') == '{"b":1.0,"a":"\\u00e9"}'
    assert plain.compact_json("{x") is None


def test_traceback_frames():
    frames = "".join(f'  File "f{i}"\n    line {i}\n' for i in range(8))
    out = arrow.shorten_tracebacks(f"Traceback (most recent call last):\n{frames}ValueError: x")
    assert "(2 frames omitted)" in out and out.endswith("ValueError: x") and "f3" not in out


def test_pytest_log(spark):
    log = "x.py .\n=== FAILURES ===\nboom\n=== 1 failed, 2 passed in 1s ==="
    assert one(spark, log, logs.pytest_output) == "=== FAILURES ===\nboom\n=== 1 failed, 2 passed in 1s ==="


def test_jest_and_grep(spark):
    assert one(spark, "PASS a\nFAIL b\nwhy\nTests: 1", logs.jest_output) == "[1 suite(s) passed -- omitted]\nFAIL b\nwhy\nTests: 1"
    assert one(spark, "a:1:x\n--\nb:2:x", logs.grep_output).startswith("a:1:x\n[1 duplicate")


def test_rewrite(spark):
    d = spark.createDataFrame([("cat f", 0.0), ("ls -l", 0.5), ("cargo test", 0.1)], "c string, f double")
    assert [r[0] for r in d.select(session.rewrite_command(F.col("c"), F.col("f"))).collect()] == ["head -100 f", "ls -la | head -40", "cargo test"]


def test_pipeline_isolates_faults(spark):
    p = pipeline.Pipeline().add(pipeline.function_stage("bad", lambda t: 1 / 0))
    row = p.run(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert row.compressed == "a b" and row.ratio == 0.0 and row.quality_score == 1.0


def test_stream_paragraphs():
    s = StreamState()
    said = "The quick brown fox jumps over lazy dogs today."
    assert s.feed(f"{said}\n\n{said}\n\nta") == f"{said}\n\n"
    assert s.feed("il") == "" and s.flush() == "tail"


def test_stream_says_what_the_batch_says(spark):
    """A stream's paragraphs against the pipeline on each paragraph, with sentences remembered across them."""
    import random

    draw = random.Random(3)
    said = [f"The {a} fox jumps over {b} lazy dogs near the old river." for a in ("brown", "red", "black") for b in ("two", "nine")]
    paragraphs = [f"<content>{'   '.join(draw.sample(said, 2))}</content>\n\tindented &amp; more" for _ in range(12)]
    text = "\n\n".join(paragraphs)
    s, out, i = StreamState(), "", 0
    while i < len(text):
        n = draw.randrange(1, 30)
        out += s.feed(text[i : i + n])
        i += n
    out += s.flush()
    d = spark.createDataFrame([(i, p) for i, p in enumerate(paragraphs)], "doc_id int, text string")
    lossless = {r.doc_id: r.compressed for r in pipeline.compress_documents(d, pipeline.Config(techniques=("whitespace", "deduplication", "format"))).collect()}
    kept = arrow.Kept()
    assert out == "\n\n".join(x for i in range(12) if (x := arrow.leader_fold(lossless[i], kept)))
    assert 1 < len(out) < len(text)


def test_eslint_without_findings_stays():
    report = '[{"filePath":"a.js","messages":[]}]'
    assert arrow.summarize_eslint(report) == report and arrow.summarize_eslint("no json") is None


def test_a_read_again_is_known(spark):
    body = "\n".join(f"line {i}" for i in range(100))
    rows = [("Read", None, body, 0.1, "s", "a.py", 1), ("Read", None, body, 0.1, "s", "a.py", 2), ("Read", None, body + "\nmore", 0.1, "s", "a.py", 3), ("Read", None, "x", 0.1, "s", None, 4), ("Other", None, "x", 0.1, "s", None, 5)]
    d = spark.createDataFrame(rows, "tool_name string, command string, output string, fill double, session_id string, path string, seq long")
    got = {r.seq: r.shown for r in pipeline.compress_tool_events(d).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] is None and got[2].startswith("[a.py: unchanged") and "+more" in got[3] and got[4] is None and got[5] is None
