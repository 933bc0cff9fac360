"""Registered queries over the reference's operators, and the SQL that checks them where SQL can say the same.

The tables' texts hold no blank lines, tabs or fences, so queries derive such inputs in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import arrow, text as T
from quillspark.operators import cache, conversation, logs, ranking, schemas, session
from quillspark.plans import pipeline
from quillspark.queries.base import TOKENS, WORDS, query
from quillspark.sources.readers import table

MESSY = "replace(replace(text, ', ', ',   '), chr(10), '  ' || chr(10) || chr(10) || chr(10) || chr(9))"


def messy(spark, sf):
    bad = F.replace(F.replace("text", F.lit(", "), F.lit(",   ")), F.lit("\n"), F.lit("  \n\n\n\t"))
    return table(spark, sf, "documents").select("doc_id", "source", bad.alias("text"))


@query("n1_whitespace", f"""
WITH m AS (SELECT doc_id, {MESSY} AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g') AS t FROM m),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(\\S) {{2,}}', '\\1 ', 'g') AS t FROM a)
SELECT doc_id, trim(replace(t, chr(10) || chr(9), chr(10) || '  '), chr(10)) AS text FROM b""")
def n1_whitespace(spark, sf):
    return messy(spark, sf).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("x1_block_dedup", f"""
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
ranked AS (SELECT *, len({WORDS.format('part')}) < 5 OR row_number() OVER (PARTITION BY doc_id, trim(part, ' ' || chr(9) || chr(13)) ORDER BY pos) = 1 AS stays FROM parts)
SELECT doc_id, trim(regexp_replace(string_agg(CASE WHEN stays THEN part ELSE '' END, chr(10) || chr(10) ORDER BY pos), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text
FROM ranked GROUP BY doc_id""")
def x1_block_dedup(spark, sf):
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", T.deduplicate_blocks(paragraphs).alias("text"))


@query("n4_strip_markup", """
SELECT doc_id, '---' || chr(10) || chr(10) || '[s ' || source || '] ' || text || chr(10) AS text FROM documents""")
def n4_strip_markup(spark, sf):
    wrapped = F.concat(F.lit('<document index="1">\n<source>s '), "source", F.lit("</source>\n<content>\n"), "text", F.lit("\n</content>\n</document>"), F.lit(""))
    out = T.strip_markup(wrapped)
    return table(spark, sf, "documents").select("doc_id", out.alias("text"))


@query("n4e_entities", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)) AS text FROM pages""")
def n4e_entities(spark, sf):
    t = F.col("html")
    for name, by in T.ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(by))
    return table(spark, sf, "pages").select("page_id", t.alias("text"))


@query("n2_minify_json", "SELECT event_id, replace(props, ': ', ':') AS text FROM events")
def n2_minify_json(spark, sf):
    return table(spark, sf, "events").select("event_id", arrow.optimize_format(F.col("props")).alias("text"))


@query("n6_truncate_code", """
SELECT doc_id, 'x' || chr(10) || '```' || chr(10) || array_to_string(list_transform(range(1, 21), lambda i: 'line ' || (i + doc_id)), chr(10)) || chr(10)
  || '... (' || (50 + doc_id % 10 - 40) || ' lines omitted) ...' || chr(10)
  || array_to_string(list_transform(range(31 + doc_id % 10, 51 + doc_id % 10), lambda i: 'line ' || (i + doc_id)), chr(10)) || chr(10) || '```' AS text FROM documents""")
def n6_truncate_code(spark, sf):
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50) + F.col("doc_id") % 10), lambda i: F.concat(F.lit("line "), (i + F.col("doc_id")).cast("string"))), "\n")
    fenced = F.concat(F.lit("x\n```\n"), body, F.lit("\n```"))
    return table(spark, sf, "documents").select("doc_id", T.truncate_code_blocks(fenced, 40).alias("text"))


@query("l3_sentences", """
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS u FROM documents)
SELECT doc_id, unnest(range(len(u))) AS pos, unnest(u) AS sentence FROM s""")
def l3_sentences(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("l5_char_shingles", """
WITH t AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark)
SELECT item_id, CAST(len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) AS BIGINT) AS n FROM t""")
def l5_char_shingles(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(T.char_shingles(F.col("text"))).cast("long").alias("n"))


@query("j7_simhash", f"""
WITH w AS (SELECT item_id, {WORDS.format('lower(text)')} AS w FROM benchmark),
sh AS (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i+1:i+3], ' '))) AS s FROM w),
h AS (SELECT item_id, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM sh),
bits AS (SELECT item_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(64) r(b) GROUP BY ALL)
SELECT item_id, CAST(sum(CASE WHEN v <= 0 THEN 0::HUGEINT WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b) END) AS BIGINT) AS simhash FROM bits GROUP BY item_id""")
def j7_simhash(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.simhash(F.col("text")).alias("simhash"))


@query("m_token_metrics", f"""
SELECT doc_id, {TOKENS.format('text')} AS approx, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS chars FROM documents""")
def m_token_metrics(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.token_count(t).alias("approx"), T.token_count(t, "chars").alias("chars"))


@query("m6_quality", f"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(left(text, CAST(length(text) // 2 AS BIGINT))), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM documents)
SELECT doc_id, CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END AS score FROM w""")
def m6_quality(spark, sf):
    half = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    return table(spark, sf, "documents").select("doc_id", T.quality_score(F.col("text"), half).alias("score"))


@query("m7_message_counts", f"""
SELECT conv_id, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS per_message,
       CAST(ceil(sum(len({WORDS.format('text')})) * 1.3::DOUBLE) AS BIGINT) AS at_once FROM conversations GROUP BY conv_id""")
def m7_message_counts(spark, sf):
    return conversation.count_messages(table(spark, sf, "conversations"))


@query("m9_cost", f"""
WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'unknown' END AS model, {TOKENS.format('text')} AS a, {TOKENS.format("replace(text, 'the ', '')")} AS b FROM documents),
r AS (SELECT *, CASE model WHEN 'gpt-4o' THEN 2.5::DOUBLE WHEN 'gpt-4o-mini' THEN 0.15::DOUBLE ELSE 3.0::DOUBLE END / 1e6::DOUBLE AS rate FROM n)
SELECT doc_id, a * rate AS input_cost, b * rate AS compressed_cost, a * rate - b * rate AS savings, CASE WHEN a * rate = 0 THEN 0.0::DOUBLE ELSE (a * rate - b * rate) / (a * rate) * 100 END AS savings_pct FROM r""")
def m9_cost(spark, sf):
    t = F.col("text")
    model = F.when(F.col("doc_id") % 3 == 0, "gpt-4o").when(F.col("doc_id") % 3 == 1, "gpt-4o-mini").otherwise("unknown")
    d = table(spark, sf, "documents").select("doc_id", model.alias("model"), T.token_count(t).alias("original_tokens"), T.token_count(F.replace(t, F.lit("the "), F.lit(""))).alias("compressed_tokens"))
    return pipeline.estimate_cost(d).select("doc_id", "input_cost", "compressed_cost", "savings", "savings_pct")


_STOP = ", ".join(f"'{w}'" for w in T.RANKING_STOPWORDS)


@query("r1_bm25", f"""
WITH chunks AS (SELECT source AS set_id, doc_id AS pos, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
stats AS (SELECT set_id, count(*) AS n, greatest(avg(len(w)), 1.0) AS avg_len FROM chunks GROUP BY 1),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS set_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})))) AS term FROM benchmark),
tf AS (SELECT set_id, pos, len, term, count(*) AS tf FROM (SELECT set_id, pos, len(w) AS len, unnest(w) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT set_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, set_id, pos, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 9) AS score
      FROM q JOIN tf USING (set_id, term) JOIN df USING (set_id, term) JOIN stats USING (set_id) GROUP BY ALL)
SELECT b.item_id AS query_id, c.pos, round(coalesce(s.score, 0), 6) AS score
FROM benchmark b JOIN chunks c ON c.set_id = 'src' || (b.item_id % 20) LEFT JOIN s ON s.query_id = b.item_id AND s.pos = c.pos""")
def r1_bm25(spark, sf):
    return ranking.bm25_scores(*_contexts(spark, sf)).select("query_id", "pos", F.round("score", 6).alias("score"))


def _contexts(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("source").alias("set_id"), F.col("doc_id").alias("pos"), "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("set_id"), F.col("text").alias("query"))
    return chunks, asked


@query("c1_recent_turns", """
SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def c1_recent_turns(spark, sf):
    turns = table(spark, sf, "conversations")
    kept = conversation.compress_history(turns, 2)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return kept.withColumn("n", F.row_number().over(newest)).filter("n <= 2").drop("n")


@query("c7_request_parts", """
WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS s, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system') AS r FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(s, '') AS system, CASE WHEN coalesce(s, '') = '' THEN coalesce(r, '') ELSE s || chr(10) || coalesce(r, '') END AS cache_text FROM p""")
def c7_request_parts(spark, sf):
    return conversation.request_parts(table(spark, sf, "conversations"))


def _cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"))
    held = cache.entries(d.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), "model", F.col("text").alias("response"), F.col("doc_id").cast("double").alias("created_at")), 100_000)
    b = table(spark, sf, "benchmark")
    asked = b.join(d, F.col("item_id") == F.col("doc_id"), "left")
    model = F.concat(F.lit("m"), (F.col("item_id") % 3).cast("string"))
    return held, asked.select(F.col("item_id").alias("request_id"), F.coalesce(d["text"], b["text"]).alias("prompt"), model.alias("model"), F.lit(50_000.0).alias("now"))


@query("h3_live_entries", "SELECT doc_id AS id, 'm' || (doc_id % 3) AS model FROM documents WHERE 100500 - doc_id <= 100000")
def h3_live_entries(spark, sf):
    return cache.live(_cache(spark, sf)[0], 100_500.0).select("id", "model")


USAGE = "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(round(value * 100) AS BIGINT) AS n FROM events"


@query("b1_budget", f"""
WITH u AS ({USAGE}), s AS (SELECT *, count(*) OVER w AS turns, sum(n) OVER w AS output_tokens FROM u WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, turns, CAST(output_tokens AS BIGINT) AS output_tokens, output_tokens / 180000.0::DOUBLE AS fill,
  output_tokens / 180000.0::DOUBLE >= 0.7 AND sum(CASE WHEN output_tokens / 180000.0::DOUBLE >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) = 1 AS alert FROM s""")
def b1_budget(spark, sf):
    return session.track_budget(_usage(spark, sf)).select("session_id", "seq", "turns", "output_tokens", "fill", "alert")


def _usage(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.row_number().over(order).alias("seq"), F.lit("").alias("text"),
        F.lit(None).cast("long").alias("input_tokens"), F.round(F.col("value") * 100).cast("long").alias("output_tokens"),
    )


@query("b5_once_per_session", f"SELECT session_id, seq FROM ({USAGE}) WHERE seq = 1")
def b5_once_per_session(spark, sf):
    return session.once_per_session(_usage(spark, sf)).select("session_id", "seq")


@query("b6_session_key", "SELECT DISTINCT user_id, substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS session_key FROM events")
def b6_session_key(spark, sf):
    return table(spark, sf, "events").select("user_id", session.session_key(F.col("user_id").cast("string")).alias("session_key")).distinct()


@query("x6_read_deltas", """
WITH r AS (SELECT user_id AS session_id, event_type AS path, event_id AS seq, props AS content, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old FROM events)
SELECT session_id, path, seq, CASE WHEN old IS NULL THEN 'new' WHEN old = content THEN 'unchanged' ELSE 'full' END AS kind FROM r""")
def x6_read_deltas(spark, sf):
    reads = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"), F.col("props").alias("content"))
    return session.read_deltas(reads).select("session_id", "path", "seq", "kind")


LOG = "SELECT user_id, string_agg({}, chr(10) ORDER BY event_id) AS output FROM events GROUP BY user_id"


def _log(spark, sf, line):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x.line)
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(rows, "\n").alias("output"))


def _line(*cases):
    out = F.when(F.lit(False), "")
    for remainder, text in cases[:-1]:
        out = out.when(F.col("event_id") % 7 == remainder, text)
    return out.otherwise(cases[-1])


def _line_sql(*cases):
    return "CASE event_id % 7 " + " ".join(f"WHEN {r} THEN '{t}'" for r, t in cases[:-1]) + f" ELSE '{cases[-1]}' END"


_INSTALL = ((0, "added 3 packages"), (1, "npm http fetch error"), (2, "WARN deprecated"), "resolving")
_PYTEST = ((0, "a warning here"), (1, "x.py ."), (2, "y.py F"), "ok")
_GIT = ((0, "Author: x"), (1, ""), (2, "Date: now"), (3, ""), "commit")


@query("f2_install_log", f"""
WITH l AS (SELECT user_id, event_id, {_line_sql(*_INSTALL)} AS line FROM events),
k AS (SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) FILTER (WHERE line IN ('added 3 packages', 'WARN deprecated')) AS kept, count(*) FILTER (WHERE line IN ('added 3 packages', 'WARN deprecated')) AS n, string_agg(line, chr(10) ORDER BY event_id) AS everything FROM l GROUP BY 1)
SELECT user_id, CASE WHEN n >= 3 THEN kept ELSE everything END AS text FROM k""")
def f2_install_log(spark, sf):
    return _log(spark, sf, _line(*_INSTALL)).select("user_id", logs.install_output(F.col("output")).alias("text"))


@query("f1_pytest_log", f"""
WITH l AS (SELECT user_id, event_id, {_line_sql(*_PYTEST)} AS line FROM events)
SELECT user_id, coalesce(string_agg(line, chr(10) ORDER BY event_id) FILTER (WHERE line LIKE '%warning%'), string_agg(line, chr(10) ORDER BY event_id)) AS text FROM l GROUP BY 1""")
def f1_pytest_log(spark, sf):
    return _log(spark, sf, _line(*_PYTEST)).select("user_id", logs.pytest_output(F.col("output")).alias("text"))


@query("f3_git_log", f"""
WITH l AS (SELECT user_id, event_id, {_line_sql(*_GIT)} AS line FROM events),
last AS (SELECT user_id, max(event_id) AS final FROM events GROUP BY 1),
b AS (SELECT l.*, lag(line) OVER (PARTITION BY l.user_id ORDER BY event_id) AS prev FROM l JOIN last USING (user_id)
      WHERE line NOT LIKE 'Author:%' AND line NOT LIKE 'Date:%' AND NOT (line = '' AND event_id = final)),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, coalesce(string_agg(line, chr(10) ORDER BY event_id) FILTER (WHERE NOT (line = '' AND coalesce(prev, 'x') = '')), '') AS text FROM u LEFT JOIN b ON u.user_id = b.user_id GROUP BY 1""")
def f3_git_log(spark, sf):
    return _log(spark, sf, _line(*_GIT)).select("user_id", logs.git_log_output(F.col("output")).alias("text"))


@query("f0_filter_dispatch", f"""
WITH l AS ({LOG.format(_line_sql(*_INSTALL))})
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'install' WHEN 2 THEN 'build' ELSE 'other' END AS kind FROM l""")
def f0_filter_dispatch(spark, sf):
    command = F.when(F.col("user_id") % 4 == 0, "python -m pytest -q").when(F.col("user_id") % 4 == 1, "npm install").when(F.col("user_id") % 4 == 2, "make all").otherwise("ls")
    return _log(spark, sf, _line(*_INSTALL)).select("user_id", logs.kind_of(command, F.col("output")).alias("kind"))


@query("f13_profiles", """
SELECT user_id, CASE WHEN f < 0.4 THEN 150 WHEN f < 0.7 THEN 75 ELSE 50 END AS min_tokens, CASE WHEN f < 0.7 THEN 60 ELSE 40 END AS longest
FROM (SELECT DISTINCT user_id, (user_id % 10) / 10.0::DOUBLE AS f FROM events)""")
def f13_profiles(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    p = session.tool_profile(F.lit("Bash"), F.col("user_id") % 10 / F.lit(10.0))
    return users.select("user_id", p.min_tokens.alias("min_tokens"), p.max_code_block_lines.alias("longest"))


@query("f15_rewrite", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'head -100 f' || event_id WHEN 1 THEN CASE WHEN event_id % 10 >= 4 THEN 'ls -la | head -40' ELSE 'ls -l' END
  WHEN 2 THEN CASE WHEN event_id % 10 >= 7 THEN 'npm test -- --reporter=min' ELSE 'npm test' END ELSE 'pwd' END AS command FROM events""")
def f15_rewrite(spark, sf):
    e = F.col("event_id")
    made = F.when(e % 4 == 0, F.concat(F.lit("cat f"), e.cast("string"))).when(e % 4 == 1, "ls -l").when(e % 4 == 2, "npm test").otherwise("pwd")
    return table(spark, sf, "events").select("event_id", session.rewrite_command(made, e % 10 / F.lit(10.0)).alias("command"))
