"""Queries over conversations, ranking, the response cache and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions.text import token_count
from quillspark.operators import cache, conversation, ranking
from quillspark.plans.pipeline import Config
from quillspark.queries.base import TOKENS, WORDS, query
from quillspark.queries.reduction import _STOP, _cache, _contexts
from quillspark.sources.readers import table
from quillspark.streaming.compress import compress_stream

NL = "chr(10)"
_SAID = "The quick brown fox jumps over lazy dogs today."
#: SQL for a sentence of its own for each turn.
_OWN = "'Note ' || substr(md5(conv_id || ':' || turn), 1, 8) || ' ' || substr(md5(conv_id || ':' || turn), 9, 8) || ' ' || substr(md5(conv_id || ':' || turn), 17, 8) || ' and ' || substr(md5(conv_id || ':' || turn), 25, 8) || '.'"
_TURNS = f"SELECT conv_id, turn, role, {_OWN} AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations"


def _own():
    h = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return F.concat(F.lit("Note "), F.substring(h, 1, 8), F.lit(" "), F.substring(h, 9, 8), F.lit(" "), F.substring(h, 17, 8), F.lit(" and "), F.substring(h, 25, 8), F.lit("."))


def _turns(spark, sf):
    """Every turn says the same sentence and one of its own; every fifth is blank."""
    text = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit(f"{_SAID}   "), _own()))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("text"))


@query("c1_compress_history", f"""
WITH t AS ({_TURNS})
SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN '' WHEN back <= 2 THEN '{_SAID}   ' || own WHEN n = 1 THEN '{_SAID} ' || own ELSE own END AS text
FROM t WHERE back <= 2 OR turn % 5 <> 4""")
def c1_compress_history(spark, sf):
    return conversation.compress_history(_turns(spark, sf), 2)


@query("c1_nothing_to_keep", "SELECT conv_id, turn, role, text FROM conversations")
def c1_nothing_to_keep(spark, sf):
    return conversation.compress_history(table(spark, sf, "conversations"), 0)


@query("c2_message_blocks", f"""
WITH t AS ({_TURNS})
SELECT conv_id, turn, role, CASE WHEN back <= 2 THEN 'text:{_SAID}|text:' || own || '|image:|text:{_SAID}'
  WHEN n = 1 THEN 'text:{_SAID}|text:' || own || '|image:' ELSE 'text:' || own || '|image:' END AS said FROM t""")
def c2_message_blocks(spark, sf):
    block = lambda kind, text, url=None: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(url).cast("string").alias("url"))
    blocks = F.array(block("text", F.lit(_SAID)), block("text", _own()), block("image", F.lit(None).cast("string"), "u"), block("text", F.lit(_SAID)))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", blocks.alias("blocks"))
    said = F.transform("blocks", lambda b: F.concat(b.type, F.lit(":"), F.coalesce(b.text, F.lit(""))))
    return conversation.compress_block_history(turns, 2).select("conv_id", "turn", "role", F.array_join(said, "|").alias("said"))


@query("c4_summaries", """
WITH u AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS u FROM documents),
k AS (SELECT doc_id, text, u, len(u) AS n, CAST(greatest(2, ceil(len(u) / 3.0::DOUBLE)) AS BIGINT) AS keep FROM u),
s AS (SELECT doc_id, n, keep, unnest(u) AS s, generate_subscripts(u, 1) AS i FROM k WHERE n > 2 AND keep < n),
w AS (SELECT *, regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+') AS w FROM s),
t AS (SELECT doc_id, n, i, len(w) AS size, unnest(w) AS t FROM w),
tf AS (SELECT doc_id, n, i, size, t, count(*) AS c FROM t GROUP BY ALL),
df AS (SELECT doc_id, t, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT doc_id, i, round(sum(c / CAST(size AS DOUBLE) * ln((n + 1) / CAST(df + 1 AS DOUBLE))), 9) AS score FROM tf JOIN df USING (doc_id, t) GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) DESC, s.i) AS rank FROM s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.i = sc.i),
o AS (SELECT doc_id, '[Summary: ' || any_value(n) || '->' || any_value(keep) || ' sentences] ' || string_agg(s, ' ' ORDER BY i) AS text FROM r WHERE rank <= keep GROUP BY 1)
SELECT k.doc_id, coalesce(o.text, k.text) AS text FROM k LEFT JOIN o USING (doc_id)""")
def c4_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", conversation.summary(F.col("text"), 3).alias("text"))


@query("c5_system_first", f"""
WITH t AS (SELECT *, CASE WHEN turn = 0 THEN 'system' ELSE role END AS who FROM ({_TURNS})),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, who = 'system' ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, who = 'system' ORDER BY turn DESC) AS b FROM t),
o AS (SELECT conv_id, turn, who AS role, CASE WHEN who = 'system' THEN '{_SAID} ' || own WHEN b <= 2 THEN '{_SAID}   ' || own || ' {_SAID}' WHEN k = 1 THEN '{_SAID} ' || own ELSE own END AS text FROM h)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, turn) - 1 AS INTEGER) AS pos, role, text FROM o""")
def c5_system_first(spark, sf):
    return conversation.system_first_messages(_with_system(spark, sf), Config(), 2)


def _with_system(spark, sf):
    """The first turn is the system's, and every turn says its sentence twice."""
    role = F.when(F.col("turn") == 0, "system").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), F.concat(F.lit(f"{_SAID}   "), _own(), F.lit(f" {_SAID}")).alias("text"))


@query("c6_system_apart", f"""
WITH t AS (SELECT *, CASE WHEN turn = 0 THEN 'system' ELSE role END AS who FROM ({_TURNS})),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, who = 'system' ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id, who = 'system' ORDER BY turn DESC) AS b FROM t),
m AS (SELECT conv_id, turn, who, k, CASE WHEN b <= 2 THEN '{_SAID}   ' || own || ' {_SAID}' WHEN k = 1 THEN '{_SAID} ' || own ELSE own END AS text, own FROM h),
s AS (SELECT conv_id, '{_SAID} ' || string_agg(own, {NL} ORDER BY turn) AS system FROM m WHERE who = 'system' GROUP BY 1),
r AS (SELECT conv_id, string_agg(text, {NL} ORDER BY turn) AS said, string_agg(who, ',' ORDER BY turn) AS roles FROM m WHERE who <> 'system' GROUP BY 1)
SELECT conv_id, coalesce(s.system, '') AS system, coalesce(r.roles, '') AS roles, CASE WHEN s.system IS NULL THEN r.said ELSE s.system || {NL} || coalesce(r.said, '') END AS cache_text FROM s FULL JOIN r USING (conv_id) WHERE conv_id IN (SELECT conv_id FROM m WHERE who = 'system' GROUP BY 1 HAVING count(*) = 1)""")
def c6_system_apart(spark, sf):
    """Conversations with one system turn."""
    turns = _with_system(spark, sf)
    one = turns.groupBy("conv_id").agg(F.count(F.when(F.col("role") == "system", 1)).alias("n")).filter("n = 1").select("conv_id")
    found = conversation.system_apart_requests(turns.join(one, "conv_id", "left_semi"), Config(), 2)
    return found.select("conv_id", "system", F.array_join(F.transform("messages", lambda m: m.role), ",").alias("roles"), "cache_text")


@query("s3_split_chunks", """
WITH p AS (SELECT doc_id AS set_id, string_split(replace(replace(text, '. ', ' --- '), ', ', '---'), '---') AS parts FROM documents),
f AS (SELECT set_id, list_filter(list_transform(parts, lambda p: trim(p, ' ' || chr(10) || chr(9) || chr(13))), lambda p: p <> '') AS parts FROM p)
SELECT set_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS text FROM f""")
def s3_split_chunks(spark, sf):
    made = F.replace(F.replace("text", F.lit(". "), F.lit(" --- ")), F.lit(", "), F.lit("---"))
    return ranking.split_chunks(table(spark, sf, "documents").select(F.col("doc_id").alias("set_id"), made.alias("text")))


_RANKED = f"""
chunks AS (SELECT source AS set_id, doc_id AS pos, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
stats AS (SELECT set_id, count(*) AS n, greatest(avg(len(w)), 1.0) AS avg_len FROM chunks GROUP BY 1),
asked AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS set_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))) AS q FROM benchmark),
q AS (SELECT query_id, set_id, unnest(q) AS term FROM asked),
tf AS (SELECT set_id, pos, len, term, count(*) AS tf FROM (SELECT set_id, pos, len(w) AS len, unnest(w) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT set_id, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, set_id, pos, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 9) AS score
      FROM q JOIN tf USING (set_id, term) JOIN df USING (set_id, term) JOIN stats USING (set_id) GROUP BY ALL),
every AS (SELECT a.query_id, c.pos, coalesce(s.score, 0) AS score, {TOKENS.format("c.text")} AS tokens, len(a.q) = 0 AS blank FROM asked a JOIN chunks c USING (set_id) LEFT JOIN s ON s.query_id = a.query_id AND s.pos = c.pos)"""


@query("r2_select_context", f"""
WITH RECURSIVE {_RANKED},
fits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM every WHERE tokens <= 500 AND NOT blank),
walk AS (
  SELECT query_id, pos, score, k, tokens AS used, true AS taken FROM fits WHERE k = 1
  UNION ALL
  SELECT f.query_id, f.pos, f.score, f.k, CASE WHEN w.used < 500 AND w.used + f.tokens <= 500 THEN w.used + f.tokens ELSE w.used END, w.used < 500 AND w.used + f.tokens <= 500
  FROM walk w JOIN fits f ON f.query_id = w.query_id AND f.k = w.k + 1)
SELECT query_id, pos, round(score, 6) AS score FROM walk WHERE taken
UNION ALL SELECT query_id, pos, round(score, 6) FROM every WHERE blank""")
def r2_select_context(spark, sf):
    return ranking.select_context(*_contexts(spark, sf), 500).select("query_id", "pos", F.round("score", 6).alias("score"))


def _simhash_sql(source: str) -> str:
    """Steps from rows (k, t) to their simhash as a 64-bit pattern."""
    return f"""
w AS (SELECT k, {WORDS.format('lower(t)')} AS w FROM ({source})),
sh AS (SELECT k, unnest(list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i+1:i+3], ' '))) AS s FROM w),
hs AS (SELECT k, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM sh),
bits AS (SELECT k, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM hs, range(64) r(b) GROUP BY ALL),
marks AS (SELECT k, CAST(sum(CASE WHEN v <= 0 THEN 0::HUGEINT ELSE (1::HUGEINT << b) END) AS UBIGINT) AS mark FROM bits GROUP BY k)"""


_LOOKUP = f"""
WITH {_simhash_sql("SELECT doc_id AS k, text AS t FROM documents")},
asked AS (SELECT item_id, 'm' || (item_id % 3) AS model FROM benchmark),
own AS (SELECT a.item_id, a.model, m.mark FROM asked a JOIN marks m ON m.k = a.item_id),
held AS (SELECT d.doc_id, 'm' || (d.doc_id % 3) AS model, m.mark, d.text FROM documents d JOIN marks m ON m.k = d.doc_id WHERE d.doc_id <= 50000),
newest AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY doc_id DESC) AS place FROM held),
met AS (SELECT o.item_id, n.doc_id, n.text, n.place, 1 - bit_count(xor(o.mark, n.mark)) / 64.0::DOUBLE AS similarity FROM own o JOIN newest n ON n.model = o.model AND n.place <= 200),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS k FROM met WHERE similarity >= 0.95),
found AS (SELECT a.item_id AS request_id, b.doc_id AS hit_id, b.text AS response, b.similarity FROM asked a LEFT JOIN best b ON b.item_id = a.item_id AND b.k = 1)
"""


@query("h1_cache_lookup", f"{_LOOKUP} SELECT request_id, coalesce(hit_id, -1) AS hit_id, coalesce(response, '') AS response, coalesce(similarity, 0) AS similarity FROM found")
def h1_cache_lookup(spark, sf):
    return cache.lookup(*_cache(spark, sf)).fillna({"hit_id": -1, "response": "", "similarity": 0.0})


@query("m12_cache_stats", f"{_LOOKUP} SELECT count(hit_id) AS hits, count(*) - count(hit_id) AS misses, round(count(hit_id) / CAST(count(*) AS DOUBLE), 4) AS hit_rate FROM found")
def m12_cache_stats(spark, sf):
    return cache.stats(cache.lookup(*_cache(spark, sf)))


@query("h2_append", "SELECT model, count(*) AS n, max(id) AS newest FROM (SELECT doc_id AS id, 'm' || (doc_id % 3) AS model FROM documents UNION ALL SELECT 1000000 + item_id, 'new' FROM benchmark) GROUP BY 1")
def h2_append(spark, sf):
    b = table(spark, sf, "benchmark")
    new = cache.entries(b.select((F.col("item_id") + 1_000_000).alias("id"), F.col("text").alias("prompt"), F.lit("new").alias("model"), F.lit("r").alias("response"), F.lit(1.0).alias("created_at")))
    return cache.append(_cache(spark, sf)[0], new).groupBy("model").agg(F.count("*").alias("n"), F.max("id").alias("newest"))


@query("h3_purge", "SELECT count(*) AS removed FROM documents WHERE 100500 - doc_id > 100000")
def h3_purge(spark, sf):
    return cache.purge(_cache(spark, sf)[0], 100_500.0)[1]


@query("h4_replay", """
WITH r AS (SELECT event_id, 'm' || (event_id % 2) AS model, md5(event_type || ':' || (event_id % 10)) AS prompt FROM events),
f AS (SELECT *, min(event_id) OVER (PARTITION BY model, prompt) AS first FROM r)
SELECT event_id AS request_id, CASE WHEN first < event_id THEN first ELSE -1 END AS hit_id, 'answer ' || first AS response FROM f""")
def h4_replay(spark, sf):
    e = F.col("event_id")
    made = table(spark, sf, "events").select(e.alias("request_id"), F.md5(F.concat_ws(":", "event_type", (e % 10).cast("string"))).alias("prompt"), F.concat(F.lit("m"), (e % 2).cast("string")).alias("model"), e.cast("double").alias("now"), F.concat(F.lit("answer "), e.cast("string")).alias("response"))
    return cache.replay(made, ttl_seconds=1e9, threshold=1.0).fillna(-1, ["hit_id"])


@query("t4_stream", f"""
WITH t AS ({_TURNS}), n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
c AS (SELECT t.conv_id AS stream_id, turn AS seq, turn = last AS ended, own, n, lag(own) OVER (PARTITION BY t.conv_id ORDER BY turn) AS before FROM t JOIN n USING (conv_id))
SELECT stream_id, seq, CASE WHEN n = 1 THEN '{_SAID}' || {NL} || {NL} ELSE 'tail ' || before || {NL} || {NL} END || CASE WHEN ended THEN 'tail ' || own ELSE '' END AS text FROM c""")
def t4_stream(spark, sf):
    """A stream of chunks, run to its end: each turn ends the paragraph before it, says a sentence that all say, and
    begins a paragraph."""
    from pyspark.sql import Window

    last = F.max("turn").over(Window.partitionBy("conv_id"))
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.when(F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id")), F.lit("\n\n")).otherwise(""), F.lit(f"{_SAID}\n\ntail   "), _own()).alias("chunk"), (F.col("turn") == last).alias("is_end"))
    folder = f"{_shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    chunks.repartition(2, "stream_id").write.parquet(f"{folder}/in")
    stream = compress_stream(spark.readStream.schema(chunks.schema).parquet(f"{folder}/in"), idle_ms=None)
    running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _shared_folder(spark) -> str:
    """The folder that driver and executors share; a temporary one only on one machine, where none is set."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="quillspark-")


@query("m8_message_counts", f"""
SELECT conv_id, CAST(sum(CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT)) AS BIGINT) AS per_message, CAST(ceil(length(string_agg(text, ' ' ORDER BY turn)) / 4.0::DOUBLE) AS BIGINT) AS at_once FROM conversations GROUP BY 1""")
def m8_message_counts(spark, sf):
    return conversation.count_messages(table(spark, sf, "conversations"), "chars")


@query("m2_char_tokens", "SELECT page_id, CAST(ceil(length(html) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM pages")
def m2_char_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", token_count(F.col("html"), "chars").alias("tokens"))
