"""Queries over the text stages and the pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quillspark.functions import arrow, text as T
from quillspark.plans import pipeline
from quillspark.queries.base import TOKENS, WORDS, query
from quillspark.queries.reduction import MESSY, messy
from quillspark.sources.readers import table

NL = "chr(10)"
_PROSE = ", ".join(f"'{w}'" for w in sorted(arrow.PROSE_STOPWORDS))
_CODE = ", ".join(f"'{w}'" for w in sorted(arrow.CODE_STOPWORDS))
#: SQL for the words of a unit that count.
_CONTENT = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN (" + _PROSE.replace("{", "{{") + "))"


def _whitespace_sql(text: str, source: str) -> str:
    """Steps from a text column t to its normalised form."""
    return f"""
a AS (SELECT doc_id, {text} AS raw, regexp_replace({text}, '[ \\t]+(\\n|$)', '\\1', 'g') AS t FROM {source}),
b AS (SELECT doc_id, raw, regexp_replace(regexp_replace(t, '\\n{{3,}}', {NL} || {NL}, 'g'), '(\\S) {{2,}}', '\\1 ', 'g') AS t FROM a),
w AS (SELECT doc_id, raw, trim(replace(t, {NL} || chr(9), {NL} || '  '), {NL}) AS t FROM b)"""


@query("l1_fences", f"""
WITH {_whitespace_sql(MESSY, "documents")}
SELECT doc_id, t || '```py' || {NL} || 'x   =  1  ' || {NL} || {NL} || {NL} || {NL} || '```' || t || {NL} || '``` open' AS text FROM w""")
def l1_fences(spark, sf):
    fenced = F.concat("text", F.lit("\n```py\nx   =  1  \n\n\n\n```\n"), "text", F.lit("\n```   open"))
    return messy(spark, sf).select("doc_id", T.normalize_whitespace(fenced).alias("text"))


@query("l4_paragraph_dedup", f"""
WITH p AS (SELECT doc_id, replace(text, {NL}, ' ') AS p FROM documents),
c AS (SELECT doc_id, p, len({_CONTENT.format("p")}) AS n FROM p)
SELECT doc_id, CASE WHEN n >= 5 THEN p || {NL} || {NL} || 'the tail' ELSE concat_ws({NL} || {NL}, CASE WHEN trim(p) <> '' THEN p END, CASE WHEN trim(p) <> '' THEN p END, 'the tail') END AS text FROM c""")
def l4_paragraph_dedup(spark, sf):
    p = F.replace("text", F.lit("\n"), F.lit(" "))
    doubled = F.concat(p, F.lit("\n\n"), p, F.lit("\n\nthe tail"))
    return table(spark, sf, "documents").select("doc_id", arrow.semantic_dedup(doubled, unit="paragraph", language="prose").alias("text"))


@query("l9_language_choice", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'import os ' ELSE 'some text ' END || {NL} || 'Return yield await lambda global nonlocal.' || CASE WHEN doc_id % 2 = 0 THEN ' Return yield await lambda global nonlocal.' ELSE '' END || ' End.' AS text FROM documents""")
def l9_language_choice(spark, sf):
    unit = "Return yield await lambda global nonlocal."
    made = F.concat(F.when(F.col("doc_id") % 2 == 0, "import os ").otherwise("some text "), F.lit(f"\n{unit} {unit} End."))
    return table(spark, sf, "documents").select("doc_id", arrow.semantic_dedup(made).alias("text"))


@query("n3_json_paragraphs", f"""
SELECT event_id, 'some text' || {NL} || {NL} || replace(props, ': ', ':') || {NL} || {NL} || '{{not: json}}' || {NL} || {NL} || '[1,"é"]'.replace('é', chr(92) || 'u00e9') AS text FROM events""")
def n3_json_paragraphs(spark, sf):
    made = F.concat(F.lit("some text\n\n"), "props", F.lit('\n\n{not: json}\n\n[1,  "é"]'))
    return table(spark, sf, "events").select("event_id", arrow.optimize_format(made).alias("text"))


@query("n4c_chunk_tags", f"SELECT doc_id, text || {NL} || 'x' || {NL} AS text FROM documents")
def n4c_chunk_tags(spark, sf):
    made = F.concat(F.lit('<chunk id="1">\n'), "text", F.lit("\n</chunk>\n<Passage> \nx\n</Passage>"))
    return table(spark, sf, "documents").select("doc_id", arrow.optimize_format(made).alias("text"))


@query("n4d_underlines", f"SELECT doc_id, 'Head' || {NL} || {NL} || text || {NL} || 'Other' || {NL} || {NL} || 'a' || {NL} || '---' || {NL} || 'b' || {NL} || '---' AS text FROM documents")
def n4d_underlines(spark, sf):
    made = F.concat(F.lit("Head\n====\n"), "text", F.lit("\nOther\n=====  \na\n-----\nb\n---"))
    return table(spark, sf, "documents").select("doc_id", T.strip_markup(made).alias("text"))


@query("n4e_named_entities", "SELECT page_id, replace(replace(replace(replace(replace(h, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)) AS text FROM (SELECT page_id, 'said &amp;lt; &gt;&apos; ' || regexp_replace(html, '[<>=\\-\\n]', ' ', 'g') AS h FROM pages)")
def n4e_named_entities(spark, sf):
    made = F.concat(F.lit("said &amp;lt; &gt;&apos; "), F.regexp_replace("html", r"[<>=\-\n]", " "))
    return table(spark, sf, "pages").select("page_id", T.strip_markup(made).alias("text"))


@query("n4f_numeric_entities", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' &#9999999; &amp;' ELSE text || ' ' || chr(CAST(65 + doc_id % 26 AS INTEGER)) || 'é&' END AS text FROM documents")
def n4f_numeric_entities(spark, sf):
    number = F.concat(F.lit(" &#"), (65 + F.col("doc_id") % 26).cast("string"), F.lit(";&#233;&amp;"))
    made = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " &#9999999; &amp;").otherwise(number))
    return table(spark, sf, "documents").select("doc_id", arrow.optimize_format(made).alias("text"))


@query("n4g_delimiters", f"SELECT doc_id, 'a' || {NL} || '---' || {NL} || text || {NL} || '---' || {NL} || 'c' || {NL} || '---' || {NL} || 'd' AS text FROM documents")
def n4g_delimiters(spark, sf):
    made = F.concat(F.lit("a\n=-=-\n"), "text", F.lit("\n-=-=-=\nc\n==--\n\n\n\nd"))
    return table(spark, sf, "documents").select("doc_id", T.strip_markup(made).alias("text"))


@query("n5_fenced_format", f"""
SELECT doc_id, text || ' A&' || {NL} || '```' || {NL} || '&#65;&amp; {{"a": 1}}' || {NL} || '```' || {NL} || {NL} || '{{"a":[1,2]}}' || {NL} || {NL} || 'end' AS text FROM documents""")
def n5_fenced_format(spark, sf):
    made = F.concat("text", F.lit(' &#65;&amp;\n```\n&#65;&amp; {"a": 1}\n```\n\n{"a": [1, 2]}\n\nend'))
    return table(spark, sf, "documents").select("doc_id", arrow.optimize_format(made).alias("text"))


def _blocks_sql(text: str, source: str) -> str:
    """Steps from a text column to its blocks without repeats; breaks here are runs of line ends alone."""
    return f"""
parts AS (SELECT doc_id, raw, {text} AS before, unnest(string_split_regex({text}, '\\n{{2,}}')) AS part, generate_subscripts(string_split_regex({text}, '\\n{{2,}}'), 1) AS pos FROM {source}),
ranked AS (SELECT *, len({WORDS.format("part")}) < 5 OR row_number() OVER (PARTITION BY doc_id, trim(part, ' ' || {NL} || chr(9) || chr(13)) ORDER BY pos) = 1 AS stays FROM parts),
x AS (SELECT doc_id, any_value(raw) AS raw, any_value(before) AS before, trim(regexp_replace(string_agg(CASE WHEN stays THEN part ELSE '' END, {NL} || {NL} ORDER BY pos), '\\n{{3,}}', {NL} || {NL}, 'g'), ' ' || {NL} || chr(9) || chr(13)) AS t FROM ranked GROUP BY doc_id)"""


_SET = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_METRICS = f"""
SELECT doc_id, t AS compressed, {TOKENS.format("raw")} AS original_tokens, {TOKENS.format("t")} AS compressed_tokens,
  CASE WHEN {TOKENS.format("raw")} = 0 THEN 0.0::DOUBLE ELSE ({TOKENS.format("raw")} - {TOKENS.format("t")}) / CAST({TOKENS.format("raw")} AS DOUBLE) END AS ratio,
  CASE WHEN {TOKENS.format("raw")} = 0 THEN 0.0::DOUBLE ELSE ({TOKENS.format("raw")} - {TOKENS.format("t")}) / CAST({TOKENS.format("raw")} AS DOUBLE) * 100 END AS reduction_pct,
  CASE WHEN len({_SET.format("t")}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({_SET.format("raw")}, {_SET.format("t")})) / CAST(len(list_distinct(list_concat({_SET.format("raw")}, {_SET.format("t")}))) AS DOUBLE) END AS quality_score
FROM """


@query("p2_lossless_only", f"WITH {_whitespace_sql(MESSY, 'documents')},{_blocks_sql('t', 'w')} {_METRICS}x")
def p2_lossless_only(spark, sf):
    return replace(pipeline.build(), skip_lossy=True).run(messy(spark, sf)).drop("text", "source", "stages")


def _fold_sql(text: str, source: str, code: str = "false") -> str:
    """Steps from a text column to its text without sentences like an earlier one. A sentence goes if one before it is
    like it and stays; here one that stays is one that none before it is like."""
    content = "list_filter(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+'), lambda w: w NOT IN (" + _PROSE + ") AND NOT (code AND w IN (" + _CODE + ")))"
    return f"""
lines AS (SELECT doc_id, raw, {code} AS code, unnest(string_split({text}, {NL})) AS line, generate_subscripts(string_split({text}, {NL}), 1) AS l FROM {source}),
sents AS (SELECT doc_id, raw, code, l, unnest(string_split(regexp_replace(line, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(line, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) AS k FROM lines),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, k) AS n, CASE WHEN trim(s) <> '' AND len({content}) >= 5 THEN trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) END AS u FROM sents),
long AS (SELECT doc_id, n, list_distinct(list_transform(range(1, length(u) - 3), lambda i: substr(u, i, 5))) AS sh FROM units WHERE u IS NOT NULL),
alike AS (SELECT a.doc_id, a.n AS first, b.n AS n FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.n < b.n AND least(len(a.sh), len(b.sh)) >= 0.85 * greatest(len(a.sh), len(b.sh))
  WHERE len(list_intersect(a.sh, b.sh)) >= 0.85 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))),
gone AS (SELECT DISTINCT doc_id, n FROM alike a WHERE NOT EXISTS (SELECT 1 FROM alike o WHERE o.doc_id = a.doc_id AND o.n = a.first)),
kept AS (SELECT u.* FROM units u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.n = g.n),
ended AS (SELECT doc_id, any_value(raw) AS raw, l, coalesce(string_agg(s, ' ' ORDER BY k) FILTER (WHERE s <> ''), '') AS line FROM kept GROUP BY doc_id, l),
every AS (SELECT DISTINCT doc_id, raw, l FROM lines),
f AS (SELECT v.doc_id, any_value(v.raw) AS raw, trim(string_agg(coalesce(e.line, ''), {NL} ORDER BY v.l), ' ' || {NL} || chr(9) || chr(13)) AS t FROM every v LEFT JOIN ended e ON v.doc_id = e.doc_id AND v.l = e.l GROUP BY v.doc_id)"""


_CODE_LINE = "regexp_matches({}, '(?im)^\\s*(?:def|class|import|from|function|const|let|var|select|insert|update) ')"


@query("j4_semantic_dedup", f"""
WITH s AS (SELECT doc_id, text AS raw, text AS t FROM documents), {_fold_sql("t", "s", _CODE_LINE.format("t"))}
SELECT doc_id, t AS text FROM f""")
def j4_semantic_dedup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", arrow.semantic_dedup(F.col("text")).alias("text"))


@query("p1_compress_documents", f"WITH {_whitespace_sql(MESSY, 'documents')},{_blocks_sql('t', 'w')}, {_fold_sql('t', 'x', _CODE_LINE.format('t'))} {_METRICS}f")
def p1_compress_documents(spark, sf):
    return pipeline.compress_documents(messy(spark, sf)).drop("text", "source", "stages")


_STAGE_SUMS = f"SELECT sum({TOKENS.format('raw')}) AS n0, sum({TOKENS.format('before')}) AS n1, sum({TOKENS.format('t')}) AS n2 FROM x"


@query("m13_stage_table", f"""
WITH {_whitespace_sql(MESSY, 'documents')},{_blocks_sql('t', 'w')}, n AS ({_STAGE_SUMS})
SELECT 0 AS place, 'whitespace' AS name, CAST(n0 AS BIGINT) AS tokens_before, CAST(n1 AS BIGINT) AS tokens_after, CAST(n0 - n1 AS BIGINT) AS saved FROM n
UNION ALL SELECT 1, 'deduplication', CAST(n1 AS BIGINT), CAST(n2 AS BIGINT), CAST(n1 - n2 AS BIGINT) FROM n
UNION ALL SELECT 2, 'format', CAST(n2 AS BIGINT), CAST(n2 AS BIGINT), 0 FROM n""")
def m13_stage_table(spark, sf):
    done = replace(pipeline.build(), skip_lossy=True).run(messy(spark, sf))
    return pipeline.stage_table(done, pipeline.TECHNIQUES[:3])


@query("u2_function_stages", "SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN text || '!' ELSE text END || ' done' AS compressed FROM documents")
def u2_function_stages(spark, sf):
    """Stages from functions; one fails on texts of odd length and leaves them, one gives no text at all."""

    def picky(text: str) -> str:
        if len(text) % 2:
            raise ValueError("odd")
        return text + "!"

    stages = [pipeline.function_stage("picky", picky), pipeline.function_stage("none", lambda _: None), pipeline.Stage("done", lambda c: F.concat(c, F.lit(" done")))]
    p = pipeline.Pipeline()
    for stage in stages:
        p = p.add(stage)
    return p.run(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "compressed")


_SHINGLES = "list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))"


@query("j1_minhash_estimate", f"""
WITH t AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark),
s AS (SELECT item_id, {_SHINGLES} AS s FROM t)
SELECT b.item_id, CASE WHEN len(list_concat(a.s, b.s)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) END AS exact, true AS near
FROM s a JOIN s b ON b.item_id = a.item_id + 1""")
def j1_minhash_estimate(spark, sf):
    """Items and the next: the exact similarity, and whether the estimate of 128 functions is within 0.2 of it."""
    d = table(spark, sf, "benchmark").select("item_id", T.char_shingles(F.col("text")).alias("s"))
    d = d.select("item_id", "s", T.minhash(F.col("s")).alias("m"))
    before = d.select((F.col("item_id") + 1).alias("item_id"), F.col("s").alias("s0"), F.col("m").alias("m0"))
    both = d.join(before, "item_id").select("item_id", T.minhash_similarity(F.col("m"), F.col("m0")).alias("estimate"), T.jaccard(F.col("s"), F.col("s0")).alias("exact"))
    return both.select("item_id", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.2).alias("near"))
