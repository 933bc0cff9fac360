"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import hashing_ann, langid, licenses, mixing, neardup, packing, recipes, rotation, suffixes, wrappers
from quillspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return note


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
levels AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.text, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT)
      / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""


@query("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op9_chunk_recipes", COPIES_SQL)
def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op7_bigru_langid")
def op7_bigru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    net = langid.train(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), net).drop("text")


@query("op8_slack_packing")
def op8_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATES = ", ".join(f"({i}, '{t.label}', string_split('{t.words}', ' '), {t.exact}, {t.least}::DOUBLE)" for i, t in enumerate(licenses.BASE + licenses.NOTICES))
LICENSES_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(template, label, p, exact, least)),
runs AS (SELECT template, unnest(range(0, len(p) - 2)) AS j, p FROM t),
looked AS (SELECT template, j, array_to_string(p[j+1:j+3], ' ') AS run FROM runs),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT id, w, unnest(range(0, len(w) - 2)) AS i FROM d),
votes AS (SELECT id, template, i - j AS diagonal, count(DISTINCT j) AS n, list(DISTINCT j) AS seen FROM places JOIN looked ON array_to_string(w[i+1:i+3], ' ') = run GROUP BY ALL),
apart AS (SELECT v.*, t.* EXCLUDE (template), coalesce(exact OR diagonal - lag(diagonal) OVER (PARTITION BY id, v.template ORDER BY diagonal) > 3, true) AS apart FROM votes v JOIN t ON t.template = v.template),
clusters AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY id, template ORDER BY diagonal) AS cluster FROM apart),
spans AS (SELECT id, label, exact, least, min(diagonal) AS diagonal, len(list_distinct(flatten(list(seen)))) / CAST(len(any_value(p)) - 2 AS DOUBLE) AS share,
  max(diagonal + list_max(seen)) + 3 - min(diagonal + list_min(seen)) <= 1.5 * len(any_value(p)) AS fits FROM clusters GROUP BY id, template, cluster, label, exact, least),
told AS (SELECT *, exact AND share = 1 AS base, CASE WHEN exact THEN share = 1 ELSE share >= least AND fits END AS found FROM spans),
per AS (SELECT id, count(*) FILTER (WHERE base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) FILTER (WHERE found OR NOT exact) AS score FROM told GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN per USING (id)
"""


@query("op4_license_diagonals", LICENSES_SQL)
def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i+1:i+5], ' '))) END AS s FROM w),
e AS (SELECT doc_id, hash(unnest(s)) AS h, unnest(s) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * common >= 80 * (len(x.s) + len(y.s) - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


@query("op1_ngram_jaccard_join", NEAR_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


ROTATION_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / 64.0) AS BIGINT), 0) AS block FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
heads AS (
  SELECT r.*, s.speaker, r.role = s.speaker AS own,
    CASE WHEN r.role = 'system' THEN '<|system|>' WHEN r.role = s.speaker THEN '<|assistant|>'
         ELSE '<|user name=' || r.role || '|>' END || chr(10) AS head
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
parts AS (SELECT *, head || text || '<|end|>' || chr(10) AS part FROM heads),
placed AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, speaker, block ORDER BY turn NULLS FIRST, role, text
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts)
SELECT conv_id, speaker, block, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       string_agg(part, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(part) - 1 AS BIGINT), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, block
"""


@query("op2_perspective_rotation", ROTATION_SQL)
def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = rotation.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m.start, m.end))
    return rendered.withColumn("mask", F.array_join(spans, ","))


@query("op3_multi_index_hashing")
def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


PASSAGES_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i+1:i+50], ' ')) AS h FROM places),
several AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
found AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS apart FROM windows SEMI JOIN several USING (h)),
united AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM found)
SELECT doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words FROM united GROUP BY doc_id, stretch
"""


@query("op6_sparse_suffixes", PASSAGES_SQL)
def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents")).drop("first")


#: What the given pages come to by plain replacements: they hold few kinds of markup in one article each.
PAGES_SQL = """
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(regexp_replace(t, '(?s)<!--.*?-->|</?(b|a|i|em|strong|span)( [^>]*)?>', '', 'g'), '<br>', ' '), '</?[a-z][a-z0-9]*( [^>]*)?>', chr(1), 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM c)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM d
"""


@query("op10_wrapper_texts", PAGES_SQL)
def op10_wrapper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))
