"""Queries over API schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import schemas
from quillspark.queries.base import query
from quillspark.sources.readers import table

NL = "chr(10)"
_SAID = "array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:6], ' ')"


def _said():
    """Six plain words of an item."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 6), " ")


def _openapi(spark, sf):
    """Three operations that count, one deprecated, and what isn't an operation."""
    head = '{"openapi":"3.0","info":{"title":"T"},"x-own":1,"paths":{"/users":{"get":{"summary":"listing '
    middle = '","tags":["users","list"],"x-code":[1],"responses":{"200":{"description":"ok","example":{"a":1}},"422":{"description":"bad"}}},"delete":{"summary":"listing users","deprecated":true}},"/pets":{"post":{"summary":"pets","description":"'
    tail = '"},"trace":{"summary":"listing"}}},"components":{"schemas":{"U":{"type":"object","x-a":2}}}}'
    long = F.concat(_said(), F.lit(" "), F.repeat(F.lit("description "), F.lit(9)))
    made = F.concat(F.lit(head), _said(), F.lit(middle), long, F.lit(tail))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("schema_id"), made.alias("schema"), F.lit("the listing of users").alias("task"))


_STOP = ", ".join(f"'{w}'" for w in schemas.DESCRIPTION_STOPWORDS)
_TERMS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN (" + _STOP + "))"
_OPERATIONS = f"""
d AS (SELECT item_id, {_SAID} AS said FROM benchmark),
o AS (SELECT item_id, 0 AS pos, '/users' AS path, 'get' AS method, {_TERMS.format("'get /users listing ' || said || '  users list'")} AS w FROM d
  UNION ALL SELECT item_id, 1, '/pets', 'post', {_TERMS.format("'post /pets pets ' || said || ' ' || repeat('description ', 9)")} FROM d
  UNION ALL SELECT item_id, 2, '/pets', 'trace', {_TERMS.format("'trace /pets listing  '")} FROM d),
f AS (SELECT *, CAST(len(list_filter(w, lambda x: x = 'listing')) AS DOUBLE) AS a, CAST(len(list_filter(w, lambda x: x = 'users')) AS DOUBLE) AS b, 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / 20.0::DOUBLE) AS norm FROM o),
scored AS (SELECT item_id, pos, path, method, round(a * 2.5::DOUBLE / (a + norm) + b * 2.5::DOUBLE / (b + norm), 9) AS score FROM f)"""


@query("r3_operation_scores", f"WITH {_OPERATIONS} SELECT item_id AS schema_id, pos, path, method, round(score, 6) AS score FROM scored")
def r3_operation_scores(spark, sf):
    return schemas.score_operations(_openapi(spark, sf)).select("schema_id", "pos", "path", "method", F.round("score", 6).alias("score"))


@query("r4_operations", f"""
WITH {_OPERATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS rank FROM scored)
SELECT item_id AS schema_id, path, method, rank FROM r WHERE rank <= 2""")
def r4_operations(spark, sf):
    return schemas.best_operations(schemas.score_operations(_openapi(spark, sf)), 2).select("schema_id", "path", "method", "rank")


def _trimmed_sql(text: str) -> str:
    """The trimmed schema, as JSON of two spaces, from the words of an item."""
    lines = [
        "{", '  "openapi": "3.0",', '  "info": {', '    "title": "T"', "  },", '  "paths": {', '    "/users": {', '      "get": {', '        "summary": "listing <1>",', '        "tags": [', '          "users",', '          "list"', "        ],",
        '        "responses": {', '          "200": {', '            "description": "ok"', "          }", "        }", "      }", "    },", '    "/pets": {', '      "trace": {', '        "summary": "listing"', "      },", '      "post": {', '        "summary": "pets",',
        '        "description": "<2>"', "      }", "    }", "  },", '  "components": {', '    "schemas": {', '      "U": {', '        "type": "object"', "      }", "    }", "  }", "}",
    ]
    whole = "'" + ("' || chr(10) || '".join(lines)) + "'"
    return whole.replace("<1>", f"' || {text} || '").replace("<2>", f"' || left({text} || ' ' || repeat('description ', 9), 80) || chr(92) || 'u2026")


@query("g1_trim_openapi", f"SELECT item_id AS schema_id, {_trimmed_sql(_SAID)} AS trimmed FROM benchmark")
def g1_trim_openapi(spark, sf):
    return schemas.trim_openapi(_openapi(spark, sf), 3)


def _sdl():
    long = F.concat(F.lit('type T {\n  """ '), _said(), F.lit(" "), F.repeat(F.lit("words and "), F.lit(12)), F.lit('"""\n  f: Int\n  """short"""\n  old: [Int!] @deprecated(reason: "x")\n  g: Int\n}'))
    return long


_SDL = f"'type T {{' || {NL} || '  \"\"\"' || left(trim({_SAID} || ' ' || repeat('words and ', 12)), 80) || '…\"\"\"' || {NL} || '  f: Int' || {NL} || '  \"\"\"short\"\"\"' || {NL} || '  g: Int' || {NL} || '}}'"


@query("n7_graphql", f"SELECT item_id, {_SDL} AS text FROM benchmark")
def n7_graphql(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", schemas.trim_graphql(_sdl()).alias("text"))


def _any(spark, sf):
    k = F.col("schema_id") % 4
    rows = _openapi(spark, sf).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("schema_id"), _sdl().alias("sdl"), "text"), "schema_id")
    schema = F.when(k == 0, F.concat(F.lit("  "), "schema")).when(k == 1, F.concat(F.lit("\n"), "sdl")).when(k == 2, F.lit("openapi: '3'\npaths:\n  /a:\n    get:\n      summary: listing\n      example: x\n")).otherwise(F.concat(F.lit(' {"type": "'), F.lit("none"), F.lit('"}')))
    return rows.select("schema_id", schema.alias("schema"), "task")


@query("g4_trim_schema", f"""
SELECT item_id AS schema_id, CASE item_id % 4 WHEN 0 THEN {_trimmed_sql(_SAID)} WHEN 1 THEN {_SDL}
  WHEN 2 THEN 'openapi: ''3''' || {NL} || 'paths:' || {NL} || '  /a:' || {NL} || '    get:' || {NL} || '      summary: listing' || {NL} ELSE ' {{"type": "none"}}' END AS trimmed FROM benchmark""")
def g4_trim_schema(spark, sf):
    return schemas.trim_schema(_any(spark, sf), 3)


@query("s5_schema_kind", "SELECT item_id AS schema_id, CASE item_id % 4 WHEN 0 THEN 'openapi' WHEN 1 THEN 'graphql' WHEN 2 THEN 'yaml' ELSE 'other' END AS kind FROM benchmark")
def s5_schema_kind(spark, sf):
    return _any(spark, sf).select("schema_id", schemas.schema_kind(F.col("schema")).alias("kind"))
