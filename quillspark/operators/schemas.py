"""API schemas: operations are scored against a task, the best stay; GraphQL descriptions are shortened."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import terms, text_of

#: Words that don't count in descriptions and in tasks, and the methods of an operation.
DESCRIPTION_STOPWORDS = (
    "a an the is are was were be been have has had do does will would could should may might can i you he she it we they "
    "this that and or but not of in on at to for with by from as into about"
).split()
TASK_STOPWORDS = [w for w in DESCRIPTION_STOPWORDS if w != "been"] + ["did"]
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

_OPERATION = "struct<summary:string,description:string,tags:array<string>,deprecated:boolean>"


def score_operations(schemas: DataFrame, k1: float = 1.5, b: float = 0.75, average: float = 20.0) -> DataFrame:
    """schemas (schema_id, schema as JSON, task): schema_id, pos, path, method, score. Deprecated operations go."""
    paths = F.from_json(F.col("schema"), f"struct<paths:map<string,map<string,{_OPERATION}>>>").paths
    task = F.array_distinct(terms(F.col("task"), TASK_STOPWORDS))
    by_path = schemas.select("schema_id", task.alias("task"), F.posexplode(F.map_entries(paths)).alias("i", "path"))
    ops = by_path.select("schema_id", "task", "i", F.col("path.key").alias("path"), F.posexplode(F.map_entries("path.value")).alias("j", "op"))
    ops = ops.filter(F.lower("op.key").isin(*METHODS) & ~F.coalesce(F.col("op.value.deprecated"), F.lit(False)))
    said = F.concat_ws(" ", "op.key", "path", text_of(F.col("op.value.summary")), text_of(F.col("op.value.description")), F.array_join(F.coalesce("op.value.tags", F.array().cast("array<string>")), " "))
    ops = ops.withColumn("terms", terms(said, DESCRIPTION_STOPWORDS))
    length = F.size("terms")

    def part(total: Column, term: Column) -> Column:
        tf = F.size(F.filter("terms", lambda t: t == term))
        return total + F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))).otherwise(0.0)

    score = F.aggregate("task", F.lit(0.0), part)
    place = F.row_number().over(Window.partitionBy("schema_id").orderBy("i", "j")) - 1
    return ops.select("schema_id", place.alias("pos"), "path", F.col("op.key").alias("method"), F.round(score, 9).alias("score"))


def best_operations(scored: DataFrame, top_k: int = 10) -> DataFrame:
    best = Window.partitionBy("schema_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def _short(text, most: int = 80):
    return text[:most] + "…" if isinstance(text, str) and len(text) > most else text


def _strip(node: dict, drop: tuple[str, ...] = ()) -> dict:
    out = {k: v for k, v in node.items() if k not in ("example", "examples", *drop) and not k.startswith("x-")}
    if "description" in out:
        out["description"] = _short(out["description"])
    if isinstance(out.get("responses"), dict):
        out["responses"] = {k: _strip(v) if isinstance(v, dict) else v for k, v in out["responses"].items() if k != "422"}
    return out


def trim_openapi(schemas: DataFrame, top_k: int = 10) -> DataFrame:
    """schemas (schema_id, schema, task): schema_id, trimmed. Only the best operations stay, without examples and
    extensions; information, servers and components stay."""
    best = best_operations(score_operations(schemas), top_k).groupBy("schema_id")
    picks = best.agg(F.array_sort(F.collect_list(F.struct("rank", "path", "method"))).alias("picks"))

    @F.pandas_udf(StringType())
    def trim(schema: pd.Series, picks: pd.Series) -> pd.Series:
        def one(text, chosen):
            data = json.loads(text)
            out = {k: data[k] for k in ("openapi", "info", "servers") if k in data}
            out["paths"] = {}
            for p in () if chosen is None else chosen:
                out["paths"].setdefault(p["path"], {})[p["method"]] = _strip(data["paths"][p["path"]][p["method"]])
            if data.get("components"):
                bare = lambda part: {k: v for k, v in part.items() if not k.startswith("x-")}
                out["components"] = {a: {name: bare(c) for name, c in b.items() if isinstance(c, dict)} for a, b in data["components"].items() if isinstance(b, dict)}
            return json.dumps(out, indent=2)

        return pd.Series([one(s, p) for s, p in zip(schema, picks, strict=True)])

    return schemas.join(picks, "schema_id", "left").select("schema_id", trim("schema", "picks").alias("trimmed"))


#: Fixed value: a field that is marked as deprecated, with its line.
DEPRECATED_FIELD = r"[ \t]+\w[\w!:\[\] ]*@deprecated[^\n]*\n?"


def trim_graphql(sdl: Column, most: int = 80) -> Column:
    """Descriptions in triple quotes are cut to `most` characters; deprecated fields go."""
    t = text_of(sdl)
    pattern = r'(?s)""".*?"""'
    between = F.split(t, pattern)

    def cut(d: Column) -> Column:
        inner = F.regexp_replace(F.substring(d, 4, 1_000_000_000), r'"""$', "")
        bare = F.regexp_replace(inner, r"^\s+|\s+$", "")
        return F.when(F.length(bare) > most, F.concat(F.lit('"""'), F.substring(bare, 1, most), F.lit('…"""'))).otherwise(d)

    notes = F.array_append(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), cut), F.lit(""))
    return F.regexp_replace(F.array_join(F.zip_with(between, notes, lambda a, b: F.concat(a, b)), ""), DEPRECATED_FIELD, "")


def schema_kind(text: Column) -> Column:
    """openapi (JSON), yaml, graphql or other."""
    t = F.regexp_replace(text_of(text), r"^\s+|\s+$", "")
    # top-level keys; null where the text isn't a JSON object
    keys = F.json_object_keys(F.when(t.startswith("{"), t))
    is_json = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ("paths", "openapi", "swagger")])), F.lit(False))
    is_sdl = t.rlike(r"(?i)\btype\s+\w+\s*\{|\bquery\b|\bmutation\b|\bschema\b\s*\{")
    return F.when(is_json, "openapi").when(t.rlike("(?i)^(openapi|swagger):"), "yaml").when(is_sdl, "graphql").otherwise("other")


@F.pandas_udf(StringType())
def _yaml_to_json(s: pd.Series) -> pd.Series:
    """Null where the text isn't a YAML object, or no reader of YAML is installed."""
    try:
        import yaml
    except ImportError:
        return pd.Series([None] * len(s), dtype=object)

    def one(t: str) -> str | None:
        try:
            data = yaml.safe_load(t)
        except yaml.YAMLError:
            return None
        return json.dumps(data, default=str) if isinstance(data, dict) else None

    return s.map(one)


@F.pandas_udf(StringType())
def _json_to_yaml(s: pd.Series) -> pd.Series:
    import yaml

    return s.map(lambda t: yaml.dump(json.loads(t), allow_unicode=True, sort_keys=False))


def trim_schema(schemas: DataFrame, top_k: int = 10) -> DataFrame:
    """schemas (schema_id, schema, task), told by their text: schema_id, trimmed. OpenAPI as JSON or YAML keeps its best
    operations, GraphQL loses long descriptions and deprecated fields, anything else stays as it is."""
    told = schemas.select("schema_id", "schema", "task", schema_kind(F.col("schema")).alias("kind"))
    bare = F.regexp_replace(text_of(F.col("schema")), r"^\s+|\s+$", "")
    read_in = told.filter("kind = 'yaml'").withColumn("read", _yaml_to_json(bare))
    as_yaml = trim_openapi(read_in.filter("read is not null").select("schema_id", F.col("read").alias("schema"), "task"), top_k)
    out = trim_openapi(told.filter("kind = 'openapi'").drop("kind"), top_k)
    out = out.unionByName(as_yaml.select("schema_id", _json_to_yaml("trimmed").alias("trimmed")))
    out = out.unionByName(told.filter("kind = 'graphql'").select("schema_id", trim_graphql(bare).alias("trimmed")))
    out = out.unionByName(told.filter("kind = 'other'").select("schema_id", F.col("schema").alias("trimmed")))
    return out.unionByName(read_in.filter("read is null").select("schema_id", F.col("schema").alias("trimmed")))
