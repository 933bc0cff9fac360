"""Sources and sinks. Inputs are read by Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is dealt out anew only if it has less than this for each core: beyond, its files give enough splits.
SMALL_SHARE = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. One that is small, and so may be a single row group that one task reads, is dealt out to all
    cores; the size is checked first, so large tables aren't moved."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().analyzed().stats().sizeInBytes()))  # of its files; no job runs
    return rows.repartition(cores) if (64 << 10) < size < cores * SMALL_SHARE else rows


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {role, content}: conv_id (the file), turn, role, text, blocks. Content is a string (text), or an
    array of blocks (blocks, with its text blocks joined by spaces as text); other fields of a block are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv_id"), "value")
    turns = whole.select("conv_id", F.posexplode(F.from_json("value", "array<struct<role:string,content:string>>")).alias("turn", "m"))
    # an array of blocks is read as its JSON
    blocks = F.from_json("m.content", "array<struct<type:string,text:string,url:string>>")
    blocks = F.when(F.col("m.content").startswith("["), blocks)
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: F.coalesce(b.text, F.lit(""))), " ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.coalesce(said, "m.content").alias("text"), blocks.alias("blocks"))


def read_tool_events(raw: DataFrame) -> DataFrame:
    """raw (value as JSON): tool events; malformed rows go."""
    schema = "struct<tool_name:string,output:string,tool_input:struct<command:string,file_path:string>,session_id:string>"
    parsed = raw.select(F.from_json("value", schema).alias("e")).filter(F.col("e.tool_name").isNotNull())
    return parsed.select("e.tool_name", "e.tool_input.command", "e.tool_input.file_path", "e.output", "e.session_id")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file {models: {name: {input_per_mtok, output_per_mtok}}}: model, input, output."""
    whole = spark.read.text(path, wholetext=True)
    models = F.from_json("value", "struct<models:map<string,struct<input_per_mtok:double,output_per_mtok:double>>>").models
    rows = whole.select(F.explode(F.coalesce(models, F.create_map().cast("map<string,struct<input_per_mtok:double,output_per_mtok:double>>"))).alias("model", "p"))
    return rows.select("model", F.col("p.input_per_mtok").alias("input"), F.col("p.output_per_mtok").alias("output"))


def write_results(compressed: DataFrame, path: str) -> None:
    """One JSON object a document: compressed_text, tokens and reduction_pct."""
    out = compressed.select("doc_id", F.col("compressed").alias("compressed_text"), "original_tokens", "compressed_tokens", F.round("reduction_pct", 1).alias("reduction_pct"))
    out.write.mode("overwrite").json(path)


def join_chunks(picked: DataFrame, separator: str = "---") -> DataFrame:
    """Selected chunks (query_id, pos, text) of each query as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda c: c.text)
    return picked.groupBy("query_id").agg(F.array_join(ordered, f"\n{separator}\n").alias("text"))


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    texts.select(column).write.mode("overwrite").text(path)


#: What is kept of a session.
SNAPSHOT = "session_key string, output_tokens long, input_tokens long, turns long, fill_fraction double, turn_number long"


def write_sessions(snapshots: DataFrame, path: str) -> None:
    """One JSON object a session: session_key and its counters."""
    names = [f.split()[0] for f in SNAPSHOT.split(", ")]
    snapshots.select(*names).write.mode("overwrite").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of sessions; counters that lack or can't be read are 0, lines without a session go."""
    held = spark.read.schema(SNAPSHOT).json(path).filter("session_key is not null")
    return held.fillna(0)


def read_profiles(spark: SparkSession, path: str | None) -> dict[str, tuple[list[str], int, int]]:
    """Profiles of tools, with those of a JSON file {tool: {techniques, min_tokens, max_code_block_lines}} over the
    defaults. Without a file, or if it can't be read, the defaults. As large as the number of tools."""
    from quillspark.operators.session import OTHER_TOOL, PROFILES

    known = dict(PROFILES)
    if path is None:
        return known
    kind = "map<string,struct<techniques:array<string>,min_tokens:int,max_code_block_lines:int>>"
    try:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("tool", "p")).collect()
    except AnalysisException:  # no such file
        return known
    for tool, p in rows:
        given = (p["techniques"], p["min_tokens"], p["max_code_block_lines"]) if p else (None, None, None)
        known[tool] = tuple(o if g is None else g for g, o in zip(given, OTHER_TOOL, strict=True))
    return known
