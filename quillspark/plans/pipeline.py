"""The text-reduction pipeline: stages in a fixed order, metrics for each, over a DataFrame of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import arrow
from quillspark.functions.text import deduplicate_blocks, normalize_whitespace, quality_score, ratio, text_of, token_count

TECHNIQUES = ("whitespace", "deduplication", "format", "semantic_dedup")


@dataclass(frozen=True)
class Config:
    techniques: tuple[str, ...] = TECHNIQUES
    similarity_threshold: float = 0.85
    indent_spaces: int = 2
    min_block_tokens: int = 5
    minify_json: bool = True
    unit: str = "sentence"
    language: str = "auto"
    backend: str = "approx"
    rag_min_score: float = 0.0
    rag_max_tokens: int = 2000
    keep_recent: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Stage:
    name: str
    apply: Callable[[Column], Column]
    lossless: bool = True


def function_stage(name: str, fn: Callable[[str], str], lossless: bool = True) -> Stage:
    """A stage from a Python function; where it raises or gives no string, the text stays as it was."""

    @F.pandas_udf(StringType())
    def guarded(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                out = fn(t)
            except Exception:
                return t
            return out if isinstance(out, str) else t

        return s.map(one)

    return Stage(name, lambda c: guarded(c), lossless)


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...] = ()
    backend: str = "approx"
    skip_lossy: bool = field(default=False)

    def add(self, stage: Stage) -> Pipeline:
        return replace(self, stages=(*self.stages, stage))

    def run(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with compressed, tokens before and after, ratio, reduction_pct, quality_score and the stages."""
        out = docs.withColumn("__0", text_of(F.col(text_col)))
        used = [s for s in self.stages if s.lossless or not self.skip_lossy]
        for i, stage in enumerate(used):
            out = out.withColumn(f"__{i + 1}", F.coalesce(stage.apply(F.col(f"__{i}")), F.col(f"__{i}")))
        count = [token_count(F.col(f"__{i}"), self.backend) for i in range(len(used) + 1)]
        out = out.withColumn("__n", F.array(*count))
        metrics = [F.struct(F.lit(s.name).alias("name"), F.get("__n", F.lit(i)).alias("tokens_before"), F.get("__n", F.lit(i + 1)).alias("tokens_after")) for i, s in enumerate(used)]
        before, after = F.get("__n", F.lit(0)), F.element_at("__n", -1)
        empty = F.array().cast("array<struct<name:string,tokens_before:bigint,tokens_after:bigint>>")
        return out.select(
            *docs.columns, F.col(f"__{len(used)}").alias("compressed"), before.alias("original_tokens"), after.alias("compressed_tokens"),
            ratio(before, after).alias("ratio"), (ratio(before, after) * 100).alias("reduction_pct"),
            quality_score(F.col("__0"), F.col(f"__{len(used)}")).alias("quality_score"), (F.array(*metrics) if metrics else empty).alias("stages"),
        )


def build(config: Config = Config()) -> Pipeline:
    stages = {
        "whitespace": Stage("whitespace", lambda c: normalize_whitespace(c, config.indent_spaces)),
        "deduplication": Stage("deduplication", lambda c: deduplicate_blocks(c, config.min_block_tokens)),
        "format": Stage("format", lambda c: arrow.optimize_format(c, config.minify_json)),
        "semantic_dedup": Stage("semantic_dedup", lambda c: arrow.semantic_dedup(c, config.similarity_threshold, config.unit, config.language), False),
    }
    chosen = config.techniques or TECHNIQUES
    return Pipeline(tuple(stages[t] for t in TECHNIQUES if t in chosen), config.backend)


def compress_documents(docs: DataFrame, config: Config = Config(), text_col: str = "text") -> DataFrame:
    return build(config).run(docs, text_col)


def stage_table(compressed: DataFrame, names: tuple[str, ...] = TECHNIQUES) -> DataFrame:
    """Tokens before and after each stage over all documents: sums by place in the array, one row of them, then rows."""
    total = lambda i, c: F.sum(F.get("stages", F.lit(i))[c])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), total(i, "tokens_before").alias("tokens_before"), total(i, "tokens_after").alias("tokens_after")) for i, n in enumerate(names)]
    sums = compressed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return sums.withColumn("saved", F.col("tokens_before") - F.col("tokens_after"))


#: US dollars per million input and output tokens; models not listed count as 3.0.
PRICES = (
    ("claude-opus-4-8", 15.0, 75.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-haiku-4-5-20251001", 0.8, 4.0),
    ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("claude-3-5-haiku-20241022", 0.8, 4.0),
    ("claude-3-opus-20240229", 15.0, 75.0),
    ("claude-3-sonnet-20240229", 3.0, 15.0),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4-turbo", 10.0, 30.0),
    ("gpt-3.5-turbo", 0.5, 1.5),
)


def estimate_cost(docs: DataFrame, model_col: str = "model", before: str = "original_tokens", after: str = "compressed_tokens", prices: DataFrame | None = None) -> DataFrame:
    """docs with input_cost, compressed_cost, savings and savings_pct. The table of prices is as large as its models."""
    prices = prices if prices is not None else docs.sparkSession.createDataFrame(PRICES, "model string, input double, output double")
    prices = prices.select(F.col("model").alias("__model"), "input")
    rated = docs.join(F.broadcast(prices), docs[model_col] == F.col("__model"), "left").withColumn("__rate", F.coalesce("input", F.lit(3.0)) / 1e6)
    cost, less = F.col(before) * F.col("__rate"), F.col(after) * F.col("__rate")
    return rated.select(
        *docs.columns, cost.alias("input_cost"), less.alias("compressed_cost"), (cost - less).alias("savings"),
        F.when(cost == 0, 0.0).otherwise((cost - less) / cost * 100).alias("savings_pct"),
    )


def compress_tool_events(events: DataFrame, fill_col: str = "fill") -> DataFrame:
    """events (tool_name, command, output, fill and, for reads, session_id, path, seq): shown is the output filtered,
    shortened and compressed by the tool's profile, or null where that isn't shorter. A read of a file that the session
    has read before shows that it is unchanged, or the difference if that is short."""
    from quillspark.operators.logs import grep_output, needs_python, structural_output
    from quillspark.operators.session import PROFILES, read_deltas, tool_profile

    reads_known = {"session_id", "path", "seq"} <= set(events.columns)
    profile = tool_profile(F.col("tool_name"), F.col(fill_col))
    is_command = F.col("tool_name") == "Bash"
    kind = F.when(is_command, needs_python(F.col("command"), text_of(F.col("output"))))
    filtered = F.when(is_command, structural_output(F.col("command"), F.col("output"))).when(F.col("tool_name") == "Grep", grep_output(text_of(F.col("output")))).otherwise(text_of(F.col("output")))
    out = events.filter(F.col("tool_name").isin(*PROFILES)).withColumn("__p", profile)
    out = out.withColumns({"__f": filtered, "__k": kind})
    # named twice, the filters' result stays a column of its own: inside the Arrow step their nested lambdas could not run
    short = arrow.shorter(F.col("__f"), F.col("output"), F.col("__k"), F.col("__p.techniques"), F.col("__p.min_tokens"), F.col("__p.max_code_block_lines"))
    out = out.withColumn("shown", F.when(F.col("__f").isNotNull(), short)).drop("__p", "__f", "__k")
    if reads_known:
        known = read_deltas(events.filter("tool_name = 'Read' and path <> ''").select("session_id", "path", "seq", F.col("output").alias("content")))
        known = known.filter("kind in ('unchanged', 'diff')").select(*[F.col(c).alias(f"__{c}") for c in ("session_id", "path", "seq")], F.col("shown").alias("__shown"))
        same = F.lit(True)
        for c in ("session_id", "path", "seq"):
            same &= F.col(c) == F.col(f"__{c}")
        out = out.join(known, same & (F.col("tool_name") == "Read"), "left").withColumn("shown", F.coalesce("__shown", "shown"))
    others = events.filter(~F.coalesce(F.col("tool_name").isin(*PROFILES), F.lit(False))).withColumn("shown", F.lit(None).cast("string"))
    return out.select(*events.columns, "shown").unionByName(others)


def hook_response(shown: Column) -> Column:
    """What a hook answers with, as JSON; null where there is nothing to change."""
    return F.when(shown.isNotNull(), F.to_json(F.struct(F.struct(shown.alias("updatedToolOutput")).alias("hookSpecificOutput"))))
