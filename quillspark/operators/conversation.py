"""Conversation history: old turns are compressed, recent ones stay; extractive summaries; request shapes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import arrow
from quillspark.functions.text import deduplicate_blocks, normalize_whitespace, sentences, strip, terms, text_of, token_count, words


def _folded(old: DataFrame, threshold: float) -> DataFrame:
    """old (conv_id, turn, part, role, text, short): short without the sentences like one kept earlier in the conversation.
    A conversation's rows stream by in order; what is held are its kept sentences, not its turns."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, kept = (), arrow.Kept(threshold)
        for batch in batches:
            out = []
            for c, text, short in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "short")), strict=True):
                if (c,) != conv:
                    conv, kept = (c,), arrow.Kept(threshold)
                out.append(text if not (text or "").strip() else arrow.leader_fold(short, kept, threshold))
            yield batch.set_column(batch.schema.get_field_index("short"), "short", pa.array(out, pa.string()))

    return old.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part").mapInArrow(fold, old.schema)


def _compressed(parts: DataFrame, threshold: float, summarize: bool, summarize_ratio: int) -> DataFrame:
    old = _folded(parts.withColumn("short", deduplicate_blocks(normalize_whitespace(F.col("text")))), threshold)
    return old.withColumn("short", summary(F.col("short"), summarize_ratio)) if summarize else old


def _aged(turns: DataFrame, keep_recent: int, summarize_ratio: int) -> tuple[DataFrame, DataFrame]:
    """The turns that are compressed, and those that stay: the last keep_recent, or all where that is 0."""
    if keep_recent < 0 or summarize_ratio < 1:
        raise ValueError("keep_recent is 0 or more, summarize_ratio 1 or more")
    ranked = turns.withColumn("__age", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    old = (F.col("__age") > keep_recent) if keep_recent else F.lit(False)
    return ranked.filter(old).drop("__age"), ranked.filter(~old).drop("__age")


def compress_history(turns: DataFrame, keep_recent: int = 5, threshold: float = 0.85, summarize: bool = False, summarize_ratio: int = 3) -> DataFrame:
    """turns (conv_id, turn, role, text): the same columns. The last keep_recent turns stay as they are (none stays
    special with 0: nothing is compressed); of the others, sentences like an earlier turn's go, and turns that become
    empty go."""
    old, recent = _aged(turns.select("conv_id", "turn", "role", "text"), keep_recent, summarize_ratio)
    old = old.select("conv_id", "turn", F.lit(0).alias("part"), "role", "text")
    old = _compressed(old, threshold, summarize, summarize_ratio).filter("short <> ''")
    return old.select("conv_id", "turn", "role", F.col("short").alias("text")).unionByName(recent)


def compress_block_history(turns: DataFrame, keep_recent: int = 5, threshold: float = 0.85, summarize: bool = False, summarize_ratio: int = 3) -> DataFrame:
    """turns (conv_id, turn, role, blocks: array<struct<type, text, ...>>): as compress_history, each text block by itself;
    text blocks that become empty go, other blocks stay, and turns without blocks go."""
    old, recent = _aged(turns.select("conv_id", "turn", "role", "blocks"), keep_recent, summarize_ratio)
    parts = old.select("conv_id", "turn", "role", F.posexplode("blocks").alias("part", "block"))
    said = parts.filter("block.type = 'text'").select("conv_id", "turn", "part", "role", F.col("block.text").alias("text"), "block")
    said = _compressed(said, threshold, summarize, summarize_ratio).filter("short <> ''")
    said = said.select("conv_id", "turn", "role", "part", F.col("block").withField("text", F.col("short")).alias("block"))
    rest = parts.filter("not block.type <=> 'text'").select("conv_id", "turn", "role", "part", "block")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "block"))), lambda x: x.block)
    again = said.unionByName(rest).groupBy("conv_id", "turn", "role").agg(ordered.alias("blocks"))
    return again.unionByName(recent)


@F.pandas_udf(StringType())
def _top(s: pd.Series, keep: pd.Series) -> pd.Series:
    import math
    from collections import Counter

    def one(units: list[str], k: int) -> str:
        bags = [t.split(" ") if t else [] for t in (u.split("\x00")[1] for u in units)]
        df = Counter(t for b in bags for t in set(b))
        n = len(units)
        score = [sum(c / len(b) * math.log((n + 1) / (df[t] + 1)) for t, c in sorted(Counter(b).items())) if b else 0.0 for b in bags]
        best = sorted(sorted(range(n), key=lambda i: (-round(score[i], 12), i))[:k])
        return " ".join(units[i].split("\x00")[0] for i in best)

    return pd.Series([None if u is None else one(list(u), int(k)) for u, k in zip(s, keep, strict=True)])


def summary(text, ratio: int = 3):
    """The sentences with the greatest TF-IDF weight, a share of 1 / ratio and at least two, in their own order."""
    found = F.filter(F.transform(sentences(strip(text)), strip), lambda u: u != "")
    n = F.size(found)
    keep = F.greatest(F.lit(2), F.ceil(n / F.lit(float(ratio))).cast("int"))
    with_terms = F.transform(found, lambda u: F.concat_ws("\x00", u, F.array_join(terms(u, []), " ")))
    head = F.format_string("[Summary: %d->%d sentences] ", n, keep)
    return F.when((n <= 2) | (keep >= n), text).otherwise(F.concat(head, _top(with_terms, keep)))


def count_messages(turns: DataFrame, backend: str = "approx") -> DataFrame:
    """Per conversation: each message rounded up by itself, and all joined by spaces and counted once. Joining by spaces
    adds up words, and characters with one for each space, so only sums are shuffled."""
    text = text_of(F.col("text"))
    if backend == "approx":
        at_once = F.ceil(F.sum(F.size(words(text))) * F.lit(1.3))
    elif backend == "chars":
        at_once = F.ceil((F.sum(F.length(text)) + F.count("*") - 1) / F.lit(4.0))
    else:
        raise ValueError(f"no such backend: {backend}")
    return turns.groupBy("conv_id").agg(F.sum(token_count(text, backend)).alias("per_message"), at_once.cast("long").alias("at_once"))


def block_text(blocks):
    """Content given as an array of {type, text}: the text blocks, joined by spaces."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: text_of(b.text)), " ")


def _by_lines(condition):
    return F.array_join(F.transform(F.filter("all", condition), lambda m: m.text), "\n")


def _ordered(turns: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", text_of(F.col("text")).alias("text"))))
    return turns.groupBy("conv_id").agg(ordered.alias("all"))


def request_parts(turns: DataFrame) -> DataFrame:
    """Per conversation: the system text, and what identifies the request in a cache (system and history, by lines)."""
    system, rest = _by_lines(lambda m: m.role == "system"), _by_lines(lambda m: m.role != "system")
    return _ordered(turns).select("conv_id", system.alias("system"), F.concat_ws("\n", F.when(system != "", system), rest).alias("cache_text"))


def _system_compressed(turns: DataFrame, config) -> DataFrame:
    """System turns as prompts: each by itself, through the whole pipeline."""
    from quillspark.plans.pipeline import compress_documents

    return compress_documents(turns.filter("role = 'system'").select("conv_id", "turn", "role", "text"), config).select("conv_id", "turn", "role", F.col("compressed").alias("text"))


def system_first_messages(turns: DataFrame, config, keep_recent: int = 5) -> DataFrame:
    """The request shape with system messages in the list: conv_id, pos, role, text. System messages are compressed as
    prompts and come first; the others are compressed as a history."""
    history = compress_history(turns.filter("not role <=> 'system'"), keep_recent, config.similarity_threshold)
    both = _system_compressed(turns, config).unionByName(history.select("conv_id", "turn", "role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "turn")
    return both.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def system_apart_requests(turns: DataFrame, config, keep_recent: int = 5) -> DataFrame:
    """The request shape with the system text apart: conv_id, system, messages, cache_text (of what is sent). The system
    text is that of the system turns by lines, compressed as one prompt; the others are compressed as a history."""
    named = request_parts(turns).filter("system <> ''").select("conv_id", F.lit(0).alias("turn"), F.lit("system").alias("role"), F.col("system").alias("text"))
    history = compress_history(turns.filter("not role <=> 'system'"), keep_recent, config.similarity_threshold)
    both = _system_compressed(named, config).unionByName(history.select("conv_id", "turn", "role", "text"), allowMissingColumns=True)
    system, rest = _by_lines(lambda m: m.role == "system"), F.filter("all", lambda m: m.role != "system")
    messages = F.transform(rest, lambda m: F.struct(m.role.alias("role"), m.text.alias("text")))
    said = F.array_join(F.transform(rest, lambda m: m.text), "\n")
    return _ordered(both).select("conv_id", system.alias("system"), messages.alias("messages"), F.concat_ws("\n", F.when(system != "", system), said).alias("cache_text"))
