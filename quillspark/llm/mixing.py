"""Mixing sources to target weights.

Tokens are summed per source; each source gets a target by weight, limited to a multiple of its own size, with
what exceeds a limit dealt again among the others. The repetition rate of a source is target over size. Every
document is emitted floor(rate) times, and once more if a number in [0, 1) drawn from a hash of the document is
below the fraction.

Only DataFrame expressions run: one aggregation (combined before the shuffle, so that a hot source is a few rows)
and one join with the table of sources, which is broadcast only behind a check of its counted rows.

Defined results: null text counts 0 words; a null source is a source of its own, last in order; sources of no words
have rate 0; repeated rows are drawn alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable, small_or_shuffled

#: White space between words, as in the contract of the query.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A reproducible number in [0, 1): the first 52 bits of an MD5 of seed, identifier and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """Per source: source_key, source_size, target, rate.

    Filling to a common level: with the sources in order of limit * size / weight, the level that is left for a
    source, if all before it are at their limits, is (total - their limits) / (weights not yet used). It rises
    while sources stop at their limits and falls afterwards, so its greatest value is the level of the rest. The
    windows below run over one row a source."""
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source_key").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long"))
    most = F.col("source_size") * limit
    sources = sources.withColumn("stop", most / F.col("weight")).withColumn("most", most)
    everything = Window.partitionBy()
    filling = Window.orderBy("stop", F.col("source_key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filling), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    sources = sources.withColumn("level", left.cast("double") / weight.cast("double"))
    level = F.max("level").over(everything)
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    sources = sources.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.select("source_key", "source_size", "target", rate.alias("rate"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    limit: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of docs with size, source_size, target, rate and copies (0 to limit) beside its own columns; own
    columns of those names give way."""
    added = ["size", "source_size", "target", "rate", "copies"]
    own = [c for c in docs.columns if c.lower() not in {*added, "source_key", "__source"}]
    keyed = lambda d: d.select(
        *own, word_count(F.col(text_col)).alias("size"), F.struct(F.col(source_col).alias("s")).alias("__source")
    )
    sized = docs.select(F.col(source_col).alias("source_key"), word_count(F.col(text_col)).alias("size"))
    targets = durable(source_targets(sized, weights, limit))
    # a null source joins as the struct {null}, which equals itself
    targets = targets.select(F.struct(F.col("source_key").alias("s")).alias("__source"), "source_size", "target", "rate")
    out = keyed(docs).join(small_or_shuffled(targets), "__source", "left").drop("__source")
    whole = F.floor("rate")
    more = draw(F.col(id_col), F.col(text_col), seed) < F.col("rate") - whole
    return out.withColumn("copies", whole.cast("long") + more.cast("long"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as its copies say."""
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter("copies > 0").select(*columns, again.alias("__copy")).select(*columns)
