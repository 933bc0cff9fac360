"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents.

Language ID learns from the documents of sf_dir that aren't held out. Documents that it can't place go: those without
text or letter (`und`), and those of which no language has MIN_SCORE of the network's mean probability. Of equal texts the one with the largest doc_id stays, of near duplicates (word 5-grams,
Jaccard 0.8 or more) the one with the smallest. Mixing emits each document as often as its source's rate says, so rows
repeat from there on. Packing returns pieces of token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, neardup, packing, recipes
from quillspark.llm.common import checkpoint_dir, stored, table


#: A document is rejected if its likeliest language is less likely than this (four languages at chance: 0.25).
MIN_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents")
    net = langid.train(labelled.filter(~langid.held_out(F.col("doc_id"))))
    if net is None:  # nothing to learn from: only what no network could place goes
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # columns of docs that have the names of what is predicted are put aside
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}
    said = langid.predict(docs.withColumnsRenamed(aside), net)
    placed = said.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE)).drop("lang_pred", "score")
    return placed.withColumnsRenamed({new: old for old, new in aside.items()}).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recipes.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't the kept one of their group go. A row is known by its doc_id (none comes last) and a hash of its
    text. The rows to drop are few beside the texts, so they are what is looked up."""
    said = F.xxhash64("text")
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", said.alias("said")).alias("row"), "text")
    found = neardup.near_duplicates(named, id_col="row").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = stored(found.select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.said").alias("gone_said")).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (said == F.col("gone_said")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network, set similarity and byte-pair encoding are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
