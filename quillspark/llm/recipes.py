"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes ends in zeros, so equal stretches give equal chunks wherever
they stand. Chunks are known by short digests; these become verified identifiers by one pass that brings together the
distinct chunks of each digest (combined before the shuffle) and finds no two that differ. If any differ, the digest
is lengthened and the pass repeated. From then on a document is its recipe, the ordered list of its chunks'
identifiers: equal recipes mean equal texts, and only recipes are grouped and joined. Long texts don't move again.

Groups are one aggregation (combined before the shuffle); the join back is a sort-merge join between a stored table
and the aggregate, which Spark's adaptive execution splits where one recipe is hot.

Defined results: null text counts as empty, and empty texts are equal to each other; of equal texts the row with the
largest doc_id stays (null is the smallest), of rows that repeat with the same doc_id one; an empty table gives an
empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable, stored
from quillspark.llm.textnp import tidy

_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def chunk_ends(data: bytes, mean_bits: int = 11, least: int = 512, most: int = 16384) -> list[int]:
    """Where the chunks of data end. Chunks have least to most bytes, but for the last."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # a window of 2, 4, 8, 16 bytes
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    places = (np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1).tolist()
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least or p == n:
            if p > last:
                ends.append(p)
            last = p
    return ends


def chunks(data: bytes, **cut) -> list[bytes]:
    ends = chunk_ends(data, **cut)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _encoded(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _recipe_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, shas = [], []
            for data in _encoded(batch.column("text")):
                recipes.append(b"".join(hashlib.blake2b(c, digest_size=size).digest() for c in chunks(data)))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(recipes, pa.binary()), pa.array(shas, pa.string())], names=["doc_id", "recipe", "text_sha256"]
            )

    return tidy(rows)


def _chunk_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c for data in _encoded(batch.column("text")) for c in chunks(data)}  # once a batch
            found = list(found)
            digests = [hashlib.blake2b(c, digest_size=size).digest() for c in found]
            for i in range(0, len(found), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(digests[i : i + 2000], pa.binary()), pa.array(found[i : i + 2000], pa.binary())], names=["digest", "chunk"])

    return tidy(rows)


def unverified(docs: DataFrame, size: int) -> DataFrame:
    """Digests that stand for more than one chunk."""
    pairs = docs.mapInArrow(_chunk_rows(size), "digest binary, chunk binary").groupBy("digest", "chunk").agg(F.count("*").alias("n"))
    return pairs.groupBy("digest").agg(F.count("*").alias("variants")).filter("variants > 1")


def recipes(docs: DataFrame, digest_bytes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, recipe (verified), text_sha256, row (a number that tells equal rows apart); stored."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    texts = source.select("text")
    while unverified(texts, digest_bytes).limit(1).count():
        if digest_bytes == 64:
            raise ArithmeticError("two different chunks share a 64-byte digest")
        digest_bytes = min(64, digest_bytes + 8)
    out = source.mapInArrow(_recipe_rows(digest_bytes), f"doc_id {kind}, recipe binary, text_sha256 string")
    return stored(out.withColumn("row", F.monotonically_increasing_id()))


def exact_duplicates(docs: DataFrame, digest_bytes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    known = recipes(docs, digest_bytes, id_col, text_col)
    groups = known.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("same"), "last", "group_size")
    out = known.join(stored(groups), F.col("recipe") == F.col("same"))
    return out.select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat doc_id and text, the one whose other
    columns (as JSON) have the smallest hash stays."""
    found = durable(exact_duplicates(docs, 16, id_col, text_col))
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("kept")
    said = F.sha2(F.coalesce(F.col(f"docs.{text_col}").cast("string"), F.lit("")), 256)
    out = docs.alias("docs").join(kept, F.col(f"docs.{id_col}").eqNullSafe(F.col("kept.id")) & (said == F.col("kept.sha")), "left_semi")
    # only where a row repeats with its doc_id are there several to choose from
    if not found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rest = [c for c in docs.columns if c not in (id_col, text_col)]
        order = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
        key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
        place = f"__place_{uuid.uuid4().hex}"
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(id_col, key).orderBy(order))).filter(F.col(place) == 1).drop(place)
    return out
