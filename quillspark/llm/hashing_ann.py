"""Approximate nearest neighbours by multi-index hashing.

Codes are signs of a learned rotation: principal directions of a bounded sample, then alternate updates of codes and an
orthogonal map (iterative quantisation). A code is split into substrings, each indexed. By the pigeonhole principle a
code within `radius` of a query agrees in some substring up to radius // substrings bits, so probing each index with
the query's substring and its neighbours of that distance retrieves every code within the radius. What is retrieved
and within the radius is ranked again by double-precision inner products of the original vectors.

The radius is set on the whole table: for up to ASKED vectors of the sample the true neighbours among all vectors are
found by brute force, and the radius is the smallest that holds `recall` of them. So it shrinks as the table grows and
its neighbours come nearer. The number of substrings is the one with the least estimated work at that radius: a small
radius gets few, long and selective ones. Queries that find fewer entries than places within the radius are
probed again with one half-way to all bits, and those still short with all bits, so each gets k whenever there are k.
Equal vectors are one entry of the index with its smallest ids
(never more than k + 1 can be among k results), and equal queries are answered once. Queries and vectors are dealt
into blocks of bounded size and every block of queries meets every block of vectors, each with its own index; a task
returns the best k + 1 a query. So a vector is copied once for each block of QUERY_BLOCK queries, whatever is near it.

Defined results: rows without vec_id, and vectors that are null, empty, zero, of another length than most of the sample,
or that hold a null or non-finite component take no part; rows that repeat (equal id and vector) count once; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stored

SAMPLE, ASKED = 4096, 256
VECTOR_BLOCK, QUERY_BLOCK = 16384, 2048


class Codes:
    def __init__(self, sample: np.ndarray, bits: int | None = None, rounds: int = 30, seed: int = 5):
        size = sample.shape[1]
        bits = min(bits or size, size, 64)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, ::-1][:, :bits]
        flat = centred @ main
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.map, self.bits = main @ turn, bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.map > 0
        return (on * (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))).sum(1, dtype=np.uint64) if len(x) else np.zeros(0, np.uint64)


class Index:
    """Substring tables over codes."""

    def __init__(self, codes: np.ndarray, bits: int, substrings: int):
        self.codes = codes
        self.edges = np.linspace(0, bits, substrings + 1).astype(int)
        self.tables = []
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            part = self._part(codes, a, b)
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << (b - a)) + 1))))

    @staticmethod
    def _part(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return (codes >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        if radius >= self.edges[-1]:
            return np.arange(len(self.codes))
        reach = radius // len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for (order, bounds), a, b in zip(self.tables, self.edges[:-1], self.edges[1:], strict=True):
            own = int(code) >> int(a) & ((1 << int(b - a)) - 1)
            for k in range(min(reach, b - a) + 1):
                for flips in combinations(range(b - a), k):
                    key = own ^ sum(1 << f for f in flips)
                    hit[order[bounds[key] : bounds[key + 1]]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def usable(vector: Column) -> Column:
    doubles = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    fine = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return fine & F.exists(doubles, lambda x: x != 0)


def learn(vectors: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> tuple[Codes, int, int] | None:
    """vectors: (entry, vector). The codes from the sample with the smallest hashes, the radius and the vectors' length."""
    rows = vectors.orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    held = rows.column("vector").to_pylist()
    size = max(sorted({len(r) for r in held}), key=[len(r) for r in held].count)
    fits = [i for i, r in enumerate(held) if len(r) == size]
    x, names = np.array([held[i] for i in fits], float), rows.column("entry").to_numpy()[fits]
    codes = Codes(x)
    some = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    asked, own, theirs = x[some], names[some], codes(x[some])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = np.stack(batch["vector"].to_numpy())
            score = asked @ held.T
            score[own[:, None] == batch["entry"].to_numpy()[None, :]] = -np.inf
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            apart = np.bitwise_count(theirs[:, None] ^ codes(held)[at])
            yield pd.DataFrame({"asked": np.repeat(np.arange(len(asked)), at.shape[1]), "score": np.take_along_axis(score, at, 1).ravel(), "apart": apart.ravel().astype("int32")})

    near = vectors.filter(F.size("vector") == size).mapInPandas(nearest, "asked int, score double, apart int").filter("score > double('-Infinity')")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "apart"))
    apart = np.sort(near.withColumn("place", place).filter(F.col("place") <= k).select("apart").toArrow().column("apart").to_numpy())
    radius = int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if len(apart) else codes.bits
    return codes, radius, size


def best_substrings(bits: int, radius: int, held: int) -> int:
    """The number of substrings with the least work for a query of so many codes: keys probed, and entries found there."""

    def work(m: int) -> float:
        size = -(-bits // m)
        keys = m * sum(comb(size, j) for j in range(min(radius // m, size) + 1))
        return 1500 * keys + 2 * held * keys / (1 << size) + 50 * m * (1 << size) / QUERY_BLOCK  # the last for the tables

    return min((m for m in range(1, bits + 1) if -(-bits // m) <= 16), key=work)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.97,
    substrings: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("asks", F.coalesce(is_query, F.lit(False))).filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), "asks")
    # equal vectors are one entry, known by the smallest id
    number = Window.partitionBy("vector").orderBy("id")
    ids = rows.groupBy("vector", "id").agg(F.max("asks").alias("asks"))
    ids = stored(ids.withColumns({"entry": F.first("id").over(number), "n": F.row_number().over(number)}))
    found = learn(ids.filter("n = 1").select("entry", "vector"), k, recall)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes, radius, size = found
    entries = ids.filter((F.col("n") == 1) & (F.size("vector") == size)).select("entry", "vector")
    queries = ids.filter(F.col("asks") & (F.size("vector") == size)).select("entry", "vector").distinct()
    n_vectors = entries.count()
    deal = lambda d, blocks, others, own, other: d.withColumn(own, F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")

    def probe(asking: DataFrame, n_queries: int, radius: int) -> DataFrame:
        """The best k + 1 entries within the radius of each query."""
        v_blocks, q_blocks = max(1, -(-n_vectors // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
        left = deal(asking, q_blocks, v_blocks, "qb", "vb").groupBy("qb", "vb")
        right = deal(entries, v_blocks, q_blocks, "vb", "qb").groupBy("qb", "vb")
        near = left.cogroup(right).applyInPandas(lambda asked, held: meet(asked, held, radius), "query long, entry long, score double")
        return near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")

    def meet(asked: pd.DataFrame, held: pd.DataFrame, radius: int) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(asked) or not len(held):
            return none
        x, names = np.stack(held["vector"].to_numpy()), held["entry"].to_numpy()
        order = np.argsort(names, kind="stable")
        x, names = x[order], names[order]
        index = Index(codes(x), codes.bits, min(substrings or best_substrings(codes.bits, radius, len(x)), codes.bits))
        q = np.stack(asked["vector"].to_numpy())
        out = []
        for name, vector, code in zip(asked["entry"].to_numpy(), q, codes(q), strict=True):
            at = index.within(code, radius)
            score = x[at] @ vector
            if len(at) > k + 1:  # ties beyond the last place go to the smaller id: keep all that tie with it
                edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                some = score >= edge
                at, score = at[some], score[some]
                best = np.argsort(-score, kind="stable")[: k + 1]
                at, score = at[best], score[best]
            out.append(pd.DataFrame({"query": name, "entry": names[at], "score": score}))
        return pd.concat(out) if out else none

    near = stored(probe(queries, queries.count(), radius))
    while radius < codes.bits:
        filled = near.groupBy("query").count().filter(F.col("count") >= min(k + 1, n_vectors)).select(F.col("query").alias("entry"))
        short = stored(queries.join(filled, "entry", "left_anti"))
        n_short = short.count()
        if not n_short:
            break
        radius = codes.bits if radius > found[1] else (radius + codes.bits + 1) // 2
        kept = near.join(short.select(F.col("entry").alias("query")), "query", "left_anti")
        near = stored(kept.unionByName(probe(short, n_short, radius)))
    # from entries back to ids: at most k + 1 of an entry, for each query entry and then for each query
    members = ids.filter(F.col("n") <= k + 1).select("entry", F.col("id").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    wide = near.join(members, "entry").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    asking = ids.filter("asks").select(F.col("entry").alias("query"), F.col("id").alias("query_id"))
    pairs = asking.join(wide.select("query", "vec_id", "score"), "query").filter("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
